"""Golden cases of the operators, on small frames and folders."""

import hashlib
import json
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbom.functions import columns as C
from quillbom.functions import rules
from quillbom.operators import assess, relate, sbom, scan, views
from quillbom.sources import repository
from quillbom.streaming import drops

LOCK = {
    "lockfileVersion": 3,
    "packages": {
        "": {"version": "1.0.0", "dependencies": {"express": "^4.18.2", "loose-dep": "*"}},
        "node_modules/express": {"version": "4.18.2", "resolved": "u", "dependencies": {"accepts": "~1.3.8", "body-parser": "^0.0.1"}},
        "node_modules/accepts": {"version": "1.3.8"},
        "node_modules/loose-dep": {"version": "2.0.0", "dev": True, "hasInstallScript": True},
        "node_modules/express/node_modules/body-parser": {"version": "1.20.1", "integrity": ""},
        "node_modules/link": {"resolved": "x"},
    },
}


def values(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_lockfile(spark):
    entries = repository.lock_entries(spark.createDataFrame([(json.dumps(LOCK),)], "text string"))
    rows = {r["name"]: r for r in sbom.components(entries).collect()}
    assert set(rows) == {"express", "accepts", "loose-dep", "body-parser"}
    assert rows["express"]["purl"] == "pkg:npm/express@4.18.2" and rows["express"]["declaredRanges"] == ["^4.18.2"]
    assert rows["loose-dep"]["dev"] and not rows["accepts"]["dev"]
    assert rows["body-parser"]["declaredRanges"] == ["^0.0.1"] and rows["body-parser"]["integrity"] is None


def test_old_lockfile_is_an_error(spark):
    old = spark.createDataFrame([(json.dumps({"lockfileVersion": 1, "packages": {}}),)], "text string")
    with pytest.raises(Exception, match="Unsupported lockfile"):
        repository.lock_entries(old).collect()


def test_anomalies(spark):
    parts = sbom.components(repository.lock_entries(spark.createDataFrame([(json.dumps(LOCK),)], "text string")))
    popular = spark.createDataFrame([("express", 1), ("acceptz", 2)], "name string, rank int")
    registry = spark.createDataFrame([("express", None, "MIT", None), ("body-parser", "2024-01-01", "GPL-3.0", "old")], "name string, published string, license string, deprecated string")
    registry = registry.withColumn("published", F.col("published").cast("timestamp"))
    downloads = spark.createDataFrame([("body-parser", 5)], "name string, weekly long")
    found = sbom.anomalies(parts, popular, registry, downloads, F.lit("2024-01-02").cast("timestamp"))
    hits = {(r["purl"].split("/")[1], r["type"], r["severity"]) for r in found.collect()}
    assert ("accepts@1.3.8", "typosquat", "high") in hits
    assert ("loose-dep@2.0.0", "version-pinning", "low") in hits and ("loose-dep@2.0.0", "install-script", "high") in hits
    assert ("body-parser@1.20.1", "license", "high") in hits and ("body-parser@1.20.1", "deprecated", "high") in hits
    assert not any(h[0].startswith("express") for h in hits)
    assert not any(h[1] == "freshness" for h in hits)  # body-parser has a loose range already


@pytest.mark.parametrize(
    ("best", "context", "expected"),
    [((0.95, 0.90, None), "production", 0.99), ((0.80, None, None), "production", 0.80), ((None, 0.65, None), "production", 0.65), ((None, 0.55, None), "production", 0.55), ((0.95, 0.90, None), "unknown", 0.693), ((None, 0.6, 0.85), "vendor", 0.507)],
)
def test_score(spark, best, context, expected):
    columns = [F.lit(b).cast("double") for b in best]
    assert values(spark, C.score(*columns, F.lit(context))) == expected


@pytest.mark.parametrize(
    ("asset", "material", "name", "parameter", "path", "sources", "details", "expected"),
    [
        ("related-crypto-material", "private-key", "k", None, "a/test-key.pem", ["keys_certs"], ["PEM header"], "CRITICAL"),
        ("related-crypto-material", "private-key", "k", None, "src/a.js", ["keys_certs"], ["PEM header"], "CRITICAL"),
        ("related-crypto-material", "private-key", "k", None, "src/a.js", ["ast"], ["generateKeyPair(rsa)"], "NONE"),
        ("certificate", None, "c", None, "a.crt", ["ast"], [""], "LOW"),
        ("algorithm", None, "AES", None, "src/a.js", ["ast"], [""], "NONE"),
        ("algorithm", None, "JWT", "weak-secret", "src/a.js", ["ast"], [""], "HIGH"),
    ],
)
def test_exposure(spark, asset, material, name, parameter, path, sources, details, expected):
    text = lambda v: F.lit(v).cast("string")
    array = lambda v: F.array(*[F.lit(x) for x in v])
    assert values(spark, C.exposure_risk(text(asset), text(material), text(name), text(parameter), text(path), array(sources), array(details))) == expected


def tree(tmp_path, spark, files):
    for name, data in files.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data if isinstance(data, bytes) else data.encode())
    return repository.files(spark, str(tmp_path))


def test_scanners(spark, tmp_path):
    pem = "x\n-----BEGIN EC PRIVATE KEY-----\nAA\n-----END EC PRIVATE KEY-----\n\n\n-----BEGIN PUBLIC KEY-----\nBB\n-----END PUBLIC KEY-----\n"
    files = tree(tmp_path, spark, {
        "keys.js": pem, "src/table.bin": b"ab\n" + bytes.fromhex(rules.BYTE_CONSTANTS["MD5"]), "test/keys.js": pem, "package-lock.json": json.dumps(LOCK),
        "src/app.js": "const j = require('jose');\n/* verify(a)\n sign(b) */ x\nfoo.verifyToken(c) // sign(d)\nhashmap.get(1)\n",
    })
    blocks = scan.pem_blocks(repository.pem_files(files)).collect()
    assert {(r["filePath"], r["line"], r["materialType"]) for r in blocks} == {("keys.js", 2, "private-key"), ("keys.js", 7, "public-key")}
    constants = scan.byte_constants(repository.constant_files(files)).collect()
    assert [(r["name"], r["filePath"], r["line"]) for r in constants] == [("MD5", "src/table.bin", 2)]
    lines = scan.candidates(repository.code_files(files).where("path like 'src/%'"), scan.byte_constants(files)).collect()
    assert {r["line"] for r in lines} == {1, 4}
    assert repository.lockfile(files).count() == 1
    with pytest.raises(Exception, match="No package-lock.json found"):
        repository.lockfile(files.where("path = 'keys.js'")).collect()


def test_code_files(spark, tmp_path):
    names = ["a.js", "b.d.ts", "c.test.js", "dist/d.js", "node_modules/bcrypt/lib/e.js", "node_modules/lodash/f.js", "node_modules/bcrypt/test/g.js", "h.TS"]
    files = tree(tmp_path, spark, {n: "x" for n in names})  # Spark passes empty files by
    assert {r["path"] for r in repository.code_files(files).collect()} == {"a.js", "node_modules/bcrypt/lib/e.js", "h.TS"}


def plain_merge(rows, window=2):
    kept = []
    for r in sorted(rows, key=lambda x: x["seq"]):
        for k in kept:
            apart = abs(k["line"] - r["line"])
            families = {k["family"], r["family"]} - {None}
            if k["path"] == r["path"] and apart <= window and len(families) < 2 and (apart == 0 or not k["sources"] & r["sources"]):
                k["sources"] = k["sources"] | r["sources"]
                k["n"] += 1
                k["family"] = k["family"] or r["family"]
                break
        else:
            kept.append(dict(r, n=1))
    return sorted((k["seq"], k["family"], k["n"]) for k in kept)


@pytest.mark.parametrize("seed", range(8))
def test_merge(spark, seed, monkeypatch):
    """Files of few and of many ranges, dense and sparse, with and without a path; groups that go on over several ranges."""
    rng = random.Random(seed)
    monkeypatch.setattr(assess, "HELD_ROWS", rng.choice([1, 10_000]))
    files, most, n = rng.choice(["ab", "a", ["a", None, "b", "c"]]), rng.choice([3, 25, 100]), rng.choice([60, 250])
    plain = [{"seq": i, "path": rng.choice(files), "line": rng.randint(1, most), "family": rng.choice([None, "AES", "RSA"]), "sources": {rng.choice(["ast", "llm", "constant"])}} for i in range(n)]
    evidence = lambda r: [{"source": s, "evidenceClass": "direct", "detail": "", "rawConfidence": 0.5, "filePath": r["path"], "line": r["line"]} for s in r["sources"]]
    rows = [(r["seq"], "algorithm", "unknown", None, r["family"], None, None, None, r["path"], r["line"], None, evidence(r)) for r in plain] + [(n, "algorithm", "unknown", None, "AES", None, None, None, "a", None, None, [])]
    schema = f"seq long, assetType string, name string, primitive string, algorithmFamily string, parameterSet string, mode string, materialType string, filePath string, line int, fingerprint string, evidence array<{scan.EVIDENCE}>"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(rng.choice([1, 4, 13])))
    merged = assess.merge_evidence(spark.createDataFrame(rows, schema)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r["seq"], r["algorithmFamily"], len(r["evidence"])) for r in merged) == [*plain_merge(plain), (n, "AES", 0)]


def test_merge_of_nothing(spark):
    schema = f"seq long, assetType string, name string, algorithmFamily string, filePath string, line int, evidence array<{scan.EVIDENCE}>"
    assert assess.merge_evidence(spark.createDataFrame([], schema)).count() == 0


def test_end_to_end(spark, tmp_path):
    files = tree(tmp_path, spark, {"src/a.js": "crypto.verify('RSA-SHA256', d)\nbcrypt.hash(p)\n", "src/k.pem": "-----BEGIN RSA PRIVATE KEY-----\nAA\n-----END RSA PRIVATE KEY-----\n"})
    found = scan.fallback(repository.code_files(files)).unionByName(scan.pem_blocks(repository.pem_files(files))).unionByName(scan.byte_constants(files))
    done = assess.assess(assess.merge_evidence(found.withColumn("seq", F.monotonically_increasing_id())))
    rows = {r["name"]: r for r in done.collect()}
    assert rows["RSA"]["nistQuantumLevel"] == 0 and rows["RSA"]["quantumRisk"] == "CRITICAL"
    assert rows["bcrypt"]["nistQuantumLevel"] == 5
    assert rows["private-key"]["exposureRisk"] == "CRITICAL" and rows["private-key"]["quantumRisk"] == "MEDIUM"
    clean, errors, warnings = assess.validate(done)
    assert clean.count() == 3 and errors.count() == 0 and warnings.count() == 1
    packages = spark.createDataFrame([(0, "bcrypt", "1", "pkg:npm/bcrypt@1", ["CVE"])], "seq long, name string, version string, purl string, osvCves array<string>")
    document = json.loads(relate.documents(relate.attribute(clean, packages)).first()["document"])
    assert len(document["components"]) == 3 and document["components"][0]["type"] == "cryptographic-asset"


def test_packages(spark):
    bom = spark.createDataFrame([("bcrypt", "1", True, False), ("@x/jose", "2", False, False), ("left-pad", "1", True, False), ("uuid", "1", True, False)], "name string, version string, isDirect boolean, devDependency boolean")
    code = spark.createDataFrame([("bcrypt", [("ast", "direct", "bcrypt.hash", 0.9, "a.js", 1)])], f"algorithmFamily string, evidence array<{scan.EVIDENCE}>")
    rows = {r["name"]: r["evidence"][0] for r in scan.packages(bom, code).collect()}
    assert set(rows) == {"bcrypt", "JWT"}
    assert rows["bcrypt"]["rawConfidence"] == 0.98 and rows["bcrypt"]["evidenceClass"] == "direct"
    assert rows["JWT"]["rawConfidence"] == 0.40 and rows["JWT"]["evidenceClass"] == "supporting"


def test_registry_fields(spark):
    documents = [
        ("a", json.dumps({"dist-tags": {"latest": "2"}, "time": {"2": "2024-01-01T00:00:00Z"}, "license": "MIT", "versions": {"2": {"deprecated": "gone"}}})),
        ("b", json.dumps({"license": {"type": "ISC"}})), ("c", json.dumps({"licenses": [{"type": "BSD-2-Clause"}], "deprecated": "old"})), ("d", "{}"), ("e", "not json"),
    ]
    raw = spark.createDataFrame([(n, d, None) for n, d in documents], "name string, packument string, notFound boolean")
    rows = {r["name"]: r for r in repository.registry_fields(raw).collect()}
    assert [rows[n]["license"] for n in "abcde"] == ["MIT", "ISC", "BSD-2-Clause", "UNKNOWN", "UNKNOWN"]
    assert rows["a"]["deprecated"] == "gone" and rows["c"]["deprecated"] == "old" and rows["a"]["published"] is not None


def test_certificate_that_cannot_be_read(spark):
    rows = assess.certificates(spark.createDataFrame([("-----BEGIN CERTIFICATE-----\nAA\n-----END CERTIFICATE-----",), (None,)], "pem string")).collect()
    assert all(r["subject"] is None and r["keyType"] is None for r in rows)


def test_views(spark):
    rows = spark.createDataFrame([("AES", None, 1, "NONE", 0.2), ("MD5", None, 0, "HIGH", 0.9)], "name string, parameterSet string, nistQuantumLevel int, exposureRisk string, confidence double")
    tasks = {r["id"]: r["affected"] for r in views.checklist(rows).collect()}
    assert tasks == {"exposed-secrets": 1, "post-quantum": 1, "weak-digests": 1, "short-keys": 1, "low-confidence": 1}
    plan = views.markdown(views.checklist(rows), "https://github.com/a/b").first()["value"]
    assert plan.count("- [ ]") == 5 and plan.count("### ") == 4 and "https://github.com/a/b" in plan and "Revoke 1 key that the sources show**" in plan
    assert views.markdown(views.checklist(rows.limit(0))).first()["value"].endswith("No task is open.\n")
    assert views.checklist(rows.limit(0)).count() == 0


def test_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(str(source))
    query = drops.apply_per_batch(drops.stream_table(spark, str(source), schema, 1), lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    total = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0]
    assert total == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_bom_packages(spark):
    bom = {"components": [{"name": "a", "version": "1", "purl": "pkg:npm/a@1", "bom-ref": "r", "scope": "required"}, {"name": "b", "version": "2", "purl": "x", "bom-ref": "s"}], "vulnerabilities": [{"id": "CVE-1", "affects": [{"ref": "r"}]}]}
    frame = spark.createDataFrame([(json.dumps(bom),)], "t string").select(F.from_json("t", repository.BOM_SCHEMA).alias("b")).select("b.*")
    rows = {r["name"]: r for r in repository.bom_packages(frame, spark.createDataFrame([("b",)], "name string")).collect()}
    assert rows["a"]["osvCves"] == ["CVE-1"] and rows["a"]["isDirect"] and rows["a"]["ecosystem"] == "npm"
    assert rows["b"]["osvCves"] == [] and rows["b"]["isDirect"] and rows["b"]["ecosystem"] == "unknown"


def test_calls(spark, tmp_path):
    from quillbom.operators import calls

    code = """import bcrypt from 'bcryptjs';
const { createHash: mk, randomBytes } = require('crypto');
const c = require('crypto'), CryptoJS = require('crypto-js'), jwt = require('jsonwebtoken');
bcrypt.genSalt(10); bcrypt.hash(p, s); bcrypt.compare(a, b);
c.createCipheriv('aes-256-gcm', k, iv);
crypto.pbkdf2Sync(p, s, 1000, 32, 'sha512');
jwt.sign(x, 'short', { algorithm: 'RS256' }); jwt.verify(x, key);
CryptoJS.TripleDES.encrypt(m, k); CryptoJS.HmacSHA256(m, k); CryptoJS.MD5(m);
window.crypto.subtle.digest({ name: 'SHA-256' }, d);
const alg = -7; // crypto.createHash('md5')
x.verify('RSA-SHA256'); "crypto.createHash('md5')";
"""
    files = tree(tmp_path, spark, {"src/a.js": code})
    got = {(r["line"], r["algorithmFamily"], r["primitive"], r["mode"], r["parameterSet"], r["materialType"]) for r in calls.findings(files).collect()}
    assert got == {
        (4, "bcrypt", None, None, "10 rounds", "salt"), (4, "bcrypt", "kdf", None, None, None), (4, "bcrypt", None, None, None, None),
        (5, "AES", "block-cipher", "GCM", "256", None), (6, "PBKDF2", "kdf", None, "1000 iters, 32 bytes, sha512", None),
        (7, "RSA", "signature", "SHA-256", "weak-secret", None), (7, "HMAC", "signature", "SHA-256", "HS256", None),
        (8, "3DES", "block-cipher", None, None, None), (8, "HMAC", "mac", "SHA256", None, None), (8, "MD5", "hash", None, None, None),
        (9, "SHA-256", "hash", None, None, None), (10, "ECDSA", "signature", None, "P-256 / ES256", None),
    }


def test_web_and_token_calls(spark, tmp_path):
    from quillbom.operators import calls

    code = """const crypto = require('crypto'), jwt = require('jsonwebtoken'), CryptoJS = require('crypto-js');
window.crypto.subtle.sign({ name: 'ECDSA', namedCurve: 'P-384', hash: { name: 'SHA-384' } }, k, d);
window.crypto.subtle.importKey('pkcs8', b, { name: 'RSA-PSS', hash: 'SHA-256' }, true, u);
window.crypto.subtle.importKey('raw', b, { name: 'AES-GCM', length: 256 }, true, u);
window.crypto.subtle.generateKey({ name: 'RSASSA-PKCS1-v1_5', modulusLength: 2048, hash: { name: 'SHA-256' } }, e, u);
window.crypto.subtle.verify(algorithm, k, s, d);
jwt.verify(t, key, { algorithms: ['RS256', 'ES384'] });
jwt.sign(t, key, { algorithm: 'none' });
crypto.sign('RSA-SHA256', d, k);
CryptoJS.algo.SHA512.create(); CryptoJS.RC4.encrypt(m, k);
crypto.pbkdf2Sync(p, s, 1000, 32);
"""
    files = tree(tmp_path, spark, {"src/a.js": code})
    got = {(r["line"], r["algorithmFamily"], r["primitive"], r["mode"], r["parameterSet"], r["materialType"]) for r in calls.findings(files).collect()}
    assert got == {
        (2, "ECDSA", "signature", None, "P-384 / SHA-384", None), (3, "RSA-PSS", None, None, "SHA-256", "private-key"), (4, "AES", "block-cipher", None, "256 bits", None),
        (5, "RSA", "signature", None, "SHA-256 / 2048 bits", None), (6, "ECDSA", "signature", None, "P-256", None), (7, "RSA", "signature", "SHA-256", "RS256", None), (7, "ECDSA", "signature", "SHA-384", "ES384", None),
        (8, "none", "signature", None, "none-algorithm-insecure", None), (9, "RSA-SHA256", "signature", None, "RSA-SHA256", None), (10, "SHA-512", "hash", None, None, None), (10, "RC4", "stream-cipher", None, None, None),
        (11, "PBKDF2", "kdf", None, "1000 iters, 32 bytes, 32", None),
    }


def test_severities_reach_the_summary(spark):
    """Hits of the detectors by way of the summary: typosquats are high, and nothing critical counts as low."""
    parts = spark.createDataFrame([(0, "expres", "1", "pkg:npm/expres@1", [], False, False)], "seq long, name string, version string, purl string, declaredRanges array<string>, hasInstallScript boolean, dev boolean")
    popular = spark.createDataFrame([("express", 1)], "name string, rank int")
    registry = spark.createDataFrame([], "name string, published timestamp, license string, deprecated string")
    found = sbom.anomalies(parts, popular, registry, spark.createDataFrame([], "name string, weekly long"), F.lit("2024-01-02").cast("timestamp"))
    rows = sbom.with_hits(parts, spark.createDataFrame([], "purl string, vuln_id string"), found.where("type = 'typosquat'"))
    rows = rows.withColumn("bucket", sbom.worst_bucket(F.size("vulns") > 0, F.transform("hits", lambda h: h["severity"])))
    summary = sbom.risk_summary(rows).first()
    assert (summary["critical"], summary["high"], summary["low"]) == (0, 1, 0)
    assert values(spark, sbom.worst_bucket(F.lit(False), F.array(F.lit("critical")))) == "critical"


def test_scans_do_not_mix(spark):
    entries = [(s, i, f"node_modules/{n}", "1", None, None, False, False, False, {"b": f"^{s}"} if n == "a" else None) for s in ("x", "y") for i, n in enumerate("ab")]
    parts = sbom.components(spark.createDataFrame(entries, "scan string, seq int, path string, version string, resolved string, integrity string, dev boolean, optional boolean, hasInstallScript boolean, dependencies map<string,string>"))
    assert {(r["scan"], r["name"]): r["declaredRanges"] for r in parts.collect()} == {("x", "a"): [], ("x", "b"): ["^x"], ("y", "a"): [], ("y", "b"): ["^y"]}
    vulns = spark.createDataFrame([("x", "pkg:npm/a@1", "V")], "scan string, purl string, vuln_id string")
    none = spark.createDataFrame([], "scan string, purl string, seq int, type string, severity string, reason string")
    documents = {r["scan"]: json.loads(r["document"]) for r in sbom.documents(sbom.with_hits(parts, vulns, none)).collect()}
    assert [v["id"] for v in documents["x"]["vulnerabilities"]] == ["V"] and documents["y"]["vulnerabilities"] == []
    with pytest.raises(ValueError, match="tell scans apart"):
        sbom.with_hits(parts, vulns.drop("scan"), none)


def test_comments_are_left_out(spark):
    text = "a(1) /* b(2)\n c */ d(3)\n/* e */ f /* g */ h\n/*/ i */ j\nk /* l"
    rows = scan.comment_free(spark.createDataFrame([("p", text.encode())], "path string, content binary")).orderBy("line").collect()
    assert [r["code"].split() for r in rows] == [["a(1)"], ["d(3)"], ["f", "h"], ["j"], ["k"]] and [r["content"] for r in rows] == text.split("\n")


def test_comment_signs_that_open_nothing(spark):
    """Quotes, templates and patterns hold the signs of comments; much code takes time in proportion."""
    from quillbom.operators import lexer

    assert lexer.without_comments("const g = 'app/*';\nx(1); // */\n`/*` + /[/*]/; y(2) /* z\n*/ w") == "const g = 'app/*';\nx(1); // */\n`/*` + /[/*]/; y(2)  \n w"
    for text in ("/* c */ x = 1;\n" * 70_000, "'\\'" * 300_000, "`\\`" * 300_000, "/[(" * 300_000, "/*" * 500_000):
        began = time.time()
        assert "".join(t for _, t, _ in lexer.tokens(text)) == text.replace(" x = 1;\n", "x=1;")
        assert time.time() - began < 30


def made_code(rng, depth=0):
    """(code, the methods it calls): an expression of random literals, operators, templates, patterns and calls."""
    kind = rng.randrange(10 if depth < 4 else 5)
    if kind == 0:
        return rng.choice(["'a\\'/*'", '"//`"', "`\\`$'`", "'\"'", "``"]), []
    if kind == 1:
        return rng.choice(["/['\"`]/g", "/[/]\\//", "/\\/*'/.source", "/(`|\\[)/i"]), []
    if kind == 2:
        return rng.choice(["x", "a.b", "7", "-1.5e3", "x++", "$", "(y)", "[1, 2]", "{ }.z"][: 8]), []
    if kind == 3:
        return f"x {rng.choice(['/', '/ /* ) */', '*', '- '])} 2", []
    if kind == 4:
        return rng.choice(["/* lost('x') ` */ y", "// lost(`\n z", "typeof x"]), []
    a, found = made_code(rng, depth + 1)
    b, more = made_code(rng, depth + 1)
    if kind in (5, 6):
        name = f"f{rng.randrange(1000)}"
        form = rng.choice(["{n}({a}, {b})", "m.{n}({a}, {b})", "m['{n}']({a}, {b})", "m?.{n}?.({a}, {b})", "m\n.{n} ({a}, {b})"])
        return form.replace("{n}", name).replace("{a}", a).replace("{b}", b), found + more + [name]
    if kind == 7:
        return f"`t ' ${{{a}}} /* \\` ${{ {b} }}`", found + more
    if kind == 8:
        return f"({a}) / ({b})", found + more
    return f"{{ k: {a}, l: [{b}] }}" if depth else f"if (x) {{ y = {a} }} else z = [{b}]", found + more


def test_no_call_is_lost():
    from quillbom.operators import calls

    rng = random.Random(5)
    for _ in range(1500):
        made = [made_code(rng) for _ in range(3)]
        code = "\n;".join(c for c, _ in made)
        got = sorted(r[4] for r in calls.facts(code) if r[0] == "call")
        assert got == sorted(n for _, names in made for n in names), code


def test_calls_in_their_lines(spark, tmp_path):
    """Cases that a lexer without memory of what stood before takes for strings, comments or patterns."""
    from quillbom.operators import calls

    code = """const r=/['"]/; crypto.createHash('md5');
x = `a ${crypto.createHash('sha1')} b`; crypto['createHash']('sha256');
function createHash(a) { return crypto.createHash(a) }
class Q { createHmac(b) { return crypto.createHmac('sha256', b) } }
y = a / b; crypto.randomBytes(16); z = c / d;
require('crypto').createHash('sha512');
"""
    files = tree(tmp_path, spark, {"src/a.js": code})
    got = {(r["line"], r["algorithmFamily"]) for r in calls.findings(files).collect()}
    assert got == {(1, "MD5"), (2, "SHA1"), (2, "SHA-256"), (3, "SHA-256"), (4, "HMAC"), (5, "CSPRNG"), (6, "SHA-512")}


def test_line_rules(spark):
    """Families of what the lines name, not of the rule."""
    wanted = [
        ("CryptoJS.MD5(x)", "js-hash", "MD5", "hash", None, None), ("CryptoJS.DES.encrypt(x)", "js-cipher", "DES", "block-cipher", None, None), ("CryptoJS.EvpKDF(x)", "js-kdf", "EVPKDF", "kdf", None, None),
        ("coseAlg: -7", "cose", "ECDSA", "signature", "P-256 / ES256", None), ("algorithm: -257", "cose", "RSA", "signature", "RS256", None), ("crypto.subtle.digest(a, b)", "webcrypto", "SHA-256", "hash", None, None),
        ("bcrypt.compare(a)", "bcrypt", "bcrypt", None, None, None), ("crypto.createCipheriv(alg, k)", "cipher", "AES", "block-cipher", None, "CBC"), ("jwt.sign(a, {algorithm: 'RS256'})", "token", "RSA", "signature", "RS256", "SHA-256"),
    ]
    rows = spark.createDataFrame([(w[0],) for w in wanted] + [("bcrypt(x)",), ("alg: -99",)], "content string")
    got = {(r["content"], *(r["hit"][c] for c in ("topic", "family", "primitive", "parameter", "mode"))) for r in scan.line_matches(rows).collect()}
    assert got == set(wanted)


def test_certificate(spark):
    """A certificate made of its parts: version, serial, algorithm, issuer, validity, subject and key."""
    import base64

    def der(tag, *parts):
        body = b"".join(parts)
        size = bytes([len(body)]) if len(body) < 128 else bytes([0x82, len(body) >> 8, len(body) & 255])
        return bytes([tag]) + size + body

    oid = lambda h: der(6, bytes.fromhex(h))
    name = der(48, der(49, der(48, oid("550403"), der(12, "exämple".encode()))), der(49, der(48, oid("55040a"), der(19, b"Org"))))
    validity = der(48, der(23, b"240101000000Z"), der(23, b"340102030405Z"))
    key = der(48, der(48, oid("2a8648ce3d0201"), oid("2a8648ce3d030107")), der(3, b"\0" + b"k" * 200))
    body = der(48, der(0xA0, der(2, b"\2")), der(2, b"\1"), der(48, oid("2a8648ce3d040302")), name, validity, name, key)
    pem = "-----BEGIN CERTIFICATE-----\n" + base64.encodebytes(der(48, body, der(48), der(3, b"\0"))).decode() + "-----END CERTIFICATE-----\n"
    row = assess.certificates(spark.createDataFrame([(pem,)], "pem string")).first()
    assert (row["subject"], row["validTo"], row["keyType"]) == ("CN=exämple\nO=Org", "2034-01-02T03:04:05Z", "ec")


def test_hashed_vector(spark):
    row = spark.createDataFrame([("a b a. C",), ("",), (None,)], "t string").select(relate.hashed_vector(F.col("t"), 16).alias("v")).collect()
    assert sum(row[0]["v"]) == 4 and max(row[0]["v"]) >= 2 and len(row[0]["v"]) == 16 and sum(row[1]["v"]) == 0


def test_exports(spark):
    parts = spark.createDataFrame([("s", "r1", "cryptographic-asset", "AES", ["l1"]), ("s", "l1", "library", "lib", None)], "scan string, ref string, type string, name string, dependsOn array<string>")
    at = F.lit("2024-01-02").cast("timestamp")
    document = json.loads(views.exported(parts, True, at).first()["document"])
    assert [c["bom-ref"] for c in document["components"]] == ["r1"] and document["dependencies"] == [{"ref": "r1", "dependsOn": ["l1"]}]
    assert document["metadata"]["tools"]["components"][0]["type"] == "application" and document["serialNumber"].startswith("urn:uuid:")
    other = json.loads(views.exported(parts, False, at, spark.createDataFrame([("s", "u")], "scan string, repository string")).first()["document"])
    assert [c["name"] for c in other["components"]] == ["lib"] and other["metadata"]["component"]["name"] == "u" and "dependencies" not in other


def test_advice_has_actions(spark):
    advice = values(spark, views.advice(F.lit("RSA"), F.lit(0), F.lit("NONE"), F.lit(None).cast("string"), F.lit("algorithm")))
    assert advice["severity"] == "critical" and len(advice["actions"]) == 3 and advice["summary"]
    assert values(spark, views.primitive_label(F.lit("hash"), F.lit("256"), F.lit(None).cast("string"))) == "hash / 256"
    assert values(spark, views.source_label(F.lit("a.js"), F.lit(3))) == "a.js:3"


def test_nearest_with_zero_vectors(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id long, v array<float>")
    corpus = spark.createDataFrame([(n, [1.0, n / 10]) for n in range(5)], "entry long, w array<float>")
    rows = relate.nearest(queries, corpus, k=2, least=0.9, block_rows=2).collect()
    assert sorted((r["id"], r["rank"], r["entry"]) for r in rows) == [(1, 1, 0), (1, 2, 1)]


def test_tree_source(spark, tmp_path, capsys):
    """Folders that no detector reads are not listed, filters reach the source, and the files are those of the plain reader."""
    from quillbom.sources import tree as trees

    names = ["a.js", "src/b.ts", "src/deep/er/c.js", "node_modules/lodash/x.js", "node_modules/bcrypt/lib/e.js", "node_modules/bcrypt/test/e.js", "node_modules/@noble/hashes/h.js", "node_modules/@types/node/n.js", ".git/objects/ab/cd", "dist/d.js", "x/node_modules/bcrypt/i.js", "key.pem"]
    plain = tree(tmp_path, spark, {n: n * 3 for n in names})
    found = trees.source_tree(spark, str(tmp_path))
    for pick in (repository.code_files, repository.candidate_files, repository.pem_files, repository.constant_files):
        assert {(r["path"], r["ext"], bytes(r["content"])) for r in pick(found).collect()} == {(r["path"], r["ext"], bytes(r["content"])) for r in pick(plain).collect()}
    small = found.where("ext in ('js', 'ts') and length < 25 and path like 'src/%'")
    assert [r["path"] for r in small.collect()] == ["src/b.ts"]
    small.explain("formatted")
    assert "PushedFilters: [In(ext, [js,ts]), LessThan(length,25), StringStartsWith(path,src/)]" in capsys.readouterr().out

    from pyarrow import fs

    visited: list[str] = []

    def list_folder(folder):
        visited.append(folder)
        return trees.listed(fs.LocalFileSystem(), str(tmp_path), folder)

    reader = trees.TreeReader(f"file://{tmp_path}", False, True, 4)
    assert len(list(trees.walk(list_folder, "", reader.enter))) == 6
    assert sorted(visited) == ["", "node_modules", "node_modules/@noble", "node_modules/@noble/hashes", "node_modules/@types", "node_modules/bcrypt", "node_modules/bcrypt/lib", "src", "src/deep", "src/deep/er", "x"]
    visited.clear()
    reader.wanted.starts.append("src/d")
    list(trees.walk(list_folder, "", reader.enter))
    assert visited == ["", "src", "src/deep", "src/deep/er"]
    assert trees.source_tree(spark, str(tmp_path), content=False, vendored=False, partitions=1).where("content is null").count() == 4


def document_texts(path):
    texts = {}
    for folder in sorted(path.glob("scan=*")):
        texts[folder.name.removeprefix("scan=")] = json.loads("".join(f.read_text() for f in sorted(folder.glob("part-*"))))
    return texts


def test_documents_as_streams(spark, tmp_path):
    """Documents that go over many partitions are those that are gathered in rows."""
    from quillbom.operators import documents

    none = F.array().cast("array<struct<seq:int,type:string,severity:string,reason:string>>")
    rows = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).when(F.col("id") == 7, "one").otherwise("large").alias("scan"), F.col("id").alias("seq"), F.concat(F.lit('n"\n'), "id").alias("name"),
        F.lit("1").alias("version"), F.concat(F.lit("p/"), "id").alias("purl"), (F.col("id") % 2 == 0).alias("dev"), F.when(F.col("id") % 5 == 0, F.array(F.struct(F.lit(0).alias("seq"), F.lit("t").alias("type"), F.lit("low").alias("severity"), F.lit("r").alias("reason")))).otherwise(none).alias("hits"),
        F.when(F.col("id") % 100 == 1, F.array(F.lit("V1"), F.lit("V2"))).otherwise(F.array().cast("array<string>")).alias("vulns"),
    )
    documents.write(documents.inventory(rows), str(tmp_path / "a"))
    assert document_texts(tmp_path / "a") == {r["scan"]: json.loads(r["document"]) for r in sbom.documents(rows).collect()}
    assert len(list((tmp_path / "a" / "scan=large").glob("part-*"))) > 1
    assert documents.elements(spark, str(tmp_path / "a")).count() == 3000 + 60
    found = spark.range(500).select(
        F.lit("algorithm").alias("assetType"), F.lit("AES").alias("name"), F.lit("x").alias("primitive"), F.lit(None).cast("string").alias("parameterSet"), F.lit("GCM").alias("mode"), F.lit(1).alias("nistQuantumLevel"), F.lit(None).cast("string").alias("materialType"), F.lit(0.5).alias("confidence"),
        F.when(F.col("id") % 2 == 0, "vendor").otherwise("production").alias("contextCategory"), F.lit("LOW").alias("quantumRisk"), F.lit("LOW").alias("exposureRisk"), F.lit(None).cast("string").alias("fingerprint"), F.array().cast(f"array<{scan.EVIDENCE}>").alias("evidence"),
        F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("filePath"), (F.col("id") % 90 + 1).cast("int").alias("line"), F.col("id").cast("string").alias("findingId"), F.struct(F.lit("n").alias("name"), F.lit("1").alias("version"), F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("purl")).alias("packageContext"),
    )
    documents.write(documents.crypto_inventory(found), str(tmp_path / "b"))
    (got,) = document_texts(tmp_path / "b").values()
    want = json.loads(relate.documents(found).first()["document"])
    key = lambda c: json.dumps(c, sort_keys=True)
    assert got["dependencies"] == want["dependencies"] and sorted(got["components"], key=key) == sorted(want["components"], key=key)
    parts = found.select(F.lit("s").alias("scan"), F.concat(F.lit("c/"), "findingId").alias("ref"), F.when(F.col("line") > 40, "cryptographic-asset").otherwise("library").alias("type"), "name", F.when(F.col("line") % 2 == 0, F.array("filePath")).alias("dependsOn"))
    for crypto in (True, False):
        documents.write(documents.export(parts, crypto, F.lit("2024-01-02").cast("timestamp")), str(tmp_path / f"c{crypto}"))
        (got,) = document_texts(tmp_path / f"c{crypto}").values()
        want = json.loads(views.exported(parts, crypto, F.lit("2024-01-02").cast("timestamp")).first()["document"])
        assert {**got, "dependencies": sorted(map(key, got["dependencies"])), "components": sorted(map(key, got["components"]))} == {**want, "dependencies": sorted(map(key, want["dependencies"])), "components": sorted(map(key, want["components"]))}


def test_lock_entries_in_the_order_of_the_text(spark):
    lock = {"lockfileVersion": 2, "packages": {"": {"version": "1"}, "node_modules/b": {"version": "2", "dev": True, "dependencies": {"z": "^1"}}, "node_modules/a": {"version": "3", "hasInstallScript": True, "extra": {"x": [1]}}, "node_modules/Z": {"link": True}}}
    rows = repository.lock_entries(spark.createDataFrame([("s", json.dumps(lock))], "scan string, text string"), scan="scan").orderBy("seq").collect()
    assert [(r["seq"], r["path"], r["version"], r["dev"], r["hasInstallScript"], r["dependencies"]) for r in rows] == [
        (0, "", "1", None, None, None), (1, "node_modules/b", "2", True, None, {"z": "^1"}), (2, "node_modules/a", "3", None, True, None), (3, "node_modules/Z", None, None, None, None),
    ]
    for bad in ("{}", "no JSON", '{"lockfileVersion":1,"packages":{}}', '{"lockfileVersion":3}', '{"lockfileVersion":3,"packages":[]}'):
        with pytest.raises(Exception, match="Unsupported lockfile"):
            repository.lock_entries(spark.createDataFrame([(bad,)], "text string")).collect()


def test_ask_once(spark, tmp_path):
    """Prompts that repeat, over restarts: each is asked once, and every finding gets its answer."""
    from quillbom.streaming import keyed

    prompts = {f"f{i}": f"prompt {i % 5}" for i in range(20)}
    digests = {p: hashlib.sha256(p.encode()).hexdigest() for p in prompts.values()}
    drop = lambda rows, schema, to: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / to))
    findings, answers = "findingId string, prompt string", "digest string, raw string"
    drop([], findings, "findings"), drop([], answers, "answers")

    def run():
        both = keyed.ask_once(drops.stream_table(spark, str(tmp_path / "findings"), findings, 1), drops.stream_table(spark, str(tmp_path / "answers"), answers, 1))
        drops.apply_per_batch(both, lambda b: b, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return Counter((r["kind"], r["prompt"] or r["findingId"], r["raw"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    drop([(f, p) for f, p in prompts.items() if f < "f15"], findings, "findings")
    want = Counter({("ask", p, None): 1 for p in {p for f, p in prompts.items() if f < "f15"}})
    assert run() == want
    drop([(digests["prompt 1"], "yes"), (digests["prompt 1"], "no")], answers, "answers")
    drop([("f1", "prompt 1")], findings, "findings")
    want += Counter({("answered", f, "no"): 1 for f, p in prompts.items() if f < "f15" and p == "prompt 1"})
    got = run()
    assert got - Counter({("answered", "f1", "no"): 1}) == want - Counter({("answered", "f1", "no"): 1}) and got["answered", "f1", "no"] in (1, 2)
    drop([(f, p) for f, p in prompts.items() if f >= "f15"], findings, "findings")
    drop([(d, "later") for d in digests.values()], answers, "answers")
    got = run()
    assert {f for kind, f, _ in got if kind == "answered"} == set(prompts)
    assert {raw for kind, f, raw in got if kind == "answered" and prompts[f] == "prompt 1"} == {"no"}
    assert {k: n for k, n in got.items() if k[0] == "ask" and n > 1} == {}


def test_summaries_on_streams(spark, tmp_path):
    """After each drop and restart the summaries are those of the tables so far, whatever comes first."""
    from quillbom.streaming import keyed

    rng = random.Random(3)
    schemas = {"components": "scan string, seq int, purl string", "vulns": "scan string, purl string, vuln_id string", "hits": "scan string, purl string, seq int, type string, severity string, reason string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).coalesce(1).write.parquet(str(tmp_path / name))
    for turn in range(3):
        purl = lambda: f"p{rng.randrange(12)}"
        scan_of = lambda: rng.choice("abc"[: turn + 1])
        rows = {
            "components": [(scan_of(), i, purl()) for i in range(15)], "vulns": [(scan_of(), purl(), f"V{i}") for i in range(2)],
            "hits": [(scan_of(), purl(), i, "t", rng.choice(["high", "medium", "low"]), "r") for i in range(6)],
        }
        for name, schema in schemas.items():
            spark.createDataFrame(rows[name], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams = [drops.stream_table(spark, str(tmp_path / n), s, 1) for n, s in schemas.items()]
        drops.apply_per_batch(keyed.risk_summaries(*streams), lambda b: b, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        parts, vulns, hits = (spark.read.schema(s).parquet(str(tmp_path / n)) for n, s in schemas.items())
        bucket = sbom.worst_bucket(F.size("vulns") > 0, F.transform("hits", lambda h: h["severity"]))
        want = sbom.risk_summary(sbom.with_hits(parts, vulns, hits).withColumn("bucket", bucket))
        got = {r["scan"]: r for r in keyed.latest(spark.read.parquet(str(tmp_path / "out")), "scan").collect()}
        for r in want.collect():
            assert [got[r["scan"]][c] for c in (*rules.SEVERITIES, "flaggedCount", "totalComponents")] == [r[c] for c in (*rules.SEVERITIES, "flaggedCount", "totalComponents")]


@pytest.mark.parametrize("least", [0.75, 0.3, 0.0, -1.0, 1.0])
def test_nearest_leaves_nothing_out(spark, least):
    """Clusters, zero vectors and copies: the rows of all pairs, with few of the pairs scored where clusters are apart."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    vectors = [(i, (centres[i % 12] + 0.15 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(600)] + [(600, [0.0] * 16), (601, [0.0] * 16), (602, centres[3].tolist()), (603, centres[3].tolist())]
    corpus, queries = spark.createDataFrame(vectors, "entry long, w array<float>"), spark.createDataFrame(vectors[::9], "id long, v array<float>")
    w = np.array([np.float32(v) for _, v in vectors], np.float64)
    size = np.linalg.norm(w, axis=1)
    want = []
    for n, v in vectors[::9]:
        q = np.array(np.float32(v), np.float64)
        near = size * np.linalg.norm(q)
        scores = np.divide(w @ q, near, out=np.zeros(len(w)), where=near > 0)
        best = sorted((-s, i) for i, s in enumerate(scores) if s >= least and i != n)[:3]
        want += [(n, r, i, round(-s, 9)) for r, (s, i) in enumerate(best, 1)]
    got = relate.nearest(queries, corpus, 3, least, block_rows=50, others=True).collect()
    loose = lambda rows: sorted((n, r, round(s, 6)) for n, r, _, s in rows)  # noqa: E731  # equal scores may differ in the last digit
    assert loose(map(tuple, got)) == loose(want)
    assert least not in (0.75,) or sorted((r[0], r[1], r[2]) for r in got) == sorted(x[:3] for x in want)
    share = relate.scored_share(queries, corpus, least).first()
    assert share["pairs"] == len(vectors) * len(vectors[::9]) and (share["scored"] < 0.4 * share["pairs"] or least < 0.75)
    assert relate.nearest(queries, corpus.limit(0)).count() == 0


def test_combined_summary_on_a_stream(spark, tmp_path):
    from quillbom.streaming import keyed

    schema = "scan string, quantumRisk string, exposureRisk string, packageContext struct<name string>"
    rng = random.Random(4)
    for turn in range(2):
        rows = [(rng.choice("ab"), rng.choice(["CRITICAL", "LOW", None]), rng.choice(["HIGH", "ODD"]), rng.choice([None, ("n",)])) for _ in range(20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = relate.combined_summary(drops.stream_table(spark, str(tmp_path / "in"), schema, 1))
        drops.apply_per_batch(stream, lambda b: b, str(tmp_path / "out"), str(tmp_path / "state"), "update").awaitTermination()
        want = relate.combined_summary(spark.read.schema(schema).parquet(str(tmp_path / "in")))
        assert sorted(keyed.latest(spark.read.parquet(str(tmp_path / "out")), "scan").select(*want.columns).collect()) == sorted(want.collect())
