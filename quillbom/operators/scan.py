"""Detectors over files: PEM blocks, byte constants, candidate lines, line rules, calls of code, packages.

Each gives findings with one evidence; a scan of many repositories is one narrow pass over the files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbom.functions import columns as C
from quillbom.functions import rules
from quillbom.functions.keys import SCAN, scan_key
from quillbom.operators import lexer

EVIDENCE = "struct<source:string,evidenceClass:string,detail:string,rawConfidence:double,filePath:string,line:int>"
FINDING = [
    "findingId", "assetType", "name", "primitive", "algorithmFamily", "parameterSet", "mode", "materialType", "filePath", "line", "sourceContext",
    "contextCategory", "evidence", "fingerprint",
]


def finding(rows: DataFrame, source: str, kind: str, **given: Column | str | float | None) -> DataFrame:
    """Findings from rows with filePath and line; columns not given are null. Ids are hashes of what is found where."""
    value = lambda k, d=None: given[k] if isinstance(given.get(k, d), Column) else F.lit(given.get(k, d))
    evidence = F.struct(
        F.lit(source).alias("source"), value("evidenceClass", kind).alias("evidenceClass"), value("detail", "").alias("detail"),
        value("rawConfidence").cast("double").alias("rawConfidence"), "filePath", F.col("line").cast("int").alias("line"),
    )
    out = rows.select(
        *scan_key(rows), value("assetType").alias("assetType"), value("name").alias("name"),
        *[value(c).cast("string").alias(c) for c in ("primitive", "algorithmFamily", "parameterSet", "mode", "materialType", "fingerprint")],
        "filePath", F.col("line").cast("int").alias("line"), value("sourceContext", "live").alias("sourceContext"), value("contextCategory", "unknown").alias("contextCategory"),
        F.array(evidence).cast(f"array<{EVIDENCE}>").alias("evidence"),
    )
    key = F.concat_ws("|", *scan_key(rows), F.lit(source), "assetType", "name", "algorithmFamily", "parameterSet", "filePath", "line")
    return out.withColumn("findingId", F.sha2(key, 256)).select(*scan_key(rows), *FINDING)


def text_lines(files: DataFrame, text: Column, path: str = "path") -> DataFrame:
    """((scan,) path, line, content) of texts cut at line feeds only."""
    by = scan_key(files)
    return files.select(*by, path, F.posexplode(F.split(text, "\n")).alias("number", "content")).select(*by, path, (F.col("number") + 1).alias("line"), "content")


def pem_blocks(files: DataFrame) -> DataFrame:
    """Key and certificate blocks, every header of every file; the fingerprint is that of the block's text."""
    text = C.as_text(F.col("content"))
    everything = "|".join(rules.PEM_HEADERS.values())
    by = scan_key(files)
    starts = files.where(F.contains(text, F.lit("-----BEGIN "))).select(*by, "path", text.alias("text")).select(*by, "path", "text", F.split("text", f"(?={everything})").alias("parts"))
    parts = starts.select(*by, "path", "text", F.posexplode("parts").alias("k", "part"), F.col("parts"))
    before = F.array_join(F.slice("parts", 1, F.col("k")), "")
    ended = F.instr("part", "-----END ")
    tail = F.substr(F.col("part"), ended)
    feed = F.instr(tail, "\n")
    block = F.when(ended == 0, F.col("part")).when(feed > 0, F.substring("part", F.lit(1), ended + feed - 2)).otherwise(F.substring("part", F.lit(1), ended + 29))
    label = F.lit(None).cast("string")
    for kind, header in rules.PEM_HEADERS.items():
        label = F.when(F.col("part").rlike(f"^{header}"), kind).otherwise(label)
    found = parts.withColumns({"label": label, "line": F.size(F.split(before, "\n")), "block": block, "filePath": F.col("path")}).where(F.col("label").isNotNull())
    stored = F.col("label") != "certificate"
    return finding(
        found.dropDuplicates([*by, "path", "line", "label"]), "keys_certs", "direct", assetType=F.when(stored, "related-crypto-material").otherwise("certificate"), name=F.col("label"),
        materialType=F.when(stored, F.col("label")), rawConfidence=0.99, detail=F.concat(F.lit("PEM header: "), F.col("label")), fingerprint=C.fingerprint(F.col("block")),
    )


def byte_constants(files: DataFrame) -> DataFrame:
    """First place of each known constant in each file; the constants are a list, not a join side."""
    table = F.array(*[F.struct(F.lit(n).alias("family"), F.lit(rules.CONSTANT_PRIMITIVE[n]).alias("primitive"), F.unhex(F.lit(h)).alias("bytes")) for n, h in rules.BYTE_CONSTANTS.items()])
    # in Latin-1 each byte is a character, so places are those of bytes, and what is missing without line feeds are the line feeds
    latin = lambda c: F.decode(c, "ISO-8859-1")
    each = files.select(*scan_key(files), F.col("path").alias("filePath"), latin(F.col("content")).alias("text")).withColumn("k", F.explode(table))
    at = F.position(latin(F.col("k.bytes")), F.col("text"))
    before = F.substring("text", F.lit(1), at - 1)
    found = each.where(at > 0).withColumn("line", F.length(before) - F.length(F.translate(before, "\n", "")) + 1)
    return finding(found, "constant", "supporting", assetType="algorithm", name=F.col("k.family"), algorithmFamily=F.col("k.family"), primitive=F.col("k.primitive"), rawConfidence=0.5, detail=F.concat(F.lit("constant of "), F.col("k.family")))


#: Files whose code a task holds as Python strings at once; an Arrow batch has thousands.
FILES_AT_ONCE = 64


def comment_free(files: DataFrame) -> DataFrame:
    """((scan,) path, line, content, code): code is the line outside block comments.

    What is a comment is said by the lexer, in one pass over the text, so that quotes, templates and
    regular expressions that hold the signs of a comment open none; an unclosed one runs to the end.
    """
    by = scan_key(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, FILES_AT_ONCE):
                rows = batch.slice(first, FILES_AT_ONCE)
                code = pa.array([lexer.without_comments(t.as_py() or "") for t in rows["text"]], rows["text"].type)
                yield pa.RecordBatch.from_arrays([*rows.columns, code], [*rows.schema.names, "code"])

    kind = "".join(f"{c} {files.schema[c].dataType.simpleString()}, " for c in by)
    both = files.select(*by, "path", C.as_text(F.col("content")).alias("text")).mapInArrow(run, f"{kind}path string, text string, code string")
    zipped = F.arrays_zip(F.split("text", "\n").alias("content"), F.split("code", "\n").alias("code"))
    return both.select(*by, "path", F.posexplode(zipped).alias("k", "z")).select(*by, "path", (F.col("k") + 1).alias("line"), F.col("z.content").alias("content"), F.col("z.code").alias("code"))


def candidates(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Lines that import a cryptographic module or call what sounds like one, unless direct evidence of the scan stands there."""
    by = scan_key(files, findings)
    lines = comment_free(files)
    clean = C.sanitize_line(F.col("code"))
    module = F.coalesce(F.nullif(F.regexp_extract("code", r"require\(\s*[\"']([^\"']+)[\"']", 1), F.lit("")), F.nullif(F.regexp_extract("code", r"from\s+[\"']([^\"']+)[\"']", 1), F.lit("")))
    called = C.crypto_calls(clean)
    hits = lines.where(F.coalesce(module.rlike(rules.CRYPTO_MODULES), F.lit(False)) | (F.size(called) > 0)).withColumn("filePath", F.col("path"))
    left = without_direct(hits, findings, by)
    return finding(left, "ast", "unclassified", assetType="algorithm", name="unknown", rawConfidence=0.35, detail=F.substring(F.trim("content"), 1, 60))


def in_order(*detectors: DataFrame) -> DataFrame:
    """All findings, those of the first detector first: detector is its number, from 1."""
    out = None
    for i, found in enumerate(detectors, 1):
        found = found.withColumn("detector", F.lit(i))
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


def without_direct(rows: DataFrame, findings: DataFrame, by: list[str]) -> DataFrame:
    """Rows (filePath, line) where no finding has direct evidence."""
    direct = findings.where(F.exists("evidence", lambda e: e["evidenceClass"] == "direct")).select(*by, "filePath", "line").distinct()
    return rows.join(direct, [*by, "filePath", "line"], "left_anti")


# What lines of code that can't be parsed are searched for.
COSE_LINE = r"(?i)\b(?:alg|coseAlg|algorithm)\s*:\s*(-(?:7|257|8|37|35|36|47|258|259))\b"
WEB_LINE = r"crypto\.subtle\.(verify|sign|digest|importKey|generateKey|deriveKey|deriveBits)"
SIGN_LINE = r"crypto\.(?:verify|sign)\s*\("
SIGN_WORD = r"crypto\.(?:verify|sign)\s*\(\s*['\"]?([A-Za-z0-9-]+)"
HKDF_LINE = r"crypto\.hkdf(?:Sync)?\s*\("
BCRYPT_LINE = r"bcrypt\.(?:hash|compare|genSalt)"
CIPHER_LINE = r"crypto\.createCipher"
CIPHER_WORD = r"createCipher(?:iv)?\s*\(\s*['\"]([^'\"]+)['\"]"
TOKEN_LINE = r"jwt\.(?:sign|verify)"
TOKEN_WORD = r"(?i)algorithm\s*:\s*['\"]([^'\"]+)['\"]"
JS_CIPHER_LINE = r"(?i)CryptoJS\.(?:AES|DES|TripleDES|RC4|Rabbit)\.(?:encrypt|decrypt)"
JS_CIPHER_WORD = r"(?i)CryptoJS\.(AES|DES|TripleDES|RC4|Rabbit)"
JS_HASH_LINE = r"(?i)CryptoJS\.(?:SHA256|SHA512|SHA384|SHA224|SHA1|SHA3|MD5|RIPEMD160)\s*\("
JS_HASH_WORD = r"(?i)CryptoJS\.(SHA256|SHA512|SHA384|SHA224|SHA1|SHA3|MD5|RIPEMD160)"
JS_MAC_LINE = r"(?i)CryptoJS\.Hmac"
JS_MAC_WORD = r"(?i)CryptoJS\.Hmac([A-Za-z0-9]+)"
JS_KDF_LINE = r"(?i)CryptoJS\.(?:PBKDF2|EvpKDF)\s*\("
JS_KDF_WORD = r"(?i)CryptoJS\.(PBKDF2|EvpKDF)"


def line_matches(lines: DataFrame, content: str = "content") -> DataFrame:
    """lines with hit, one row for each topic that a line speaks of: topic, family, primitive, parameter, mode, material, confidence."""
    text, none = F.col(content), F.lit(None).cast("string")
    has, word = text.rlike, lambda p: F.nullif(F.regexp_extract(content, p, 1), F.lit(""))
    said = lambda *kinds, otherwise: _cases(kinds, otherwise)
    web, cose = word(WEB_LINE), cose_column(word(COSE_LINE).try_cast("int"))
    named = said((has("(?i)P-256|ECDSA"), "ECDSA"), (has("(?i)RSA"), "RSA"), (has("(?i)AES"), "AES"), otherwise=none)
    salt, compare = has("genSalt"), has("compare")
    cipher, token = C.algorithm_identifier(word(CIPHER_WORD)), F.coalesce(word(TOKEN_WORD), F.lit("HS256"))
    known_token, js = C.algorithm_identifier(token), F.lower(word(JS_CIPHER_WORD))
    js_family = said((js == "tripledes", "3DES"), (js == "des", "DES"), (js == "rc4", "RC4"), (js == "rabbit", "Rabbit"), otherwise=F.lit("AES"))
    digest = F.upper(word(JS_HASH_WORD))
    rules_of = [
        ("cose", cose.isNotNull(), cose["family"], "signature", cose["parameter"], none, none, 0.60),
        (
            "webcrypto", web.isNotNull(), F.coalesce(named, said((web == "digest", "SHA-256"), (web.startswith("derive"), "HKDF"), otherwise=F.lit("ECDSA"))),
            said((named == "AES", "block-cipher"), (web == "digest", "hash"), (web.startswith("derive"), "kdf"), otherwise=F.lit("signature")), none, none, none, 0.55,
        ),
        ("sign", has(SIGN_LINE), "RSA", "signature", F.coalesce(word(SIGN_WORD), F.lit("RSA")), none, none, 0.55),
        ("hkdf", has(HKDF_LINE), "HKDF", "kdf", "sha256", none, none, 0.55),
        ("bcrypt", has(BCRYPT_LINE), "bcrypt", F.when(~salt & ~compare, "kdf"), none, none, F.when(salt, "salt"), 0.55),
        ("pbkdf2", has(r"crypto\.pbkdf2"), "PBKDF2", "kdf", none, none, none, 0.55),
        ("cipher", has(CIPHER_LINE), F.coalesce(cipher["family"], F.lit("AES")), "block-cipher", cipher["key_size"], F.when(word(CIPHER_WORD).isNull(), "CBC").otherwise(cipher["mode"]), none, 0.55),
        ("token", has(TOKEN_LINE), F.coalesce(known_token["family"], F.lit("HMAC")), "signature", token, F.when(known_token.isNull(), "SHA-256").otherwise(known_token["mode"]), none, 0.55),
        ("js-cipher", has(JS_CIPHER_LINE), js_family, F.when(js.isin("rc4", "rabbit"), "stream-cipher").otherwise("block-cipher"), none, none, none, 0.55),
        ("js-hash", has(JS_HASH_LINE), F.coalesce(C.algorithm_identifier(digest)["family"], digest), "hash", none, none, none, 0.55),
        ("js-mac", has(JS_MAC_LINE), "HMAC", "mac", none, F.coalesce(F.upper(word(JS_MAC_WORD)), F.lit("SHA256")), none, 0.55),
        ("js-kdf", has(JS_KDF_LINE), F.upper(word(JS_KDF_WORD)), "kdf", none, none, none, 0.55),
    ]
    names = ("family", "primitive", "parameter", "mode", "material")
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    fired = [
        F.when(fires, F.struct(F.lit(topic).alias("topic"), *[column(v).cast("string").alias(k) for k, v in zip(names, values, strict=True)], F.lit(sure).alias("confidence")))
        for topic, fires, *values, sure in rules_of
    ]
    return lines.withColumn("hit", F.explode(F.array_compact(F.array(*fired))))


def _cases(kinds: tuple, otherwise: Column) -> Column:
    out = otherwise
    for condition, value in reversed(kinds):
        out = F.when(condition, value).otherwise(out)
    return out


def fallback(files: DataFrame) -> DataFrame:
    """Findings of the line rules, for files that no parser reads."""
    hits = line_matches(text_lines(files, C.as_text(F.col("content")))).withColumn("filePath", F.col("path"))
    stored = F.col("hit.material").isNotNull()
    return finding(
        hits, "ast", "direct", assetType=F.when(stored, "related-crypto-material").otherwise("algorithm"), name=F.when(stored, "bcrypt-salt").otherwise(F.col("hit.family")), algorithmFamily=F.col("hit.family"),
        primitive=F.col("hit.primitive"), mode=F.col("hit.mode"), parameterSet=F.col("hit.parameter"), materialType=F.col("hit.material"), rawConfidence=F.col("hit.confidence"),
        detail=F.concat(F.lit("line rule: "), F.col("hit.topic")),
    )


def cose_column(number: Column) -> Column:
    """struct(family, parameter) of a COSE number, null for others."""
    out = F.lit(None)
    for k, (family, parameter) in rules.COSE.items():
        out = F.when(number == k, F.struct(F.lit(family).alias("family"), F.lit(parameter).alias("parameter"))).otherwise(out)
    return out


def library_info(name: Column) -> Column:
    """struct(primitive, families, exact) of a package: by its name, then by the name without scope, then by stems."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("primitive"), F.lit(x[1]).alias("families")) for kv in rules.LIBRARIES.items() for x in kv])
    low = F.lower(name)
    bare = F.when(F.contains(low, F.lit("/")), F.try_element_at(F.split(low, "/"), F.lit(2))).otherwise(low)
    info = lambda s, exact: F.when(s.isNotNull(), F.struct(s["primitive"].alias("primitive"), s["families"].alias("families"), F.lit(exact).alias("exact")))
    stems = F.lit(None)
    for pattern, primitive, families in reversed(rules.STEMS):
        stems = F.when(bare.rlike(pattern), F.struct(F.lit(primitive).alias("primitive"), F.lit(families).alias("families"), F.lit(False).alias("exact"))).otherwise(stems)
    known = F.coalesce(info(F.try_element_at(table, low), True), info(F.try_element_at(table, bare), False), stems)
    return F.when(~low.isin(rules.NOT_CAPABLE), known)


def sca_confidence(exact: Column, direct: Column, dev: Column, corroborated: Column) -> Column:
    x = F.when(exact, 0.70).otherwise(0.50) + F.when(direct, 0.15).otherwise(-0.10) - F.when(dev, 0.10).otherwise(0.0) + F.when(corroborated, 0.20).otherwise(0.0)
    return C.half_up(F.greatest(F.lit(0.15), F.least(F.lit(0.98), x)), 2)


def corroborated(known: DataFrame, findings: DataFrame) -> DataFrame:
    """(scan, name, version, agreed) of known packages (families, bare) whose family a finding of the scan has, or whose
    bare name the detail of some evidence contains.

    The names of a scan's known packages are one short array, for there are no more than known
    libraries; each finding meets that array once and passes on the names that it contains.
    """
    key = [SCAN, "name", "version"]
    seen = findings.where(F.col("algorithmFamily").isNotNull()).select(SCAN, F.col("algorithmFamily").alias("f")).distinct()
    by_family = known.select(*key, F.explode("families").alias("f")).join(seen, [SCAN, "f"]).select(*key)
    names = known.groupBy(SCAN).agg(F.collect_set("bare").alias("names"))
    details = findings.select(SCAN, F.explode("evidence.detail").alias("detail")).distinct().join(names, SCAN)
    met = details.select(SCAN, F.explode(F.filter("names", lambda n: F.contains(F.col("detail"), n))).alias("bare")).distinct()
    by_name = known.join(met, [SCAN, "bare"]).select(*key)
    return by_family.union(by_name).distinct().withColumn("agreed", F.lit(True))


def packages(bom: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings for packages known to hold cryptography, surer where a code finding agrees on the family or names the package."""
    by = scan_key(bom, findings)
    if not by:
        bom, findings, by = bom.withColumn(SCAN, F.lit("")), findings.withColumn(SCAN, F.lit("")), [SCAN]
        return packages(bom, findings).drop(SCAN)
    known = bom.withColumn("info", library_info(F.col("name"))).where(F.col("info").isNotNull()).withColumn("families", F.split("info.families", ", "))
    known = known.withColumn("bare", F.coalesce(F.try_element_at(F.split("name", "/"), F.lit(2)), "name"))
    agreed = corroborated(known, findings)
    rows = known.join(agreed, [SCAN, "name", "version"], "left").withColumn("agreed", F.coalesce("agreed", F.lit(False)))
    rows = rows.withColumns({"filePath": F.concat(F.lit("node_modules/"), F.col("name"), F.lit("/package.json")), "line": F.lit(1)})
    family = F.coalesce(F.col("families")[0], F.col("name"))
    primitive = F.create_map(*[F.lit(x) for kv in rules.PRIMITIVE_OF.items() for x in kv])
    return finding(
        rows, "sca", "supporting", evidenceClass=F.when(F.col("isDirect") & F.col("agreed"), "direct").otherwise("supporting"), assetType="algorithm", name=family, algorithmFamily=family,
        primitive=F.try_element_at(primitive, F.col("info.primitive")), rawConfidence=sca_confidence(F.col("info.exact"), F.col("isDirect"), F.col("devDependency"), F.col("agreed")),
        detail=F.concat(F.lit("package "), F.col("name")), contextCategory=F.when(F.col("isDirect") & F.col("agreed"), "production").otherwise("vendor"),
    )
