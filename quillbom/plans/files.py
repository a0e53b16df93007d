"""Detectors on files made of the driver's tables: scripts of pages and texts of documents, with code around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillbom.functions import columns as C
from quillbom.functions import rules
from quillbom.operators import assess, calls, relate, sbom, scan
from quillbom.plans.registered import query
from quillbom.session import table
from quillbom.sources import repository

_SCRIPT = "<script>(.*?)</script>"


def _files(rows, key, *lines):
    """(path, content) of a file for each row: the lines, which are literals or columns."""
    text = F.concat_ws("\n", *[F.coalesce(F.lit(x) if isinstance(x, str) else x, F.lit("")) for x in lines])
    return rows.select(F.col(key).cast("string").alias("path"), text.cast("binary").alias("content"))


@query(r"""WITH s AS (SELECT page_id, CAST(page_id AS VARCHAR) AS p, regexp_extract(html, '<script>(.*?)</script>', 1) AS code FROM pages),
c AS (
    SELECT page_id, 1 AS line, '' AS receiver, 'test' AS method, '''' || p || '''' AS argument FROM s UNION ALL SELECT page_id, 1, '', 'fold', p FROM s
    UNION ALL SELECT page_id, 2, 'crypto', 'createHash', '''md5-' || p || '''' FROM s UNION ALL SELECT page_id, 2, '', 'inner', p FROM s
    UNION ALL SELECT page_id, 3, 'crypto', 'createHmac', '''sha256''' FROM s UNION ALL SELECT page_id, 3, 'a.b', 'digest', '/[/''"]/g' FROM s
    UNION ALL SELECT page_id, 5, '', 'half', 'x/' || p || '/2' FROM s
    UNION ALL SELECT page_id, 4, '', 'track', unnest(regexp_extract_all(code, 'track\(([0-9]+)\)', 1)) FROM s
)
SELECT page_id, line, receiver, method, argument FROM c""")
def lexed_calls(spark, sf_dir):
    """Calls in scripts with quotes in regular expressions, nested templates, computed members and divisions; none in comments."""
    rows = table(spark, sf_dir, "pages").withColumn("p", F.col("page_id").cast("string"))
    files = _files(
        rows, "page_id",
        F.concat(F.lit("const q = /['\"`/*]/.test('"), "p", F.lit("') ? 1 / fold("), "p", F.lit(") : 2 / 3; // lost('x')")),
        F.concat(F.lit("const t = `a 'b ${crypto.createHash('md5-"), "p", F.lit("')} /* ${ /* no(1) */ `${inner("), "p", F.lit(")} }`} c`;")),
        "crypto['createHmac']('sha256', k); if (x) /`/.exec; a?.b.digest?.(/[/'\"]/g, { c: '}' });",
        F.regexp_extract("html", _SCRIPT, 1),
        F.concat(F.lit("y = { z: 1 } / half(x / "), "p", F.lit(" / 2) / `}${'`'}`.length; /* gone(1); `")),
    )
    found = calls.code_facts(files).where("kind = 'call' and b <> 'exec'")
    return found.select(F.col("path").cast("long").alias("page_id"), F.col("line").cast("int").alias("line"), F.col("a").alias("receiver"), F.col("b").alias("method"), F.get("args", F.lit(0)).alias("argument"))


@query(r"""WITH s AS (SELECT page_id, page_id % 3 AS kind, ['sha256', 'sha384', 'sha512'][page_id % 3 + 1] AS digest FROM pages)
SELECT page_id, 3::INT AS line, 'SHA-' || substr(digest, 4) AS family, 'hash' AS primitive FROM s UNION ALL SELECT page_id, 4, 'CSPRNG', 'drbg' FROM s UNION ALL SELECT page_id, 5, 'HMAC', 'mac' FROM s""")
def renamed_calls(spark, sf_dir):
    """Calls by names that imports and destructuring give to functions of modules, after they are bound and not before."""
    digest = F.element_at(F.array(*[F.lit(x) for x in ("sha256", "sha384", "sha512")]), (F.col("page_id") % 3 + 1).cast("int"))
    files = _files(
        table(spark, sf_dir, "pages"), "page_id", "import { randomBytes as fill } from 'node:crypto'; early('md5');", "const { createHash: early, createHmac } = require('crypto'), lib = require('./lib');",
        F.concat(F.lit("early('"), digest, F.lit("').update(lib.createHash(1));")), F.concat(F.lit("fill("), F.col("page_id").cast("string"), F.lit(");")), "createHmac('sha256', key);",
    )
    found = calls.findings(files)
    return found.select(F.col("filePath").cast("long").alias("page_id"), "line", F.col("algorithmFamily").alias("family"), "primitive")


@query(r"""WITH d AS (SELECT doc_id, source, len(string_split(replace(coalesce(text, ''), '*/', ''), chr(10))) AS n FROM documents)
SELECT doc_id, 1::INT AS line, 'const g = ''app/*''; r = /[/*]''/;' AS code FROM d UNION ALL SELECT doc_id, n + 1, 'require(''jose'');' FROM d
UNION ALL SELECT doc_id, n + 2, 'x = `/* ${a} */`;' FROM d UNION ALL SELECT doc_id, n + 3, 'verify(' || doc_id || ')' FROM d""")
def comment_state(spark, sf_dir):
    """Lines of code outside block comments; the texts of all documents are comments, and quotes, templates and patterns open none."""
    rows = table(spark, sf_dir, "documents")
    files = _files(
        rows, "doc_id", "const g = 'app/*'; r = /[/*]'/;", F.concat(F.lit("/* "), F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit("")), F.lit(" */ require('jose');")),
        F.concat(F.lit("x = `/* ${a} */`; /* "), "source"), F.concat(F.lit(" */ verify("), F.col("doc_id").cast("string"), F.lit(") /* to the end")),
    )
    code = scan.comment_free(files).withColumn("code", F.trim("code")).where("code <> ''")
    return code.select(F.col("path").cast("long").alias("doc_id"), F.col("line").cast("int").alias("line"), "code")


@query(r"""WITH d AS (SELECT doc_id, text, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)
SELECT doc_id, 1::INT AS line, 'const j = require(''jose'');' AS detail FROM d UNION ALL SELECT doc_id, 3, 'account.verifyToken(' || doc_id || '); // sign(x)' FROM d
UNION ALL SELECT doc_id, n + 6, 'encrypt(' || n || ')' FROM d""")
def candidate_lines(spark, sf_dir):
    """Lines that import or call what sounds like cryptography, unless direct evidence stands there."""
    rows = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    files = _files(
        rows, "doc_id", "const j = require('jose');", "crypto.createHash('md5'); // direct evidence", F.concat(F.lit("account.verifyToken("), F.col("doc_id").cast("string"), F.lit("); // sign(x)")),
        "hashmap.get('sign(1)', designer(2)); /* verify(3)", F.lit(""), F.concat(F.regexp_replace(text, r"\*/", ""), F.lit(" */")), F.concat(F.lit("encrypt("), F.size(F.split(text, "\n")).cast("string"), F.lit(")")),
    )
    found = scan.candidates(files, calls.findings(files))
    return found.select(F.col("filePath").cast("long").alias("doc_id"), "line", F.col("evidence")[0]["detail"].alias("detail"))


@query(r"""WITH d AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n, md5(coalesce(text, '')) AS body, source FROM documents),
b AS (
    SELECT doc_id, n + 1 AS line, 'EC PRIVATE KEY' AS label, 'private-key' AS kind, body FROM d
    UNION ALL SELECT doc_id, n + 4, 'PUBLIC KEY', 'public-key', source FROM d UNION ALL SELECT doc_id, n + 7, 'CERTIFICATE', NULL, source FROM d
)
SELECT doc_id, CAST(line AS INTEGER) AS line, kind AS material, substr(sha256('-----BEGIN ' || label || '-----' || chr(10) || body || chr(10) || '-----END ' || label || '-----'), 1, 16) AS fingerprint FROM b""")
def pem_findings(spark, sf_dir):
    """Key and certificate blocks at the end of every document's text, with their fingerprints."""
    block = lambda label, body: F.concat(F.lit(f"-----BEGIN {label}-----\n"), body, F.lit(f"\n-----END {label}-----"))
    rows = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    files = _files(rows, "doc_id", text, block("EC PRIVATE KEY", F.md5(text)), block("PUBLIC KEY", F.col("source")), block("CERTIFICATE", F.col("source")))
    found = scan.pem_blocks(files)
    return found.select(F.col("filePath").cast("long").alias("doc_id"), "line", F.col("materialType").alias("material"), "fingerprint")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'MD5' WHEN 'fr' THEN 'SHA-256' WHEN 'de' THEN 'AES' ELSE 'ChaCha20' END AS family, CAST(len(string_split(coalesce(text, ''), chr(10))) + 1 AS INTEGER) AS line FROM documents")
def constant_findings(spark, sf_dir):
    """Constants of algorithms among the bytes of every document, one algorithm for each language."""
    names = {"en": "MD5", "fr": "SHA-256", "de": "AES", "es": "ChaCha20"}
    held = F.lit(None).cast("binary")
    for lang, name in names.items():
        held = F.when(F.col("lang") == lang, F.unhex(F.lit(rules.BYTE_CONSTANTS[next(k for k in rules.BYTE_CONSTANTS if k.upper().startswith(name.upper()))]))).otherwise(held)
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.lit("\n").cast("binary"), held, F.lit("\nend").cast("binary")).alias("content"))
    return scan.byte_constants(files).select(F.col("filePath").cast("long").alias("doc_id"), F.col("algorithmFamily").alias("family"), "line")


_RULE_LINES = [
    "const {w} = crypto.subtle.digest('SHA-256', {w})", "crypto.subtle.importKey('raw', {w}, {{ name: 'AES-GCM' }})", "await crypto.subtle.verify({{ name: 'RSA-PSS' }}, {w})", "crypto.subtle.deriveBits({w})", "crypto.sign({w}); x", "crypto.verify('RSA-SHA256', {w})",
    "crypto.hkdfSync('sha512', {w})", "bcrypt.compare({w}, hash)", "bcrypt.genSaltSync(12) + {w}", "bcrypt.hash({w})", "crypto.pbkdf2({w})", "crypto.createCipheriv({w}, key)", "crypto.createCipheriv('aes-256-gcm', {w})", "crypto.createDecipheriv('aes-256-gcm', {w})",
    "jwt.sign({w}, key, {{ algorithm: 'RS256' }})", "jwt.verify({w}, key)", "CryptoJS.DES.encrypt({w})", "cryptojs.TripleDES.decrypt({w})", "CryptoJS.RC4.encrypt({w})", "CryptoJS.MD5({w})", "CryptoJS.SHA512({w}) + CryptoJS.HmacSHA1({w})", "CryptoJS.EvpKDF({w})",
    "{{ coseAlg: -7, {w} }}", "algorithm: -257", "alg: -99 {w}", "total({w})",
]


@query(r"""WITH w AS (SELECT doc_id, line, regexp_extract(content, '[A-Za-z]+', 0) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)),
l AS (SELECT doc_id, line, replace((""" + "[" + ", ".join("'" + x.format(w="{w}").replace("'", "''") + "'" for x in _RULE_LINES) + r"""])[(length(w) * 7 + ascii(w) + line) % 26 + 1], '{w}', w) AS c FROM w),
f AS (
    SELECT doc_id, line, 'cose' AS topic, CASE n WHEN '-7' THEN 'ECDSA' WHEN '-257' THEN 'RSA' END AS family, 'signature' AS primitive, CASE n WHEN '-7' THEN 'P-256 / ES256' WHEN '-257' THEN 'RS256' END AS parameter, NULL AS mode, NULL AS material
    FROM (SELECT *, regexp_extract(c, '(?i)(alg|coseAlg|algorithm): (-7|-257)\b', 2) AS n FROM l) WHERE n <> ''
    UNION ALL SELECT doc_id, line, 'webcrypto', CASE WHEN c ILIKE '%P-256%' OR c ILIKE '%ecdsa%' THEN 'ECDSA' WHEN c ILIKE '%rsa%' THEN 'RSA' WHEN c ILIKE '%aes%' THEN 'AES' WHEN contains(c, 'digest(') THEN 'SHA-256' WHEN contains(c, 'deriveBits(') THEN 'HKDF' ELSE 'ECDSA' END,
        CASE WHEN c ILIKE '%aes%' AND c NOT ILIKE '%rsa%' AND c NOT ILIKE '%ecdsa%' THEN 'block-cipher' WHEN contains(c, 'digest(') THEN 'hash' WHEN contains(c, 'deriveBits(') THEN 'kdf' ELSE 'signature' END, NULL, NULL, NULL FROM l WHERE regexp_matches(c, 'crypto\.subtle\.(digest|importKey|verify|deriveBits)')
    UNION ALL SELECT doc_id, line, 'sign', 'RSA', 'signature', coalesce(nullif(regexp_extract(c, 'crypto\.(sign|verify)\(''?([A-Za-z0-9-]+)', 2), ''), 'RSA'), NULL, NULL FROM l WHERE regexp_matches(c, 'crypto\.(sign|verify)\(')
    UNION ALL SELECT doc_id, line, 'hkdf', 'HKDF', 'kdf', 'sha256', NULL, NULL FROM l WHERE contains(c, 'crypto.hkdfSync(')
    UNION ALL SELECT doc_id, line, 'bcrypt', 'bcrypt', CASE WHEN contains(c, 'bcrypt.hash') AND NOT contains(c, 'compare') THEN 'kdf' END, NULL, NULL, CASE WHEN contains(c, 'genSalt') THEN 'salt' END FROM l WHERE regexp_matches(c, 'bcrypt\.(hash|compare|genSalt)')
    UNION ALL SELECT doc_id, line, 'pbkdf2', 'PBKDF2', 'kdf', NULL, NULL, NULL FROM l WHERE contains(c, 'crypto.pbkdf2')
    UNION ALL SELECT doc_id, line, 'cipher', 'AES', 'block-cipher', CASE WHEN contains(c, '''aes-256') THEN '256' END, CASE WHEN contains(c, '''aes-256') THEN 'GCM' ELSE 'CBC' END, NULL FROM l WHERE contains(c, 'crypto.createCipheriv(')
    UNION ALL SELECT doc_id, line, 'token', CASE WHEN contains(c, '''RS256''') THEN 'RSA' ELSE 'HMAC' END, 'signature', CASE WHEN contains(c, '''RS256''') THEN 'RS256' ELSE 'HS256' END, 'SHA-256', NULL FROM l WHERE regexp_matches(c, 'jwt\.(sign|verify)')
    UNION ALL SELECT doc_id, line, 'js-cipher', CASE WHEN contains(c, 'TripleDES') THEN '3DES' WHEN contains(c, '.DES') THEN 'DES' ELSE 'RC4' END, CASE WHEN contains(c, 'RC4') THEN 'stream-cipher' ELSE 'block-cipher' END, NULL, NULL, NULL FROM l WHERE regexp_matches(c, '(?i)cryptojs\.(DES|TripleDES|RC4)\.(en|de)crypt')
    UNION ALL SELECT doc_id, line, 'js-hash', CASE WHEN contains(c, 'MD5(') THEN 'MD5' ELSE 'SHA-512' END, 'hash', NULL, NULL, NULL FROM l WHERE regexp_matches(c, 'CryptoJS\.(MD5|SHA512)\(')
    UNION ALL SELECT doc_id, line, 'js-mac', 'HMAC', 'mac', NULL, 'SHA1', NULL FROM l WHERE contains(c, 'CryptoJS.HmacSHA1')
    UNION ALL SELECT doc_id, line, 'js-kdf', 'EVPKDF', 'kdf', NULL, NULL, NULL FROM l WHERE contains(c, 'CryptoJS.EvpKDF(')
)
SELECT doc_id, CAST(line AS INTEGER) AS line, topic, family, primitive, parameter, mode, material FROM f""")
def line_rules(spark, sf_dir):
    """Line rules for code that can't be parsed, on lines made of a word of every line of the documents; several may fire."""
    rows = table(spark, sf_dir, "documents")
    lines = scan.text_lines(rows, F.col("text"), "doc_id").withColumn("w", F.regexp_extract("content", "[A-Za-z]+", 0))
    place = (F.length("w") * 7 + F.ascii("w") + F.col("line")) % len(_RULE_LINES) + 1
    line = F.replace(F.element_at(F.array(*[F.lit(x.format(w="{w}")) for x in _RULE_LINES]), place.cast("int")), F.lit("{w}"), F.col("w"))
    hits = scan.line_matches(lines.withColumn("content", line))
    return hits.select("doc_id", F.col("line").cast("int").alias("line"), *[F.col(f"hit.{c}").alias(c) for c in ("topic", "family", "primitive", "parameter", "mode", "material")])


_FOLDERS = ["src/", "lib/test/", "node_modules/bcrypt/lib/", "node_modules/@noble/hashes/", "node_modules/left-pad/", "dist/", ".git/", "", "node_modules/bcrypt/test/", "app/fixtures/", "a/b/c/", "node_modules/jose/a/b/c/d/e/"]
_ENDS = [".js", ".TS", ".d.ts", ".pem", ".mjs", ".test.js", ".css", ".tsx", "", ".KEY"]


@query(r"""WITH p AS (SELECT page_id, """ + "[" + ", ".join(f"'{x}'" for x in _FOLDERS) + r"""][length(url) % 12 + 1] || 'p' || page_id || """ + "[" + ", ".join(f"'{x}'" for x in _ENDS) + r"""][(length(html) + page_id) % 10 + 1] AS path, length(html) * 40 AS size FROM pages),
f AS (SELECT *, lower(regexp_extract(path, '\.([^./]*)$', 1)) AS ext, string_split(path, '/') AS parts, regexp_matches(path, '(?i)[._-](test|spec)\.[a-z0-9]+$') OR regexp_matches(path, '(^|/)(__tests__|__mocks__|test|tests)/') AS test FROM p),
g AS (
    SELECT *, list_has_any(parts, ['node_modules', '.git', 'dist', 'build', 'coverage', '.next', '__tests__', '__mocks__', 'test', 'tests', 'fixtures']) AS skipped,
           regexp_matches(path, '^node_modules/(bcrypt|jose|@noble/hashes)/') AND len(string_split(regexp_replace(path, '^node_modules/(bcrypt|jose|@noble/hashes)/', ''), '/')) <= 5
           AND NOT list_has_any(list_slice(parts, 3, 99), ['node_modules', '.git', 'test', 'tests']) AS vendored,
           list_contains(['js', 'jsx', 'ts', 'tsx', 'mjs', 'cjs'], ext) AND NOT path LIKE '%.d.ts' AND NOT test AS source
    FROM f
)
SELECT page_id, path, ext, source AND (NOT skipped OR vendored AND ext IN ('js', 'mjs', 'cjs')) AS code, source AND NOT skipped AS candidates,
       (list_contains(['pem', 'key', 'crt', 'cer', 'p12', 'pfx', 'jks', 'keystore'], ext) OR size < 20000) AND NOT skipped AND NOT test AS keys, size <= 2000000 AND NOT skipped AND NOT test AS constants FROM g""".replace("\\\\", "\\"))
def file_kinds(spark, sf_dir):
    """Which detectors read a file: by folder, name, extension and size."""
    pages = table(spark, sf_dir, "pages")
    nth = lambda values, place: F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))
    path = F.concat(nth(_FOLDERS, F.length("url")), F.lit("p"), F.col("page_id").cast("string"), nth(_ENDS, F.length("html") + F.col("page_id")))
    tree = pages.select("page_id", path.alias("path"), (F.length("html") * 40).cast("long").alias("length")).withColumn("ext", C.extension(F.col("path")))
    kinds = {"code": repository.code_files, "candidates": repository.candidate_files, "keys": repository.pem_files, "constants": repository.constant_files}
    found = tree.select("page_id", "path", "ext")
    for name, pick in kinds.items():
        found = found.join(pick(tree).select("page_id", F.lit(True).alias(name)), "page_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return found


@query("""SELECT p_partkey, p_brand AS name, CASE p_size % 3 WHEN 0 THEN 'rsa' WHEN 1 THEN 'ec' ELSE 'ed25519' END AS kind, '20' || CAST(20 + p_size % 40 AS VARCHAR) || '-03-04T05:06:07Z' AS until FROM part""")
def certificate_facts(spark, sf_dir):
    """Subject, end and type of key of certificates made of every part's values, and null for those that can't be read."""
    part = table(spark, sf_dir, "part")
    tlv = lambda tag, *parts: (lambda body: F.concat(F.lit(tag), F.lpad(F.hex((F.length(body) / 2).cast("long")), 2, "0"), body))(F.concat(*parts))
    lit = F.lit
    oid = F.when(F.col("p_size") % 3 == 0, tlv("06", lit("2A864886F70D010101"))).when(F.col("p_size") % 3 == 1, tlv("06", lit("2A8648CE3D0201"))).otherwise(tlv("06", lit("2B6570")))
    name = tlv("30", tlv("31", tlv("30", tlv("06", lit("550403")), tlv("0C", F.hex(F.col("p_brand").cast("binary"))))))
    year = (F.lit(20) + F.col("p_size") % 40).cast("string")
    time = lambda text: tlv("17", F.hex(text.cast("binary")))
    validity = tlv("30", time(lit("200101000000Z")), time(F.concat(year, lit("0304050607Z"))))
    body = tlv("30", tlv("02", lit("01")), tlv("30", tlv("06", lit("2A03"))), tlv("30", lit("")), validity, name, tlv("30", tlv("30", oid), tlv("03", lit("00"))))
    pem = F.concat(lit("-----BEGIN CERTIFICATE-----\n"), F.base64(F.unhex(tlv("30", body))), lit("\n-----END CERTIFICATE-----"))
    read = assess.certificates(part.select("p_partkey", pem.alias("pem")))
    until = F.regexp_replace("validTo", "^19", "20")  # years from 50 on are of the last century in this form of time
    return read.select("p_partkey", F.regexp_replace("subject", "^CN=", "").alias("name"), F.col("keyType").alias("kind"), until.alias("until"))


@query("""SELECT doc_id, 'File: ' || source || '.js' || chr(10) || chr(10) || 'Similar code:' || chr(10) || '- ' || lang || ' (0.' || CAST(50 + doc_id % 50 AS VARCHAR) || ')' || chr(10) || '- x (0.25)' || chr(10) || chr(10) || 'Code:' || chr(10) || left(coalesce(text, ''), 200)
|| chr(10) || chr(10) || 'Answer with one JSON object: algorithmFamily, primitive, parameterSet, confidence, reasoning.' AS prompt FROM documents""")
def verification_prompts(spark, sf_dir):
    """What a model is asked about a place in code, with what is similar to it."""
    rows = table(spark, sf_dir, "documents")
    near = lambda name, score: F.struct(name.alias("entry"), score.cast("double").alias("score"))
    neighbours = F.array(near(F.col("lang"), (F.lit(50) + F.col("doc_id") % 50) / 100), near(F.lit("x"), F.lit(0.25)))
    return rows.select("doc_id", relate.prompt(F.concat("source", F.lit(".js")), F.left(F.coalesce("text", F.lit("")), F.lit(200)), neighbours).alias("prompt"))


@query("""SELECT page_id, 'sha-' || page_id AS name, CASE WHEN page_id % 2 = 0 THEN 'algorithm' ELSE 'related-crypto-material' END AS kind, CASE WHEN page_id % 2 = 0 THEN 'hash' END AS primitive, CASE WHEN page_id % 2 = 1 THEN length(url) END AS size,
CASE WHEN page_id % 3 = 0 THEN 'static,llm' ELSE 'ast,embedding' END AS sources, CASE WHEN page_id % 5 = 0 THEN 'pkg:npm/p' || (page_id % 4) END AS provided FROM pages""")
def cbom_document(spark, sf_dir):
    """The cryptographic inventory of all pages as findings, written as documents of ten scans and read back."""
    rows = table(spark, sf_dir, "pages")
    p, even = F.col("page_id"), F.col("page_id") % 2 == 0
    evidence = lambda source: F.struct(F.lit(source).alias("source"), F.lit("direct").alias("evidenceClass"), F.col("url").alias("detail"), F.lit(0.9).alias("rawConfidence"), F.col("url").alias("filePath"), F.lit(1).alias("line"))
    none = F.lit(None).cast("string")
    package = F.concat(F.lit("pkg:npm/p"), (p % 4).cast("string"))
    found = rows.select(
        (p % 10).cast("string").alias("scan"), F.when(even, "algorithm").otherwise("related-crypto-material").alias("assetType"), F.concat(F.lit("sha-"), p.cast("string")).alias("name"), F.when(even, "hash").alias("primitive"),
        F.when(~even, F.concat(F.length("url").cast("string"), F.lit(" bits"))).alias("parameterSet"), none.alias("mode"), F.lit(3).alias("nistQuantumLevel"), F.when(~even, "secret-key").alias("materialType"), F.lit(0.9).alias("confidence"),
        F.when(p % 5 == 0, "vendor").otherwise("production").alias("contextCategory"), F.lit("LOW").alias("quantumRisk"), F.lit("NONE").alias("exposureRisk"), none.alias("fingerprint"),
        F.when(p % 3 == 0, F.array(evidence("sca"), evidence("llm"), evidence("constant"))).otherwise(F.array(evidence("ast"), evidence("vectorSearch"))).alias("evidence"), F.col("url").alias("filePath"), F.lit(1).alias("line"), p.cast("string").alias("findingId"),
        F.struct(F.lit("n").alias("name"), F.lit("1").alias("version"), package.alias("purl")).alias("packageContext"),
    )
    kind = (
        "components array<struct<`bom-ref` string, name string, sources array<string>, cryptoProperties struct<assetType string, algorithmProperties struct<primitive string>, relatedCryptoMaterialProperties struct<size long>>>>, "
        "dependencies array<struct<ref string, provides array<string>>>"
    )
    read = relate.documents(found).select(F.from_json("document", kind).alias("d"))
    edges = read.select(F.explode("d.dependencies").alias("e")).select(F.col("e.ref").alias("provided"), F.explode("e.provides").alias("ref"))
    parts = read.select(F.explode("d.components").alias("c")).select(F.col("c.bom-ref").alias("ref"), "c.name", "c.cryptoProperties.*", F.array_join("c.sources", ",").alias("sources"))
    return parts.join(edges, "ref", "left").select(
        F.substring("name", 5, 20).cast("long").alias("page_id"), "name", F.col("assetType").alias("kind"), F.col("algorithmProperties.primitive").alias("primitive"), F.col("relatedCryptoMaterialProperties.size").alias("size"), "sources", "provided",
    )


@query("""WITH c AS (SELECT c_nationkey::BIGINT AS scan, 'r' || c_custkey AS ref, c_name AS name, c_custkey FROM customer)
SELECT scan, name, CASE WHEN c_custkey % 3 = 0 THEN 'npm' ELSE 'unknown' END AS ecosystem, c_custkey % 4 = 0 AS dev, c_custkey % 5 = 0 OR c_custkey % 7 = 0 AS direct, coalesce(n, 0) AS n_known
FROM c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey""")
def bom_rows(spark, sf_dir):
    """Packages of the document of each nation, with the vulnerabilities that affect them."""
    customers = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    dev = F.array(F.struct(F.lit("cdx:npm:package:development").alias("name"), F.when(k % 4 == 0, "true").otherwise("false").alias("value")))
    component = F.struct(
        F.col("c_name").alias("name"), F.lit("1").alias("version"), F.concat(F.when(k % 3 == 0, "pkg:npm/").otherwise("pkg:pypi/"), "c_name").alias("purl"), F.concat(F.lit("r"), k.cast("string")).alias("bom-ref"),
        F.when(k % 5 == 0, "required").otherwise("optional").alias("scope"), F.lit(None).cast("boolean").alias("direct"), dev.alias("properties"),
    )
    scan_of = F.col("c_nationkey").cast("long").alias("scan")
    parts = customers.groupBy(scan_of).agg(F.collect_list(component).alias("components"))
    affects = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(customers.select(F.col("c_custkey").alias("o_custkey"), scan_of), "o_custkey")
    vuln = F.struct(F.concat(F.lit("V"), F.col("o_orderkey").cast("string")).alias("id"), F.array(F.struct(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("ref"))).alias("affects"))
    boms = parts.join(affects.groupBy("scan").agg(F.collect_list(vuln).alias("vulnerabilities")), "scan", "left")
    named = customers.where(k % 7 == 0).select(scan_of, F.col("c_name").alias("name"))
    return repository.bom_packages(boms, named).select("scan", "name", "ecosystem", F.col("devDependency").alias("dev"), F.col("isDirect").alias("direct"), F.size("osvCves").cast("long").alias("n_known"))


@query("""SELECT o_orderkey, o_orderpriority AS latest, CAST(o_orderdate AS DATE)::VARCHAR AS published, CASE o_orderkey % 4 WHEN 0 THEN 'MIT-' || o_orderstatus WHEN 1 THEN 'BSD-' || o_custkey WHEN 2 THEN 'ISC-' || o_custkey ELSE 'UNKNOWN' END AS license,
CASE WHEN o_orderstatus = 'F' THEN 'old ' || o_custkey END AS deprecated, CASE WHEN o_orderstatus = 'F' THEN 'Deprecated: old ' || o_custkey END AS reason FROM orders""")
def registry_facts(spark, sf_dir):
    """Fields of registry documents, with licences in their three forms, and what deprecation says."""
    orders = table(spark, sf_dir, "orders")
    k, who = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    licence = (
        F.when(k % 4 == 0, F.concat(F.lit('"license":"MIT-'), "o_orderstatus", F.lit('",'))).when(k % 4 == 1, F.concat(F.lit('"license":{"type":"BSD-'), who, F.lit('"},')))
        .when(k % 4 == 2, F.concat(F.lit('"licenses":[{"type":"ISC-'), who, F.lit('"}],'))).otherwise("")
    )
    old = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('{"deprecated":"old '), who, F.lit('"}'))).otherwise("{}")
    document = F.concat(
        F.lit("{"), licence, F.lit('"dist-tags":{"latest":'), quoted(F.col("o_orderpriority")), F.lit('},"time":{'), quoted(F.col("o_orderpriority")), F.lit(":"), quoted(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.lit('},"versions":{"0":{"deprecated":"no"},'), quoted(F.col("o_orderpriority")), F.lit(":"), old, F.lit("}}"),
    )
    read = repository.registry_fields(orders.select(k.cast("string").alias("name"), document.alias("packument"), F.lit(False).alias("notFound")))
    said = sbom.deprecation(F.col("deprecated"))["reason"]
    return read.select(F.col("name").cast("long").alias("o_orderkey"), "latest", F.date_format("published", "yyyy-MM-dd").alias("published"), "license", "deprecated", said.alias("reason"))
