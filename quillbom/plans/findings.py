"""Finding operators on the driver's tables: documents, pages and events stand for code and evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillbom.functions import columns as C
from quillbom.functions import rules
from quillbom.operators import assess, calls, documents, relate, scan, views
from quillbom.plans.registered import query
from quillbom.session import shared_folder, table
from quillbom.sources import repository


def _nth(values: list, column, kind: str = "string"):
    """The value of a list at a column's number, modulo the list's length."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (column % len(values) + 1).cast("int"))


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


@query("""SELECT p_partkey, upper(split_part(p_name, ' ', 1)) || CASE WHEN p_partkey % 3 = 0 THEN '-X' ELSE '' END AS family, upper(['gcm', 'cbc', 'ctr', 'ecb'][p_size % 4 + 1]) AS mode, CAST(100 + p_size * 8 AS VARCHAR) AS key_size FROM part""")
def algorithm_id_parse(spark, sf_dir):
    """What code calls an algorithm, as family, mode and key size: names in dashed parts, in any order and case (F1)."""
    word, size = F.substring_index("p_name", " ", 1), (F.lit(100) + F.col("p_size") * 8).cast("string")
    mode = _nth(["gcm", "cbc", "ctr", "ecb"], F.col("p_size"))
    family = F.when(F.col("p_partkey") % 3 == 0, F.concat(word, F.lit("-X"))).otherwise(word)
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("-", family, size, mode)).otherwise(F.concat(F.lit(" '"), F.upper(F.concat_ws("-", mode, family, size)), F.lit("'")))
    rows = table(spark, sf_dir, "part").withColumn("a", C.algorithm_identifier(raw))
    return rows.select("p_partkey", "a.family", "a.mode", "a.key_size")


@query("""SELECT p_partkey, CASE WHEN family IN ('RSA', 'DES', 'ECDSA') THEN 0 WHEN primitive = 'hash' THEN CASE WHEN size >= 512 THEN 5 WHEN size >= 384 THEN 4 WHEN size >= 256 THEN 3 WHEN size >= 160 THEN 1 ELSE 0 END
ELSE CASE WHEN size >= 256 THEN 5 WHEN size >= 192 THEN 3 WHEN size >= 128 THEN 1 ELSE 0 END END AS level
FROM (SELECT p_partkey, p_size * 12 AS size, ['AES', 'SHA', 'RSA', 'DES', 'ChaCha20', 'ECDSA'][p_partkey % 6 + 1] AS family, CASE WHEN p_partkey % 6 = 1 THEN 'hash' WHEN p_partkey % 6 IN (2, 5) THEN 'signature' ELSE 'block-cipher' END AS primitive FROM part)""")
def nist_level(spark, sf_dir):
    """Security levels of families and sizes of every part."""
    p = F.col("p_partkey") % 6
    primitive = F.when(p == 1, "hash").when(p.isin(2, 5), "signature").otherwise("block-cipher")
    family = _nth(["AES", "SHA", "RSA", "DES", "ChaCha20", "ECDSA"], F.col("p_partkey"))
    size = F.concat((F.col("p_size") * 12).cast("string"), F.lit(" bits"))
    return table(spark, sf_dir, "part").select("p_partkey", C.nist_level(F.lit("algorithm"), primitive, F.lit(None).cast("string"), family, size).cast("int").alias("level"))


@query(r"""WITH hit AS (SELECT doc_id, unnest(regexp_extract_all(text, 'token = "([0-9a-f]{40})"', 1)) AS secret FROM documents)
SELECT doc_id, substr(sha256(secret), 1, 16) AS fingerprint, count(*) AS n FROM hit GROUP BY ALL""")
def secret_fingerprint(spark, sf_dir):
    """Secrets in texts, by the start of their hash."""
    hits = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})"'), 1)).alias("secret"))
    return hits.groupBy("doc_id", C.fingerprint(F.col("secret")).alias("fingerprint")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, 'token = "[0-9a-f]{40}"') THEN length(string_split(text[1:strpos(text, 'token = "') - 1], chr(10))) END AS line,
CASE WHEN regexp_matches(text, 'token = "[0-9a-f]{40}"') THEN 'LOW' ELSE 'NONE' END AS exposure FROM documents""")
def secret_scan(spark, sf_dir):
    """Where secrets stand and how exposed they are."""
    found = F.col("text").rlike('token = "[0-9a-f]{40}"')
    material = F.when(found, "secret-key")
    asset = F.when(found, "related-crypto-material").otherwise("algorithm")
    empty = F.array().cast("array<string>")
    risk = C.exposure_risk(asset, material, F.lit("token"), F.lit(None).cast("string"), F.concat(F.lit("doc/"), F.col("source")), empty, empty)
    line = F.when(found, C.line_at(F.col("text"), F.instr("text", 'token = "')))
    return table(spark, sf_dir, "documents").select("doc_id", line.cast("long").alias("line"), risk.alias("exposure"))


@query("""SELECT doc_id, line, length(content) AS width FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
WHERE regexp_matches(lower(content), 'licensed under|token = ')""")
def line_scan(spark, sf_dir):
    """Texts as numbered lines, and those that a pattern meets."""
    lines = scan.text_lines(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")
    return lines.where(F.lower("content").rlike("licensed under|token = ")).select("doc_id", F.col("line").cast("long").alias("line"), F.length("content").cast("long").alias("width"))


_LINES_SQL = """lines AS (SELECT doc_id, line, content || ' ' || {code}[(doc_id + line) % {n} + 1] AS content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents))"""


def _code_lines(spark, sf_dir, code):
    """The lines of all documents, each with a piece of code behind it."""
    lines = scan.text_lines(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")
    return lines.withColumn("content", F.concat("content", F.lit(" "), _nth(code, F.col("doc_id") + F.col("line"))))


@query("""SELECT p_partkey, CASE WHEN segment IN ('Hash', 'Verify', 'Box') THEN w[1] || '.' || w[2] || segment ELSE '' END AS calls
FROM (SELECT p_partkey, string_split(p_name, ' ') AS w, ['Hash', 'List', 'Verify', 'Box', 'Items'][p_partkey % 5 + 1] AS segment FROM part)""")
def call_token_match(spark, sf_dir):
    """Calls whose name tells of cryptography, outside strings and comments; names are made of every part's words."""
    word = lambda i: F.split("p_name", " ")[i]
    line = F.concat(word(0), F.lit("."), word(1), _nth(["Hash", "List", "Verify", "Box", "Items"], F.col("p_partkey")), F.lit("(x, 'sign(z)'); // encrypt(y)"))
    calls = C.crypto_calls(C.sanitize_line(line))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(calls, ",").alias("calls"))


@query("""SELECT page_id, len(regexp_extract_all(html, 'track\\([0-9]+\\)')) AS calls, len(string_split(html, chr(10))) AS lines FROM pages""".replace("\\\\", "\\"))
def script_calls(spark, sf_dir):
    """Calls in the scripts of pages (F8 on markup)."""
    pages = table(spark, sf_dir, "pages")
    lines = scan.text_lines(pages.withColumn("path", F.col("page_id").cast("string")), F.col("html"))
    names = C.crypto_calls(C.sanitize_line(F.regexp_replace("content", r"\btrack\(", "verify(")))  # a name that tells of cryptography in place of the pages' own
    found = lines.select(F.col("path").cast("long").alias("page_id"), F.size(F.filter(names, lambda n: n == "verify")).alias("n"))
    return found.groupBy("page_id").agg(F.sum("n").alias("calls"), F.count("*").alias("lines"))


@query(r"""WITH p AS (SELECT page_id, ['src/', 'lib/tests/', 'vendor/', 'x/', 'app/', 'docs/node_modules/', ''][page_id % 7 + 1] || 'p' || page_id || regexp_replace(url, '^https?://[^/]+', '') || '.js' AS path FROM pages), l AS (SELECT *, lower(path) AS q FROM p)
SELECT page_id, CASE WHEN regexp_matches(q, 'test/|tests/|spec/|__tests__/|__mocks__/|\.test\.|\.spec\.|mock|fixture') THEN 'test' WHEN regexp_matches(q, 'vendor/|node_modules/|third_party/|third-party/|dist/|build/') THEN 'vendor'
WHEN regexp_matches(q, 'src/|lib/|app/|backend/|server/') OR NOT contains(trim(q, '/'), '/') THEN 'production' ELSE 'unknown' END AS category,
regexp_matches(path, '(?i)[._-](test|spec)\.[a-zA-Z0-9]+$') OR regexp_matches(path, '(?i)(^|/)(__tests__|__mocks__|test|tests)/') AS is_test FROM l""")
def context_classify(spark, sf_dir):
    """Context of a path, and test paths: the addresses of all pages below several folders."""
    folder = _nth(["src/", "lib/tests/", "vendor/", "x/", "app/", "docs/node_modules/", ""], F.col("page_id"))
    path = F.concat(folder, F.lit("p"), F.col("page_id").cast("string"), F.regexp_replace("url", "^https?://[^/]+", ""), F.lit(".js"))
    return table(spark, sf_dir, "pages").select("page_id", C.context_category(path).alias("category"), C.is_test_path(path).alias("is_test"))


@query("""WITH c AS (SELECT p_partkey, p_size * 12 AS size, p_partkey % 5 AS kind, ['production', 'test', 'vendor'][p_size % 3 + 1] AS context FROM part),
l AS (SELECT *, CASE kind WHEN 0 THEN CASE WHEN size >= 256 THEN 5 WHEN size >= 192 THEN 3 WHEN size >= 128 THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN size >= 512 THEN 5 WHEN size >= 384 THEN 4 WHEN size >= 256 THEN 3 WHEN size >= 160 THEN 1 ELSE 0 END
    WHEN 2 THEN 0 ELSE 5 END AS level FROM c)
SELECT p_partkey, level, CASE WHEN kind = 4 THEN 'NONE' WHEN level = 0 AND kind = 2 AND context = 'production' THEN 'CRITICAL' WHEN level = 0 THEN 'HIGH' WHEN level <= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM l""")
def quantum_risk(spark, sf_dir):
    """Security level and quantum risk of families, sizes and contexts."""
    p = F.col("p_partkey")
    family, primitive = _nth(["AES", "SHA-2", "RSA", "bcrypt", "CSPRNG"], p), _nth(["block-cipher", "hash", "signature", "kdf", "drbg"], p)
    asset, material, context = F.lit("algorithm"), F.lit(None).cast("string"), _nth(["production", "test", "vendor"], F.col("p_size"))
    rows = table(spark, sf_dir, "part").withColumn("level", C.nist_level(asset, primitive, material, family, F.concat((F.col("p_size") * 12).cast("string"), F.lit(" bits"))))
    risk = C.quantum_risk(F.col("level"), C.data_sensitivity(context, asset, primitive), C.is_unaffected(asset, primitive, material, F.upper(family)))
    return rows.select("p_partkey", "level", risk.alias("risk"))


_SCORE_SQL = """WITH e AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN r END) AS d, max(CASE WHEN event_type = 'signup' THEN r END) AS s,
    max(CASE WHEN event_type = 'click' AND user_id % 3 = 0 THEN r END) AS i FROM (SELECT *, floor(value) / 500 AS r FROM events) GROUP BY user_id),
b AS (SELECT user_id, CASE WHEN d IS NOT NULL AND s IS NOT NULL THEN least(0.99::DOUBLE, floor((d + 0.04::DOUBLE) * 100 + 0.5) / 100) WHEN d IS NOT NULL THEN d
    WHEN s IS NOT NULL AND i IS NOT NULL THEN least(0.85::DOUBLE, (s + i) / 2) WHEN i IS NOT NULL THEN i * 0.6::DOUBLE WHEN s IS NOT NULL THEN s ELSE 0 END AS b FROM e),
c AS (SELECT user_id, floor(b * CASE user_id % 4 WHEN 0 THEN 1::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE 0.7::DOUBLE END * 1000 + 0.5) / 1000 AS score FROM b) """


def _scores(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("r", F.floor("value") / 500.0)
    best = rows.groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "purchase", F.col("r"))).alias("d"), F.max(F.when(F.col("event_type") == "signup", F.col("r"))).alias("s"),
        F.max(F.when((F.col("event_type") == "click") & (F.col("user_id") % 3 == 0), F.col("r"))).alias("i"),
    )
    context = _nth(["production", "test", "vendor", "unknown"], F.col("user_id"))
    return best.select("user_id", C.score(F.col("d"), F.col("s"), F.col("i"), context).alias("score"))


@query(_SCORE_SQL + "SELECT * FROM c")
def evidence_score(spark, sf_dir):
    """Confidence from the best evidence of each class."""
    return _scores(spark, sf_dir)


@query(_SCORE_SQL + """, t AS (SELECT CASE WHEN score >= 0.85 THEN 'very-high' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS value FROM c)
SELECT value, (SELECT count(*) FROM t WHERE t.value = d.value) AS n FROM (VALUES ('very-high'), ('high'), ('medium'), ('low')) d(value)""")
def confidence_tier(spark, sf_dir):
    """Counts of all confidence tiers, zeros included."""
    return views.histogram(_scores(spark, sf_dir).withColumn("tier", C.confidence_tier(F.col("score"))), "tier", rules.CONFIDENCE_TIERS)


_FINDINGS_SQL = """WITH f AS (SELECT doc_id, ['algorithm', 'certificate', 'related-crypto-material', 'gadget'][doc_id % 4 + 1] AS assetType,
    CASE WHEN doc_id % 3 = 0 THEN ['hash', 'mac', 'xor'][doc_id % 9 // 3 + 1] END AS primitive, CASE WHEN doc_id % 5 = 0 THEN 'salt' END AS materialType,
    ['production', 'test', 'elsewhere'][doc_id % 7 % 3 + 1] AS contextCategory, 'live' AS sourceContext, CASE WHEN doc_id % 2 = 0 THEN ['AES', 'SHA-256'][doc_id % 6 // 3 + 1] END AS algorithmFamily FROM documents) """


def _checked(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", d.cast("string").alias("findingId"), _nth(["algorithm", "certificate", "related-crypto-material", "gadget"], d).alias("assetType"),
        F.when(d % 3 == 0, _nth(["hash", "mac", "xor"], F.floor(d % 9 / 3))).alias("primitive"), F.when(d % 5 == 0, "salt").alias("materialType"),
        _nth(["production", "test", "elsewhere"], d % 7).alias("contextCategory"), F.lit("live").alias("sourceContext"), F.when(d % 2 == 0, _nth(["AES", "SHA-256"], F.floor(d % 6 / 3))).alias("algorithmFamily"),
    )
    return assess.issues(rows)


@query(_FINDINGS_SQL + """, i AS (SELECT doc_id, (assetType NOT IN ('algorithm', 'certificate', 'related-crypto-material'))::INT + coalesce((primitive = 'xor')::INT, 0) + (contextCategory = 'elsewhere')::INT
    + (assetType IN ('certificate', 'related-crypto-material') AND primitive IS NOT NULL)::INT + (assetType = 'algorithm' AND materialType IS NOT NULL)::INT AS errors,
    (assetType IN ('algorithm', 'gadget') AND coalesce(algorithmFamily = 'SHA-256', false))::INT AS warnings FROM f)
SELECT doc_id, errors = 0 AS clean, errors::BIGINT AS errors, warnings::BIGINT AS warnings FROM i""")
def validate_split(spark, sf_dir):
    """Findings with errors and warnings (C14)."""
    count = lambda level: F.size(F.filter("issues", lambda i: i["level"] == level)).cast("long").alias(f"{level}s")
    return _checked(spark, sf_dir).select("doc_id", assess.is_clean().alias("clean"), count("error"), count("warning"))


_RISKS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE"]


def _correlated(spark, sf_dir):
    p = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", _nth(_RISKS, p).alias("quantumRisk"), _nth(_RISKS, F.floor(p / 5)).alias("exposureRisk"), _nth(["hash", "mac", "block-cipher", "kdf", "drbg", None], p).alias("primitive"),
        F.when(p % 3 == 0, F.struct(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("name"), F.lit("1").alias("version"), F.concat(F.lit("pkg:npm/p"), F.col("o_custkey").cast("string")).alias("purl"))).alias("packageContext"),
    )


@query("SELECT " + ", ".join(f"count(*) FILTER (o_orderkey % 5 = {i}) AS quantum{r.title()}, count(*) FILTER ((o_orderkey // 5) % 5 = {i}) AS exposure{r.title()}" for i, r in enumerate(_RISKS)) + ", count(*) FILTER (o_orderkey % 3 = 0) AS attributed, count(*) FILTER (o_orderkey % 3 <> 0) AS firstParty FROM orders")
def combined_summary(spark, sf_dir):
    """Counts of findings by both risks and by attribution (A3)."""
    return relate.combined_summary(_correlated(spark, sf_dir))


@query("SELECT ['hash', 'mac', 'block-cipher', 'kdf', 'drbg'][o_orderkey % 6 + 1] AS primitive, count(*) AS n FROM orders WHERE o_orderkey % 6 < 5 GROUP BY 1")
def primitive_histogram(spark, sf_dir):
    """Findings by primitive, those without one left out (A3)."""
    return relate.by_primitive(_correlated(spark, sf_dir))


@query("SELECT value, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = i) AS n FROM (VALUES ('CRITICAL', 0), ('HIGH', 1), ('MEDIUM', 2), ('LOW', 3), ('NONE', 4), ('ODD', 9)) d(value, i)")
def zero_filled_histogram(spark, sf_dir):
    """Counts for a whole closed domain (A5)."""
    return views.histogram(_correlated(spark, sf_dir), "quantumRisk", [*_RISKS, "ODD"])


@query("""WITH n AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1) SELECT value, n, n / greatest(1, (SELECT max(n) FROM n))::DOUBLE AS share FROM n""")
def bar_shares(spark, sf_dir):
    """Counts against the largest."""
    return views.bar_shares(table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n")))


@query("""WITH severe AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 = 0 AND (o_orderkey % 5 < 2 OR (o_orderkey // 5) % 5 < 2))
SELECT 'p' || c_custkey AS name, '1' AS version, 'pkg:npm/p' || c_custkey AS purl FROM customer JOIN severe ON c_custkey = o_custkey WHERE c_nationkey % 2 = 0""")
def compounding_risk(spark, sf_dir):
    """Packages with a vulnerability and a severe finding."""
    key = F.col("c_custkey").cast("string")
    packages = table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), key).alias("name"), F.lit("1").alias("version"), F.concat(F.lit("pkg:npm/p"), key).alias("purl"), F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("CVE"))).otherwise(F.array().cast("array<string>")).alias("osvCves"))
    return relate.compounding(_correlated(spark, sf_dir), packages).select("name", "version", "purl")


@query("""WITH f AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages), p AS (SELECT host, min(page_id) AS first FROM f GROUP BY host)
SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN host END AS package, CASE WHEN page_id % 4 <> 0 THEN 'v' || first END AS version FROM f JOIN p USING (host)""")
def package_attribution(spark, sf_dir):
    """The owning package of a path, at its first version."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    packages = rows.select(F.col("host").alias("name"), F.concat(F.lit("v"), F.col("page_id").cast("string")).alias("version"), F.lit("").alias("purl"), F.col("page_id").alias("seq"))
    findings = rows.withColumn("filePath", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("src/"), F.col("host"))).otherwise(F.concat(F.lit("a/node_modules/x/node_modules/"), F.col("host"), F.lit("/lib/i.js"))))
    return relate.attribute(findings, packages).select("page_id", F.col("packageContext.name").alias("package"), F.col("packageContext.version").alias("version"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_direct_lines(spark, sf_dir):
    """Rows whose place has no direct evidence."""
    evidence = F.array(F.struct(F.when(F.col("l_returnflag") == "R", "direct").otherwise("supporting").alias("evidenceClass")))
    at = lambda c: (F.lit("f").alias("filePath"), F.col(c).alias("line"))
    findings = table(spark, sf_dir, "lineitem").select(*at("l_orderkey"), evidence.alias("evidence"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", *at("o_orderkey"))
    return scan.without_direct(rows, findings, []).select("o_orderkey", "o_orderpriority")


def _evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("line", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    e = F.struct(F.col("event_type").alias("source"), F.lit("direct").alias("evidenceClass"), F.lit("").alias("detail"), (F.col("value") / 500).alias("rawConfidence"), F.col("user_id").cast("string").alias("filePath"), (F.col("line") * 2).cast("int").alias("line"))
    return rows.select(
        F.col("event_id").alias("seq"), F.lit("algorithm").alias("assetType"), F.lit("unknown").alias("name"), F.col("user_id").cast("string").alias("filePath"), (F.col("line") * 2).cast("int").alias("line"),
        *[F.lit(None).cast("string").alias(c) for c in ("primitive", "parameterSet", "mode", "materialType", "fingerprint")], F.when(F.col("value") > 50, "AES").otherwise("RSA").alias("algorithmFamily"), F.array(e).alias("evidence"),
    )


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, CASE WHEN value > 50 THEN 'AES' ELSE 'RSA' END AS family FROM events),
f AS (SELECT *, coalesce(lag(family) OVER u = family AND lag(event_type) OVER u <> event_type, false) AS fits FROM r WINDOW u AS (PARTITION BY user_id ORDER BY place)),
c AS (SELECT *, count(*) FILTER (NOT fits) OVER (PARTITION BY user_id ORDER BY place) AS chain FROM f),
k AS (SELECT *, (row_number() OVER (PARTITION BY user_id, chain ORDER BY place) - 1) // 2 AS pair FROM c)
SELECT min(event_id) AS seq, CAST(user_id AS VARCHAR) AS filePath, CAST(2 * min(place) AS INTEGER) AS line, min(family) AS algorithmFamily, CAST(count(*) AS INTEGER) AS n_evidence FROM k GROUP BY user_id, chain, pair""")
def evidence_merge(spark, sf_dir):
    """The greedy merge of neighbouring evidence (J13, C11, F25, F26): of events that follow each other and fit, the second goes to the first; the third fits what has gone no more."""
    merged = assess.merge_evidence(_evidence(spark, sf_dir))
    return merged.select("seq", "filePath", "line", "algorithmFamily", F.size("evidence").alias("n_evidence"))


@query("""WITH r AS (SELECT *, 2 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, CASE WHEN value > 50 THEN 'AES' ELSE 'RSA' END AS family FROM events)
SELECT a.user_id, count(*) AS pairs FROM r a JOIN r b ON a.user_id = b.user_id AND b.line > a.line AND b.line - a.line <= 2 AND a.event_type <> b.event_type AND a.family = b.family GROUP BY a.user_id""")
def evidence_band_pairs(spark, sf_dir):
    """Pairs of evidence that could merge: a band join, by buckets of lines."""
    rows = _evidence(spark, sf_dir).select("filePath", "line", "algorithmFamily", F.col("evidence")[0]["source"].alias("source"))
    left = rows.withColumn("band", F.explode(F.array(F.floor(F.col("line") / 2), F.floor(F.col("line") / 2) + 1)))
    right = rows.select("filePath", F.col("line").alias("other"), F.col("algorithmFamily").alias("family"), F.col("source").alias("from"), F.floor(F.col("line") / 2).alias("band"))
    near = left.join(right, ["filePath", "band"]).where("other > line AND other - line <= 2 AND source <> from AND algorithmFamily = family")
    return near.groupBy(F.col("filePath").cast("long").alias("user_id")).agg(F.count("*").alias("pairs"))


@query("""SELECT p_partkey, CASE WHEN kind IN (0, 1) THEN 'kdf' WHEN kind = 3 THEN 'hash' END AS primitive, CASE WHEN kind IN (0, 1) THEN 'bcrypt' WHEN kind = 3 THEN 'MD5' END AS family,
CASE WHEN kind IN (0, 3) THEN CASE WHEN p_size % 2 = 0 THEN 0.85 ELSE 0.6 END WHEN kind = 1 THEN CASE WHEN p_size % 2 = 0 THEN 0.65 ELSE 0.4 END END::DOUBLE AS confidence FROM (SELECT *, p_partkey % 5 AS kind FROM part)""")
def sca_priority_lookup(spark, sf_dir):
    """What is known of a package, by name, name without scope, or stem; and how sure that makes us; scopes and other names are the parts' words."""
    word = lambda i: F.split("p_name", " ")[i]
    names = [F.lit("bcrypt"), F.concat(F.lit("@"), word(0), F.lit("/bcrypt")), F.concat(word(0), F.lit("-"), word(1)), F.lit("MD5"), F.lit("uuid")]
    rows = table(spark, sf_dir, "part").withColumn("info", scan.library_info(F.element_at(F.array(*names), (F.col("p_partkey") % 5 + 1).cast("int"))))
    sure = F.when(F.col("info").isNotNull(), scan.sca_confidence(F.col("info.exact"), F.col("p_size") % 2 == 0, F.lit(False), F.lit(False)))
    return rows.select("p_partkey", "info.primitive", F.split("info.families", ", ")[0].alias("family"), sure.alias("confidence"))


@query("""WITH name AS (SELECT unnest(['jose', 'bcrypt', '@noble/hashes', 'node-rsa', 'md5', 'elliptic']) AS name, unnest([0, 1, 2, 3, 4, 5]) AS i, unnest(['jose', 'bcrypt', 'hashes', 'node-rsa', 'md5', 'elliptic']) AS bare,
    unnest([['JWT', 'JWE', 'JWS', 'AES', 'RSA', 'ECDSA', 'EdDSA'], ['bcrypt'], ['SHA-2', 'SHA-3', 'BLAKE2', 'BLAKE3', 'HMAC', 'PBKDF2', 'scrypt', 'HKDF'], ['RSA'], ['MD5'], ['ECDSA', 'ECDH', 'EdDSA']]) AS families),
package AS (SELECT s_suppkey, s_suppkey % 200 AS scan, name, bare, families, s_acctbal > 0 AS direct FROM supplier JOIN name ON i = s_suppkey % 6),
finding AS (SELECT c_custkey % 200 AS scan, CASE c_custkey % 11 WHEN 0 THEN 'AES' WHEN 1 THEN 'MD5' END AS family, c_mktsegment || ' ' || ['a.bcryptSync', 'jose.SignJWT', 'x', 'y', 'thenoble/hashes', 'z', 'w'][c_custkey % 7 + 1] AS detail FROM customer)
SELECT DISTINCT scan::BIGINT AS scan, name, EXISTS (SELECT 1 FROM finding f WHERE f.scan = p.scan AND (list_contains(families, f.family) OR contains(f.detail, bare))) AS agreed FROM package p""")
def semi_corroboration(spark, sf_dir):
    """Known packages that a finding of their scan agrees with: by family, or where the detail of its evidence contains the name."""
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    names = _nth(["jose", "bcrypt", "@noble/hashes", "node-rsa", "md5", "elliptic"], F.col("s_suppkey"))
    bom = supplier.select((F.col("s_suppkey") % 200).cast("long").alias("scan"), names.alias("name"), F.lit("1").alias("version"), (F.col("s_acctbal") > 0).alias("isDirect"), F.lit(False).alias("devDependency")).distinct()
    c = F.col("c_custkey")
    detail = F.concat("c_mktsegment", F.lit(" "), _nth(["a.bcryptSync", "jose.SignJWT", "x", "y", "thenoble/hashes", "z", "w"], c))
    evidence = F.array(F.struct(detail.alias("detail")))
    code = customer.select((c % 200).cast("long").alias("scan"), F.when(c % 11 == 0, "AES").when(c % 11 == 1, "MD5").alias("algorithmFamily"), evidence.alias("evidence"))
    found = scan.packages(bom, code).select("scan", F.regexp_extract("filePath", "node_modules/(.*)/package.json", 1).alias("name"), F.col("evidence")[0]["rawConfidence"].alias("sure"))
    # exact names are sure to 0.60, direct ones to 0.85; an agreement makes these 0.80 and 0.98, whether a scan has a package as one, the other or both
    agreed = F.col("sure").between(0.79, 0.81) | (F.col("sure") > 0.86)
    return found.select("scan", "name", agreed.alias("agreed")).distinct()


@query(_FINDINGS_SQL + "SELECT doc_id, assetType, title FROM (SELECT *, list_aggregate(list_transform(string_split(assetType, '-'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS title FROM f)")
def type_labels(spark, sf_dir):
    """Types in words."""
    kind = _nth(["algorithm", "certificate", "related-crypto-material", "gadget"], F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("assetType"), views.type_label(kind).alias("title"))


@query("SELECT event_id, value FROM events WHERE event_type <> 'purchase' ORDER BY value DESC, event_id LIMIT 50")
def cap_topn(spark, sf_dir):
    """The first 50 for a costly step (L1)."""
    return relate.capped(table(spark, sf_dir, "events").where("event_type <> 'purchase'").select("event_id", "value"), [F.desc("value"), F.asc("event_id")])


@query("""SELECT id, CAST(rank AS INTEGER) AS rank, entry, floor(score * 1e6 + 0.5) / 1e6 AS score FROM (SELECT q.vec_id AS id, c.vec_id AS entry, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS rank FROM embeddings q, embeddings c
WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) >= 0.2) WHERE rank <= 3""")
def cosine_topk(spark, sf_dir):
    """The three most similar of all other entries for each query row (J16, L2, F36, C16); the query set is every fiftieth row."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    corpus = rows.select(F.col("vec_id").alias("entry"), F.col("embedding").alias("w"))
    return relate.nearest(queries, corpus, 3, 0.2, others=True).select("id", "rank", "entry", C.half_up(F.col("score"), 6).alias("score"))


def _answer():
    """What a model said of a turn: an answer that quotes it, the turn itself, nothing found, or a family that is not known."""
    n = F.col("conv_id") + F.col("turn")
    confidence = (F.lit(1) + F.col("turn") % 9) / 10
    answer = lambda family: F.to_json(F.struct(family.alias("algorithmFamily"), confidence.alias("confidence"), F.col("text").alias("reasoning")), {"ignoreNullFields": "false"})
    nothing = F.to_json(F.struct(F.lit(None).cast("string").alias("algorithmFamily"), confidence.alias("confidence")), {"ignoreNullFields": "false"})
    unknown = F.to_json(F.struct(F.lit("homebrew").alias("algorithmFamily"), confidence.alias("confidence")))
    fenced = F.concat(F.lit("```json\n"), answer(F.lit("aes-gcm")), F.lit("\n```"))
    return F.when(n % 4 == 0, F.when(n % 8 == 0, fenced).otherwise(answer(F.lit("ChaCha20")))).when(n % 4 == 1, F.translate("text", "{}", "")).when(n % 4 == 2, nothing).otherwise(unknown)


def _verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("v", relate.verdict(relate.response(_answer())))
    return rows.select("conv_id", "turn", "v.outcome", "v.family", F.col("v.confidence").alias("confidence"))


_OUTCOME_SQL = """WITH o AS (SELECT conv_id, turn, ['ok', 'failed', 'no_crypto', 'schema_mismatch'][(conv_id + turn) % 4 + 1] AS outcome, CASE WHEN (conv_id + turn) % 8 = 0 THEN 'AES' WHEN (conv_id + turn) % 4 = 0 THEN 'ChaCha20' END AS family,
    CASE WHEN (conv_id + turn) % 4 = 1 THEN 0 ELSE (1 + turn % 9) / 10 END::DOUBLE AS confidence FROM conversations) """


@query(_OUTCOME_SQL + "SELECT * FROM o")
def llm_verdicts(spark, sf_dir):
    """Recorded answers that quote every turn, read and checked."""
    return _verdicts(spark, sf_dir)


@query(_OUTCOME_SQL + "SELECT count(*) AS attempted, count(*) FILTER (outcome IN ('ok', 'no_crypto')) AS succeeded, count(*) FILTER (outcome IN ('failed', 'schema_mismatch')) AS failed, count(*) FILTER (outcome = 'no_crypto') AS noCrypto FROM o")
def llm_outcome_counts(spark, sf_dir):
    """Outcomes of verification, counted."""
    return relate.outcome_counts(_verdicts(spark, sf_dir))


@query("""SELECT detector, count(*) AS n, min(event_id) AS first FROM (SELECT 1 AS detector, event_id FROM events WHERE event_type = 'click' UNION ALL SELECT 2, event_id FROM events WHERE event_type = 'view'
UNION ALL SELECT 3, event_id FROM events WHERE event_type IN ('view', 'error')) GROUP BY detector""")
def detector_union(spark, sf_dir):
    """Outputs of detectors in their fixed order."""
    rows = table(spark, sf_dir, "events")
    parts = [rows.where(F.col("event_type").isin(*kinds)).select("event_id") for kinds in (["click"], ["view"], ["view", "error"])]
    return scan.in_order(*parts).groupBy("detector").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("SELECT n_nationkey::BIGINT AS scan, 'c' || c_custkey AS ref FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT s_nationkey::BIGINT, 's' || s_suppkey FROM supplier")
def merged_documents(spark, sf_dir):
    """Components of two documents of each scan."""
    parsed = lambda t, p: table(spark, sf_dir, t).groupBy(F.col(f"{p}_nationkey").cast("long").alias("scan")).agg(F.collect_list(F.struct(F.concat(F.lit(p), F.col(f"{p}_{'cust' if p == 'c' else 'supp'}key").cast("string")).alias("ref"))).alias("components"))
    return relate.merge_documents(parsed("customer", "c"), parsed("supplier", "s")).select("scan", "c.ref")


@query("""SELECT p_partkey, 'crypto/algorithm/' || trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '-') || '@' ||
CASE WHEN p_partkey % 2 = 0 THEN 'src-' || p_partkey || '-js-L' || p_size ELSE substr(sha1(CAST(p_partkey AS VARCHAR)), 1, 8) END AS ref FROM part""")
def bom_ref_slug(spark, sf_dir):
    """References of findings."""
    key = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("src/"), key, F.lit(".js")))
    name = F.concat("p_name", F.lit(" ("), F.col("p_brand"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", C.bom_ref(F.lit("algorithm"), name, path, F.col("p_size"), key).alias("ref"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'low' ELSE ['critical', 'high', 'medium', 'low'][event_id % 4 + 1] END AS severity, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def property_bag(spark, sf_dir):
    """Properties read back from their text."""
    word = F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise(_nth(rules.SEVERITIES, F.col("event_id")))
    bag = F.create_map(F.lit("anomaly"), F.concat(word, F.lit(" — some reason")), F.lit("props"), F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", C.normalised_severity(F.element_at(bag, F.lit("anomaly"))).alias("severity"), F.get_json_object(F.element_at(bag, F.lit("props")), "$.k").cast("long").alias("k"))


def _assets(spark, sf_dir):
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(_nth(["AES", "ECDSA", "RSA", "MD5", "SHA1", "DES"], p), F.lit(" "), F.col("p_brand")).alias("name"), F.lit("algorithm").alias("assetType"), F.lit(None).cast("string").alias("parameterSet"),
        F.col("p_brand").alias("filePath"), F.col("p_size").alias("line"), (p % 6).cast("int").alias("nistQuantumLevel"), F.when(p % 11 == 0, "CRITICAL").otherwise("NONE").alias("exposureRisk"), (F.col("p_size") / 50.0).alias("confidence"),
    )


_ASSETS_SQL = """WITH a AS (SELECT p_partkey, ['AES', 'ECDSA', 'RSA', 'MD5', 'SHA1', 'DES'][p_partkey % 6 + 1] || ' ' || p_brand AS name, p_partkey % 6 AS level, p_partkey % 11 = 0 AS exposed, p_size / 50.0::DOUBLE AS conf FROM part) """


@query(_ASSETS_SQL + "SELECT p_partkey, name, 'low' AS tier FROM a WHERE conf < 0.3 AND contains(lower(name), 'rsa')")
def asset_view(spark, sf_dir):
    """The filtered and sorted table of assets."""
    return views.asset_view(_assets(spark, sf_dir), search="rsa", tier="low", sort="level").select("p_partkey", "name", "tier")


@query(_ASSETS_SQL + """, t AS (SELECT name, unnest([CASE WHEN exposed THEN '1exposed-secrets' END, CASE WHEN level = 0 THEN '2post-quantum' END, CASE WHEN contains(upper(name), 'MD5') OR contains(upper(name), 'SHA1') THEN '3weak-digests' END,
CASE WHEN level = 1 THEN '4short-keys' END, CASE WHEN conf < 0.3 THEN '5low-confidence' END]) AS t FROM a)
SELECT CAST(t[1] AS INTEGER) AS position, t[2:] AS id, count(*) AS affected, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM t WHERE t IS NOT NULL GROUP BY t""")
def remediation_checklist(spark, sf_dir):
    """What to do, in up to five tasks."""
    return views.checklist(_assets(spark, sf_dir)).select("position", "id", "affected", "names")


@query(_ASSETS_SQL + """SELECT p_partkey, CASE WHEN exposed THEN 'exposed secret' WHEN level = 0 AND contains(upper(name), 'EC') THEN 'elliptic curve' WHEN level = 0 AND contains(upper(name), 'RSA') THEN 'factoring' WHEN level = 0 THEN 'classical asymmetric'
WHEN contains(upper(name), 'MD5') OR contains(upper(name), 'SHA1') THEN 'weak digest' WHEN level = 1 THEN 'short key' WHEN level >= 3 THEN 'resistant' ELSE 'good practice' END AS topic FROM a""")
def remediation_advice(spark, sf_dir):
    """Advice for each asset."""
    a = C.F.col
    return _assets(spark, sf_dir).select("p_partkey", views.advice(a("name"), a("nistQuantumLevel"), a("exposureRisk"), a("parameterSet"), a("assetType"))["topic"].alias("topic"))


@query("SELECT o_orderkey FROM orders WHERE date_diff('day', TIMESTAMP '1998-01-01', o_orderdate) BETWEEN 0 AND 90")
def expiring_window(spark, sf_dir):
    """What ends within 90 days."""
    return table(spark, sf_dir, "orders").where(C.expires_soon(F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp"))).select("o_orderkey")


@query("SELECT CASE WHEN p_size % 7 <= 0 THEN 'vulnerable' WHEN p_size % 7 <= 2 THEN 'weak' WHEN p_size % 7 <= 5 THEN 'safe' ELSE 'unknown' END AS tier, count(*) AS n FROM part GROUP BY 1")
def quantum_tier(spark, sf_dir):
    """Tiers of security levels."""
    return table(spark, sf_dir, "part").groupBy(C.quantum_tier(F.col("p_size") % 7).alias("tier")).agg(F.count("*").alias("n"))


@query("""WITH cose(number, family, parameter) AS (VALUES (-7, 'ECDSA', 'P-256 / ES256'), (-8, 'EdDSA', 'EdDSA'), (-37, 'RSA-PSS', 'PS256'), (-35, 'ECDSA', 'P-384 / ES384'), (-36, 'ECDSA', 'P-521 / ES512'), (-47, 'ECDSA', 'secp256k1 / ES256K'))
SELECT p_partkey, -p_size AS number, family, parameter FROM part LEFT JOIN cose ON number = -p_size""")
def cose_lookup(spark, sf_dir):
    """COSE numbers, for every size as a number."""
    number = -F.col("p_size")
    cose = scan.cose_column(number)
    return table(spark, sf_dir, "part").select("p_partkey", number.alias("number"), cose["family"].alias("family"), cose["parameter"].alias("parameter"))


@query("""SELECT page_id, regexp_replace(url, '^https?://[^/]+/?', '') || CASE WHEN page_id > 0 THEN '#L' || page_id ELSE '' END AS tail FROM pages""")
def file_links(spark, sf_dir):
    """Links to a line of a file."""
    path = F.regexp_replace("url", "^https?://[^/]+/?", "")
    link = views.file_link(F.lit("https://github.com/a/b.git"), path, F.col("page_id"))
    return table(spark, sf_dir, "pages").where(path != "").select("page_id", F.replace(link, F.lit("https://github.com/a/b/blob/HEAD/"), F.lit("")).alias("tail"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'https://github.com/advisories/GHSA-' || s_suppkey ELSE 'https://osv.dev/vulnerability/CVE-' || s_suppkey END AS link FROM supplier")
def issue_links(spark, sf_dir):
    """Links to advisories."""
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "GHSA-").otherwise("CVE-"), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", views.issue_link(name).alias("link"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
t AS (SELECT doc_id, min(line) AS place FROM l WHERE contains(content, 'icense') GROUP BY doc_id)
SELECT t.doc_id, place AS line, string_agg(content, chr(10) ORDER BY l.line) AS text FROM t JOIN l ON l.doc_id = t.doc_id AND l.line BETWEEN place - 2 AND place + 1 GROUP BY t.doc_id, place""")
def fixed_span(spark, sf_dir):
    """The lines around a place."""
    lines = scan.text_lines(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "path"), F.col("text"))
    at = lines.where(F.contains("content", F.lit("icense"))).groupBy("path").agg(F.min("line").alias("line"))
    return relate.fixed_span(lines, at, back=2, ahead=2).select(F.col("path").alias("doc_id"), F.col("line").cast("long").alias("line"), "text")


@query(r"""WITH s AS (SELECT page_id, regexp_extract(html, '<script>(.*?)</script>', 1) AS code FROM pages)
SELECT 'track' AS method, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(code, 'track\(')) FROM s)""")
def code_calls(spark, sf_dir):
    """Calls in the scripts of pages, by the lexer."""
    files = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.regexp_extract("html", "<script>(.*?)</script>", 1).cast("binary").alias("content"))
    rows = calls.code_facts(files).where("kind = 'call'")
    return rows.groupBy(F.col("b").alias("method")).agg(F.count("*").alias("n"), F.count_distinct("path").alias("pages"))


@query("""WITH c AS (SELECT p_partkey, p_partkey % 4 AS kind, [128, 192, 256][p_size % 3 + 1] AS bits, ['gcm', 'cbc', 'ctr'][p_partkey % 3 + 1] AS mode, [256, 384, 512][p_size % 3 + 1] AS digest, p_size FROM part)
SELECT p_partkey, CASE kind WHEN 0 THEN 'AES' WHEN 1 THEN 'SHA-' || digest WHEN 2 THEN 'CSPRNG' END AS family, CASE kind WHEN 0 THEN bits::VARCHAR WHEN 2 THEN (p_size * 8) || ' bits' END AS parameter, CASE kind WHEN 0 THEN upper(mode) END AS mode FROM c WHERE kind < 3""")
def call_rules(spark, sf_dir):
    """Calls resolved to modules and turned into findings: sizes, modes and digests of every part."""
    p, size = F.col("p_partkey"), F.col("p_size")
    said = [
        F.concat(F.lit("c.createCipheriv('aes-"), _nth([128, 192, 256], size), F.lit("-"), _nth(["gcm", "cbc", "ctr"], p), F.lit("', k, iv)")), F.concat(F.lit("c.createHash('sha"), _nth([256, 384, 512], size), F.lit("')")),
        F.concat(F.lit("c.randomBytes("), size.cast("string"), F.lit(")")), F.concat(F.split("p_name", " ")[0], F.lit("(x)")),
    ]
    code = F.concat(F.lit("const c = require('crypto');\n// "), F.col("p_name"), F.lit("\n"), F.element_at(F.array(*said), (p % 4 + 1).cast("int")))
    part = table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # a few MB of rows make much code: they are dealt before
    files = part.select(p.cast("string").alias("path"), code.cast("binary").alias("content"))
    return calls.findings(files).select(F.col("filePath").cast("long").alias("p_partkey"), F.col("algorithmFamily").alias("family"), F.col("parameterSet").alias("parameter"), "mode")


_COMMENTS = ["old: bcrypt.genSalt(10) then bcrypt.hash(p)", "bcrypt.compare(a, b)", "x = pbkdf2Sync(p)", "nothing", "jwt.verify(t); randomBytes(16)"]


@query("WITH " + _LINES_SQL.format(code=_list(_COMMENTS), n=len(_COMMENTS)) + r""" , f AS (
    SELECT doc_id, line, 'bcrypt' AS family, CASE WHEN regexp_matches(content, 'bcrypt\\w*\\.hash') AND NOT regexp_matches(content, 'bcrypt\\w*\\.(genSalt|compare)') THEN 'kdf' END AS primitive, NULL AS parameter, CASE WHEN regexp_matches(content, 'bcrypt\\w*\\.genSalt') THEN 'salt' END AS material
    FROM lines WHERE regexp_matches(content, 'bcrypt\\w*\\.(genSalt|compare|hash)(Sync)?\\(')
    UNION ALL SELECT doc_id, line, 'PBKDF2', 'kdf', 'sha512', NULL FROM lines WHERE regexp_matches(content, 'pbkdf2(Sync)?\\(')
    UNION ALL SELECT doc_id, line, 'CSPRNG', 'drbg', '128 bits', NULL FROM lines WHERE contains(content, 'randomBytes(')
    UNION ALL SELECT doc_id, line, 'HMAC', 'signature', 'HS256', NULL FROM lines WHERE contains(content, 'jwt.verify(')
) SELECT * FROM f""".replace("\\\\", "\\"))
def comment_rules(spark, sf_dir):
    """Commented-out calls on every line of the documents: of each topic the first rule."""
    rows = calls.comment_hits(_code_lines(spark, sf_dir, _COMMENTS), "content")
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), *[F.col(f"hit.{c}").alias(c) for c in ("family", "primitive", "parameter", "material")])


@query(r"""SELECT page_id, regexp_full_match(u, 'https?://(www\.)?github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+?(\.git)?/?') AS is_repository
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://[^/]+', 'https://github.com/owner') ELSE url END AS u FROM pages)""")
def repository_urls(spark, sf_dir):
    """Which addresses are repositories: those of all pages, half of them moved to the hosting site."""
    url = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://[^/]+", "https://github.com/owner")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", C.is_repository(url).alias("is_repository"))


@query("""SELECT n_nationkey::BIGINT AS scan, name FROM nation JOIN (SELECT s_nationkey AS k, 's' || (s_suppkey % 40) AS name FROM supplier UNION SELECT c_nationkey, 's' || (c_custkey % 60) FROM customer) ON k = n_nationkey""")
def name_union(spark, sf_dir):
    """Names that the manifest of each nation declares, for use and for development, each once."""
    declared = lambda t, key, n, as_: table(spark, sf_dir, t).groupBy(F.col(f"{key[0]}_nationkey").cast("long").alias("scan")).agg(F.collect_set(F.concat(F.lit("s"), (F.col(key) % n).cast("string"))).alias(as_))
    both = declared("supplier", "s_suppkey", 40, "a").join(declared("customer", "c_custkey", 60, "b"), "scan", "full")
    section = lambda names: F.map_from_arrays(F.coalesce(names, F.array().cast("array<string>")), F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.lit("^1")))
    manifests = both.select("scan", F.to_json(F.struct(F.lit("app").alias("name"), section(F.col("a")).alias("dependencies"), section(F.col("b")).alias("devDependencies"))).alias("text"))
    return repository.declared_names(manifests)


def _exported(spark, sf_dir, crypto):
    """Parts as assets and suppliers as libraries, in 50 scans."""
    assets = _assets(spark, sf_dir).select((F.col("p_partkey") % 50).alias("scan"), F.concat(F.lit("crypto/"), F.col("p_partkey").cast("string")).alias("ref"), F.lit("cryptographic-asset").alias("type"), "name", F.when(F.col("p_partkey") % 4 == 0, F.array(F.concat(F.lit("lib/"), F.col("p_partkey").cast("string")))).alias("dependsOn"))
    libraries = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).cast(assets.schema["scan"].dataType).alias("scan"), F.concat(F.lit("lib/"), F.col("s_suppkey").cast("string")).alias("ref"), F.lit("library").alias("type"), F.col("s_name").alias("name"))
    parts = assets.unionByName(libraries, allowMissingColumns=True)
    repositories = parts.select("scan").distinct().withColumn("repository", F.concat(F.lit("https://github.com/a/r"), F.col("scan").cast("string")))
    path = f"{shared_folder(spark)}/exported-{uuid.uuid4().hex}"
    documents.write(documents.export(parts, crypto, F.lit("2024-01-02").cast("timestamp"), repositories=repositories), path)
    here = F.col("scan").cast("long").alias("scan")
    head = documents.heads(spark, path).select(here, F.from_json("head", "serialNumber string, metadata struct<component struct<name string>>").alias("h"))
    e = documents.elements(spark, path).select(here, F.from_json("element", "`bom-ref` string, type string, name string, ref string, dependsOn array<string>").alias("e"))
    edges = e.where("e.ref is not null").groupBy("scan", F.col("e.ref").alias("ref")).agg(F.min(F.get("e.dependsOn", F.lit(0))).alias("depends"))
    rows = e.where("e.ref is null").select("scan", F.col("e.bom-ref").alias("ref"), "e.name").join(edges, ["scan", "ref"], "left")
    heads = head.select("scan", F.col("h.metadata.component.name").alias("repository"), F.length("h.serialNumber").cast("long").alias("serial"))
    return rows.join(heads, "scan", "left").select("scan", "repository", "serial", "ref", "name", "depends")


@query(_ASSETS_SQL + """SELECT (p_partkey % 50)::BIGINT AS scan, 'https://github.com/a/r' || (p_partkey % 50) AS repository, 45::BIGINT AS serial, 'crypto/' || p_partkey AS ref, name, CASE WHEN p_partkey % 4 = 0 THEN 'lib/' || p_partkey END AS depends FROM a""")
def export_document(spark, sf_dir):
    """The exported document of each scan's cryptographic assets, read back."""
    return _exported(spark, sf_dir, crypto=True)


@query("""SELECT (s_suppkey % 50)::BIGINT AS scan, 'https://github.com/a/r' || (s_suppkey % 50) AS repository, 45::BIGINT AS serial, 'lib/' || s_suppkey AS ref, s_name AS name, NULL::VARCHAR AS depends FROM supplier""")
def export_without_assets(spark, sf_dir):
    """The exported document without them (K4)."""
    return _exported(spark, sf_dir, crypto=False)


@query(_ASSETS_SQL + """SELECT count(*) AS totalAssets, count(*) AS typeAlgorithm, 0::BIGINT AS typeCertificate, count(*) FILTER (level = 0) AS level0, count(*) FILTER (level = 5) AS level5, count(*) FILTER (exposed) AS exposureCritical,
count(*) FILTER (NOT exposed) AS exposureNone, count(*) FILTER (conf >= 0.85) AS confidenceVeryHigh, count(*) FILTER (conf < 0.3) AS flaggedForReview, count(*) FILTER (exposed) AS exposedSecrets, count(*) AS firstPartySource FROM a""")
def asset_summary(spark, sf_dir):
    """All counts of the assets in one row, zeros included (A5)."""
    found = views.cbom_summary(_assets(spark, sf_dir), F.lit("2024-01-02").cast("timestamp"))
    return found.select("totalAssets", "typeAlgorithm", "typeCertificate", "level0", "level5", "exposureCritical", "exposureNone", "confidenceVeryHigh", "flaggedForReview", "exposedSecrets", "firstPartySource")


@query(_ASSETS_SQL + """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN level ELSE coalesce(CASE WHEN p_partkey % 3 = 0 THEN level + 10 END, level) END::INT AS level, CASE WHEN conf >= 0.85 THEN 'very-high' WHEN conf >= 0.6 THEN 'high' WHEN conf >= 0.3 THEN 'medium' ELSE 'low' END AS confidence,
CASE WHEN p_partkey % 5 = 0 THEN 'llm' ELSE 'static' END AS source FROM a""")
def flat_assets(spark, sf_dir):
    """Assets of documents as flat rows: nested fields before properties, properties before flat ones."""
    p = F.col("p_partkey")
    prop = lambda n, v, test: F.when(test, F.struct(F.lit(f"quillbom:{n}").alias("name"), v.cast("string").alias("value")))
    level = F.col("nistQuantumLevel")
    bag = F.array_compact(F.array(prop("confidence", F.col("confidence"), F.lit(True)), prop("confidence", F.lit("9"), F.lit(True)), prop("nistQuantumLevel", level + 10, p % 3 == 0), prop("evidence:llm", F.lit("x"), p % 5 == 0)))
    nested = F.when(p % 2 == 0, F.struct(F.lit("algorithm").alias("assetType"), F.struct(level.alias("nistQuantumSecurityLevel")).alias("algorithmProperties")))
    body = F.struct(F.array(F.struct(F.lit("cryptographic-asset").alias("type"), F.col("p_partkey").cast("string").alias("name"), level.alias("nistQuantumLevel"), bag.alias("properties"), nested.alias("cryptoProperties")), F.struct(F.lit("library").alias("type"), F.lit("x").alias("name"), level.alias("nistQuantumLevel"), bag.alias("properties"), nested.alias("cryptoProperties"))).alias("components"))
    assets = _assets(spark, sf_dir).select(F.inline(views.document_assets(F.to_json(body)))).drop("type")
    return views.flat_assets(assets).select(F.col("name").cast("long").alias("p_partkey"), F.col("nistQuantumLevel").alias("level"), "confidence", F.col("evidenceSources")[0].alias("source"))


@query(_ASSETS_SQL + """SELECT p_partkey, 'Level ' || level AS title FROM a""")
def level_explanations(spark, sf_dir):
    """Security levels explained."""
    return views.explained(_assets(spark, sf_dir)).select("p_partkey", F.substring_index("explanation.title", ":", 1).alias("title"))


@query("""WITH f AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0)
SELECT 'pkg:npm/p' || o_custkey AS purl, count(*) AS n, min(o_orderkey) AS first FROM f GROUP BY o_custkey""")
def findings_by_package(spark, sf_dir):
    """What each package is known to hold (A4)."""
    rows = _correlated(spark, sf_dir).select("packageContext", F.lit("").alias("filePath"), F.col("o_orderkey").alias("line"), F.lit("").alias("findingId"), F.lit("").alias("name"), F.lit("").alias("assetType"), "quantumRisk", "exposureRisk")
    return relate.findings_by_package(rows).select("purl", F.size("findings").cast("long").alias("n"), F.col("findings")[0]["line"].alias("first"))


@query("SELECT count(*) AS total, least(count(*), 50) AS taken, greatest(count(*) - 50, 0) AS skipped FROM events WHERE event_type <> 'purchase'")
def cap_skipped(spark, sf_dir):
    """How many the limit of the costly step skips (L1)."""
    return relate.skipped(table(spark, sf_dir, "events").where("event_type <> 'purchase'"))


@query("""WITH f AS (SELECT conv_id, turn, (conv_id + turn) % 3 = 0 AS direct, CASE (conv_id + turn) % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' WHEN 2 THEN 'no_crypto' ELSE 'schema_mismatch' END AS outcome FROM conversations)
SELECT count(*) AS total, count(*) FILTER (direct) AS direct, count(*) FILTER (NOT direct) AS candidates, count(*) FILTER (NOT direct) AS attempted, count(*) FILTER (NOT direct AND outcome IN ('ok', 'no_crypto')) AS succeeded,
count(*) FILTER (NOT direct AND outcome = 'no_crypto') AS noCrypto, count(*) FILTER (NOT direct AND outcome IN ('failed', 'schema_mismatch')) AS failed, count(*) FILTER (NOT direct AND outcome = 'failed') AS unreadable,
count(*) FILTER (NOT direct AND outcome = 'schema_mismatch') AS mismatched FROM f""")
def verification_pass(spark, sf_dir):
    """Findings to be verified, their recorded answers, interpretive evidence and the scan's summary, in one pass."""
    n = F.col("conv_id") + F.col("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("findingId", F.concat_ws("-", "conv_id", "turn"))
    kind = F.when(n % 3 == 0, "direct").otherwise("supporting")
    evidence = F.array(F.struct(F.lit("ast").alias("source"), kind.alias("evidenceClass"), F.substring("text", 1, 40).alias("detail"), F.lit(0.4).alias("rawConfidence"), F.lit("a.js").alias("filePath"), F.lit(1).alias("line"))).cast(f"array<{scan.EVIDENCE}>")
    findings = rows.select("findingId", F.lit("unknown").alias("name"), F.lit(None).cast("string").alias("algorithmFamily"), F.lit(None).cast("string").alias("primitive"), F.lit("a.js").alias("filePath"), F.lit(1).alias("line"), evidence.alias("evidence"))
    return relate.scan_summary(relate.verified(findings, rows.select("findingId", _answer().alias("raw"))))
