"""Package operators on the driver's tables: parts stand for packages, orders and lines for what refers to them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillbom.functions import columns as C
from quillbom.operators import documents, sbom, views
from quillbom.plans.registered import query
from quillbom.session import shared_folder, table
from quillbom.sources import repository

AS_OF = "2001-08-02"


@query("""WITH p AS (SELECT p_size::BIGINT AS scan, p_partkey, 'p' || p_partkey AS name, p_brand AS version, p_retailprice > 1500 AS dev, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice, p_partkey) AS seq FROM part)
SELECT p.scan, p.name, p.version, 'pkg:npm/' || p.name || '@' || p.version AS purl, p.dev, p.seq, coalesce(string_agg('^' || q.p_partkey, ',' ORDER BY q.seq), '') AS ranges
FROM p LEFT JOIN p q ON q.scan = p.scan AND q.p_partkey % 7 = 0 AND 'p' || (q.p_partkey % 100) = p.name GROUP BY ALL""")
def lock_components(spark, sf_dir):
    """Lockfiles of all parts, one for each size, taken apart to components with the ranges that others declare for them."""
    part = table(spark, sf_dir, "part").withColumn("scan", F.col("p_size").cast("long"))
    needs = F.when(F.col("p_partkey") % 7 == 0, F.create_map(F.concat(F.lit("p"), (F.col("p_partkey") % 100).cast("string")), F.concat(F.lit("^"), F.col("p_partkey").cast("string"))))
    value = F.to_json(F.struct(F.col("p_brand").alias("version"), F.when(F.col("p_retailprice") > 1500, F.lit(True)).alias("dev"), needs.alias("dependencies")))
    entry = F.concat(F.lit('"node_modules/p'), F.col("p_partkey").cast("string"), F.lit('":'), value)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p_retailprice", "p_partkey", entry.alias("e")))), lambda x: x["e"])
    locks = part.groupBy("scan").agg(F.concat(F.lit('{"lockfileVersion":3,"packages":{"":{"version":"1"},'), F.array_join(listed, ","), F.lit("}}")).alias("text"))
    parts = sbom.components(repository.lock_entries(locks, scan="scan"))
    return parts.select("scan", "name", "version", "purl", "dev", F.col("seq").cast("long").alias("seq"), F.array_join("declaredRanges", ",").alias("ranges"))


@query("""WITH e AS (SELECT CASE WHEN l_linenumber % 10 = 3 THEN 0 ELSE l_partkey END AS k, l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS v FROM lineitem)
SELECT p_partkey, coalesce(md5(string_agg(v, ',' ORDER BY l_orderkey, l_linenumber, v)), '') AS ranges, count(v) AS n_ranges FROM (SELECT p_partkey FROM part UNION SELECT 0) LEFT JOIN e ON k = p_partkey GROUP BY p_partkey""")
def declared_ranges_collect(spark, sf_dir):
    """What all entries declare for a name, in their order; one name has more than a tenth of all."""
    name = F.when(F.col("l_linenumber") % 10 == 3, F.lit(0)).otherwise(F.col("l_partkey"))
    edges = table(spark, sf_dir, "lineitem").select(name.alias("k"), F.col("l_quantity").cast("int").cast("string").alias("v"), F.struct("l_orderkey", "l_linenumber").alias("s"))
    found = sbom.declared_ranges(edges, "k", "v", "s")
    names = table(spark, sf_dir, "part").select("p_partkey").union(spark.range(1)).distinct()
    rows = names.join(found, F.col("p_partkey") == F.col("name"), "left")
    return rows.select("p_partkey", F.coalesce(F.md5(F.array_join("declaredRanges", ",")), F.lit("")).alias("ranges"), F.coalesce(F.size("declaredRanges"), F.lit(0)).cast("long").alias("n_ranges"))


@query("""SELECT p_partkey, 'pkg:npm/' || url_encode('@' || p_brand || '/' || p_name) || '@' || CAST(p_size AS VARCHAR) AS purl FROM part""")
def purl_build(spark, sf_dir):
    """Package names from paths, and package URLs."""
    path = F.concat(F.lit("node_modules/a/node_modules/@"), F.col("p_brand"), F.lit("/"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", C.purl(C.package_name(path), F.col("p_size").cast("string")).alias("purl"))


def _parts(spark, sf_dir):
    """Customers as components of a scan for each nation, with urgent orders as vulnerabilities and closed ones as anomalies of the same package."""
    package = lambda c: F.concat(F.lit("p-"), (F.col(c) % 500).cast("string"))
    parts = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("scan"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("version"), package("c_custkey").alias("purl"))
    orders = table(spark, sf_dir, "orders").withColumns({"scan": (F.col("o_custkey") % 25).cast("long"), "purl": package("o_custkey")})
    vulns = orders.where("o_orderpriority = '1-URGENT'").select("scan", "purl", F.col("o_orderkey").cast("string").alias("vuln_id"))
    severity = F.when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    hits = orders.where("o_orderstatus = 'F'").select("scan", "purl", F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("type"), severity.alias("severity"), F.lit("closed").alias("reason"))
    return parts, vulns, hits


_PARTS_SQL = """WITH parts AS (SELECT c_nationkey::BIGINT AS scan, c_custkey AS seq, c_name AS name, 'p-' || (c_custkey % 500) AS purl FROM customer),
o AS (SELECT *, (o_custkey % 25)::BIGINT AS scan, 'p-' || (o_custkey % 500) AS purl FROM orders),
v AS (SELECT scan, purl, count(*) AS nv FROM o WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
hit AS (SELECT scan, purl, o_orderpriority AS type, CASE o_orderpriority WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity FROM o WHERE o_orderstatus = 'F'),
h AS (SELECT scan, purl, count(*) AS nh, bool_or(severity = 'high') AS hi, bool_or(severity = 'medium') AS me FROM hit GROUP BY ALL),
rows AS (SELECT parts.*, coalesce(nv, 0) AS n_vulns, coalesce(nh, 0) AS n_hits,
    CASE WHEN nv > 0 THEN 'critical' WHEN hi THEN 'high' WHEN me THEN 'medium' WHEN nh > 0 THEN 'low' END AS bucket FROM parts LEFT JOIN v USING (scan, purl) LEFT JOIN h USING (scan, purl)) """


def _bucketed(spark, sf_dir):
    rows = sbom.with_hits(*_parts(spark, sf_dir))
    return rows.withColumn("bucket", sbom.worst_bucket(F.size("vulns") > 0, F.transform("hits", lambda h: h["severity"])))


@query(_PARTS_SQL + "SELECT scan, seq, name, purl, n_vulns, n_hits, bucket FROM rows")
def left_enrich_hits(spark, sf_dir):
    """Components with vulnerabilities and anomalies of their purl in their scan; rows of one purl share them."""
    return _bucketed(spark, sf_dir).select("scan", "seq", "name", "purl", F.size("vulns").cast("long").alias("n_vulns"), F.size("hits").cast("long").alias("n_hits"), "bucket")


@query(_PARTS_SQL + """SELECT scan, count(*) FILTER (bucket = 'critical') AS critical, count(*) FILTER (bucket = 'high') AS high, count(*) FILTER (bucket = 'medium') AS medium,
count(*) FILTER (bucket = 'low') AS low, count(bucket) AS flaggedCount, count(*) AS totalComponents FROM rows GROUP BY scan""")
def risk_bucket_summary(spark, sf_dir):
    """Components of each scan by their worst bucket (A1)."""
    return sbom.risk_summary(_bucketed(spark, sf_dir))


@query(_PARTS_SQL + "SELECT scan, type, count(*) AS n FROM parts JOIN hit USING (scan, purl) GROUP BY ALL")
def type_histogram(spark, sf_dir):
    """Hits by type, once for each row that shows them."""
    return sbom.type_histogram(_bucketed(spark, sf_dir))


@query(_PARTS_SQL + "SELECT scan, seq, name, bucket AS severity, n_hits AS flagCount FROM rows WHERE n_vulns > 0 OR n_hits > 0")
def worst_severity_view(spark, sf_dir):
    """The table of flagged components."""
    return views.component_view(_bucketed(spark, sf_dir), only_flagged=True, sort="severity").select("scan", "seq", "name", "severity", F.col("flagCount").cast("long").alias("flagCount"))


@query(_PARTS_SQL + "SELECT scan, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM parts JOIN hit USING (scan, purl) GROUP BY scan")
def anomaly_facets(spark, sf_dir):
    """The distinct anomaly types of each scan, sorted, for a filter."""
    return views.anomaly_types(_bucketed(spark, sf_dir)).select("scan", F.array_join("types", ",").alias("types"))


@query("SELECT c_custkey, coalesce(string_agg('V' || o_orderkey, ',' ORDER BY 'V' || o_orderkey), '') AS vulns FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def first_affected(spark, sf_dir):
    """Vulnerabilities shown with the first component that they affect."""
    ref = lambda c: F.struct(F.concat(F.lit("r"), c.cast("string")).alias("ref"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    vulns = orders.select(F.concat(F.lit("V"), F.col("o_orderkey").cast("string")).alias("id"), F.array(ref(F.col("o_custkey")), ref(F.col("o_custkey") + 1)).alias("affects"))
    parts = table(spark, sf_dir, "customer").select("c_custkey", ref(F.col("c_custkey"))["ref"].alias("ref"))
    return views.affected_first(parts, vulns).select("c_custkey", F.array_join("vulns", ",").alias("vulns"))


@query(_PARTS_SQL + "SELECT type, count(*) AS hits, scan FROM hit GROUP BY ALL")
def detector_counts(spark, sf_dir):
    """What each detector of a scan has found."""
    return sbom.detector_counts(_parts(spark, sf_dir)[2])


@query("""SELECT count(*) AS asked, count(k) AS answered, count(*) - count(k) AS errors FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) ON o_custkey = k""")
def fact_counts(spark, sf_dir):
    """How many names were asked of a registry, answered, and not."""
    facts = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return sbom.fact_counts(table(spark, sf_dir, "orders"), facts, "o_custkey")


@query("""SELECT l_orderkey, l_linenumber, count(*) FILTER (l_returnflag = 'R') OVER (PARTITION BY l_partkey) AS n_hits FROM lineitem""")
def duplicate_key_hits(spark, sf_dir):
    """Hits of rows that repeat a purl add up, and each of these rows shows them all."""
    purl = F.concat(F.lit("pkg:npm/p"), F.col("l_partkey").cast("string")).alias("purl")
    rows = table(spark, sf_dir, "lineitem")
    hits = rows.where("l_returnflag = 'R'").select(purl, F.lit(0).alias("seq"), F.lit("install-script").alias("type"), F.lit("high").alias("severity"), F.lit("script").alias("reason"))
    none = rows.limit(0).select(purl, F.lit("").alias("vuln_id"))
    return sbom.with_hits(rows.select("l_orderkey", "l_linenumber", purl), none, hits).select("l_orderkey", "l_linenumber", F.size("hits").cast("long").alias("n_hits"))


@query(_PARTS_SQL + "SELECT scan, name, purl, 'required' AS scope, n_hits AS n_properties, sum(n_vulns) OVER (PARTITION BY scan)::BIGINT AS n_vulnerabilities FROM rows")
def bom_document(spark, sf_dir):
    """The document of each scan, read back: components with their properties, and the vulnerabilities."""
    element, e = F.col("element"), _streamed(spark, sf_dir)
    known = e.where(F.startswith(element, F.lit('{"id":'))).where("e.id is not null").groupBy("scan").agg(F.count("*").alias("n"))
    rows = e.where(F.startswith(element, F.lit('{"type":'))).select("scan", "e.name", "e.purl", "e.scope", F.coalesce(F.size("e.properties"), F.lit(0)).cast("long").alias("n_properties"))
    return rows.join(known, "scan", "left").withColumn("n_vulnerabilities", F.coalesce("n", F.lit(0).cast("long"))).drop("n")


def _streamed(spark, sf_dir):
    """(scan, element, e): the elements of all scans' documents, as text and read, written as streams and read back; no document is one row."""
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    parts, vulns, hits = _parts(spark, sf_dir)
    inventory, texts = documents.shared_inventory(parts.withColumn("dev", F.lit(False)), vulns, hits)
    documents.write(inventory, path, texts, compression="gzip")  # what components share is in each of them
    read = F.from_json("element", "name string, purl string, scope string, properties array<struct<name string>>, id string, affects array<struct<ref string>>")
    return documents.elements(spark, path).select(F.col("scan").cast("long").alias("scan"), "element", read.alias("e"))


@query(_PARTS_SQL + "SELECT scan, name, purl, 'required' AS scope, n_hits AS n_properties, NULL AS id FROM rows UNION ALL SELECT scan, NULL, purl, NULL, NULL, o_orderkey::VARCHAR FROM parts JOIN o USING (scan, purl) WHERE o_orderpriority = '1-URGENT'")
def streamed_documents(spark, sf_dir):
    """The documents of all scans written as streams and read back by element: components, then vulnerabilities."""
    held = F.when(F.col("e.id").isNull(), F.coalesce(F.size("e.properties"), F.lit(0)).cast("long"))
    return _streamed(spark, sf_dir).select("scan", "e.name", F.coalesce("e.purl", F.col("e.affects")[0]["ref"]).alias("purl"), "e.scope", held.alias("n_properties"), "e.id")


@query("""SELECT p_partkey, coalesce(n > 30, false) AS popular FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey""")
def popular_flag(spark, sf_dir):
    """Membership in a list."""
    popular = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).count().where("count > 30")
    return sbom.flag_members(table(spark, sf_dir, "part"), popular, "p_partkey", "popular").select("p_partkey", "popular")


@query("""WITH names AS (SELECT 'sup' || s_suppkey AS name FROM supplier), ranked AS (
    SELECT 'sup' || l_suppkey AS near, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS rank FROM lineitem GROUP BY l_suppkey QUALIFY rank <= 40)
SELECT name, near, distance FROM (SELECT name, near, levenshtein(name, near) AS distance, row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, near), rank) AS r
    FROM names, ranked WHERE name NOT IN (SELECT near FROM ranked) AND levenshtein(name, near) BETWEEN 1 AND CASE WHEN length(name) <= 5 THEN 1 ELSE 2 END) WHERE r = 1""")
def typosquat_nearest(spark, sf_dir):
    """The nearest popular name within one or two edits."""
    name = lambda c: F.concat(F.lit("sup"), F.col(c).cast("string"))
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").count().orderBy(F.desc("count"), "l_suppkey").limit(40)
    popular = counts.select(name("l_suppkey").alias("name"), F.struct((-F.col("count")).alias("c"), "l_suppkey").alias("rank"))
    found = sbom.nearest_popular(table(spark, sf_dir, "supplier").select(name("s_suppkey").alias("name")), popular)
    return found.select("name", "near", F.col("distance").cast("long").alias("distance"))


@query("""SELECT c_mktsegment, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def distinct_enrich_join(spark, sf_dir):
    """Facts fetched once for each distinct key, then joined back."""
    orders = table(spark, sf_dir, "orders")
    facts = orders.select("o_custkey").distinct().join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    return sbom.enrich(orders, facts, "o_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query(f"""SELECT o_orderkey, CAST(floor(date_diff('day', o_orderdate, TIMESTAMP '{AS_OF}') + 0.5) AS BIGINT) AS days FROM orders
WHERE o_orderstatus <> 'F' AND date_diff('day', o_orderdate, TIMESTAMP '{AS_OF}') < 30 AND CAST(o_totalprice AS BIGINT) % 1000 < 100""")
def freshness_gate(spark, sf_dir):
    """New and unpopular ones, asked only of rows without other hits."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    as_of = F.lit(AS_OF).cast("timestamp")
    fresh = sbom.freshness(F.col("o_orderdate"), F.round("o_totalprice").cast("long") % 1000, as_of)
    return rows.where(fresh.isNotNull()).select("o_orderkey", F.floor(C.days_between(F.col("o_orderdate"), as_of) + 0.5).alias("days"))


@query("""WITH t AS (SELECT doc_id, CASE WHEN regexp_matches(text, 'Apache License, Version 2\\.0') THEN 'Apache-2.0' WHEN regexp_matches(text, 'MIT License') THEN ' MIT '
WHEN regexp_matches(text, 'GNU General Public License, version 3') THEN 'GPL-3.0-only' WHEN regexp_matches(text, 'CC BY-NC 4\\.0') THEN 'CC-BY-NC-4.0' END AS raw FROM documents)
SELECT doc_id, coalesce(regexp_replace(trim(raw), '(?i)-(or-later|only)$', ''), 'UNKNOWN') AS license,
CASE coalesce(raw, '') WHEN 'GPL-3.0-only' THEN 'high' WHEN '' THEN 'medium' WHEN 'CC-BY-NC-4.0' THEN 'low' END AS severity FROM t""")
def license_extract_classify(spark, sf_dir):
    """Licence identifiers and how severe they are."""
    has = lambda p: F.col("text").rlike(p)
    raw = F.when(has(r"Apache License, Version 2\.0"), "Apache-2.0").when(has("MIT License"), " MIT ").when(has("GNU General Public License, version 3"), "GPL-3.0-only").when(has(r"CC BY-NC 4\.0"), "CC-BY-NC-4.0")
    return table(spark, sf_dir, "documents").select("doc_id", C.license_id(raw).alias("license"), C.license_severity(raw).alias("severity"))


@query("""SELECT l_orderkey, l_linenumber, 'Loose version range: ' || r AS reason FROM (SELECT l_orderkey, l_linenumber,
CASE l_returnflag WHEN 'A' THEN '*' WHEN 'R' THEN '^0.0.1, latest' END AS r FROM lineitem) WHERE r IS NOT NULL""")
def version_pinning(spark, sf_dir):
    """Loose ranges."""
    ranges = F.when(F.col("l_returnflag") == "A", F.array(F.lit("*"), F.lit("^4.18.2"))).when(F.col("l_returnflag") == "R", F.array(F.lit("^0.0.1"), F.lit("~1.0"), F.lit("latest"))).otherwise(F.array(F.lit("1.2.3")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sbom.version_pinning(ranges).alias("h"))
    return rows.where("h is not null").select("l_orderkey", "l_linenumber", "h.reason")


@query("""SELECT p_partkey, CASE WHEN n > 30 THEN 'low' ELSE 'high' END AS severity FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey WHERE p_size % 3 = 0""")
def install_script(spark, sf_dir):
    """Install scripts, less severe for popular packages (P5, C4)."""
    popular = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).count().where("count > 30")
    rows = sbom.flag_members(table(spark, sf_dir, "part"), popular, "p_partkey", "popular").withColumn("h", sbom.install_script(F.col("p_size") % 3 == 0, F.col("popular")))
    return rows.where("h is not null").select("p_partkey", "h.severity")


@query("""SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1) / 1000) AS BIGINT) AS chunk FROM customer""")
def chunk_ids(spark, sf_dir):
    """Rows in chunks of 1000."""
    return sbom.chunks(table(spark, sf_dir, "customer"), [F.desc("c_acctbal"), F.asc("c_custkey")], 1000).select("c_custkey", "chunk")


@query("""SELECT event_type, user_id, min(event_id) AS seq, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY event_type, user_id""")
def last_wins(spark, sf_dir):
    """The last row of each key, at the place of its first (D3)."""
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", F.col("event_id").alias("seq"), "event_id", "value")
    return sbom.upsert(rows, ["event_type", "user_id"])


@query("""SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text, lang""")
def dedupe_keep_first(spark, sf_dir):
    """The first of equal rows."""
    return sbom.keep_first(table(spark, sf_dir, "documents"), ["text", "lang"], "doc_id")


@query("""SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY ALL""")
def windowed_counts(spark, sf_dir):
    """Events by hour and type, as the streaming operator counts them."""
    from quillbom.streaming.drops import windowed_counts as counts

    return counts(table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", C.half_up(F.col("total"), 2).alias("total"))
