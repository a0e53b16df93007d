"""Queries on copies of the smallest tables with shifted keys, where groups hold more rows than in the tables themselves, against DuckDB."""

import json
import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_queries import TABLES, plain

from quillbom import catalog
from quillbom.llm import quality
from quillbom.operators import assess, calls, documents, sbom, scan, views
from quillbom.session import shared_folder


@pytest.fixture
def copies(tmp_path, sf_dir):
    """A function of table, copies and what is added to a column for each: the folder of all tables, that one repeated."""

    def make(**tables):
        for t in TABLES:
            n, steps = tables.get(t, (1, {}))
            columns = ", ".join(f"{c} + i * {step} AS {c}" for c, step in steps.items())
            duckdb.sql(f"COPY (SELECT * EXCLUDE (i) {f'REPLACE ({columns})' if steps else ''} FROM '{sf_dir}/{t}.parquet', range({n}) r(i)) TO '{tmp_path}/{t}.parquet'")
        return str(tmp_path)

    return make


def differences(spark, name, folder):
    """(rows the query lacks, rows it has beyond its SQL)."""
    frame, con = catalog.QUERIES[name](spark, folder), duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(folder, t)}.parquet'")
    cursor = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want, got = sorted(tuple(plain(v) for v in r) for r in cursor.fetchall()), sorted(tuple(plain(r[n]) for n in names) for r in frame.collect())
    return [r for r in want if r not in set(got)], [r for r in got if r not in set(want)], len(want) - len(got)


def test_corroboration_of_packages_that_are_direct_and_not(spark, copies):
    """a scan that has a package both as a direct one and as another gets one answer for it."""
    folder = copies(supplier=(400, {"s_suppkey": 601, "s_acctbal": -40}))
    assert differences(spark, "semi_corroboration", folder) == ([], [], 0)


@pytest.mark.parametrize("name", ["export_document", "export_without_assets", "bom_document"])
def test_documents_are_no_rows(spark, sf_dir, name):
    """the documents are read back by element, so that no row holds one; their elements are gathered nowhere."""
    frame = catalog.QUERIES[name](spark, sf_dir)
    assert "collect_list" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert differences(spark, name, sf_dir) == ([], [], 0)


@pytest.mark.parametrize("name", ["bom_document", "streamed_documents"])
def test_what_components_share_is_written_once(spark, copies, name):
    """with copies of customers and orders, what packages share grows with their square; it is neither dealt nor kept as rows of each component."""
    folder = copies(customer=(60, {"c_custkey": 500}), orders=(60, {"o_custkey": 500, "o_orderkey": 10_000}))
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(shared_folder(spark).removeprefix("file:")) for f in files)
    before = size()
    frame = catalog.QUERIES[name](spark, folder)
    assert size() - before < 1_000_000
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(folder, t)}.parquet'")
    want = con.sql(f"SELECT count(*), sum(n_properties)::BIGINT, count(DISTINCT purl) FROM ({catalog.ORACLES[name]})").fetchall()[0]
    assert tuple(frame.agg(F.count("*"), F.sum("n_properties"), F.count_distinct("purl")).first()) == want


def test_shared_texts_make_the_same_documents(spark, tmp_path):
    """documents with texts made once are those of components that hold them, over many partitions, with missing and strange values."""
    package = lambda c: F.when(c % 11 > 0, F.concat(F.lit('p"\u2028'), (c % 7).cast("string")))
    n = F.col("id")
    parts = spark.range(900).select(F.when(n % 10 == 0, "small").otherwise("large").alias("scan"), n.alias("seq"), F.concat(F.lit('n}"\n\u2028'), n).alias("name"), F.lit("1}").alias("version"), package(n).alias("purl"), (n % 2 == 0).alias("dev"))
    vulns = spark.range(60).select(F.when(n % 3 == 0, "small").otherwise("large").alias("scan"), package(n % 6).alias("purl"), F.when(n % 5 > 0, F.concat(F.lit('V"'), n)).alias("vuln_id"))
    hits = spark.range(50).select(F.lit("large").alias("scan"), package(n % 5).alias("purl"), n.alias("seq"), F.lit("t").alias("type"), F.lit("low").alias("severity"), F.when(n % 4 > 0, "r}").alias("reason"))
    documents.write(documents.inventory(sbom.with_hits(parts, vulns, hits)), str(tmp_path / "a"))
    inventory, texts = documents.shared_inventory(parts, vulns, hits)
    documents.write(inventory, str(tmp_path / "b"), texts)
    found = [{f.name: json.loads("".join(p.read_text() for p in sorted(f.glob("part-*")))) for f in (tmp_path / x).glob("scan=*")} for x in "ab"]
    assert found[0] == found[1] and len(found[0]["scan=large"]["vulnerabilities"]) > 1000
    assert documents.elements(spark, str(tmp_path / "b")).count() == sum(len(d["components"]) + len(d["vulnerabilities"]) for d in found[0].values())


def test_exported_heads_name_their_repositories(spark, tmp_path):
    """documents written as streams have the heads of those that are gathered in rows, for scans with an address and without one."""
    parts = spark.createDataFrame([("a", "x", "library", "n"), ("b", "y", "cryptographic-asset", "m")], "scan string, ref string, type string, name string")
    addresses, at = spark.createDataFrame([("a", 'u"/1')], "scan string, repository string"), F.lit("2024-01-02").cast("timestamp")
    documents.write(documents.export(parts, True, at, repositories=addresses), str(tmp_path / "d"))
    got = {r["scan"]: json.loads(r["head"]) for r in documents.heads(spark, str(tmp_path / "d")).collect()}
    want = {r["scan"]: json.loads(r["document"]) for r in views.exported(parts, True, at, addresses).collect()}
    assert got == {scan: {k: d[k] for k in ("serialNumber", "metadata")} for scan, d in want.items()}


def test_comments_of_more_files_than_a_task_holds(spark):
    """files are lexed by slices of a batch, each row with its own code."""
    n = 3 * scan.FILES_AT_ONCE + 5
    files = spark.range(0, n, 1, 1).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("f("), "id", F.lit(") /* a\nb */ g("), "id", F.lit(")"))).cast("binary").alias("content"))
    got = {(r["path"], r["line"]): r["code"].strip() for r in scan.comment_free(files).where("code <> ''").collect()}
    assert got == {(str(i), line): f"{name}({i})" for i in range(n) if i % 7 for line, name in ((1, "f"), (2, "g"))}


def test_files_are_lexed_once_for_calls_and_bindings(spark, sf_dir, copies):
    """F8: no join of calls and bindings, whose sides would lex all files each; code that a few MB of rows make is dealt to tasks."""
    files = spark.range(20).select(F.col("id").cast("string").alias("path"), F.lit("c.createHash('md5'); const c = require('x'); const d = require('crypto'), d2 = d; d.createHash('sha1'); c.createHash('md5')").cast("binary").alias("content"))
    resolved = calls.resolved_calls(calls.code_facts(files, ("call", "binding")))
    assert resolved._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert {(r["path"], r["args"][0]) for r in resolved.where("module = 'crypto' and method = 'createHash'").collect()} == {(str(i), "'sha1'") for i in range(20)}
    folder = copies(part=(3, {"p_partkey": 1000}))
    plan = catalog.QUERIES["call_rules"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and plan.count("MapInPandas") == 2
    assert differences(spark, "call_rules", folder) == ([], [], 0)


def test_signs_of_parts_of_batches():
    """of a finding's evidence only sources become Python objects, also in parts of batches and without evidence; rows of groups are made once a batch."""
    evidence = [[{"source": s, "detail": "x"} for s in sources] for sources in ("ab", "", "b", "cab")]
    batch = pa.RecordBatch.from_pydict({"filePath": ["f"] * 4, "line": [1, 2, 3, 4], "algorithmFamily": ["AES", None, "Unknown", "rsa"], "evidence": pa.array(evidence, pa.list_(pa.struct([("source", pa.string()), ("detail", pa.string())])))})
    want = [(("f",), 1, "aes", frozenset("ab")), (("f",), 2, None, frozenset()), (("f",), 3, None, frozenset("b")), (("f",), 4, "rsa", frozenset("abc"))]
    for first in range(4):
        assert list(assess._signs(batch.slice(first), ["filePath"])) == want[first:]
    other = batch.slice(2)
    assert [[r["line"] for r in rows] for rows in assess._dicts([[(batch, 3), (other, 0)], [(batch, 0)], [(other, 1)]])] == [[4, 3], [1], [4]]


def test_all_trusted_rows_count(spark):
    """every trusted label is taken, and the quantile is that of all values, nulls left out."""
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.trusted_ids(labels, "doc_id").count() == 30_000
    values = spark.range(5003).select(F.when(F.col("id") > 2, F.pow(F.col("id") * 37 % 4999, F.lit(0.5))).alias("s"))
    for share in (0.0, 0.001, 0.5, 1.0):
        assert quality.quantile(values, share) == values.agg(F.percentile("s", F.lit(share))).first()[0]
    assert quality.quantile(values.limit(0), 0.5) is None
