"""Correlation of findings with packages, the CBOM document, retrieval and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbom.functions import columns as C
from quillbom.functions import rules
from quillbom.functions.keys import SCAN, scan_key
from quillbom.operators import scan as detectors


def attribute(findings: DataFrame, packages: DataFrame) -> DataFrame:
    """findings with packageContext: the first version of the package of the scan whose folder holds the file."""
    by = scan_key(findings, packages)
    first = packages.groupBy(*by, "name").agg(F.min_by(F.struct("name", "version", "purl"), "seq").alias("packageContext")).withColumnRenamed("name", "_owner")
    return findings.withColumn("_owner", C.owning_package(F.col("filePath"))).join(first, [*by, "_owner"], "left").drop("_owner")


def compounding(correlated: DataFrame, packages: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """((scan,) name, version, purl) of packages with a known vulnerability (or anomaly) and a severe finding of their own."""
    by = scan_key(correlated, packages)
    severe = correlated.where(F.col("quantumRisk").isin("CRITICAL", "HIGH") | F.col("exposureRisk").isin("CRITICAL", "HIGH"))
    own = severe.where("packageContext is not null").select(*by, F.col("packageContext.purl").alias("purl")).distinct()
    risky = packages.where(F.size("osvCves") > 0).select(*by, "name", "version", "purl")
    if anomalies is not None:
        risky = risky.unionByName(packages.join(anomalies.select(*by, "purl").distinct(), [*by, "purl"], "left_semi").select(*by, "name", "version", "purl")).distinct()
    return risky.join(own, [*by, "purl"], "left_semi")


def combined_summary(correlated: DataFrame) -> DataFrame:
    """Counts by quantum and exposure class, and of findings with and without a package; a row for each scan if there are several."""
    count = lambda c, v, n: F.count(F.when(F.coalesce(F.when(F.col(c).isin(rules.EXPOSURES), F.col(c)), F.lit("NONE")) == v, 1)).alias(n)
    return correlated.groupBy(*scan_key(correlated)).agg(
        *[count("quantumRisk", v, f"quantum{v.title()}") for v in rules.EXPOSURES], *[count("exposureRisk", v, f"exposure{v.title()}") for v in rules.EXPOSURES],
        F.count("packageContext").alias("attributed"), F.count(F.when(F.col("packageContext").isNull(), 1)).alias("firstParty"),
    )


def by_primitive(correlated: DataFrame) -> DataFrame:
    return correlated.where("primitive is not null").groupBy(*scan_key(correlated), "primitive").agg(F.count("*").alias("n"))


def findings_by_package(correlated: DataFrame) -> DataFrame:
    """((scan,) purl, findings): what each package is known to hold, in the order of files and lines."""
    own = correlated.where("packageContext is not null")
    each = F.array_sort(F.collect_list(F.struct("filePath", "line", "findingId", "name", "assetType", "quantumRisk", "exposureRisk")))
    return own.groupBy(*scan_key(own), F.col("packageContext.purl").alias("purl")).agg(each.alias("findings"))


def component(ref: Column, columns: list[str] = ()) -> Column:
    """A finding as a CycloneDX component struct; null fields are left out when written as JSON. Of the columns
    of certificates (subject, validTo), those that are among the given ones are used."""
    kind = F.col("assetType")
    algorithm = F.when(kind == "algorithm", F.struct("primitive", F.col("parameterSet").alias("parameterSetIdentifier"), "mode", F.col("nistQuantumLevel").alias("nistQuantumSecurityLevel")))
    material = F.when(kind == "related-crypto-material", F.struct(F.coalesce("materialType", F.lit("other")).alias("type"), F.lit("active").alias("state"), C.leading_int(F.col("parameterSet")).alias("size")))
    given = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    until = F.coalesce(F.date_format(given("validTo").try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), given("validTo"))
    certificate = F.when(kind == "certificate", F.struct(given("subject").alias("subjectName"), until.alias("notValidAfter"), F.col("parameterSet").alias("signatureAlgorithm")))
    prop = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(f"quillbom:{name}").alias("name"), value.cast("string").alias("value")))
    props = F.array_compact(F.array(prop("confidence", F.col("confidence")), prop("context", F.col("contextCategory")), prop("quantumRisk", F.col("quantumRisk")), prop("exposureRisk", F.col("exposureRisk")), prop("fingerprint", F.col("fingerprint"))))
    shown = lambda s: F.when(s.isin("keys_certs", "sca", "constant"), "static").when(s == "sbom_sca", "sca").when(s == "vectorSearch", "embedding").otherwise(s)
    seen = F.transform("evidence", lambda e: F.struct(F.lit("quillbom:evidence").alias("name"), F.concat(e["evidenceClass"], F.lit(" — "), e["detail"]).alias("value")))
    return F.struct(
        F.lit("cryptographic-asset").alias("type"), ref.alias("bom-ref"), "name",
        F.struct(kind.alias("assetType"), algorithm.alias("algorithmProperties"), certificate.alias("certificateProperties"), material.alias("relatedCryptoMaterialProperties")).alias("cryptoProperties"),
        F.concat(props, seen).alias("properties"), F.array_distinct(F.transform("evidence", lambda e: shown(e["source"]))).alias("sources"),
    )


def references(findings: DataFrame) -> DataFrame:
    return findings.withColumn("bomRef", C.bom_ref(F.col("assetType"), F.col("name"), F.col("filePath"), F.col("line"), F.col("findingId")))


def provides(correlated: DataFrame) -> DataFrame:
    """((scan,) ref, provides): per package the findings in its folder."""
    own = correlated.where((F.col("contextCategory") == "vendor") & F.col("packageContext").isNotNull())
    return own.groupBy(*scan_key(own), F.col("packageContext.purl").alias("ref")).agg(F.array_sort(F.collect_set("bomRef")).alias("provides"))


def documents(correlated: DataFrame) -> DataFrame:
    """(scan, document): the CBOM of each scan as JSON text; rows without a scan column are of one scan, whose name is empty."""
    rows = references(correlated if scan_key(correlated) else correlated.withColumn(SCAN, F.lit("")))
    parts = rows.groupBy(SCAN).agg(F.array_sort(F.collect_list(F.struct("filePath", "line", component(F.col("bomRef"), rows.columns).alias("c")))).alias("x"))
    edges = provides(rows).groupBy(SCAN).agg(F.array_sort(F.collect_list(F.struct("ref", "provides"))).alias("dependencies"))
    body = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), F.transform("x", lambda e: e["c"]).alias("components"), F.coalesce("dependencies", F.array().cast(edges.schema["dependencies"].dataType)).alias("dependencies"))
    return parts.join(edges, SCAN, "left").select(SCAN, F.to_json(body).alias("document"))


def merge_documents(left: DataFrame, right: DataFrame) -> DataFrame:
    """((scan,) c): the components of two parsed documents of each scan, one row each; a scan may be in one of them only."""
    by = scan_key(left, right)
    return left.select(*by, F.explode("components").alias("c")).unionByName(right.select(*by, F.explode("components").alias("c")), allowMissingColumns=True)


# Retrieval


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either is all zeros."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


class Pivots:
    """A few vectors to which angles are taken, and how far an entry may be from a query."""

    def __init__(self, vectors: list, least: float):
        known = [np.asarray(v, np.float64) for v in vectors]
        self.units = np.array([v / n for v in known if (n := np.linalg.norm(v)) > 0])
        self.widest = float(np.arccos(np.clip(least, -1.0, 1.0))) + 1e-6
        self.band = max(self.widest / 4, np.pi / 64)
        self.bands = int(np.pi / self.band) + 2

    def angles(self, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """(angles to the pivots, which vectors are all zeros)."""
        v = np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)
        size = np.linalg.norm(v, axis=1)
        unit = v / np.where(size > 0, size, 1.0)[:, None]
        return np.arccos(np.clip(unit @ self.units.T, -1.0, 1.0)), size == 0


class Cells:
    """A corpus in cells of bounded number: by the nearest of a few pivots, and by the angle to it in bands.

    Angles obey the triangle inequality, so a query whose angle to a pivot differs from a band by more
    than the widest angle asked for has no entry of that cell within it; nor has it one whose nearest
    pivot is further from the query than its own nearest by more than twice that angle. Vectors of
    all zeros have a cell of their own, which is searched if a cosine of 0 is enough. Pivots are a
    bounded sample of the corpus, the first by hash: they decide what is left out, never what is found.
    """

    def __init__(self, corpus: DataFrame, least: float, pivots: int):
        self.pivots = Pivots([r["w"] for r in corpus.orderBy(F.xxhash64("entry"), "entry").limit(pivots).select("w").collect()], least)
        self.zeros = least <= 0
        self.placed = self._placed(corpus, self.pivots)
        self.sizes = {r["cell"]: r["count"] for r in self.placed.groupBy("cell").count().collect()}  # bounded: pivots times bands

    @staticmethod
    def _placed(corpus: DataFrame, pivots: Pivots) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                cell = np.full(len(rows), -1)
                if len(rows) and len(pivots.units):
                    angle, zero = pivots.angles(rows["w"])
                    near = angle.argmin(axis=1)
                    cell = np.where(zero, -1, near * pivots.bands + (angle[np.arange(len(rows)), near] / pivots.band).astype(np.int64))
                yield rows.assign(cell=cell)

        return corpus.select("entry", "w").mapInPandas(run, f"entry {corpus.schema['entry'].dataType.simpleString()}, w {corpus.schema['w'].dataType.simpleString()}, cell long")

    def asked(self, queries: DataFrame) -> DataFrame:
        """(id, v, cell): queries with each cell that may hold what they ask for."""
        pivots, zeros = self.pivots, self.zeros
        cells = np.array(sorted(c for c in self.sizes if c >= 0), np.int64)
        pivot, low = cells // pivots.bands, (cells % pivots.bands) * pivots.band
        always = [c for c in self.sizes if c < 0 and zeros]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                found: list[list[int]] = [[] for _ in range(len(rows))]
                if len(rows) and len(cells):
                    angle, zero = pivots.angles(rows["v"])
                    to = angle[:, pivot]
                    stay = (to + pivots.widest >= low) & (to - pivots.widest <= low + pivots.band) & (to <= angle.min(axis=1)[:, None] + 2 * pivots.widest)
                    found = [cells[s].tolist() for s in np.where(zero[:, None], zeros, stay)]
                yield rows.assign(cells=[f + always for f in found])

        kind = f"id {queries.schema['id'].dataType.simpleString()}, v {queries.schema['v'].dataType.simpleString()}, cells array<long>"
        return queries.select("id", "v").mapInPandas(run, kind).select("id", "v", F.explode("cells").alias("cell"))


def _looked_up(values: dict[int, int], default: int) -> Column:
    """The value of a row's cell."""
    table = F.create_map(*[F.lit(x).cast("long") for kv in (values or {-2: default}).items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col("cell")), F.lit(default).cast("long"))


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 3, least: float = 0.75, block_rows: int = 2048, others: bool = False, pivots: int = 32) -> DataFrame:
    """queries (id, v) with their k most similar corpus entries (entry, w) of at least that cosine; ties to the smaller entry.
    With others, an entry is no neighbour of the query of the same number.

    Exact: cells of the corpus that hold nothing so similar are left out by the triangle inequality.
    Of the others, blocks of bounded size meet blocks of the queries that ask for them, and each pair
    of blocks is one task's matrix product.
    """
    cells = Cells(corpus, least, pivots)
    query_blocks = max(1, -(-queries.count() // block_rows))
    deal = lambda c, n: F.pmod(F.xxhash64(c), n.cast("long") if isinstance(n, Column) else F.lit(n)).cast("int")
    of_cell = _looked_up({c: -(-n // block_rows) for c, n in cells.sizes.items()}, 1).cast("int")
    asked = cells.asked(queries).withColumn("j", deal("id", query_blocks))
    left = asked.withColumn("i", F.explode(F.sequence(F.lit(0), of_cell - 1)))
    wanted = asked.select(F.col("cell").alias("at"), F.col("j").alias("by")).distinct()  # at most cells times blocks of queries
    right = cells.placed.withColumn("i", deal("entry", of_cell)).join(wanted, F.col("cell") == F.col("at")).select("entry", "w", "cell", "i", "by")

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asked) and len(held):
            q, c = np.array(asked["v"].tolist(), np.float64), np.array(held["w"].tolist(), np.float64)
            size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)
            scores = np.divide(q @ c.T, size, out=np.zeros_like(size), where=size > 0)
            entries = held["entry"].to_numpy()
            for n, row in zip(asked["id"], scores, strict=True):
                near = np.flatnonzero((row >= least) & (entries != n) if others else row >= least)
                out += [(n, entries[x], row[x]) for x in near[np.lexsort((entries[near], -row[near]))][:k]]
        return pd.DataFrame(out, columns=["id", "entry", "score"]).astype({"id": "int64", "entry": "int64", "score": "float64"})

    found = left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "by")).applyInPandas(run, "id long, entry long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "entry")))
    return ranked.where(F.col("rank") <= k).select("id", "rank", "entry", "score")


def scored_share(queries: DataFrame, corpus: DataFrame, least: float = 0.75, pivots: int = 32) -> DataFrame:
    """One row (pairs, scored): all pairs of queries and entries, and those that nearest() scores."""
    cells = Cells(corpus, least, pivots)
    scored = cells.asked(queries).agg(F.coalesce(F.sum(_looked_up(cells.sizes, 0)), F.lit(0)).alias("scored"))
    return scored.select(F.lit(queries.count() * sum(cells.sizes.values())).alias("pairs"), "scored")


def fixed_span(lines: DataFrame, at: DataFrame, back: int = 40, ahead: int = 5) -> DataFrame:
    """((scan,) path, line, text): the lines around each place, from back before it to just under ahead after it."""
    key = [*scan_key(lines, at), "path"]
    places = at.select(*key, F.col("line").alias("at"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - back), F.col("line") + ahead - 1)).alias("line"))
    joined = places.join(lines, [*key, "line"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"])
    return joined.groupBy(*key, "at").agg(F.array_join(ordered, "\n").alias("text")).withColumnRenamed("at", "line")


def enclosing_span(lines: DataFrame, at: DataFrame) -> DataFrame:
    """The span that a place is shown in. Functions around it are never found where this comes from, as it reads a
    field that is not there, so the span is always the fixed one."""
    return fixed_span(lines, at)


def hashed_vector(text: Column, size: int = 256) -> Column:
    """A term-frequency vector of hashed words, for retrieval without a model: buckets are counted by sorting them once."""
    words = F.array_sort(F.transform(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int")))
    ends = F.filter(F.transform(words, lambda w, i: F.when(F.coalesce(F.get(words, i + 1) != w, F.lit(True)), F.struct(w.alias("w"), (i + 1).alias("end")))), lambda e: e.isNotNull())
    counts = F.map_from_arrays(F.transform(ends, lambda e: e["w"]), F.transform(ends, lambda e, i: e["end"] - F.coalesce(F.get(ends, i - 1)["end"], F.lit(0))))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(counts, i), F.lit(0)).cast("float"))


# Verification


def to_verify(findings: DataFrame) -> DataFrame:
    """Findings without direct evidence whose place is known."""
    direct = F.exists("evidence", lambda e: e["evidenceClass"] == "direct")
    return findings.where(~direct & F.col("filePath").isNotNull() & (F.col("line") > 0))


def capped(rows: DataFrame, order: list, most: int = 50) -> DataFrame:
    """The first rows in that order, for a costly step that has a limit."""
    return rows.orderBy(*order).limit(most)


def skipped(rows: DataFrame, most: int = 50) -> DataFrame:
    """One row: how many there are for the costly step, how many it takes, and how many it skips."""
    n = F.count("*")
    return rows.agg(n.alias("total"), F.least(n, F.lit(most)).alias("taken"), F.greatest(n - most, F.lit(0)).alias("skipped"))


def verified(findings: DataFrame, answers: DataFrame) -> DataFrame:
    """The whole pass from findings to be verified to findings with interpretive evidence.

    answers has the recorded answer (raw) of a finding's id. Findings without direct evidence whose
    answer names a family get it, with the answer's confidence as evidence; outcome is null for
    findings that were not asked, or whose answer is missing.
    """
    by = scan_key(findings, answers)
    asked = to_verify(findings).select(*by, "findingId")
    known = answers.join(asked, [*by, "findingId"], "left_semi").dropDuplicates([*by, "findingId"]).select(*by, "findingId", verdict(response(F.col("raw"))).alias("v"))
    rows = findings.join(known, [*by, "findingId"], "left")
    ok = F.coalesce(F.col("v.outcome") == "ok", F.lit(False))
    seen = F.struct(
        F.lit("llm").alias("source"), F.lit("interpretive").alias("evidenceClass"), F.concat(F.lit("verified as "), F.col("v.family")).alias("detail"),
        F.col("v.confidence").alias("rawConfidence"), F.col("filePath"), F.col("line").cast("int").alias("line"),
    )
    added = F.when(ok, F.concat("evidence", F.array(seen).cast(f"array<{detectors.EVIDENCE}>"))).otherwise(F.col("evidence"))
    take = lambda c, new: F.when(ok, F.coalesce(new, F.col(c))).otherwise(F.col(c))
    return rows.withColumns({
        "evidence": added, "algorithmFamily": take("algorithmFamily", F.col("v.family")), "name": take("name", F.col("v.family")), "primitive": take("primitive", F.col("v.primitive")), "outcome": F.col("v.outcome"),
    }).drop("v")


def scan_summary(findings: DataFrame) -> DataFrame:
    """What a scan says at its end: findings in all, with direct evidence, candidates for verification, and its outcomes with the reasons of failures."""
    direct = F.exists("evidence", lambda e: e["evidenceClass"] == "direct")
    is_ = lambda *v: F.count(F.when(F.col("outcome").isin(*v), 1))
    return findings.groupBy(*scan_key(findings)).agg(
        F.count("*").alias("total"), F.count(F.when(direct, 1)).alias("direct"), F.count(F.when(~direct | F.col("outcome").isNotNull(), 1)).alias("candidates"),
        is_("ok", "no_crypto", "failed", "schema_mismatch").alias("attempted"), is_("ok", "no_crypto").alias("succeeded"), is_("no_crypto").alias("noCrypto"),
        is_("failed", "schema_mismatch").alias("failed"), is_("failed").alias("unreadable"), is_("schema_mismatch").alias("mismatched"),
    )


def prompt(path: Column, code: Column, neighbours: Column) -> Column:
    listed = F.array_join(F.transform(neighbours, lambda n: F.concat(F.lit("- "), n["entry"], F.lit(" ("), F.format_number(n["score"], 2), F.lit(")"))), "\n")
    return F.concat_ws("\n\n", F.concat(F.lit("File: "), path), F.concat(F.lit("Similar code:\n"), listed), F.concat(F.lit("Code:\n"), code), F.lit("Answer with one JSON object: algorithmFamily, primitive, parameterSet, confidence, reasoning."))


def response(raw: Column) -> Column:
    """struct of a model's JSON answer; fences are dropped, and text around the object; null where none can be read."""
    kind = "algorithmFamily string, primitive string, parameterSet string, confidence double, reasoning string"
    text = F.trim(F.regexp_replace(raw, r"```(?:json)?", ""))
    inner = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    read = lambda t: F.when(F.try_parse_json(t).isNotNull() & F.startswith(F.trim(t), F.lit("{")), F.from_json(t, kind))
    return F.coalesce(read(text), read(inner))


def canonical_family(name: Column) -> Column:
    known = {f.lower(): f for f in rules.FAMILIES} | rules.FAMILY_ALIASES
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.lower(F.trim(name)))


def verdict(answer: Column) -> Column:
    """struct(outcome, family, primitive, confidence) of an answer: failed, no_crypto, schema_mismatch or ok."""
    blank = lambda c: c.isNull() | F.lower(F.trim(c)).isin("", "null", "none", "unknown", "undefined")
    family = answer["algorithmFamily"]
    rescued = F.coalesce(canonical_family(answer["parameterSet"]), canonical_family(answer["primitive"]))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(answer["confidence"], F.lit(0.0)), F.lit(0.0))))
    in_reason = F.array_min(F.array_compact(F.array(*[F.when(answer["reasoning"].rlike(r"(?i)(?<![A-Za-z0-9_])\Q" + f + r"\E(?![A-Za-z0-9_])"), F.struct(F.lit(i).alias("i"), F.lit(f).alias("f"))) for i, f in enumerate(rules.FAMILIES)])))["f"]
    found = F.when(F.lower(F.trim(family)).isin(rules.PRIMITIVES), F.coalesce(rescued, in_reason)).otherwise(F.coalesce(canonical_family(family), F.when(blank(family), rescued)))
    nothing = (blank(family) | (sure <= 0)) & rescued.isNull()
    outcome = F.when(answer.isNull(), "failed").when(nothing, "no_crypto").when(found.isNull(), "schema_mismatch").when(sure <= 0, "no_crypto").otherwise("ok")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "ok", found).alias("family"), F.when((outcome == "ok") & answer["primitive"].isin(rules.PRIMITIVES), answer["primitive"]).alias("primitive"), sure.alias("confidence"))


def outcome_counts(rows: DataFrame) -> DataFrame:
    is_ = lambda *v: F.count(F.when(F.col("outcome").isin(*v), 1))
    return rows.agg(F.count("*").alias("attempted"), is_("ok", "no_crypto").alias("succeeded"), is_("failed", "schema_mismatch").alias("failed"), is_("no_crypto").alias("noCrypto"))
