"""The software inventory: components of lockfiles, their vulnerabilities and anomalies, and the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbom.functions import columns as C
from quillbom.functions import rules
from quillbom.functions.keys import SCAN, scan_key
from quillbom.functions.positions import with_position


def components(entries: DataFrame) -> DataFrame:
    """One row per installed package: entries without the root and without a version; ranges that any entry of the scan declares."""
    by = scan_key(entries)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    name = C.package_name(F.col("path"))
    kept = entries.where((F.col("path") != "") & F.col("version").isNotNull()).select(
        *by, "seq", name.alias("name"), F.col("path").alias("lockfilePath"), "version", C.purl(name, F.col("version")).alias("purl"),
        F.nullif("resolved", F.lit("")).alias("resolved"), F.nullif("integrity", F.lit("")).alias("integrity"), flag("dev"), flag("optional"), flag("hasInstallScript"),
    )
    declared = declared_ranges(entries.select(*by, "seq", F.explode("dependencies").alias("name", "range")), "name", "range", "seq")
    return kept.join(declared, [*by, "name"], "left").withColumn("declaredRanges", F.coalesce("declaredRanges", F.array().cast("array<string>")))


#: Runs that the ranges of a name are sorted in, where names are not parted by scans.
RUNS = 32


def declared_ranges(edges: DataFrame, name: str, value: str, seq: str) -> DataFrame:
    """(scan,) name, declaredRanges: the ranges in the order of the entries that declare them.

    With a scan column a group is no larger than one lockfile. Without, a name may have a large part
    of all rows: these are first collected and sorted in runs, in as many tasks, and the runs of a
    name are then merged, which a sort does in linear time.
    """
    by = scan_key(edges)
    rows = edges.select(*by, F.col(name).alias("name"), F.struct(F.col(seq).alias("s"), F.col(value).alias("v")).alias("p"))
    if by:
        pairs = rows.groupBy(*by, "name").agg(F.array_sort(F.collect_list("p")).alias("pairs"))
    else:
        runs = rows.groupBy("name", F.pmod(F.xxhash64("p"), F.lit(RUNS)).alias("run")).agg(F.array_sort(F.collect_list("p")).alias("sorted"))
        pairs = runs.groupBy("name").agg(F.array_sort(F.flatten(F.collect_list("sorted"))).alias("pairs"))
    return pairs.select(*by, "name", F.transform("pairs", lambda p: p["v"]).alias("declaredRanges"))


def hit(kind: str, severity: Column, reason: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), severity.alias("severity"), reason.alias("reason"))


def version_pinning(ranges: Column) -> Column:
    loose = C.loose_ranges(ranges)
    return F.when(F.size(loose) > 0, hit("version-pinning", F.lit("low"), F.concat(F.lit("Loose version range: "), F.array_join(loose, ", "))))


def install_script(has_script: Column, popular: Column) -> Column:
    severity = F.when(popular, "low").otherwise("high")
    return F.when(has_script, hit("install-script", severity, F.when(popular, "Runs an install script; widely used").otherwise("Runs an install script; not widely used")))


def freshness(published: Column, weekly: Column, as_of: Column) -> Column:
    age = F.floor(C.days_between(published, as_of) + 0.5).cast("string")
    return F.when(C.is_fresh(published, weekly, as_of), hit("freshness", F.lit("medium"), F.concat(F.lit("Published "), age, F.lit(" days ago, few downloads"))))


def licence(text: Column) -> Column:
    severity = C.license_severity(text)
    return F.when(severity.isNotNull(), hit("license", severity, F.concat(F.lit("Licence: "), C.license_id(text))))


def deprecation(text: Column) -> Column:
    return F.when(text.isNotNull() & (text != ""), hit("deprecated", F.lit("high"), F.concat(F.lit("Deprecated: "), text)))


def nearest_popular(names: DataFrame, popular: DataFrame, name: str = "name") -> DataFrame:
    """(name, near, distance): for each distinct name that is not popular, the nearest popular name within
    one edit (names of up to 5 letters) or two; ties go to the name of smaller rank.

    Names within two edits share a variant with at most two letters deleted, so both sides emit their
    deletion variants and meet in an equi-join; no name is held against all others.
    """
    limit = lambda c: F.when(F.length(c) <= 5, 1).otherwise(2)
    asked = names.select(F.col(name).alias("name")).where(F.length("name") >= 3).distinct()
    asked = asked.join(popular.select(F.col("name").alias("p")), F.col("name") == F.col("p"), "left_anti")
    left = asked.select("name", F.explode(deletions(F.col("name"), 2)).alias("variant"))
    right = popular.select(F.col("name").alias("near"), "rank", F.explode(deletions(F.col("name"), 2)).alias("variant"))
    met = left.join(right, "variant").select("name", "near", "rank").distinct()
    far = met.withColumn("distance", F.levenshtein("name", "near", 2)).where((F.col("distance") >= 1) & (F.col("distance") <= limit(F.col("name"))))
    best = far.groupBy("name").agg(F.min(F.struct("distance", "rank", "near")).alias("b"))
    return best.select("name", F.col("b.near").alias("near"), F.col("b.distance").alias("distance"))


def deletions(text: Column, times: int) -> Column:
    """The distinct texts left when up to so many letters are deleted."""
    out = F.array(text)
    for _ in range(times):
        out = F.array_distinct(
            F.concat(out, F.flatten(F.transform(out, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1))))))
        )
    return out


def flag_members(rows: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with whether their key is among the members'."""
    known = members.select(F.col(key).alias("_member")).distinct()
    return rows.join(known, F.col(key) == F.col("_member"), "left").withColumn(flag, F.col("_member").isNotNull()).drop("_member")


def enrich(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows joined to facts of their key; facts are reduced to the last of each key by seq if they have one."""
    if "seq" in facts.columns:
        facts = facts.groupBy(key).agg(*[F.max_by(c, "seq").alias(c) for c in facts.columns if c not in (key, "seq")])
    return rows.join(facts, key, "left")


def upsert(rows: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """One row for each key (and scan): the values of its last row by seq, at the place (seq) of its first."""
    by = [*scan_key(rows), *key]
    others = [c for c in rows.columns if c not in (*by, seq)]
    return rows.groupBy(*by).agg(F.min(seq).alias(seq), F.max_by(F.struct(*others), seq).alias("_last")).select(*by, seq, "_last.*")


def keep_first(rows: DataFrame, same: list[str], order: str) -> DataFrame:
    """(order, copies) of the first of the rows that are equal in some columns, by a total order, and how many they are.

    Rows meet by the SHA-256 of what they say, so that long texts are not shuffled; nulls differ from empty texts.
    """
    by = scan_key(rows)
    digest = F.sha2(F.to_json(F.struct(*same), {"ignoreNullFields": "false"}), 256).alias("digest")
    return rows.select(*by, digest, order).groupBy(*by, "digest").agg(F.min(order).alias(order), F.count("*").alias("copies")).drop("digest")


def anomalies(parts: DataFrame, popular: DataFrame, registry: DataFrame, downloads: DataFrame, as_of: Column) -> DataFrame:
    """((scan,) purl, seq, type, severity, reason) of all detectors, in their fixed order; freshness is asked only where
    no other detector of the lockfile has a hit. Popular names, registry and downloads are the same for all scans."""
    near = nearest_popular(parts, popular).withColumnRenamed("name", "_n")
    rows = flag_members(parts, popular.select("name"), "name", "popular").join(near, F.col("name") == F.col("_n"), "left")
    typo = F.when(F.col("near").isNotNull(), hit("typosquat", F.lit("high"), F.concat(F.lit("Looks like "), F.col("near"))))
    rows = rows.withColumn("static", F.array_compact(F.array(typo, version_pinning(F.col("declaredRanges")), install_script(F.col("hasInstallScript"), F.col("popular")))))
    rows = enrich(enrich(rows, registry, "name"), downloads, "name")
    new = F.when(F.size("static") == 0, freshness(F.col("published"), F.col("weekly"), as_of))
    found = F.concat("static", F.array_compact(F.array(new, licence(F.col("license")), deprecation(F.col("deprecated")))))
    by = scan_key(parts)
    return rows.select(*by, "purl", F.posexplode(found).alias("seq", "h")).select(*by, "purl", "seq", "h.*")


def detector_counts(found: DataFrame) -> DataFrame:
    """Hits of each detector, by scan if there are several: what a scan logs of its detectors (typosquat and freshness among them)."""
    return found.groupBy(*scan_key(found), "type").agg(F.count("*").alias("hits"))


def fact_counts(parts: DataFrame, facts: DataFrame, key: str = "name") -> DataFrame:
    """How many distinct names were asked, answered, and not answered (errors count as no answer)."""
    names = parts.select(key).distinct().join(facts.select(F.col(key).alias("_fact")).distinct(), F.col(key) == F.col("_fact"), "left")
    return names.agg(F.count("*").alias("asked"), F.count("_fact").alias("answered"), F.count(F.when(F.col("_fact").isNull(), 1)).alias("errors"))


def with_hits(parts: DataFrame, vulns: DataFrame, found: DataFrame) -> DataFrame:
    """Components with the arrays of their purl's vulnerabilities and anomalies; rows of one purl (and scan) share them."""
    by = scan_key(parts, vulns, found)
    ids = vulns.groupBy(*by, "purl").agg(F.array_sort(F.collect_list("vuln_id")).alias("vulns"))
    hits = found.groupBy(*by, "purl").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "severity", "reason"))).alias("hits"))
    rows = parts.join(ids, [*by, "purl"], "left").join(hits, [*by, "purl"], "left")
    return rows.withColumns({"vulns": F.coalesce("vulns", F.array().cast("array<string>")), "hits": F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType))})


def worst_bucket(has_vuln: Column, severities: Column) -> Column:
    """Exclusive bucket: any vulnerability (or hit of that severity) is critical; else the worst of the severities; low for any other hit."""
    holds = lambda s: F.array_contains(severities, s)
    return F.when(has_vuln | holds("critical"), "critical").when(holds("high"), "high").when(holds("medium"), "medium").when(F.size(severities) > 0, "low")


def risk_summary(rows: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Counts of components by bucket, flagged and in all; a row for each scan if there are several."""
    count = lambda s: F.count(F.when(F.col(bucket) == s, 1)).alias(s)
    return rows.groupBy(*scan_key(rows)).agg(*[count(s) for s in rules.SEVERITIES], F.count(bucket).alias("flaggedCount"), F.count("*").alias("totalComponents"))


def type_histogram(rows: DataFrame) -> DataFrame:
    by = scan_key(rows)
    return rows.select(*by, F.explode("hits").alias("h")).groupBy(*by, F.col("h.type").alias("type")).agg(F.count("*").alias("n"))


def chunks(rows: DataFrame, order: list, size: int) -> DataFrame:
    """rows with the number of their chunk of that size. Positions come from the counts of range
    partitions, so no row is numbered in one task; only a count per partition is gathered."""
    return with_position(rows, order, "position").withColumn("chunk", F.floor(F.col("position") / size)).drop("position")


def properties(hits: str) -> Column:
    """An array of anomalies as CycloneDX properties."""
    return F.transform(hits, lambda h: F.struct(F.concat(F.lit("anomaly:"), h["type"]).alias("name"), F.concat(h["severity"], F.lit(" — "), h["reason"]).alias("value")))


def component_struct(with_hits: bool = True) -> Column:
    """A component of with_hits() as a CycloneDX struct, its anomalies last or left out; null fields are left out when written as JSON."""
    shown = [F.when(F.size("hits") > 0, properties("hits")).alias("properties")] if with_hits else []
    return F.struct(
        F.lit("library").alias("type"), "name", "version", "purl", F.col("purl").alias("bom-ref"), F.when(F.col("dev"), "optional").otherwise("required").alias("scope"), *shown,
    )


def documents(rows: DataFrame) -> DataFrame:
    """(scan, document): one CycloneDX document as JSON text for each scan, from with_hits(). A document holds
    the components of one lockfile, so its size does not grow with the number of scans; rows without a scan
    column are of one scan, whose name is empty."""
    rows = rows if scan_key(rows) else rows.withColumn(SCAN, F.lit(""))
    vuln = F.transform("vulns", lambda v: F.struct(v.alias("id"), F.array(F.struct(F.col("purl").alias("ref"))).alias("affects")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", component_struct().alias("c"), vuln.alias("v")))), lambda x: F.struct(x["c"].alias("c"), x["v"].alias("v")))
    one = rows.groupBy(SCAN).agg(listed.alias("x"))
    body = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), F.col("x.c").alias("components"), F.flatten("x.v").alias("vulnerabilities"))
    return one.select(SCAN, F.to_json(body).alias("document"))
