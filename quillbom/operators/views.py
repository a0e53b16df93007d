"""Views for people: filtered and sorted tables, summaries, remediation, exported documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbom.functions import columns as C
from quillbom.functions import advice as texts
from quillbom.functions import rules
from quillbom.functions.keys import SCAN, scan_key


def component_view(rows: DataFrame, search: str = "", severity: str | None = None, kind: str | None = None, only_vulns: bool = False, only_flagged: bool = False, sort: str = "name", down: bool = False) -> DataFrame:
    """Components of with_hits() that pass the filters, sorted; the sort by flags starts with the most."""
    rows = rows.withColumn("severity", worst(F.col("vulns"), F.col("hits"))).withColumn("flagCount", F.size("hits"))
    tests = [F.contains(F.lower("name"), F.lit(search.lower()))] if search else []
    tests += [F.col("severity") == severity] if severity else []
    tests += [F.exists("hits", lambda h: h["type"] == kind)] if kind else []
    tests += [F.size("vulns") > 0] if only_vulns else []
    tests += [(F.size("vulns") > 0) | (F.size("hits") > 0)] if only_flagged else []
    for t in tests:
        rows = rows.where(t)
    keys = {"name": F.collate("name", "UNICODE"), "version": F.collate("version", "UNICODE"), "flags": -F.col("flagCount"), "severity": C.rank_of(F.col("severity"), rules.SEVERITIES)}
    key = keys[sort]
    return rows.orderBy(key.desc() if down else key.asc(), "seq")


def worst(vulns: Column, hits: Column) -> Column:
    ranks = F.array_min(F.transform(hits, lambda h: C.rank_of(h["severity"], rules.SEVERITIES)))
    return F.when(F.size(vulns) > 0, "critical").otherwise(F.try_element_at(F.array(*[F.lit(s) for s in rules.SEVERITIES]), ranks))


def asset_view(rows: DataFrame, search: str = "", kind: str | None = None, tier: str | None = None, level: int | None = None, review: bool = False, sort: str = "name", down: bool = False) -> DataFrame:
    rows = rows.withColumn("tier", C.confidence_tier(F.col("confidence")))
    if search:
        rows = rows.where(F.contains(F.lower("name"), F.lit(search.lower())) | F.contains(F.lower("filePath"), F.lit(search.lower())))
    for column, value in (("assetType", kind), ("tier", tier), ("nistQuantumLevel", level)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if review:
        rows = rows.where(F.col("tier").isin("low", "medium"))
    keys = {"name": F.collate("name", "UNICODE"), "type": F.col("assetType"), "confidence": C.rank_of(F.col("tier"), rules.CONFIDENCE_TIERS), "level": F.col("nistQuantumLevel")}
    return rows.orderBy(keys[sort].desc() if down else keys[sort].asc(), "filePath", "line")


def histogram(rows: DataFrame, column: str, domain: list) -> DataFrame:
    """(value, n) for every value of a closed domain, zeros included."""
    values = rows.sparkSession.createDataFrame([(v,) for v in domain], f"value {rows.schema[column].dataType.simpleString()}")
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return values.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def bar_shares(counts: DataFrame) -> DataFrame:
    """counts (value, n) with n over the largest n, at least 1; the largest is one number, joined back."""
    top = counts.agg(F.greatest(F.lit(1), F.coalesce(F.max("n"), F.lit(0))).alias("top"))
    return counts.crossJoin(F.broadcast(top)).withColumn("share", F.col("n") / F.col("top")).drop("top")


def advice(name: Column, level: Column, exposure: Column, parameter: Column, asset: Column) -> Column:
    """struct(severity, topic, summary, actions, target) of what to do about an asset; the first line that holds decides."""
    n, p = F.upper(F.coalesce(name, F.lit(""))), F.upper(F.coalesce(parameter, F.lit("")))
    q = F.coalesce(level, F.lit(0))

    def say(topic: str) -> Column:
        severity, target, summary, actions = texts.ADVICE[topic]
        return F.struct(
            F.lit(severity).alias("severity"), F.lit(topic).alias("topic"), F.lit(summary).alias("summary"), F.array(*[F.lit(a) for a in actions]).alias("actions"), F.lit(target).alias("target")
        )

    weak = C.any_of(p, ["SHA1", "MD5"]) | C.any_of(n, ["SHA1", "MD5"])
    return (
        F.when(exposure.isin("CRITICAL", "HIGH"), say("exposed secret"))
        .when((q == 0) & C.any_of(n, ["EC", "CURVE"]), say("elliptic curve"))
        .when((q == 0) & F.contains(n, F.lit("RSA")), say("factoring"))
        .when(q == 0, say("classical asymmetric"))
        .when(weak, say("weak digest"))
        .when(q == 1, say("short key"))
        .when(q >= 3, say("resistant"))
        .when(asset == "certificate", say("certificate"))
        .otherwise(say("good practice"))
    )


def explained(rows: DataFrame, level: str = "nistQuantumLevel") -> DataFrame:
    """rows with the explanation of their security level: title, algorithms, attack, recommendation. Six fixed rows, as expressions."""
    table = F.create_map(*[x for k, v in texts.LEVELS.items() for x in (F.lit(k), F.struct(*[F.lit(t).alias(c) for c, t in zip(("title", "algorithms", "attack", "recommendation"), v, strict=True)]))])
    return rows.withColumn("explanation", F.try_element_at(table, F.col(level).cast("int")))


def checklist(rows: DataFrame) -> DataFrame:
    """((scan,) position, id, priority, affected, names, title, description, fix): up to five tasks, each where it concerns any asset; one pass."""
    by = scan_key(rows)
    n, p = F.upper(F.coalesce("name", F.lit(""))), F.upper(F.coalesce("parameterSet", F.lit("")))
    weak = C.any_of(p, ["SHA1", "MD5"]) | C.any_of(n, ["SHA1", "MD5"])
    tests = {
        "exposed-secrets": F.col("exposureRisk").isin("CRITICAL", "HIGH"), "post-quantum": F.col("nistQuantumLevel") == 0, "weak-digests": weak,
        "short-keys": F.col("nistQuantumLevel") == 1, "low-confidence": C.confidence_tier(F.col("confidence")) == "low",
    }
    hits = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(i).alias("position"), F.lit(t).alias("id"), F.lit(texts.TASKS[t][0]).alias("priority"))) for i, (t, test) in enumerate(tests.items(), 1)]))
    each = rows.select(*by, "name", F.explode(hits).alias("t"))
    per_name = each.groupBy(*by, "t", "name").agg(F.count("*").alias("n"))  # distinct names first, so that a task gathers names, not assets
    tasks = per_name.groupBy(*by, "t").agg(F.sum("n").alias("affected"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    word = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for t, v in texts.TASKS.items() for x in (t, v[i])]), F.col("t.id"))
    noun = F.concat(word(2), F.when(F.col("affected") > 1, "s").otherwise(""))
    title = F.concat_ws(" ", word(1), F.col("affected").cast("string"), noun, F.nullif(word(3), F.lit("")))
    return tasks.select(*by, "t.position", "t.id", "t.priority", "affected", "names", title.alias("title"), F.replace(word(4), F.lit("{names}"), F.col("names")).alias("description"), word(5).alias("fix"))


def markdown(tasks: DataFrame, repository: str | None = None) -> DataFrame:
    """(value): the lines of the plan as one text: a heading, a section for each priority that has tasks, a box for each task."""
    item = F.concat(F.lit("- [ ] **"), F.col("title"), F.lit("**\n  - "), F.col("description"), F.lit("\n  - **Fix:** "), F.col("fix"), F.lit("\n"))
    listed = tasks.agg(F.array_sort(F.collect_list(F.struct("position", "priority", item.alias("text")))).alias("tasks"))  # five tasks at most
    head = f"## {texts.PLAN_TITLE}\n" + (f"*Target repository:* {repository}\n" if repository else "") + "\n"
    of = lambda priorities: F.transform(F.filter("tasks", lambda t: t["priority"].isin(*priorities)), lambda t: t["text"])
    sections = [F.when(F.size(of(p)) > 0, F.concat(F.lit(f"### {name}\n"), F.array_join(of(p), ""), F.lit("\n"))).otherwise("") for name, p in texts.SECTIONS.items()]
    body = F.when(F.size("tasks") == 0, texts.NOTHING_TO_DO + "\n").otherwise(F.concat(*sections))
    return listed.select(F.concat(F.lit(head), body).alias("value"))


def cbom_summary(rows: DataFrame, as_of: Column, given: DataFrame | None = None) -> DataFrame:
    """One row (for each scan): assets in all, zero-filled counts by type, level, exposure and confidence, and those to review,
    expiring and exposed. Exposure counts of given (scan, exposure<Class>), the server's own, come first where there are any."""
    by = scan_key(rows) if given is None else scan_key(rows, given)
    tier = C.confidence_tier(F.col("confidence"))
    count = lambda test, name: F.count(F.when(test, 1)).alias(name)
    title = lambda v: "".join(w.title() for w in str(v).split("-"))
    until = F.col("validTo") if "validTo" in rows.columns else F.lit(None).cast("string")
    vendor = F.startswith("filePath", F.lit("node_modules/"))
    found = rows.groupBy(*by).agg(
        F.count("*").alias("totalAssets"), *[count(F.col("assetType") == v, f"type{title(v)}") for v in rules.ASSET_TYPE_ORDER], *[count(F.col("nistQuantumLevel") == v, f"level{v}") for v in rules.QUANTUM_LEVELS],
        *[count(F.coalesce("exposureRisk", F.lit("NONE")) == v, f"exposure{v.title()}") for v in rules.EXPOSURES], *[count(tier == v, f"confidence{title(v)}") for v in rules.CONFIDENCE_TIERS],
        count(tier == "low", "flaggedForReview"), count(C.expires_soon(until.try_cast("timestamp"), as_of), "certsExpiringSoon"), count(F.coalesce(vendor, F.lit(False)), "attributedToPackage"), count(~F.coalesce(vendor, F.lit(False)), "firstPartySource"),
    )
    names = [f"exposure{v.title()}" for v in rules.EXPOSURES]
    if given is not None:
        renamed = given.select(*by, *[F.col(n).alias(f"_{n}") for n in names])
        found = found.join(renamed, by, "left") if by else found.join(F.broadcast(renamed.limit(1)), F.lit(True), "left")  # one row
        found = found.withColumns({n: F.coalesce(f"_{n}", n) for n in names}).drop(*[f"_{n}" for n in names])
    return found.withColumn("exposedSecrets", F.col("exposureCritical") + F.col("exposureHigh"))


def type_counts(rows: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(type, n): the counts that the server gave, or those of the rows' hits where it gave none."""
    from quillbom.operators import sbom

    own = sbom.type_histogram(rows)
    if given is None:
        return own
    both = own.join(given.withColumnRenamed("n", "_given"), "type", "full")
    return both.select("type", F.coalesce("_given", "n").alias("n"))


# Assets as documents show them


ASSET = (
    "name string, `bom-ref` string, bomRef string, assetType string, sourceFile string, filePath string, sourceLine int, line int, sourceContext string, confidence string, quantumRisk string, exposureRisk string, "
    "nistQuantumLevel int, quantumSecurityLevel int, evidenceSources array<string>, properties array<struct<name string, value string>>, "
    "cryptoProperties struct<assetType string, algorithmProperties struct<primitive string, parameterSetIdentifier string, mode string, nistQuantumSecurityLevel int>, certificateProperties struct<subjectName string, notValidAfter string>>"
)


def flat_assets(assets: DataFrame, prefix: str = "quillbom:") -> DataFrame:
    """Assets of the shape ASSET as flat rows: nested fields, properties of the document and flat fields, in the order that each field says."""
    bag = F.map_from_entries(F.filter(F.transform(F.array_distinct(F.transform(F.coalesce("properties", F.array()), lambda p: p["name"])), lambda n: F.struct(n.alias("key"), F.get(F.filter("properties", lambda p: p["name"] == n), F.lit(0))["value"].alias("value"))), lambda e: e["key"].isNotNull()))
    prop = lambda n: F.try_element_at(F.col("_bag"), F.lit(prefix + n))
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    nested = F.col("cryptoProperties.algorithmProperties")
    level = F.coalesce(nested["nistQuantumSecurityLevel"], prop("nistQuantumLevel").try_cast("int"), "nistQuantumLevel", "quantumSecurityLevel", F.when(F.col("quantumRisk").isin("CRITICAL", "HIGH"), 0).otherwise(1))
    raw = F.coalesce("confidence", prop("confidence"))
    score = F.nullif(F.regexp_extract(raw, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).cast("double")
    sources = F.transform(F.filter(F.coalesce("properties", F.array()), lambda p: F.startswith(p["name"], F.lit(prefix + "evidence:"))), lambda p: F.replace(p["name"], F.lit(prefix + "evidence:"), F.lit("")))
    shown = F.transform(sources, lambda s: F.when(s == "sbom_sca", "sca").when(s == "vectorSearch", "embedding").when(s == "llm", "llm").otherwise("static"))
    rows = assets.withColumn("_bag", bag)
    found = rows.select(
        F.coalesce("bom-ref", "bomRef").alias("bomRef"), "name", F.coalesce("cryptoProperties.assetType", "assetType").alias("assetType"),
        F.coalesce(text("sourceFile"), text("filePath"), prop("filePath")).alias("sourceFile"), F.coalesce(F.nullif("sourceLine", F.lit(0)), "line", prop("line").try_cast("int")).alias("sourceLine"),
        F.coalesce(text("sourceContext"), prop("sourceContext"), F.lit("live")).alias("sourceContext"), level.alias("nistQuantumLevel"),
        F.when(raw.isin(rules.CONFIDENCE_TIERS), raw).when(score.isNull(), "low").otherwise(C.confidence_tier(score)).alias("confidence"), score.alias("confidenceScore"),
        F.coalesce("quantumRisk", prop("quantumRisk")).alias("quantumRisk"), F.coalesce("exposureRisk", prop("exposureRisk"), F.lit("NONE")).alias("exposureRisk"),
        F.array_distinct(F.when(F.size(F.coalesce("evidenceSources", F.array().cast("array<string>"))) > 0, F.col("evidenceSources")).otherwise(shown)).alias("evidenceSources"),
        nested["primitive"].alias("primitive"), nested["parameterSetIdentifier"].alias("parameterSet"), nested["mode"].alias("mode"), F.col("cryptoProperties.certificateProperties.notValidAfter").alias("validTo"),
    )
    empty = (F.size("evidenceSources") == 0) & F.lit(True)
    return found.withColumn("evidenceSources", F.when(empty, F.array(F.lit("static"))).otherwise(F.col("evidenceSources")))


def document_assets(document: Column) -> Column:
    """The assets of a scan's answer: its own list, else those of its CBOM, else the components of that type."""
    parse = lambda path: F.from_json(F.get_json_object(document, path), f"array<struct<type string, {ASSET}>>")
    return F.coalesce(parse("$.cryptoComponents"), parse("$.cbom.components"), F.filter(F.coalesce(parse("$.components"), F.array().cast(f"array<struct<type string, {ASSET}>>")), lambda c: c["type"] == "cryptographic-asset"))


def type_label(kind: Column) -> Column:
    """A type in words: each dashed part with a capital."""
    return F.initcap(F.replace(kind, F.lit("-"), F.lit(" ")))


def primitive_label(primitive: Column, parameter: Column, mode: Column) -> Column:
    return F.when(primitive.isNull() | (primitive == ""), "—").otherwise(F.concat_ws(" / ", primitive, F.nullif(parameter, F.lit("")), F.nullif(mode, F.lit(""))))


def source_label(path: Column, line: Column) -> Column:
    return F.when(path.isNull() | (path == ""), "Location unavailable").when(F.coalesce(line, F.lit(0)) == 0, path).otherwise(F.concat(path, F.lit(":"), line.cast("string")))


def file_link(repository: Column, path: Column, line: Column) -> Column:
    """Where a file's line is shown on the hosting site."""
    base = F.regexp_replace(repository, r"(\.git)?/*\z", "")
    anchor = F.when(F.coalesce(line, F.lit(0)) > 0, F.concat(F.lit("#L"), line.cast("string"))).otherwise("")
    return F.when(path.isNotNull() & (path != ""), F.concat(base, F.lit("/blob/HEAD/"), path, anchor))


def issue_link(identifier: Column) -> Column:
    return F.concat(F.when(F.startswith(identifier, F.lit("GHSA-")), "https://github.com/advisories/").otherwise("https://osv.dev/vulnerability/"), identifier)


def anomaly_types(rows: DataFrame) -> DataFrame:
    """((scan,) types): the distinct types of the hits of with_hits(), sorted, as a filter offers them."""
    by = scan_key(rows)
    each = rows.select(*by, F.explode("hits.type").alias("type"))
    return each.groupBy(*by).agg(F.array_sort(F.collect_set("type")).alias("types"))


def affected_first(components: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """components (bom-ref as ref) with the ids of the vulnerabilities (id, affects) that name them first among what they affect.

    This is what is shown of a document: a vulnerability stands with one component, the first.
    """
    by = scan_key(components, vulnerabilities)
    first = vulnerabilities.select(*by, "id", F.get("affects", F.lit(0))["ref"].alias("ref")).where("ref is not null")
    ids = first.groupBy(*by, "ref").agg(F.array_sort(F.collect_list("id")).alias("vulns"))
    return components.join(ids, [*by, "ref"], "left").withColumn("vulns", F.coalesce("vulns", F.array().cast("array<string>")))


def exported(parts: DataFrame, crypto: bool, at: Column, repositories: DataFrame | None = None, tool: str = "quillbom") -> DataFrame:
    """(scan, document): the exported document of each scan, with only its cryptographic assets, or without them.

    parts has scan, ref (its place in the document), type, and what else a component shows; dependsOn, if
    there is such a column, becomes the document's dependencies. repositories names each scan's address.
    Serial numbers are hashes of scan, kind and time, so that exporting again gives the same document.
    """
    parts = parts if scan_key(parts) else parts.withColumn(SCAN, F.lit(""))
    is_crypto = F.col("type") == "cryptographic-asset"
    kept = parts.where(is_crypto if crypto else ~is_crypto)
    shown = F.struct(*[F.col("ref").alias("bom-ref") if c == "ref" else F.col(c) for c in parts.columns if c not in (SCAN, "dependsOn")])
    none = F.lit(None).cast("array<struct<ref:string,dependsOn:array<string>>>")
    edges = F.collect_list(F.when(F.size("dependsOn") > 0, F.struct("ref", "dependsOn"))) if "dependsOn" in parts.columns else none
    grouped = parts.select(SCAN).distinct().join(kept.groupBy(SCAN).agg(F.array_sort(F.collect_list(shown)).alias("components"), F.array_sort(edges).alias("edges")), SCAN, "left")
    where = repositories.select(SCAN, "repository") if repositories is not None else grouped.select(SCAN, F.lit(None).cast("string").alias("repository"))
    grouped = grouped.join(where, SCAN, "left")
    key = F.sha1(F.concat_ws("|", F.lit("cbom" if crypto else "sbom"), SCAN, at.cast("string")).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(key, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    tools = F.struct(F.array(F.struct(F.lit("application").alias("type"), F.lit(tool).alias("name"), F.lit("1.0.0").alias("version"))).alias("components"))
    component = F.when(F.col("repository").isNotNull(), F.struct(F.lit("application").alias("type"), F.col("repository").alias("name")))
    body = F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.7").alias("specVersion"), F.lit(1).alias("version"), F.concat(F.lit("urn:uuid:"), uuid).alias("serialNumber"),
        F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), tools.alias("tools"), component.alias("component")).alias("metadata"),
        F.coalesce("components", F.array().cast(grouped.schema["components"].dataType)).alias("components"), F.when(F.size("edges") > 0, F.col("edges")).alias("dependencies"),
    )
    return grouped.select(SCAN, F.to_json(body).alias("document"))
