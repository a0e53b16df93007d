"""Readers: source trees, lockfiles, BOM documents, registry snapshots, corpora; and writers of JSON and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbom.functions import columns as C
from quillbom.functions import rules
from quillbom.functions.keys import scan_key

BOM_SCHEMA = (
    "components array<struct<name string, version string, purl string, `bom-ref` string, scope string, direct boolean, "
    "properties array<struct<name string, value string>>>>, vulnerabilities array<struct<id string, affects array<struct<ref string>>>>"
)


def files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(path relative to root, ext, length, content) of every file below root, in any store Spark reads."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^[a-zA-Z]+:/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    relative = F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)
    return found.select(relative.alias("path"), C.extension(F.col("path")).alias("ext"), "length", *(["content"] if content else []))


def code_files(tree: DataFrame) -> DataFrame:
    """Source files to be parsed: by extension, without tests, skipped folders and declaration files;
    packages under the root's node_modules come in when their name tells of cryptography, four folders deep at most."""
    own = ~C.in_skipped_dir(F.col("path"))
    package = F.regexp_extract("path", r"^node_modules/((?:@[^/]+/)?[^/]+)/", 1)
    inner = F.regexp_replace("path", r"^node_modules/(?:@[^/]+/)?[^/]+/", "")
    vendored = (package != "") & package.rlike(r"(?i)crypto|bcrypt|jwt|jsonwebtoken|jose|forge|sodium|nacl|elliptic|argon2|scrypt|pbkdf2|hash|cipher") & (F.size(F.split(inner, "/")) <= 5)
    vendored = vendored & ~F.arrays_overlap(F.split(inner, "/"), F.array(*[F.lit(x) for x in ("node_modules", ".git", "test", "tests")]))
    known = F.col("ext").isin(rules.SCANNED_EXTENSIONS) & ~F.endswith("path", F.lit(".d.ts")) & ~C.is_test_path(F.col("path"))
    return tree.where(known & (own | (vendored & F.col("ext").isin("js", "mjs", "cjs"))))


def candidate_files(tree: DataFrame) -> DataFrame:
    """Source files that are searched for candidate lines: extensions in any case, nothing under a node_modules folder."""
    return code_files(tree).where(~F.array_contains(F.split("path", "/"), "node_modules"))


def pem_files(tree: DataFrame) -> DataFrame:
    small = F.col("ext").isin(rules.KEY_EXTENSIONS) | (F.col("length") < rules.MAX_PEM_BYTES)
    return tree.where(small & ~C.in_skipped_dir(F.col("path")) & ~C.is_test_path(F.col("path")))


def constant_files(tree: DataFrame) -> DataFrame:
    return tree.where((F.col("length") <= rules.MAX_CONSTANT_BYTES) & ~C.in_skipped_dir(F.col("path")) & ~C.is_test_path(F.col("path")))


def lockfile(tree: DataFrame) -> DataFrame:
    """The root lockfile's text; its absence is an error when the result is read."""
    return tree.where(F.col("path") == "package-lock.json").agg(F.first(C.as_text(F.col("content"))).alias("text")).select(
        F.when(F.col("text").isNull(), F.raise_error(F.lit("No package-lock.json found"))).otherwise(F.col("text")).alias("text")
    )


def lock_entries(locks: DataFrame, text: str = "text", scan: str | None = None) -> DataFrame:
    """One row per package entry of lockfiles: (scan,) seq, path and the entry's fields, in the order of the text. Old lockfiles are an error.

    The text is parsed once to a variant, whose entries are generated one by one; no map of all
    entries is built. A variant has its keys sorted, so an entry's place in the text is looked up
    in the sorted list of keys.
    """
    by = [scan] if scan else []
    lock = F.try_parse_json(text)
    keys = F.json_object_keys(F.get_json_object(text, "$.packages"))
    places = F.transform(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), lambda e: e["i"])
    parsed = locks.select(*by, lock.alias("_lock"), places.alias("_places"))
    packages = F.try_variant_get("_lock", "$.packages", "variant")
    bad = F.col("_lock").isNull() | F.coalesce(F.try_variant_get("_lock", "$.lockfileVersion", "int") < 2, F.lit(True)) | packages.isNull() | F.col("_places").isNull()
    parsed = parsed.select(*by, "_places", F.when(bad, F.raise_error(F.lit("Unsupported lockfile")).cast("variant")).otherwise(packages).alias("_packages"))
    entries = parsed.lateralJoin(locks.sparkSession.tvf.variant_explode(F.col("_packages").outer()))
    get = lambda name, kind: F.try_variant_get("value", f"$.{name}", kind).alias(name)
    return entries.select(
        *by, F.get("_places", F.col("pos")).alias("seq"), F.col("key").alias("path"), *[get(c, "string") for c in ("version", "resolved", "integrity")],
        *[get(c, "boolean") for c in ("dev", "optional", "hasInstallScript")], get("dependencies", "map<string,string>"),
    )


def declared_names(manifests: DataFrame, text: str = "text") -> DataFrame:
    """((scan,) name): the names that manifests declare as dependencies or for development, each once; what can't be read declares none."""
    by = scan_key(manifests)
    names = lambda section: F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{section}")), F.array().cast("array<string>"))
    return manifests.select(*by, F.explode(F.array_union(names("dependencies"), names("devDependencies"))).alias("name")).distinct()


def bom_packages(boms: DataFrame, direct_names: DataFrame | None = None) -> DataFrame:
    """Packages of parsed BOM documents, with the vulnerabilities that affect them."""
    by = scan_key(boms) if direct_names is None else scan_key(boms, direct_names)
    parts = boms.select(*by, F.posexplode("components").alias("seq", "c"))
    hits = boms.select(*by, F.explode("vulnerabilities").alias("v")).select(*by, F.col("v.id").alias("id"), F.explode("v.affects.ref").alias("ref"))
    hits = hits.groupBy(*[F.col(c).alias(f"_{c}") for c in by], "ref").agg(F.collect_list("id").alias("osvCves"))
    ref = F.col("c")["bom-ref"]
    named = F.coalesce(F.col("c.scope") == "required", F.lit(False)) | F.coalesce(F.col("c.direct"), F.lit(False))
    dev = F.exists(F.coalesce("c.properties", F.array()), lambda p: F.endswith(p["name"], F.lit("development")) & (p["value"] == "true"))
    same = ref == F.col("ref")
    for c in by:
        same &= F.col(c) == F.col(f"_{c}")
    found = parts.join(hits, same, "left").select(
        *by, "seq", F.col("c.name").alias("name"), F.col("c.version").alias("version"), F.col("c.purl").alias("purl"),
        F.when(F.startswith("c.purl", F.lit("pkg:npm/")), "npm").otherwise("unknown").alias("ecosystem"),
        F.coalesce(dev, F.lit(False)).alias("devDependency"), named.alias("isDirect"), F.coalesce("osvCves", F.array().cast("array<string>")).alias("osvCves"),
    )
    if direct_names is not None:
        named = direct_names.select(*by, "name").distinct().withColumn("_direct", F.lit(True))
        found = found.join(named, [*by, "name"], "left").withColumn("isDirect", F.col("isDirect") | F.coalesce("_direct", F.lit(False))).drop("_direct")
    return found


def read_bom(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOM_SCHEMA).json(path, multiLine=True)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled snippets, one JSON object a line."""
    return spark.read.schema("text string, algorithm_family string, primitive string, source_repo string").json(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of registry documents: (name, latest, published, license, deprecated, notFound)."""
    raw = spark.read.schema("name string, packument string, notFound boolean").json(path)
    return registry_fields(raw)


def registry_fields(raw: DataFrame) -> DataFrame:
    """Fields of registry documents given as JSON text in packument."""
    doc = F.try_parse_json("packument")
    get = lambda path: F.try_variant_get(doc, path, "string")
    latest = get("$['dist-tags'].latest")
    times = F.from_json(F.get_json_object("packument", "$.time"), "map<string,string>")
    versions = F.from_json(F.get_json_object("packument", "$.versions"), "map<string,struct<deprecated:string>>")
    plain = F.when(F.schema_of_variant(F.try_variant_get(doc, "$.license", "variant")) == "STRING", get("$.license"))
    licence = F.coalesce(F.nullif(plain, F.lit("")), get("$.license.type"), get("$.licenses[0].type"), F.lit("UNKNOWN"))
    deprecated = F.coalesce(F.nullif(F.try_element_at(versions, latest)["deprecated"], F.lit("")), F.nullif(get("$.deprecated"), F.lit("")))
    return raw.select("name", latest.alias("latest"), F.try_element_at(times, latest).try_cast("timestamp").alias("published"), licence.alias("license"), deprecated.alias("deprecated"), F.coalesce("notFound", F.lit(False)).alias("notFound"))


def downloads(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of weekly downloads: (name, weekly); what could not be read counts as 0, as an error of the service does."""
    return spark.read.schema("name string, downloads long").json(path).select("name", F.coalesce("downloads", F.lit(0)).alias("weekly"))


def write_scan(documents: DataFrame, correlation: DataFrame, path: str) -> None:
    """The documents of scans as lines of text, and their correlation beside them as JSON."""
    write_text(documents.select(F.col("document").alias("value")), f"{path}/cbom")
    write_json(correlation, f"{path}/correlation.json")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)
