"""Column expressions: paths, package names, identifiers, decision lists. All of them are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillbom.functions import rules


def half_up(x: Column, digits: int) -> Column:
    """Rounded as floor(x * 10^digits + 0.5) / 10^digits, on doubles."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def any_of(text: Column, parts: list[str]) -> Column:
    """Whether the text holds any of the parts."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def as_text(content: Column) -> Column:
    """Bytes as UTF-8 text; bytes that are none become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


# Paths and packages


def package_name(path: Column) -> Column:
    """What follows the last node_modules/ of a path."""
    return F.element_at(F.split(path, "node_modules/"), -1)


def owning_package(path: Column) -> Column:
    """Name of the package a file in node_modules belongs to, scope included; null elsewhere."""
    name = F.regexp_extract(path, r"^[\s\S]*node_modules/((?:@[^/]+/)?[^/]+)", 1)
    return F.nullif(name, F.lit(""))


def encode_component(text: Column) -> Column:
    """URI component encoding: a form encoding but for the space and ~ ! ( ) '."""
    out = F.url_encode(text)
    for coded, plain in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%28", "("), ("%29", ")"), ("%27", "'")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def purl(name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:npm/"), encode_component(name), F.lit("@"), version)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(?i)[._-](test|spec)\.[a-zA-Z0-9]+\z") | path.rlike(r"(?i)(?:^|/)(?:__tests__|__mocks__|test|tests)/")


def in_skipped_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in rules.SKIPPED_DIRS]))


def context_category(path: Column) -> Column:
    p = F.lower(path)
    production = any_of(p, rules.PRODUCTION_PARTS) | ~F.contains(F.regexp_replace(p, r"^/+|/+\z", ""), F.lit("/"))
    return (
        F.when(any_of(p, rules.TEST_PARTS), "test").when(any_of(p, rules.VENDOR_PARTS), "vendor").when(production, "production").otherwise("unknown")
    )


def line_at(text: Column, position: Column) -> Column:
    """Line number of a 1-based position: line feeds before it, and one."""
    return F.size(F.split(F.substring(text, F.lit(1), position - 1), "\n"))


# Packages' anomalies


def loose_ranges(ranges: Column) -> Column:
    return F.filter(ranges, lambda r: r.rlike(rules.LOOSE_RANGE))


def license_id(text: Column) -> Column:
    """An identifier without blanks and without -or-later or -only; UNKNOWN where there is none."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)-(or-later|only)\z", "")
    return F.when(t == "", "UNKNOWN").otherwise(t)


def license_severity(text: Column) -> Column:
    t = license_id(text)
    return (
        F.when(t.isin(rules.LICENSES_HIGH), "high")
        .when(t.isin(rules.LICENSES_MEDIUM) | (t == "UNKNOWN"), "medium")
        .when(t.isin(rules.LICENSES_FREE), F.lit(None).cast("string"))
        .otherwise("low")
    )


def is_fresh(published: Column, weekly: Column, as_of: Column) -> Column:
    """New and unpopular: under 30 days old and under 100 downloads a week."""
    return (days_between(published, as_of) < 30) & (F.coalesce(weekly, F.lit(0)) < 100)


def days_between(earlier: Column, later: Column) -> Column:
    return (F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))) / F.lit(86400000.0)


def expires_soon(until: Column, as_of: Column, days: int = 90) -> Column:
    left = days_between(as_of, until)
    return F.coalesce((left >= 0) & (left <= days), F.lit(False))


# Identifiers


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def bom_ref(kind: Column, name: Column, path: Column, line: Column, finding_id: Column) -> Column:
    where = F.concat(slug(path), F.lit("-L"), line.cast("string"))
    return F.concat(F.lit("crypto/"), kind, F.lit("/"), slug(name), F.lit("@"), F.coalesce(where, F.substring(F.sha1(finding_id.cast("binary")), 1, 8)))


def fingerprint(block: Column) -> Column:
    return F.substring(F.sha2(block, 256), 1, 16)


def algorithm_identifier(raw: Column) -> Column:
    """struct(family, mode, key_size) of what code calls an algorithm; null for blanks.

    In order: an object literal with a name; a JOSE name; a name whose dashed parts are a key size,
    a mode and the family; a bare digest; else the text in upper case.
    """
    text = F.trim(raw)
    named = F.regexp_extract(text, r"(?i)name\s*:\s*['\"]([\w.-]+)['\"]", 1)
    length = F.nullif(F.regexp_extract(text, r"(?i)length\s*:\s*(\d+)", 1), F.lit(""))
    digest = F.nullif(F.upper(F.regexp_extract(text, r"(?i)hash\s*:\s*['\"]?([\w-]+)['\"]?", 1)), F.lit(""))
    bare = F.lower(F.regexp_replace(text, "^['\"]|['\"]\\z", ""))
    jose, bits = F.regexp_extract(bare, r"^(hs|rs|es|ps)(256|384|512)\z", 1), F.regexp_extract(bare, r"^(?:hs|rs|es|ps)(256|384|512)\z", 1)
    jose_family = F.when(jose == "hs", "HMAC").when(jose == "rs", "RSA").when(jose == "es", "ECDSA").otherwise("RSA-PSS")
    parts = F.split(bare, "-")
    is_mode = lambda p: p.isin(rules.CIPHER_MODES)
    sizes = F.filter(parts, lambda p: p.rlike(r"^\d{2,3}\z"))
    modes = F.filter(parts, lambda p: is_mode(p) & ~p.rlike(r"^\d{2,3}\z"))
    rest = F.upper(F.array_join(F.filter(parts, lambda p: ~p.rlike(r"^\d{2,3}\z") & ~is_mode(p)), "-"))
    make = lambda family, mode=None, size=None: F.struct(
        (family if isinstance(family, Column) else F.lit(family)).alias("family"),
        (mode if mode is not None else F.lit(None).cast("string")).alias("mode"),
        (size if size is not None else F.lit(None).cast("string")).alias("key_size"),
    )
    return (
        F.when(text.isNull() | (text == ""), None)
        .when(named != "", make(F.upper(named), None, F.coalesce(length, digest)))
        .when(jose != "", make(jose_family, F.concat(F.lit("SHA-"), bits)))
        .when(bare == "eddsa", make("EdDSA"))
        .when(bare == "none", make("none"))
        .when(F.contains(bare, F.lit("-")) & (rest != ""), make(rest, F.upper(F.try_element_at(modes, F.lit(-1))), F.try_element_at(sizes, F.lit(-1))))
        .when(bare.rlike(r"^sha\d{3}\z"), make(F.concat(F.lit("SHA-"), F.substring(bare, 4, 3))))
        .when(bare == "md5", make("MD5"))
        .when(bare == "ripemd160", make("RIPEMD-160"))
        .otherwise(make(F.upper(text)))
    )


def key_size(parameter: Column) -> Column:
    """The digits of a parameter as one number; null where there are none."""
    digits = F.regexp_replace(parameter, "[^0-9]", "")
    return F.nullif(digits, F.lit("")).try_cast("decimal(38,0)")


def leading_int(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("bigint")


# Decision lists over findings


def is_unaffected(asset: Column, primitive: Column, material: Column, family: Column) -> Column:
    """Findings that quantum computers have no bearing on: calls without a primitive, random numbers, salts."""
    no_primitive = (asset == "algorithm") & primitive.isNull()
    return no_primitive | F.coalesce(primitive == "drbg", F.lit(False)) | F.coalesce(material == "salt", F.lit(False)) | F.coalesce(family == "CSPRNG", F.lit(False))


def nist_level(asset: Column, primitive: Column, material: Column, family: Column, parameter: Column) -> Column:
    """Security level 0 to 5; the first line that holds decides. family is the family or the name."""
    f = F.upper(F.coalesce(family, F.lit("")))
    p = F.lower(F.coalesce(parameter, F.lit("")))
    stored = asset.isin("related-crypto-material", "certificate")
    size = key_size(parameter)
    own = F.nullif(F.regexp_extract(f, r"(\d{3})", 1), F.lit("")).cast("decimal(38,0)")
    steps = lambda n, cuts: F.coalesce(F.coalesce(*[F.when(n >= least, level) for least, level in cuts], F.when(n.isNotNull(), 0)), F.lit(1))
    derives = F.coalesce(primitive == "kdf", F.lit(False)) | (f.isin("BCRYPT", "PBKDF2", "SCRYPT", "ARGON2") & primitive.isNotNull())
    return (
        F.when(is_unaffected(asset, primitive, material, f), 5)
        .when(stored & p.rlike("rsa|ec|dsa|sha256withrsa"), 0)
        .when(f.isin(rules.SHOR_FAMILIES) | f.isin(rules.BROKEN_FAMILIES), 0)
        .when(derives, F.when(p.rlike("md5|sha1"), 1).otherwise(5))
        .when(primitive.isin("block-cipher", "stream-cipher", "ae"), steps(size, [(256, 5), (192, 3), (128, 1)]))
        .when(primitive.isin("hash", "mac"), steps(F.coalesce(own, size), [(512, 5), (384, 4), (256, 3), (160, 1)]))
        .otherwise(1)
    )


def data_sensitivity(context: Column, asset: Column, primitive: Column) -> Column:
    return (
        F.when(context.isin("test", "vendor"), "low")
        .when(asset.isin("related-crypto-material", "certificate"), "high")
        .when(primitive.isin("pke", "kem", "signature", "key-agree"), "high")
        .otherwise("medium")
    )


def quantum_risk(level: Column, sensitivity: Column, unaffected: Column) -> Column:
    return (
        F.when(unaffected, "NONE").when((level == 0) & (sensitivity == "high"), "CRITICAL").when(level == 0, "HIGH").when(level <= 2, "MEDIUM").otherwise("LOW")
    )


def exposure_risk(asset: Column, material: Column, name: Column, parameter: Column, path: Column, sources: Column, details: Column) -> Column:
    """How exposed a secret is; sources and details are the arrays of the finding's evidence."""
    key_file = F.coalesce(F.lower(path).rlike(r"\.(key|pem|p8|pkcs8)\z"), F.lit(False))
    scanned = F.exists(sources, lambda s: s.isin("keys_certs", "keysCerts"))
    on_disk = key_file | scanned | F.exists(details, lambda d: d.rlike("(?i)PEM header|file match|fs.read"))
    stored = asset == "related-crypto-material"
    private = F.coalesce(stored & ((material == "private-key") | (name == "private-key")), F.lit(False)) | key_file
    made = F.exists(sources, lambda s: s == "ast") & F.exists(details, lambda d: F.contains(d, F.lit("generateKeyPair"))) & ~scanned
    return (
        F.when(private & on_disk, "CRITICAL")
        .when(private & made, "NONE")
        .when(stored & (material == "secret-key"), F.when(on_disk, "HIGH").otherwise("LOW"))
        .when(F.contains(F.coalesce(parameter, F.lit("")), F.lit("weak-secret")), "HIGH")
        .when(asset == "certificate", "LOW")
        .otherwise("NONE")
    )


def base_score(direct: Column, supporting: Column, interpretive: Column) -> Column:
    """Score from the highest raw confidence of each evidence class; null where the class is absent."""
    return (
        F.when(direct.isNotNull() & supporting.isNotNull(), F.least(F.lit(0.99), half_up(direct + 0.04, 2)))
        .when(direct.isNotNull(), direct)
        .when(supporting.isNotNull() & interpretive.isNotNull(), F.least(F.lit(0.85), (supporting + interpretive) / 2))
        .when(interpretive.isNotNull(), interpretive * 0.6)
        .when(supporting.isNotNull(), supporting)
        .otherwise(0.0)
    )


def context_cap(context: Column) -> Column:
    return F.when(context == "production", 1.0).when(context == "test", 0.4).otherwise(0.7)


def score(direct: Column, supporting: Column, interpretive: Column, context: Column) -> Column:
    return half_up(base_score(direct, supporting, interpretive) * context_cap(context), 3)


def best_confidence(evidence: Column, kind: str) -> Column:
    """Highest raw confidence of one class in an array of evidence."""
    of_kind = F.filter(evidence, lambda e: e["evidenceClass"] == kind)
    return F.array_max(F.transform(of_kind, lambda e: e["rawConfidence"]))


def confidence_tier(x: Column) -> Column:
    return F.when(x >= 0.85, "very-high").when(x >= 0.60, "high").when(x >= 0.30, "medium").otherwise("low")


def quantum_tier(level: Column) -> Column:
    return F.when(level <= 0, "vulnerable").when(level <= 2, "weak").when(level <= 5, "safe").otherwise("unknown")


def rank_of(value: Column, order: list[str]) -> Column:
    """Place in a closed order; null and unknown values come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), value), F.lit(0)), F.lit(len(order) + 1)).cast("int")


# Code lines


def sanitize_line(line: Column) -> Column:
    """A line of code without its // comment and with empty string literals."""
    return F.regexp_replace(F.regexp_replace(line, "//.*\\z", ""), "([\"'`])(?:(?=(\\\\?))\\2.)*?\\1", '""')


def identifier_tokens(name: Column) -> Column:
    """Lower-case parts of an identifier, cut at dots, underscores and changes of case."""
    cut = F.regexp_replace(F.regexp_replace(name, r"[._]", " "), r"([a-z0-9])([A-Z])", "$1 $2")
    cut = F.lower(F.regexp_replace(cut, r"([A-Z]+)([A-Z][a-z0-9])", "$1 $2"))
    return F.filter(F.split(cut, r"\s+"), lambda p: p != "")


def crypto_calls(line: Column) -> Column:
    """Names before an opening bracket whose last dotted part has a segment that tells of cryptography."""
    names = F.regexp_extract_all(line, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*)\s*\("), 1)
    segments = F.array(*[F.lit(s) for s in rules.CALL_SEGMENTS])
    return F.filter(names, lambda n: F.arrays_overlap(identifier_tokens(F.element_at(F.split(n, r"\."), -1)), segments))


def normalised_severity(text: Column) -> Column:
    """Severity before the dash of an anomaly property; unknown ones are low."""
    head = F.trim(F.substring_index(text, "—", 1))
    return F.when(head.isin(rules.SEVERITIES), head).otherwise("low")


def is_repository(url: Column) -> Column:
    """Addresses of repositories on the hosting site that scans accept."""
    return url.rlike(r"^https?://(www\.)?github\.com/[\w.-]+/[\w.-]+?(\.git)?/?\z")
