"""Merging of evidence, scores, risk classes and validation of findings."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillbom.functions import columns as C
from quillbom.functions import rules
from quillbom.functions.keys import scan_key
from quillbom.session import shared_folder

FILLED = ["primitive", "algorithmFamily", "parameterSet", "mode", "materialType", "fingerprint", "keyExtension", "callContext", "sourceContext", "exposureRisk"]


class _Groups:
    """Findings that may merge, as connected groups, read in the order of place and line.

    Whether two may ever merge is seen from what they have at first: a merge adds sources and fills
    in an unknown family, which only rules merges out. Findings of one line, family and set of
    sources are one, so what is kept is bounded by the kinds of findings on a few lines.
    """

    def __init__(self, window: int):
        self.window, self.place, self.line = window, None, None
        self.parent: list[int] = []
        self.active: dict[tuple, int] = {}  # (line, family, sources) of the last lines

    def root(self, group: int) -> int:
        while self.parent[group] != group:
            self.parent[group] = group = self.parent[self.parent[group]]
        return group

    def add(self, place: tuple, line: int, family: str | None, sources: frozenset) -> int:
        """The group of the next finding, to be looked up by root() when later ones are added."""
        if place != self.place:
            self.place, self.active = place, {}
        elif line != self.line:
            self.active = {k: g for k, g in self.active.items() if k[0] >= line - self.window}
        self.line = line
        found = self.active.get((line, family, sources))
        if found is None:
            found = len(self.parent)
            self.parent.append(found)
            for (other, known, seen), group in self.active.items():
                if (known is None or family is None or known == family) and (other == line or seen.isdisjoint(sources)):
                    self.parent[self.root(group)] = self.root(found)
            self.active[line, family, sources] = found
        return found


def _signs(batch: pa.RecordBatch, place: list[str]) -> Iterator[tuple]:
    """(place, line, family or None, sources) of the rows of a batch."""
    columns = [batch[c].to_pylist() for c in place]
    sources = batch["evidence"].flatten().field("source").to_pylist()  # nothing else of the evidence becomes Python objects
    at = 0
    for *where, line, family, n in zip(*columns, batch["line"].to_pylist(), batch["algorithmFamily"].to_pylist(), batch["evidence"].value_lengths().to_pylist(), strict=True):
        family = (family or "unknown").lower()
        yield tuple(where), line, None if family == "unknown" else family, frozenset(sources[at:at + n])
        at += n


def _dicts(groups: list[list[tuple[pa.RecordBatch, int]]]) -> Iterator[list[dict]]:
    """The rows of groups, which are places in batches; each batch is turned to Python objects once, for the rows that are asked for."""
    asked: dict[int, tuple[pa.RecordBatch, list[int]]] = {}
    for batch, i in itertools.chain.from_iterable(groups):
        asked.setdefault(id(batch), (batch, []))[1].append(i)
    found = {(key, i): row for key, (batch, places) in asked.items() for i, row in zip(places, batch.take(pa.array(places)).to_pylist(), strict=True)}
    for group in groups:
        yield [found.pop((id(batch), i)) for batch, i in group]


def _edges(dealt: DataFrame, place: list[str], window: int) -> list:
    """What a partition's first and last lines hold: (part, side, place, line, family, sources, group); for last lines as groups are at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, head, first, part = _Groups(window), {}, None, None
        for batch in batches:
            for at, line, family, sources in _signs(batch, place):
                part = batch["_part"][0].as_py() if part is None else part
                first = first or (at, line)
                group = groups.add(at, line, family, sources)
                if at == first[0] and line <= first[1] + window:
                    head.setdefault((line, family, sources), group)
        rows = [(part, side, repr(at), line, family, sorted(sources), groups.root(g)) for side, at, held in (("head", first and first[0], head), ("tail", groups.place, groups.active)) for (line, family, sources), g in held.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["part", "side", "place", "line", "family", "sources", "group"])

    return dealt.mapInArrow(run, "part int, side string, place string, line long, family string, sources array<string>, group long").collect()


def _across(edges: list, window: int) -> dict[int, dict[int, str]]:
    """For each partition its groups that go on in others, with a name for the whole: one walk over the edges of the partitions in their order."""
    whole, member = _Groups(window), {}
    for e in sorted(edges, key=lambda e: (e["part"], e["side"], e["line"])):  # a partition's head before its tail
        at = whole.add(e["place"], e["line"], e["family"], frozenset(e["sources"]))
        own = member.setdefault((e["part"], e["group"]), at)
        whole.parent[whole.root(at)] = whole.root(own)
    parts_of: dict[int, set[int]] = {}
    for (part, _), at in member.items():
        parts_of.setdefault(whole.root(at), set()).add(part)
    found: dict[int, dict[int, str]] = {}
    for (part, group), at in member.items():
        if len(parts_of[whole.root(at)]) > 1:
            found.setdefault(part, {})[group] = str(whole.root(at))
    return found


#: Rows of groups that may still grow, from which those that cannot are passed on.
HELD_ROWS = 10_000


def merge_evidence(findings: DataFrame, window: int = 2) -> DataFrame:
    """Findings of one asset type and file (and scan), at most so many lines apart, become one, in the order of seq.

    The merge is greedy: a finding goes to the first one before it that it fits, whose identity and
    evidence grow as it takes others in. Two fit when their families (or names) do (null and unknown
    fit all) and they are on one line or share no source.

    Findings are dealt by ranges of place and line, so a file of any number of findings is spread over
    tasks as others are, and their number follows the data. In each range, groups that may merge are
    told apart on the way; a finding alone in its group is passed on as it is, and a group is merged
    as soon as no later line can join it. Groups that go on in the next range are found from what
    stands on the ranges' first and last lines, and only their rows are shuffled once more. Findings
    of no known line merge with none; a null path is a file like others.
    """
    findings, nowhere = findings.where("line is not null"), findings.where("line is null")
    place = [*scan_key(findings), "assetType", "filePath"]
    spark, names = findings.sparkSession, findings.columns
    shared_folder(spark)
    order = [*place, "line"]
    dealt = findings.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    across = _across(_edges(dealt, place, window), window)

    def grouped(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple[str | None, list[dict] | None, pa.RecordBatch]]:
        """(name, rows, batch) of groups that end here, if whole, with single findings as parts of batches; or else of those that go on."""
        groups, held, beyond, count = _Groups(window), {}, None, 0

        def passed(everything: bool) -> Iterator[tuple]:
            nonlocal held, count
            open_groups = set() if everything else {groups.root(g) for g in groups.active.values()}
            together: dict[int, list] = {}
            for group, rows in held.items():
                together.setdefault(groups.root(group), []).extend(rows)
            singles: dict[int, tuple] = {}
            several: list[tuple[str | None, list]] = []
            for root, rows in together.items():
                if root in open_groups or whole == (root in beyond):
                    continue
                if len(rows) > 1 or not whole:
                    several.append((beyond.get(root), rows))
                else:
                    singles.setdefault(id(rows[0][0]), (rows[0][0], []))[1].append(rows[0][1])
            for (name, places), rows in zip(several, _dicts([places for _, places in several]), strict=True):
                yield name, rows, places[0][0]
            for batch, places in singles.values():
                yield None, None, batch.take(pa.array(sorted(places)))
            held = {root: rows for root, rows in together.items() if root in open_groups}
            count = sum(map(len, held.values()))

        for batch in batches:
            for i, (at, line, family, sources) in enumerate(_signs(batch, place)):
                if beyond is None:
                    beyond = across.get(batch["_part"][0].as_py(), {})
                group = groups.add(at, line, family, sources)
                held.setdefault(group, []).append((batch, i))
                count += 1
                if count >= HELD_ROWS and count % 1000 == 0:
                    yield from passed(False)
        if beyond is not None:
            yield from passed(True)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged, schema = [], None
        for _, rows, batch in grouped(batches, whole=True):
            if rows is None:
                yield batch.select(names)
                continue
            schema = schema or batch.select(names).schema
            merged += _merged(rows, window)
            if len(merged) >= 1000:
                yield pa.RecordBatch.from_pylist(merged, schema=schema)
                merged = []
        if merged:
            yield pa.RecordBatch.from_pylist(merged, schema=schema)

    def beyond_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows, batch in grouped(batches, whole=False):
            kept = pa.RecordBatch.from_pylist(rows, schema=batch.select(names).schema)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([name] * len(rows))], [*names, "_whole"])

    def joined(rows: pa.Table) -> pa.Table:
        kept = rows.select(names)
        return pa.Table.from_pylist(_merged(kept.to_pylist(), window), schema=kept.schema)

    out = dealt.mapInArrow(inside, findings.schema)
    if across:
        split = dealt.where(F.col("_part").isin(list(across))).mapInArrow(beyond_edges, StructType([*findings.schema.fields, StructField("_whole", StringType())]))
        out = out.unionByName(split.groupBy("_whole").applyInArrow(joined, findings.schema))
    return out.unionByName(nowhere)


def _merged(rows: list[dict], window: int) -> list[dict]:
    """The greedy merge of one group, in the order of seq; only findings kept on near lines are looked at."""
    out: list[dict] = []
    near: dict[int, list[tuple[int, dict]]] = {}
    for row in sorted(rows, key=lambda r: r["seq"]):
        close = [k for line in range(row["line"] - window, row["line"] + window + 1) for k in near.get(line, [])]
        target = min((k for k in close if _fits(k[1], row, window)), key=lambda k: k[0], default=None)
        if target is None:
            near.setdefault(row["line"], []).append((len(out), row))
            out.append(row)
            continue
        kept = target[1]
        kept["evidence"] = kept["evidence"] + row["evidence"]
        for c in FILLED:
            if c in kept and kept[c] is None:
                kept[c] = row[c]
        if kept["name"] in (None, "", "unknown") and row["name"] not in (None, "", "unknown"):
            kept["name"] = row["name"]
    return out


def _fits(a: dict, b: dict, window: int) -> bool:
    if abs(a["line"] - b["line"]) > window:
        return False
    families = [(x["algorithmFamily"] or x["name"] or "unknown").lower() for x in (a, b)]
    if "unknown" not in families and families[0] != families[1]:
        return False
    return a["line"] == b["line"] or {e["source"] for e in a["evidence"]}.isdisjoint(e["source"] for e in b["evidence"])


def assess(findings: DataFrame) -> DataFrame:
    """findings with contextCategory, confidence, level, quantumRisk and exposureRisk."""
    best = {k: C.best_confidence(F.col("evidence"), k) for k in ("direct", "supporting", "interpretive")}
    rows = findings.withColumn("contextCategory", C.context_category(F.col("filePath")))
    rows = rows.withColumn("confidence", C.score(best["direct"], best["supporting"], best["interpretive"], F.col("contextCategory")))
    family = F.coalesce("algorithmFamily", "name")
    rows = rows.withColumn("nistQuantumLevel", C.nist_level(F.col("assetType"), F.col("primitive"), F.col("materialType"), family, F.col("parameterSet")))
    unaffected = C.is_unaffected(F.col("assetType"), F.col("primitive"), F.col("materialType"), F.upper(family))
    rows = rows.withColumn("quantumRisk", C.quantum_risk(F.col("nistQuantumLevel"), C.data_sensitivity(F.col("contextCategory"), F.col("assetType"), F.col("primitive")), unaffected))
    sources, details = F.transform("evidence", lambda e: e["source"]), F.transform("evidence", lambda e: e["detail"])
    return rows.withColumn("exposureRisk", C.exposure_risk(F.col("assetType"), F.col("materialType"), F.col("name"), F.col("parameterSet"), F.col("filePath"), sources, details))


def issues(findings: DataFrame) -> DataFrame:
    """findings with an array of issues (level, field, message)."""
    issue = lambda level, field, text: F.struct(F.lit(level).alias("level"), F.lit(field).alias("field"), F.lit(text).alias("message"))

    def domain(field: str, values: list[str], required: bool) -> object:
        c = F.col(field)
        wrong = (c.isNull() if required else F.lit(False)) | (c.isNotNull() & ~c.isin(values))
        return F.when(wrong, issue("error", field, f"{field} is not one of the known values"))

    stored = F.col("assetType").isin("related-crypto-material", "certificate")
    checks = [
        domain("assetType", rules.ASSET_TYPES, True),
        domain("primitive", rules.PRIMITIVES, False),
        domain("materialType", rules.MATERIAL_TYPES, False),
        domain("contextCategory", rules.CONTEXTS, True),
        domain("sourceContext", rules.SOURCE_CONTEXTS, True),
        F.when((F.col("assetType") == "related-crypto-material") & F.col("primitive").isNotNull(), issue("error", "primitive", "stored material has no primitive")),
        F.when((F.col("assetType") == "certificate") & F.col("primitive").isNotNull(), issue("error", "primitive", "a certificate has no primitive")),
        F.when((F.col("assetType") == "algorithm") & F.col("materialType").isNotNull(), issue("error", "materialType", "an algorithm has no material type")),
        F.when(~stored & F.col("algorithmFamily").isNotNull() & ~F.col("algorithmFamily").isin(rules.FAMILIES), issue("warning", "algorithmFamily", "family is not in the registry")),
    ]
    return findings.withColumn("issues", F.array_compact(F.array(*checks)))


def is_clean(column: str = "issues") -> object:
    return ~F.exists(column, lambda i: i["level"] == "error")


def validate(findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean findings, errors, warnings)."""
    rows = issues(findings)
    each = rows.select("findingId", F.explode("issues").alias("i")).select("findingId", "i.*")
    return rows.where(is_clean()).drop("issues"), each.where("level = 'error'"), each.where("level = 'warning'")


def certificates(blocks: DataFrame, pem: str = "pem") -> DataFrame:
    """blocks with subject, validTo and keyType of X.509 certificates in PEM text; null where it can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            read = [_certificate(p) for p in rows[pem]]
            yield rows.assign(subject=[r[0] for r in read], validTo=[r[1] for r in read], keyType=[r[2] for r in read])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)
    return blocks.mapInPandas(run, f"{fields}, subject string, validTo string, keyType string")


def _der(data: bytes, at: int) -> tuple[int, int, int]:
    """(tag, start of content, end) of the element at a place."""
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        size, at = int.from_bytes(data[at:at + n], "big"), at + n
    if at + size > len(data):
        raise ValueError("element is cut off")
    return tag, at, at + size


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]]:
    out = []
    while start < end:
        out.append(_der(data, start))
        start = out[-1][2]
    return out


# Object identifiers, as hex.
_KEY_TYPES = {"2a864886f70d010101": "rsa", "2a8648ce3d0201": "ec", "2b6570": "ed25519", "2a8648ce380401": "dsa"}
_NAME_PARTS = {"550403": "CN", "550406": "C", "550407": "L", "550408": "ST", "55040a": "O", "55040b": "OU"}


def _certificate(pem: str | None) -> tuple[str | None, str | None, str | None]:
    import base64
    import re

    try:
        body = re.search(r"-----BEGIN CERTIFICATE-----(.*?)-----END CERTIFICATE-----", pem, re.S)[1]
        data = base64.b64decode(re.sub(r"\s+", "", body))
        _, a, b = _der(data, 0)
        parts = _children(data, *_children(data, a, b)[0][1:])
        parts = parts[1:] if parts[0][0] == 0xA0 else parts
        _, _, _, validity, subject, key = parts[:6]
        names = []
        for part in _children(data, *subject[1:]):
            oid, value = _children(data, *_children(data, *part[1:])[0][1:])
            names.append(f"{_NAME_PARTS.get(data[oid[1]:oid[2]].hex(), '?')}={data[value[1]:value[2]].decode('utf-8', 'replace')}")
        tag, x, y = _children(data, *validity[1:])[1]
        time = data[x:y].decode()
        if tag == 0x17:
            time = ("19" if time[:2] >= "50" else "20") + time
        until = f"{time[:4]}-{time[4:6]}-{time[6:8]}T{time[8:10]}:{time[10:12]}:{time[12:14]}Z"
        _, p, q = _children(data, *_children(data, *key[1:])[0][1:])[0]
        return "\n".join(names), until, _KEY_TYPES.get(data[p:q].hex())
    except Exception:  # a certificate that can't be read has no such facts
        return None, None, None
