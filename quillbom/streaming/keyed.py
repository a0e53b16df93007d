"""Operators with keyed state over streams: verification that asks once, and summaries that follow their scans.

State is kept by key in the state store and goes on after a restart from the query's checkpoint. The
processors take rows in any order and any cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillbom.functions import rules
from quillbom.functions.keys import SCAN

ANSWERED = "digest string, kind string, findingId string, prompt string, raw string"
SUMMARY = f"{SCAN} string, " + ", ".join(f"{s} long" for s in rules.SEVERITIES) + ", flaggedCount long, totalComponents long"


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="none")


class _Answers(StatefulProcessor):
    """Of one prompt: its answer, once it is there, and the findings that wait for it until then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answer = handle.getValueState("answer", "raw string")
        self.waiting = handle.getMapState("waiting", "findingId string", "asked boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        rows = list(rows)
        given = sorted(r["raw"] for r in rows if r["kind"] == "answer" and r["raw"] is not None)
        findings = {r["findingId"]: r["prompt"] for r in rows if r["kind"] == "finding"}
        if self.answer.exists():
            raw = self.answer.get()[0]
        elif given:
            raw = given[0]
            self.answer.update((raw,))
            for (finding,) in self.waiting.keys():
                findings.setdefault(finding, None)
            self.waiting.clear()
        else:
            if findings and not self.waiting.exists():
                yield Row(digest=key[0], kind="ask", findingId=None, prompt=next(iter(findings.values())), raw=None)
            for finding in findings:
                self.waiting.updateValue((finding,), (True,))
            return
        for finding in sorted(findings):
            yield Row(digest=key[0], kind="answered", findingId=finding, prompt=None, raw=raw)


def ask_once(findings: DataFrame, answers: DataFrame) -> DataFrame:
    """(digest, kind, findingId, prompt, raw): prompts to ask, each once however many findings share it, and the answers of findings.

    findings has findingId and prompt, answers the digest of a prompt and the raw answer. A prompt is
    asked when its first finding comes and no answer is known; a finding is answered at once where one
    is, else when it comes. The first answer stays; findings that come again are answered again.
    """
    digest = F.sha2("prompt", 256)
    none = F.lit(None).cast("string")
    both = findings.select(digest.alias("digest"), F.lit("finding").alias("kind"), "findingId", "prompt", none.alias("raw")).unionByName(
        answers.select("digest", F.lit("answer").alias("kind"), none.alias("findingId"), none.alias("prompt"), "raw")
    )
    return _stateful(both, "digest", _Answers(), ANSWERED, "append")


class _Summaries(StatefulProcessor):
    """Of one scan: for each package its components, whether it has a vulnerability, and the worst severity; and the counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.packages = handle.getMapState("packages", "purl string", "components long, rank int")
        self.counts = handle.getValueState("counts", ", ".join(f"{s} long" for s in rules.SEVERITIES) + ", total long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        order = list(rules.SEVERITIES)  # from the worst
        news: dict[str | None, list[int]] = {}
        for r in rows:
            new = news.setdefault(r["purl"], [0, len(order)])
            if r["kind"] == "component":
                new[0] += 1
            else:
                rank = 0 if r["kind"] == "vulnerability" else order.index(r["severity"]) if r["severity"] in order else len(order) - 1
                new[1] = min(new[1], rank)
        counts = list(self.counts.get()) if self.counts.exists() else [0] * (len(order) + 1)
        for purl, (more, rank) in news.items():
            n, worst = self.packages.getValue((purl,)) if self.packages.containsKey((purl,)) else (0, len(order))
            if worst < len(order):
                counts[worst] -= n
            n, worst = n + more, min(worst, rank)
            if worst < len(order):
                counts[worst] += n
            counts[-1] += more
            self.packages.updateValue((purl,), (n, worst))
        self.counts.update(tuple(counts))
        yield Row(**{SCAN: key[0]}, **dict(zip(order, counts, strict=False)), flaggedCount=sum(counts[:-1]), totalComponents=counts[-1])


def risk_summaries(components: DataFrame, vulnerabilities: DataFrame, hits: DataFrame) -> DataFrame:
    """sbom.risk_summary() of each scan over streams, in update mode: a row for each scan that a batch has news of.

    components, vulnerabilities and hits have scan and purl, hits a severity too; they may come in any
    order, a vulnerability before its component too. State is a row for each package of a scan.
    """
    kind = lambda rows, name, severity: rows.select(F.col(SCAN).cast("string").alias(SCAN), F.coalesce("purl", F.lit("")).alias("purl"), F.lit(name).alias("kind"), severity.alias("severity"))
    none = F.lit(None).cast("string")
    rows = kind(components, "component", none).unionByName(kind(vulnerabilities, "vulnerability", none)).unionByName(kind(hits, "hit", F.col("severity")))
    return _stateful(rows, SCAN, _Summaries(), SUMMARY, "update")


def latest(updates: DataFrame, key: str, number: str = "batch") -> DataFrame:
    """The last row of each key of what drops.apply_per_batch() has left of a stream in update mode."""
    columns = [c for c in updates.columns if c not in (key, number)]
    return updates.groupBy(key).agg(F.max_by(F.struct(*columns), number).alias("u")).select(key, "u.*")
