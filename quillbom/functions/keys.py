"""The key that keeps scans apart: tables of one scan have no such column, tables of many scans have it throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame

SCAN = "scan"


def scan_key(*frames: DataFrame) -> list[str]:
    """The scan column, if all frames have it; an error if only some do, as rows of different scans would meet."""
    have = [SCAN in f.columns for f in frames]
    if any(have) and not all(have):
        raise ValueError("some of these tables tell scans apart and some do not")
    return [SCAN] if all(have) else []
