"""The registered queries and their oracle SQL, gathered from the plans."""

from __future__ import annotations

from quillbom.plans import files, findings, packages
from quillbom.plans.registered import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "files", "findings", "packages"]
FLAGSHIP = "risk_bucket_summary"
