"""Named queries over the given tables, each with the SQL it must agree with."""

from snagline.plans import gate, ledger, redaction, sessions, streams, triage  # noqa: F401
from snagline.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
