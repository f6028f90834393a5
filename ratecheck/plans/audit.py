"""The main path: lines and master in, verdicts and summaries out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ratecheck.operators.validate import (
    TOLERANCE, line_verdicts, verdict_summary, verdicts_with_acceptance,
)


def audit(lines: DataFrame, master: DataFrame, tolerance: float = TOLERANCE,
          accept_unknown: bool = False, as_of: str | None = None) -> DataFrame:
    """Verdict per line; with ``accept_unknown`` new parts are judged by their first line."""
    if accept_unknown:
        return verdicts_with_acceptance(lines, master, as_of, tolerance)
    return line_verdicts(lines, master, tolerance)


def audit_summary(lines: DataFrame, master: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Verdict counts per invoice."""
    return verdict_summary(audit(lines, master, tolerance))
