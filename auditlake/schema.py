"""Severity orders and the columns of findings.

The orders differ by place and are not merged: the consensus knows UNKNOWN but
not INFO, the risk policy ignores INFO.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Highest first; positions count down to 0.
FINDING_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "SAFE"]
CONSENSUS_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "SAFE", "UNKNOWN"]
RISK_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "SAFE"]

FINDING_COLUMNS = ["repo", "path", "seq", "line", "severity", "category", "rule_id", "title", "description", "code_context", "tainted", "confidence"]


def rank(severity: Column, order: list[str] = FINDING_ORDER) -> Column:
    """Ordinal of a severity; names outside the order count 0."""
    n = F.array_position(F.array(*[F.lit(x) for x in order]), F.coalesce(severity, F.lit(""))).cast("int")
    return F.when(n > 0, len(order) - n).otherwise(0)


def name_of(ordinal: Column, order: list[str] = FINDING_ORDER) -> Column:
    return F.when(ordinal.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in reversed(order)]), ordinal + 1))
