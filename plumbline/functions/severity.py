"""Severities and stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from worst to mildest with their penalty weights.
SEVERITY_WEIGHTS = {"critical": 1.0, "high": 0.6, "medium": 0.3, "low": 0.1, "info": 0.0}
SEVERITIES = tuple(SEVERITY_WEIGHTS)


def severity_weight(severity: Column) -> Column:
    weight = F.lit(None).cast("double")
    for name, value in SEVERITY_WEIGHTS.items():
        weight = F.when(severity == name, F.lit(value)).otherwise(weight)
    return weight


def severity_rank(severity: Column) -> Column:
    """0 for critical up to 4 for info."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def ratio_severity(ratio: Column, critical: float = 0.5, high: float = 0.2, medium: float = 0.05) -> Column:
    """Severity from the share of affected rows; each threshold must be exceeded."""
    return (
        F.when(ratio > critical, "critical")
        .when(ratio > high, "high")
        .when(ratio > medium, "medium")
        .otherwise("low")
    )


def _short_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def finding_id(source: Column, check: Column, issue: Column, column: Column, fingerprint: Column) -> Column:
    """The same defect gets the same id in every run, so decisions can be matched to it."""
    return _short_hash(source, check, issue, F.coalesce(column, F.lit("*")), fingerprint)


def proposal_id(finding: Column, action: Column, discriminator: str = "") -> Column:
    return _short_hash(finding, action, F.lit(discriminator))


def percent(ratio: Column) -> Column:
    return F.format_string("%.1f%%", ratio * 100)


def grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("E")
    )
