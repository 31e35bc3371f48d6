"""The findings table: one row per defect detected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.severity import SEVERITIES, finding_id, severity_rank

FINDINGS_DDL = (
    "finding_id string, check_id string, issue_type string, source string, severity string, "
    "`column` string, title string, explanation string, affected_rows bigint, row_count bigint, "
    "affected_ratio double, row_ids array<bigint>, details string, confidence double"
)
FINDING_COLUMNS = (
    "finding_id", "check_id", "issue_type", "source", "severity", "column", "title", "explanation",
    "affected_rows", "row_count", "affected_ratio", "row_ids", "details", "confidence",
)
#: Row ids kept as evidence per finding.
EVIDENCE_ROWS = 200

DETERMINISTIC = "deterministic"
ADVISORY = "advisory"


def finding(
    check: str,
    issue: str,
    severity: Column,
    column: Column,
    title: Column,
    explanation: Column,
    affected: Column,
    row_count: Column,
    details: Column,
    confidence: Column | float = 1.0,
    fingerprint: Column | str = "",
    source: str = DETERMINISTIC,
) -> Column:
    """One finding as a struct, ready for ``inline``."""
    affected = affected.cast("bigint")
    rows = row_count.cast("bigint")
    origin, mark = F.lit(source), fingerprint if isinstance(fingerprint, Column) else F.lit(fingerprint)
    return F.struct(
        finding_id(origin, F.lit(check), F.lit(issue), column, mark).alias("finding_id"),
        F.lit(check).alias("check_id"),
        F.lit(issue).alias("issue_type"),
        origin.alias("source"),
        severity.alias("severity"),
        column.cast("string").alias("column"),
        title.alias("title"),
        explanation.alias("explanation"),
        affected.alias("affected_rows"),
        rows.alias("row_count"),
        F.when(rows > 0, affected / rows).otherwise(0.0).alias("affected_ratio"),
        F.array().cast("array<bigint>").alias("row_ids"),
        details.alias("details"),
        (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"),
    )


def as_findings(df: DataFrame, structs: list[Column]) -> DataFrame:
    """Rows of findings from struct columns, nulls left out."""
    return df.select(F.inline(F.array_compact(F.array(*structs)))).select(*FINDING_COLUMNS)


def no_findings(spark) -> DataFrame:
    return spark.createDataFrame([], FINDINGS_DDL)


def details(**parts: Column) -> Column:
    """Named values as a JSON object."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in parts.items()]))


def phrase(template: str, *values: Column | str | int) -> Column:
    """A sentence with ``%s`` and ``%,d`` slots filled from columns."""
    return F.format_string(template, *[v if isinstance(v, Column) else F.lit(v) for v in values])


def worst_first(findings: DataFrame) -> DataFrame:
    """Most severe first, then most rows, then by column."""
    return findings.orderBy(
        severity_rank(F.col("severity")), F.desc("affected_rows"), F.coalesce("column", F.lit("")), "finding_id"
    )


def by_severity(findings: DataFrame, deterministic_only: bool = True) -> DataFrame:
    """Findings per severity, zeros kept."""
    counted = findings.filter(F.col("source") == DETERMINISTIC) if deterministic_only else findings
    levels = findings.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SEVERITIES))).alias("severity"))
    return (
        levels.join(counted.groupBy("severity").agg(F.count(F.lit(1)).alias("n")), "severity", "left")
        .select("severity", F.coalesce("n", F.lit(0)).alias("findings"), severity_rank(F.col("severity")).alias("rank"))
        .orderBy("rank")
        .drop("rank")
    )


def by_source(findings: DataFrame) -> DataFrame:
    return findings.groupBy("source").agg(F.count(F.lit(1)).alias("findings"))


def by_column(findings: DataFrame) -> DataFrame:
    return findings.groupBy("column").agg(
        F.count(F.lit(1)).alias("findings"), F.sum("affected_rows").alias("affected_rows")
    )
