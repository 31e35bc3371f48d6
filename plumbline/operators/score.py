"""The quality score: 100 minus severity-weighted shares of affected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.severity import SEVERITY_WEIGHTS, grade, severity_weight
from plumbline.operators.findings import DETERMINISTIC


def penalty() -> Column:
    return severity_weight(F.col("severity")) * F.col("affected_ratio") * 100


#: How the score comes about, in words, for reports.
FORMULA = (
    f"Each finding costs its severity weight ({', '.join(f'{name} {weight:g}' for name, weight in SEVERITY_WEIGHTS.items())}) "
    "times the share of rows it affects, in points of 100. A column's score is 100 less its costs, from 0 to 100. The table's score is the mean of its columns "
    "less the costs of findings about the whole table. Advisory findings cost nothing."
)


def _clamp(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))


def column_scores(findings: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per column of ``columns`` (any table with ``column``): score, penalty, findings.

    Advisory findings never count.
    """
    charged = findings.filter(F.col("source") == DETERMINISTIC).groupBy("column").agg(
        F.sum(penalty()).alias("penalty"), F.count(F.lit(1)).alias("finding_count")
    )
    joined = columns.select("column").join(F.broadcast(charged), "column", "left")
    charge = F.coalesce("penalty", F.lit(0.0))
    return joined.select(
        "column",
        F.round(_clamp(100 - charge), 2).alias("score"),
        F.round(charge, 2).alias("penalty"),
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
    )


def quality_score(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: mean column score less the penalties of findings about the whole table."""
    counted = findings.filter(F.col("source") == DETERMINISTIC)
    whole = counted.join(F.broadcast(scores.select("column")), "column", "left_anti").agg(
        F.coalesce(F.sum(penalty()), F.lit(0.0)).alias("dataset_penalty")
    )
    mean = scores.agg(F.coalesce(F.avg("score"), F.lit(100.0)).alias("column_mean"))
    severities = counted.agg(
        *[F.count_if(F.col("severity") == name).alias(name) for name in ("critical", "high", "medium", "low", "info")]
    )
    overall = F.round(_clamp(F.col("column_mean") - F.col("dataset_penalty")), 2)
    return (
        mean.crossJoin(whole)
        .crossJoin(severities)
        .select(
            overall.alias("overall"),
            grade(overall).alias("grade"),
            F.round("dataset_penalty", 2).alias("dataset_penalty"),
            "critical", "high", "medium", "low", "info",
        )
    )


def worst_columns(scores: DataFrame, limit: int = 20) -> DataFrame:
    return scores.orderBy("score", "column").limit(limit)
