"""Tables and documents for people: summaries, charts, payloads and the audit log."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.naming import hinted
from plumbline.operators.findings import DETERMINISTIC, by_severity, by_source, worst_first
from plumbline.operators.profile import dataset_profile
from plumbline.operators.propose import decision_counts, with_status
from plumbline.operators.score import FORMULA, worst_columns

WHOLE_TABLE = "(whole table)"


# ------------------------------------------------------------------ chart data


def columns_per_type(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("semantic_type").agg(F.count(F.lit(1)).alias("columns"))


def most_missing(profiles: DataFrame, limit: int = 20) -> DataFrame:
    """Columns with gaps, the emptiest first."""
    share = F.round(F.col("missing_count") / F.col("row_count") * 100, 2)
    return (
        profiles.filter("missing_count > 0")
        .select("column", share.alias("missing_percent"))
        .orderBy(F.desc("missing_percent"), "column")
        .limit(limit)
    )


# ------------------------------------------------------------------ shape-only payloads


def must_mask(profiles: DataFrame) -> DataFrame:
    """Profiles with ``masked``: whether values may only be shown as shapes."""
    sensitive = [row.column for row in profiles.select("column").collect() if "sensitive" in hinted(row.column)]
    by_type = F.col("semantic_type").isin("email", "identifier")
    return profiles.withColumn("masked", by_type | F.col("column").isin(*sensitive) if sensitive else by_type)


def column_summaries(profiles: DataFrame, samples: int = 5) -> DataFrame:
    """What a column looks like, without its content: one JSON object per column."""
    shown = F.transform(
        F.slice("sample_values", 1, max(samples, 1)),
        lambda v: F.when(F.col("masked"), tx.mask(v)).otherwise(F.substring(v, 1, tx.MASK_LENGTH)),
    )
    parts = [
        F.col("column").alias("name"),
        F.col("semantic_type").alias("inferred_type"),
        F.col("missing_count").alias("missing"),
        F.col("row_count").alias("rows"),
        F.col("unique_count").alias("distinct"),
        F.round("numeric.minimum", 4).alias("min"),
        F.round("numeric.maximum", 4).alias("max"),
        F.col("temporal.minimum").alias("earliest"),
        F.col("temporal.maximum").alias("latest"),
    ]
    if samples > 0:
        parts += [shown.alias("examples"), F.col("masked").alias("examples_are_masked")]
    return must_mask(profiles).select(
        "position", "column", F.to_json(F.struct(*parts)).alias("summary")
    )


def level_counts(trimmed: DataFrame, pos: int, limit: int = 60) -> DataFrame:
    """The most frequent levels of one column: ``value, count``."""
    return (
        trimmed.filter(F.col("pos") == pos)
        .groupBy(F.col("t").alias("value"))
        .agg(F.sum("n").alias("count"))
        .orderBy(F.desc("count"), "value")
        .limit(limit)
    )


def finding_summaries(findings: DataFrame, limit: int = 10) -> DataFrame:
    """The worst findings without any example values."""
    return worst_first(findings).limit(limit).select(
        F.col("finding_id").alias("finding_reference"),
        "issue_type",
        "severity",
        F.coalesce("column", F.lit(WHOLE_TABLE)).alias("column"),
        "affected_rows",
        F.col("row_count").alias("total_rows"),
    )


# ------------------------------------------------------------------ report and audit log


def report_tables(analysis, proposals: DataFrame, decisions: DataFrame, cleaned=None) -> dict[str, DataFrame]:
    """Every section of a report as a table."""
    scores = analysis.column_scores.select("column", "score")
    found = worst_first(analysis.findings)
    tables = {
        "score": analysis.score.withColumn("formula", F.lit(FORMULA)),
        "dataset": dataset_profile(analysis.data, analysis.profiles),
        "severity_counts": by_severity(analysis.findings).filter("findings > 0"),
        "findings_by_source": by_source(analysis.findings),
        "columns": analysis.profiles.join(scores, "column").select(
            "position", "column", "semantic_type", "missing_count",
            F.round(F.col("missing_count") / F.col("row_count") * 100, 1).alias("missing_percent"),
            "unique_count", "score",
        ).orderBy("position"),
        "worst_columns": worst_columns(analysis.column_scores),
        "column_types": columns_per_type(analysis.profiles),
        "most_missing": most_missing(analysis.profiles),
        "findings": found.filter(F.col("source") == DETERMINISTIC),
        "advisory_findings": found.filter(F.col("source") != DETERMINISTIC),
        "decisions": decision_counts(proposals, decisions),
        "proposals": with_status(proposals, decisions).orderBy("position"),
        "skipped_checks": analysis.skipped,
    }
    if cleaned is not None:
        tables["applied"] = cleaned.applied
        tables["outcome"] = cleaned.outcome
    return tables


def audit_log(analysis, proposals: DataFrame, decisions: DataFrame, cleaned=None, reviewer: str = "reviewer") -> DataFrame:
    """One JSON document: the table, every decision, every change and the outcome."""
    offers = with_status(proposals, decisions)
    decided = offers.agg(_listed(
        offers, "position",
        ["proposal_id", "finding_id", "action", "column", "source", "destructive", "affected_rows", "status",
         "decided_at", "decided_by"],
    ).alias("decisions"))
    score = analysis.score.select(F.col("overall").alias("quality_score"))
    dataset = F.struct(
        F.lit(analysis.row_count).alias("rows"), F.lit(len(analysis.data.columns)).alias("columns"), F.col("quality_score")
    )
    table = decided.crossJoin(F.broadcast(score))
    parts = [
        F.lit(analysis.analysis_id).alias("analysis_id"),
        F.lit(analysis.data.name).alias("source_name"),
        F.lit(analysis.created_at.isoformat()).alias("analysed_at"),
        F.lit(datetime.now(timezone.utc).isoformat()).alias("exported_at"),
        F.lit(reviewer).alias("reviewer"),
        dataset.alias("dataset"),
        F.col("decisions"),
    ]
    if cleaned is not None:
        changes = cleaned.applied.agg(
            _listed(cleaned.applied, "proposal_id", ["proposal_id", "action", "column", "rows_changed"]).alias("applied")
        )
        outcome = cleaned.outcome.select(F.struct("*").alias("outcome"))
        table = table.crossJoin(F.broadcast(changes)).crossJoin(F.broadcast(outcome))
        parts += [F.col("applied").alias("applied_changes"), F.col("outcome")]
    return table.select(F.to_json(F.struct(*parts)).alias("value"))


def _listed(df: DataFrame, order: str, names: list[str]) -> Column:
    """Rows of a metadata table as an array of structs in order."""
    known = [name for name in names if name in df.columns]
    entries = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__order"), *known)))
    return F.transform(entries, lambda e: F.struct(*[e[name].alias(name) for name in known]))
