"""The history of runs: append-only Parquet tables under one folder.

Rows are only ever added. What belongs together is saved as one commit: its rows are written first, in
folders of their own, and one row in the table of commits publishes them all. Readers see published
rows only, so a save that fails half-way leaves nothing behind that anyone reads. Cell values copied
from the data are replaced by counts unless the caller asks to keep them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.propose import Proposals, decision_counts, with_status

# The keys of finding details and proposal parameters that may quote the data.
SENSITIVE_KEYS = ("examples", "variant_groups", "constant_value", "mapping", "values")

TABLES = {
    "analyses": "analysis_id string, created_at timestamp, source_name string, content_hash string, row_count bigint, "
    "column_count int, size_bytes bigint, quality_score double, score_breakdown string, rule_set_name string, notes array<string>",
    "analysis_columns": "analysis_id string, name string, position int, data_type string, semantic_type string, "
    "confidence double, row_count bigint, missing_count bigint, unique_count bigint, column_score double",
    "findings": "analysis_id string, finding_id string, check_id string, issue_type string, source string, severity string, "
    "column_name string, title string, explanation string, affected_rows bigint, row_count bigint, confidence double, details string",
    "proposals": "analysis_id string, proposal_id string, finding_id string, action string, source string, column_name string, "
    "title string, description string, parameters string, affected_rows bigint, destructive boolean, confidence double, "
    "decision_status string, decided_at timestamp, decided_by string, decision_note string",
    "applied_changes": "analysis_id string, proposal_id string, action string, column_name string, rows_changed bigint, "
    "parameters string, applied_at timestamp, position int",
    "audit_events": "analysis_id string, occurred_at timestamp, event_type string, actor string, summary string, payload string",
    "call_log": "analysis_id string, occurred_at timestamp, task string, model string, input_tokens bigint, "
    "output_tokens bigint, latency_ms bigint, succeeded boolean, error_type string",
}


#: The table that publishes commits, and the column that names the commit of a row.
COMMITS, COMMIT = "commits", "__commit"
COMMITS_DDL = "commit_id string, kind string, analysis_id string, published_at timestamp"


def redact(details: Column, keep_examples: bool = False) -> Column:
    """Details JSON with every value that quotes the data replaced by a count or a flag."""
    if keep_examples:
        return details
    parts = F.from_json(details, "map<string,string>")
    elements = lambda value: F.coalesce(
        F.json_array_length(value), F.size(F.json_object_keys(value))
    )
    entries = F.transform(
        F.map_entries(parts),
        lambda e: F.when(~e["key"].isin(*SENSITIVE_KEYS), F.struct(e["key"].alias("key"), e["value"].alias("value")))
        .when(
            e["value"].rlike(r"\A[\[{]"),
            F.struct(F.concat(e["key"], F.lit("_count")).alias("key"), elements(e["value"]).cast("string").alias("value")),
        )
        .otherwise(F.struct(F.concat(e["key"], F.lit("_present")).alias("key"), F.lit("true").alias("value"))),
    )
    return F.to_json(F.map_from_entries(entries))


class History:
    """Reads and appends the history tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str, keep_examples: bool = False):
        self.spark, self.root, self.keep_examples = spark, root.rstrip("/"), keep_examples

    def _stored(self, name: str, schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema).option("recursiveFileLookup", "true")
        try:
            return reader.parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        """The published rows of a history table; empty when nothing was stored yet.

        Rows without a commit were stored before there were commits, and count as published.
        """
        rows = self._stored(name, f"{TABLES[name]}, {COMMIT} string")
        published = self.commits().select(F.col("commit_id").alias(COMMIT)).distinct()
        known = rows.join(published, COMMIT, "left_semi").unionByName(rows.filter(F.col(COMMIT).isNull()))
        return known.drop(COMMIT)

    def commits(self) -> DataFrame:
        """What was saved: ``commit_id, kind, analysis_id, published_at``."""
        return self._stored(COMMITS, COMMITS_DDL)

    @contextmanager
    def _commit(self, kind: str, analysis_id: str | None) -> Iterator[str]:
        """The name of a new commit, which is published when the block ends without an error."""
        commit = uuid.uuid4().hex
        yield commit
        row = [(commit, kind, analysis_id, datetime.now(timezone.utc))]
        # One row in one file: it is there as a whole or not at all.
        self.spark.createDataFrame(row, COMMITS_DDL).coalesce(1).write.mode("append").parquet(f"{self.root}/{COMMITS}")

    def _append(self, commit: str, name: str, df: DataFrame) -> None:
        fields = self.spark.createDataFrame([], TABLES[name]).schema.fields
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields], F.lit(commit).alias(COMMIT))
        rows.coalesce(1).write.parquet(f"{self.root}/{name}/{commit}")

    def _event(self, commit: str, analysis_id: str | None, kind: str, summary: Column, payload: Column, source: DataFrame, actor: str) -> None:
        self._append(
            commit,
            "audit_events",
            source.select(
                F.lit(analysis_id).alias("analysis_id"), F.lit(datetime.now(timezone.utc)).alias("occurred_at"),
                F.lit(kind).alias("event_type"), F.lit(actor).alias("actor"),
                summary.alias("summary"), payload.alias("payload"),
            ),
        )

    # -------------------------------------------------------------- writes

    def log_event(self, kind: str, summary: str, analysis_id: str | None = None, actor: str = "reviewer", payload: str = "{}") -> None:
        with self._commit("event", analysis_id) as commit:
            self._event(commit, analysis_id, kind, F.lit(summary), F.lit(payload), self.spark.range(1), actor)

    def log_call(self, analysis_id: str | None, task: str, model: str, input_tokens: int, output_tokens: int,
                 latency_ms: int, succeeded: bool = True, error_type: str | None = None) -> None:
        """Cost of one outside call, never its content."""
        values = {
            "analysis_id": analysis_id, "occurred_at": datetime.now(timezone.utc), "task": task, "model": model,
            "input_tokens": input_tokens, "output_tokens": output_tokens, "latency_ms": latency_ms,
            "succeeded": succeeded, "error_type": error_type,
        }
        with self._commit("call", analysis_id) as commit:
            self._append(commit, "call_log", self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]))

    def save_analysis(self, analysis) -> None:
        """A run with its columns, findings and an event, all of it or nothing."""
        with self._commit("analysis", analysis.analysis_id) as commit:
            self._save_analysis(commit, analysis)

    def _save_analysis(self, commit: str, analysis) -> None:
        known = {"analysis_id": F.lit(analysis.analysis_id)}
        score = analysis.score.select(F.struct("*").alias("s"))
        columns = analysis.column_scores.agg(F.collect_list(F.struct("column", "score", "penalty")).alias("columns"))
        data = analysis.data
        self._append(
            commit,
            "analyses",
            score.crossJoin(F.broadcast(columns)).withColumns(
                {
                    **known,
                    "created_at": F.lit(analysis.created_at),
                    "source_name": F.lit(data.name),
                    "content_hash": F.lit(data.content_hash),
                    "row_count": F.lit(analysis.row_count),
                    "column_count": F.lit(len(data.columns)),
                    "size_bytes": F.lit(data.size_bytes),
                    "quality_score": F.col("s.overall"),
                    "score_breakdown": F.to_json(F.struct("s", "columns")),
                    "rule_set_name": F.lit(analysis.rules.name if analysis.rules else None),
                    "notes": F.array(*map(F.lit, data.notes)).cast("array<string>"),
                }
            ),
        )
        self._append(
            commit,
            "analysis_columns",
            analysis.profiles.join(analysis.column_scores.select("column", F.col("score").alias("column_score")), "column")
            .withColumn("name", F.col("column")).withColumns(known),
        )
        self._append(
            commit,
            "findings",
            analysis.findings.withColumns(
                {**known, "column_name": F.col("column"), "details": redact(F.col("details"), self.keep_examples)}
            ),
        )
        found = analysis.findings.agg(F.count(F.lit(1)).alias("findings")).crossJoin(F.broadcast(analysis.score))
        summary = F.format_string("Analysed '%s': %,d rows, %,d findings, score %.1f.", F.lit(data.name),
                                  F.lit(analysis.row_count), F.col("findings"), F.col("overall"))
        payload = F.to_json(F.struct(F.lit(analysis.row_count).alias("rows"), "findings", F.col("overall").alias("quality_score")))
        self._event(commit, analysis.analysis_id, "analysis.completed", summary, payload, found, "engine")

    def save_review(self, analysis, proposals: Proposals, decisions: DataFrame, reviewer: str = "reviewer") -> None:
        """Offered corrections with their decisions, refusals included. Stored ids are skipped."""
        self._require(analysis.analysis_id)
        stored = self.table("proposals").filter(F.col("analysis_id") == analysis.analysis_id).select("proposal_id")
        offers = with_status(proposals.table, decisions)
        for name, default in (("decided_at", "timestamp"), ("decided_by", "string"), ("note", "string")):
            if name not in offers.columns:
                offers = offers.withColumn(name, F.lit(None).cast(default))
        counts = decision_counts(proposals.table, decisions)
        summary = F.format_string("%,d corrections approved, %,d rejected, %,d left pending.", "approved", "rejected", "pending")
        with self._commit("review", analysis.analysis_id) as commit:
            self._append(
                commit,
                "proposals",
                offers.join(stored, "proposal_id", "left_anti").withColumns(
                    {
                        "analysis_id": F.lit(analysis.analysis_id),
                        "column_name": F.col("column"),
                        "decision_status": F.col("status"),
                        "decision_note": F.coalesce("note", F.lit("")),
                        "parameters": redact(F.to_json("parameters"), self.keep_examples),
                    }
                ),
            )
            self._event(commit, analysis.analysis_id, "review.decided", summary, F.to_json(F.struct("*")), counts, reviewer)

    def save_cleaned(self, analysis, cleaned, reviewer: str = "reviewer") -> None:
        """The changes that were really made."""
        self._require(analysis.analysis_id)
        order = F.row_number().over(_by_id())
        summary = F.format_string("%,d cells changed, %,d rows removed; score %.1f to %.1f.", "cells_changed", "rows_removed",
                                  "score_before", "score_after")
        with self._commit("cleaning", analysis.analysis_id) as commit:
            self._append(
                commit,
                "applied_changes",
                cleaned.applied.withColumns(
                    {
                        "analysis_id": F.lit(analysis.analysis_id), "column_name": F.col("column"),
                        "parameters": redact(F.to_json("parameters"), self.keep_examples),
                        "applied_at": F.lit(datetime.now(timezone.utc)), "position": order,
                    }
                ),
            )
            self._event(commit, analysis.analysis_id, "dataset.cleaned", summary, F.to_json(F.struct("*")), cleaned.outcome, reviewer)

    # -------------------------------------------------------------- reads

    def find_analysis(self, analysis_id: str) -> DataFrame:
        return self.table("analyses").filter(F.col("analysis_id") == analysis_id)

    def _require(self, analysis_id: str) -> None:
        if self.find_analysis(analysis_id).isEmpty():
            raise LookupError(f"The history knows no analysis '{analysis_id}'.")

    def find_by_hash(self, content_hash: str) -> DataFrame:
        """Earlier runs over the same content."""
        return self.table("analyses").filter(F.col("content_hash") == content_hash)

    def recent_analyses(self, limit: int = 20) -> DataFrame:
        return self.table("analyses").orderBy(F.desc("created_at"), F.desc("analysis_id")).limit(limit)

    def audit_trail(self, analysis_id: str) -> DataFrame:
        """Events of one analysis, oldest first."""
        self._require(analysis_id)
        return self.table("audit_events").filter(F.col("analysis_id") == analysis_id).orderBy("occurred_at")

    def applied_changes(self, analysis_id: str) -> DataFrame:
        self._require(analysis_id)
        return self.table("applied_changes").filter(F.col("analysis_id") == analysis_id).orderBy("applied_at", "position")

    def usage_totals(self) -> DataFrame:
        """Calls and tokens over the whole call log."""
        return self.table("call_log").agg(
            F.count(F.lit(1)).alias("calls"),
            F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        )


def _by_id():
    from pyspark.sql import Window

    # One row per applied correction: metadata-sized, so a single window task is fine.
    return Window.orderBy(F.monotonically_increasing_id())
