"""From findings to corrected data: propose, decide, apply, and measure again."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import ground
from plumbline.operators.apply import Cleaned, apply_corrections, corrected_values, previews
from plumbline.operators.checks import Context, run_isolated
from plumbline.operators.dataset import ROW_ID, Dataset, collecting, materialise, pinned, small_table
from plumbline.operators.evidence import attach_rows
from plumbline.operators.findings import DETERMINISTIC
from plumbline.operators.frequency import Frequencies, frequencies, recounted, trimmed_counts
from plumbline.operators.propose import Proposals, propose
from plumbline.operators.score import column_scores, quality_score
from plumbline.plans.analysis import Analysis, Review, analyze, column_facts, reviewed


@dataclass(frozen=True)
class CleanedRun:
    """A corrected table, what was changed, and the new analysis."""

    cleaned: Cleaned
    after: Analysis
    outcome: DataFrame

    @property
    def data(self) -> Dataset:
        return self.cleaned.data

    @property
    def applied(self) -> DataFrame:
        return self.cleaned.applied


def offer(analysis: Analysis, with_previews: bool = True) -> Proposals:
    """Corrections for the findings, worst first, with the first cells each would change."""
    proposals = propose(analysis)
    if not with_previews:
        return proposals
    table, _ = pinned(proposals.table.join(F.broadcast(previews(analysis.data, proposals)), "proposal_id", "left"))
    return Proposals(table, proposals.mappings)


#: Corrections that look at other columns too, or at whole rows.
_BEYOND_THE_COLUMN = ("fill_from_related", "drop_duplicate_rows")


def clean(analysis: Analysis, proposals: Proposals, decisions: DataFrame) -> CleanedRun:
    """Apply what was approved, and measure the result again as far as it changed.

    Where no row was removed, only corrected columns are measured again, from their corrected values
    where that is enough; facts and evidence of all other columns stay. The checks that look at whole
    rows read the table again.
    """
    cleaned = apply_corrections(analysis.data, proposals, decisions)
    kept = cleaned.data
    if cleaned.rows_removed:
        after = analyze(kept, analysis.rules, analysis.review.as_of, analysis.row_ids, near_unique=analysis.near_unique)
    else:
        after = analyze_again(analysis, kept, proposals, [row.asDict() for row in cleaned.applied.collect()])
    before = analysis.score.select(F.col("overall").alias("score_before"))
    outcome, _ = pinned(
        before.crossJoin(F.broadcast(after.score.select(F.col("overall").alias("score_after")))).select(
            "score_before",
            "score_after",
            F.round(F.col("score_after") - F.col("score_before"), 2).alias("score_delta"),
            F.lit(analysis.row_count).alias("rows_before"),
            F.lit(after.row_count).alias("rows_after"),
            F.lit(cleaned.rows_removed).alias("rows_removed"),
            F.lit(cleaned.cells_changed).alias("cells_changed"),
        )
    )
    return CleanedRun(Cleaned(kept, cleaned.applied, cleaned.rows_removed, cleaned.cells_changed), after, outcome)


def analyze_again(analysis: Analysis, data: Dataset, proposals: Proposals, applied: list[dict]) -> Analysis:
    """The analysis of a table that differs by some corrections of cells from one that is analysed already."""
    with collecting() as intermediates:
        review = _measured_again(analysis, data, proposals, applied)
        context = Context(data, review.facts, review.row_count, review.as_of, analysis.rules, analysis.row_ids, data.notes)
        run = run_isolated(context, analysis.only)
        changed = {offer["column"] for offer in applied}
        found = run.findings
        if analysis.row_ids:
            # Evidence of other columns' findings is what it was.
            known = {row.finding_id: row.row_ids for row in analysis.findings.filter("column IS NOT NULL").collect() if row["column"] not in changed}
            rows = [row.asDict(recursive=True) for row in found.collect()]
            same = [{**row, "row_ids": known[row["finding_id"]]} for row in rows if row["finding_id"] in known]
            others = [row for row in rows if row["finding_id"] not in known]
            found, _ = pinned(small_table(data.spark, same, found.schema).unionByName(attach_rows(review, small_table(data.spark, others, found.schema))))
        scores, _ = pinned(column_scores(found, review.profiles))
        total, _ = pinned(quality_score(found, scores))
    return Analysis(review, found, scores, total, run.skipped, analysis.rules, analysis.row_ids, analysis.only, analysis.near_unique, intermediates=intermediates, given=data)


def _measured_again(analysis: Analysis, data: Dataset, proposals: Proposals, applied: list[dict]) -> Review:
    """The review after some corrections: other columns keep their values and facts."""
    before = analysis.review
    positions = {data.columns.index(offer["column"]): offer["column"] for offer in applied}
    same = [p for p in range(len(data.columns)) if p not in positions]
    if not positions:
        return replace(before, data=data, frequencies=replace(before.frequencies, data=data))
    facts = {fact["pos"]: fact for fact in before.fact_rows}
    counted, afresh = [], []
    for p, name in positions.items():
        offers = [offer for offer in applied if offer["column"] == name]
        whole = facts[p]["kind"] == "text" and not facts[p]["has_long"] and p not in before.frequencies.near_unique
        if whole and not any(offer["action"] in _BEYOND_THE_COLUMN for offer in offers):
            values = before.frequencies.ordinary.filter(F.col("pos") == p).select(F.col("s").alias(name), "n", F.col("first_row").alias(ROW_ID))
            frame, data_type = corrected_values(values, name, before.data.type_of(name), proposals, offers)
            counted.append(recounted(frame.withColumnRenamed(ROW_ID, "first_row"), name, data_type, p))
        else:
            afresh.append(p)
    known = frequencies(data, analysis.near_unique, afresh) if afresh else replace(before.frequencies.of([]), data=data)
    if counted:
        known = replace(known, ordinary=known.ordinary.unionByName(materialise(reduce(DataFrame.unionByName, counted))))
    trimmed = materialise(trimmed_counts(known.values))
    new = column_facts(data, before.as_of, known, trimmed)
    old = before.frequencies.of(same)
    merged = Frequencies(data, old.ordinary.unionByName(known.ordinary), old.kept.unionByName(known.kept), old.near_unique | known.near_unique)
    texts = before.trimmed.filter(F.col("pos").isin(same)).unionByName(trimmed)
    return reviewed(data, before.as_of, merged, texts, [facts[p] for p in same if p in facts] + new)


@dataclass(frozen=True)
class Advice:
    """What survived of a set of suggestions, and why the rest did not."""

    findings: DataFrame
    proposals: Proposals
    rejected: DataFrame


def occurring_levels(analysis: Analysis) -> DataFrame:
    """``column, t, n``: every trimmed text value of the table with its rows."""
    names = analysis.review.facts.select("pos", "column")
    return analysis.review.frequencies.levels().join(F.broadcast(names), "pos").select("column", "t", "n")


def advise(
    analysis: Analysis,
    mappings: DataFrame | None = None,
    descriptions: DataFrame | None = None,
    rules: DataFrame | None = None,
    explanations: DataFrame | None = None,
) -> Advice:
    """Ground suggestions from outside and turn the sound ones into advisory findings.

    None of this moves the score; a mapping becomes a proposal like any other.
    """
    spark, count = analysis.data.spark, analysis.row_count
    columns, levels = analysis.profiles.select("column"), occurring_levels(analysis)
    found = analysis.findings.limit(0)
    refused = spark.createDataFrame([], "task string, reason string")
    offers = Proposals(
        spark.createDataFrame([], "proposal_id string, finding_id string, action string, source string, `column` string, "
                              "title string, description string, rationale string, parameters map<string,string>, "
                              "affected_rows bigint, destructive boolean, confidence double, position int"),
        spark.createDataFrame([], "proposal_id string, from_value string, to_value string"),
    )

    def reasons(task: str, grounded: DataFrame) -> DataFrame:
        return grounded.filter("NOT accepted").select(F.lit(task).alias("task"), "reason")

    if descriptions is not None:
        grounded = ground.ground_descriptions(descriptions, columns)
        found = found.unionByName(ground.description_findings(grounded, count))
        refused = refused.unionByName(reasons("description", grounded))
    if mappings is not None:
        grounded = ground.ground_mappings(mappings, columns, levels)
        advisory = ground.mapping_findings(grounded, levels, count)
        found = found.unionByName(advisory)
        offers = Proposals(*ground.mapping_proposals(grounded, advisory))
        refused = refused.unionByName(reasons("mapping", grounded))
    if explanations is not None:
        severe = analysis.findings.filter(F.col("severity").isin("critical", "high") & (F.col("source") == DETERMINISTIC))
        found = found.unionByName(ground.explanation_findings(explanations, severe))
        _, unknown = ground.ground_explanations(explanations, severe)
        refused = refused.unionByName(
            unknown.select(F.lit("explanation").alias("task"),
                           F.format_string("No such finding: '%s'.", "finding_reference").alias("reason"))
        )
    if rules is not None:
        grounded = ground.ground_rules(rules, columns, levels)
        names = [rule.name for rule in analysis.rules.rules] if analysis.rules else []
        found = found.unionByName(ground.rule_findings(grounded, count, names))
        refused = refused.unionByName(reasons("rule", grounded))
    return Advice(found, offers, refused)
