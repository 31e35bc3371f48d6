"""Profile, check and score a table."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.severity import percent, ratio_severity
from plumbline.operators import checks, profile
from plumbline.operators.checks import Context, run_isolated
from plumbline.operators.dataset import Dataset, Intermediates, col, collecting, materialise, pinned, small_table
from plumbline.operators.evidence import attach_rows
from plumbline.operators.findings import FINDING_COLUMNS, as_findings, details, finding, phrase
from plumbline.operators.frequency import NEAR_UNIQUE, Frequencies, folded_counts, frequencies, trimmed_counts, whole_texts
from plumbline.operators.rules import RuleSet, business_rules
from plumbline.operators.profile import FACTS_SCHEMA, MEASURED_SCHEMA
from plumbline.operators.score import column_scores, quality_score


@dataclass
class Review:
    """The measured state of one table: frequencies, facts and the profile.

    ``trimmed`` has the trimmed texts of :attr:`values`.
    """

    data: Dataset
    as_of: date
    frequencies: Frequencies
    trimmed: DataFrame
    facts: DataFrame
    fact_rows: list
    profiles: DataFrame
    row_count: int

    @property
    def values(self) -> DataFrame:
        """The frequency table: of nearly unique columns only the values that something is said about."""
        return self.frequencies.values


@dataclass
class Analysis:
    """The result of one run. Every table is small except the data itself.

    ``skipped`` names the checks that failed, with the reason; their findings are missing.
    """

    review: Review
    findings: DataFrame
    column_scores: DataFrame
    score: DataFrame
    skipped: DataFrame
    rules: RuleSet | None = None
    row_ids: bool = True
    only: Iterable[str] | None = None
    near_unique: int = NEAR_UNIQUE
    analysis_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    created_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    intermediates: Intermediates = field(default_factory=Intermediates)
    given: Dataset | None = None

    def release(self) -> None:
        """Give back the space of the tables computed on the way; findings, profiles and scores stay."""
        if self.given is not None:
            # The data may be such a table; from here on it is read as it was given.
            self.review = replace(self.review, data=self.given)
        self.intermediates.release()

    @property
    def data(self) -> Dataset:
        return self.review.data

    @property
    def profiles(self) -> DataFrame:
        return self.review.profiles

    @property
    def row_count(self) -> int:
        return self.review.row_count

    def summary(self) -> dict:
        """Key figures, free of cell values."""
        return {
            "analysis_id": self.analysis_id,
            "rows": self.row_count,
            "columns": len(self.data.columns),
            "findings": self.findings.count(),
            "quality_score": self.score.first().overall,
            "skipped_checks": [row.check_id for row in self.skipped.collect()],
        }


def measure(data: Dataset, as_of: date | None = None, least: int = NEAR_UNIQUE) -> Review:
    """Value frequencies, per-column facts and profiles of a table.

    Columns of more than ``least`` values, nearly all of them distinct, are measured by their cells.
    """
    as_of = as_of or date.today()
    known = frequencies(data, least)
    data = known.data
    trimmed = materialise(trimmed_counts(known.values))
    return reviewed(data, as_of, known, trimmed, column_facts(data, as_of, known, trimmed))


def reviewed(data: Dataset, as_of: date, known: Frequencies, trimmed: DataFrame, facts: list[dict]) -> Review:
    """A review from the facts of all columns."""
    rows = sorted(facts, key=lambda fact: fact["pos"])
    table = small_table(data.spark, rows, FACTS_SCHEMA)
    profiles = with_whole_values(data, profile.profiles(table))
    return Review(data, as_of, known, trimmed, table, rows, profiles, rows[0]["row_count"] if rows else 0)


def with_whole_values(data: Dataset, profiles: DataFrame) -> DataFrame:
    """Profiles whose top and sample values are the values themselves, however long."""
    table, rows = pinned(profiles)
    shown = {row["position"]: {*row["sample_values"], *(entry["value"] for entry in row["top_values"])} for row in rows}
    whole = whole_texts(data, shown)
    if not whole:
        return table
    for row in rows:
        row["sample_values"] = [whole.get((row["position"], value), value) for value in row["sample_values"]]
        row["top_values"] = [{**entry, "value": whole.get((row["position"], entry["value"]), entry["value"])} for entry in row["top_values"]]
    return small_table(data.spark, rows, table.schema)


def column_facts(data: Dataset, as_of: date, known: Frequencies, trimmed: DataFrame) -> list[dict]:
    """All facts of the columns that ``known`` covers, a row for each.

    Questions that need no answer of each other are asked in one query: their answers are rows of
    one table, told apart by the columns they fill, and are put together by column here.
    """
    spark, values, folded = data.spark, known.values, folded_counts(trimmed)
    counts = {row["pos"]: {**row.asDict(recursive=True), **known.distinct_of(row["pos"])} for row in profile.measures(known.weighted(), as_of).collect()}
    counts = profile.with_means(counts)
    numeric = [fact for fact in counts.values() if fact["number_count"]]
    numbers = known.weighted([fact["pos"] for fact in numeric])
    answered(counts, [known.distinct_texts(folded), *([profile.squared_distances(numbers, numeric)] if numeric else [])])
    for fact in counts.values():
        fact["std_dev"] = profile.std_dev(fact.pop("squares", None), fact["number_count"])
    described = [{**row, **counts[row["pos"]]} for row in profile.column_rows(data) if row["pos"] in counts]
    typed = checks.with_counts(profile.typed_facts(small_table(spark, described, MEASURED_SCHEMA)), as_of)
    facts = {row["pos"]: row.asDict(recursive=True) for row in typed.collect()}

    near = [pos for pos in known.near_unique if checks.may_offend(facts[pos])]
    shown = trimmed.select("pos", F.col("t").alias("shown"), "n", "first_row").unionByName(
        values.filter("present AND NOT is_text").select("pos", "shown", "n", "first_row")
    )
    rows = list(facts.values())
    parts = [
        profile.top_values(shown),
        profile.sample_values(values),
        checks.example_facts(known.ordinary, rows, FACTS_SCHEMA, as_of, known.cells(near)),
        *checks.filler_facts(folded, rows, FACTS_SCHEMA),
    ]
    for kind in checks.VARIANTS:
        if checks.variant_positions(kind, rows):
            parts += checks.variant_facts(trimmed, rows, kind)
    if numeric:
        measured = small_table(spark, described, MEASURED_SCHEMA)
        parts += [
            profile.extremes(numbers, [facts[fact["pos"]] for fact in numeric]),
            profile.medians(numbers, measured, sliced=list(known.near_unique)),
        ]
    answered(facts, parts)
    forms = checks.variant_forms(trimmed, facts)
    written = {(row.pos, row.kind, row.name): row.forms for row in forms.collect()} if forms is not None else {}
    for pos, fact in facts.items():
        for kind in checks.VARIANTS:
            names = fact.pop(f"{kind}_names", None)
            fact[f"{kind}_groups"] = [{"name": e["name"], "forms": written[pos, kind, e["name"]]} for e in names] if names else None
    return [{name: fact.get(name) for name in FACTS_SCHEMA.names} for fact in facts.values()]


def answered(facts: dict[int, dict], parts: list[DataFrame]) -> None:
    """Put the answers of some tables ``pos, ...`` into the facts of their columns, from one query."""
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for row in together.collect():
        facts[row["pos"]].update({name: value for name, value in row.asDict(recursive=True).items() if value is not None})


def analyze(
    data: Dataset,
    rules: RuleSet | None = None,
    as_of: date | None = None,
    row_ids: bool = True,
    only: Iterable[str] | None = None,
    near_unique: int = NEAR_UNIQUE,
) -> Analysis:
    """Measure, check and score a table.

    ``as_of`` is the day that future dates are judged against. ``row_ids`` adds the first
    rows behind each finding, at the price of another pass over the table. ``near_unique`` is
    the least number of values from which a column can count as nearly unique; results do not
    depend on it.
    """
    only = None if only is None else list(only)
    with collecting() as intermediates:
        review = measure(data, as_of, near_unique)
        context = Context(review.data, review.facts, review.row_count, review.as_of, rules, row_ids, data.notes)
        run = run_isolated(context, only)
        found = run.findings
        if row_ids:
            found, _ = pinned(attach_rows(review, found))
        scores, _ = pinned(column_scores(found, review.profiles))
        total, _ = pinned(quality_score(found, scores))
    return Analysis(review, found, scores, total, run.skipped, rules, row_ids, only, near_unique, intermediates=intermediates, given=data)


def structural_findings(data: Dataset, rules: RuleSet | None = None, as_of: date | None = None) -> DataFrame:
    """Missing values, constant columns, exact duplicates and rules, by aggregates alone.

    No value frequencies and no row ids: one scan for the first two checks, one narrow
    grouping for duplicates, one scan for all single-row rules.
    """
    measured, rows = pinned(structural_measures(data))
    row_count = rows[0]["row_count"] if rows else 0
    ratio = F.try_divide(F.col("missing_count"), F.col("row_count"))
    missing = finding(
        "missing_values", "missing_values", ratio_severity(ratio), F.col("column"),
        phrase("Missing values in '%s'", F.col("column")),
        phrase("%,d cells of '%s' hold no value (%s of rows).", F.col("missing_count"), F.col("column"), percent(ratio)),
        F.col("missing_count"), F.col("row_count"), details(missing_ratio=F.round(ratio, 4)),
    )
    populated = F.col("row_count") - F.col("missing_count")
    constant = finding(
        "constant_column", "constant_column", F.lit("info"), F.col("column"),
        phrase("'%s' never varies", F.col("column")),
        phrase("All filled cells of '%s' say '%s'. Confirm that this is intended.", F.col("column"), F.col("lowest")),
        populated, F.col("row_count"), details(constant_value=F.col("lowest")),
    )
    is_constant = (F.col("row_count") >= 2) & (populated > 0) & (F.col("lowest") == F.col("highest"))
    found = as_findings(
        measured, [F.when(F.col("missing_count") > 0, missing), F.when(is_constant, constant)]
    )
    context = Context(data, measured, row_count, as_of or date.today(), rules, row_ids=False, notes=data.notes)
    found = found.unionByName(checks.exact_duplicates(context))
    if rules is not None:
        found = found.unionByName(business_rules(context))
    return found.select(*FINDING_COLUMNS)


def structural_measures(data: Dataset) -> DataFrame:
    """Missing cells and the lowest and highest filled value of every column, in one scan.

    Equal extremes mean a constant column; no distinct count is needed.
    """
    sums, rows = [F.count(F.lit(1)).alias("row_count")], []
    for position, field_ in enumerate(data.fields):
        gap = tx.missing(col(field_.name), field_.dataType)
        orderable = field_.dataType.typeName() not in ("map", "variant", "array", "struct", "binary")
        filled = F.when(~gap, col(field_.name)) if orderable else F.lit(None)
        sums += [
            F.count_if(gap).alias(f"g{position}"), F.min(filled).alias(f"a{position}"), F.max(filled).alias(f"z{position}")
        ]
        rows.append(
            F.struct(
                F.lit(field_.name).alias("column"),
                F.col(f"g{position}").alias("missing_count"),
                F.col(f"a{position}").cast("string").alias("lowest"),
                F.col(f"z{position}").cast("string").alias("highest"),
            )
        )
    return data.frame.agg(*sums).select("row_count", F.inline(F.array(*rows)))
