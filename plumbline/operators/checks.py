"""The deterministic checks.

A column check is an expression over the facts table, which has one row per column; all of
them run in one projection. A dataset check is a function returning findings. Register more
of either kind with :func:`column_check` and :func:`dataset_check`.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import naming
from plumbline.functions import text as tx
from plumbline.functions.dates import DATE_FORMATS
from plumbline.functions.severity import percent, ratio_severity
from plumbline.operators.dataset import (
    ROW_ID,
    Dataset,
    beside_facts,
    col,
    digest_part,
    first_per_group,
    lookup,
    materialise,
    pinned,
    row_digest,
    small_table,
)
from plumbline.operators.findings import (
    EVIDENCE_ROWS,
    FINDING_COLUMNS,
    as_findings,
    details,
    finding,
    no_findings,
    phrase,
)
from plumbline.operators.isolation import halved, reason, surviving

log = logging.getLogger(__name__)

SIGMA = 5.0
MIN_NUMBERS_FOR_EXTREMES = 20
KIND_SHARE = 0.1
EXAMPLES = 5
LISTED = 20


@dataclass(frozen=True)
class Context:
    """What a dataset check may look at."""

    data: Dataset
    facts: DataFrame
    row_count: int
    as_of: date
    rules: object = None
    row_ids: bool = True
    notes: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class Verdict:
    """A column check's answer, as expressions over the facts table."""

    fires: Column
    severity: Column
    affected: Column
    title: Column
    explanation: Column
    details: Column
    confidence: float = 1.0


COLUMN_CHECKS: dict[str, tuple[str, Callable[[], Verdict]]] = {}
DATASET_CHECKS: dict[str, Callable[[Context], DataFrame]] = {}


def column_check(check_id: str, issue: str | None = None):
    """Register a check that judges one column at a time from its facts."""

    def register(build: Callable[[], Verdict]):
        _require_new(check_id)
        COLUMN_CHECKS[check_id] = (issue or check_id, build)
        return build

    return register


def dataset_check(check_id: str):
    """Register a check that looks at whole rows."""

    def register(run: Callable[[Context], DataFrame]):
        _require_new(check_id)
        DATASET_CHECKS[check_id] = run
        return run

    return register


def _require_new(check_id: str) -> None:
    if check_id in COLUMN_CHECKS or check_id in DATASET_CHECKS:
        raise ValueError(f"A check named {check_id!r} is already registered.")


def check_ids() -> list[str]:
    return sorted([*COLUMN_CHECKS, *DATASET_CHECKS])


#: Checks that several parts of their own make up: check id -> the contexts of two halves, none when there is one part.
HALVES: dict[str, Callable[[Context], list[Context]]] = {}


@dataclass
class _Part:
    """A check, or half of one, that gives findings and may fail while it is built or run."""

    check_id: str
    context: Context
    found: DataFrame | None = None

    def findings(self) -> DataFrame:
        if self.found is None:
            self.found = DATASET_CHECKS[self.check_id](self.context).select(*FINDING_COLUMNS)
        return self.found


def _together(parts: Sequence[_Part]) -> DataFrame:
    """Findings of some checks: all column checks in one projection, then the others."""
    context = parts[0].context
    structs = [
        _column_finding(part.check_id, *COLUMN_CHECKS[part.check_id], context.data.spark.sparkContext)
        for part in parts
        if part.check_id in COLUMN_CHECKS
    ]
    found = as_findings(context.facts, structs) if structs else no_findings(context.data.spark)
    for part in parts:
        if part.check_id in DATASET_CHECKS:
            found = found.unionByName(part.findings())
    return found


def _parts(context: Context, only: Iterable[str] | None) -> list[_Part]:
    wanted = set(check_ids() if only is None else only)
    return [_Part(check_id, context) for check_id in [*sorted(COLUMN_CHECKS), *sorted(DATASET_CHECKS)] if check_id in wanted]


def run_checks(context: Context, only: Iterable[str] | None = None) -> DataFrame:
    """Findings of every check, or of those in ``only``, as one plan.

    A check that cannot be built is left out. One that fails while the plan runs fails the plan;
    see :func:`run_isolated`.
    """
    parts = _parts(context, only)
    kept, refused = surviving(parts, lambda some: _together(some))
    _report(refused)
    return _together(kept) if kept else no_findings(context.data.spark)


@dataclass(frozen=True)
class CheckRun:
    """What the checks found, and which of them failed: ``check_id, part, reason``."""

    findings: DataFrame
    skipped: DataFrame


_SKIPPED_DDL = "check_id string, part string, reason string"


def run_isolated(context: Context, only: Iterable[str] | None = None) -> CheckRun:
    """Findings of every check, or of those in ``only``, computed now.

    All checks run in one plan. If that fails, halves of them run, down to the checks at fault,
    which are named and skipped; a rule set is halved on down to its rules. If several checks run and
    all of them fail, the fault is not theirs and the first error is raised.
    """
    parts = _parts(context, only)

    def attempt(some: Sequence[_Part]) -> list[dict]:
        return [row.asDict(recursive=True) for row in _together(some).collect()]

    results, refused = halved(parts, attempt)
    if len(parts) > 1 and len(refused) == len(parts):
        raise refused[0][1]
    failed: list[tuple[_Part, Exception]] = []
    while refused:
        part, error = refused.pop()
        halves = HALVES[part.check_id](part.context) if part.check_id in HALVES else []
        if not halves:
            failed.append((part, error))
            continue
        more, fail = halved([_Part(part.check_id, half) for half in halves], attempt)
        results += more
        refused += fail
    _report(failed)
    rows = [row for result in results for row in result]
    spark = context.data.spark
    skipped = [(part.check_id, _part_name(part), reason(error)) for part, error in failed]
    return CheckRun(small_table(spark, rows, no_findings(spark).schema), spark.createDataFrame(sorted(skipped, key=str), _SKIPPED_DDL))


def _part_name(part: _Part) -> str | None:
    rules = getattr(part.context.rules, "rules", ()) if part.check_id in HALVES else ()
    return rules[0].name if len(rules) == 1 else None


def _report(failed: list[tuple[_Part, Exception]]) -> None:
    for part, error in failed:
        log.error("Check %s failed and is skipped: %s", part.check_id, reason(error))


@lru_cache(maxsize=256)
def _column_finding(check_id: str, issue: str, build: Callable[[], Verdict], _: SparkContext) -> Column:
    """A check's finding; the expression is the same for every table, so it is kept."""
    verdict = build()
    struct = finding(
        check_id, issue, verdict.severity, F.col("column"), verdict.title, verdict.explanation,
        verdict.affected, F.col("row_count"), verdict.details, verdict.confidence,
    )
    return F.when(verdict.fires & (F.col("row_count") > 0), struct)


# ------------------------------------------------------------------ shared expressions


def _share(count: str) -> Column:
    return F.try_divide(F.col(count), F.col("row_count"))


def _examples(check: str) -> Column:
    listed = F.try_element_at(F.col("examples"), F.lit(check))
    return F.coalesce(listed, F.array().cast("array<string>"))


def _quoted(check: str) -> Column:
    return F.concat(F.lit("'"), F.array_join(_examples(check), "', '"), F.lit("'"))


def _counted(sentence: str, count: str, *more: Column) -> Column:
    """A sentence that starts with a count, a column name and a share."""
    return phrase(sentence, F.col(count), F.col("column"), percent(_share(count)), *more)


def _titled(template: str) -> Column:
    return phrase(template, F.col("column"))


# ------------------------------------------------------------------ completeness


@column_check("missing_values")
def _missing_values() -> Verdict:
    ratio = _share("missing_count")
    empty = F.when(ratio >= 1, " Nothing in the column is filled in.").otherwise("")
    return Verdict(
        F.col("missing_count") > 0,
        F.when(ratio >= 1, "critical").otherwise(ratio_severity(ratio, medium=0.02)),
        F.col("missing_count"),
        _titled("Missing values in '%s'"),
        _counted("%,d cells of '%s' hold no value (%s of rows).%s", "missing_count", empty),
        details(missing_ratio=F.round(ratio, 4), semantic_type=F.col("semantic_type")),
    )


@column_check("constant_column")
def _constant_column() -> Verdict:
    value = F.try_element_at(F.col("top_values"), F.lit(1))["value"]
    return Verdict(
        (F.col("row_count") >= 2) & (F.col("unique_count") == 1) & (F.col("present_count") > 0),
        F.lit("info"),
        F.col("present_count"),
        _titled("'%s' never varies"),
        phrase("All filled cells of '%s' say '%s'. Confirm that this is intended.", F.col("column"), value),
        details(constant_value=value),
    )


@column_check("placeholder_values", "placeholder_value")
def _placeholder_values() -> Verdict:
    listed = F.coalesce(F.col("filler_values"), F.array().cast("array<string>"))
    shown = F.array_join(F.slice(listed, 1, EXAMPLES), "', '")
    return Verdict(
        F.col("is_text") & (F.col("filler_rows") > 0),
        ratio_severity(_share("filler_rows")),
        F.col("filler_rows"),
        _titled("Placeholders in '%s'"),
        _counted(
            "%,d cells of '%s' (%s) say something like '%s' in place of a value. They are gaps that "
            "counts of missing cells do not see.",
            "filler_rows", shown,
        ),
        details(values=listed),
    )


# ------------------------------------------------------------------ validity


@column_check("invalid_date")
def _invalid_date() -> Verdict:
    return Verdict(
        F.col("is_text") & F.col("is_temporal") & (F.col("undated_count") > 0),
        ratio_severity(_share("undated_count")),
        F.col("undated_count"),
        _titled("Invalid dates in '%s'"),
        _counted("%,d cells of '%s' (%s) name no day of the calendar in any known format: %s.",
                 "undated_count", _quoted("invalid_date")),
        details(examples=_examples("invalid_date")),
    )


@column_check("inconsistent_date_format")
def _inconsistent_date_format() -> Verdict:
    labelled = F.zip_with(
        F.array(*map(F.lit, DATE_FORMATS)),
        F.col("format_counts"),
        lambda label, count: F.struct((-count).alias("order"), label.alias("label"), count.alias("count")),
    )
    seen = F.array_sort(F.filter(labelled, lambda e: e["count"] > 0))
    named = F.transform(F.slice(seen, 1, 4), lambda e: F.concat(e["label"], F.lit(" ("), e["count"].cast("string"), F.lit(")")))
    counts = F.map_from_entries(F.transform(F.slice(seen, 1, 10), lambda e: F.struct(e["label"], e["count"])))
    return Verdict(
        F.col("is_text") & F.col("is_temporal") & (F.col("date_count") > 0) & (F.col("every_format") == 0),
        F.lit("high"),
        F.col("date_count"),
        _titled("Mixed date formats in '%s'"),
        phrase("'%s' follows no single date format; it mixes %s. Decide which convention applies before "
               "parsing: 01/02/2024 is two different days.", F.col("column"), F.array_join(named, ", ")),
        details(format_counts=counts),
        0.9,
    )


@column_check("invalid_email")
def _invalid_email() -> Verdict:
    return Verdict(
        F.col("is_text") & (F.col("semantic_type") == "email") & (F.col("bad_email_count") > 0),
        ratio_severity(_share("bad_email_count")),
        F.col("bad_email_count"),
        _titled("Invalid email addresses in '%s'"),
        _counted("%,d cells of '%s' (%s) are not usable addresses: %s.", "bad_email_count", _quoted("invalid_email")),
        details(examples=_examples("invalid_email")),
    )


@column_check("numeric_stored_as_text")
def _numeric_stored_as_text() -> Verdict:
    unreadable = F.col("present_count") - F.col("number_count")
    words = F.when(unreadable > 0, phrase(" and %,d are no numbers at all", unreadable)).otherwise("")
    return Verdict(
        F.col("is_text") & F.col("is_numeric") & ((F.col("decorated_count") > 0) | (unreadable > 0)),
        F.lit("medium"),
        F.col("number_count"),
        _titled("'%s' holds numbers as text"),
        phrase("'%s' is numeric, but %,d cells carry signs or separators that a plain conversion rejects%s: %s.",
               F.col("column"), F.col("decorated_count"), words, _quoted("numeric_stored_as_text")),
        details(
            parseable=F.col("number_count"), unparseable=unreadable, decorated=F.col("decorated_count"),
            examples=_examples("numeric_stored_as_text"),
        ),
    )


@column_check("impossible_numeric")
def _impossible_numeric() -> Verdict:
    count = F.col("impossible_count")
    reason = F.when(F.col("age_name"), "outside the human range 0-120").otherwise("negative, unlike any real amount")
    return Verdict(
        F.col("is_numeric") & (count > 0),
        F.lit("high"),
        count,
        _titled("Impossible values in '%s'"),
        _counted("%,d cells of '%s' (%s) are %s: %s.", "impossible_count", reason, _quoted("impossible_numeric")),
        details(examples=_examples("impossible_numeric"), reason=reason),
    )


@column_check("suspicious_numeric")
def _suspicious_numeric() -> Verdict:
    return Verdict(
        F.col("is_numeric") & (F.col("number_count") >= MIN_NUMBERS_FOR_EXTREMES) & (F.col("extreme_count") > 0),
        F.lit("low"),
        F.col("extreme_count"),
        _titled("Extreme values in '%s'"),
        phrase("%,d cells of '%s' lie more than five standard deviations from the mean (%,.2f, deviation %,.2f): "
               "%s. They may be right; look before you act.",
               F.col("extreme_count"), F.col("column"), F.col("mean"), F.col("std_dev"), _quoted("suspicious_numeric")),
        details(
            mean=F.round("mean", 4), std_dev=F.round("std_dev", 4), sigma_threshold=F.lit(SIGMA),
            examples=_examples("suspicious_numeric"),
        ),
        0.6,
    )


@column_check("future_date")
def _future_date() -> Verdict:
    return Verdict(
        F.col("is_temporal") & F.col("past_name") & (F.col("future_count") > 0),
        F.lit("high"),
        F.col("future_count"),
        _titled("Future dates in '%s'"),
        _counted("%,d cells of '%s' (%s) lie in the future, though the name speaks of something past: %s.",
                 "future_count", _quoted("future_date")),
        details(examples=_examples("future_date"), evaluated_on=F.col("as_of").cast("string")),
    )


# ------------------------------------------------------------------ consistency and format


def _groups_shown(groups: str) -> Column:
    listed = F.transform(F.slice(F.col(groups), 1, 3), lambda g: F.array_join(F.slice(g["forms"], 1, 4), " / "))
    return F.array_join(listed, "; ")


def _groups_listed(groups: str) -> Column:
    return F.map_from_entries(
        F.transform(F.slice(F.col(groups), 1, LISTED), lambda g: F.struct(g["name"], g["forms"]))
    )


@column_check("inconsistent_category")
def _inconsistent_category() -> Verdict:
    return Verdict(
        F.col("is_text") & (F.col("category_rows") > 0),
        F.lit("medium"),
        F.col("category_rows"),
        _titled("Inconsistent categories in '%s'"),
        phrase("%,d groups of values in '%s' differ only in spacing or punctuation (%,d rows): %s. Grouping by "
               "the column splits each of them.", F.col("category_group_count"), F.col("column"),
               F.col("category_rows"), _groups_shown("category_groups")),
        details(variant_groups=_groups_listed("category_groups")),
    )


@column_check("inconsistent_capitalization")
def _inconsistent_capitalization() -> Verdict:
    return Verdict(
        F.col("is_text") & (F.col("case_rows") > 0),
        F.lit("low"),
        F.col("case_rows"),
        _titled("Mixed capitalisation in '%s'"),
        phrase("%,d values of '%s' are written in more than one letter case (%,d rows): %s.",
               F.col("case_group_count"), F.col("column"), F.col("case_rows"), _groups_shown("case_groups")),
        details(variant_groups=_groups_listed("case_groups")),
    )


@column_check("mixed_datatypes")
def _mixed_datatypes() -> Verdict:
    total = F.nullif(F.col("present_count"), F.lit(0))
    kinds = ("numbers", "dates", "booleans", "text")
    shares = {kind: F.coalesce(F.try_divide(F.col(f"kind_{kind}"), total), F.lit(0.0)) for kind in kinds}
    large = sum((F.when(share >= KIND_SHARE, 1).otherwise(0) for share in shares.values()), F.lit(0))
    parts = [
        F.when(share >= KIND_SHARE, F.concat(F.format_string("%.0f%% ", share * 100), F.lit(kind)))
        for kind, share in shares.items()
    ]
    return Verdict(
        F.col("is_text") & ~F.col("semantic_type").isin("empty", "identifier") & (total >= 5) & (large >= 2),
        F.lit("medium"),
        F.col("present_count"),
        _titled("'%s' mixes data types"),
        phrase("'%s' holds %s. It cannot be stored under one type without losing rows.",
               F.col("column"), F.concat_ws(", ", *parts)),
        details(shares=F.struct(*[F.round(share, 4).alias(kind) for kind, share in shares.items()])),
        0.85,
    )


@column_check("leading_trailing_whitespace")
def _leading_trailing_whitespace() -> Verdict:
    return Verdict(
        F.col("is_text") & (F.col("padded_present") > 0),
        F.lit("low"),
        F.col("padded_present"),
        _titled("Padded values in '%s'"),
        _counted("%,d cells of '%s' (%s) start or end with white space, which breaks joins and grouping.", "padded_present"),
        details(examples=_examples("leading_trailing_whitespace")),
    )


@column_check("corrupted_encoding")
def _corrupted_encoding() -> Verdict:
    severity = ratio_severity(_share("damaged_count"))
    return Verdict(
        F.col("is_text") & (F.col("damaged_count") > 0),
        F.when(severity == "low", "medium").otherwise(severity),
        F.col("damaged_count"),
        _titled("Corrupted characters in '%s'"),
        _counted("%,d cells of '%s' (%s) were read with the wrong encoding; %,d can be decoded back and %,d lost bytes for good.",
                 "damaged_count", F.col("repairable_count"), F.col("lost_count")),
        details(examples=_examples("corrupted_encoding"), unrecoverable=F.col("lost_count")),
    )


# ------------------------------------------------------------------ facts behind the checks


def with_counts(facts: DataFrame, as_of: date) -> DataFrame:
    """Typed facts with the counts that several checks ask for."""
    return facts.withColumns(
        {
            "as_of": F.lit(as_of),
            "undated_count": F.col("present_count") - F.col("date_count"),
            "bad_email_count": F.col("present_count") - F.col("email_count"),
            "damaged_count": F.col("lost_count") + F.col("repairable_count"),
            "impossible_count": F.when(F.col("age_name"), F.col("implausible_age_count"))
            .when(F.col("amount_name"), F.col("negative_count"))
            .otherwise(0),
        }
    )


def _known_filler() -> Column:
    return F.col("filler") | (F.col("short_filler") & (F.col("longest") > tx.SHORT_TOKEN))


def _repeated_filler() -> Column:
    """A value that covers a hundredth of the rows where nearly all others are distinct."""
    floor = F.greatest(F.lit(5), F.floor(F.col("row_count") * 0.01))
    return (
        (F.col("distinct_folded") / F.col("present_count") >= 0.7)
        & (F.col("n") >= floor)
        & (F.col("n") / F.col("row_count") <= 0.5)
    )


def fillers(folded: DataFrame, facts: list[dict], types: T.StructType) -> DataFrame:
    """Folded values that stand in for a missing one: ``pos, fold, n, repeated``."""
    wanted = [fact for fact in facts if fact["is_text"]]
    known, repeated = F.coalesce(_known_filler(), F.lit(False)), _repeated_filler()
    return (
        beside_facts(folded, wanted, ["row_count", "present_count", "longest", "distinct_folded"], types)
        .filter(known | repeated)
        .select("pos", "fold", "n", (repeated & ~known).alias("repeated"))
    )


def filler_facts(folded: DataFrame, facts: list[dict], types: T.StructType) -> list[DataFrame]:
    """Rows holding placeholders, per column, and the first few placeholder values.

    Repeated fillers are all listed: each covers a hundredth of the rows or, in a small
    table, five rows, so there are a hundred at most.
    """
    found = fillers(folded, facts, types)
    listed = first_per_group(found, ["pos"], [F.asc("fold")], LISTED).groupBy("pos").agg(
        F.array_sort(F.collect_list("fold")).alias("filler_values")
    )
    counted = found.groupBy("pos").agg(
        F.sum("n").alias("filler_rows"),
        F.array_sort(F.collect_list(F.when(F.col("repeated"), F.col("fold")))).alias("repeated_fillers"),
    )
    return [counted, listed]


def spelling_variants(trimmed: DataFrame, positions: list[int], key: str, compared: str) -> DataFrame:
    """Keys written in several ways: ``pos, name, n, first_row`` of each.

    Values without a key, such as lone punctuation, are variants of nothing. Counts combine on the
    map side, so a key with very many forms is no large group.
    """
    keyed = trimmed.filter(F.col("pos").isin(positions) & (F.col(key) != ""))
    grouped = keyed.groupBy("pos", F.col(key).alias("name")).agg(
        F.sum("n").alias("n"),
        F.min("first_row").alias("first_row"),
        F.min(compared).alias("__low"),
        F.max(compared).alias("__high"),
    )
    return grouped.filter("__low <> __high").drop("__low", "__high")


#: Kind of spelling variants -> which columns have them, the key of a group and what differs within one.
VARIANTS: dict[str, tuple[Callable[[dict], bool], str, str]] = {
    "case": (lambda fact: bool(fact["is_text"] and fact["unique_count"]), "fold", "t"),
    "category": (lambda fact: bool(fact["is_text"] and fact["semantic_type"] in ("categorical", "boolean")), "key", "fold"),
}


def variant_positions(kind: str, facts: list[dict]) -> list[int]:
    """Columns whose values are compared by letter case, or by letters and digits."""
    return [fact["pos"] for fact in facts if VARIANTS[kind][0](fact)]


def variant_facts(trimmed: DataFrame, facts: list[dict], kind: str) -> list[DataFrame]:
    """Rows and number of the groups of spelling variants, per column, and the first groups."""
    _, key, compared = VARIANTS[kind]
    groups = spelling_variants(trimmed, variant_positions(kind, facts), key, compared)
    totals = groups.groupBy("pos").agg(F.sum("n").alias(f"{kind}_rows"), F.count(F.lit(1)).alias(f"{kind}_group_count"))
    first = first_per_group(groups, ["pos"], [F.asc("first_row"), F.asc("name")], LISTED)
    return [totals, first.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("__rank", "name"))).alias(f"{kind}_names"))]


def variant_forms(trimmed: DataFrame, facts: dict[int, dict]) -> DataFrame | None:
    """``pos, kind, name, forms``: the first few written forms of the groups that :func:`variant_facts` names."""
    wanted = [
        {"pos": pos, "kind": kind, "name": entry["name"]} for pos, fact in facts.items() for kind in VARIANTS for entry in fact.get(f"{kind}_names") or ()
    ]
    if not wanted:
        return None
    schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType())])
    named = trimmed.filter(F.col("pos").isin([row["pos"] for row in wanted])).select(
        "pos", "t", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(key).alias("name")) for kind, (_, key, _) in VARIANTS.items()])).alias("group")
    )
    forms = named.select("pos", "group.*", "t").join(F.broadcast(small_table(trimmed.sparkSession, wanted, schema)), ["pos", "kind", "name"])
    few = first_per_group(forms, ["pos", "kind", "name"], [F.asc("t")], LISTED)
    return few.groupBy("pos", "kind", "name").agg(F.array_sort(F.collect_list("t")).alias("forms"))


def may_offend(fact: dict) -> bool:
    """Whether any value of a column can be an example of :func:`example_facts`, by its counts."""
    text = fact["kind"] == "text"
    short_of = lambda count: text and fact["present_count"] > fact[count]
    return bool(
        (fact["is_temporal"] and (short_of("date_count") or (fact["past_name"] and fact["future_count"])))
        or (fact["semantic_type"] == "email" and short_of("email_count"))
        or (fact["is_numeric"] and (fact["decorated_count"] or fact["implausible_age_count"] or fact["negative_count"] or _reaches_far(fact)))
        or (text and (fact["padded_present"] or fact["repairable_count"]))
    )


def _reaches_far(fact: dict) -> bool:
    """Whether the extremes of a column lie far from its mean."""
    ends = [fact["mean"] - fact["min_number"], fact["max_number"] - fact["mean"]]
    return bool(fact["std_dev"]) and not max(ends) <= SIGMA * fact["std_dev"]


def example_facts(values: DataFrame, facts: list[dict], types: T.StructType, as_of: date, cells: DataFrame | None = None) -> DataFrame:
    """The first few offending values of each check: a map from check id to texts.

    ``cells`` has the cells of columns whose distinct values are not all in ``values``.
    """
    names = ["is_numeric", "is_temporal", "semantic_type", "age_name", "amount_name", "past_name", "mean", "std_dev"]
    number, text = F.col("number"), F.col("is_text") & F.col("present")
    impossible = F.when(F.col("age_name"), (number < 0) | (number > 120)).otherwise(F.col("amount_name") & (number < 0))
    raw = F.coalesce("s", "shown")
    offences = {
        "invalid_date": (text & F.col("is_temporal") & (F.col("mask") == 0), raw),
        "invalid_email": (text & (F.col("semantic_type") == "email") & ~F.col("email"), raw),
        "numeric_stored_as_text": (text & F.col("is_numeric") & number.isNotNull() & ~F.col("plain"), raw),
        "impossible_numeric": (F.col("is_numeric") & impossible, number.cast("string")),
        "suspicious_numeric": (
            F.col("is_numeric") & (F.col("std_dev") > 0) & (F.try_divide(F.abs(number - F.col("mean")), F.col("std_dev")) > SIGMA),
            number.cast("string"),
        ),
        "future_date": (
            F.col("is_temporal") & F.col("past_name") & (F.col("moment") > F.lit(as_of).cast("timestamp_ntz")),
            F.date_format("moment", "yyyy-MM-dd"),
        ),
        "leading_trailing_whitespace": (text & F.col("padded"), F.concat(F.lit("["), raw, F.lit("]"))),
        "corrupted_encoding": (
            text & F.col("repairable"),
            F.concat(raw, F.lit(" -> "), F.coalesce(tx.repair_encoding(F.col("s")), raw)),
        ),
    }
    flags = [
        F.when(hit, F.struct(F.lit(check).alias("check"), example.alias("example")))
        for check, (hit, example) in offences.items()
    ]

    def offending(table: DataFrame) -> DataFrame:
        return beside_facts(table, facts, names, types).select("pos", "first_row", raw.alias("raw"), F.inline(F.array_compact(F.array(*flags))))

    hits = offending(values)
    if cells is not None:
        # Cells repeat; a value is one example, however often it stands there.
        once = offending(cells).filter("example IS NOT NULL").groupBy("pos", "raw", "check", "example").agg(F.min("first_row").alias("first_row"))
        hits = hits.unionByName(once)
    hits = hits.drop("raw")
    ranked = first_per_group(
        hits.filter("example IS NOT NULL"), ["pos", "check"], [F.asc("first_row"), F.asc("example")], EXAMPLES
    )
    per_check = ranked.groupBy("pos", "check").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__rank", "example"))), lambda e: e["example"]).alias("texts")
    )
    return per_check.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("check", "texts"))).alias("examples"))


# ------------------------------------------------------------------ dataset checks


def _folded_digest(data: Dataset) -> Column:
    return row_digest([digest_part(col(f.name), f.dataType, True) for f in data.fields])


@dataset_check("exact_duplicate_rows")
def exact_duplicates(context: Context) -> DataFrame:
    """Rows that repeat an earlier one once text is trimmed and case ignored."""
    data = context.data
    rows = data.frame.select(ROW_ID, _folded_digest(data).alias("digest"))
    groups = materialise(
        rows.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias("kept"))
        .filter("n > 1")
    )
    totals = groups.agg(F.sum(F.col("n") - 1).alias("affected"), F.count(F.lit(1)).alias("groups")).filter("groups > 0")
    total, seen = pinned(totals.withColumn("row_count", F.lit(context.row_count)))
    if not seen:
        return no_findings(data.spark)
    ratio = F.try_divide(F.col("affected"), F.col("row_count"))
    struct = finding(
        "exact_duplicate_rows", "exact_duplicate_rows", F.when(ratio > 0.05, "high").otherwise("medium"),
        F.lit(None), F.lit("Exact duplicate rows"),
        phrase("%,d rows (%s) repeat an earlier row, in %,d groups. Text is compared trimmed and without regard to case.",
               F.col("affected"), percent(ratio), F.col("groups")),
        F.col("affected"), F.col("row_count"),
        details(duplicate_groups=F.col("groups"), comparison=F.lit("trimmed, case-folded")),
    )
    found = as_findings(total, [struct])
    if not context.row_ids:
        return found
    repeats = rows.join(lookup(groups.select("digest", "kept")), "digest").filter(F.col(ROW_ID) > F.col("kept"))
    return _with_rows(found, repeats)


def _with_rows(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Attach the first row ids to a table of at most one finding."""
    ranked = first_per_group(rows.select(F.lit(1).alias("one"), ROW_ID), ["one"], [F.asc(ROW_ID)], EVIDENCE_ROWS)
    listed = ranked.agg(F.array_sort(F.collect_list(ROW_ID)).alias("ids"))
    return found.crossJoin(F.broadcast(listed)).withColumn("row_ids", F.col("ids")).drop("ids")


def _identities(data: Dataset, columns: list[str]) -> DataFrame:
    """The id, identity key and folded digest of each row that has a key."""
    return _with_identity(data, columns, _folded_digest(data).alias("digest"))


def _with_identity(data: Dataset, columns: list[str], *others: Column) -> DataFrame:
    """``others`` of each row that has an identity key, beside it and the row id.

    The key is taken out of an array. A plain column would be worked out anew in every filter that the
    optimizer moves to the scan, such as that of a join by it, and several times over in each.
    """
    keys = F.array(tx.blocking_key([col(name) for name in columns])).alias("keys")
    return data.frame.select(ROW_ID, *others, keys).withColumn("identity", F.explode(F.array_compact("keys"))).drop("keys")


def _distinct_rows(identities: DataFrame) -> DataFrame:
    return identities.groupBy("identity", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias(ROW_ID))


def colliding_identities(data: Dataset, columns: list[str]) -> DataFrame:
    """Identity keys shared by rows that are not exact copies, one row per key.

    Rows are first merged per (key, distinct row), then per key. Both steps combine on the
    map side, so a key that covers a third of the table reaches the second one as a single
    partial row per task.
    """
    single = F.col("n") == 1
    return (
        _distinct_rows(_identities(data, columns))
        .groupBy("identity")
        .agg(
            F.sum("n").alias("rows"),
            F.count_if(single).alias("singles"),
            F.min(F.when(single, F.col(ROW_ID))).alias("first_single"),
        )
        .filter("rows > 1 AND singles > 0")
    )


@dataset_check("probable_duplicate_rows")
def probable_duplicates(context: Context) -> DataFrame:
    """Rows that share an identity key without being exact copies of each other."""
    data = context.data
    columns = naming.identity_columns(data.columns)
    if not columns:
        return no_findings(data.spark)
    colliding = materialise(colliding_identities(data, columns))
    totals = colliding.agg(F.sum("singles").alias("affected"), F.count(F.lit(1)).alias("groups")).filter("groups > 0")
    total, seen = pinned(totals.withColumn("row_count", F.lit(context.row_count)))
    if not seen:
        return no_findings(data.spark)
    # The lowest row ids lie in the groups that start first, so that many groups suffice.
    first = colliding.orderBy("first_single").limit(EVIDENCE_ROWS).select("identity", "first_single")
    extra = {}
    if context.row_ids:
        total = total.crossJoin(F.broadcast(_identity_examples(data, columns, first)))
        extra["examples"] = F.col("examples")
    ratio = F.try_divide(F.col("affected"), F.col("row_count"))
    listed = F.array(*map(F.lit, columns))
    struct = finding(
        "probable_duplicate_rows", "probable_duplicate_rows", F.when(ratio > 0.02, "high").otherwise("medium"),
        F.lit(None), F.lit("Probable duplicate records"),
        phrase("%,d rows (%s) share the identity built from %s with another row that is no exact copy, in %,d groups. "
               "Which of them are one record is for a person to say.",
               F.col("affected"), percent(ratio), F.array_join(listed, ", "), F.col("groups")),
        F.col("affected"), F.col("row_count"),
        details(key_columns=listed, duplicate_groups=F.col("groups"), **extra),
        0.8,
    )
    found = as_findings(total, [struct])
    if not context.row_ids:
        return found
    members = _identities(data, columns).join(F.broadcast(first), "identity")
    return _with_rows(found, _distinct_rows(members).filter("n = 1"))


def _identity_examples(data: Dataset, columns: list[str], first: DataFrame, groups: int = 5, rows: int = 4) -> DataFrame:
    """The first few groups with the first rows of each, as one array."""
    chosen = first.orderBy("first_single").limit(groups)
    shown = F.struct(*[F.coalesce(col(name).cast("string"), F.lit("")).alias(name) for name in columns]).alias("shown")
    members = _with_identity(data, columns, shown).join(F.broadcast(chosen), "identity")
    ranked = first_per_group(members, ["identity"], [F.asc(ROW_ID)], rows)
    sorted_rows = F.array_sort(F.collect_list(F.struct("__rank", ROW_ID, "shown")))
    per_group = ranked.groupBy("identity", "first_single").agg(
        F.transform(sorted_rows, lambda e: e[ROW_ID]).alias("rows"),
        F.transform(sorted_rows, lambda e: e["shown"]).alias("values"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("first_single", "rows", "values")))
    return per_group.agg(
        F.transform(ordered, lambda e: F.struct(e["rows"].alias("rows"), e["values"].alias("values"))).alias("examples")
    )


@dataset_check("schema_mismatch")
def schema_mismatch(context: Context) -> DataFrame:
    """Header names that were repaired while reading."""
    notes = context.notes
    if not notes:
        return no_findings(context.data.spark)
    struct = finding(
        "schema_mismatch", "schema_mismatch", F.lit("medium"), F.lit(None), F.lit("The header row needed repairs"),
        F.lit(f"{len(notes)} header problem(s) were repaired while reading. " + " ".join(notes[:6])),
        F.lit(0), F.lit(context.row_count), details(notes=F.array(*map(F.lit, notes[:LISTED]))),
    )
    return as_findings(context.data.spark.range(1), [struct])
