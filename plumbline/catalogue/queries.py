"""Every operator as a query over the given tables or views derived from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import lru_cache

import yaml
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import plumbline.operators.rules as rl
from plumbline.catalogue.views import dataset, frame
from plumbline.functions import text as tx
from plumbline.functions.dates import format_labels, with_dates
from plumbline.functions.numbers import with_number
from plumbline.operators import checks, dependencies, ground, profile, report
from plumbline.operators.apply import apply_corrections, approved_in_order, previews, with_correction, without_repeats
from plumbline.operators.checks import Context, run_checks
from plumbline.operators.dataset import ROW_ID, pinned, preview_rows
from plumbline.operators.evidence import attach_rows
from plumbline.operators.findings import by_severity, worst_first
from plumbline.operators.propose import decide, decision_counts, propose, spelling_leaders, spelling_map, with_status
from plumbline.operators.sampling import evenly_spaced_sample
from plumbline.operators.score import column_scores, quality_score, worst_columns
from plumbline.plans.analysis import Review, analyze, measure, structural_findings
from plumbline.plans.review import advise, clean, offer
from plumbline.sources.history import History, redact
from plumbline.sources.readers import open_view, read_csv
from plumbline.sources.writers import write_csv

#: The day that future dates are judged against.
AS_OF = date(2024, 6, 30)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RULES = rl.RuleSet(
    (
        rl.NotNull("email_required", column="email"),
        rl.Unique("customer_id_unique", columns=("customer_id",), severity="critical"),
        rl.Range("age_plausible", column="age", minimum=0, maximum=120),
        rl.Range("revenue_small", column="revenue", maximum=9000, severity="medium"),
        rl.AllowedValues("segment_known", column="segment", severity="low",
                         values=("automobile", "building", "furniture", "household", "machinery")),
        rl.NoFutureDates("signup_past", column="signup_date"),
        rl.Regex("customer_id_format", column="customer_id", pattern="CUST-[0-9]+$"),
        rl.NotNull("absent_column", column="no_such_column"),
    ),
    name="customers",
)


def query(name: str):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        return run

    return register


@lru_cache(maxsize=64)
def _measured(application: str, spark: SparkSession, sf_dir: str, name: str) -> Review:
    data = dataset(spark, sf_dir, name)
    return measure(data, AS_OF)


def review_of(spark: SparkSession, sf_dir: str, name: str) -> Review:
    """The measured state of a table; queries over the same table share it."""
    return _measured(spark.sparkContext.applicationId, spark, sf_dir, name)


def _context(review: Review, rules=None, row_ids: bool = False) -> Context:
    return Context(review.data, review.facts, review.row_count, review.as_of, rules, row_ids)


BRIEF = ("column", "severity", "affected_rows", "row_count")


def _named(review: Review, df: DataFrame) -> DataFrame:
    """``df`` with column names in place of positions."""
    return df.join(F.broadcast(review.facts.select("pos", "column")), "pos").drop("pos")


# ------------------------------------------------------------------ profile


@query("missing_counts")
def missing_counts(spark, sf_dir):
    return profile.missing_counts(dataset(spark, sf_dir, "dirty_customer")).select("column", "missing_count", "row_count")


@query("profile_numeric")
def profile_numeric(spark, sf_dir):
    review = review_of(spark, sf_dir, "lineitem")
    stats = F.col("numeric")
    return review.profiles.filter("numeric IS NOT NULL").select(
        "column", stats["minimum"].alias("minimum"), stats["maximum"].alias("maximum"),
        F.round(stats["mean"], 4).alias("mean"), F.round(stats["median"], 4).alias("median"),
        F.round(stats["std_dev"], 4).alias("std_dev"), stats["zero_count"].alias("zero_count"),
        stats["negative_count"].alias("negative_count"),
    )


@query("profile_numeric_text")
def profile_numeric_text(spark, sf_dir):
    review = review_of(spark, sf_dir, "dirty_customer")
    stats = F.col("numeric")
    return review.profiles.filter(F.col("column").isin("age", "revenue")).select(
        "column", stats["minimum"].alias("minimum"), stats["maximum"].alias("maximum"),
        F.round(stats["mean"], 4).alias("mean"), stats["median"].alias("median"), F.round(stats["std_dev"], 4).alias("std_dev"),
    )


@query("profile_text")
def profile_text(spark, sf_dir):
    review = review_of(spark, sf_dir, "documents")
    stats = F.col("text")
    return review.profiles.filter("text IS NOT NULL").select(
        "column", stats["min_length"].alias("min_length"), stats["max_length"].alias("max_length"),
        stats["mean_length"].alias("mean_length"), stats["blank_count"].alias("blank_count"), "missing_count",
    )


@query("profile_temporal")
def profile_temporal(spark, sf_dir):
    review = review_of(spark, sf_dir, "dirty_orders")
    stats = F.col("temporal")
    return review.profiles.filter("semantic_type IN ('date', 'datetime')").select(
        "column", stats["minimum"].alias("earliest"), stats["maximum"].alias("latest"),
        F.array_join(stats["formats"], "; ").alias("formats"), stats["unparseable_count"].alias("unparseable"),
    )


@query("profile_native_dates")
def profile_native_dates(spark, sf_dir):
    review = review_of(spark, sf_dir, "orders")
    return review.profiles.filter("temporal IS NOT NULL").select(
        "column", "semantic_type", F.col("temporal.minimum").alias("earliest"), F.col("temporal.maximum").alias("latest"),
        "unique_count",
    )


@query("cardinality")
def cardinality(spark, sf_dir):
    return review_of(spark, sf_dir, "dirty_customer").profiles.select("column", "unique_count", "row_count")


@query("cardinality_events")
def cardinality_events(spark, sf_dir):
    return review_of(spark, sf_dir, "events").profiles.select("column", "unique_count")


@query("top_values")
def top_values(spark, sf_dir):
    review = review_of(spark, sf_dir, "dirty_customer")
    return review.profiles.filter(F.col("column").isin("segment", "age", "city")).select(
        "column", F.posexplode("top_values").alias("rank", "top")
    ).select("column", F.col("rank").cast("bigint").alias("rank"), F.col("top.value").alias("value"), F.col("top.count").alias("n"))


@query("sample_values")
def sample_values(spark, sf_dir):
    return review_of(spark, sf_dir, "dirty_customer").profiles.filter(F.col("column").isin("segment", "full_name", "city")).select(
        "column", F.posexplode("sample_values").alias("rank", "value")
    ).select("column", F.col("rank").cast("bigint").alias("rank"), "value")


@query("infer_types")
def infer_types(spark, sf_dir):
    return review_of(spark, sf_dir, "dirty_customer").profiles.select("column", "semantic_type")


@query("infer_types_native")
def infer_types_native(spark, sf_dir):
    return review_of(spark, sf_dir, "orders").profiles.select("column", "semantic_type", "confidence")


@query("columns_per_type")
def columns_per_type(spark, sf_dir):
    return report.columns_per_type(review_of(spark, sf_dir, "dirty_customer").profiles)


@query("most_missing")
def most_missing(spark, sf_dir):
    return report.most_missing(review_of(spark, sf_dir, "dirty_customer").profiles)


@query("dataset_totals")
def dataset_totals(spark, sf_dir):
    totals = profile.dataset_totals(review_of(spark, sf_dir, "dirty_customer").profiles)
    return totals.select("row_count", "column_count", "total_cells", "missing_cells", F.round("missing_ratio", 6).alias("missing_ratio"))


@query("duplicate_rows")
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(dataset(spark, sf_dir, "repeated_orders"))


@query("duplicate_line_items")
def duplicate_line_items(spark, sf_dir):
    return profile.duplicate_rows(dataset(spark, sf_dir, "repeated_lines"))


@query("kind_shares")
def kind_shares(spark, sf_dir):
    facts = review_of(spark, sf_dir, "dirty_part").facts
    return facts.select("column", *[F.col(f"kind_{kind}").alias(kind) for kind in ("numbers", "dates", "booleans", "text")])


@query("date_formats")
def date_formats(spark, sf_dir):
    facts = review_of(spark, sf_dir, "dirty_orders").facts.filter("column = 'order_date'")
    return facts.select(
        F.posexplode("format_counts").alias("bit", "n")
    ).filter("n > 0").select(F.col("bit").cast("bigint").alias("bit"), "n")


@query("evenly_spaced_sample")
def evenly_spaced(spark, sf_dir):
    data = dataset(spark, sf_dir, "dirty_customer", columns=["email"])
    return evenly_spaced_sample(data, "email", 100).select(F.col(ROW_ID).alias("row_id"), F.col("email").alias("value"))


# ------------------------------------------------------------------ value expressions


@query("parse_numbers")
def parse_numbers(spark, sf_dir):
    df = with_number(frame(spark, sf_dir, "dirty_orders"), F.col("amount"), "number")
    return df.select("row_key", "number")


@query("parse_dates")
def parse_dates(spark, sf_dir):
    df = with_dates(frame(spark, sf_dir, "dirty_customer"), F.col("signup_date"), "mask", "moment")
    return df.select("row_key", F.date_format("moment", "yyyy-MM-dd").alias("day"), F.size(format_labels(F.col("mask"))).cast("bigint").alias("formats"))


@query("parse_numbers_european")
def parse_numbers_european(spark, sf_dir):
    return with_number(frame(spark, sf_dir, "european_prices"), F.col("price"), "number").select("row_key", "number")


@query("parse_dates_every_format")
def parse_dates_every_format(spark, sf_dir):
    df = with_dates(frame(spark, sf_dir, "dated_orders"), F.col("written"), "mask", "moment")
    return df.select("row_key", F.date_format("moment", "yyyy-MM-dd").alias("day"))


@query("boolean_tokens")
def boolean_tokens(spark, sf_dir):
    return frame(spark, sf_dir, "dirty_part").select("row_key", tx.boolean_token(F.col("in_stock")).alias("truth"))


@query("valid_emails")
def valid_emails(spark, sf_dir):
    return frame(spark, sf_dir, "dirty_customer").select("row_key", tx.is_email(F.col("email")).alias("valid"))


@query("category_keys")
def category_keys(spark, sf_dir):
    df = frame(spark, sf_dir, "dirty_part")
    return df.groupBy(tx.squash(F.col("part_type")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("identity_keys")
def identity_keys(spark, sf_dir):
    df = frame(spark, sf_dir, "dirty_company")
    return df.select("row_key", tx.blocking_key([F.col("company_name"), F.col("contact_email")]).alias("identity"))


@query("repair_encoding")
def repair_encoding(spark, sf_dir):
    df = frame(spark, sf_dir, "dirty_customer")
    return df.select("row_key", tx.repair_encoding(F.col("city")).alias("repaired"), tx.has_lost_characters(F.col("city")).alias("lost"))


@query("mask_values")
def mask_values(spark, sf_dir):
    return frame(spark, sf_dir, "dirty_customer").select("row_key", tx.mask(F.col("revenue")).alias("shape"))


@query("neutralise_formulas")
def neutralise_formulas(spark, sf_dir):
    return frame(spark, sf_dir, "dirty_part").select("row_key", tx.neutralise_formula(F.col("remark")).alias("remark"))


@query("plain_numbers")
def plain_numbers(spark, sf_dir):
    df = frame(spark, sf_dir, "dirty_orders")
    return df.agg(F.count_if(tx.is_plain_number(F.col("amount"))).alias("plain"), F.count(F.lit(1)).alias("row_count"))


# ------------------------------------------------------------------ checks


def _check_query(name: str, check: str, view: str) -> None:
    @query(name)
    def run(spark, sf_dir):
        return run_checks(_context(review_of(spark, sf_dir, view)), [check]).select(*BRIEF)


for _name, _check, _view in (
    ("check_missing_values", "missing_values", "dirty_customer"),
    ("check_constant_column", "constant_column", "dirty_customer"),
    ("check_placeholder_values", "placeholder_values", "dirty_customer"),
    ("check_invalid_date", "invalid_date", "dirty_customer"),
    ("check_inconsistent_date_format", "inconsistent_date_format", "dirty_customer"),
    ("check_invalid_email", "invalid_email", "dirty_customer"),
    ("check_numeric_stored_as_text", "numeric_stored_as_text", "dirty_customer"),
    ("check_impossible_numeric", "impossible_numeric", "dirty_customer"),
    ("check_suspicious_numeric", "suspicious_numeric", "dirty_customer"),
    ("check_future_date", "future_date", "dirty_customer"),
    ("check_inconsistent_category", "inconsistent_category", "dirty_customer"),
    ("check_inconsistent_capitalization", "inconsistent_capitalization", "dirty_customer"),
    ("check_leading_trailing_whitespace", "leading_trailing_whitespace", "dirty_customer"),
    ("check_corrupted_encoding", "corrupted_encoding", "dirty_customer"),
    ("check_mixed_datatypes", "mixed_datatypes", "dirty_part"),
    ("check_mixed_date_format_orders", "inconsistent_date_format", "dirty_orders"),
    ("check_impossible_amounts", "impossible_numeric", "dirty_orders"),
):
    _check_query(_name, _check, _view)


@query("check_exact_duplicates")
def check_exact_duplicates(spark, sf_dir):
    data = dataset(spark, sf_dir, "repeated_orders")
    context = Context(data, None, data.frame.count(), AS_OF, row_ids=False)
    found = checks.exact_duplicates(context)
    return found.select("severity", "affected_rows", "row_count",
                        F.get_json_object("details", "$.duplicate_groups").cast("bigint").alias("duplicate_groups"))


@query("check_probable_duplicates")
def check_probable_duplicates(spark, sf_dir):
    data = dataset(spark, sf_dir, "dirty_company")
    context = Context(data, None, data.frame.count(), AS_OF, row_ids=False)
    return checks.probable_duplicates(context).select(
        "severity", "affected_rows", "row_count",
        F.get_json_object("details", "$.duplicate_groups").cast("bigint").alias("duplicate_groups"),
    )


@query("probable_duplicate_rows_first")
def probable_duplicate_rows_first(spark, sf_dir):
    data = dataset(spark, sf_dir, "dirty_company")
    context = Context(data, None, data.frame.count(), AS_OF, row_ids=True)
    return checks.probable_duplicates(context).select(F.explode("row_ids").alias("row_id"))


@query("exact_duplicate_rows_first")
def exact_duplicate_rows_first(spark, sf_dir):
    data = dataset(spark, sf_dir, "repeated_orders")
    context = Context(data, None, data.frame.count(), AS_OF, row_ids=True)
    return checks.exact_duplicates(context).select(F.explode("row_ids").alias("row_id"))


@query("check_business_rules")
def check_business_rules(spark, sf_dir):
    review = review_of(spark, sf_dir, "dirty_customer")
    return run_checks(_context(review, RULES), ["business_rule"]).select(
        "title", "column", "severity", "affected_rows", "row_count"
    )


@query("evidence_rows")
def evidence_rows(spark, sf_dir):
    review = review_of(spark, sf_dir, "dirty_customer")
    wanted = ["invalid_email", "leading_trailing_whitespace", "missing_values", "impossible_numeric", "future_date", "placeholder_values"]
    found, _ = pinned(run_checks(_context(review), wanted))
    filled = attach_rows(review, found)
    return filled.select("check_id", "column", F.explode("row_ids").alias("row_id"))


@query("structural_findings")
def structural(spark, sf_dir):
    found = structural_findings(dataset(spark, sf_dir, "dirty_customer"), RULES, AS_OF)
    return found.select("check_id", "column", "severity", "affected_rows", "row_count")


# ------------------------------------------------------------------ rules


def _rule_query(name: str, view: str, rule: rl.Rule) -> None:
    @query(name)
    def run(spark, sf_dir):
        data = dataset(spark, sf_dir, view)
        return rl.evaluate(data, rl.RuleSet((rule,)), AS_OF)


_rule_query("rule_not_null", "dirty_customer", rl.NotNull("email_required", column="email"))
_rule_query("rule_range", "lineitem", rl.Range("quantity_range", column="l_quantity", minimum=5, maximum=45))
_rule_query("rule_range_text", "dirty_customer", rl.Range("revenue_range", column="revenue", minimum=2000, maximum=8000))
_rule_query("rule_allowed_values", "orders", rl.AllowedValues("status_known", column="o_orderstatus", values=("f", "O")))
_rule_query("rule_no_future_dates", "dirty_customer", rl.NoFutureDates("signup_past", column="signup_date", tolerance_days=30))
_rule_query("rule_regex", "dirty_company", rl.Regex("vat_format", column="vat_code", pattern="[A-Z]{2}[0-9]{9}$"))
_rule_query("rule_unique", "lineitem", rl.Unique("line_unique", columns=("l_orderkey", "l_linenumber")))
_rule_query("rule_comparison_dates", "dirty_orders",
            rl.Comparison("delivered_later", left="delivery_date", operator=">=", right="order_date", compare_as="date"))
_rule_query("rule_comparison_numbers", "lineitem",
            rl.Comparison("discount_below_tax", left="l_discount", operator="<", right="l_tax"))


@query("violating_rows")
def violating_rows(spark, sf_dir):
    data = dataset(spark, sf_dir, "dirty_customer")
    fits, _ = RULES.split(data.columns)
    return rl.violating_rows(data, fits, AS_OF, 50).select("rule", F.explode("ids").alias("row_id"))


@query("rule_split")
def rule_split(spark, sf_dir):
    data = dataset(spark, sf_dir, "dirty_customer")
    fits, skipped = RULES.split(data.columns)
    counted = rl.evaluate(data, RULES, AS_OF).select("rule", F.lit("evaluated").alias("state"), "affected")
    names = rl.rule_table(spark, skipped).select("rule", F.lit("skipped").alias("state"), F.lit(None).cast("bigint").alias("affected"))
    return counted.unionByName(names)


# ------------------------------------------------------------------ score

_SCORED = ["missing_values", "invalid_email", "leading_trailing_whitespace", "impossible_numeric"]


def _scored(spark, sf_dir):
    review = review_of(spark, sf_dir, "dirty_customer")
    found, _ = pinned(run_checks(_context(review), _SCORED))
    return review, found


@query("column_scores")
def column_score_rows(spark, sf_dir):
    review, found = _scored(spark, sf_dir)
    return column_scores(found, review.profiles)


@query("quality_score")
def quality_score_row(spark, sf_dir):
    review, found = _scored(spark, sf_dir)
    return quality_score(found, column_scores(found, review.profiles))


@query("worst_columns")
def worst_column_rows(spark, sf_dir):
    review, found = _scored(spark, sf_dir)
    return worst_columns(column_scores(found, review.profiles), 3)


@query("severity_counts")
def severity_counts(spark, sf_dir):
    return by_severity(_scored(spark, sf_dir)[1])


@query("findings_sorted")
def findings_sorted(spark, sf_dir):
    found = worst_first(_scored(spark, sf_dir)[1])
    return found.select("check_id", "column", "severity", "affected_rows")


@query("finding_ids")
def finding_ids(spark, sf_dir):
    return _scored(spark, sf_dir)[1].select("finding_id", "check_id", "column")


@query("finding_summaries")
def finding_summaries(spark, sf_dir):
    return report.finding_summaries(_scored(spark, sf_dir)[1]).drop("finding_reference")


# ------------------------------------------------------------------ dependencies and imputation


@query("functional_dependencies")
def functional_dependencies(spark, sf_dir):
    data = dataset(spark, sf_dir, "gappy_nation")
    return dependencies.find_determinants(data, ["nation_name"])


@query("pair_statistics")
def pair_statistics(spark, sf_dir):
    data = dataset(spark, sf_dir, "gappy_nation")
    stats = dependencies.pair_statistics(data, ["nation_name"])
    return stats.select("determinant", "target", "evidence_rows", "distinct_keys", "decides", "recoverable_rows", "unrecoverable_rows")


@query("lookup_table")
def lookup_rows(spark, sf_dir):
    return dependencies.lookup_table(dataset(spark, sf_dir, "gappy_nation"), "nation_key", "nation_name")


@query("canonical_spelling")
def canonical_spelling(spark, sf_dir):
    review = review_of(spark, sf_dir, "dirty_customer")
    mapping = spelling_map(review.values.filter(F.col("pos") == review.data.columns.index("segment")), "fold")
    return mapping.select("from_value", "to_value", "n")


@query("category_spelling")
def category_spelling(spark, sf_dir):
    review = review_of(spark, sf_dir, "dirty_customer")
    mapping = spelling_map(review.values.filter(F.col("pos") == review.data.columns.index("segment")), "key")
    return mapping.select("from_value", "to_value", "n")


@query("impute_median")
def impute_median(spark, sf_dir):
    review = review_of(spark, sf_dir, "dirty_customer")
    return _named(review, profile.medians(review.values, review.facts.filter("column IN ('age', 'revenue')")))


@query("impute_mode")
def impute_mode(spark, sf_dir):
    from plumbline.operators.propose import most_frequent

    review = review_of(spark, sf_dir, "dirty_customer")
    return _named(review, most_frequent(review.trimmed)).filter(F.col("column").isin("segment", "city", "currency"))


# ------------------------------------------------------------------ proposals and corrections


@lru_cache(maxsize=8)
def _offered_for(application: str, spark: SparkSession, sf_dir: str):
    analysis = analyze(dataset(spark, sf_dir, "dirty_customer"), None, AS_OF, row_ids=False)
    return analysis, offer(analysis, with_previews=False)


def offered(spark, sf_dir):
    return _offered_for(spark.sparkContext.applicationId, spark, sf_dir)


@query("proposals")
def proposal_rows(spark, sf_dir):
    return offered(spark, sf_dir)[1].table.select("action", "column", "affected_rows", "destructive", "confidence").filter(
        "action <> 'manual_review'"
    )


@query("proposal_mappings")
def proposal_mappings(spark, sf_dir):
    _, offers = offered(spark, sf_dir)
    return offers.mappings.join(offers.table.select("proposal_id", "action", "column"), "proposal_id").drop("proposal_id")


def _approve(spark, offers, *actions: str):
    rows = offers.table.filter(F.col("action").isin(*actions)).select("proposal_id").collect()
    return decide(spark, [row.proposal_id for row in rows])


@query("correction_previews")
def correction_previews(spark, sf_dir):
    analysis, offers = offered(spark, sf_dir)
    shown = previews(analysis.data, offers).join(offers.table.select("proposal_id", "action"), "proposal_id")
    return shown.select("action", F.inline("preview")).filter("action IN ('strip_whitespace', 'parse_dates', 'cast_to_numeric')")


@query("corrected_customers")
def corrected_customers(spark, sf_dir):
    analysis, offers = offered(spark, sf_dir)
    chosen = _approve(spark, offers, "strip_whitespace", "repair_encoding", "parse_dates", "cast_to_numeric", "normalize_case")
    cleaned = apply_corrections(analysis.data, offers, chosen)
    return cleaned.data.frame.select(
        F.col(ROW_ID).alias("row_id"), "full_name", "segment", "city", "signup_date", "revenue", "age"
    )


@query("cleared_customers")
def cleared_customers(spark, sf_dir):
    analysis, offers = offered(spark, sf_dir)
    cleaned = apply_corrections(analysis.data, offers, _approve(spark, offers, "clear_invalid_values", "fill_missing"))
    return cleaned.data.frame.select(F.col(ROW_ID).alias("row_id"), "email", "segment", "signup_date", "age")


@query("applied_changes")
def applied_changes(spark, sf_dir):
    analysis, offers = offered(spark, sf_dir)
    everything = [row.proposal_id for row in offers.table.select("proposal_id").collect()]
    return apply_corrections(analysis.data, offers, decide(spark, everything)).applied.select("action", "column", "rows_changed")


@query("recovered_nations")
def recovered_nations(spark, sf_dir):
    analysis = analyze(dataset(spark, sf_dir, "gappy_nation"), None, AS_OF, row_ids=False, only=["missing_values"])
    offers = propose(analysis)
    cleaned = apply_corrections(analysis.data, offers, _approve(spark, offers, "fill_from_related"))
    return cleaned.data.frame.select(F.col(ROW_ID).alias("row_id"), "nation_key", "nation_name")


@query("drop_duplicates")
def drop_duplicates(spark, sf_dir):
    return without_repeats(dataset(spark, sf_dir, "repeated_orders")).select(F.col(ROW_ID).alias("row_id"))


@query("drop_duplicates_shared_ids")
def drop_duplicates_shared_ids(spark, sf_dir):
    kept = without_repeats(dataset(spark, sf_dir, "shared_ids"))
    return kept.select("customer", "status", F.lower("priority").alias("priority"))


@query("clipped_ages")
def clipped_ages(spark, sf_dir):
    data = dataset(spark, sf_dir, "dirty_customer")
    clipped = with_correction(data.frame, data, "clip_to_range", "age", {"minimum": "0", "maximum": "75"}, None, "clipped")
    return clipped.select(F.col(ROW_ID).alias("row_id"), "clipped")


@query("proposed_removal")
def proposed_removal(spark, sf_dir):
    analysis = analyze(dataset(spark, sf_dir, "repeated_orders"), None, AS_OF, row_ids=False, only=["exact_duplicate_rows"])
    offers = propose(analysis)
    done = apply_corrections(analysis.data, offers, _approve(spark, offers, "drop_duplicate_rows"))
    applied = done.applied.select("action", F.col("rows_changed").alias("rows_removed"))
    return applied.join(offers.table.select("action", "affected_rows", "destructive"), "action")


# ------------------------------------------------------------------ long values, marks and wide tables

_LONG_CHECKS = ["inconsistent_capitalization", "inconsistent_category"]


@query("long_value_findings")
def long_value_findings(spark, sf_dir):
    return run_checks(_context(review_of(spark, sf_dir, "long_notes")), _LONG_CHECKS).select("check_id", *BRIEF)


@query("long_value_evidence")
def long_value_evidence(spark, sf_dir):
    review = review_of(spark, sf_dir, "long_notes")
    found, _ = pinned(run_checks(_context(review), _LONG_CHECKS))
    return attach_rows(review, found).select("check_id", "column", F.explode("row_ids").alias("row_id"))


@query("long_value_mapping")
def long_value_mapping(spark, sf_dir):
    review = review_of(spark, sf_dir, "long_notes")
    mapping = spelling_map(review.values.filter(F.col("pos") == review.data.columns.index("note")), "fold", review.data)
    return mapping.select(F.md5("to_value").alias("to_digest"), "n")


@query("long_value_correction")
def long_value_correction(spark, sf_dir):
    analysis = analyze(dataset(spark, sf_dir, "long_notes"), None, AS_OF, row_ids=False, only=_LONG_CHECKS)
    offers = propose(analysis)
    cleaned = apply_corrections(analysis.data, offers, _approve(spark, offers, "normalize_case"))
    return cleaned.data.frame.select(F.col(ROW_ID).alias("row_id"), F.md5("note").alias("note"), F.length("code").alias("code_length"))


@query("marks_stay_gaps")
def marks_stay_gaps(spark, sf_dir):
    review = review_of(spark, sf_dir, "marked_parts")
    return spelling_map(review.values, "key").select("from_value", "to_value", "n")


@query("tied_spellings")
def tied_spellings(spark, sf_dir):
    review = review_of(spark, sf_dir, "marked_parts")
    return spelling_leaders(review.values, "fold").select("key", F.col("leaders").cast("bigint").alias("leaders"))


@query("wide_dependencies")
def wide_dependencies(spark, sf_dir):
    return dependencies.find_determinants(dataset(spark, sf_dir, "wide_nation"), ["nation_name"])


@query("dataset_profile")
def dataset_profile(spark, sf_dir):
    review = review_of(spark, sf_dir, "repeated_orders")
    return profile.dataset_profile(review.data, review.profiles)


@query("decision_counts")
def decision_count_row(spark, sf_dir):
    _, offers = offered(spark, sf_dir)
    return decision_counts(offers.table, _approve(spark, offers, "strip_whitespace", "parse_dates"))


@query("proposals_with_status")
def proposals_with_status(spark, sf_dir):
    _, offers = offered(spark, sf_dir)
    return with_status(offers.table, _approve(spark, offers, "strip_whitespace")).select("action", "column", "status").filter(
        "action <> 'manual_review'"
    )


@query("score_after_corrections")
def score_after_corrections(spark, sf_dir):
    analysis, offers = offered(spark, sf_dir)
    run = clean(analysis, offers, _approve(spark, offers, "strip_whitespace", "parse_dates"))
    return run.outcome


# ------------------------------------------------------------------ suggestions


def _suggested_mappings(spark, sf_dir) -> DataFrame:
    """Every segment spelling mapped to its capital form, and some unsound ideas."""
    levels = frame(spark, sf_dir, "dirty_customer").select(F.col("segment").alias("from_value")).distinct()
    rows = levels.select(
        F.lit("segment").alias("column"), "from_value", F.upper("from_value").alias("to_value"),
        F.when(F.col("from_value").startswith("b"), 0.5).otherwise(0.9).alias("confidence"),
    )
    backwards = levels.select(
        F.lit("segment").alias("column"), F.upper("from_value").alias("from_value"), F.lower("from_value").alias("to_value"),
        F.lit(0.8).alias("confidence"),
    )
    elsewhere = levels.select(F.lit("nowhere").alias("column"), "from_value", F.lit("X").alias("to_value"), F.lit(0.9).alias("confidence"))
    both = rows.unionByName(backwards).unionByName(elsewhere).distinct()
    order = F.row_number().over(_ordered("column", "confidence", "from_value", "to_value"))
    return both.withColumn("suggestion", order.cast("bigint"))


def _ordered(*names: str):
    from pyspark.sql import Window

    # Suggestions number a few per distinct segment.
    return Window.orderBy(*names)


@query("ground_mappings")
def ground_mappings(spark, sf_dir):
    review = review_of(spark, sf_dir, "dirty_customer")
    levels = _named(review, review.trimmed)
    return ground.ground_mappings(_suggested_mappings(spark, sf_dir), review.profiles.select("column"), levels).select(
        "column", "source", "target", "accepted"
    )


@query("ground_descriptions")
def ground_descriptions(spark, sf_dir):
    review = review_of(spark, sf_dir, "dirty_customer")
    twice = review.profiles.select("column", F.explode(F.array(F.col("position"), F.col("position") + 100)).alias("suggestion"))
    other = review_of(spark, sf_dir, "dirty_orders").profiles.select("column", (F.col("position") + 500).alias("suggestion"))
    made = twice.unionByName(other).withColumn("suggestion", F.col("suggestion").cast("bigint"))
    return ground.ground_descriptions(made, review.profiles.select("column")).select("suggestion", "column", "accepted")


@query("ground_rules")
def ground_rules(spark, sf_dir):
    review = review_of(spark, sf_dir, "dirty_customer")
    bounds = review.profiles.select(
        F.col("position").cast("bigint").alias("suggestion"),
        F.concat(F.col("column"), F.lit("_range")).alias("name"),
        F.lit("range").alias("rule_type"), "column", F.col("numeric.minimum").alias("minimum"), F.col("numeric.maximum").alias("maximum"),
        F.array().cast("array<string>").alias("allowed_values"), F.lit(0.8).alias("confidence"),
    )
    words = review.profiles.select(
        (F.col("position") + 100).cast("bigint").alias("suggestion"),
        F.concat(F.col("column"), F.lit("_words")).alias("name"),
        F.lit("allowed_values").alias("rule_type"), "column", F.lit(None).cast("double").alias("minimum"),
        F.lit(None).cast("double").alias("maximum"), F.array(F.lit("eur"), F.lit("rome")).alias("allowed_values"), F.lit(0.8).alias("confidence"),
    )
    levels = _named(review, review.frequencies.levels())
    return ground.ground_rules(bounds.unionByName(words), review.profiles.select("column"), levels).select("name", "accepted")


@query("advisory_findings")
def advisory_findings(spark, sf_dir):
    analysis, _ = offered(spark, sf_dir)
    advice = advise(analysis, mappings=_suggested_mappings(spark, sf_dir))
    return advice.findings.select("check_id", "column", "severity", "source", "affected_rows")


# ------------------------------------------------------------------ reports


@query("level_counts")
def level_counts(spark, sf_dir):
    review = review_of(spark, sf_dir, "dirty_customer")
    return report.level_counts(review.trimmed, review.data.columns.index("segment"))


@query("column_summaries")
def column_summaries(spark, sf_dir):
    """The fields of every summary; examples as the shapes they are masked to."""
    summary = report.column_summaries(review_of(spark, sf_dir, "dirty_customer").profiles)
    part = lambda name: F.get_json_object("summary", f"$.{name}")
    return summary.select(
        "column", part("inferred_type").alias("inferred_type"), part("missing").cast("bigint").alias("missing"),
        part("rows").cast("bigint").alias("row_count"), part("distinct").cast("bigint").alias("distinct_count"),
        part("min").cast("double").alias("lowest"), part("max").cast("double").alias("highest"),
        part("examples_are_masked").cast("boolean").alias("masked"),
        F.when(F.col("column").isin("customer_id", "segment"), F.array_join(F.from_json(part("examples"), "array<string>"), ";")).alias("examples"),
    )


@query("masked_columns")
def masked_columns(spark, sf_dir):
    return report.must_mask(review_of(spark, sf_dir, "dirty_customer").profiles).select("column", "masked")


@query("redacted_details")
def redacted_details(spark, sf_dir):
    found = _scored(spark, sf_dir)[1].filter("check_id = 'invalid_email'")
    return found.select("check_id", "column", redact(F.col("details")).alias("details"))


@query("audit_log")
def audit_log(spark, sf_dir):
    analysis, offers = offered(spark, sf_dir)
    return report.audit_log(analysis, offers.table, _approve(spark, offers, "strip_whitespace")).select(
        F.get_json_object("value", "$.dataset.rows").cast("bigint").alias("rows"),
        F.get_json_object("value", "$.dataset.columns").cast("bigint").alias("columns"),
    )


@query("table_preview")
def table_preview(spark, sf_dir):
    return preview_rows(dataset(spark, sf_dir, "dirty_customer"), 50)


@query("analysis_orders")
def analysis_orders(spark, sf_dir):
    review = review_of(spark, sf_dir, "dirty_orders")
    return run_checks(_context(review)).select("check_id", *BRIEF)


@query("checks_beside_failing_ones")
def checks_beside_failing_ones(spark, sf_dir):
    """All checks of an analysis, two of which fail while they run, and a rule that does."""
    review = review_of(spark, sf_dir, "dirty_orders")
    broken = rl.Regex("unreadable_pattern", column="priority", pattern="[0-9")
    rules = rl.RuleSet((rl.NotNull("amount_given", column="amount"), broken, rl.NotNull("status_given", column="order_date")))
    fail = F.raise_error(F.concat(F.lit("cannot judge "), F.col("column")))

    def breaking() -> checks.Verdict:
        return checks.Verdict(fail.cast("boolean"), F.lit("high"), F.lit(0), F.lit(""), F.lit(""), F.lit("{}"))

    def breaking_on_rows(context):
        nothing = F.lit("")
        struct = checks.finding("breaking_on_rows", "", F.lit("high"), F.col("column"), fail, nothing, F.lit(0), F.col("row_count"), nothing)
        return checks.as_findings(context.facts, [struct])

    checks.column_check("breaking")(breaking)
    checks.dataset_check("breaking_on_rows")(breaking_on_rows)
    try:
        run = checks.run_isolated(_context(review, rules))
    finally:
        checks.COLUMN_CHECKS.pop("breaking")
        checks.DATASET_CHECKS.pop("breaking_on_rows")
    found = run.findings.select("check_id", *BRIEF)
    named = run.skipped.select(
        F.concat(F.lit("skipped: "), F.concat_ws(" ", "check_id", "part")).alias("check_id"), F.lit(None).cast("string").alias("column"),
        F.lit(None).cast("string").alias("severity"), F.lit(None).cast("bigint").alias("affected_rows"), F.lit(None).cast("bigint").alias("row_count"),
    )
    return found.unionByName(named)


# ------------------------------------------------------------------ reviews, reports and evidence in groups


@query("manual_offers")
def manual_offers(spark, sf_dir):
    """Findings that only a person can settle."""
    return offered(spark, sf_dir)[1].table.filter("action = 'manual_review'").select("column", "affected_rows")


@query("application_order")
def application_order(spark, sf_dir):
    _, offers = offered(spark, sf_dir)
    everything = [row.proposal_id for row in offers.table.select("proposal_id").collect()]
    return approved_in_order(offers.table, decide(spark, everything)).select("step", "action", "column")


@query("report_columns")
def report_columns(spark, sf_dir):
    analysis, offers = offered(spark, sf_dir)
    columns = report.report_tables(analysis, offers.table, _approve(spark, offers, "strip_whitespace"))["columns"]
    return columns.select("column", "semantic_type", "missing_count", "missing_percent", "unique_count")


@query("probable_duplicate_examples")
def probable_duplicate_examples(spark, sf_dir):
    """The rows of the first groups of probable duplicates, by place."""
    data = dataset(spark, sf_dir, "dirty_company")
    found = checks.probable_duplicates(Context(data, None, data.frame.count(), AS_OF, row_ids=True))
    groups = F.from_json(F.get_json_object("details", "$.examples"), "array<struct<rows:array<bigint>>>")
    return found.select(F.posexplode(groups).alias("place", "group")).select("place", F.posexplode("group.rows").alias("member", "row_id"))


@query("rules_read_from_yaml")
def rules_read_from_yaml(spark, sf_dir):
    """Rules written as text, read, and evaluated."""
    text = """
    name: customers
    rules:
      - {type: not_null, name: email_required, column: email}
      - {type: unique, name: customer_id_unique, columns: [customer_id], severity: critical}
      - {type: range, name: age_plausible, column: age, minimum: 0, maximum: 120}
      - {type: regex, name: customer_id_format, column: customer_id, pattern: "CUST-[0-9]+$"}
      - {type: not_null, name: switched_off, column: city, enabled: false}
    """
    return rl.evaluate(dataset(spark, sf_dir, "dirty_customer"), rl.parse_rules(yaml.safe_load(text)), AS_OF)


# ------------------------------------------------------------------ files and history


def _scratch(spark: SparkSession) -> str:
    """A new folder where driver and executors can both write."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/plumbline-files/{uuid.uuid4().hex}"


@query("csv_round_trip")
def csv_round_trip(spark, sf_dir):
    path = _scratch(spark)
    write_csv(dataset(spark, sf_dir, "dirty_customer"), path, sanitise=False)
    return read_csv(spark, path).frame.drop(ROW_ID)


@query("csv_semicolons")
def csv_semicolons(spark, sf_dir):
    path = _scratch(spark)
    prices = frame(spark, sf_dir, "european_prices").select(F.col("row_key").alias("Key"), F.col("price").alias("key"), F.col("price").alias(" price "))
    prices.write.option("sep", ";").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, header=True)
    return read_csv(spark, path).frame.drop(ROW_ID)


@query("csv_line_breaks")
def csv_line_breaks(spark, sf_dir):
    """Cells with line breaks, quotes and delimiters, read in splits."""
    path = _scratch(spark)
    note = F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, chr(10), p_type, ', \"', p_brand, '\"', chr(10)) WHEN p_partkey % 3 = 1 THEN concat('a ', chr(34), ' b') ELSE p_name END")
    parts = frame(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), note.alias("note"), F.col("p_brand").alias("brand"))
    parts.write.options(escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path, header=True)
    return read_csv(spark, path).frame.drop(ROW_ID)


@query("csv_latin")
def csv_latin(spark, sf_dir):
    path = _scratch(spark)
    cities = frame(spark, sf_dir, "dirty_customer").select("customer_id", F.regexp_replace("city", "\ufffd|Ã¶", "é").alias("city"))
    cities.write.option("encoding", "ISO-8859-1").csv(path, header=True)
    return read_csv(spark, path).frame.drop(ROW_ID)


def _saved(spark, sf_dir, *names: str):
    history = History(spark, _scratch(spark))
    for name in names:
        history.save_analysis(analyze(dataset(spark, sf_dir, name), None, AS_OF, row_ids=False, only=["missing_values"]))
    return history


@query("stored_columns")
def stored_columns(spark, sf_dir):
    return _saved(spark, sf_dir, "dirty_customer").table("analysis_columns").select("name", "row_count", "missing_count", "unique_count")


@query("stored_findings")
def stored_findings(spark, sf_dir):
    return _saved(spark, sf_dir, "dirty_customer").table("findings").select("column_name", "severity", "affected_rows", "row_count")


@query("recent_analyses")
def recent_analyses(spark, sf_dir):
    recent = _saved(spark, sf_dir, "gappy_nation", "dirty_customer").recent_analyses(2)
    return recent.select("source_name", "row_count", "column_count")


@query("stored_events")
def stored_events(spark, sf_dir):
    history = _saved(spark, sf_dir, "dirty_customer")
    known = history.recent_analyses(1).first().analysis_id
    return history.audit_trail(known).select("event_type", F.get_json_object("payload", "$.rows").cast("bigint").alias("rows"))


@query("ragged_rows")
def ragged_rows(spark, sf_dir):
    """Every third line lacks its last cell, every ninth its last two."""
    path = _scratch(spark)
    line = F.expr("concat_ws(',', c_custkey, CASE WHEN c_custkey % 9 > 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END)")
    lines = frame(spark, sf_dir, "customer").select(line.alias("key,segment,nation"))
    lines.write.options(sep="\x01", quote="\x02", header=True).csv(path)
    return read_csv(spark, path, delimiter=",").frame.drop(ROW_ID)


@query("opened_view")
def opened_view(spark, sf_dir):
    path = f"{_scratch(spark)}.parquet"
    frame(spark, sf_dir, "dirty_customer").write.parquet(path)
    open_view(spark, path, "opened_customers")
    return spark.sql("SELECT segment, count(*) AS customers, min(row_key) AS first_row FROM opened_customers GROUP BY segment")


@query("header_findings")
def header_findings(spark, sf_dir):
    path = _scratch(spark)
    prices = frame(spark, sf_dir, "european_prices").select(F.col("row_key").alias("Key"), F.col("price").alias("key"))
    prices.write.option("sep", ";").csv(path, header=True)
    found = analyze(read_csv(spark, path), None, AS_OF, row_ids=False, only=["schema_mismatch"]).findings
    return found.select("check_id", "severity", "affected_rows", "row_count")


@query("stored_proposals")
def stored_proposals(spark, sf_dir):
    analysis, offers = offered(spark, sf_dir)
    history = History(spark, _scratch(spark))
    history.save_analysis(analysis)
    history.save_review(analysis, offers, _approve(spark, offers, "strip_whitespace"))
    return history.table("proposals").filter("action <> 'manual_review'").select("action", "column_name", F.col("decision_status").alias("status"))


@query("stored_changes")
def stored_changes(spark, sf_dir):
    analysis, offers = offered(spark, sf_dir)
    history = History(spark, _scratch(spark))
    history.save_analysis(analysis)
    history.save_cleaned(analysis, clean(analysis, offers, _approve(spark, offers, "parse_dates", "strip_whitespace")))
    return history.applied_changes(analysis.analysis_id).select("position", "action", "column_name", "rows_changed")


@query("history_after_a_failed_save")
def history_after_a_failed_save(spark, sf_dir):
    """A save that breaks off after its first tables, between two that do not."""
    history = _saved(spark, sf_dir, "gappy_nation")
    broken = analyze(dataset(spark, sf_dir, "dirty_part"), None, AS_OF, row_ids=False, only=["missing_values"])
    broken.findings = broken.findings.withColumn("title", F.raise_error(F.lit("no title")).cast("string"))
    broken.findings = broken.findings.unionByName(spark.createDataFrame([tuple(None for _ in broken.findings.columns)], broken.findings.schema).withColumn("title", F.raise_error(F.lit("no title")).cast("string")))
    try:
        history.save_analysis(broken)
    except PySparkException:
        pass
    history.save_analysis(analyze(dataset(spark, sf_dir, "dirty_customer"), None, AS_OF, row_ids=False, only=["missing_values"]))
    columns = history.table("analysis_columns").groupBy("analysis_id").agg(F.count(F.lit(1)).alias("columns"))
    events = history.table("audit_events").groupBy("analysis_id").agg(F.count(F.lit(1)).alias("events"))
    return history.recent_analyses(9).join(columns, "analysis_id", "left").join(events, "analysis_id", "left").select("source_name", "row_count", "columns", "events")


@query("usage_totals")
def usage_totals(spark, sf_dir):
    history = History(spark, _scratch(spark))
    for row in frame(spark, sf_dir, "customer").groupBy("c_mktsegment").count().collect():
        history.log_call(None, row.c_mktsegment, "none", row["count"], 2 * row["count"], 1)
    return history.usage_totals()
