"""Suggestions from outside, checked against the data before anyone sees them.

A suggestion is a row of a table; whoever wrote it, person or program, it only survives if it
speaks of columns and values that exist. What survives becomes advisory: it never moves the
score and changes nothing until approved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.severity import proposal_id
from plumbline.operators.dataset import lookup, materialise
from plumbline.operators.findings import ADVISORY, as_findings, details, finding, phrase

MINIMUM_CONFIDENCE = 0.6
# The rule types a suggestion may propose.
SUGGESTIBLE_RULES = ("not_null", "range", "allowed_values", "no_future_dates", "regex", "unique")


def _reason(*tests: tuple[Column, Column]) -> Column:
    """The first reason that applies, or null."""
    reason = F.lit(None).cast("string")
    for fails, why in reversed(tests):
        reason = F.when(fails, why).otherwise(reason)
    return reason


def ground_mappings(suggestions: DataFrame, columns: DataFrame, levels: DataFrame, minimum: float = MINIMUM_CONFIDENCE) -> DataFrame:
    """Value mappings with ``accepted`` and, when refused, the ``reason``.

    ``suggestions``: ``suggestion`` (their order), ``column, from_value, to_value, confidence``.
    ``columns`` lists the table's ``column`` names, ``levels`` the ``column, t`` that occur.
    """
    named = suggestions.withColumns({"source": tx.trim(F.col("from_value")), "target": tx.trim(F.col("to_value"))})
    exists = columns.select("column", F.lit(True).alias("column_exists"))
    occurring = levels.select("column", "t").distinct()
    sources = occurring.select("column", F.col("t").alias("source"), F.lit(True).alias("source_occurs"))
    targets = occurring.select("column", F.col("t").alias("target"), F.lit(True).alias("target_occurs"))
    checked = (
        named.join(exists, "column", "left")
        .join(sources, ["column", "source"], "left")
        .join(targets, ["column", "target"], "left")
        .withColumn(
            "basic",
            _reason(
                (F.col("column_exists").isNull(), phrase("Column '%s' is not in the table.", F.col("column"))),
                (F.col("confidence") < minimum, F.lit("The confidence is too low.")),
                (F.col("source") == F.col("target"), phrase("'%s' maps onto itself.", F.col("source"))),
                (F.col("source_occurs").isNull(), phrase("'%s' does not occur in '%s'.", F.col("source"), F.col("column"))),
                (F.col("target_occurs").isNull(), phrase("'%s' does not occur in '%s' and would be invented.", F.col("target"), F.col("column"))),
            ),
        )
    )
    clashes = _clashes(checked.filter("basic IS NULL").select("suggestion", "column", "source", "target"))
    reason = F.coalesce("basic", "clash")
    return checked.join(clashes, "suggestion", "left").select(
        "suggestion", "column", "source", "target", "confidence", reason.isNull().alias("accepted"), reason.alias("reason")
    )


def _clashes(sound: DataFrame) -> DataFrame:
    """``suggestion, clash``: one mapping per source and never both directions, earlier ones first.

    Whether a mapping stands depends on earlier ones, so it is settled in rounds. In each, a
    mapping falls if an earlier one of its source, or of the opposite direction, stands, and it
    stands if none of these is open. The first open mapping of every column is settled in any case.
    """
    none = F.lit(None).cast("string")
    state = materialise(sound.withColumns({"clash": none, "settled": F.lit(False)}))
    stands = F.col("settled") & F.col("clash").isNull()
    while not state.filter("NOT settled").isEmpty():
        marks = lambda suffix: [
            F.min(F.when(stands, F.col("suggestion"))).alias(f"stands_{suffix}"),
            F.min(F.when(~F.col("settled"), F.col("suggestion"))).alias(f"open_{suffix}"),
        ]
        same = state.groupBy("column", "source").agg(*marks("same"))
        back = state.groupBy("column", F.col("source").alias("target"), F.col("target").alias("source")).agg(*marks("back"))
        seen = state.join(same, ["column", "source"]).join(back, ["column", "source", "target"], "left")
        falls_same = F.col("stands_same") < F.col("suggestion")
        falls_back = F.col("stands_back") < F.col("suggestion")
        waits = (F.col("open_same") < F.col("suggestion")) | (F.coalesce("open_back", "suggestion") < F.col("suggestion"))
        clash = F.when(falls_same, phrase("A mapping of '%s' came before.", F.col("source"))).when(
            falls_back, phrase("The opposite mapping, of '%s' to '%s', came before.", F.col("target"), F.col("source"))
        )
        settled = F.col("settled") | F.coalesce(falls_same | falls_back, F.lit(False)) | F.coalesce(falls_same, F.lit(False)) | F.coalesce(falls_back, F.lit(False)) | ~waits
        state = materialise(
            seen.select(
                "suggestion", "column", "source", "target",
                F.when(F.col("settled"), F.col("clash")).otherwise(clash).alias("clash"), settled.alias("settled"),
            )
        )
    return state.select("suggestion", "clash")


def _first_of(suggestions: DataFrame, sound: Column, key: str) -> Column:
    """Whether a row is the first sound suggestion of its key."""
    order = Window.partitionBy(key, sound).orderBy("suggestion")
    return sound & (F.row_number().over(order) == 1)


def ground_descriptions(suggestions: DataFrame, columns: DataFrame) -> DataFrame:
    """Column descriptions (``suggestion, column, ...``): the first one of each real column."""
    exists = columns.select("column", F.lit(True).alias("column_exists"))
    known = suggestions.join(exists, "column", "left")
    sound = F.col("column_exists").isNotNull()
    ranked = known.withColumn("first", _first_of(known, sound, "column"))
    reason = _reason(
        (~sound, phrase("Column '%s' is not in the table.", F.col("column"))),
        (~F.col("first"), phrase("'%s' is described twice.", F.col("column"))),
    )
    return ranked.withColumns({"accepted": reason.isNull(), "reason": reason}).drop("column_exists", "first")


def ground_rules(suggestions: DataFrame, columns: DataFrame, levels: DataFrame, minimum: float = MINIMUM_CONFIDENCE) -> DataFrame:
    """Suggested rules that are well formed, about real columns and true to the data.

    ``suggestions``: ``suggestion, name, rule_type, column, minimum, maximum, allowed_values,
    confidence``. ``levels`` has the ``column, t`` that occur, all of them.
    """
    exists = columns.select("column", F.lit(True).alias("column_exists"))
    proposed = suggestions.filter("rule_type = 'allowed_values'").select(
        "suggestion", "column", F.explode_outer("allowed_values").alias("value")
    ).withColumn("folded", tx.fold(tx.trim(F.col("value"))))
    # Levels may be as many as rows, proposed values are few: only levels that are proposed go on.
    asked = lookup(proposed.select("column", "folded").distinct())
    occurring = levels.select("column", tx.fold(F.col("t")).alias("folded")).join(asked, ["column", "folded"], "left_semi").distinct()
    overlap = (
        proposed.join(occurring, ["column", "folded"], "left_semi")
        .select("suggestion")
        .distinct()
        .withColumn("overlaps", F.lit(True))
    )
    known = suggestions.join(exists, "column", "left").join(overlap, "suggestion", "left")
    kind = F.col("rule_type")
    basic = _reason(
        (~kind.isin(*SUGGESTIBLE_RULES), phrase("Rule type '%s' is not supported.", kind)),
        (F.col("column_exists").isNull(), phrase("Column '%s' is not in the table.", F.col("column"))),
        (F.col("confidence") < minimum, F.lit("The confidence is too low.")),
    )
    shape = _reason(
        ((kind == "range") & F.col("minimum").isNull() & F.col("maximum").isNull(), F.lit("A range needs a bound.")),
        ((kind == "range") & (F.col("minimum") > F.col("maximum")), F.lit("The bounds are the wrong way round.")),
        ((kind == "allowed_values") & (F.coalesce(F.size("allowed_values"), F.lit(0)) <= 0), F.lit("The vocabulary is empty.")),
        ((kind == "allowed_values") & F.col("overlaps").isNull(), F.lit("None of the proposed values occur.")),
    )
    judged = known.withColumns({"basic": basic, "shape": shape})
    sound = F.col("basic").isNull() & F.col("shape").isNull()
    ranked = judged.withColumn("first", _first_of(judged, sound, "name")).withColumn(
        "taken_before",
        F.coalesce(
            F.max(F.when(sound, 1)).over(
                Window.partitionBy("name").orderBy("suggestion").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    )
    reason = F.coalesce(
        "basic",
        F.when(F.col("taken_before") == 1, phrase("A rule named '%s' was already suggested.", F.col("name"))),
        "shape",
    )
    return ranked.withColumns({"accepted": reason.isNull(), "reason": reason}).drop(
        "column_exists", "overlaps", "basic", "shape", "first", "taken_before"
    )


def ground_explanations(explanations: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Explanations (``finding_reference, text``) joined to findings, and those about none."""
    known = findings.select(F.col("finding_id").alias("finding_reference"), "issue_type", "column", "title",
                            "affected_rows", "row_count")
    return (
        explanations.join(known, "finding_reference"),
        explanations.join(known, "finding_reference", "left_anti"),
    )


# ------------------------------------------------------------------ what survives


def mapping_findings(grounded: DataFrame, levels: DataFrame, row_count: int) -> DataFrame:
    """One advisory finding per column with accepted mappings.

    ``levels`` has ``column, t, n``: the occurring values and their rows.
    """
    accepted = grounded.filter("accepted").join(
        levels.select("column", F.col("t").alias("source"), "n"), ["column", "source"], "left"
    )
    pair = F.concat(F.lit("'"), F.col("source"), F.lit("' to '"), F.col("target"), F.lit("'"))
    per_column = accepted.groupBy("column").agg(
        F.sum("n").alias("affected"),
        F.min("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("mappings"),
        F.array_sort(F.collect_list(F.struct("suggestion", pair.alias("pair")))).alias("pairs"),
    ).withColumn("row_count", F.lit(row_count))
    shown = F.array_join(F.transform(F.slice("pairs", 1, 4), lambda p: p["pair"]), "; ")
    struct = finding(
        "advised_category_mapping", "inconsistent_category", F.lit("info"), F.col("column"),
        phrase("Suggested merge of categories in '%s'", F.col("column")),
        phrase("%,d mapping(s) are suggested: %s. Both sides occur in the data; whether they mean the same is for a person to say.",
               F.col("mappings"), shown),
        F.col("affected"), F.col("row_count"), details(mapping_count=F.col("mappings")), F.col("confidence"), source=ADVISORY,
    )
    return as_findings(per_column, [struct])


def mapping_proposals(grounded: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposals for advisory mapping findings, and the mappings they carry."""
    about = findings.filter("check_id = 'advised_category_mapping'")
    identity = proposal_id(F.col("finding_id"), F.lit("map_category"), ADVISORY)
    table = about.select(
        identity.alias("proposal_id"), "finding_id", F.lit("map_category").alias("action"), "source", "column",
        phrase("Apply the suggested mapping to '%s'", F.col("column")).alias("title"),
        F.lit("Rewrite values as suggested. Read every mapping first: it rests on meaning, not on a rule.").alias("description"),
        F.col("explanation").alias("rationale"),
        F.create_map().cast("map<string,string>").alias("parameters"),
        "affected_rows", F.lit(False).alias("destructive"), "confidence",
        F.lit(None).cast("int").alias("position"),
    )
    pairs = grounded.filter("accepted").join(table.select("proposal_id", "column"), "column")
    return table, pairs.select("proposal_id", F.col("source").alias("from_value"), F.col("target").alias("to_value"))


def description_findings(grounded: DataFrame, row_count: int) -> DataFrame:
    """Accepted descriptions as advisory findings; needs ``meaning`` and ``confidence``."""
    struct = finding(
        "advised_column_meaning", "schema_mismatch", F.lit("info"), F.col("column"),
        phrase("Reading of '%s'", F.col("column")), F.col("meaning"), F.lit(0), F.lit(row_count),
        F.lit("{}"), F.col("confidence"), source=ADVISORY,
    )
    return as_findings(grounded.filter("accepted"), [struct])


def rule_findings(grounded: DataFrame, row_count: int, existing: list[str] = ()) -> DataFrame:
    """Accepted rules as advisory findings, names already in use left out."""
    fresh = grounded.filter("accepted")
    if existing:
        fresh = fresh.filter(~F.col("name").isin(*existing))
    struct = finding(
        "advised_rule", "business_rule_violation", F.lit("info"), F.col("column"),
        phrase("Suggested rule: %s", F.col("name")),
        phrase("A %s rule on '%s' is suggested. Add it to the rule file to adopt it.", F.col("rule_type"), F.col("column")),
        F.lit(0), F.lit(row_count), details(rule_type=F.col("rule_type")), F.col("confidence"),
        fingerprint=F.col("name"), source=ADVISORY,
    )
    return as_findings(fresh, [struct])


def explanation_findings(explanations: DataFrame, findings: DataFrame) -> DataFrame:
    """Explanations of known findings as advisory findings."""
    known, _ = ground_explanations(explanations, findings)
    struct = finding(
        "advised_explanation", "explanation", F.lit("info"), F.col("column"),
        phrase("Explanation: %s", F.col("title")), F.col("text"), F.col("affected_rows"), F.col("row_count"),
        details(explains_finding=F.col("finding_reference")), 0.7, fingerprint=F.col("finding_reference"), source=ADVISORY,
    )
    return as_findings(known, [struct])


def merge_findings(found: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables, each finding id once."""
    return found.unionByName(more.join(found.select("finding_id"), "finding_id", "left_anti").dropDuplicates(["finding_id"]))
