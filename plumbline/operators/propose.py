"""Corrections offered for findings. Nothing changes until a person approves one.

A proposal is one row; the value mappings it needs are rows of a second table, because a
lookup may have as many keys as the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import naming
from plumbline.functions.severity import proposal_id
from plumbline.operators.dataset import ROW_ID, Dataset, first_per_group, lookup, materialise, pinned, small_table
from plumbline.operators.dependencies import find_determinants, lookup_table
from plumbline.operators.findings import worst_first
from plumbline.operators.frequency import text_cells

PROPOSALS_SCHEMA = T.StructType(
    [
        T.StructField("proposal_id", T.StringType()),
        T.StructField("finding_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("rationale", T.StringType()),
        T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
        T.StructField("affected_rows", T.LongType()),
        T.StructField("destructive", T.BooleanType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("position", T.IntegerType()),
    ]
)
MAPPINGS_DDL = "proposal_id string, from_value string, to_value string"
#: Separates the values of a list parameter; a control character no trimmed value contains.
LIST_MARK = "\x1f"
MANUAL = "manual_review"


@dataclass(frozen=True)
class Proposals:
    """Offered corrections and the value mappings some of them carry."""

    table: DataFrame
    mappings: DataFrame


# ------------------------------------------------------------------ shared evidence


def spelling_leaders(values: DataFrame, key: str) -> DataFrame:
    """Keys with several written forms: ``pos, key, leaders`` (most frequent forms) and the ``winner``.

    A group whose most frequent forms tie has several leaders and no majority to follow. Blank
    values and values without letters or digits have no key and belong to no group.
    """
    forms = _forms(values, key)
    groups = forms.groupBy("pos", "key").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("forms")).filter("forms > 1")
    return (
        forms.join(groups, ["pos", "key"])
        .filter("n = most")
        .groupBy("pos", "key")
        .agg(F.count(F.lit(1)).alias("leaders"), F.min(F.struct("s", "first_row", "is_long")).alias("winner"))
    )


def _forms(values: DataFrame, key: str) -> DataFrame:
    present = values.filter(F.col("present") & (F.col(key) != ""))
    return present.select("pos", F.col(key).alias("key"), "s", "n", "first_row", "is_long")


def spelling_map(values: DataFrame, key: str, data: Dataset | None = None) -> DataFrame:
    """Each written form mapped to the most frequent form sharing its key.

    ``values`` has ``pos, s, n`` and the key column, one row per raw form. Long forms stand in
    their short form; with ``data``, the text to write is read back whole.
    """
    leaders = spelling_leaders(values, key).filter("leaders = 1").select("pos", "key", "winner")
    mapped = _forms(values, key).join(leaders, ["pos", "key"]).filter(F.col("s") != F.col("winner.s"))
    if data is not None:
        mapped = _spelled_out(mapped, data)
    else:
        mapped = mapped.withColumn("to_value", F.col("winner.s"))
    return mapped.select("pos", F.col("s").alias("from_value"), "to_value", "n")


def _spelled_out(mapped: DataFrame, data: Dataset) -> DataFrame:
    """``mapped`` with ``to_value``, the winner's whole text, read back from its first row if it is long."""
    mapped = materialise(mapped)
    wanted = mapped.filter("winner.is_long").select("pos", F.col("winner.first_row").alias(ROW_ID)).distinct()
    positions = [row.pos for row in wanted.select("pos").distinct().collect()]
    if not positions:
        return mapped.withColumn("to_value", F.col("winner.s"))
    whole = text_cells(data, positions).join(lookup(wanted), ["pos", ROW_ID]).groupBy("pos", F.col(ROW_ID).alias("__row")).agg(F.first("s").alias("__whole"))
    long = F.col("winner.is_long") & (F.col("winner.first_row") == F.col("__row"))
    joined = mapped.join(whole.withColumnRenamed("pos", "__pos"), long & (F.col("pos") == F.col("__pos")), "left")
    return joined.withColumn("to_value", F.coalesce("__whole", "winner.s")).drop("__whole", "__row", "__pos")


def most_frequent(trimmed: DataFrame) -> DataFrame:
    """The one most frequent trimmed value per column; none when two tie: ``pos, value``."""
    top = first_per_group(trimmed.select("pos", "t", "n"), ["pos"], [F.desc("n"), F.asc("t")], 2, "rank")
    pair = top.groupBy("pos").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("t", "n"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("second"),
    )
    return pair.filter(F.col("second").isNull() | (F.col("first.n") > F.col("second"))).select(
        "pos", F.col("first.t").alias("value")
    )


def may_impute(name: str, semantic_type: str) -> bool:
    """Codes, coordinates and identifiers have no meaningful middle."""
    return not (naming.hinted(name) & {"identifier", "code", "coordinate"} or semantic_type == "identifier")


# ------------------------------------------------------------------ builders

#: issue type -> builder; a builder returns an offer or None for manual review.
BUILDERS: dict[str, Callable[["Evidence", dict], dict | None]] = {}


def builds(issue_type: str):
    """Register the proposal builder of an issue type."""

    def register(build):
        BUILDERS[issue_type] = build
        return build

    return register


@dataclass(frozen=True)
class Evidence:
    """Per-column knowledge the builders draw on; every entry is one row per column."""

    facts: dict[str, dict]
    changed: dict[tuple[str, str], int]
    ties: dict[tuple[str, str], int]
    modes: dict[str, str]
    medians: dict[str, float]
    determinants: dict[str, dict]


def _offer(action: str, title: str, description: str, affected: int | None = None, destructive: bool = False,
           confidence: float = 1.0, **parameters: str) -> dict:
    return {
        "action": action, "title": title, "description": description, "affected_rows": affected,
        "destructive": destructive, "confidence": confidence, "parameters": parameters,
    }


@builds("leading_trailing_whitespace")
def _strip(evidence: Evidence, found: dict) -> dict:
    return _offer("strip_whitespace", f"Trim '{found['column']}'",
                  "Remove white space around the values. What can be seen stays the same.")


@builds("inconsistent_capitalization")
def _case(evidence: Evidence, found: dict) -> dict | None:
    changed = evidence.changed.get((found["column"], "fold"))
    if not changed:
        return {}
    return _offer("normalize_case", f"Unify the letter case of '{found['column']}'",
                  "Rewrite each value the way it is written most often." + _tied(evidence, found, "fold"), changed)


def _tied(evidence: Evidence, found: dict, key: str) -> str:
    ties = evidence.ties.get((found["column"], key))
    return f" {ties:,} group(s) have no majority and stay as they are." if ties else ""


@builds("inconsistent_category")
def _category(evidence: Evidence, found: dict) -> dict | None:
    changed = evidence.changed.get((found["column"], "key"))
    if not changed:
        return {}
    return _offer("map_category", f"Merge equal categories of '{found['column']}'",
                  "Rewrite values that differ only in spacing or punctuation the way most rows have them."
                  + _tied(evidence, found, "key"), changed)


@builds("numeric_stored_as_text")
def _numeric(evidence: Evidence, found: dict) -> dict:
    fact = evidence.facts[found["column"]]
    lost = fact["present_count"] - fact["number_count"]
    warning = f" {lost:,} value(s) cannot be read and would become empty." if lost else ""
    return _offer("cast_to_numeric", f"Convert '{found['column']}' to numbers",
                  "Drop signs and separators and store real numbers." + warning, fact["number_count"],
                  lost > 0, unparseable_becomes_empty=str(lost))


@builds("inconsistent_date_format")
def _dates(evidence: Evidence, found: dict) -> dict:
    fact = evidence.facts[found["column"]]
    lost = fact["undated_count"]
    warning = f" {lost:,} value(s) cannot be read and would become empty." if lost else ""
    return _offer("parse_dates", f"Rewrite '{found['column']}' as ISO dates",
                  "Write every date as YYYY-MM-DD. Ambiguous ones are read day first; check the preview." + warning,
                  evidence.changed.get((found["column"], "date"), 0), lost > 0, 0.7,
                  output_format="yyyy-MM-dd", dayfirst="true")


@builds("exact_duplicate_rows")
def _duplicates(evidence: Evidence, found: dict) -> dict:
    return _offer("drop_duplicate_rows", "Keep one row of each equal group",
                  "Keep the first of each group of equal rows and drop the rest.", destructive=True, keep="first")


@builds("invalid_email")
def _emails(evidence: Evidence, found: dict) -> dict:
    return _offer("clear_invalid_values", f"Blank the invalid addresses of '{found['column']}'",
                  "Empty malformed addresses so that they count as missing. The text is lost.",
                  destructive=True, predicate="invalid_email")


@builds("invalid_date")
def _bad_dates(evidence: Evidence, found: dict) -> dict:
    return _offer("clear_invalid_values", f"Blank the impossible dates of '{found['column']}'",
                  "Empty values that name no day; nobody can tell what was meant.",
                  destructive=True, predicate="invalid_date")


@builds("placeholder_value")
def _placeholders(evidence: Evidence, found: dict) -> dict:
    fact = evidence.facts[found["column"]]
    return _offer("clear_invalid_values", f"Blank the placeholders of '{found['column']}'",
                  "Empty filler so that the gap counts as missing.", destructive=True,
                  predicate="placeholder_value", longest=str(fact["longest"] or 0),
                  repeated=LIST_MARK.join(fact["repeated_fillers"] or []))


@builds("corrupted_encoding")
def _encoding(evidence: Evidence, found: dict) -> dict | None:
    repairable = evidence.facts[found["column"]]["repairable_count"]
    if not repairable:
        return None
    return _offer("repair_encoding", f"Repair the characters of '{found['column']}'",
                  "Decode damaged values back to the text the source held.", repairable, confidence=0.95)


@builds("missing_values")
def _missing(evidence: Evidence, found: dict) -> dict | None:
    name = found["column"]
    fact = evidence.facts[name]
    if fact["missing_count"] >= fact["row_count"]:
        return None
    decided = evidence.determinants.get(name)
    if decided is not None:
        return _recover(name, decided)
    if not may_impute(name, fact["semantic_type"]):
        return None
    if fact["is_numeric"] and evidence.medians.get(name) is not None:
        value, strategy = _plain(round(evidence.medians[name], 6)), "median"
    elif fact["semantic_type"] in ("categorical", "boolean") and name in evidence.modes:
        value, strategy = evidence.modes[name], "most frequent value"
    else:
        return None
    return _offer("fill_missing", f"Fill the gaps of '{name}' with the {strategy}",
                  f"Write '{value}' into every gap. This invents data and biases every statistic of the column.",
                  confidence=0.5, value=value, strategy=strategy)


def _plain(number: float) -> str:
    return str(float(number))


def _recover(name: str, decided: dict) -> dict | None:
    other, rows = decided["determinant"], decided["evidence_rows"]
    if decided["recoverable_rows"] == 0:
        return {
            "manual": f"'{name}' is decided by '{other}' on all {rows:,} rows where both are filled, but '{other}' "
            f"gives no value for any of the {decided['unrecoverable_rows']:,} gaps. It must come from the source."
        }
    rest = decided["unrecoverable_rows"]
    left = f" {rest:,} gap(s) stay, because '{other}' does not help there." if rest else ""
    return _offer("fill_from_related", f"Recover '{name}' from '{other}'",
                  f"Look the value up by '{other}', which decides it on {rows:,} rows.{left}",
                  decided["recoverable_rows"], confidence=0.9, determinant=other)


# ------------------------------------------------------------------ assembly


def propose(analysis) -> Proposals:
    """Corrections for every finding of an analysis, worst finding first."""
    review, data = analysis.review, analysis.review.data
    found = [row.asDict() for row in worst_first(analysis.findings).collect()]
    evidence, maps = _gather(review, found)
    rows, seen = [], set()
    for finding in found:
        row = _proposal(finding, evidence)
        if row is not None and (row["finding_id"], row["action"]) not in seen:
            seen.add((row["finding_id"], row["action"]))
            rows.append({**row, "position": len(rows)})
    drafted = small_table(data.spark, rows, PROPOSALS_SCHEMA)
    table, _ = pinned(drafted.withColumn("proposal_id", proposal_id(F.col("finding_id"), F.col("action"))))
    return Proposals(table, _mappings(data, table, evidence, maps))


def _proposal(found: dict, evidence: Evidence) -> dict | None:
    build = BUILDERS.get(found["issue_type"])
    column_known = found["column"] is None or found["column"] in evidence.facts
    offer = build(evidence, found) if build is not None and column_known else None
    base = {
        "proposal_id": None, "finding_id": found["finding_id"], "source": found["source"],
        "column": found["column"], "rationale": found["explanation"],
    }
    if offer == {}:
        return None
    if offer is None or "manual" in offer:
        note = (offer or {}).get("manual", "No safe automatic fix exists; someone who knows the data must decide.")
        return {
            **base, "action": MANUAL, "title": f"Review: {found['title']}", "description": note, "parameters": {},
            "affected_rows": found["affected_rows"], "destructive": False, "confidence": found["confidence"],
        }
    affected = offer["affected_rows"]
    return {**base, **offer, "affected_rows": found["affected_rows"] if affected is None else affected}


def _gather(review, found: list[dict]) -> tuple[Evidence, dict[str, DataFrame]]:
    facts = {fact["column"]: fact for fact in review.fact_rows}
    issues = {issue: [f["column"] for f in found if f["issue_type"] == issue and f["column"] in facts]
              for issue in ("inconsistent_capitalization", "inconsistent_category", "inconsistent_date_format",
                            "missing_values")}

    def values_of(names: list[str]) -> DataFrame:
        return review.values.filter(F.col("pos").isin([facts[name]["pos"] for name in names]))

    maps = {
        key: materialise(spelling_map(values_of(issues[issue]), key, review.data))
        for key, issue in (("fold", "inconsistent_capitalization"), ("key", "inconsistent_category"))
        if issues[issue]
    }
    by_pos = {fact["pos"]: name for name, fact in facts.items()}
    ties = {
        (by_pos[row.pos], key): row.n
        for key, issue in (("fold", "inconsistent_capitalization"), ("key", "inconsistent_category"))
        if issues[issue]
        for row in spelling_leaders(values_of(issues[issue]), key).filter("leaders > 1").groupBy("pos").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    changed = {}
    for key, mapping in maps.items():
        for row in mapping.groupBy("pos").agg(F.sum("n").alias("n")).collect():
            changed[(by_pos[row.pos], key)] = row.n
    if issues["inconsistent_date_format"]:
        rewritten = F.date_format("moment", "yyyy-MM-dd")
        differs = F.coalesce("s", "t") != F.coalesce(rewritten, F.lit(""))
        dated = review.frequencies.weighted([facts[name]["pos"] for name in issues["inconsistent_date_format"]])
        for row in dated.filter("given").groupBy("pos").agg(
            F.sum(F.when(differs, F.col("n")).otherwise(0)).alias("n")
        ).collect():
            changed[(by_pos[row.pos], "date")] = row.n

    gaps = [name for name in issues["missing_values"] if facts[name]["present_count"] > 0]
    determinants = {
        row.target: row.asDict() for row in find_determinants(review.data, gaps, review.fact_rows).collect()
    }
    modes = {}
    if gaps:
        positions = [facts[name]["pos"] for name in gaps]
        shown = review.values.filter(F.col("pos").isin(positions) & F.col("present")).groupBy(
            "pos", F.col("shown").alias("t")
        ).agg(F.sum("n").alias("n"))
        few = [p for p in positions if facts[by_pos[p]]["semantic_type"] in ("categorical", "boolean")]
        modes = {by_pos[row.pos]: row.value for row in most_frequent(shown.filter(F.col("pos").isin(few))).collect()}
    medians = {
        row["column"]: row.median
        for row in review.profiles.select("column", F.col("numeric.median").alias("median")).collect()
    }
    return Evidence(facts, changed, ties, modes, medians, determinants), maps


def _mappings(data: Dataset, table: DataFrame, evidence: Evidence, maps: dict[str, DataFrame]) -> DataFrame:
    """``proposal_id, from_value, to_value`` of every proposal that maps values."""
    result = data.spark.createDataFrame([], MAPPINGS_DDL)
    offers = table.select("proposal_id", "action", "column", F.col("parameters")["determinant"].alias("determinant")).collect()
    for offer in offers:
        key = {"normalize_case": "fold", "map_category": "key"}.get(offer.action)
        if key is not None:
            pos = evidence.facts[offer["column"]]["pos"]
            pairs = maps[key].filter(F.col("pos") == pos).select("from_value", "to_value")
        elif offer.action == "fill_from_related":
            pairs = lookup_table(data, offer.determinant, offer["column"], needed_only=True).toDF("from_value", "to_value")
        else:
            continue
        result = result.unionByName(pairs.withColumn("proposal_id", F.lit(offer.proposal_id)))
    return materialise(result)


# ------------------------------------------------------------------ decisions


def with_status(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals with their decision; no decision means pending.

    ``decisions`` has ``proposal_id, status`` and optionally ``decided_at, decided_by, note``.
    """
    return proposals.join(decisions, "proposal_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("pending"))
    )


def decision_counts(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Totals of a review, as one row."""
    status, manual = F.col("status"), F.col("action") == MANUAL
    return with_status(proposals, decisions).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~manual).alias("actionable"),
        F.count_if(status == "approved").alias("approved"),
        F.count_if(status == "rejected").alias("rejected"),
        F.count_if(status == "pending").alias("pending"),
        F.count_if(manual).alias("manual_review"),
        F.count_if(F.col("source") != "deterministic").alias("advisory"),
        F.count_if(~manual & (status == "pending")).alias("pending_actionable"),
    )


def decide(spark, approved: list[str] = (), rejected: list[str] = (), reviewer: str = "reviewer") -> DataFrame:
    """A decisions table from proposal ids."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("proposal_id", "status", "decided_by")])
    rows = [{"proposal_id": p, "status": "approved", "decided_by": reviewer} for p in approved]
    rows += [{"proposal_id": p, "status": "rejected", "decided_by": reviewer} for p in rejected]
    return small_table(spark, rows, schema).withColumn("decided_at", F.current_timestamp()).withColumn("note", F.lit(""))


def merge_proposals(offered: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables, each proposal id once; what was offered first wins."""
    fresh = more.join(offered.select("proposal_id"), "proposal_id", "left_anti").dropDuplicates(["proposal_id"])
    return offered.unionByName(fresh, allowMissingColumns=True)
