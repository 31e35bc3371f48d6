"""Declarative business rules.

Rules that look at one row at a time become predicates counted together in one aggregate; all
uniqueness rules share one grouping. A rule whose columns are absent is skipped, so a rule
file may serve several tables.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, fields, replace
from datetime import date, timedelta
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as tx
from plumbline.functions.dates import with_dates
from plumbline.functions.numbers import with_number
from plumbline.functions.severity import SEVERITIES, percent
from plumbline.operators.checks import HALVES, Context, dataset_check
from plumbline.operators.dataset import ROW_ID, Dataset, col, first_per_group, lookup, materialise, row_digest, small_table
from plumbline.operators.findings import EVIDENCE_ROWS, as_findings, details, finding, no_findings, phrase

log = logging.getLogger(__name__)

OPERATORS = {
    "<": lambda left, right: left < right,
    "<=": lambda left, right: left <= right,
    ">": lambda left, right: left > right,
    ">=": lambda left, right: left >= right,
    "==": lambda left, right: left == right,
    "!=": lambda left, right: left != right,
}


class RuleError(ValueError):
    """A rule file or rule definition is not valid."""


@dataclass(frozen=True)
class Rule:
    name: str
    description: str = ""
    severity: str = "high"
    enabled: bool = True
    type = ""

    def __post_init__(self) -> None:
        if not self.name or len(self.name) > 120:
            raise RuleError("A rule needs a name of at most 120 characters.")
        if self.severity not in SEVERITIES:
            raise RuleError(f"Rule '{self.name}': unknown severity '{self.severity}'.")

    @property
    def used(self) -> list[str]:
        return [self.column]


@dataclass(frozen=True)
class NotNull(Rule):
    column: str = ""
    severity: str = "critical"
    type = "not_null"


@dataclass(frozen=True)
class Range(Rule):
    column: str = ""
    minimum: float | None = None
    maximum: float | None = None
    type = "range"

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.minimum is None and self.maximum is None:
            raise RuleError(f"Rule '{self.name}': give a minimum, a maximum or both.")
        if self.minimum is not None and self.maximum is not None and self.minimum > self.maximum:
            raise RuleError(f"Rule '{self.name}': the minimum exceeds the maximum.")


@dataclass(frozen=True)
class AllowedValues(Rule):
    column: str = ""
    values: tuple[str, ...] = ()
    case_sensitive: bool = False
    type = "allowed_values"

    def __post_init__(self) -> None:
        super().__post_init__()
        if not self.values:
            raise RuleError(f"Rule '{self.name}': the vocabulary is empty.")
        object.__setattr__(self, "values", tuple(str(value) for value in self.values))


@dataclass(frozen=True)
class NoFutureDates(Rule):
    column: str = ""
    tolerance_days: int = 0
    type = "no_future_dates"

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.tolerance_days < 0:
            raise RuleError(f"Rule '{self.name}': the tolerance is negative.")


@dataclass(frozen=True)
class Regex(Rule):
    """Values must match from their first character on. The dialect is Java's."""

    column: str = ""
    pattern: str = ""
    type = "regex"


@dataclass(frozen=True)
class Unique(Rule):
    columns: tuple[str, ...] = ()
    type = "unique"

    def __post_init__(self) -> None:
        super().__post_init__()
        if not self.columns:
            raise RuleError(f"Rule '{self.name}': name at least one column.")
        object.__setattr__(self, "columns", tuple(self.columns))

    @property
    def used(self) -> list[str]:
        return list(self.columns)


@dataclass(frozen=True)
class Comparison(Rule):
    left: str = ""
    operator: str = "=="
    right: str = ""
    compare_as: str = "numeric"
    type = "comparison"

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.operator not in OPERATORS:
            raise RuleError(f"Rule '{self.name}': unknown operator '{self.operator}'.")
        if self.compare_as not in ("numeric", "date"):
            raise RuleError(f"Rule '{self.name}': compare as 'numeric' or 'date'.")

    @property
    def used(self) -> list[str]:
        return [self.left, self.right]


RULE_TYPES = {rule.type: rule for rule in (NotNull, Range, AllowedValues, NoFutureDates, Regex, Unique, Comparison)}


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = ()
    name: str = "default"
    description: str = ""
    version: int = 1

    def __post_init__(self) -> None:
        names = [rule.name for rule in self.rules]
        repeated = {name for name in names if names.count(name) > 1}
        if repeated:
            raise RuleError(f"Rule names must be unique: {', '.join(sorted(repeated))}.")

    def split(self, columns: list[str]) -> tuple[list[Rule], list[Rule]]:
        """Enabled rules that these columns can answer, and the others."""
        enabled = [rule for rule in self.rules if rule.enabled]
        fits = [rule for rule in enabled if set(rule.used) <= set(columns)]
        return fits, [rule for rule in enabled if rule not in fits]


def parse_rules(raw: dict, source: str = "<inline>") -> RuleSet:
    """A rule set from a mapping, every problem named in one error."""
    rules, problems = [], []
    for index, entry in enumerate(raw.get("rules") or []):
        try:
            rules.append(_parse_rule(entry))
        except (RuleError, TypeError) as error:
            problems.append(f"rule {index + 1}: {error}")
    if problems:
        raise RuleError(f"{source}: " + "; ".join(problems))
    return RuleSet(
        tuple(rules), str(raw.get("name", "default")), str(raw.get("description", "")), int(raw.get("version", 1))
    )


def _parse_rule(entry: dict) -> Rule:
    kind = RULE_TYPES.get(entry.get("type"))
    if kind is None:
        raise RuleError(f"unknown rule type {entry.get('type')!r}")
    known = {f.name for f in fields(kind)}
    given = {key: value for key, value in entry.items() if key != "type"}
    unknown = set(given) - known
    if unknown:
        raise RuleError(f"unknown setting {', '.join(sorted(unknown))}")
    if any(not given.get(key) for key in ("column", "left", "right", "pattern") if key in known):
        raise RuleError(f"'{entry.get('name')}' lacks a required setting")
    return kind(**{key: tuple(value) if isinstance(value, list) else value for key, value in given.items()})


def load_rules(path: str | Path) -> RuleSet:
    """A rule set from a YAML file on the driver."""
    try:
        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as error:
        raise RuleError(f"Cannot read the rule file {path}: {error}") from error
    if raw is None:
        return RuleSet()
    if not isinstance(raw, dict):
        raise RuleError(f"{path}: expected a mapping at the top level.")
    return parse_rules(raw, Path(path).name)


def load_rules_or_none(path: str | Path) -> RuleSet | None:
    """Like :func:`load_rules`, but a broken file is logged and yields None."""
    try:
        return load_rules(path)
    except RuleError as error:
        log.warning("Rules unavailable: %s", error)
        return None


def check_patterns(spark: SparkSession, rules: RuleSet) -> None:
    """Raise :class:`RuleError` when the engine cannot compile a pattern."""
    for rule in rules.rules:
        if isinstance(rule, Regex):
            try:
                spark.range(1).select(F.lit("").rlike(rule.pattern)).collect()
            except Exception as error:
                raise RuleError(f"Rule '{rule.name}': invalid pattern.") from error


# ------------------------------------------------------------------ evaluation


def _with_parsed(data: Dataset, rules: list[Rule]) -> DataFrame:
    """Add a parsed copy of every text column that a rule reads as number or date."""
    df = data.frame
    for position, name in enumerate(data.columns):
        text = tx.is_text(data.type_of(name))
        if any(_reads(rule, name, "numeric") for rule in rules):
            out = f"number_{position}"
            df = with_number(df, col(name), out) if text else df.withColumn(out, _native_number(data, name))
        if any(_reads(rule, name, "date") for rule in rules):
            out = f"moment_{position}"
            if text:
                df = with_dates(df, col(name), "__mask", out).drop("__mask")
            else:
                df = df.withColumn(out, _native_moment(data, name))
    return df


def _reads(rule: Rule, name: str, as_type: str) -> bool:
    if name not in rule.used:
        return False
    if isinstance(rule, Range):
        return as_type == "numeric"
    if isinstance(rule, NoFutureDates):
        return as_type == "date"
    return isinstance(rule, Comparison) and rule.compare_as == as_type


def _native_number(data: Dataset, name: str) -> Column:
    if isinstance(data.type_of(name), T.NumericType):
        return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))
    return F.lit(None).cast("double")


def _native_moment(data: Dataset, name: str) -> Column:
    if isinstance(data.type_of(name), (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col(name).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def violation(rule: Rule, data: Dataset, as_of: date) -> Column:
    """Whether a row breaks a single-row rule; needs the columns of :func:`_with_parsed`."""

    def number(name: str) -> Column:
        return F.col(f"number_{data.columns.index(name)}")

    def moment(name: str) -> Column:
        return F.col(f"moment_{data.columns.index(name)}")

    broken = F.lit(False)
    if isinstance(rule, NotNull):
        broken = tx.missing(col(rule.column), data.type_of(rule.column))
    elif isinstance(rule, Range):
        # A value that is no number is left to the checks.
        if rule.minimum is not None:
            broken = broken | (number(rule.column) < rule.minimum)
        if rule.maximum is not None:
            broken = broken | (number(rule.column) > rule.maximum)
    elif isinstance(rule, AllowedValues):
        text = tx.normalised_text(col(rule.column), data.type_of(rule.column))
        shape = (lambda c: c) if rule.case_sensitive else tx.fold
        known = [shape(tx.trim(F.lit(value))) for value in rule.values]
        broken = ~shape(text).isin(known)
    elif isinstance(rule, NoFutureDates):
        limit = as_of + timedelta(days=rule.tolerance_days)
        broken = moment(rule.column) > F.lit(limit).cast("timestamp_ntz")
    elif isinstance(rule, Regex):
        present = ~tx.missing(col(rule.column), data.type_of(rule.column))
        broken = present & ~col(rule.column).cast("string").rlike(rf"\A(?:{rule.pattern})")
    elif isinstance(rule, Comparison):
        read = moment if rule.compare_as == "date" else number
        broken = ~OPERATORS[rule.operator](read(rule.left), read(rule.right))
    return F.coalesce(broken, F.lit(False))


def violation_counts(data: Dataset, rules: list[Rule], as_of: date) -> DataFrame:
    """Rows breaking each single-row rule, all counted in one pass: ``rule, affected``."""
    parsed = _with_parsed(data, rules)
    counts = [F.count_if(violation(rule, data, as_of)).alias(f"r{i}") for i, rule in enumerate(rules)]
    pairs = [F.struct(F.lit(rule.name).alias("rule"), F.col(f"r{i}").alias("affected")) for i, rule in enumerate(rules)]
    return parsed.agg(*counts).select(F.inline(F.array(*pairs)))


def unique_key(rule: Unique, data: Dataset) -> Column:
    """Digest of the trimmed, folded key. Nulls equal each other."""
    return row_digest([tx.fold(tx.trim(col(name).cast("string"))) for name in rule.columns])


def _unique_keys(data: Dataset, rules: list[Unique]) -> DataFrame:
    """Row id, ``rule`` and ``digest`` of every row for every uniqueness rule, from one pass over the table."""
    keys = [F.struct(F.lit(rule.name).alias("rule"), unique_key(rule, data).alias("digest")) for rule in rules]
    return data.frame.select(ROW_ID, F.inline(F.array(*keys)))


def repeat_counts(data: Dataset, rules: list[Unique]) -> DataFrame:
    """Rows repeating an earlier key, for each rule: ``rule, affected``. All rules share one grouping."""
    groups = _unique_keys(data, rules).groupBy("rule", "digest").agg(F.count(F.lit(1)).alias("n"))
    none = data.spark.createDataFrame([(rule.name, 1) for rule in rules], "rule string, n bigint")
    return groups.select("rule", "n").unionByName(none).groupBy("rule").agg(F.sum(F.col("n") - 1).alias("affected"))


def _demand(rule: Rule) -> str:
    """What a rule asks for, in words."""
    if isinstance(rule, NotNull):
        return f"'{rule.column}' must be filled in."
    if isinstance(rule, Range):
        bounds = [f"at least {rule.minimum:g}"] if rule.minimum is not None else []
        bounds += [f"at most {rule.maximum:g}"] if rule.maximum is not None else []
        return f"'{rule.column}' must be {' and '.join(bounds)}."
    if isinstance(rule, AllowedValues):
        more = ", and others" if len(rule.values) > 8 else ""
        return f"'{rule.column}' may only be {', '.join(rule.values[:8])}{more}."
    if isinstance(rule, NoFutureDates):
        return f"'{rule.column}' must not lie more than {rule.tolerance_days} day(s) ahead."
    if isinstance(rule, Regex):
        return f"'{rule.column}' must match {rule.pattern}."
    if isinstance(rule, Unique):
        return f"{' + '.join(rule.columns)} must not repeat."
    return f"'{rule.left}' must be {rule.operator} '{rule.right}' ({rule.compare_as})."


_RULES_SCHEMA = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("rule_type", T.StringType()),
        T.StructField("rule_severity", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("demand", T.StringType()),
    ]
)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as a metadata table. Rules over several columns belong to the whole table."""
    rows = [
        {
            "rule": rule.name,
            "rule_type": rule.type,
            "rule_severity": rule.severity,
            "column": rule.used[0] if len(rule.used) == 1 else None,
            "columns": rule.used,
            "demand": " ".join(part for part in (_demand(rule), rule.description) if part),
        }
        for rule in rules
    ]
    return small_table(spark, rows, _RULES_SCHEMA)


def evaluate(data: Dataset, rules: RuleSet, as_of: date) -> DataFrame:
    """``rule, affected`` for every applicable rule."""
    fits, _ = rules.split(data.columns)
    single = [rule for rule in fits if not isinstance(rule, Unique)]
    counted = [violation_counts(data, single, as_of)] if single else []
    unique = [rule for rule in fits if isinstance(rule, Unique)]
    counted += [repeat_counts(data, unique)] if unique else []
    if not counted:
        return data.spark.createDataFrame([], "rule string, affected bigint")
    result = counted[0]
    for more in counted[1:]:
        result = result.unionByName(more)
    return result


def violating_rows(data: Dataset, rules: list[Rule], as_of: date, limit: int = EVIDENCE_ROWS) -> DataFrame:
    """The first row ids breaking each rule: ``rule, ids``."""
    single = [rule for rule in rules if not isinstance(rule, Unique)]
    hits = []
    if single:
        flags = [F.when(violation(rule, data, as_of), F.lit(rule.name)) for rule in single]
        hits.append(
            _with_parsed(data, single).select(ROW_ID, F.explode(F.array_compact(F.array(*flags))).alias("rule"))
        )
    unique = [rule for rule in rules if isinstance(rule, Unique)]
    if unique:
        keyed = _unique_keys(data, unique)
        first = keyed.groupBy("rule", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias("kept"))
        repeated = materialise(first.filter("n > 1").select("rule", "digest", "kept"))
        repeats = keyed.join(lookup(repeated), ["rule", "digest"])
        hits.append(repeats.filter(F.col(ROW_ID) > F.col("kept")).select(ROW_ID, "rule"))
    rows = hits[0]
    for more in hits[1:]:
        rows = rows.unionByName(more)
    ranked = first_per_group(rows, ["rule"], [F.asc(ROW_ID)], limit)
    return ranked.groupBy("rule").agg(F.array_sort(F.collect_list(ROW_ID)).alias("ids"))


@dataset_check("business_rule")
def business_rules(context: Context) -> DataFrame:
    """One finding per broken rule, and one that names the rules not evaluated."""
    rules: RuleSet | None = context.rules
    spark = context.data.spark
    if rules is None:
        return no_findings(spark)
    fits, skipped = rules.split(context.data.columns)
    found = no_findings(spark)
    if fits:
        broken = evaluate(context.data, rules, context.as_of).filter("affected > 0")
        known = broken.join(F.broadcast(rule_table(spark, fits)), "rule").withColumn("row_count", F.lit(context.row_count))
        struct = finding(
            "business_rule", "business_rule_violation", F.col("rule_severity"), F.col("column"),
            phrase("Business rule failed: %s", F.col("rule")),
            phrase("%,d rows (%s) break the rule '%s'. %s", F.col("affected"),
                   percent(F.try_divide(F.col("affected"), F.col("row_count"))), F.col("rule"), F.col("demand")),
            F.col("affected"), F.col("row_count"),
            details(rule_name=F.col("rule"), rule_type=F.col("rule_type"), columns=F.col("columns")),
            fingerprint=F.col("rule"),
        )
        found = as_findings(known, [struct])
        if context.row_ids:
            rows = violating_rows(context.data, fits, context.as_of)
            tagged = found.withColumn("rule", F.get_json_object("details", "$.rule_name"))
            found = (
                tagged.join(F.broadcast(rows), "rule", "left")
                .withColumn("row_ids", F.coalesce("ids", "row_ids"))
                .drop("rule", "ids")
            )
    if skipped:
        found = found.unionByName(_skipped_finding(context, skipped))
    return found


def _halves(context: Context) -> list[Context]:
    """The applicable rules in two halves; rules that do not fit the table stay with the first."""
    rules: RuleSet | None = context.rules
    fits, misfits = rules.split(context.data.columns) if rules is not None else ([], [])
    if len(fits) + bool(misfits) < 2:
        return []
    middle = len(fits) // 2
    return [replace(context, rules=replace(rules, rules=tuple(part))) for part in (misfits + fits[:middle], fits[middle:]) if part]


HALVES["business_rule"] = _halves


def _skipped_finding(context: Context, skipped: list[Rule]) -> DataFrame:
    names = [rule.name for rule in skipped]
    listed = F.array(
        *[F.struct(F.lit(r.name).alias("name"), F.array(*map(F.lit, r.used)).alias("columns")) for r in skipped[:20]]
    )
    struct = finding(
        "business_rule", "business_rule_violation", F.lit("info"), F.lit(None),
        F.lit(f"Rules that do not fit this table: {len(names)}"),
        F.lit("The table lacks columns these rules need: " + ", ".join(names[:8]) + (", and others" if len(names) > 8 else "") + "."),
        F.lit(0), F.lit(context.row_count), details(skipped_rules=listed), fingerprint="__skipped__",
    )
    return as_findings(context.data.spark.range(1), [struct])
