"""Column profiles: one row per column with everything the checks and the score need."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import naming
from plumbline.functions import text as tx
from plumbline.functions.dates import ALL_FORMATS, DATE_FORMATS, TIMED_FORMATS, format_labels
from plumbline.operators.dataset import (
    ROW_ID,
    Dataset,
    beside_facts,
    col,
    digest_part,
    first_per_group,
    row_digest,
    small_table,
)
from plumbline.operators.frequency import kind_of

TOP_VALUES = 10
SAMPLE_VALUES = 5
#: Distinct values of a column that one task may sort for an exact median, and rows of its last slice.
MEDIAN_WINDOW, SLICE = 1_000_000, 100_000
#: Where ranges are cut: evenly, and closely around the middle.
_SHARES = [*(i / 16 for i in range(1, 8)), 0.49, 0.51, *(i / 16 for i in range(9, 16))]

_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(),
    "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(), "bigints": T.ArrayType(T.LongType()), "strings": T.ArrayType(T.StringType()),
}


def _fields(**names: str) -> list[T.StructField]:
    """Fields by type: the names of all fields of a type in one string."""
    return [T.StructField(name, _TYPES[kind]) for kind, listed in names.items() for name in listed.split()]


#: What is measured of a column by sums over its values.
MEASURED_SCHEMA = T.StructType(
    _fields(
        int="pos min_length max_length max_trimmed longest any_format every_format",
        string="column data_type kind",
        boolean="temporal_name identifier_name age_name amount_name past_name sensitive_name all_whole has_long",
        bigint="row_count missing_count given_count distinct_raw total_length blank_count padded_count padded_present email_count at_count "
        "token_count date_count number_count decorated_count zero_count negative_count implausible_age_count future_count lost_count "
        "repairable_count kind_dates kind_booleans distinct_text distinct_folded",
        bigints="format_counts",
        double="min_number max_number total_number mean std_dev",
        timestamp_ntz="min_moment max_moment",
    )
)
_GROUPS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("forms", T.ArrayType(T.StringType()))]))
#: Everything that is known of a column: the measures, its type, and what checks and profiles show of it.
FACTS_SCHEMA = T.StructType(
    [
        *MEASURED_SCHEMA.fields,
        *_fields(
            bigint="unique_count present_count kind_numbers kind_text undated_count bad_email_count damaged_count impossible_count "
            "extreme_count filler_rows case_rows case_group_count category_rows category_group_count",
            string="semantic_type",
            double="confidence median",
            boolean="is_numeric is_temporal is_text",
            date="as_of",
            strings="sample_values repeated_fillers filler_values",
        ),
        T.StructField("top_values", T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("count", T.LongType())]))),
        T.StructField("examples", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("case_groups", _GROUPS),
        T.StructField("category_groups", _GROUPS),
    ]
)


def column_rows(data: Dataset) -> list[dict]:
    """Column metadata: position, name, type and what the name hints at."""
    return [
        {
            "pos": position,
            "column": field.name,
            "data_type": field.dataType.simpleString(),
            "kind": kind_of(field.dataType),
            **{f"{hint}_name": hint in naming.hinted(field.name) for hint in naming.PROFILED},
        }
        for position, field in enumerate(data.fields)
    ]


# ------------------------------------------------------------------ one-scan measures


def missing_counts(data: Dataset) -> DataFrame:
    """Missing cells of every column from a single aggregate, one row per column."""
    sums = [
        F.count_if(tx.missing(col(field.name), field.dataType)).alias(str(position))
        for position, field in enumerate(data.fields)
    ]
    wide = data.frame.agg(F.count(F.lit(1)).alias("row_count"), *sums)
    pairs = [
        F.struct(F.lit(field.name).alias("column"), F.col(str(position)).alias("missing_count"))
        for position, field in enumerate(data.fields)
    ]
    return wide.select("row_count", F.inline(F.array(*pairs))).select(
        "column", "missing_count", "row_count", F.try_divide(F.col("missing_count"), F.col("row_count")).alias("missing_ratio")
    )


def duplicate_rows(data: Dataset, folded: bool = False) -> DataFrame:
    """Repeats of earlier rows and the groups they form, as one row.

    ``folded`` compares text trimmed and without regard to case; otherwise cells must be equal.
    """
    parts = [digest_part(col(f.name), f.dataType, folded) for f in data.fields]
    groups = data.frame.groupBy(row_digest(parts).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
    )


def dataset_profile(data: Dataset, profile_rows: DataFrame) -> DataFrame:
    """One row about the whole table: its size, its gaps and its raw repeated rows."""
    return dataset_totals(profile_rows).crossJoin(F.broadcast(duplicate_rows(data)))


# ------------------------------------------------------------------ value-level measures


def _weighted(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def measures(values: DataFrame, as_of: date) -> DataFrame:
    """Sums over the value-frequency table, one row per column position."""
    n, mask, number, moment = F.col("n"), F.col("mask"), F.col("number"), F.col("moment")
    present, given = F.col("present"), F.col("given")
    dated, numeric, token = mask != 0, number.isNotNull(), F.col("token")
    whole = (F.rint(number) == number) & (F.abs(number) < F.lit(float("inf")))
    lost, repairable = F.col("lost"), F.col("repairable")
    return values.groupBy("pos").agg(
        F.sum("n").alias("row_count"),
        _weighted(~present).alias("missing_count"),
        _weighted(given).alias("given_count"),
        F.count_if(present).alias("distinct_raw"),
        F.min(F.when(given, F.col("size"))).alias("min_length"),
        F.max(F.when(given, F.col("size"))).alias("max_length"),
        F.sum(F.when(given, F.col("size") * n)).alias("total_length"),
        F.max("tsize").alias("max_trimmed"),
        F.max(F.when(present, F.col("tsize"))).alias("longest"),
        _weighted(F.col("blank")).alias("blank_count"),
        _weighted(F.col("padded")).alias("padded_count"),
        _weighted(F.col("padded") & present).alias("padded_present"),
        _weighted(F.col("email")).alias("email_count"),
        _weighted(F.col("at")).alias("at_count"),
        _weighted(token).alias("token_count"),
        _weighted(dated).alias("date_count"),
        F.coalesce(F.bit_or(F.when(dated, mask)), F.lit(0)).alias("any_format"),
        F.coalesce(F.bit_and(F.when(dated, mask)), F.lit(ALL_FORMATS)).alias("every_format"),
        F.array(*[_weighted(mask.bitwiseAND(1 << bit) != 0) for bit in range(len(DATE_FORMATS))]).alias("format_counts"),
        _weighted(numeric).alias("number_count"),
        F.coalesce(F.bool_and(F.when(numeric, whole)), F.lit(False)).alias("all_whole"),
        _weighted(numeric & ~F.col("plain")).alias("decorated_count"),
        F.min("number").alias("min_number"),
        F.max("number").alias("max_number"),
        F.sum(number * n).alias("total_number"),
        _weighted(number == 0).alias("zero_count"),
        _weighted(number < 0).alias("negative_count"),
        _weighted((number < 0) | (number > 120)).alias("implausible_age_count"),
        F.min("moment").alias("min_moment"),
        F.max("moment").alias("max_moment"),
        _weighted(moment > F.lit(as_of).cast("timestamp_ntz")).alias("future_count"),
        _weighted(lost).alias("lost_count"),
        _weighted(repairable).alias("repairable_count"),
        _weighted(present & dated & ~numeric).alias("kind_dates"),
        _weighted(present & token & ~numeric & ~dated).alias("kind_booleans"),
        F.bool_or("is_long").alias("has_long"),
    )


def with_means(counts: dict[int, dict]) -> dict[int, dict]:
    """Measures by position with the mean of the numbers of each column."""
    return {
        pos: {**row, "mean": row["total_number"] / row["number_count"] if row["number_count"] else None} for pos, row in counts.items()
    }


def squared_distances(numbers: DataFrame, facts: list[dict]) -> DataFrame:
    """``pos, squares``: the sum of squared distances from the mean.

    Means are taken first and squared differences second; a single pass over squares loses
    precision when the mean is large.
    """
    known = beside_facts(numbers.filter("number IS NOT NULL"), facts, ["mean"], _SPREAD)
    return known.groupBy("pos").agg(F.sum(F.pow(F.col("number") - F.col("mean"), 2) * F.col("n")).alias("squares"))


def std_dev(squares: float | None, number_count: int) -> float | None:
    """The sample standard deviation."""
    return math.sqrt(squares / (number_count - 1)) if squares is not None and number_count > 1 else None


def extremes(numbers: DataFrame, facts: list[dict], sigma: float = 5.0) -> DataFrame:
    """``pos, extreme_count``: rows far from the mean."""
    known = beside_facts(numbers.filter("number IS NOT NULL"), facts, ["mean", "std_dev"], _SPREAD)
    far = F.try_divide(F.abs(F.col("number") - F.col("mean")), F.col("std_dev")) > sigma
    return known.groupBy("pos").agg(F.coalesce(F.sum(F.when(far, F.col("n"))), F.lit(0)).alias("extreme_count"))


_SPREAD = T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("std_dev", T.DoubleType())])


def medians(values: DataFrame, measured: DataFrame, window: int = MEDIAN_WINDOW, sliced: Iterable[int] = ()) -> DataFrame:
    """Exact median per numeric column, without sorting a whole column in one task.

    Columns with more than ``window`` distinct numbers, and those of ``sliced``, are narrowed first,
    all of them together: in a round approximate quantiles cut the ranges, exact counts pick the slice
    that holds the middle of each, and slices shrink about fifty-fold. Only the last slices are ranked.
    """
    numbers = values.filter("number IS NOT NULL").select("pos", "number", "n")
    sizes = {
        row.pos: row
        for row in measured.filter("number_count > 0").select("pos", "number_count", "distinct_raw").collect()
    }
    large = {pos: row.number_count for pos, row in sizes.items() if row.distinct_raw > window or pos in set(sliced)}
    small = [pos for pos in sizes if pos not in large]
    direct = numbers.filter(F.col("pos").isin(small)).groupBy("pos").agg(
        F.percentile("number", F.lit(0.5), F.col("n")).alias("median")
    )
    if not large:
        return direct
    slices = _narrowed(numbers, large, min(window, SLICE))
    inside = _inside(numbers, slices)
    merged = inside.groupBy("pos", "number", "below", "total").agg(F.sum("n").alias("n"))
    reached = F.col("below") + F.sum("n").over(Window.partitionBy("pos").orderBy("number"))
    total = F.col("total")
    ranked = (
        merged.withColumn("reached", reached)
        .groupBy("pos")
        .agg(
            F.min(F.when(F.col("reached") * 2 >= total, F.col("number"))).alias("lower"),
            F.min(F.when(F.col("reached") * 2 > total, F.col("number"))).alias("upper"),
        )
        .select("pos", ((F.col("lower") + F.col("upper")) / 2).alias("median"))
    )
    return direct.unionByName(ranked)


@dataclass(frozen=True)
class _Slice:
    """Numbers from ``low`` up to but without ``high`` of a column, and the rows below them."""

    total: int
    low: float | None = None
    high: float | None = None
    below: int = 0


_SLICES = T.StructType(
    [T.StructField("pos", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()),
     T.StructField("below", T.LongType()), T.StructField("total", T.LongType()), T.StructField("cuts", T.ArrayType(T.DoubleType()))]
)


def _inside(numbers: DataFrame, slices: dict[int, _Slice], cuts: dict[int, list[float]] | None = None) -> DataFrame:
    """The numbers that lie in the slice of their column."""
    rows = [{"pos": pos, **vars(each), "cuts": (cuts or {}).get(pos)} for pos, each in slices.items()]
    table = F.broadcast(small_table(numbers.sparkSession, rows, _SLICES))
    return numbers.join(table, "pos").filter(
        (F.col("low").isNull() | (F.col("number") >= F.col("low"))) & (F.col("high").isNull() | (F.col("number") < F.col("high")))
    )


def _narrowed(numbers: DataFrame, totals: dict[int, int], window: int) -> dict[int, _Slice]:
    """For every column a slice around its middle that holds ``window`` rows at most, or cannot be cut."""
    slices = {pos: _Slice(total) for pos, total in totals.items()}
    open_, rows = dict(slices), dict.fromkeys(totals)
    while open_:
        quantiles = _inside(numbers, open_).groupBy("pos").agg(F.percentile_approx("number", _SHARES, 10_000).alias("cuts"))
        cuts = {row.pos: sorted(set(row.cuts) - {slices[row.pos].low}) for row in quantiles.collect()}
        many = max(map(len, cuts.values()), default=0)
        at = [F.try_element_at("cuts", F.lit(i + 1)) for i in range(many)]
        counted = _inside(numbers, open_, cuts).groupBy("pos").agg(
            F.array(*[F.coalesce(F.sum(F.when(F.col("number") < cut, F.col("n"))), F.lit(0)) for cut in at]).cast("array<bigint>").alias("weights"),
            F.array(*[F.count_if(F.col("number") < cut) for cut in at]).cast("array<bigint>").alias("counts"),
            F.count(F.lit(1)).alias("rows"),
        )
        going = {}
        for row in counted.collect():
            known, own = slices[row.pos], cuts[row.pos]
            # The slice must hold both middle ranks of an even count.
            left = max((i for i in range(len(own)) if known.below + row.weights[i] <= (known.total - 1) // 2), default=None)
            right = min((i for i in range(len(own)) if known.below + row.weights[i] > known.total // 2), default=None)
            inner = (row.counts[right] if right is not None else row.rows) - (row.counts[left] if left is not None else 0)
            slices[row.pos] = replace(
                known,
                low=own[left] if left is not None else known.low,
                high=own[right] if right is not None else known.high,
                below=known.below + (row.weights[left] if left is not None else 0),
            )
            if inner > window and (rows[row.pos] is None or inner < rows[row.pos]):
                going[row.pos] = slices[row.pos]
            rows[row.pos] = inner
        open_ = going
    return slices


def top_values(shown: DataFrame, limit: int = TOP_VALUES) -> DataFrame:
    """The most frequent values per column, ties by value: ``pos, top_values``.

    ``shown`` holds ``pos, shown, n, first_row`` with one row per distinct value; long values
    stand there in their short form.
    """
    ranked = first_per_group(shown, ["pos"], [F.desc("n"), F.asc("shown")], limit)
    entry = F.struct("__rank", F.col("shown").alias("value"), F.col("n").alias("count"))
    listed = F.transform(
        F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count"))
    )
    return ranked.groupBy("pos").agg(listed.alias("top_values"))


def sample_values(values: DataFrame, limit: int = SAMPLE_VALUES) -> DataFrame:
    """The first distinct values in row order: ``pos, sample_values``."""
    raw = values.filter("present").select("pos", F.coalesce("s", "shown").alias("shown"), "first_row")
    ranked = first_per_group(raw, ["pos"], [F.asc("first_row"), F.asc("shown")], limit)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__rank", "shown"))), lambda e: e["shown"])
    return ranked.groupBy("pos").agg(listed.alias("sample_values"))


# ------------------------------------------------------------------ type inference


def semantic_type(facts: DataFrame) -> DataFrame:
    """Add ``semantic_type`` and ``confidence``: the first rule that fits, most specific first.

    Every value votes. Shares are taken over given values, blank text included.
    """
    total = F.nullif(F.col("given_count"), F.lit(0)).cast("double")
    share = lambda name: F.coalesce(F.try_divide(F.col(name), total), F.lit(0.0))
    kind, email, dates, numbers = F.col("kind"), share("email_count"), share("date_count"), share("number_count")
    distinct = F.coalesce(F.col("distinct_text"), F.lit(0)) + F.when(F.col("blank_count") > 0, 1).otherwise(0)
    unique = F.coalesce(F.try_divide(distinct, total), F.lit(0.0))
    rules = [
        (kind == "boolean", "boolean", F.lit(1.0)),
        (kind == "date", "date", F.lit(1.0)),
        (kind == "datetime", "datetime", F.lit(1.0)),
        (kind == "integer", "integer", F.lit(1.0)),
        (kind.isin("float", "decimal"), "float", F.lit(1.0)),
        (F.col("given_count") == 0, "empty", F.lit(1.0)),
        (kind == "other", "unknown", F.lit(0.0)),
        (
            (email >= 0.6) | ((share("at_count") >= 0.8) & (email >= 0.3)),
            "email",
            F.greatest(email, F.lit(0.6)),
        ),
        (share("token_count") >= 0.9, "boolean", share("token_count")),
        (
            dates >= F.when(F.col("temporal_name"), 0.4).otherwise(0.7),
            F.when(F.col("any_format").bitwiseAND(TIMED_FORMATS) != 0, "datetime").otherwise("date"),
            dates,
        ),
        (numbers >= 0.7, F.when(F.col("all_whole"), "integer").otherwise("float"), numbers),
        (
            (unique > 0.95) & (F.col("max_trimmed") <= 40) & (numbers < 0.5) & (dates < 0.5)
            & (F.col("identifier_name") | ((unique == 1.0) & (total >= 20))),
            "identifier",
            unique,
        ),
        (
            (F.col("max_trimmed") <= 60) & ((distinct <= 50) | (unique <= 0.25)),
            "categorical",
            1.0 - unique,
        ),
    ]
    chosen, confidence = F.lit("text"), F.lit(0.5)
    for fits, name, certainty in reversed(rules):
        chosen = F.when(fits, name).otherwise(chosen)
        confidence = F.when(fits, certainty).otherwise(confidence)
    return facts.withColumns({"semantic_type": chosen, "confidence": F.round(confidence, 4)})


def typed_facts(joined: DataFrame) -> DataFrame:
    """The measures of each column, one row a column, with the inferred type."""
    unique = F.when(F.col("kind") == "text", F.coalesce("distinct_text", F.lit(0))).when(
        F.col("kind") != "other", F.col("distinct_raw")
    )
    counted = joined.withColumns(
        {
            "unique_count": unique,
            "present_count": F.col("row_count") - F.col("missing_count"),
            "kind_numbers": F.col("number_count"),
            "kind_text": F.col("row_count") - F.col("missing_count") - F.col("number_count")
            - F.col("kind_dates") - F.col("kind_booleans"),
        }
    )
    typed = semantic_type(counted)
    kind = F.col("semantic_type")
    return typed.withColumns(
        {
            "is_numeric": kind.isin("integer", "float"),
            "is_temporal": kind.isin("date", "datetime"),
            "is_text": F.col("kind") == "text",
        }
    )


def profiles(facts: DataFrame) -> DataFrame:
    """The profile table: one row per column in table order.

    ``facts`` has, beside the typed facts, ``median``, ``top_values`` and ``sample_values``.
    """
    numeric = F.col("is_numeric") | (
        ~F.col("semantic_type").isin("empty", "date", "datetime")
        & (F.col("number_count") >= 0.5 * F.col("present_count"))
        & (F.col("present_count") > 0)
    )
    numbers = F.struct(
        F.col("min_number").alias("minimum"),
        F.col("max_number").alias("maximum"),
        F.col("mean"),
        F.col("median"),
        F.when(F.col("number_count") > 1, F.col("std_dev")).when(F.col("number_count") == 1, 0.0).alias("std_dev"),
        F.col("zero_count"),
        F.col("negative_count"),
    )
    texts = F.struct(
        F.coalesce("min_length", F.lit(0)).alias("min_length"),
        F.coalesce("max_length", F.lit(0)).alias("max_length"),
        F.round(F.coalesce(F.try_divide(F.col("total_length"), F.col("given_count")), F.lit(0.0)), 2).alias("mean_length"),
        F.col("padded_count"),
        F.col("blank_count"),
    )
    native = F.col("kind").isin("date", "datetime")
    dates = F.struct(
        F.date_format("min_moment", "yyyy-MM-dd").alias("minimum"),
        F.date_format("max_moment", "yyyy-MM-dd").alias("maximum"),
        F.when(native, F.array(F.lit("native"))).otherwise(format_labels(F.col("any_format"))).alias("formats"),
        F.when(native, F.lit(0)).otherwise(F.col("given_count") - F.col("date_count")).alias("unparseable_count"),
    )
    return facts.select(
        F.col("column"),
        F.col("pos").alias("position"),
        "data_type",
        "semantic_type",
        "confidence",
        "row_count",
        "missing_count",
        "unique_count",
        F.when(numeric, numbers).alias("numeric"),
        F.when(F.col("is_temporal"), dates).alias("temporal"),
        F.when(~F.col("is_numeric") & ~F.col("is_temporal"), texts).alias("text"),
        F.coalesce("top_values", F.array().cast("array<struct<value:string,count:bigint>>")).alias("top_values"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )


def dataset_totals(profile_rows: DataFrame) -> DataFrame:
    """Cells, missing cells and their share over a profile table."""
    totals = profile_rows.agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.sum("row_count").alias("total_cells"),
        F.sum("missing_count").alias("missing_cells"),
    )
    ratio = F.when(F.col("total_cells") > 0, F.col("missing_cells") / F.col("total_cells")).otherwise(0.0)
    return totals.withColumn("missing_ratio", ratio)
