"""Approved corrections applied to the data, in a fixed order.

Column corrections become projections over the rows, so any number of them costs one pass.
Value mappings and lookups are joins; only removing duplicate rows groups the table.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as tx
from plumbline.functions.dates import with_dates
from plumbline.functions.numbers import with_number
from plumbline.operators.dataset import (
    ROW_ID,
    Dataset,
    col,
    digest_part,
    first_per_group,
    lookup,
    materialise,
    row_digest,
    small_table,
)
from plumbline.operators.evidence import filler_rows
from plumbline.operators.frequency import short_form
from plumbline.operators.isolation import reason, surviving
from plumbline.operators.propose import LIST_MARK, Proposals

log = logging.getLogger(__name__)

# The order of the corrections. Later steps see what earlier ones did; removing rows comes last.
APPLICATION_ORDER = (
    "repair_encoding",
    "strip_whitespace",
    "normalize_case",
    "map_category",
    "cast_to_numeric",
    "parse_dates",
    "clear_invalid_values",
    "clip_to_range",
    "fill_from_related",
    "fill_missing",
    "drop_duplicate_rows",
)
PREVIEW_ROWS = 10
APPLIED_SCHEMA = T.StructType(
    [
        T.StructField("proposal_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("rows_changed", T.LongType()),
        T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
    ]
)


class CorrectionError(ValueError):
    """A correction does not fit the table."""


@dataclass(frozen=True)
class Cleaned:
    """The corrected table and the changes that were really made."""

    data: Dataset
    applied: DataFrame
    rows_removed: int
    cells_changed: int


def approved_in_order(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approved, applicable proposals in the order they are applied."""
    order = F.array_position(F.array(*map(F.lit, APPLICATION_ORDER)), F.col("action"))
    return (
        proposals.join(decisions.filter("status = 'approved'").select("proposal_id").distinct(), "proposal_id")
        .withColumn("step", order)
        .filter("step > 0")
        .orderBy("step", F.coalesce("column", F.lit("")), "proposal_id")
    )


def with_correction(
    df: DataFrame, data: Dataset, action: str, name: str, parameters: dict[str, str], mapping: DataFrame | None, out: str
) -> DataFrame:
    """``df`` plus column ``out``: the corrected content of column ``name``.

    ``df`` holds the columns of ``data`` and possibly more.
    """
    if name not in data.columns:
        raise CorrectionError(f"Column '{name}' is not in the table.")
    data_type = data.type_of(name)
    text = col(name).cast("string")
    if action == "repair_encoding":
        after = F.coalesce(tx.repair_encoding(text), text)
    elif action == "strip_whitespace":
        after = tx.trim(text)
    elif action in ("normalize_case", "map_category"):
        df = _joined(df, short_form(text), mapping)
        after = F.coalesce("__to", text)
    elif action == "cast_to_numeric":
        df, after = _as_number(df, name, data_type)
    elif action == "clip_to_range":
        df, after = _as_number(df, name, data_type)
        if parameters.get("minimum") is not None:
            after = F.when(after < float(parameters["minimum"]), float(parameters["minimum"])).otherwise(after)
        if parameters.get("maximum") is not None:
            after = F.when(after > float(parameters["maximum"]), float(parameters["maximum"])).otherwise(after)
    elif action == "parse_dates":
        df, moment = _as_moment(df, name, data_type)
        after = F.date_format(moment, parameters.get("output_format", "yyyy-MM-dd"))
    elif action == "clear_invalid_values":
        df, invalid = _invalid(df, name, data_type, parameters)
        after = F.when(~F.coalesce(invalid, F.lit(False)), text)
    elif action == "fill_missing":
        if "value" not in parameters:
            raise CorrectionError("The proposal carries no fill value.")
        after = F.when(tx.missing(col(name), data_type), F.lit(parameters["value"])).otherwise(text)
    elif action == "fill_from_related":
        determinant = parameters.get("determinant", "")
        if determinant not in data.columns:
            raise CorrectionError(f"The determining column '{determinant}' is not in the table.")
        df = _joined(df, tx.normalised_text(col(determinant), data.type_of(determinant)), mapping)
        after = F.when(tx.missing(col(name), data_type) & F.col("__to").isNotNull(), F.col("__to")).otherwise(text)
    else:
        raise CorrectionError(f"Unknown action '{action}'.")
    return df.withColumn(out, after).drop("__from", "__to", "__number", "__mask", "__moment")


def _joined(df: DataFrame, key: Column, mapping: DataFrame | None) -> DataFrame:
    if mapping is None:
        raise CorrectionError("The proposal carries no value mapping.")
    pairs = mapping.select(F.col("from_value").alias("__from"), F.col("to_value").alias("__to"))
    # A null key finds nothing; with a number of its own, each goes where it likes.
    apart = F.when(key.isNull(), F.col(ROW_ID))
    return df.withColumns({"__key": key, "__apart": apart}).join(
        lookup(pairs).withColumn("__none", F.lit(None).cast("bigint")), (F.col("__key") == F.col("__from")) & F.col("__apart").eqNullSafe(F.col("__none")), "left"
    ).drop("__key", "__apart", "__none")


def _as_number(df: DataFrame, name: str, data_type: T.DataType) -> tuple[DataFrame, Column]:
    if tx.is_text(data_type):
        return with_number(df, col(name), "__number"), F.col("__number")
    return df, col(name).cast("double")


def _as_moment(df: DataFrame, name: str, data_type: T.DataType) -> tuple[DataFrame, Column]:
    if tx.is_text(data_type):
        return with_dates(df, col(name), "__mask", "__moment"), F.col("__moment")
    return df, col(name).cast("timestamp_ntz")


def _invalid(df: DataFrame, name: str, data_type: T.DataType, parameters: dict[str, str]) -> tuple[DataFrame, Column]:
    predicate = parameters.get("predicate")
    present = ~tx.missing(col(name), data_type)
    if predicate == "invalid_email":
        # Blank cells become empty as well: they are no address either.
        return df, ~tx.is_email(col(name))
    if predicate == "invalid_date":
        df, moment = _as_moment(df, name, data_type)
        return df, present & moment.isNull()
    if predicate == "placeholder_value":
        repeated = [value for value in parameters.get("repeated", "").split(LIST_MARK) if value]
        fact = {"longest": int(parameters.get("longest", 0)), "repeated_fillers": repeated}
        return df, present & filler_rows(col(name), fact)
    raise CorrectionError(f"Unknown predicate '{predicate}'.")


def changed(before: Column, after: Column) -> Column:
    return ~before.cast("string").eqNullSafe(after.cast("string"))


def repeated_rows(data: Dataset) -> DataFrame:
    """Digests of rows that occur more than once: ``__digest``, their number and the first row id."""
    digest = row_digest([digest_part(col(f.name), f.dataType, True) for f in data.fields])
    groups = data.frame.select(ROW_ID, digest.alias("__digest")).groupBy("__digest")
    return materialise(groups.agg(F.count(F.lit(1)).alias("__n"), F.min(ROW_ID).alias("__kept")).filter("__n > 1"))


def without_repeats(data: Dataset, repeated: DataFrame | None = None) -> DataFrame:
    """The table without rows that repeat an earlier one, text compared trimmed and folded.

    Exactly one row of each group stays, even where row ids repeat. Only digests that really
    repeat are joined back. When they are few the join is a broadcast and no other row is
    shuffled.
    """
    repeated = repeated_rows(data) if repeated is None else repeated
    digest = row_digest([digest_part(col(f.name), f.dataType, True) for f in data.fields])
    keyed = data.frame.withColumn("__digest", digest).join(lookup(repeated.select("__digest", "__kept")), "__digest", "left")
    alone = keyed.filter(F.col("__kept").isNull())
    first = keyed.filter(F.col("__kept") == F.col(ROW_ID)).dropDuplicates(["__digest"])
    return alone.unionByName(first).select(*map(col, data.frame.columns))


def apply_corrections(data: Dataset, proposals: Proposals, decisions: DataFrame) -> Cleaned:
    """Apply what was approved and count what changed.

    The counts come from one aggregate over the corrected rows, however many corrections
    there are. A correction that does not fit the table, or fails while it runs, is skipped and
    the others are made; one that changes nothing is not recorded.
    """
    chosen = [row.asDict() for row in approved_in_order(proposals.table, decisions).collect()]
    on_cells = [offer for offer in chosen if offer["action"] != "drop_duplicate_rows"]
    attempted: dict[tuple[str, ...], tuple[DataFrame, dict[str, int]]] = {}

    def attempt(offers: Sequence[dict]) -> None:
        attempted[tuple(offer["proposal_id"] for offer in offers)] = _corrected(data, proposals, offers)

    kept, refused = surviving(on_cells, attempt)
    if len(refused) > 1 and not kept and not any(isinstance(error, CorrectionError) for _, error in refused):
        raise refused[0][1]  # the fault is not theirs
    for offer, error in refused:
        log.error("Correction %s skipped: %s", offer["proposal_id"], reason(error))
    key = tuple(offer["proposal_id"] for offer in kept)
    if key not in attempted:
        attempt(kept)
    corrected, counted = attempted[key]
    offers = dict(zip(counted, kept, strict=True))
    applied = [{**offer, "rows_changed": counted[flag]} for flag, offer in offers.items() if counted[flag]]
    result = data.with_frame(corrected.select(*map(col, data.frame.columns)))

    removed = 0
    for offer in chosen:
        if offer["action"] == "drop_duplicate_rows":
            repeated = repeated_rows(result)
            removed = repeated.agg(F.sum(F.col("__n") - 1)).first()[0] or 0
            if removed:
                applied.append({**offer, "rows_changed": removed})
                result = data.with_frame(materialise(without_repeats(result, repeated)))
    rows = [{name: row[name] for name in APPLIED_SCHEMA.names} for row in applied]
    return Cleaned(result, small_table(data.spark, rows, APPLIED_SCHEMA), removed, sum(r["rows_changed"] for r in rows))


_FLAG = "__changed_"


def _corrected(data: Dataset, proposals: Proposals, offers: Sequence[dict]) -> tuple[DataFrame, dict[str, int]]:
    """The rows after some corrections of cells, with a change flag for each, and how many cells each changed.

    They are computed here: counts, duplicate removal and the new analysis all read them.
    """
    current, flags = data, []
    for offer in offers:
        name, mapping = offer["column"], mapping_of(proposals, offer)
        df = with_correction(
            current.frame, current, offer["action"], name, offer["parameters"] or {}, mapping, "__after"
        )
        flags.append(f"{_FLAG}{len(flags)}")
        df = df.withColumn(flags[-1], changed(col(name), F.col("__after")))
        kept = [F.col("__after").alias(name) if column == name else col(column) for column in data.frame.columns]
        current = _Stepped(df.select(*kept, *flags), data.name)
    if not flags:
        return current.frame, {}
    corrected = materialise(current.frame)
    return corrected, corrected.agg(*[F.count_if(flag).alias(flag) for flag in flags]).first().asDict()


class _Stepped(Dataset):
    """A dataset that carries a change flag per correction beside its columns."""

    @property
    def fields(self):
        return [f for f in super().fields if not f.name.startswith(_FLAG)]


def corrected_values(values: DataFrame, name: str, data_type: T.DataType, proposals: Proposals, offers: Sequence[dict]) -> tuple[DataFrame, T.DataType]:
    """Weighted values of one column after its corrections, and the type they have then.

    ``values`` has the column ``name``, ``n`` and a row id. Each offer must depend on the column alone.
    """
    current = Dataset(values.select(ROW_ID, col(name), "n"))
    for offer in offers:
        df = with_correction(current.frame, current, offer["action"], name, offer["parameters"] or {}, mapping_of(proposals, offer), "__after")
        current = Dataset(df.select(ROW_ID, F.col("__after").alias(name), "n"))
    return current.frame, current.type_of(name)


def mapping_of(proposals: Proposals, offer: dict) -> DataFrame | None:
    """The value mapping a proposal carries, if its action needs one."""
    if offer["action"] not in ("normalize_case", "map_category", "fill_from_related"):
        return None
    return proposals.mappings.filter(F.col("proposal_id") == offer["proposal_id"])


def previews(data: Dataset, proposals: Proposals, limit: int = PREVIEW_ROWS) -> DataFrame:
    """The first cells each column correction would change, from one pass over the table.

    One row per proposal: ``proposal_id`` and ``preview``, an array of ``row_id, column,
    before, after``.
    """
    offers = [
        row.asDict()
        for row in proposals.table.filter(F.col("column").isNotNull()).collect()
        if row.action in APPLICATION_ORDER and row["column"] in data.columns
    ]
    df, flags = data.frame, []
    for position, offer in enumerate(offers):
        name, after = offer["column"], f"__after_{position}"
        df = with_correction(
            df, data, offer["action"], name, offer["parameters"] or {}, mapping_of(proposals, offer), after
        )
        cell = F.struct(
            F.lit(offer["proposal_id"]).alias("proposal_id"),
            F.col(ROW_ID).alias("row_id"),
            F.lit(name).alias("column"),
            tx.render(col(name)).alias("before"),
            tx.render(F.col(after)).alias("after"),
        )
        # A gap rendered the same way before and after is no change worth showing.
        shown = F.coalesce(col(name).cast("string"), F.lit("")) != F.coalesce(F.col(after).cast("string"), F.lit(""))
        flags.append(F.when(shown, cell))
    if not flags:
        return data.spark.createDataFrame([], "proposal_id string, preview array<struct<row_id:bigint>>")
    cells = df.select(F.inline(F.array_compact(F.array(*flags))))
    ranked = first_per_group(cells, ["proposal_id"], [F.asc("row_id")], limit)
    return ranked.groupBy("proposal_id").agg(
        F.array_sort(F.collect_list(F.struct("row_id", "column", "before", "after"))).alias("preview")
    )
