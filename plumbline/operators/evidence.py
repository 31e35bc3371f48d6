"""The first rows behind each column finding."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.dates import with_dates
from plumbline.functions.numbers import with_number
from plumbline.operators.checks import SIGMA, VARIANTS, spelling_variants
from plumbline.operators.dataset import ROW_ID, Dataset, col, first_per_group
from plumbline.operators.findings import EVIDENCE_ROWS, FINDING_COLUMNS
from plumbline.operators.frequency import folded_form, short_form, text_cells

_NEEDS_NUMBER = {"impossible_numeric", "suspicious_numeric"}
_NEEDS_DATE = {"invalid_date", "future_date"}


def attach_rows(review, findings: DataFrame, limit: int = EVIDENCE_ROWS) -> DataFrame:
    """Fill ``row_ids`` of column findings with the lowest ids of the rows at fault.

    One pass over the table tests only the columns that have a finding, with the predicate
    of that finding. Rows of spelling variants are found by a join with the groups that start
    first: every row before the wanted ones starts a group or belongs to one that started earlier,
    so no more groups than rows are needed, however many there are.
    """
    data, facts, as_of = review.data, review.fact_rows, review.as_of
    by_column = {fact["column"]: fact for fact in facts}
    fired = [
        (row.check_id, row.column)
        for row in findings.filter("column IS NOT NULL").select("check_id", "column").distinct().collect()
        if row.column in by_column
    ]
    flags, df = [], data.frame
    for check, name in fired:
        position = data.columns.index(name)
        text = tx.is_text(data.type_of(name))
        if check in _NEEDS_NUMBER and f"number_{position}" not in df.columns:
            out = f"number_{position}"
            df = with_number(df, col(name), out) if text else df.withColumn(out, col(name).cast("double"))
        if check in _NEEDS_DATE and f"moment_{position}" not in df.columns:
            out = f"moment_{position}"
            if text:
                df = with_dates(df, col(name), "__mask", out).drop("__mask")
            else:
                df = df.withColumn(out, col(name).cast("timestamp_ntz"))
        hit = _predicate(check, data, name, by_column[name], as_of)
        if hit is not None:
            flags.append(F.when(hit, F.struct(F.lit(check).alias("check_id"), F.lit(name).alias("column"))))
    parts = [df.select(ROW_ID, F.inline(F.array_compact(F.array(*flags))))] if flags else []
    parts += [_variant_rows(review, check, names, limit) for check in _VARIANTS if (names := [n for c, n in fired if c == check])]
    if not parts:
        return findings
    hits = reduce(DataFrame.unionByName, parts)
    ranked = first_per_group(hits, ["check_id", "column"], [F.asc(ROW_ID)], limit)
    rows = ranked.groupBy("check_id", "column").agg(F.array_sort(F.collect_list(ROW_ID)).alias("ids"))
    return (
        findings.join(F.broadcast(rows), ["check_id", "column"], "left")
        .withColumn("row_ids", F.coalesce("ids", "row_ids"))
        .select(*FINDING_COLUMNS)
    )


def filler_rows(value: Column, fact) -> Column:
    """Whether a cell is one of its column's placeholders."""
    trimmed = tx.trim(value)
    key = tx.squash(value)
    short = F.length(key) <= tx.SHORT_TOKEN
    word = key.isin(*tx.FILLER_WORDS) & (~short | F.lit((fact["longest"] or 0) > tx.SHORT_TOKEN))
    dash = (key == "") & (trimmed != "") & (F.length(trimmed) <= tx.SHORT_TOKEN)
    # A repeated filler covers a hundredth of the rows, so there are a hundred at most.
    repeated = fact["repeated_fillers"] or []
    return word | dash | (folded_form(value).isin(*repeated) if repeated else F.lit(False))


#: Check -> the kind of spelling variants it looks for.
_VARIANTS = {"inconsistent_category": "category", "inconsistent_capitalization": "case"}


def _variant_rows(review, check: str, names: list[str], limit: int) -> DataFrame:
    """Rows whose value belongs to a group of spelling variants: row id, check and column."""
    data, (_, key, compared) = review.data, VARIANTS[_VARIANTS[check]]
    positions = {data.columns.index(name): name for name in names}
    variants = spelling_variants(review.trimmed, list(positions), key, compared)
    groups = F.broadcast(first_per_group(variants, ["pos"], [F.asc("first_row"), F.asc("name")], limit).select("pos", "name"))
    value = F.col("s")
    name = folded_form(value) if key == "fold" else short_form(tx.squash(value))
    cells = text_cells(data, list(positions)).withColumn("name", name)
    column = F.element_at(F.create_map(*[F.lit(each) for pair in positions.items() for each in pair]), F.col("pos"))
    return cells.join(groups, ["pos", "name"], "left_semi").select(ROW_ID, F.lit(check).alias("check_id"), column.alias("column"))


def _predicate(check: str, data: Dataset, name: str, fact, as_of: date) -> Column | None:
    value, data_type = col(name), data.type_of(name)
    position = data.columns.index(name)
    number, moment = F.col(f"number_{position}"), F.col(f"moment_{position}")
    present = ~tx.missing(value, data_type)
    if check == "missing_values":
        return ~present
    if check == "placeholder_values":
        return present & filler_rows(value, fact)
    if check == "invalid_date":
        return present & moment.isNull()
    if check == "invalid_email":
        return present & ~tx.is_email(value)
    if check == "impossible_numeric":
        return (number < 0) | (number > 120) if fact["age_name"] else number < 0
    if check == "suspicious_numeric":
        return F.abs(number - F.lit(fact["mean"])) / F.lit(fact["std_dev"]) > SIGMA
    if check == "future_date":
        return moment > F.lit(as_of).cast("timestamp_ntz")
    if check == "leading_trailing_whitespace":
        return present & (tx.trim(value) != value)
    if check == "corrupted_encoding":
        return tx.has_lost_characters(value) | tx.repair_encoding(value).isNotNull()
    # The remaining checks judge a column as a whole, or are answered by :func:`_variant_rows`.
    return None
