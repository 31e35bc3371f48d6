"""The value-frequency table: each distinct value of each column, once, with its count.

Nearly every judgement about a column depends on the value alone. Judging a distinct value
and weighting it by its count costs one shuffle of map-side combined rows, and a value that
fills a third of the table arrives as one row per map task.

Of a column whose values are nearly all distinct such a table would be as long as the column and
several times as wide. A cardinality sketch finds these columns before anything is grouped. Their
cells are judged where they are read, distinct values are counted by grouping them without their
judgements, and only the values that something is said about are kept (:func:`frequencies`).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as tx
from plumbline.functions.dates import date_steps
from plumbline.functions.numbers import number_steps
from plumbline.functions.steps import Steps, read_with, side_by_side
from plumbline.operators.dataset import ROW_ID, Dataset, col, first_per_group, lookup, materialise, small_table, spread

#: Text longer than this travels in a short form plus the judgements made on the whole text.
LONG_TEXT = 256
#: Characters that the short form shows; a digest of the whole text follows them.
SHOWN_OF_LONG = 200
#: Columns with fewer distinct values are always counted in full.
NEAR_UNIQUE = 20_000
#: Distinct values for each row from which a column counts as nearly unique. Text above its share cannot
#: be categorical, whatever the error of the sketch.
NATIVE_SHARE, TEXT_SHARE = 0.1, 0.3
#: Most frequent and first values that are kept of a nearly unique column.
KEPT_TOP, KEPT_FIRST = 10, 5

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_MOMENT = (T.DateType, T.TimestampType, T.TimestampNTZType)

#: Judgements on one text value, in the order they are packed for long text.
_JUDGEMENT_TYPES = {
    "t": "string", "fold": "string", "key": "string", "size": "int", "tsize": "int",
    "padded": "boolean", "blank": "boolean", "mask": "int", "moment": "timestamp_ntz",
    "number": "double", "token": "boolean", "email": "boolean", "at": "boolean",
    "plain": "boolean", "lost": "boolean", "repairable": "boolean", "filler": "boolean",
    "short_filler": "boolean",
}
JUDGEMENTS = tuple(_JUDGEMENT_TYPES)
VALUE_COLUMNS = (
    "pos", "s", "shown", "is_text", "is_long", "given", "present", *JUDGEMENTS, "n", "first_row",
)


def kind_of(data_type: T.DataType) -> str:
    """How a column is treated: text, integer, float, decimal, boolean, date, datetime, other."""
    if tx.is_text(data_type):
        return "text"
    if isinstance(data_type, _INTEGRAL):
        return "integer"
    if tx.is_floating(data_type):
        return "float"
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, _MOMENT):
        return "datetime"
    return "other"


def _slot(value: Column, kind: str) -> tuple[str, Column]:
    """The typed slot a native value travels in: integer, double, decimal text or timestamp."""
    if kind in ("integer", "boolean"):
        return "l", value.cast("bigint")
    if kind == "float":
        return "d", F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    if kind == "decimal":
        return "s", value.cast("string")
    if kind in ("date", "datetime"):
        return "m", value.cast("timestamp_ntz")
    # Nested and binary values are only ever present or absent.
    return "l", F.when(value.isNotNull(), F.lit(1)).cast("bigint")


_SLOT_TYPES = {"s": "string", "l": "bigint", "d": "double", "m": "timestamp_ntz"}


def _unpivot(data: Dataset, slots: dict[int, dict[str, Column]], letters: str) -> DataFrame:
    """One row per cell. UNPIVOT becomes an Expand operator, inside generated code."""
    prepared, groups = [col(ROW_ID)], []
    for position, filled in slots.items():
        for letter in letters:
            value = filled.get(letter, F.lit(None).cast(_SLOT_TYPES[letter]))
            prepared.append(value.alias(f"{letter}{position}"))
        groups.append(f"({', '.join(f'{letter}{position}' for letter in letters)}) AS `{position}`")
    table = data.spark.sql(
        f"SELECT * FROM {{cells}} UNPIVOT INCLUDE NULLS "
        f"(({', '.join(letters)}) FOR pos IN ({', '.join(groups)}))",
        cells=data.frame.select(*prepared),
    )
    return table.withColumn("pos", F.col("pos").cast("int"))


def short_form(text: Column) -> Column:
    """The text itself or, when it is long, its first characters and a digest of all of it.

    Short forms are equal where texts are, so they stand for them in groupings and joins.
    """
    digest = F.concat(F.left(text, F.lit(SHOWN_OF_LONG)), F.lit("… #"), F.md5(text))
    return F.when(F.length(text) <= LONG_TEXT, text).otherwise(digest)


#: What a short form looks like. A text that only looks like one is its own short form.
_SHORTENED = re.compile(rf"(?s).{{{SHOWN_OF_LONG}}}… #[0-9a-f]{{32}}")


def whole_texts(data: Dataset, shown: dict[int, set[str]]) -> dict[tuple[int, str], str]:
    """The texts that short forms stand for, raw or trimmed, by position and form; others are left out.

    ``shown`` has a few values of each column. Only columns that show a short form are read.
    """
    wanted = [{"pos": p, "form": value} for p, values in shown.items() for value in values if _SHORTENED.fullmatch(value)]
    if not wanted:
        return {}
    found: dict[tuple[int, str], str] = {}
    for row in _distinct_wholes(data, wanted).collect():
        found[row.pos, row.form] = min(row.whole, found.get((row.pos, row.form), row.whole))
    return found


def _distinct_wholes(data: Dataset, wanted: list[dict]) -> DataFrame:
    """``pos, form, whole``: the texts behind some short forms, each once.

    Texts are keys of a grouping, which hashes them. The least text of a form, as an aggregate, would sort every cell.
    """
    schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("form", T.StringType())])
    cells = text_cells(data, sorted({row["pos"] for row in wanted})).filter(F.length("s") > SHOWN_OF_LONG)
    texts = cells.select("pos", F.explode(F.array_distinct(F.array("s", tx.trim(F.col("s"))))).alias("whole"))
    named = texts.withColumn("form", short_form(F.col("whole"))).join(F.broadcast(small_table(data.spark, wanted, schema)), ["pos", "form"])
    return named.select("pos", "form", "whole").distinct()


def folded_form(value: Column) -> Column:
    """A raw text as it appears in the ``fold`` column of the frequency table."""
    return short_form(tx.fold(tx.trim(value)))


def judgement_steps(value: Column) -> Steps:
    """Projections for everything the checks ask about one text value."""
    trimmed, folded, squashed = F.col("__t"), F.col("__fold"), F.col("__key")
    is_filler = squashed.isin(*tx.FILLER_WORDS)
    short = F.length(squashed) <= tx.SHORT_TOKEN
    dash = (squashed == "") & (trimmed != "") & (F.length(trimmed) <= tx.SHORT_TOKEN)
    lost = tx.has_lost_characters(value)
    return [
        {"__t": tx.trim(value)},
        *side_by_side(
            number_steps(trimmed),
            date_steps(trimmed),
            [
                {"__fold": tx.fold(trimmed)},
                {"__key": F.regexp_replace(folded, r"[^\p{L}\p{N}]+", "")},
                {
                    "t": short_form(trimmed),
                    "fold": short_form(folded),
                    "key": short_form(squashed),
                    "size": F.length(value),
                    "tsize": F.length(trimmed),
                    "padded": trimmed != value,
                    "blank": trimmed == "",
                    "token": F.lower(trimmed).isin(*tx.TRUE_WORDS, *tx.FALSE_WORDS),
                    "email": tx.is_email(trimmed),
                    "at": trimmed.contains("@"),
                    "plain": tx.is_plain_number(trimmed),
                    "lost": lost,
                    "repairable": ~lost & tx.repair_encoding(value).isNotNull(),
                    "filler": (is_filler & ~short) | dash,
                    "short_filler": is_filler & short,
                },
            ],
        ),
    ]


def with_judgements(df: DataFrame) -> DataFrame:
    """Judge the text in column ``s``."""
    return read_with(df, F.col("s"), judgement_steps)


@dataclass(frozen=True)
class Sketch:
    """What one pass tells of a column: rows, about how many distinct values, the longest text, and the parts that hold rows."""

    rows: int
    distinct: int
    longest: int
    parts: int = 1

    def near_unique(self, kind: str, least: int) -> bool:
        share = TEXT_SHARE if kind == "text" else NATIVE_SHARE
        return self.distinct > least and self.distinct > share * self.rows


def column_sketches(data: Dataset, positions: Iterable[int]) -> dict[int, Sketch]:
    """Sketches of some columns, from one aggregate over the table."""
    kinds = {p: kind_of(data.type_of(data.columns[p])) for p in positions}
    if not kinds:
        return {}
    sums = [F.count(F.lit(1)).alias("rows"), F.size(F.collect_set("__part")).alias("parts")]
    for p, kind in kinds.items():
        if kind != "other":
            sums.append(F.approx_count_distinct(col(data.columns[p])).alias(f"d{p}"))
        if kind == "text":
            sums.append(F.max(F.length(col(data.columns[p]))).alias(f"w{p}"))
    row = data.frame.withColumn("__part", F.spark_partition_id()).agg(*sums).first().asDict()
    return {p: Sketch(row["rows"], row.get(f"d{p}") or 0, row.get(f"w{p}") or 0, row["parts"]) for p in kinds}


def text_cells(data: Dataset, positions: list[int]) -> DataFrame:
    """One row per cell of some text columns: row id, ``pos`` and the text ``s``."""
    return _unpivot(data, {position: {"s": col(data.columns[position])} for position in positions}, "s")


def _text_counts(data: Dataset, positions: list[int], long: bool) -> DataFrame:
    """Distinct texts of some columns: either the long values or all others.

    Short text is counted first and judged once per distinct value. Long text is judged
    where it is read and travels in its short form, so a shuffle never carries whole documents.
    """
    table = text_cells(data, positions)
    table = table.filter(F.length("s") > LONG_TEXT) if long else table.filter(F.col("s").isNull() | (F.length("s") <= LONG_TEXT))
    counts = [F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias("first_row")]
    if long:
        packed = with_judgements(table).select(
            ROW_ID, "pos", short_form(F.col("s")).alias("s"), F.struct(*JUDGEMENTS).alias("j")
        )
        values = packed.groupBy("pos", "s", "j").agg(*counts).select("pos", "s", "n", "first_row", "j.*")
    else:
        values = with_judgements(table.groupBy("pos", "s").agg(*counts))
    return _judged_text(values)


def _judged_text(values: DataFrame) -> DataFrame:
    """Judged texts with ``pos, s, n, first_row`` as rows of the frequency table."""
    given = F.col("t").isNotNull()
    return values.withColumns(
        {
            "is_text": F.lit(True),
            "is_long": F.coalesce(F.col("size") > LONG_TEXT, F.lit(False)),
            "shown": F.col("t"),
            "given": given,
            "present": given & ~F.coalesce("blank", F.lit(False)),
        }
    ).select(*VALUE_COLUMNS)


def _slots(data: Dataset, kinds: dict[int, str]) -> tuple[dict[int, dict[str, Column]], str]:
    """The slots that native columns travel in, and the letters of those in use."""
    slots = {
        position: dict([_slot(col(data.columns[position]), kind)]) for position, kind in kinds.items()
    }
    return slots, "".join(letter for letter in "sldm" if any(letter in slot for slot in slots.values()))


def _native_counts(data: Dataset, kinds: dict[int, str]) -> DataFrame:
    """Distinct typed values with their number, moment and display text."""
    slots, letters = _slots(data, kinds)
    counted = (
        _unpivot(data, slots, letters)
        .groupBy("pos", *letters)
        .agg(F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias("first_row"))
    )
    return _judged_natives(counted, kinds, letters)


def _judged_natives(counted: DataFrame, kinds: dict[int, str], letters: str) -> DataFrame:
    """Typed values with ``pos``, their slots, ``n`` and ``first_row`` as rows of the frequency table."""
    for letter, data_type in _SLOT_TYPES.items():
        if letter not in letters:
            counted = counted.withColumn(letter, F.lit(None).cast(data_type))

    def of(*wanted: str) -> Column:
        return F.col("pos").isin([position for position, kind in kinds.items() if kind in wanted])

    whole, text = F.col("l").cast("string"), F.col("s")
    shown = (
        F.when(of("boolean"), F.when(F.col("l") == 1, "True").when(F.col("l") == 0, "False"))
        .when(of("date"), F.col("m").cast("date").cast("string"))
        .otherwise(F.coalesce(text, whole, F.col("d").cast("string"), F.col("m").cast("string")))
    )
    number = F.when(
        of("integer", "float", "decimal"),
        F.coalesce("d", F.col("l").cast("double"), text.try_cast("double")),
    )
    judged = counted.withColumns({"shown": shown, "number": number, "moment": F.col("m")}).withColumns(
        {
            "given": F.col("shown").isNotNull(),
            "present": F.col("shown").isNotNull(),
            "size": F.length("shown"),
            "is_text": F.lit(False),
            "is_long": F.lit(False),
        }
    )
    blanks = {
        name: F.lit(None).cast(data_type)
        for name, data_type in _JUDGEMENT_TYPES.items()
        if name not in ("size", "number", "moment")
    }
    return judged.withColumns(blanks).select(*VALUE_COLUMNS)


def value_counts(data: Dataset, columns: list[str] | None = None) -> DataFrame:
    """Distinct values per column with their judgements, count and first row.

    Columns: ``pos``; ``s``, the raw text in its short form; ``shown``, the trimmed value for
    display; the judgements; ``n``; ``first_row``. Missing values stay in, one row a column.
    """
    names = data.columns if columns is None else columns
    positions = [data.columns.index(name) for name in names]
    texts = [p for p in positions if kind_of(data.type_of(data.columns[p])) == "text"]
    longest = {p: sketch.longest for p, sketch in column_sketches(data, texts).items()}
    return _all_counts(data, positions, longest)


def _all_counts(data: Dataset, positions: list[int], longest: dict[int, int]) -> DataFrame:
    kinds = {p: kind_of(data.type_of(data.columns[p])) for p in positions}
    texts = [p for p, kind in kinds.items() if kind == "text"]
    natives = {p: kind for p, kind in kinds.items() if kind != "text"}
    long = [p for p in texts if longest[p] > LONG_TEXT]
    parts = [_text_counts(data, chosen, is_long) for chosen, is_long in ((texts, False), (long, True)) if chosen]
    if natives:
        parts.append(_native_counts(data, natives))
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ nearly unique columns


def judged_cells(data: Dataset, positions: list[int]) -> DataFrame:
    """The cells of some columns in the form of the frequency table: one row a cell, ``n`` being one."""
    kinds = {p: kind_of(data.type_of(data.columns[p])) for p in positions}
    texts = [p for p, kind in kinds.items() if kind == "text"]
    natives = {p: kind for p, kind in kinds.items() if kind != "text"}
    parts = []
    if texts:
        parts.append(_judged_text_cells(text_cells(data, texts)))
    if natives:
        slots, letters = _slots(data, natives)
        parts.append(_judged_natives(_unpivot(data, slots, letters).withColumns(_once()), natives, letters))
    return reduce(DataFrame.unionByName, parts)


def _once() -> dict[str, Column]:
    return {"n": F.lit(1).cast("bigint"), "first_row": F.col(ROW_ID)}


def _judged_text_cells(cells: DataFrame) -> DataFrame:
    """Cells of :func:`text_cells` as rows of the frequency table."""
    return _judged_text(with_judgements(cells).withColumns({"s": short_form(F.col("s")), **_once()}))


@dataclass(frozen=True)
class Distinct:
    """How many distinct values a nearly unique column has: as given, trimmed, and without letter case."""

    raw: int | None
    text: int | None
    folded: int | None


@dataclass(frozen=True)
class Frequencies:
    """The values of a table's columns, as far as something is said about them.

    ``ordinary`` has every distinct value of the ordinary columns. ``kept`` has the values of nearly
    unique columns that come first, are most frequent, stand in for missing ones, fill a hundredth of
    the rows, or differ from others only by letter case; each with its full count.
    """

    data: Dataset
    ordinary: DataFrame
    kept: DataFrame
    near_unique: dict[int, Distinct]

    @property
    def values(self) -> DataFrame:
        return self.ordinary.unionByName(self.kept) if self.near_unique else self.ordinary

    def cells(self, positions: Iterable[int] | None = None) -> DataFrame | None:
        """The judged cells of nearly unique columns, read from the table; None when there are none."""
        wanted = [p for p in self.near_unique if positions is None or p in set(positions)]
        return judged_cells(self.data, wanted) if wanted else None

    def weighted(self, positions: Iterable[int] | None = None) -> DataFrame:
        """All values of some columns with weights ``n``; a value of a nearly unique column may stand there more than once."""
        chosen = None if positions is None else list(positions)
        table = self.ordinary if chosen is None else self.ordinary.filter(F.col("pos").isin(chosen))
        cells = self.cells(chosen)
        return table if cells is None else table.unionByName(cells)

    def distinct_texts(self, folded: DataFrame) -> DataFrame:
        """``pos, distinct_text, distinct_folded`` of every ordinary text column."""
        return folded.filter(~F.col("pos").isin(list(self.near_unique))).groupBy("pos").agg(
            F.sum("forms").alias("distinct_text"), F.count(F.lit(1)).alias("distinct_folded")
        )

    def distinct_of(self, pos: int) -> dict[str, int]:
        """What is known of the distinct values of a nearly unique column, by the names of its measures."""
        known = self.near_unique.get(pos)
        if known is None:
            return {}
        if known.raw is not None:
            return {"distinct_raw": known.raw}
        return {"distinct_text": known.text, "distinct_folded": known.folded} if known.text else {}

    def of(self, positions: Iterable[int]) -> Frequencies:
        """The values of some columns."""
        chosen = list(positions)
        among = F.col("pos").isin(chosen)
        return replace(self, ordinary=self.ordinary.filter(among), kept=self.kept.filter(among), near_unique={p: d for p, d in self.near_unique.items() if p in chosen})

    def levels(self) -> DataFrame:
        """``pos, t, n``: every trimmed present text with its rows. Nearly unique columns are grouped here."""
        texts = [p for p, distinct in self.near_unique.items() if distinct.raw is None]
        known = self.ordinary.unionByName(judged_cells(self.data, texts)) if texts else self.ordinary
        return known.filter("is_text AND present").groupBy("pos", "t").agg(F.sum("n").alias("n"))


def frequencies(data: Dataset, least: int = NEAR_UNIQUE, positions: list[int] | None = None) -> Frequencies:
    """Count the values of all or some columns; of nearly unique ones (more than ``least`` values) only those of interest.

    The ``data`` of the result is the same table, spread over the cores where few tasks read it.
    """
    positions = list(range(len(data.columns))) if positions is None else positions
    kinds = {p: kind_of(data.type_of(data.columns[p])) for p in positions}
    sketches = column_sketches(data, positions)
    for sketch in list(sketches.values())[:1]:
        data = spread(data, sketch.rows, sketch.parts)
    near = [p for p in positions if sketches[p].near_unique(kinds[p], least)]
    ordinary = [p for p in positions if p not in near]
    longest = {p: sketches[p].longest for p in positions}
    nothing = data.spark.createDataFrame([], judged_cells(data, near).schema) if near else None
    counted = materialise(_all_counts(data, ordinary, longest)) if ordinary else nothing
    if not near:
        return Frequencies(data, counted, counted, {})
    texts = [p for p in near if kinds[p] == "text"]
    rows, early = sketches[near[0]].rows, _early_rows(data, near)
    kept_natives, distinct = _near_unique_natives(data, {p: kinds[p] for p in near if kinds[p] != "text"}, rows, early)
    kept_texts, more = _near_unique_texts(data, texts, rows, early)
    kept = [part for part in (kept_natives, kept_texts) if part is not None]
    return Frequencies(data, counted, reduce(DataFrame.unionByName, kept, nothing), distinct | more)


#: First rows that are searched for the first distinct values of a column.
_EARLY = 1000
#: Rows of a column that the first pass over its values may keep.
_KEPT_AT_ONCE = 500


def _early_rows(data: Dataset, positions: list[int]) -> dict[int, int]:
    """For each column the row by which its first ``KEPT_FIRST`` distinct values have come, if that is soon."""
    shown = [
        F.when(~tx.missing(col(data.columns[p]), data.type_of(data.columns[p])), short_form(col(data.columns[p]).cast("string"))).alias(str(p))
        for p in positions
    ]
    rows = data.frame.select(ROW_ID, *shown).orderBy(ROW_ID).limit(_EARLY).collect()
    found = {}
    for p in positions:
        seen = set()
        for row in rows:
            seen.add(row[str(p)])
            if len(seen - {None}) == KEPT_FIRST:
                found[p] = row[ROW_ID]
                break
    return found


def _early(positions: Iterable[int], early: dict[int, int]) -> Column:
    """Whether ``first_row`` is among the early rows of its column."""
    conditions = [(F.col("pos") == p) & (F.col("first_row") <= early[p]) for p in positions if p in early]
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


@dataclass(frozen=True)
class _Total:
    """Sums over the distinct values of a column: their rows, how many there are, and how many are kept in any case."""

    n: int
    values: int
    forms: int
    wanted: int

    @property
    def too_many(self) -> bool:
        """Whether not all wanted values and the strongest others were found at once."""
        return self.wanted > _KEPT_AT_ONCE - KEPT_TOP


def _kept_and_totals(grouped: DataFrame, positions: list[int], rows: int, strongest: list[Column]) -> tuple[list[dict], dict[int, _Total]]:
    """The wanted and the ``KEPT_TOP`` strongest other rows of every column, and its totals.

    ``grouped`` has ``pos, n, forms, present, wanted``, a row for each distinct value. Where very many
    are wanted, as the totals tell, some are missing. The totals are observed while the rows are found.
    A task that runs twice may be observed twice; the rows of a column are known, so that shows, and
    then the totals are grouped instead.
    """
    each = {"n": F.col("n"), "values": F.col("present").cast("bigint"), "forms": F.when(F.col("present"), F.col("forms")), "wanted": F.col("wanted").cast("bigint")}
    seen = Observation()
    sums = [F.coalesce(F.sum(F.when(F.col("pos") == p, value)), F.lit(0)).alias(f"{name}_{p}") for p in positions for name, value in each.items()]
    order = Window.partitionBy("pos").orderBy(F.desc("wanted"), *strongest)
    ranked = grouped.observe(seen, *sums).filter("present").withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= _KEPT_AT_ONCE)
    found, others = [], dict.fromkeys(positions, 0)
    for row in sorted(ranked.collect(), key=lambda row: row["__rank"]):
        others[row.pos] += not row.wanted
        if row.wanted or others[row.pos] <= KEPT_TOP:
            found.append(row.asDict(recursive=True))
    told = {p: _Total(*(int(seen.get[f"{name}_{p}"]) for name in each)) for p in positions}
    if any(total.n != rows for total in told.values()):
        counted = grouped.groupBy("pos").agg(*[F.coalesce(F.sum(value), F.lit(0)).alias(name) for name, value in each.items()])
        told = {row.pos: _Total(*(row[name] for name in each)) for row in counted.collect()}
    return found, told


def _near_unique_natives(data: Dataset, kinds: dict[int, str], rows: int, early: dict[int, int]) -> tuple[DataFrame | None, dict[int, Distinct]]:
    """The most frequent and the first typed values of each column, and how many there are."""
    if not kinds:
        return None, {}
    values = _native_counts(data, kinds)
    grouped = values.withColumns({"forms": F.lit(1), "wanted": _early(kinds, early) & F.col("present")})
    found, totals = _kept_and_totals(grouped, list(kinds), rows, [F.desc("n"), F.asc("shown")])
    distinct = {p: Distinct(total.values, None, None) for p, total in totals.items()}
    late = [p for p, total in totals.items() if p not in early or total.too_many]
    names = list(VALUE_COLUMNS)
    kept = small_table(data.spark, [{name: row[name] for name in names} for row in found if row["pos"] not in late], values.schema)
    if late:
        # Row ids repeat or the first rows are empty: the first values are ranked like the most frequent ones.
        present = values.filter(F.col("present") & F.col("pos").isin(late))
        for order, limit in (([F.desc("n")], KEPT_TOP), ([F.asc("first_row")], KEPT_FIRST)):
            kept = kept.unionByName(first_per_group(present, ["pos"], [*order, F.asc("shown")], limit).select(*names))
        kept = materialise(kept.distinct())
    return kept, distinct


def _near_unique_texts(data: Dataset, positions: list[int], rows: int, early: dict[int, int]) -> tuple[DataFrame | None, dict[int, Distinct]]:
    """The texts of interest of each column with their counts, and how many distinct texts there are.

    A first pass groups trimmed texts and finds the folded forms of interest; a second one counts
    the raw texts of those forms.
    """
    if not positions:
        return None, {}
    cells = judged_cells(data, positions)
    digest = F.unhex(F.md5("fold"))
    flagged = F.coalesce(F.col("filler") | F.col("short_filler"), F.lit(False))
    trimmed = cells.groupBy("pos", "t", digest.alias("digest"), "present", flagged.alias("flagged")).agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))
    folded = trimmed.groupBy("pos", "digest", "present").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"), F.min("first_row").alias("first_row"), F.bool_or("flagged").alias("flagged"),
        F.min(F.struct((-F.col("n")).alias("less"), F.col("t").alias("t"))).alias("best"),
    )
    # A value that fills a hundredth of the rows may stand in for a missing one.
    interesting = (F.col("forms") > 1) | F.col("flagged") | (F.col("n") >= max(5, rows // 100)) | _early(positions, early)
    grouped = folded.withColumn("wanted", F.col("present") & interesting)
    found, totals = _kept_and_totals(grouped, positions, rows, [F.asc("best.less"), F.asc("best.t")])
    distinct = {p: Distinct(None, total.forms, total.values) for p, total in totals.items()}
    schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    wanted = small_table(data.spark, [{"pos": row["pos"], "digest": bytes(row["digest"])} for row in found], schema)
    many = [p for p, total in totals.items() if total.too_many]
    if many:
        some = folded.filter(F.col("pos").isin(many) & F.col("present"))
        tops = first_per_group(some, ["pos"], [F.asc("best.less"), F.asc("best.t")], KEPT_TOP).select("pos", "digest")
        wanted = wanted.unionByName(grouped.filter(F.col("pos").isin(many) & F.col("wanted")).select("pos", "digest")).unionByName(tops)
    late = [p for p in positions if p not in early]
    if late:
        first = first_per_group(folded.filter(F.col("pos").isin(late) & F.col("present")), ["pos"], [F.asc("first_row"), F.asc("best.t")], KEPT_FIRST)
        wanted = wanted.unionByName(first.select("pos", "digest"))
    if many or late:
        wanted = materialise(wanted.distinct())
    chosen = _cells_of_forms(data, positions, wanted)
    keys = [name for name in VALUE_COLUMNS if name not in ("n", "first_row")]
    kept = chosen.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row")).select(*VALUE_COLUMNS)
    return materialise(kept), distinct


def _cells_of_forms(data: Dataset, positions: list[int], wanted: DataFrame) -> DataFrame:
    """The judged present cells of some text columns whose folded forms are ``wanted``: ``pos, digest``."""
    few = lookup(wanted)
    if few is wanted:
        # Joined by shuffle: cells are judged where they are read, so that long ones travel in their short form.
        judged = judged_cells(data, positions).withColumn("digest", F.unhex(F.md5("fold")))
        return judged.filter("present").join(few, ["pos", "digest"], "left_semi").drop("digest")
    # Only chosen cells are judged.
    folded = text_cells(data, positions).withColumn("digest", F.unhex(F.md5(folded_form(F.col("s")))))
    return _judged_text_cells(folded.join(few, ["pos", "digest"], "left_semi").drop("digest")).filter("present")


def recounted(values: DataFrame, name: str, data_type: T.DataType, pos: int) -> DataFrame:
    """The frequency table of one column from values with weights: ``values`` has column ``name``, ``n`` and ``first_row``."""
    weights = [F.sum("n").alias("n"), F.min("first_row").alias("first_row")]
    kind = kind_of(data_type)
    if kind == "text":
        grouped = values.groupBy(col(name).alias("s")).agg(*weights).withColumn("pos", F.lit(pos))
        return _judged_text(with_judgements(grouped).withColumn("s", short_form(F.col("s"))))
    letter, value = _slot(col(name), kind)
    grouped = values.groupBy(value.alias(letter)).agg(*weights).withColumn("pos", F.lit(pos))
    return _judged_natives(grouped, {pos: kind}, letter)


def trimmed_counts(values: DataFrame) -> DataFrame:
    """Present text values after trimming: ``pos, key, fold, t, n, raw_forms, first_row``."""
    return (
        values.filter("is_text AND present")
        .groupBy("pos", "key", "fold", "t")
        .agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("raw_forms"),
            F.min("first_row").alias("first_row"),
            F.bool_or("filler").alias("filler"),
            F.bool_or("short_filler").alias("short_filler"),
        )
    )


def folded_counts(trimmed: DataFrame) -> DataFrame:
    """Trimmed values that differ only by letter case, merged."""
    return trimmed.groupBy("pos", "key", "fold").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("forms"),
        F.min("first_row").alias("first_row"),
        F.bool_or("filler").alias("filler"),
        F.bool_or("short_filler").alias("short_filler"),
    )
