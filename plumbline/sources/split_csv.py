"""CSV files whose cells hold line breaks, read in splits like any other text.

Whether a line begins inside quotes depends on all lines before it. But what a line makes of either
case can be told from the line alone: it may end as it must, keep the state or change it. Such steps
combine, so each split of a file is summed up on its own, a pass over the few sums tells how every
split begins, and then each line knows its state. Lines that begin inside quotes belong to the record
before them, across the ends of splits too.
"""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.dataset import ROW_ID, materialise, small_table

_SPLITS = T.StructType(
    [
        T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("inside", T.BooleanType()),
        T.StructField("owner_block", T.LongType()), T.StructField("owner_place", T.LongType()), T.StructField("header", T.LongType()),
    ]
)


def _patterns(delimiter: str) -> tuple[str, str]:
    """Patterns of lines that end inside quotes: when they begin outside of them, and inside.

    A quote opens at the begin of a field only, two in a row stand for one, and what follows a closing
    quote up to the next delimiter is part of the field. No part of a pattern is tried twice.
    """
    mark = re.escape(delimiter)
    quoted, rest = r'(?:[^"]|"")*+', rf"[^{mark}]*+"
    fields = rf'(?:(?:"{quoted}"{rest}|[^"{mark}]{rest}|){mark})*+'
    opened = rf'{fields}"{quoted}\z'
    return rf"(?s)\A{opened}", rf'(?s)\A{quoted}(?:\z|"{rest}{mark}{opened})'


def _decoded(line: Column, encoding: str) -> Column:
    return line if encoding == "UTF-8" else F.decode(line.cast("binary"), encoding)


def _lines(spark: SparkSession, path: str, delimiter: str, encoding: str) -> DataFrame:
    """Every line with its split, its number and what it makes of the state: ``last_set`` and ``turns``.

    ``last_set`` is the state that the last line before it left in any case (null: none did so), and
    ``turns`` counts the lines since then that change the state.
    """
    outside, inside = _patterns(delimiter)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("number"), _decoded(F.col("value"), encoding).alias("line"),
    )
    has_quotes = F.contains("line", F.lit('"'))
    stepped = lines.withColumns(
        {"from_outside": has_quotes & F.col("line").rlike(outside), "from_inside": ~has_quotes | F.col("line").rlike(inside)}
    )
    order = Window.partitionBy("file", "block").orderBy("number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    through = order.rowsBetween(Window.unboundedPreceding, 0)
    sets, turns = F.col("from_outside") == F.col("from_inside"), F.col("from_outside") & ~F.col("from_inside")
    counted = stepped.withColumn("turned", F.sum(turns.cast("bigint")).over(through))
    marked = F.when(sets, F.struct("turned", F.col("from_outside").alias("state")))
    known = counted.withColumns({"last": F.last(marked, True).over(before), "earlier": F.coalesce(F.lag("turned").over(order), F.lit(0))})
    return materialise(
        known.select(
            "file", "block", "number", "line", "from_outside", "from_inside", F.col("last.state").alias("last_set"),
            (F.col("earlier") - F.coalesce("last.turned", F.lit(0))).alias("turns"),
        )
    )


def _state(begins_inside: Column) -> Column:
    """Whether a line begins inside quotes, when its split does or does not."""
    return F.coalesce("last_set", begins_inside) != (F.col("turns") % 2 == 1)


def _splits(lines: DataFrame) -> DataFrame:
    """How every split begins, which record goes on in it, and the number of its file's header line.

    There is one row for each split of a file, so the driver can go through them in order.
    """
    sums = []
    for begins in (False, True):
        state = _state(F.lit(begins))
        ends = F.when(state, F.col("from_inside")).otherwise(F.col("from_outside"))
        sums += [F.max_by(ends, "number").alias(f"ends_{begins}"), F.count_if(~state).alias(f"records_{begins}")]
    first = F.min(F.when(F.trim("line") != "", F.col("number"))).alias("first")
    found = lines.groupBy("file", "block").agg(*sums, first).orderBy("file", "block").collect()
    rows = []
    for file, splits in groupby(found, key=lambda row: row.file):
        splits = list(splits)
        header = next((split.first for split in splits if split.first is not None), None)
        inside, owner = False, (None, None)
        for split in splits:
            rows.append(dict(zip(_SPLITS.names, (file, split.block, inside, *owner, header))))
            if split[f"records_{inside}"]:
                owner = (split.block, split[f"records_{inside}"])
            inside = split[f"ends_{inside}"]
    return small_table(lines.sparkSession, rows, _SPLITS)


def records(spark: SparkSession, path: str, delimiter: str, encoding: str) -> DataFrame:
    """``record`` and the row id of every CSV record but the header of each file; blank lines are none."""
    lines = _lines(spark, path, delimiter, encoding)
    known = lines.join(F.broadcast(_splits(lines)), ["file", "block"]).withColumn("starts", ~_state(F.col("inside")))
    order = Window.partitionBy("file", "block").orderBy("number")
    place = F.sum(F.col("starts").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # A line that the next record follows at once is a record by itself.
    placed = known.withColumns({"place": place, "alone": F.col("starts") & F.coalesce(F.lead("starts").over(order), F.lit(False))})
    single = placed.filter("alone").select("number", "header", F.col("line").alias("record"))
    joined = (
        placed.filter(~F.col("alone"))
        .withColumns({"owner_block": F.when(F.col("place") > 0, F.col("block")).otherwise(F.col("owner_block")), "owner_place": F.when(F.col("place") > 0, F.col("place")).otherwise(F.col("owner_place"))})
        .groupBy("file", "owner_block", "owner_place", "header")
        .agg(F.min("number").alias("number"), F.array_sort(F.collect_list(F.struct("number", "line"))).alias("parts"))
        .select("number", "header", F.array_join(F.transform("parts", lambda part: part["line"]), "\n").alias("record"))
    )
    kept = single.unionByName(joined).filter((F.col("number") != F.col("header")) & (F.trim("record") != ""))
    return kept.select("record", F.col("number").alias(ROW_ID))


def read_split(spark: SparkSession, path: str, schema: T.StructType, delimiter: str, encoding: str) -> DataFrame:
    """The cells of every record as text, under the names of ``schema``, and the row id."""
    options = {"sep": delimiter, "quote": '"', "escape": '"'}
    cells = F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("cells")
    return records(spark, path, delimiter, encoding).select(cells, ROW_ID).select("cells.*", ROW_ID)
