"""Samples taken at a constant stride, in row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.dataset import ROW_ID, Dataset, col

#: Ranges of row ids ranked independently.
RANGES = 64


def evenly_spaced_sample(data: Dataset, column: str, limit: int) -> DataFrame:
    """At most ``limit`` given values of a column, every n-th in row order: row id and value.

    The rows are cut at quantiles of their ids, so ranges are of like size however the ids lie.
    Counting each range gives the position at which it starts, so ranges are ranked side by side
    and nothing is sorted as a whole.
    """
    given = data.frame.select(ROW_ID, col(column)).filter(col(column).isNotNull())
    shares = [i / RANGES for i in range(1, RANGES)]
    bounds = given.agg(F.percentile_approx(ROW_ID, shares, 10_000).alias("cuts"), F.count(F.lit(1)).alias("n")).first()
    if bounds.n <= limit or limit <= 0:
        return given
    stride = -(-bounds.n // limit)
    cuts = F.array(*[F.lit(cut).cast("bigint") for cut in sorted(set(bounds.cuts))])
    ranged = given.withColumn("__range", F.size(F.filter(cuts, lambda cut: cut <= F.col(ROW_ID))))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("__range")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(ROW_ID)) - 1
    return (
        ranged.withColumn("__inside", inside)
        .join(F.broadcast(starts), "__range")
        .filter((F.col("__start") + F.col("__inside")) % stride == 0)
        .select(ROW_ID, col(column))
    )
