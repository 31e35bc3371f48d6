"""Columns whose value another column decides, so that gaps can be looked up, not guessed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators.dataset import Dataset, col, spread

#: Fewer jointly filled rows than this are no evidence.
MIN_EVIDENCE = 20
#: A column with more distinct values than this share of its rows decides everything trivially.
MAX_KEY_SHARE = 0.5
#: Targets in one pass, and a quarter of the determinants; more in one plan outgrow generated methods.
TOGETHER = 8


def _normal(data: Dataset, name: str) -> Column:
    return tx.normalised_text(col(name), data.type_of(name))


def pair_statistics(data: Dataset, targets: list[str], determinants: list[str] | None = None) -> DataFrame:
    """Evidence for every (determinant, target) pair of columns.

    Each row is expanded over the determinants only, and one grouping by determinant and key
    gathers what is known of all targets at once. It combines on the map side, so a frequent key
    arrives as one row per task. Very wide tables take a few such passes.
    """
    names = data.columns if determinants is None else determinants
    parts = [
        _statistics(data, targets[t : t + TOGETHER], names[n : n + 4 * TOGETHER])
        for t in range(0, len(targets), TOGETHER)
        for n in range(0, len(names), 4 * TOGETHER)
    ]
    return reduce(DataFrame.unionByName, parts)


def _statistics(data: Dataset, targets: list[str], names: list[str]) -> DataFrame:
    keys = [_digest(_normal(data, name)).alias(f"k{n}") for n, name in enumerate(names)]
    values = [hashed.alias(f"{letter}{i}") for i, target in enumerate(targets) for letter, hashed in zip("vw", _hashes(_normal(data, target)))]
    listed = ", ".join(f"k{n} AS `{n}`" for n in range(len(names)))
    # UNPIVOT becomes an Expand operator, inside generated code.
    cells = data.spark.sql(f"SELECT * FROM {{rows}} UNPIVOT INCLUDE NULLS (key FOR determinant IN ({listed}))", rows=data.frame.select(*values, *keys))
    sums = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(targets)):
        sums.append(F.count(f"v{i}").alias(f"n{i}"))
        sums += [least(f"{letter}{i}").alias(f"{name}_{letter}{i}") for letter in "vw" for name, least in (("min", F.min), ("max", F.max))]
    per_key = cells.groupBy("determinant", "key").agg(*sums)
    totals = []
    for i, target in enumerate(targets):
        filled, gaps = F.col(f"n{i}"), F.col("rows") - F.col(f"n{i}")
        taught = F.col("key").isNotNull() & (filled > 0)
        one_value = (F.col(f"min_v{i}") == F.col(f"max_v{i}")) & (F.col(f"min_w{i}") == F.col(f"max_w{i}"))
        totals.append(
            F.struct(
                F.lit(target).alias("target"),
                F.coalesce(F.sum(F.when(taught, filled)), F.lit(0)).alias("evidence_rows"),
                F.count_if(taught).alias("distinct_keys"),
                F.coalesce(F.bool_and(F.when(taught, one_value)), F.lit(False)).alias("decides"),
                F.coalesce(F.sum(F.when(taught, gaps)), F.lit(0)).alias("recoverable_rows"),
                F.sum(gaps).alias("gap_rows"),
                ((F.min(f"min_v{i}") != F.max(f"max_v{i}")) | (F.min(f"min_w{i}") != F.max(f"max_w{i}"))).alias("varies"),
            )
        )
    named = F.element_at(F.array(*map(F.lit, names)), F.col("determinant").cast("int") + 1)
    pairs = per_key.groupBy("determinant").agg(F.array(*totals).alias("pairs")).select(named.alias("determinant"), F.inline("pairs"))
    return pairs.filter("determinant <> target").withColumn("unrecoverable_rows", F.col("gap_rows") - F.col("recoverable_rows"))


def _digest(text: Column) -> Column:
    """Long keys travel as digests; only their equality matters here."""
    return F.when(F.length(text) <= 64, text).otherwise(F.md5(text))


def _hashes(text: Column) -> tuple[Column, Column]:
    """Two independent hashes of a value, together 128 bits; null for null.

    Only the equality of values matters. The least and greatest number of a key are kept in place while
    rows are grouped; the least text would have every expanded row sorted first.
    """
    return F.when(text.isNotNull(), F.xxhash64(text)), F.when(text.isNotNull(), F.xxhash64(F.md5(text)))


def dependencies(statistics: DataFrame) -> DataFrame:
    """Pairs where the target has gaps and every key maps to exactly one value."""
    return statistics.filter(
        (F.col("gap_rows") > 0)
        & F.col("varies")
        & (F.col("evidence_rows") >= MIN_EVIDENCE)
        & (F.col("distinct_keys") >= 2)
        & (F.col("distinct_keys") <= MAX_KEY_SHARE * F.col("evidence_rows"))
        & F.col("decides")
    ).select("determinant", "target", "evidence_rows", "distinct_keys", "recoverable_rows", "unrecoverable_rows")


def best_determinants(found: DataFrame) -> DataFrame:
    """One determinant per target: most gaps filled, then fewest keys, then the later name."""
    order = Window.partitionBy("target").orderBy(
        F.desc("recoverable_rows"), F.asc("distinct_keys"), F.desc("determinant")
    )
    return found.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def find_determinants(data: Dataset, targets: list[str], facts: list[dict] | None = None) -> DataFrame:
    """The best determinant of each target column with gaps.

    With collected facts, columns that cannot qualify are left out of the search: a column
    keeps at least its distinct values less the target's gaps, and that may not exceed half
    of the rows both columns fill.
    """
    names = data.columns
    if facts is not None:
        known = {fact["column"]: fact for fact in facts}
        names = [name for name in names if any(_may_decide(known[name], known[target]) for target in targets)]
    paired = any(name != target for name in names for target in targets)
    if facts is None:
        # Nothing is known of the table; a measured one is spread already.
        size = data.frame.select(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.size(F.collect_set("part")).alias("parts")).first()
        data = spread(data, size.rows, size.parts)
    if not paired:
        return data.spark.createDataFrame(
            [], "determinant string, target string, evidence_rows bigint, distinct_keys bigint, "
            "recoverable_rows bigint, unrecoverable_rows bigint",
        )
    return best_determinants(dependencies(pair_statistics(data, targets, names)))


def _may_decide(source: dict, target: dict) -> bool:
    if source["unique_count"] is None:
        return False
    evidence = min(source["present_count"], target["present_count"])
    return source["unique_count"] - target["missing_count"] <= MAX_KEY_SHARE * evidence


def lookup_table(data: Dataset, determinant: str, target: str, needed_only: bool = False) -> DataFrame:
    """``key, value`` for every key seen beside a value; optionally only keys of rows with gaps."""
    pairs = data.frame.select(_normal(data, determinant).alias("key"), _normal(data, target).alias("value")).filter(
        "key IS NOT NULL"
    ).distinct()
    grouped = pairs.groupBy("key").agg(
        F.min("value").alias("value"), F.bool_or(F.col("value").isNull()).alias("needed")
    ).filter("value IS NOT NULL")
    return (grouped.filter("needed") if needed_only else grouped).select("key", "value")
