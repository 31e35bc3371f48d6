"""Mixing sources to target weights by Pfair scheduling.

Every source is a task whose k-th block (from 0) may be released at slot ``floor(k / w)`` and must
run before slot ``ceil((k + 1) / w)``, w being the source's target weight, exactly as given. Of the
released blocks, the one with the earliest deadline runs next. Every block that exists gets its
slot that way; weights are not rounded. No source is ever a whole block ahead of or behind its
target weight. Rows are counted, numbered and joined by DataFrame operations; the order of the
blocks is serial and worked out on the driver, from one row a source.
"""

from __future__ import annotations

import heapq
from array import array
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import ROW_KEY, beside, with_any_columns, with_row_key, written

#: Rows in a block, and slots in a period of :func:`period`, which takes whole shares.
BLOCK, SLOTS = 16, 1000
#: Rows are numbered in buckets of at most about this many, and in more buckets than there are tasks.
NUMBERED, BUCKETS_PER_TASK = 20_000, 4
#: Target weights grow with this power of a source's number of rows.
SMOOTHING = 0.5
#: Columns that say where a row stands in the mix.
PLACE = ("block", "slot", "released", "deadline", "in_mix")
#: The largest slot a column can hold.
_LAST = 2**63 - 1


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shares(weights: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``source, slots``: whole slots of a period for every source, by largest remainders.

    ``weights (source, weight)`` must name fewer sources than there are slots. Sources whose
    weight is null or not above zero are left out; every other source gets one slot at least.
    """
    valid = weights.filter("weight > 0").groupBy("source").agg(F.sum("weight").alias("weight"))
    listed = valid.agg(
        F.array_sort(F.collect_list(F.struct("source", "weight"))).alias("list"), F.sum("weight").alias("total"), F.count("*").alias("n")
    ).filter("n > 0")
    spare = F.lit(slots) - F.col("n")
    ideal = F.transform("list", lambda s: F.struct(s["source"].alias("source"), (s["weight"] / F.col("total") * spare).alias("ideal")))
    floored = listed.select(
        "n", F.assert_true(spare >= 0, F.lit("more sources than slots")), ideal.alias("ideals")
    ).select("n", "ideals", (F.lit(slots) - F.col("n") - F.aggregate("ideals", F.lit(0).cast("long"), lambda a, s: a + F.floor(s["ideal"]))).alias("left"))
    ranked = floored.select(
        "left",
        F.posexplode(
            F.array_sort("ideals", lambda a, b: F.when(a["ideal"] % 1 > b["ideal"] % 1, -1).when(a["ideal"] % 1 < b["ideal"] % 1, 1).when(F.coalesce(a["source"], F.lit("")) < F.coalesce(b["source"], F.lit("")), -1).otherwise(1))
        ).alias("rank", "s"),
    )
    return ranked.select(
        F.col("s.source").alias("source"),
        (1 + F.floor("s.ideal") + F.when(F.col("rank") < F.col("left"), 1).otherwise(0)).cast("long").alias("slots"),
    )


def period(shared: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``source, k, slot, slots``: the slot of the k-th block of each source in one period."""
    tasks = shared.agg(F.array_sort(F.collect_list(F.struct("source", F.col("slots").alias("share"), F.lit(0).cast("long").alias("done")))).alias("tasks")).filter("size(tasks) > 0")
    span = F.lit(slots).cast("long")

    def next_slot(state: Column, slot: Column) -> Column:
        ready = F.filter(
            F.transform(
                state["tasks"],
                lambda t, i: F.struct(
                    F.ceil((t["done"] + 1) * span / t["share"]).alias("deadline"),
                    i.alias("task"),
                    (F.floor(t["done"] * span / t["share"]) <= slot).alias("released"),
                ),
            ),
            lambda t: t["released"],
        )
        return _let(
            F.array_min(ready)["task"],
            lambda chosen: F.struct(
                F.transform(
                    state["tasks"],
                    lambda t, i: F.struct(t["source"].alias("source"), t["share"].alias("share"), (t["done"] + F.when(i == chosen, 1).otherwise(0)).cast("long").alias("done")),
                ).alias("tasks"),
                F.concat(state["chosen"], F.array(chosen)).alias("chosen"),
            ),
        )

    start = F.struct(F.col("tasks"), F.array().cast("array<int>").alias("chosen"))
    run = tasks.select("tasks", F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), start, next_slot)["chosen"].alias("chosen"))
    return run.select("tasks", F.posexplode("chosen").alias("slot", "task")).select(
        F.col("tasks")[F.col("task")]["source"].alias("source"),
        (F.row_number().over(Window.partitionBy("task").orderBy("slot")) - 1).cast("long").alias("k"),
        F.col("slot").cast("long").alias("slot"),
        F.col("tasks")[F.col("task")]["share"].alias("slots"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows (source, ...)`` with ``number``, counting each source's rows from 0 in a mixed order.

    A source is numbered in buckets of bounded size whose first numbers are sums of the sizes
    before, so no task holds a large source.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS_PER_TASK * tasks, -(-rows.count() // NUMBERED))
    mixed = F.xxhash64("doc_id", *ROW_KEY)
    dealt = rows.withColumn("__bucket", F.pmod(mixed, F.lit(buckets)))
    held = dealt.groupBy("source", "__bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select(F.col("source").alias("__source"), F.col("__bucket").alias("__held"), before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("source", "__bucket").orderBy(mixed, "doc_id", *ROW_KEY))
    return (
        dealt.withColumn("__place", place)
        .join(offsets, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__held")))
        .withColumn("number", F.col("__before") + F.col("__place") - 1)
        .drop("__source", "__held", "__before", "__place", "__bucket")
    )


def smoothed_weights(docs: DataFrame, power: float = SMOOTHING) -> DataFrame:
    """``source, weight``: each source's number of rows to a power, which lifts small sources."""
    return docs.groupBy("source").agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def earliest_deadlines(weights: list[float], held: list[int], full: list[int]) -> tuple[dict[str, array], int | None]:
    """``task, block, slot, released, deadline`` of every block, and the first slot whose task has no full block.

    Task i has ``held[i]`` blocks, ``full[i]`` of them full. Weights are read as the decimal numbers
    they are written as, and all windows are whole-number arithmetic. One heap step for each block.
    """
    exact = [Fraction(repr(float(w))) for w in weights]
    scale = lcm(*(w.denominator for w in exact))
    parts = [int(w * scale) for w in exact]
    total = sum(parts)
    out = {name: array("q") for name in ("task", "block", "slot", "released", "deadline")}
    done = [0] * len(parts)
    waiting = [(0, i) for i in range(len(parts))]
    ready, slot, end = [], 0, None
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            released, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[i] + 1) * total // parts[i]), i, released))
        if not ready:
            slot = waiting[0][0]
            continue
        deadline, i, released = heapq.heappop(ready)
        if end is None and done[i] >= full[i]:
            end = slot
        if done[i] >= held[i]:
            continue
        for name, value in (("task", i), ("block", done[i]), ("slot", slot), ("released", released), ("deadline", deadline)):
            out[name].append(min(value, _LAST))
        done[i] += 1
        heapq.heappush(waiting, (done[i] * total // parts[i], i))
        slot += 1
    return out, end


def schedule(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """``doc_id, source`` and the place of every row in the mix: ``block, slot, released, deadline, in_mix``.

    ``slot`` orders the mix: rows with the same slot form one block of one source. ``in_mix`` holds
    for the slots before the first one whose source has no full block left; until there, each
    source's number of blocks is less than one away from its target weight times the slots. Later
    blocks follow within their own windows, so no row is lost, but slots may stay empty and the
    shares no longer hold. Without ``weights`` they are :func:`smoothed_weights`. A null source is a
    source of its own. Rows of sources without a positive weight get null slots and are not in the
    mix. An empty table gives an empty result. ``slots`` has no effect on the schedule, which has no
    period; it stays for callers that name it.
    """
    return _places(with_row_key(docs), weights, block).drop(*ROW_KEY)


def _plan(rows: DataFrame, weights: DataFrame | None, block: int) -> tuple[DataFrame, DataFrame, int | None]:
    """``source, task`` of the weighted sources, ``task, block`` and the place of every block, and the first gap."""
    spark = rows.sparkSession
    weights = smoothed_weights(rows) if weights is None else weights
    valid = weights.filter("weight > 0 AND NOT isnan(weight)").groupBy("source").agg(F.sum("weight").cast("double").alias("weight"))
    counts = rows.groupBy(F.col("source").alias("__source")).agg(F.count("*").alias("n"))
    found = valid.join(counts, F.col("source").eqNullSafe(F.col("__source")), "left").select("source", "weight", F.coalesce("n", F.lit(0)).alias("n")).collect()
    found.sort(key=lambda r: (r.source is not None, r.source or ""))
    places, end = earliest_deadlines([r.weight for r in found], [-(-r.n // block) for r in found], [r.n // block for r in found])
    tasks = pa.table({"__source": pa.array([r.source for r in found], pa.string()), "__task": pa.array(range(len(found)), pa.int64())})
    plan = pa.table({"__task" if k == "task" else "__block" if k == "block" else k: pa.array(memoryview(v), pa.int64()) if len(v) else pa.array([], pa.int64()) for k, v in places.items()})
    return written(spark.createDataFrame(tasks)), written(spark.createDataFrame(plan)), end


def _places(keyed: DataFrame, weights: DataFrame | None, block: int) -> DataFrame:
    """The place of every row of ``keyed``, which has its row key; texts stay where they are."""
    rows = keyed.select("doc_id", "source", *ROW_KEY)
    tasks, plan, end = _plan(rows, weights, block)
    numbered = _numbered(rows).withColumn("block", F.floor(F.col("number") / block))
    named = numbered.join(beside(tasks), F.col("source").eqNullSafe(F.col("__source")), "left")
    placed = named.join(beside(plan), (named["__task"] == plan["__task"]) & (F.col("block") == F.col("__block")), "left")
    return placed.select(
        "doc_id",
        "source",
        *ROW_KEY,
        "block",
        "slot",
        "released",
        "deadline",
        F.coalesce(F.col("slot") < F.lit(end), F.lit(False)).alias("in_mix"),
    )


@with_any_columns
def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """All columns of ``docs`` and the place of every row in the mix (see :func:`schedule`).

    A column of ``docs`` that is named like one of these gives way.
    """
    keyed = with_row_key(docs.drop(*PLACE))
    places = written(_places(keyed, weights, block).drop("doc_id", "source"))
    return keyed.join(beside(places), ROW_KEY).select(*keyed.drop(*ROW_KEY).columns, *PLACE)
