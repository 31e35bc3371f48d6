"""Connected components of a graph that Spark holds as a table of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``edges (a, b)``: nodes of one component share their root.

    Every round each node moves to its smallest neighbour and the graph shrinks to the nodes
    moved to. With ids that are digests, or are :func:`scattered`, the rounds grow with the logarithm
    of the size; a chain of rising ids would take a round for each of them. Both
    steps are groupings and joins; groupings combine locally first, so the centre of a large star
    reaches no task with all its edges. An empty table of edges gives an empty result; loops and
    repeated edges are allowed; null ends are ignored.
    """
    edges = written(
        edges.filter("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    moves = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        moves.append(move)
        left, right = move.toDF("a", "to_a"), move.toDF("b", "to_b")
        edges = written(
            edges.join(left, "a")
            .join(right, "b")
            .filter("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .distinct()
        )
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves.pop().toDF("node", "root")
    for move in reversed(moves):
        later = roots.toDF("to", "later")
        roots = written(move.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("root")))
    return roots


_HALF = 0xFFFFFFFF


def _mixed(half: Column) -> Column:
    return F.xxhash64(half).bitwiseAND(F.lit(_HALF))


def scattered(ids: Column, rounds: int = 3) -> Column:
    """Other longs in place of ``ids``, in no order that they have; :func:`gathered` takes them back.

    Each round exchanges the halves of the bits and changes one of them by a digest of the other.
    """
    high, low = F.shiftrightunsigned(ids, 32), ids.bitwiseAND(F.lit(_HALF))
    for _ in range(rounds):
        high, low = low, high.bitwiseXOR(_mixed(low))
    return F.shiftleft(high, 32).bitwiseOR(low)


def gathered(ids: Column, rounds: int = 3) -> Column:
    """The longs that :func:`scattered` was given."""
    high, low = F.shiftrightunsigned(ids, 32), ids.bitwiseAND(F.lit(_HALF))
    for _ in range(rounds):
        high, low = low.bitwiseXOR(_mixed(high)), high
    return F.shiftleft(high, 32).bitwiseOR(low)
