"""Expressions built in steps.

A long expression that uses an intermediate several times is inlined into one huge method
and outgrows the code generator. Written as successive projections, each intermediate is
computed once: the optimizer does not merge projections that would repeat costly work.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import zip_longest

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Successive projections; names starting with two underscores are dropped at the end.
Steps = list[dict[str, Column]]


def side_by_side(*plans: Steps) -> Steps:
    """Independent step lists merged level by level, to keep the number of projections low."""
    return [
        {name: value for level in levels for name, value in level.items()}
        for levels in zip_longest(*plans, fillvalue={})
    ]


def apply_steps(df: DataFrame, steps: Steps) -> DataFrame:
    for level in steps:
        df = df.withColumns(level)
    return df.drop(*[name for level in steps for name in level if name.startswith("__")])


#: The column that cached steps read.
INPUT = "__input"


@lru_cache(maxsize=16)
def _built(build: Callable[[Column], Steps], context: SparkContext) -> Steps:
    return build(F.col(INPUT))


def steps_for(df: DataFrame, build: Callable[[Column], Steps]) -> Steps:
    """The steps of ``build`` over the column named by :data:`INPUT`.

    Building a few hundred expressions takes longer than planning them, so they are kept for
    as long as the Spark context lives.
    """
    return _built(build, df.sparkSession.sparkContext)


def read_with(df: DataFrame, value: Column, build: Callable[[Column], Steps], **outputs: str) -> DataFrame:
    """Run cached steps over ``value`` and keep their outputs under the given names."""
    done = apply_steps(df.withColumn(INPUT, value), steps_for(df, build)).drop(INPUT)
    return done.withColumnsRenamed(outputs)
