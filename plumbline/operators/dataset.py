"""A table under review, and small helpers every operator shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.storagelevel import StorageLevel

from plumbline.functions import text as tx

ROW_ID = "__row_id"
#: Bytes of a lookup that may be broadcast; they are counted before.
BROADCAST_BYTES = 32 << 20


class ShapeError(ValueError):
    """The table has no rows, no columns, or more of them than the caller allows."""


@dataclass(frozen=True)
class Dataset:
    """A DataFrame with a row id column, plus what was learned while reading it."""

    frame: DataFrame
    name: str = "dataset"
    notes: tuple[str, ...] = ()
    content_hash: str | None = None
    size_bytes: int = 0
    encoding: str | None = None
    delimiter: str | None = None

    @classmethod
    def of(cls, df: DataFrame, name: str = "dataset", row_id: str | None = None, **known) -> Dataset:
        """Wrap ``df``. ``row_id`` names a unique integer column that gives the row order.

        Without one, ids follow the order of the scan. They are stable while the files and
        the split settings stay the same; counts never depend on them.
        """
        if ROW_ID in df.columns:
            return cls(df, name, **known)
        ids = F.col(f"`{row_id}`").cast("bigint") if row_id else F.monotonically_increasing_id()
        return cls(df.withColumn(ROW_ID, ids), name, **known)

    @property
    def fields(self) -> list[T.StructField]:
        return [field for field in self.frame.schema.fields if field.name != ROW_ID]

    @property
    def columns(self) -> list[str]:
        return [field.name for field in self.fields]

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession

    def type_of(self, name: str) -> T.DataType:
        return self.frame.schema[name].dataType

    def with_frame(self, frame: DataFrame) -> Dataset:
        return replace(self, frame=frame)

    def check_shape(self, max_rows: int | None = None, max_columns: int | None = None) -> None:
        """Raise :class:`ShapeError` for an empty or oversized table. No limit by default."""
        if not self.columns:
            raise ShapeError("The table has no columns.")
        if max_columns is not None and len(self.columns) > max_columns:
            raise ShapeError(f"{len(self.columns):,} columns exceed the limit of {max_columns:,}.")
        if self.frame.isEmpty():
            raise ShapeError("The table has a header but no rows.")
        if max_rows is not None and self.frame.limit(max_rows + 1).count() > max_rows:
            raise ShapeError(f"The table has more than {max_rows:,} rows.")


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def preview_rows(data: Dataset, limit: int = 50) -> DataFrame:
    """The first few rows, by row id."""
    return data.frame.orderBy(ROW_ID).limit(limit).select(*map(col, data.columns))


def small_table(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """Metadata-sized rows (one per column, rule or finding) as a local relation."""
    schema = _nullable(schema)
    maps = [field.name for field in schema.fields if isinstance(field.dataType, T.MapType)]
    for name in maps:
        rows = [{**row, name: list(row[name].items()) if row[name] is not None else None} for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)), schema)


def pinned(df: DataFrame) -> tuple[DataFrame, list[dict]]:
    """A metadata-sized table computed now and kept as a local relation, with its rows."""
    rows = [row.asDict(recursive=True) for row in df.collect()]
    return small_table(df.sparkSession, rows, df.schema), rows


def _nullable(data_type: T.DataType) -> T.DataType:
    if isinstance(data_type, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in data_type.fields])
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(_nullable(data_type.elementType))
    if isinstance(data_type, T.MapType):
        return T.MapType(data_type.keyType, _nullable(data_type.valueType))
    return data_type


def shared_folder(spark: SparkSession) -> str | None:
    """Where intermediate tables may be written: the session's checkpoint folder, if it has one."""
    return spark.conf.get("spark.checkpoint.dir", None)


class Intermediates:
    """Tables computed on the way; :meth:`release` gives their space back."""

    def __init__(self):
        self.kept: list[DataFrame] = []
        self.paths: list[tuple[SparkSession, str]] = []

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()
        for spark, path in self.paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.kept, self.paths = [], []


#: Collects what is computed while a plan is run; see :func:`collecting`.
_COLLECTING: ContextVar[Intermediates | None] = ContextVar("collecting", default=None)


@contextmanager
def collecting() -> Iterator[Intermediates]:
    """Gather the intermediate tables of a plan, so that its result can release them."""
    owner, outer = Intermediates(), _COLLECTING.get()
    token = _COLLECTING.set(owner)
    try:
        yield owner
    finally:
        _COLLECTING.reset(token)
        if outer is not None:
            outer.kept += owner.kept
            outer.paths += owner.paths


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once for several readers.

    Written as a table to the shared folder, so a lost executor costs no recomputation and
    later plans start from a plain scan. Without such a folder it is persisted, lineage
    intact.
    """
    owner, root = _COLLECTING.get(), shared_folder(df.sparkSession)
    if root is None:
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        if owner is not None:
            owner.kept.append(kept)
        return kept
    path = f"{root.rstrip('/')}/plumbline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if owner is not None:
        owner.paths.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows from which a table is worth a task of its own, when each is judged cell by cell.
ROWS_PER_TASK = 25_000


def spread(data: Dataset, rows: int, parts: int) -> Dataset:
    """A table of ``rows`` rows, all of them in ``parts`` parts of its scan, computed once in as many as keep the cores busy.

    A compressed file of a few MB is one part of a scan, though it may unpack to millions of rows, and every
    pass over them would be one task, however many parts the file's bytes are split into. Tables that come
    in parts enough, or are small, stay as they are.
    """
    wanted = min(rows // ROWS_PER_TASK, 2 * data.spark.sparkContext.defaultParallelism)
    if 3 * parts >= wanted:
        return data
    return data.with_frame(materialise(data.frame.repartition(wanted, col(ROW_ID))))


def lookup(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when its bytes are counted and few.

    Anything larger is returned unmarked and joins by shuffle, where adaptive execution splits
    skewed keys.
    """
    width = sum(
        (F.coalesce(F.octet_length(col(f.name)), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(0) for f in df.schema),
        F.lit(16 * len(df.columns)),
    )
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= limit else df


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "__rank") -> DataFrame:
    """The first ``limit`` rows of each group, without sorting a whole hot group in one task.

    The optimizer ranks small limits within each task before it shuffles what is left. For larger
    ones that is written out: a first ranking inside salted sub-groups leaves ``limit`` rows of each.
    """
    final = Window.partitionBy(*map(col, keys)).orderBy(*order)
    if limit > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.struct(*map(col, df.columns))]), F.lit(256)))
        local = Window.partitionBy(*map(col, keys), "__salt").orderBy(*order)
        df = salted.withColumn(rank, F.row_number().over(local)).filter(F.col(rank) <= limit).drop(rank, "__salt")
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= limit)


#: Columns whose facts are written into an expression; more of them are joined.
_WRITTEN_OUT = 200


def beside_facts(df: DataFrame, facts: list[dict], names: list[str], types: T.StructType) -> DataFrame:
    """``df (pos, ...)`` with some facts of the column at ``pos``; rows without facts are left out.

    Facts are a row for each column of a table, so few of them need no join.
    """
    rows = [{"pos": fact["pos"], **{name: fact[name] for name in names}} for fact in facts]
    schema = T.StructType([T.StructField("pos", T.IntegerType()), *(types[name] for name in names)])
    if len(rows) > _WRITTEN_OUT:
        return df.join(F.broadcast(small_table(df.sparkSession, rows, schema)), "pos")
    known = df.filter(F.col("pos").isin([row["pos"] for row in rows]))
    for name in names:
        value = F.lit(None)
        for row in rows:
            value = F.when(F.col("pos") == row["pos"], F.lit(row[name])).otherwise(value)
        known = known.withColumn(name, value.cast(types[name].dataType))
    return known


def row_digest(values: list[Column]) -> Column:
    """A 128-bit digest of several values; nulls equal each other and differ from any text.

    Grouping by the digest shuffles sixteen bytes a row however wide the table is. Each
    part carries its length, so neighbouring values cannot run into each other.
    """
    parts = [
        F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        for text in (value.cast("string") for value in values)
    ]
    return F.unhex(F.md5(F.concat_ws(",", *parts)))


def digest_part(value: Column, data_type: T.DataType, folded: bool) -> Column:
    """One column as it enters a row digest: text folded when asked, -0.0 read as 0.0."""
    if folded and tx.is_text(data_type):
        return tx.comparison_form(value, data_type)
    if tx.is_floating(data_type):
        return value + F.lit(0.0)
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(F.struct(value))
    return value
