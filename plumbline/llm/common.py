"""What the operators of this subpackage share: written intermediate tables and Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: Python objects made from one slice of a batch stay near this many bytes of text.
SLICE_BYTES = 4 << 20


@cache
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="plumbline-llm-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is set.

    Where it is unset, a local master gets a temporary folder and a cluster its warehouse folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return _test_folder()
    return spark.conf.get("spark.sql.warehouse.dir")


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that nothing has yet."""
    return f"{shared_folder(spark).rstrip('/')}/plumbline-llm/{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    path = new_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id`` and the whole text, a missing text read as the empty one."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of rows whose ``column`` holds about ``limit`` bytes; a row is never cut."""
    at = batch.schema.get_field_index(column)
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_pylist()
    first = held = 0
    for row, size in enumerate(sizes):
        if row > first and held + size > limit:
            yield batch.slice(first, row - first)
            first, held = row, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def arrow_map(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """``each`` over slices of bounded size, in the tasks that read the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = each(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8."""
    array = column(batch, name)
    return array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()).to_pylist()


#: Names of the row key that :func:`with_row_key` adds.
ROW_KEY = ["__file", "__at"]


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with a key for every row, which ids (null or repeated) are not.

    Rows read from files are named by file and place, which every later scan repeats. Anything
    else is written to the shared folder first, since row numbers of a plan may change when part
    of it is computed again.
    """
    for name in ROW_KEY:
        if name in docs.columns:
            raise ValueError(f"a column is named {name}")
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return written(docs.select("*", F.lit(0).cast("long").alias("__file"), F.monotonically_increasing_id().alias("__at")))


#: Columns that stages read by name; any others travel through a stage packed into one.
_READ = ("doc_id", "text", "lang", "source", "n_chars")
_OTHERS = "__others"


def with_any_columns(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage over documents whose other columns may have any names, those that stages use themselves too.

    They come back in their places. Where the stage adds a column of that name, it gives way.
    """

    @wraps(stage)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        others = [name for name in docs.columns if name not in _READ]
        if not others:
            return stage(docs, *args, **options)
        packed = F.struct(*[F.col(_quoted(name)).alias(f"c{i}") for i, name in enumerate(others)]).alias(_OTHERS)
        read = [name for name in docs.columns if name in _READ]
        out = stage(docs.select(*read, packed), *args, **options)
        added = [name for name in out.columns if name not in (*read, _OTHERS)]
        kept = [F.col(name) if name in read else F.col(_OTHERS)[f"c{others.index(name)}"].alias(name) for name in docs.columns if name not in added]
        return out.select(*kept, *added)

    return run


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Bytes of a table that may be broadcast; they are counted before.
BROADCAST_BYTES = 32 << 20


def beside(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its bytes are few, so that the texts it joins need not move.

    The bytes are counted first. A larger table comes back unmarked and joins by shuffle. ``df``
    should be a written table, since counting reads it.
    """
    width: Column = F.lit(16 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            width = width + 8 * F.coalesce(F.size(F.col(field.name)), F.lit(0))
        elif isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else df
