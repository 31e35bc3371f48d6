"""Corpus-wide counts of very many keys, asked for and answered block by block.

Documents are packed into blocks of bounded size and each block lists its distinct 64-bit keys in
order. Keys are dealt to buckets by value, so a block's share of a bucket is one run of its list and
travels as one row. A bucket sees every key of its range once for each block that holds it, however
often the key occurs, so frequent keys make no bucket larger than others. The answers keep the order
of the lists and go back to the blocks without the keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import column, shared_folder, slices, written

#: Bytes of text in a block, and of keys and weights in a bucket.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 12 << 20
#: Buckets there are at least.
LEAST_BUCKETS = 48


def squeeze(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, equal places of the numbers together."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T) if width > 1 else values
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind) if width > 1 else raw.view(kind)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, np.uint64), dtype=np.uint64)


def blocks(rows: DataFrame, build: Callable[[pa.RecordBatch], dict[str, bytes | int]], fields: str) -> DataFrame:
    """A table with one row a block: ``block`` and the ``fields`` that ``build`` makes of its rows.

    ``fields`` must hold ``n_keys``, the number of distinct keys. A block never spans two tasks. The
    table lies in the shared folder, bucketed by block, so that answers come to the blocks and not the
    other way round.
    """
    names = [part.split()[0] for part in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal number
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            out = {"block": number, **build(whole)}
            number += 1
            return pa.RecordBatch.from_pylist([out], pa.schema([("block", pa.int64()), *((n, pa.int64() if n.startswith("n_") else pa.binary()) for n in names)]))

        held, size = [], 0
        for batch in batches:
            for part in slices(batch, limit=BLOCK_BYTES):
                if not part.num_rows:
                    continue
                more = pa.compute.sum(pa.compute.binary_length(column(part, "text"))).as_py()
                if held and size + more > BLOCK_BYTES:
                    yield packed(held)
                    held, size = [], 0
                held.append(part)
                size += more
        if held:
            yield packed(held)

    spark = rows.sparkSession
    name = f"plumbline_blocks_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/plumbline-llm/{name}"
    made = rows.mapInArrow(run, f"block bigint, {fields}").write.format("parquet").option("path", path)
    made.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name)
    return spark.table(name)


def answers(table: DataFrame, listed: Callable[[dict], tuple[np.ndarray, np.ndarray]], combine: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, int]]], stats: tuple[str, ...] = ()) -> DataFrame:
    """``block, answers`` and the ``stats``: what ``combine`` says of every key of every block.

    ``listed(row)`` gives the keys of a block, sorted and distinct, and their weights (``uint32``).
    ``combine(keys, weights, ends)`` gets all entries of a bucket, block after block in the order of
    their numbers (``ends`` are the places where blocks end), and returns a number for each entry and
    sums over the bucket. ``answers`` lists the buckets' pieces in order; a sum stands in one of the
    rows of its bucket, the others hold zeros.
    """
    total = table.agg(F.sum("n_keys")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total * 12 // BUCKET_BYTES))
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, (keys, weights) = row["block"], listed(row)
                ends = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                runs = [(i, a, b) for i, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _, _ in runs], pa.int64()),
                        pa.array([block] * len(runs), pa.int64()),
                        pa.array([squeeze_sorted(keys[a:b]) for _, a, b in runs], pa.binary()),
                        pa.array([squeeze(weights[a:b]) for _, a, b in runs], pa.binary()),
                    ],
                    ["bucket", "block", "keys", "weights"],
                )

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        keys = [expand_sorted(each) for each in group["keys"]]
        ends = np.cumsum([len(each) for each in keys])
        found, sums = combine(np.concatenate(keys), np.concatenate([expand(each, np.uint32) for each in group["weights"]]), ends)
        out = pd.DataFrame({"bucket": group["bucket"].to_numpy(), "block": group["block"].to_numpy()})
        out["answers"] = [squeeze(each) for each in np.split(found, ends[:-1])]
        for name in stats:
            out[name] = [sums[name]] + [0] * (len(out) - 1)
        return out

    sums = "".join(f", {name} bigint" for name in stats)
    asked = table.mapInArrow(ask, "bucket bigint, block bigint, keys binary, weights binary")
    pieces = asked.groupBy("bucket").applyInPandas(answer, f"bucket bigint, block bigint, answers binary{sums}")
    return written(pieces)


def answered(table: DataFrame, pieces: DataFrame) -> DataFrame:
    """The blocks, each with its ``answers`` as an array in the order of its keys."""
    whole = pieces.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "answers"))), lambda p: p["answers"]).alias("answers"))
    return table.join(whole, "block", "left")


def told(parts: list[bytes] | None, kind: type) -> np.ndarray:
    """The answers of one block."""
    return np.concatenate([np.zeros(0, kind), *(expand(part, kind) for part in parts or ())])
