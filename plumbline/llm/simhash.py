"""SimHash near-duplicates by pivot distance tables.

Distinct fingerprints meet in buckets, so that Spark can deal them out: of four blocks of bits,
two differing bits leave at least two blocks alike, hence six pairs of blocks name the buckets.
A bucket with more than ``BUCKET`` members is cut again by blocks of its free bits, down to
buckets that cannot hold more than 256 fingerprints. In a bucket, the distances of every
fingerprint to the reference fingerprints are laid out as a table; pairs whose coordinates differ
by more than the wanted distance anywhere are discarded (the triangle inequality), and the rest
are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ROW_KEY, arrow_map, as_bytes, beside, column, with_any_columns, with_row_key, written
from plumbline.llm.graph import components, gathered, scattered

#: Words in a shingle, and the number of bits in which linked fingerprints may differ.
SHINGLE, MAX_BITS = 3, 2
#: Buckets of more fingerprints are cut again while bits are left to cut by.
BUCKET = 128
#: Reference fingerprints.
PIVOTS = 24


def _fingerprint(text: bytes, shingle: int) -> int:
    words = text.split()
    if not words:
        return 0
    if len(words) <= shingle:
        joined = [b" ".join(words)]
    else:
        joined = [b" ".join(part) for part in zip(*(words[i:] for i in range(shingle)))]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(joined), 1 << 16):
        hashes = np.array([digest(each, 42) for each in joined[at : at + (1 << 16)]], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(joined)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``fp`` (the fingerprint as a signed long) of every row.

    A null or blank text has fingerprint zero; a text of fewer words than a shingle has one
    shingle, all its words. Ties, bits set in exactly half of the shingles, count as unset.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_fingerprint(text.lower(), shingle) for text in as_bytes(batch)]
        fp = pa.array(np.array(found, dtype=np.uint64).view(np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([*(column(batch, name) for name in keep), fp], [*keep, "fp"])

    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in rows.select(*keep).schema)
    return arrow_map(rows, each, f"{schema}, fp bigint")


def _cuts(free: list[int], blocks: int = 4, alike: int = 2) -> list[list[int]]:
    """The bits held alike by each choice of ``alike`` blocks out of the free bits."""
    size = len(free) // blocks
    parts = [free[i * size : (i + 1) * size] for i in range(blocks)]
    return [sorted(sum(choice, [])) for choice in combinations(parts, alike)]


def _signed(bits: list[int]) -> int:
    mask = reduce(lambda m, bit: m | 1 << bit, bits, 0)
    return mask - (1 << 64) if mask >> 63 else mask


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: digests of their numbers, so every task makes the same ones."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode()) for i in range(count)], dtype=np.uint64)


def _near(fps: np.ndarray, max_bits: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``max_bits`` in any row of ``fps`` (buckets by members), by pivot table and verification."""
    table = np.bitwise_count(fps[:, :, None] ^ references).astype(np.int8)
    row, a, b = (each.ravel() for each in np.broadcast_arrays(np.arange(len(fps))[:, None], *(i[None, :] for i in np.triu_indices(fps.shape[1], 1))))
    for pivot in range(len(references)):
        alike = np.abs(table[row, a, pivot] - table[row, b, pivot]) <= max_bits
        row, a, b = row[alike], a[alike], b[alike]
    close = np.bitwise_count(fps[row, a] ^ fps[row, b]) <= max_bits
    return fps[row, a][close], fps[row, b][close]


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints (column ``fp``) that differ in at most ``max_bits`` bits.

    ``fps`` must hold each fingerprint once. ``max_bits`` may be 1 or 2.
    """
    if max_bits not in (1, 2):
        raise ValueError("links() finds fingerprints that differ in one or two bits")
    rows = fps.select("fp", F.explode(F.array(*[F.lit(_signed(held)) for held in _cuts(list(range(64)))])).alias("mask"))
    masks = {_signed(held): held for held in _cuts(list(range(64)))}
    references = pivots()
    found = []

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().view(np.uint64)
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes).tolist():
                first = starts[sizes == size]
                step = max(1, 2_000_000 // (size * size))
                for at in range(0, len(first), step):
                    a, b = _near(values[first[at : at + step, None] + np.arange(size)], max_bits, references)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    while True:
        last = min(64 - len(held) for held in masks.values()) <= 8
        keyed = rows.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "bits").agg(F.count("*").alias("n")).filter("n > 1")
        keyed = written(keyed.join(sizes, ["mask", "bits"]))
        small = keyed if last else keyed.filter(F.col("n") <= bucket)
        found.append(small.groupBy("mask", "bits").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(pairs, "a bigint, b bigint"))
        large = keyed.filter(F.col("n") > bucket).select("fp", "mask")
        if last or large.isEmpty():
            break
        deeper, cuts = {}, []
        for mask, held in masks.items():
            free = [bit for bit in range(64) if bit not in set(held)]
            below = [sorted(held + cut) for cut in _cuts(free)]
            deeper |= {_signed(bits): bits for bits in below}
            cuts += [(mask, _signed(bits)) for bits in below]
        steps = rows.sparkSession.createDataFrame(cuts, "mask bigint, below bigint")
        rows = large.join(F.broadcast(steps), "mask").select("fp", F.col("below").alias("mask")).distinct()
        masks = deeper
    return reduce(DataFrame.unionByName, found).distinct()


def _rooted(prints: DataFrame, max_bits: int) -> DataFrame:
    """``fp, root`` of the fingerprints that some other one is linked to."""
    distinct = written(prints.select("fp").distinct())
    found = links(distinct, max_bits).select(*(scattered(F.col(end)).alias(end) for end in ("a", "b")))
    return components(found).select(gathered(F.col("node")).alias("fp"), gathered(F.col("root")).alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``fingerprint`` is written as sixteen hex digits. ``component_id`` is the smallest document id
    that links reach, where a link joins fingerprints of at most ``max_bits`` different bits; rows
    with equal fingerprints are always joined. Null ids are never the smallest: a component that
    holds nothing else has a null ``component_id``. Repeated rows come out as often as they came in.
    """
    prints = written(fingerprints(docs, shingle))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    grouped = written(distinct.join(_rooted(prints, max_bits), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("members"))
    known = grouped.join(smallest, "root").filter("members > 1").select("fp", "component_id")
    return prints.join(known, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


@with_any_columns
def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id.

    Rows without an id come after all others; among rows of the same id (repeated rows) the one
    that comes first in the files stays.
    """
    rows = with_row_key(docs)
    prints = written(fingerprints(rows, shingle, ("doc_id", *ROW_KEY)))
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", *ROW_KEY)
    first = prints.groupBy("fp").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    grouped = written(first.join(_rooted(prints, max_bits), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    kept = grouped.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("members")).filter("members > 1")
    repeats = prints.join(grouped.join(kept, "root").select("fp", "kept"), "fp")
    gone = written(repeats.filter(" or ".join(f"{name} <> kept.{name}" for name in ROW_KEY)).select(*ROW_KEY))
    return rows.join(beside(gone), ROW_KEY, "left_anti").select(*docs.columns)
