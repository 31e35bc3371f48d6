"""Benchmark decontamination by Wu-Manber search for many patterns at once.

Patterns are windows of benchmark words, joined and framed by blanks, so an occurrence can only
begin and end at words. The search holds a text's position at the end of a window of the shortest
pattern's length. The block of bytes that ends there is looked up in a shift table: most blocks
occur in no pattern and move the position far ahead. A block without shift leads, by the hash of
the suffix, to a bucket of patterns, of which those with the same prefix hash are compared byte
by byte. Many stretches of text step forward together as one array.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, column, slices, with_any_columns, written

#: Consecutive words in a window.
WINDOW = 10
#: Bytes of windows that one pass over the documents looks for; more windows mean more passes.
PASS_BYTES = 24 << 20
#: Patterns shorter than this are searched with tables of their own, so they don't shorten all shifts.
SHORT = 24
#: Bits of the shift table's index, and positions a stretch of text covers.
TABLE_BITS, STRETCH = 18, 512

#: ASCII letters are lowered; every ASCII character that is neither a letter nor a digit parts words.
_FOLD = bytes(c if c > 127 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``window, item_id``: the distinct windows of every item, words joined by one blank.

    An item of fewer words than a window, but at least one, is one window. Null and wordless texts
    give none.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found, ids = [], []
                for item, text in zip(column(part, "item_id").to_pylist(), as_bytes(part), strict=True):
                    words = words_of(text)
                    spans = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else ()
                    found.extend(spans)
                    ids.extend([item] * len(spans))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(ids, pa.string())], ["window", "item_id"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(each, "window binary, item_id string").distinct()


class Searcher:
    """The tables of one set of patterns, and the search for them."""

    def __init__(self, patterns: list[bytes]):
        self.groups = [
            _Tables(list(numbers), [patterns[n] for n in numbers])
            for numbers in (
                [n for n, p in enumerate(patterns) if len(p) < SHORT],
                [n for n, p in enumerate(patterns) if len(p) >= SHORT],
            )
            if numbers
        ]

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and pattern number of every occurrence in ``data`` (bytes)."""
        found = [tables.find(data) for tables in self.groups]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))


class _Tables:
    def __init__(self, numbers: list[int], patterns: list[bytes]):
        self.numbers, self.patterns = numbers, patterns
        self.least = min(map(len, patterns))
        self.block = min(3, self.least)
        self.shift = np.full(1 << TABLE_BITS, self.least - self.block + 1, np.int32)
        heads = np.frombuffer(b"".join(p[: self.least] for p in patterns), np.uint8).reshape(len(patterns), self.least)
        for end in range(self.block, self.least + 1):
            np.minimum.at(self.shift, self._hash(heads, np.full(1, end))[:, 0], self.least - end)
        self.bucket: dict[bytes, list[int]] = defaultdict(list)
        for n, pattern in enumerate(patterns):
            self.bucket[pattern[: self.least]].append(n)
        self.suffix = np.zeros(1 << TABLE_BITS, bool)
        self.suffix[self._suffix(heads, np.full(1, self.least))] = True

    def _hash(self, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Table index of the block of bytes before each of ``ends``, in each row."""
        code = np.zeros((rows.shape[0], len(ends)), np.uint32)
        for back in range(self.block, 0, -1):
            code = code * np.uint32(2654435761) + rows[:, ends - back]
        return (code * np.uint32(2246822519)) >> np.uint32(32 - TABLE_BITS)

    def _suffix(self, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bucket index of the last bytes, up to eight, before each of ``ends``."""
        code = np.zeros((rows.shape[0], len(ends)), np.uint32)
        for back in range(min(8, self.least), 0, -1):
            code = code * np.uint32(2246822519) + rows[:, ends - back] + np.uint32(1)
        return (code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = data.reshape(1, -1)
        at = np.arange(self.least, len(data) + 1, STRETCH)
        until = np.minimum(at + STRETCH, len(data) + 1)
        hits = []
        while len(at):
            step = self.shift[self._hash(row, at)[0]]
            stop = step == 0
            if stop.any():
                here = at[stop]
                hits.append(here[self.suffix[self._suffix(row, here)[0]]])
                step[stop] = 1
            at = at + step
            going = at < until
            at, until = at[going], until[going]
        starts, found = [], []
        whole = data.tobytes()
        for end in np.concatenate(hits).tolist() if hits else ():
            start = end - self.least
            for n in self.bucket.get(whole[start:end], ()):
                if whole.startswith(self.patterns[n], start):
                    starts.append(start)
                    found.append(self.numbers[n])
        return np.array(starts, np.int64), np.array(found, np.int64)


def _search(batch: pa.RecordBatch, searcher: Searcher, sizes: np.ndarray) -> list[tuple[int, np.ndarray, set[int]]]:
    """For every text: its number of words, which words are hit, and the windows found."""
    words = [text.translate(_FOLD).split() for text in as_bytes(batch)]
    framed = [b" " + b" ".join(each) + b" " if each else b"" for each in words]
    data = np.frombuffer(b"\0".join(framed), np.uint8)
    begins = np.cumsum([0, *(len(each) + 1 for each in framed)])
    starts, found = searcher.find(data)
    rows = np.searchsorted(begins, starts, side="right") - 1
    out = [(len(each), np.zeros(len(each), bool), set()) for each in words]
    blanks = {}
    for start, number, row in zip(starts.tolist(), found.tolist(), rows.tolist(), strict=True):
        if row not in blanks:
            blanks[row] = np.flatnonzero(np.frombuffer(framed[row], np.uint8) == 32)
        first = int(np.searchsorted(blanks[row], start - begins[row]))
        out[row][1][first : first + sizes[number]] = True
        out[row][2].add(number)
    return out


def _passes(found: DataFrame) -> Iterator[tuple[list[bytes], list[list[str]]]]:
    """The windows and the items of each, in portions of about ``PASS_BYTES``."""
    total = found.agg(F.sum(F.octet_length("window") + F.octet_length(F.coalesce("item_id", F.lit(""))))).first()[0] or 0
    portions = max(1, -(-total // PASS_BYTES))
    for portion in range(portions):
        held: dict[bytes, list[str]] = defaultdict(list)
        for row in found.filter(F.pmod(F.xxhash64("window"), F.lit(portions)) == portion).toLocalIterator():
            held[bytes(row["window"])].append(row["item_id"])
        yield list(held), list(held.values())


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """How far benchmark ``items (item_id, text)`` occur in every row of ``docs``.

    Returns the ``keep`` columns and ``n_words``, ``n_hit`` (words inside an occurrence of a
    window), ``n_items`` (items with occurring windows), ``items_sha256`` (of their ids, sorted as
    strings and joined by commas) and ``contaminated``. A null or wordless text has no words and
    no hits. An item without an id counts as an item with an empty id. With no items nothing is
    hit. Rows are never shuffled: windows travel to the documents, ``PASS_BYTES`` of them in a
    pass, and each pass adds to what the rows carry.
    """
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"), F.lit(b"").alias("__hit"), F.lit(b"").alias("__items"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    result = f"{kept}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    portions = _passes(written(windows(items, size)))
    portion = next(portions)
    while portion is not None:
        later = next(portions, None)
        rows = _one_pass(rows, *portion, keep, f"{kept}, text string, __hit binary, __items binary" if later else result, last=later is None)
        rows = written(rows) if later else rows
        portion = later
    return rows


def _one_pass(rows: DataFrame, patterns: list[bytes], ids: list[list[str]], keep: tuple[str, ...], schema: str, last: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((patterns, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, ids = shared.value
        sizes = np.array([each.count(b" ") + 1 for each in patterns], np.int64)
        searcher = Searcher([b" " + each + b" " for each in patterns])
        for batch in batches:
            for part in slices(batch):
                found = _search(part, searcher, sizes)
                before = zip(column(part, "__hit").to_pylist(), column(part, "__items").to_pylist(), strict=True)
                hits, items = [], []
                for (_, hit, numbers), (old_hit, old_items) in zip(found, before, strict=True):
                    if old_hit:
                        hit = hit | np.unpackbits(np.frombuffer(old_hit, np.uint8), count=len(hit)).astype(bool)
                    hits.append(hit)
                    items.append({name or "" for n in numbers for name in ids[n]} | set(old_items.decode().split("\0")[:-1]))
                own = [column(part, name) for name in keep]
                if last:
                    digests = [hashlib.sha256(",".join(sorted(each)).encode()).hexdigest() for each in items]
                    numbers = [[n for n, _, _ in found], [int(hit.sum()) for hit in hits], [len(each) for each in items]]
                    own += [*(pa.array(each, pa.int64()) for each in numbers), pa.array(digests, pa.string()), pa.array([n > 0 for n in numbers[1]], pa.bool_())]
                else:
                    packed = [np.packbits(hit).tobytes() if hit.any() else b"" for hit in hits]
                    own += [column(part, "text"), pa.array(packed, pa.binary()), pa.array(["".join(f"{x}\0" for x in sorted(each)).encode() for each in items], pa.binary())]
                yield pa.RecordBatch.from_arrays(own, names)

    names = [part.split()[0] for part in schema.split(", ")]
    return rows.mapInArrow(run, schema)


@with_any_columns
def without_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs."""
    flags = decontaminate(docs.select(F.struct(*docs.columns).alias("row"), "text"), items, size, ("row",))
    return flags.filter("not contaminated").select("row.*")
