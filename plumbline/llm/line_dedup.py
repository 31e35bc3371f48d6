"""Near-duplicate lines by a segment-partition edit join.

Lines are compared in lower case with single blanks. Two lines are linked if one edit (a character
put in, taken out or exchanged) at most lies between them, lines of fewer than ``LEAST_CHARS``
characters only if they are equal. A line of length L is split into two segments, one more than
the edits allowed. One edit leaves one of the segments whole, so every line puts its segments into
an index by length, place and content, and probes the index of its own length and of the length one
below with the substrings that stand where a segment can have moved to.

A place of the index that more than ``CROWD`` lines share (say, lines that begin alike) is not
compared pair by pair. Its lines still differ by one edit in the rest, the region; the region is
split into two segments in its turn, and the lines meet again in smaller places, until the places
are small or the region is a single character. Lines that are alike but for that character are all
linked to each other, so links to one of them say the same. Every candidate pair is verified by a
banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ROW_KEY, as_bytes, beside, column, slices, with_any_columns, with_row_key, written
from plumbline.llm.graph import components

#: Edits that linked lines may lie apart.
EDITS = 1
#: Characters from which lines are linked to others than equal ones.
LEAST_CHARS = 20
#: Lines that may share a place of the index before it is split.
CROWD = 32
#: Lines whose texts are wanted are broadcast as 64-bit numbers up to this many.
BROADCAST_LINES = 4_000_000
#: Bytes of text that a task looks at together.
TOGETHER = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: The line number of the row that stands for a document as a whole.
_DOCUMENT = -1


def normalised(line: bytes) -> bytes:
    """Lower case with single blanks (ASCII white space), as UTF-8."""
    return b" ".join(line.decode().lower().encode().split())


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class _Lines:
    """Texts laid end to end, with hashes of any of their substrings."""

    def __init__(self, lines: list[bytes]):
        codes = [np.frombuffer(line.decode().encode("utf-32-le"), np.uint32) for line in lines]
        self.sizes = np.array([len(code) for code in codes], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.codes = np.concatenate([np.zeros(0, np.uint32), *codes])
        terms = (self.codes + np.uint64(1)) * _powers(_BASE, len(self.codes))[:-1]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.back = _powers(_BACK, len(self.codes))

    def substring(self, line: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = self.first[line] + begin, self.first[line] + end
        return (self.sums[b] - self.sums[a]) * self.back[a]

    def places(self, line: np.ndarray, longer: np.ndarray, before: np.ndarray, after: np.ndarray, mark: np.ndarray | int = 0) -> np.ndarray:
        """Numbers of the places where lines meet: equal lengths (less one if ``longer``), the same
        ``before`` first and ``after`` last characters, and the same ``mark``."""
        size = self.sizes[line]
        length = (size - longer).astype(np.uint64)
        number = self.substring(line, np.zeros_like(before), before)
        for part in (self.substring(line, size - after, size), length, before.astype(np.uint64), after.astype(np.uint64), np.asarray(mark, np.uint64)):
            number = (number ^ part) * np.uint64(0xD6E8FEB86659FD93)
            number ^= number >> np.uint64(32)
        return number.view(np.int64)


def _state(before: np.ndarray, after: np.ndarray, longer: np.ndarray) -> np.ndarray:
    return before << 32 | after << 1 | longer


def _halves(size: np.ndarray, before: np.ndarray, after: np.ndarray, longer: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """What lies before and after the region once either segment of it is known to be alike."""
    region = size - longer - before - after
    half = region // 2
    return [(before + half, after), (before, after + region - half)]


def _index(lines: _Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, place and state: both segments of every line, and its probes into lines one shorter."""
    found = []
    for longer in (0, 1):
        line = np.flatnonzero(lines.sizes - longer >= LEAST_CHARS)
        size, none, more = lines.sizes[line], np.zeros(len(line), np.int64), np.full(len(line), longer, np.int64)
        for before, after in _halves(size, none, none, more):
            found.append((line, lines.places(line, more, before, after), _state(before, after, more)))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _thinned(place: np.ndarray, state: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and states, where all but the first ``CROWD + 1`` rows of a place are sent elsewhere.

    Those rows need not meet the others: the ones that stay prove the place crowded, and the rest
    are marked as belonging to a crowd.
    """
    order = np.argsort(place, kind="stable")
    ranked = place[order]
    opens = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    rank = np.arange(len(ranked)) - np.repeat(opens, np.diff(np.concatenate([opens, [len(ranked)]])))
    spare = order[rank > CROWD]
    place, state = place.copy(), state.copy()
    place[spare] = (seed[spare].view(np.uint64) * _BASE).view(np.int64)
    state[spare] |= np.int64(-1 << 63)
    return place, state


def _scan(docs: DataFrame) -> DataFrame:
    """Every distinct line of each portion of text, with its first place there and its index entries.

    ``digest, line, doc_id``, the row's key, ``places`` and ``states``; one more row for every
    document, with the number of its lines that hold a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=TOGETHER):
                yield _scanned(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *ROW_KEY, F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, "digest binary, line int, doc_id bigint, __file bigint, __at bigint, n_lines int, places array<bigint>, states array<bigint>"))


def _scanned(batch: pa.RecordBatch) -> pa.RecordBatch:
    seen: dict[bytes, int] = {}
    kept, where = [], []
    texts, ids = as_bytes(batch), column(batch, "doc_id").to_pylist()
    counts = [0] * len(texts)
    # In the order of the documents, so that the first of equal lines is the one that stays.
    for row in sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0)):
        text, n = texts[row], 0
        for number, line in enumerate(text.split(b"\n")):
            plain = normalised(line)
            if plain:
                n += 1
                digest = xxhash.xxh3_128_digest(plain)
                if digest not in seen:
                    seen[digest] = len(kept)
                    kept.append(plain)
                    where.append((row, number))
        counts[row] = n
    lines = _Lines(kept)
    line, place, state = _index(lines)
    pointers = np.frombuffer(b"".join(seen), ">i8").astype(np.int64)[::2]
    place, state = _thinned(place, state, pointers[line])
    order = np.argsort(line, kind="stable")
    ends = np.cumsum(np.bincount(line, minlength=len(kept)))
    offsets = pa.array(np.concatenate([[0], ends, np.full(len(counts), ends[-1] if len(ends) else 0)]).astype(np.int32))
    rows = pa.array([row for row, _ in where] + list(range(len(counts))), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*seen, *[None] * len(counts)], pa.binary()),
            pa.array([number for _, number in where] + [_DOCUMENT] * len(counts), pa.int32()),
            *(column(batch, name).take(rows) for name in ("doc_id", *ROW_KEY)),
            pa.array([None] * len(kept) + counts, pa.int32()),
            pa.ListArray.from_arrays(offsets, pa.array(place[order])),
            pa.ListArray.from_arrays(offsets, pa.array(state[order])),
        ],
        ["digest", "line", "doc_id", *ROW_KEY, "n_lines", "places", "states"],
    )


def _meet(entries: DataFrame) -> DataFrame:
    """Candidates from index entries ``place, pointer, state``.

    ``kind, x, y``: kind 0 are pairs of pointers, kind 1 entries (pointer and state) of crowded places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate([old, column(batch, name).to_numpy()]) for old, name in zip(held, ("place", "pointer", "state"), strict=True)]
            if not len(rows[0]):
                continue
            # The last place may go on in the next batch; of a crowd, enough rows stay to know it.
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            yield _met(*(each[:last] for each in rows))
            held = _fresh(*(each[last:] for each in rows))
            if len(held[0]) > 100_000:
                yield _met(*(each[: -4 * CROWD] for each in held))
                held = [each[-4 * CROWD :] for each in held]
        yield _met(*held)

    partitions = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entries.repartition(partitions, "place").sortWithinPartitions("place", "pointer", "state").mapInArrow(run, "kind int, x bigint, y bigint")


def _fresh(place: np.ndarray, pointer: np.ndarray, state: np.ndarray) -> list[np.ndarray]:
    """Sorted entries, each once."""
    if not len(place):
        return [place, pointer, state]
    fresh = np.concatenate([[True], (place[1:] != place[:-1]) | (pointer[1:] != pointer[:-1]) | (state[1:] != state[:-1])])
    return [place[fresh], pointer[fresh], state[fresh]]


def _met(place: np.ndarray, pointer: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    xs, ys, kinds = [], [], []

    def add(kind: int, x: np.ndarray, y: np.ndarray) -> None:
        xs.append(x)
        ys.append(y)
        kinds.append(np.full(len(x), kind, np.int32))

    spare = state < 0
    add(1, pointer[spare], state[spare] & np.int64((1 << 63) - 1))
    place, pointer, state = _fresh(place[~spare], pointer[~spare], state[~spare])
    if len(place):
        opens = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sizes = np.diff(np.concatenate([opens, [len(place)]]))
        crowded = np.repeat(sizes > CROWD, sizes)
        add(1, pointer[crowded], state[crowded])
        for size in np.unique(sizes[(sizes > 1) & (sizes <= CROWD)]).tolist():
            rows = opens[sizes == size][:, None] + np.arange(size)
            a, b = (rows[:, i].ravel() for i in np.triu_indices(size, 1))
            # Two lines that are both one longer than the place's length don't meet there.
            apart = ((state[a] & state[b] & 1) == 0) & (pointer[a] != pointer[b])
            add(0, np.minimum(pointer[a], pointer[b])[apart], np.maximum(pointer[a], pointer[b])[apart])
    parts = [np.concatenate(each) for each in (kinds, xs, ys)]
    return pa.RecordBatch.from_arrays([pa.array(each) for each in parts], ["kind", "x", "y"])


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``pointer, digest, plain``: the lines that ``wanted (pointer)`` names, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=TOGETHER):
                plain = {normalised(line) for text in as_bytes(part) for line in text.split(b"\n")}
                plain.discard(b"")
                digests = [xxhash.xxh3_128_digest(line) for line in plain]
                pointers = np.frombuffer(b"".join(digests), ">i8").astype(np.int64)[::2]
                yield pa.RecordBatch.from_arrays([pa.array(pointers), pa.array(digests, pa.binary()), pa.array(list(plain), pa.binary())], ["pointer", "digest", "plain"])

    lines = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "pointer bigint, digest binary, plain binary")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_LINES else wanted
    return written(lines.join(side, "pointer", "left_semi").groupBy("pointer", "digest").agg(F.first("plain").alias("plain")))


def _split(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """``place, pointer, state, leaf`` of crowd members, whose regions are split once more.

    At a region of one character or none the entries are leaves: all members of a leaf's place are
    linked to those among them that are not longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "plain", TOGETHER):
                lines = _Lines(column(part, "plain").to_pylist())
                pointer, state = column(part, "pointer").to_numpy(), column(part, "state").to_numpy()
                line, size = np.arange(len(pointer)), lines.sizes
                before, after, longer = state >> 32, (state & 0xFFFFFFFF) >> 1, state & 1
                region = size - longer - before - after
                wide, found = region > 1, []

                def add(rows: np.ndarray, left: np.ndarray, right: np.ndarray, mark: np.ndarray | int, leaf: bool) -> None:
                    places = lines.places(line[rows], longer[rows], left[rows], right[rows], mark)  # noqa: B023
                    found.append((places, pointer[rows], _state(left, right, longer)[rows], np.full(len(rows), leaf)))  # noqa: B023

                for left, right in _halves(size, before, after, longer):
                    rows = np.flatnonzero(wide)
                    moved_place, moved_state = _thinned(lines.places(line[rows], longer[rows], left[rows], right[rows]), _state(left, right, longer)[rows], pointer[rows])
                    found.append((moved_place, pointer[rows], moved_state, np.zeros(len(rows), bool)))
                add(np.flatnonzero(~wide & (longer == 0)), before, after, 1, True)
                last = len(lines.codes) - 1
                for step in (0, 1):
                    # The character left when one of the region's characters is taken out.
                    rows = np.flatnonzero(~wide & (step < np.maximum(region + longer, 1)) & ((region > 0) | (step == 0)))
                    char = lines.codes[np.minimum(lines.first[rows] + before[rows] + step, last)].astype(np.uint64) if len(rows) else np.zeros(0, np.uint64)
                    add(rows, before, after, np.where(region[rows] > 0, char + np.uint64(2), np.uint64(0)), True)
                places, pointers, states, leaves = (np.concatenate(each) for each in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(pointers), pa.array(states), pa.array(leaves)], ["place", "pointer", "state", "leaf"])

    return crowd.join(texts, "pointer").select("pointer", "state", "plain").mapInArrow(run, "place bigint, pointer bigint, state bigint, leaf boolean")


def _stars(leaves: DataFrame) -> DataFrame:
    """Pairs ``x, y`` that link all members of each leaf's place to one that is not longer."""
    centre = leaves.groupBy("place").agg(F.min(F.when(F.col("state").bitwiseAND(1) == 0, F.col("pointer"))).alias("centre")).filter("centre is not null")
    return leaves.join(centre, "place").filter("pointer <> centre").select(F.least("pointer", "centre").alias("x"), F.greatest("pointer", "centre").alias("y"))


def within(left: list[np.ndarray], right: list[np.ndarray], edits: int) -> np.ndarray:
    """Which pairs of code-point arrays lie at most ``edits`` apart, by banded bit-parallel states.

    For each number of errors, the bits of a word say which diagonals of the band can be reached;
    one step of the words takes in one character of all left texts.
    """
    out = np.zeros(len(left), bool)
    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    order = np.argsort(sizes[:, 0], kind="stable")
    order = order[np.abs(sizes[order, 0] - sizes[order, 1]) <= edits]
    at = 0
    while at < len(order):
        width = int(sizes[order[min(at + 4095, len(order) - 1)], 0])
        rows = order[at : at + max(1, min(4096, 4_000_000 // max(width, 1)))]
        at += len(rows)
        out[rows] = _band([left[i] for i in rows], [right[i] for i in rows], sizes[rows], edits)
    return out


def _band(left: list[np.ndarray], right: list[np.ndarray], sizes: np.ndarray, edits: int) -> np.ndarray:
    width, n, band = int(sizes.max(initial=0)), len(left), 2 * edits + 1
    a, b = np.full((width + 1, n), -1, np.int64), np.full((width + 2 * edits + 2, n), -2, np.int64)
    for i in range(n):
        a[: len(left[i]), i] = left[i]
        b[edits : edits + len(right[i]), i] = right[i]
    everything = np.uint64((1 << band) - 1)
    reach = [np.full(n, ((1 << (e + 1)) - 1) << edits & int(everything), np.uint64) for e in range(edits + 1)]
    done = np.zeros(n, bool)
    one, target = np.uint64(1), (sizes[:, 1] - sizes[:, 0] + edits).astype(np.uint64)
    for i in range(width + 1):
        ended = sizes[:, 0] == i
        if ended.any():
            done |= ended & ((reach[-1] >> target & one) == one)
        if i == width:
            break
        alike = np.zeros(n, np.uint64)
        for shift in range(band):
            alike |= (a[i] == b[i + shift]).astype(np.uint64) << np.uint64(shift)
        before = [each.copy() for each in reach]
        reach[0] = before[0] & alike
        for e in range(1, edits + 1):
            # A match, an exchange, a character left out of the left text, one put into it.
            reach[e] = (before[e] & alike) | before[e - 1] | (before[e - 1] >> one) | ((reach[e - 1] << one) & everything)
    return done


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b``: digests of the candidate pairs ``x, y`` that lie at most ``EDITS`` apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = lambda lines: [np.frombuffer(line.decode().encode("utf-32-le"), np.uint32).astype(np.int64) for line in lines]
        for batch in batches:
            for part in slices(batch, "left", TOGETHER):
                close = within(codes(column(part, "left").to_pylist()), codes(column(part, "right").to_pylist()), EDITS)
                yield pa.RecordBatch.from_arrays([column(part, "a"), column(part, "b")], ["a", "b"]).filter(pa.array(close))

    first, second = texts.toDF("x", "a", "left"), texts.toDF("y", "b", "right")
    both = pairs.distinct().join(first, "x").join(second, "y").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a binary, b binary")


def line_links(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """``a, b``: digests of linked lines. Lines that differ in one place only are linked by way of one of them."""
    entries = scanned.filter("line >= 0").select(
        F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long").alias("pointer"), F.explode(F.arrays_zip("places", "states")).alias("entry")
    )
    met = written(_meet(entries.select(F.col("entry.places").alias("place"), "pointer", F.col("entry.states").alias("state"))))
    wanted = written(met.select(F.explode(F.when(F.col("kind") == 0, F.array("x", "y")).otherwise(F.array("x"))).alias("pointer")).distinct())
    texts = _texts(docs, wanted)
    pairs = []
    while True:
        pairs.append(met.filter("kind = 0").select("x", "y"))
        crowd = met.filter("kind = 1").select(F.col("x").alias("pointer"), F.col("y").alias("state")).distinct()
        if crowd.isEmpty():
            break
        parted = written(_split(crowd, texts))
        pairs.append(_stars(parted.filter("leaf").distinct()))
        met = written(_meet(parted.filter("not leaf").drop("leaf")))
    return written(_verified(reduce(DataFrame.unionByName, pairs), texts))


def kept_lines(docs: DataFrame) -> DataFrame:
    """Which lines of every row stay when each class of linked lines keeps its first one.

    ``docs`` must have its row key. Returns the row's key, ``doc_id``, ``n_lines`` (lines that hold a
    word), ``n_kept``, ``n_linked`` (kept lines to which others are linked by edits) and ``kept``
    (numbers of the kept lines, from 0, over all lines). Lines are ordered by document id, rows
    without an id last, then by place in the files. Null and empty texts have no lines.
    """
    scanned = _scan(docs)
    roots = components(line_links(docs, scanned))
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", *ROW_KEY, "line")
    first = written(scanned.filter("line >= 0").groupBy("digest").agg(F.min(place).alias("place")).join(roots.withColumnRenamed("node", "digest"), "digest", "left"))
    alone = first.filter("root is null").select("place", F.lit(False).alias("linked"))
    classes = first.filter("root is not null").groupBy("root").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("linked"))
    kept = alone.unionByName(classes).groupBy(*[F.col(f"place.{name}").alias(name) for name in ROW_KEY]).agg(
        F.sort_array(F.collect_list("place.line")).alias("kept"), F.count_if("linked").cast("int").alias("n_linked")
    )
    whole = scanned.filter("line < 0").select("doc_id", *ROW_KEY, "n_lines")
    return whole.join(kept, ROW_KEY, "left").select(
        *ROW_KEY,
        "doc_id",
        "n_lines",
        F.coalesce(F.size("kept"), F.lit(0)).alias("n_kept"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.coalesce("kept", F.array().cast("array<int>")).alias("kept"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_kept, n_linked, kept`` of every row; see :func:`kept_lines`.

    ``kept`` is written as numbers joined by commas. Repeated rows come out as often as they came
    in; the lines of all but the first are gone.
    """
    found = kept_lines(with_row_key(docs.select("doc_id", "text")))
    return found.select("doc_id", *(F.col(n).cast("long").alias(n) for n in ("n_lines", "n_kept", "n_linked")), F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


@with_any_columns
def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` whose texts have lost the lines that an earlier line stands for.

    A row that loses all lines that hold a word is dropped; rows without any stay as they are.
    ``n_chars``, where there is such a column, follows the text.
    """
    rows = with_row_key(docs)
    changed = written(kept_lines(rows).filter("n_kept < n_lines").select(*ROW_KEY, F.col("kept").alias("__kept")))
    lines = F.split("text", "\n")
    stays = F.filter(lines, lambda line, i: F.array_contains("__kept", i) | ~line.rlike(r"\S"))
    joined = rows.join(beside(changed), ROW_KEY, "left").filter("__kept is null or size(__kept) > 0")
    text = F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(size))
    return out.select(*docs.columns)
