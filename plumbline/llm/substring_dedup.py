"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text; its upper bits depend on the last sixteen bytes only.
Where they fall below a bound, a chunk ends, so a passage is cut alike wherever it stands, and an
insertion moves no boundary beyond the chunks it touches. At every chunk begins a window, which ends
with the first chunk that makes it hold enough words. Chunks and windows are compared by digest over
the whole corpus, windows by all their bytes. A passage is a union of overlapping windows, each of
which stands as a whole at another place; chunks that recur by chance, one by one, make none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ROW_KEY, as_bytes, beside, column, with_any_columns, with_row_key, written
from plumbline.llm.tallies import answered, answers, blocks, expand, expand_sorted, squeeze, squeeze_sorted, told

#: Bytes in a chunk on average, and at most.
MEAN, LONGEST = 20, 1024
#: A window, the least passage, holds this many words.
LEAST_WORDS = 20

#: The gear table: one number for each byte, made from digests.
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([byte]), 7) & 0xFFFF for byte in range(256)], np.uint16)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Zero bytes between texts, so that no hash reaches into another text.
_APART = b"\0" * 16


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Places in ``data`` (bytes) where the gear hash ends a chunk; never inside a character."""
    hashed = _GEAR[data]
    for step in (1, 2, 4, 8):
        hashed[step:] += hashed[:-step].copy() << np.uint16(step)
    ends = np.flatnonzero(hashed < 65536 // MEAN) + 1
    ends = ends[ends < len(data)]
    return ends[(data[ends] & 0xC0) != 0x80]


def _cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Document, begin and end of every chunk, and the bytes they lie in."""
    if not texts:
        none = np.zeros(0, np.int64)
        return none, none, none, b""
    whole = _APART + _APART.join(texts) + _APART
    data = np.frombuffer(whole, np.uint8)
    sizes = np.array([len(text) for text in texts], np.int64)
    first = np.cumsum(sizes + len(_APART)) - sizes
    last = first + sizes
    ends = np.unique(np.concatenate([chunk_ends(data), last]))
    doc = np.searchsorted(first, ends, side="left") - 1
    inside = (doc >= 0) & (ends <= last[np.maximum(doc, 0)]) & (sizes[np.maximum(doc, 0)] > 0)
    ends, doc = ends[inside], doc[inside]
    begins = np.maximum(np.concatenate([[0], ends[:-1]]), first[doc])
    return *_shorter(data, doc, begins, ends), whole


def _shorter(data: np.ndarray, doc: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chunks of more than ``LONGEST`` bytes cut from their begin on, at characters."""
    parts = np.maximum(1, -(-(ends - begins) // LONGEST))
    if parts.max(initial=1) == 1:
        return doc, begins, ends
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = np.repeat(begins, parts) + place * LONGEST
    for _ in range(3):
        cuts = np.where((place > 0) & ((data[cuts] & 0xC0) == 0x80), cuts - 1, cuts)
    final = place == np.repeat(parts, parts) - 1
    until = np.where(final, np.repeat(ends, parts), np.concatenate([cuts[1:], [0]]))
    return np.repeat(doc, parts), cuts, until


def _block(batch: pa.RecordBatch, least_words: int = LEAST_WORDS) -> dict[str, bytes | int]:
    texts = as_bytes(batch)
    doc, begins, ends, whole = _cut(texts)
    view = memoryview(whole)
    digests = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], np.uint64)
    blank = _SPACE[np.frombuffer(whole, np.uint8)] | (np.frombuffer(whole, np.uint8) == 0)
    starts = np.cumsum(~blank[1:] & blank[:-1])
    words = np.diff(np.concatenate([[0], starts]))
    word_count = np.concatenate([[0], np.cumsum(words)])
    spans = word_count[ends - 1] - word_count[np.maximum(begins - 1, 0)]
    # A window counts words by its own bytes only, so it ends alike wherever it stands.
    wanted = word_count[begins] - ~blank[begins] + max(1, least_words)
    until = np.searchsorted(word_count[ends - 1], wanted)
    opens = np.flatnonzero(until < len(ends))
    opens = opens[doc[until[opens]] == doc[opens]]
    until = until[opens]
    windows = np.array([xxhash.xxh3_64_intdigest(view[a:b], 1) for a, b in zip(begins[opens].tolist(), ends[until].tolist(), strict=True)], np.uint64)
    keys, place = np.unique(np.concatenate([digests, windows]), return_inverse=True)
    # Of a key: twice the documents that hold it, and one more where it stands twice in one of them.
    own = np.unique(place.astype(np.int64) << 32 | np.concatenate([doc, doc[opens]])) >> 32
    held = np.bincount(own, minlength=len(keys))
    weights = held * 2 + (np.bincount(place, minlength=len(keys)) > held)
    lengths = np.zeros(len(ends), np.int32)
    lengths[opens] = until - opens + 1
    ids = column(batch, "doc_id").to_pylist()
    return {
        "n_docs": len(texts),
        "n_keys": len(keys),
        "keys": squeeze_sorted(keys),
        "weights": squeeze(weights.astype(np.uint32)),
        "ids": squeeze(np.array([i or 0 for i in ids], np.int64)),
        "missing": squeeze(np.array([i is None for i in ids], np.uint8)),
        **{name.strip("_"): squeeze(column(batch, name).to_numpy()) for name in ROW_KEY},
        "chunks": squeeze(np.bincount(doc, minlength=len(texts)).astype(np.int32)),
        "places": squeeze(place.astype(np.int32)),
        "sizes": squeeze((ends - begins).astype(np.int32)),
        "words": squeeze(spans.astype(np.int32)),
        "lengths": squeeze(lengths),
    }


_FIELDS = "n_docs bigint, n_keys bigint, keys binary, weights binary, ids binary, missing binary, file binary, at binary, chunks binary, places binary, sizes binary, words binary, lengths binary"

#: What is known of a chunk or window: it stands at one place; in several documents, here first; in several, elsewhere before; or more than once in one document.
_ONCE, _FIRST, _AGAIN, _OWN = 0, 1, 2, 3


def _known(keys: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[str, int]]:
    _, first, place = np.unique(keys, return_index=True, return_inverse=True)
    many = np.bincount(place, weights >> 1)[place] > 1
    found = np.where(many, _AGAIN, np.where(weights & 1, _OWN, _ONCE)).astype(np.uint8)
    found[first[many[first]]] = _FIRST
    return found, {}


def _first_places(place: np.ndarray) -> np.ndarray:
    """Whether no earlier entry has the same number."""
    first = np.zeros(len(place), bool)
    first[np.unique(place, return_index=True)[1]] = True
    return first


def _passages(row: dict) -> list[tuple]:
    """Per document of a block: chunks, repeated chunks, words, words in passages, the longest, spans, later spans, whether another row or this row holds one of them again."""
    known, place = told(row["answers"], np.uint8), expand(row["places"], np.int32)
    chunks, sizes, words, lengths = (expand(row[name], np.int32) for name in ("chunks", "sizes", "words", "lengths"))
    repeated = known[place[: len(sizes)]] != _ONCE
    opens = np.flatnonzero(lengths)
    until = opens + lengths[opens]
    place = place[len(sizes) :]
    state = known[place].copy()
    abroad = (state == _FIRST) | (state == _AGAIN)
    state[state == _OWN] = _FIRST
    # Of a window seen here first, only the first place keeps that state.
    state[(state == _FIRST) & ~_first_places(place)] = _AGAIN
    bounds = np.concatenate([[0], np.cumsum(chunks)])
    among = np.searchsorted(opens, bounds)
    out = []
    for i in range(len(chunks)):
        (a, b), (c, d) = bounds[i : i + 2], among[i : i + 2]
        offsets = np.concatenate([[0], np.cumsum(sizes[a:b])])
        count = np.concatenate([[0], np.cumsum(words[a:b])])
        begins, ends, of = opens[c:d] - a, until[c:d] - a, state[c:d]
        later = _covered(begins[of == _AGAIN], ends[of == _AGAIN], b - a)
        # A later copy may overlap the first one (as in "again again again"), which stays whole.
        first = (of == _FIRST) & np.isin(place[c:d], place[c:d][of == _AGAIN])
        later &= ~_covered(begins[first], ends[first], b - a)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], later.astype(np.int8), [0]])))
        spans, gone = (
            [(int(offsets[x]), int(offsets[y]), int(count[y] - count[x])) for x, y in runs]
            for runs in (_unions(begins[of != _ONCE], ends[of != _ONCE]), zip(edge[::2], edge[1::2], strict=True))
        )
        out.append((int(b - a), int(np.count_nonzero(repeated[a:b])), int(count[-1]), sum(n for *_, n in spans), max((n for *_, n in spans), default=0), spans, gone, bool(abroad[c:d].any()), len(np.unique(place[c:d])) < d - c))
    return out


def _covered(begins: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` chunks lie in one of the windows."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, begins, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps)[:-1] > 0


def _unions(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """First chunk and end of each union of overlapping windows; windows come in order, and so do their ends."""
    if not len(begins):
        return []
    opens = np.concatenate([[True], begins[1:] >= ends[:-1]])
    return list(zip(begins[opens], ends[np.concatenate([opens[1:], [True]])], strict=True))


def passages(docs: DataFrame, least_words: int = LEAST_WORDS, keyed: bool = False) -> DataFrame:
    """Repeated passages of every row of ``docs``.

    Returns ``doc_id``, the row's key, ``n_chunks``, ``n_repeated_chunks`` (found at another place,
    of this row or another, as well), ``n_words``, ``repeated_words`` (words in passages), ``longest_words``, ``repeated`` (a
    passage stands in another row as well), ``repeated_within`` (one stands more than once in this row), ``spans`` (``begin:end`` of every passage in bytes of UTF-8, joined by commas) and
    ``later_spans`` (what windows cover that stand as a whole at an earlier place, of an earlier row or of this one, without the first place itself). Null and
    empty texts have no chunks. Repeated rows are copies of each other. ``keyed`` says that ``docs``
    has its row key already.
    """
    rows = (docs if keyed else with_row_key(docs.select("doc_id", "text"))).select(F.col("doc_id").cast("long").alias("doc_id"), *ROW_KEY, F.coalesce("text", F.lit("")).alias("text"))
    packed = blocks(rows, lambda batch: _block(batch, least_words), _FIELDS)
    keys = lambda row: (expand_sorted(row["keys"]), expand(row["weights"], np.uint32))
    table = answered(packed.drop("keys", "weights"), answers(packed.select("block", "n_keys", "keys", "weights"), keys, _known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = lambda spans: ",".join(f"{a}:{b}" for a, b, _ in spans)
        for batch in batches:
            for row in batch.to_pylist():
                found = _passages(row)
                chunks, repeated, words, inside, longest, spans, later, abroad, within = zip(*found, strict=True)
                numbers = [pa.array(each, pa.int64()) for each in (chunks, repeated, words, inside, longest)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(expand(row["ids"], np.int64), mask=expand(row["missing"], np.uint8).astype(bool)),
                        *(pa.array(expand(row[name.strip("_")], np.int64)) for name in ROW_KEY),
                        *numbers,
                        pa.array(abroad, pa.bool_()),
                        pa.array(within, pa.bool_()),
                        pa.array([joined(each) for each in spans], pa.string()),
                        pa.array([joined(each) for each in later], pa.string()),
                    ],
                    names,
                )

    schema = "doc_id bigint, __file bigint, __at bigint, n_chunks bigint, n_repeated_chunks bigint, n_words bigint, repeated_words bigint, longest_words bigint, repeated boolean, repeated_within boolean, spans string, later_spans string"
    names = [part.split()[0] for part in schema.split(", ")]
    return table.mapInArrow(run, schema)


@with_any_columns
def without_later_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` whose texts have lost every passage that stands at an earlier place, in the same row too; the first copy stays."""
    rows = with_row_key(docs)
    gone = written(passages(rows, least_words, keyed=True).filter("later_spans <> ''").select(*ROW_KEY, F.col("later_spans").alias("__later")))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(column(batch, "text").to_pylist(), column(batch, "__later").to_pylist(), strict=True):
                if spans:
                    data, kept, at = text.encode(), [], 0
                    for begin, end in (map(int, span.split(":")) for span in spans.split(",")):
                        kept.append(data[at:begin])
                        at = end
                    text = b"".join([*kept, data[at:]]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else column(batch, n) for n in names], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.join(beside(gone), ROW_KEY, "left").mapInArrow(run, schema)
