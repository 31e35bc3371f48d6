"""Language-model scores: a word bigram model smoothed by deleted interpolation.

``P(word | before)`` mixes the maximum-likelihood bigram estimate with a unigram estimate. The share
of the bigram depends on how often the word before occurs: one weight for each doubling of that
frequency. The weights are learned by expectation-maximisation on counts from which the document at
hand is deleted, so every training document takes its turn as held-out data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, column
from plumbline.llm.tallies import answered, answers, blocks, expand, squeeze, told

#: Documents whose id has this remainder are not learned from.
FOLDS, HELD_OUT = 5, 1
#: What is added to every count of the unigram estimate.
ADDED = 0.5
#: Buckets of context frequency, one for each doubling.
FREQUENCIES = 48
#: Cells of the logarithm of bigram over unigram estimate: this many a unit, over this range.
CELLS, LOWEST, HIGHEST = 32, -24, 40

#: The key that stands for the end of a text; words hold no blank.
_END = xxhash.xxh64_intdigest(b" end") | 1


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Even 64-bit keys of word pairs; the keys of single words are odd."""
    mixed = before * np.uint64(0x9E3779B97F4A7C15) ^ (word + (before >> np.uint64(29)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))) & ~np.uint64(1)


def _block(batch: pa.RecordBatch) -> dict[str, bytes | int]:
    """The tokens of a block's documents, as places in its list of words; the end has place 0."""
    places: dict[bytes, int] = {}
    sizes, tokens = [], []
    for text in as_bytes(batch):
        words = text.lower().split()
        sizes.append(len(words) + 1)
        tokens.append(np.fromiter((places.setdefault(word, len(places) + 1) for word in words), np.int32, len(words)))
        tokens.append(np.zeros(1, np.int32))
    ids, held_out = column(batch, "doc_id").to_pylist(), column(batch, "held_out").to_pylist()
    return {
        "n_docs": len(sizes),
        "n_keys": sum(sizes),
        "words": squeeze(np.array([_END, *(xxhash.xxh64_intdigest(word) | 1 for word in places)], np.uint64)),
        "ids": squeeze(np.array([i or 0 for i in ids], np.int64)),
        "flags": squeeze(np.array([held + 2 * (i is None) for held, i in zip(held_out, ids, strict=True)], np.uint8)),
        "sizes": squeeze(np.array(sizes, np.int32)),
        "tokens": squeeze(np.concatenate(tokens)),
    }


_FIELDS = "n_docs bigint, n_keys bigint, words binary, ids binary, flags binary, sizes binary, tokens binary"


class _Tokens:
    """The tokens of a block: the keys of words and pairs, and each token's places among them."""

    def __init__(self, row: dict):
        self.flags, self.sizes = expand(row["flags"], np.uint8), expand(row["sizes"], np.int32)
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        word, token = expand(row["words"], np.uint64), expand(row["tokens"], np.int32)
        # A text's first word follows an end; so does the block's first token, whose last one is an end.
        before = np.concatenate([token[-1:], token[:-1]])
        singles, place = np.unique(word, return_inverse=True)
        place = place.astype(np.int32)
        pairs, self.pair = np.unique(_pair_keys(word[before], word[token]), return_inverse=True)
        self.single, self.before, self.pair = place[token], place[before], self.pair.astype(np.int32)
        self.singles, self.pairs = singles, pairs

    def listed(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys in order, and how often each occurs in documents that are learned from."""
        learned = (self.flags & 1)[self.doc] == 0
        counts = [np.bincount(place[learned], minlength=len(keys)) for place, keys in ((self.single, self.singles), (self.pair, self.pairs))]
        keys = np.concatenate([self.singles, self.pairs])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate(counts).astype(np.uint32)[order]


def _sums(keys: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[str, int]]:
    names, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, weights, minlength=len(names)).astype(np.uint64)
    words = (names & np.uint64(1)).astype(bool)
    return total[place], {"tokens": int(total[words].sum()), "known": int(np.count_nonzero(total[words]))}


class _Counts(_Tokens):
    """The corpus counts of every token of a block: of its word, of the word before and of the pair."""

    def __init__(self, row: dict):
        super().__init__(row)
        total = np.empty(len(self.singles) + len(self.pairs), np.uint64)
        total[np.argsort(np.concatenate([self.singles, self.pairs]), kind="stable")] = told(row["answers"], np.uint64)
        singles, pairs = total[: len(self.singles)], total[len(self.singles) :]
        self.word, self.context, self.both = singles[self.single], singles[self.before], pairs[self.pair]

    def deleted(self) -> tuple[np.ndarray, ...]:
        """The counts without the token's own document, for tokens of documents that were learned from."""
        learned = np.flatnonzero((self.flags & 1)[self.doc] == 0)
        doc = self.doc[learned].astype(np.int64) << 32
        word, context, both = (self._less(doc, total, place, learned) for total, place in ((self.word, self.single), (self.context, self.before), (self.both, self.pair)))
        return word, context, both, self.sizes[self.doc[learned]]

    @staticmethod
    def _less(doc: np.ndarray, total: np.ndarray, place: np.ndarray, learned: np.ndarray) -> np.ndarray:
        _, own, n = np.unique(doc | place[learned], return_inverse=True, return_counts=True)
        return total[learned].astype(np.int64) - n[own]


def _frequency(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), FREQUENCIES - 1)


def _histogram(table: DataFrame, tokens: int, known: int) -> dict[tuple[int, int], float]:
    """How often each ratio of the two deleted estimates occurs at each context frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                word, context, both, size = _Counts(row).deleted()
                seen = context > 0
                word, context, both, size = word[seen], context[seen], both[seen], size[seen]
                single = (word + ADDED) / (tokens - size + ADDED * (known + 1))
                ratio = both / context / single
                cell = np.where(both > 0, np.clip(np.log(np.maximum(ratio, 1e-30)), LOWEST, HIGHEST - 0.01) * CELLS - LOWEST * CELLS, -1)
                found, n = np.unique((_frequency(context) << 32) + np.floor(cell).astype(np.int64) + 1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["cell", "n"])

    rows = table.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return {(row["cell"] >> 32, (row["cell"] & 0xFFFFFFFF) - 1): float(row["n"]) for row in rows}


def mixture_weights(histogram: dict[tuple[int, int], float], rounds: int = 200) -> np.ndarray:
    """The bigram's weight at each context frequency, by expectation-maximisation.

    A frequency without evidence takes the weight of the nearest lower one that has some, the
    lowest ones that of the nearest higher one; without any evidence all weights are zero.
    """
    weights = np.full(FREQUENCIES, np.nan)
    for frequency in range(FREQUENCIES):
        cells = [(cell, n) for (f, cell), n in histogram.items() if f == frequency]
        if not cells:
            continue
        ratio = np.array([np.exp((cell + 0.5) / CELLS + LOWEST) if cell >= 0 else 0.0 for cell, _ in cells])
        n = np.array([count for _, count in cells])
        weight = 0.5
        for _ in range(rounds):
            later = float((n * (weight * ratio / (weight * ratio + 1 - weight))).sum() / n.sum())
            later = min(max(later, 1e-6), 1 - 1e-6)
            if abs(later - weight) < 1e-9:
                break
            weight = later
        weights[frequency] = weight
    found = np.flatnonzero(~np.isnan(weights))
    if not len(found):
        return np.zeros(FREQUENCIES)
    nearest = np.maximum(np.searchsorted(found, np.arange(FREQUENCIES), side="right") - 1, 0)
    return weights[found[nearest]]


def score(docs: DataFrame) -> DataFrame:
    """The score of every row of ``docs`` under a model of all rows outside the held-out fold.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (both scores
    are log10 probabilities of the whole text with its end). Null and empty texts are one token,
    the end. A row without an id is learned from. Repeated rows count as often as they occur. If
    nothing is learned from, both scores spread evenly over one unknown word.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    packed = blocks(rows, _block, _FIELDS)
    pieces = answers(packed, lambda row: _Tokens(row).listed(), _sums, ("tokens", "known"))
    sums = pieces.agg(F.sum("tokens"), F.sum("known")).first()
    tokens, known = int(sums[0] or 0), int(sums[1] or 0)
    table = answered(packed, pieces)
    weights = mixture_weights(_histogram(table, tokens, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts, n = _Counts(row), row["n_docs"]
                single = (counts.word + ADDED) / (tokens + ADDED * (known + 1))
                bigram = counts.both / np.maximum(counts.context, 1)
                weight = np.where(counts.context > 0, weights[_frequency(counts.context)], 0.0)
                total = lambda values: np.bincount(counts.doc, values, minlength=n)  # noqa: E731, B023
                missing = (counts.flags & 2).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(expand(row["ids"], np.int64), mask=missing),
                        pa.array((counts.flags & 1).astype(bool)),
                        pa.array(counts.sizes.astype(np.int64)),
                        pa.array(total(counts.word > 0).astype(np.int64)),
                        pa.array(np.full(n, tokens, np.int64)),
                        pa.array(total(np.log10(single))),
                        pa.array(total(np.log10(weight * bigram + (1 - weight) * single))),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return table.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
