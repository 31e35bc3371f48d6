"""Toxicity as severity grades, by cumulative-link ordinal regression on sparse text features.

For grades 0..K the model holds one weight per feature and K ordered thresholds:
``P(grade > k) = logistic(w.x - t_k)``. All thresholds share the weights. The expected severity
is the sum of ``P(grade > k)`` over k.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, column, slices, with_any_columns

#: At most this many labelled documents are fitted: those whose ids have the smallest digests.
SAMPLE = 6000
#: A feature must occur in this many documents of the sample to get a weight.
MIN_DOCUMENTS = 3
#: Strength of the penalties on absolute and on squared weights.
L1, L2 = 0.0001, 0.00002
#: A document is toxic if its expected severity is above this.
REJECT_ABOVE = 0.4
#: Lengths of the word beginnings used as features, beside whole words.
BEGINNINGS = (4, 5, 6)
#: Features are numbered by hash.
FEATURE_BITS = 24

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Numbers of a lower-case word and of its beginnings; inflected forms share beginnings."""
    parts = [word, *(word[:size] + "-" for size in BEGINNINGS if len(word) > size)]
    return [xxhash.xxh32_intdigest(part) >> (32 - FEATURE_BITS) for part in parts]


def features(text: str) -> set[int]:
    """The features of a text, each once."""
    return {feature for word in set(_WORD.findall(text.lower())) for feature in word_features(word)}


def severity_grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` from binary labels: 0 not toxic, 1 toxic, 2 toxic and of low quality.

    A document labelled more than once gets its highest grade; rows without an id or a toxic label
    give none.
    """
    grade = F.when(F.col("toxic") == 0, 0).otherwise(F.when(F.col("quality") == 0, 2).otherwise(1))
    return labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(grade).alias("grade"))


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def scorer(self):
        """A function from a text to ``P(grade > k)`` for every threshold k; it remembers words."""
        weights, thresholds, known = self.weights, np.array(self.thresholds), {}

        def probabilities(text: str) -> list[float]:
            if len(known) > 500_000:
                known.clear()
            seen: set[int] = set()
            for word in set(_WORD.findall(text.lower())):
                held = known.get(word)
                if held is None:
                    held = known[word] = tuple(f for f in word_features(word) if f in weights)
                if held:
                    seen.update(held)
            return _sigmoid(sum(weights[f] for f in sorted(seen)) - thresholds).tolist()

        return probabilities


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_grades(examples: list[tuple[np.ndarray, int]], rounds: int = 300) -> OrdinalModel:
    """The model of ``(features, grade)`` rows, by accelerated proximal gradient steps.

    With one grade only, no weight is learned and the thresholds follow the share of the grades;
    without rows nothing is toxic.
    """
    grades = np.array([grade for _, grade in examples], np.int64)
    n, top = len(grades), int(max([1, *grades]))
    if not n:
        return OrdinalModel({}, (40.0,))
    above = np.array([(np.sum(grades > k) + 0.5) / (n + 1) for k in range(top)])
    thresholds = np.maximum.accumulate(np.log((1 - above) / above))
    if len(set(grades.tolist())) < 2:
        return OrdinalModel({}, tuple(thresholds.tolist()))
    rows = np.repeat(np.arange(n), [len(found) for found, _ in examples])
    names, cols, counts = np.unique(np.concatenate([found for found, _ in examples]), return_inverse=True, return_counts=True)
    # Features that barely move the fit of the thresholds alone would get no weight under the penalty.
    pull, _ = _slopes(np.zeros(n), thresholds, grades)
    wanted = (counts >= MIN_DOCUMENTS) & (np.abs(np.bincount(cols, pull[rows], minlength=len(names))) > L1 / 2)
    lengths = np.bincount(rows, wanted[cols], minlength=n)
    place = np.cumsum(wanted) - 1
    rows, cols = rows[wanted[cols]], place[cols[wanted[cols]]]
    weights, thresholds = _descend(rows, cols, lengths, grades, np.zeros(int(wanted.sum())), thresholds, rounds)
    held = {int(name): float(weight) for name, weight in zip(names[wanted], weights, strict=True) if weight}
    return OrdinalModel(held, tuple(thresholds.tolist()))


def _slopes(score: np.ndarray, thresholds: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How the mean loss changes with each document's score, and with each threshold."""
    n, top = len(grades), len(thresholds)
    p = np.concatenate([np.ones((n, 1)), _sigmoid(score[:, None] - thresholds[None, :]), np.zeros((n, 1))], axis=1)
    slope, each = p * (1 - p), np.arange(n)
    low, high = slope[each, grades], slope[each, grades + 1]
    mass = np.maximum(p[each, grades] - p[each, grades + 1], 1e-9) * n
    numbers = np.arange(top)[None, :]
    moved = np.where(numbers == grades[:, None] - 1, low[:, None], 0) - np.where(numbers == grades[:, None], high[:, None], 0)
    return (high - low) / mass, (moved / mass[:, None]).sum(axis=0)


def _descend(rows, cols, lengths, grades, weights, thresholds, rounds):
    n = len(grades)
    # Each weight's step is bounded by the lengths of the documents that hold its feature.
    step = 4.0 * n / np.maximum(1.0, np.bincount(cols, lengths[rows] + 1.0, minlength=len(weights)))
    seen_w, seen_t, pace = weights.copy(), thresholds.copy(), 1.0
    for _ in range(rounds):
        score = np.bincount(rows, seen_w[cols], minlength=n)
        by_score, by_threshold = _slopes(score, seen_t, grades)
        new_w = seen_w - step * (np.bincount(cols, by_score[rows], minlength=len(weights)) + L2 * seen_w)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * L1, 0)
        new_t = np.maximum.accumulate(np.clip(seen_t - by_threshold, -30, 30))
        moved = max(np.abs(new_w - weights).max(initial=0), np.abs(new_t - thresholds).max())
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        drift = (pace - 1) / faster
        seen_w, seen_t = new_w + drift * (new_w - weights), np.maximum.accumulate(new_t + drift * (new_t - thresholds))
        weights, thresholds, pace = new_w, new_t, faster
        if moved < 1e-4:
            break
    return weights, thresholds


def fit(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents, those whose ids have the smallest digests.

    Of rows that share an id, the one whose text has the smallest digest counts.
    """
    chosen = grades.filter("doc_id is not null and grade is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.filter("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("grade").cast("int").alias("grade"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [np.sort(np.fromiter(features(text), np.int32)).tobytes() for text in column(part, "text").to_pylist()]
                digests = pa.array([xxhash.xxh3_128_digest(text) for text in as_bytes(part)], pa.binary())
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), digests, pa.array(found, pa.binary()), column(part, "grade")], ["doc_id", "digest", "features", "grade"])

    kind = known.schema["doc_id"].dataType.simpleString()
    found = known.mapInArrow(each, f"doc_id {kind}, digest binary, features binary, grade int")
    rows = found.groupBy("doc_id").agg(F.min_by(F.struct("features", "grade"), "digest").alias("row")).select("row.*").collect()
    return fit_grades(sorted(((np.frombuffer(row["features"], np.int32), row["grade"]) for row in rows), key=lambda e: (e[1], e[0].tobytes())))


def score(docs: DataFrame, model: OrdinalModel, reject_above: float = REJECT_ABOVE) -> DataFrame:
    """All columns of ``docs`` and ``severity``, ``grade`` (the likeliest) and ``toxic``.

    A null or empty text is scored by the thresholds alone.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probabilities = model.scorer()
        for batch in batches:
            for part in slices(batch):
                chances = [probabilities(text or "") for text in column(part, "text").to_pylist()]
                severity = [sum(each) for each in chances]
                grade = [int(np.argmax(-np.diff([1.0, *each, 0.0]))) for each in chances]
                own = [pa.array(severity, pa.float64()), pa.array(grade, pa.int32()), pa.array([s > reject_above for s in severity], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *own], [*part.schema.names, "severity", "grade", "toxic"])

    return docs.mapInArrow(each, f"{fields}, severity double, grade int, toxic boolean")


def grade_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, severity, grade, toxic`` of every row, by the model that ``labels`` teach.

    Empty tables give an empty result; without usable labels the severity is the same for all and
    nothing is toxic unless most labels are.
    """
    model = fit(docs, severity_grades(labels), sample)
    return score(docs.select("doc_id", "text"), model).select("doc_id", "severity", "grade", "toxic")


@with_any_columns
def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows graded toxic."""
    model = fit(docs, severity_grades(labels), sample)
    flags = score(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return flags.filter("not toxic").select("row.*")
