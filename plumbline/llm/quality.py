"""Quality rules: base rules on words and repetition, and a log-likelihood ratio of hashed n-grams.

Single words and word pairs are hashed to a fixed number of buckets. Two multinomials over the
buckets are counted: one of trusted documents, one of the whole raw corpus. A document's score is
the mean over its n-grams of the logarithm of the ratio of the two. Every document is held against
one threshold, so equal texts get equal verdicts. All of it is DataFrame operations.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of hashed n-grams.
BUCKETS = 10_000
#: At most this many trusted documents define the target: those whose ids have the smallest digests.
SAMPLE = 20_000
#: Documents whose mean log ratio is below this are not kept.
THRESHOLD = -0.08
#: A base rule: fewer words fail.
LEAST_WORDS = 10
#: A base rule: windows of this many words found again, and the percentage of words in them that fails.
WINDOW, MOST_REPEATED = 5, 20

_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Runs of characters that are not ASCII white space."""
    return F.filter(F.split(text, _SPACE), lambda word: word != "")


def _repeated(windows: Column) -> Column:
    """How many words stand in windows (given by their hashes, in order) that are found twice."""

    def covered(places: Column) -> Column:
        each = F.transform(
            places, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - at, F.lit(WINDOW)))
        )
        return F.aggregate(each, F.lit(0).cast("long"), lambda total, n: total + n)

    def found_twice(ranked: Column) -> Column:
        return F.filter(ranked, lambda w, i: (w["hash"] == F.get(ranked, i - 1)["hash"]) | (w["hash"] == F.get(ranked, i + 1)["hash"]))

    ranked = F.sort_array(F.transform(windows, lambda hash_, i: F.struct(hash_.alias("hash"), i.alias("at"))))
    places = _let(ranked, lambda r: F.sort_array(F.transform(found_twice(r), lambda w: w["at"])))
    count = _let(places, covered)
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), count).otherwise(F.lit(0).cast("long"))


def _hashed(docs: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns, ``__text``, ``__words``, ``__hashes`` (of each word) and ``__n``."""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    rows = rows.withColumn("__words", words_of(F.col("__text")))
    return rows.withColumns({"__hashes": F.transform("__words", lambda word: F.xxhash64(word)), "__n": F.size("__words")})


def _buckets(buckets: int) -> Column:
    """Buckets of all single words and word pairs."""
    pairs = F.zip_with(
        F.slice("__hashes", F.lit(1), F.greatest(F.col("__n") - 1, F.lit(0))),
        F.slice("__hashes", F.lit(2), F.greatest(F.col("__n") - 1, F.lit(0))),
        lambda left, right: F.pmod(F.xxhash64(left, right), F.lit(buckets)).cast("int"),
    )
    singles = F.transform("__hashes", lambda word: F.pmod(word, F.lit(buckets)).cast("int"))
    return F.concat(singles, pairs)


def trusted_ids(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` ids labelled as of high quality and not toxic."""
    good = labels.filter("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """The logarithm of the ratio of target to raw probability of every bucket.

    Both multinomials are smoothed by one count a bucket. Without trusted documents all ratios
    are one.
    """
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted.select(F.col("doc_id").alias("__trusted"))), F.col("doc_id") == F.col("__trusted"), "left"
    )
    grams = _hashed(marked.withColumn("__good", F.col("__trusted").isNotNull().cast("long")), "__good").select(
        "__good", F.explode(_buckets(buckets)).alias("bucket")
    )
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("__good").alias("target")).collect()
    raw, target = [1.0] * buckets, [1.0] * buckets
    for row in counts:
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    if sum(target) == buckets:
        return [0.0] * buckets
    total = sum(raw) / sum(target)
    return [log(t / r * total) for t, r in zip(target, raw, strict=True)]


def rate(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, the base rules, the score and the verdict of every row of ``docs``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score, kept``. A null text is the empty one: no words, score 0, base rules failed. Repeated
    rows get the same verdict each. Without labels all ratios are one, so every document that
    passes the base rules is kept.
    """
    ratios = log_ratios(docs, trusted_ids(labels, sample), buckets)
    table = F.split(F.lit(",".join(f"{ratio:.7f}" for ratio in ratios)), ",").cast("array<double>")
    rows = _hashed(docs, "doc_id")
    lines = F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(
        F.col("__n") > WINDOW,
        F.transform(F.sequence(F.lit(1), F.greatest(F.col("__n") - WINDOW + 1, F.lit(1))), lambda at: F.xxhash64(F.slice("__hashes", at, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    grams = F.greatest(2 * F.col("__n") - 1, F.lit(1))
    rows = rows.withColumns({"__lines": lines, "__windows": windows, "__grams": _buckets(buckets)})
    rows = rows.select(
        "doc_id",
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("__windows")).alias("n_repeat_words"),
        (F.aggregate("__grams", F.lit(0.0), lambda total, bucket: total + F.get(table, bucket)) / grams).alias("score"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
