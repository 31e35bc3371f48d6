import re
from collections import Counter
from math import log

from plumbline.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, again, seen = len(words), 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {j for i in range(n - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return n, sum(map(len, words)), symbols, again, len(covered), n < 10 or 100 * len(covered) > 20 * n


def base(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed


def test_base_columns_agree_with_brute_force(table):
    docs = table("documents", "sf0.01")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality.rate(docs, table("labels", "sf0.01")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert base(row) == brute(texts[row.doc_id])
        assert not (row.base_failed and row.kept)


def test_odd_rows(odd_documents, table):
    rows = quality.rate(odd_documents, table("labels")).collect()
    assert sorted(map(base, rows)) == sorted(brute(r.text) for r in odd_documents.collect())


def test_good_documents_are_kept_and_junk_is_not(table):
    labels = {r.doc_id: r for r in table("labels", "sf0.1").collect()}
    rows = quality.rate(table("documents", "sf0.1"), table("labels", "sf0.1")).collect()
    good = [r for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 1 and not r.base_failed]
    junk = [r for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 0]
    assert sum(r.kept for r in good) >= 0.995 * len(good)
    assert sum(r.kept for r in junk) <= 0.2 * len(junk)


def test_score_is_the_mean_log_ratio(documents, spark):
    texts = ["a b c d e f g h i j k", "a b c", "z y x z y x w v u t", ""]
    docs = documents(list(enumerate(texts)), clashing=True)
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    grams = [(w := t.split()) + [" ".join(p) for p in zip(w, w[1:])] for t in texts]
    raw, target = Counter(g for each in grams for g in each), Counter(grams[0])
    buckets = 100_000
    total_raw, total_target = sum(raw.values()) + buckets, sum(target.values()) + buckets
    for row in quality.rate(docs, labels, buckets=buckets).collect():
        held = grams[row.doc_id]
        ratios = [log((target[g] + 1) / total_target) - log((raw[g] + 1) / total_raw) for g in held]
        assert abs(row.score - (sum(ratios) / len(held) if held else 0)) < 1e-5


def test_trusted_sample_is_bounded(table):
    labels = table("labels")
    ids = [r.doc_id for r in quality.trusted_ids(labels, 7).collect()]
    assert len(ids) == 7 and ids == [r.doc_id for r in quality.trusted_ids(labels, 7).collect()]


def test_empty_tables(spark, documents):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.rate(documents([]), labels).collect() == []
    row = quality.rate(documents([(1, "one two three four five six seven eight nine ten")]), labels).first()
    assert row.kept and abs(row.score) < 0.01
