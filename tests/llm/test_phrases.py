import random
import re
from collections import Counter, defaultdict

import pytest

from plumbline.llm import phrases, queries


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def counted(rows):
    """Occurrences of all phrases of one to five words, by language."""
    found = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            for size in range(1, 6):
                for at in range(len(words) - size + 1):
                    found["und" if lang is None else lang][tuple(words[at : at + size])] += 1
    return found


def brute(rows, least=100, top=2000):
    out = []
    for lang, f in counted(rows).items():
        n = sum(k for phrase, k in f.items() if len(phrase) == 1)
        often = {phrase: k for phrase, k in f.items() if k >= least}
        covered = Counter()
        for phrase, k in often.items():
            for size in range(2, len(phrase)):
                for at in range(len(phrase) - size + 1):
                    part = phrase[at : at + size]
                    covered[part] = max(covered[part], k)
        scored = []
        for phrase, a in often.items():
            if len(phrase) > 1 and covered[phrase] < a:
                cuts = [(1000 * a * n // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def result(frame):
    return sorted(tuple(row) for row in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_given_documents_agree_with_brute_force(spark, table):
    rows = [(row.lang, row.text) for row in table("documents", "sf0.01").collect()]
    expected = brute(rows)
    assert len(expected) > 50
    assert result(queries.op13_collocations(spark, "/root/testdata/sf0.01")) == expected


@pytest.mark.parametrize("least, budget", [(2, 2_000_000), (2, 400), (3, 40), (100, 8), (5, 2000)])
def test_groups_of_any_size_count_alike(spark, table, least, budget):
    rows = table("documents").select("lang", "text").limit(60).collect()
    rows = [tuple(row) for row in rows] + [("en", "the same passage of words again and again " * 150), (None, "the same passage")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string")
    found, totals = phrases.frequent_phrases(docs, least, budget)
    expected = {(lang, " ".join(p), k) for lang, f in counted(rows).items() for p, k in f.items() if k >= least}
    assert {tuple(row) for row in found.collect()} == expected
    assert found.count() == len(expected)
    assert {row.lang: row.n for row in totals.collect()} == {lang: sum(k for p, k in f.items() if len(p) == 1) for lang, f in counted(rows).items()}


def test_heavy_prefixes_are_cut_and_groups_keep_to_the_budget(spark, documents):
    rng = random.Random(9)
    text = " ".join(rng.choices(["a", "b", "c", "d"], [60, 20, 10, 10], k=6000))
    blocks = phrases._read(documents([(1, text)]))
    words = text.split()
    pairs = Counter(zip(words, words[1:]))
    known = phrases._keyed(spark.createDataFrame([("en", " ".join(p), n) for p, n in pairs.items()], "lang string, phrase string, f bigint"))
    heavy, groups = phrases._vertical(blocks, known, 2, 5, phrases._filter(known), 1600)
    assert len(heavy) == 3 and all(len(names) for names in heavy)
    sizes = Counter()
    for row in phrases._pieces(blocks, 3, 5, phrases._filter(known), heavy, groups).collect():
        sizes[row.grp] += len(phrases.expand(row.depths, phrases.np.uint8))
    assert len(sizes) > 4
    assert max(sizes.values()) <= 1600


def test_scores_take_the_lowest_cut_and_leave_covered_phrases_out(documents):
    rows = [(1, "new york city, " * 150 + "new york. " * 30 + "city hall! " * 120 + "new deal; " * 100)]
    found = {row.phrase: row for row in phrases.collocations(documents(rows)).collect()}
    assert set(found) == {"new york city", "new york", "city hall", "new deal"}
    assert (found["new york city"].l, found["new york city"].r) in {(280, 150), (180, 270)}
    assert result(phrases.collocations(documents(rows))) == brute([("en", rows[0][1])])


def test_only_the_top_is_ranked(documents):
    rng = random.Random(2)
    text = " . ".join(" ".join(rng.choices("abcdefgh", k=6)) for _ in range(3000))
    for top in (1, 7):
        assert result(phrases.collocations(documents([(1, text)]), least=20, top=top)) == brute([("en", text)], 20, top)


def test_long_products_stay_exact(spark, monkeypatch):
    big = 5 * 10**12
    f = [("en", "x", big), ("en", "y", 3 * big), ("en", "x y", big - 1)]
    found = spark.createDataFrame(f, "lang string, phrase string, f bigint")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n bigint")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: (found, totals))
    (row,) = phrases.collocations(found).collect()
    assert row.score == 1000 * (big - 1) * 9 * big // (3 * big * big)


def test_a_filter_admits_what_it_was_made_of(spark, monkeypatch):
    rows = [("en" if i % 2 else "de", f"w{i} v{i % 7}", i) for i in range(500)]
    keyed = phrases._keyed(spark.createDataFrame(rows, "lang string, phrase string, f bigint"))
    keys = phrases._phrase_keys([r[0] for r in rows], [r[1] for r in rows])
    others = phrases._phrase_keys(["fr"] * 500, [r[1] for r in rows])
    bits = phrases._filter(keyed)
    assert phrases._admitted(bits, keys).all()
    assert phrases._admitted(bits, others).sum() < 5


def test_a_crowded_filter_loses_nothing(spark, table, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 256)
    rows = [tuple(row) for row in table("documents").select("lang", "text").limit(40).collect()]
    docs = spark.createDataFrame(rows, "lang string, text string")
    found, _ = phrases.frequent_phrases(docs, 3, 500)
    assert {tuple(row) for row in found.collect()} == {(lang, " ".join(p), k) for lang, f in counted(rows).items() for p, k in f.items() if k >= 3}


def test_odd_rows(odd_documents):
    rows = [(row.lang, row.text) for row in odd_documents.collect()]
    assert result(phrases.collocations(odd_documents, least=2)) == brute(rows, 2)


def test_odd_languages_and_control_characters(spark):
    rows = [("a\tb\n", "x\x0by\x0cx\x1cy z\x1cw " * 3), ("", "p q r " * 4), (None, "p q r! " * 4), ("und", "p q\tr\r" * 4)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert result(phrases.collocations(docs, least=2)) == brute(rows, 2)


def test_empty_table(documents):
    assert phrases.collocations(documents([])).collect() == []
    assert phrases.collocations(documents([(1, None), (2, ""), (3, "...")])).collect() == []


def test_rarer_phrases_of_given_documents(table):
    rows = [(row.lang, row.text) for row in table("documents").collect()]
    expected = brute(rows, 10, 500)
    assert len(expected) > 300
    assert result(phrases.collocations(table("documents"), least=10, top=500, budget=5000)) == expected
