import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import queries, spelling


def counted(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {word: n for word, n in total.items() if len(word) >= 7 and n >= 2}


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def neighbours(words):
    """Near words by way of all words with a place left out: words that share one are compared."""
    left_out, near = defaultdict(set), {word: set() for word in words}
    for word in words:
        for key in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}:
            left_out[key].add(word)
    for group in left_out.values():
        for a in group:
            near[a] |= {b for b in group if b != a and distance_one(a, b)}
    return near


def brute(n):
    near = neighbours(n)
    form = {}
    for word in n:
        best = min(near[word], key=lambda v: (-n[v], v), default=None)
        form[word] = best if best is not None and n[best] >= 10 * n[word] else None
    out = []
    for word in n:
        root = word
        while form[root] is not None:
            root = form[root]
        out.append((word, form[word], root, n[word], len(near[word]), n[form[word]] if form[word] else None))
    return sorted(out)


def result(frame):
    return sorted(tuple(row) for row in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_given_documents_agree_with_brute_force(spark, table):
    rows = [(row.doc_id, row.text) for row in table("documents", "sf0.01").collect()]
    expected = brute(counted(rows))
    assert any(row[4] > 3 for row in expected) and any(row[1] for row in expected)
    assert result(queries.op11_spelling_variants(spark, "/root/testdata/sf0.01")) == expected


def invented(rng, size, alphabet="abé"):
    words = {"".join(rng.choices(alphabet, k=rng.randint(7, 10))) for _ in range(size)}
    words |= {"a" * 7, "a" * 8, "a" * 9, "ab" * 4, "ab" * 4 + "a", "b" * 40, "b" * 41, "b" * 20 + "a" + "b" * 20, "cccccccc" * 20, "cccccccc" * 20 + "d"}
    return sorted(words)


@pytest.mark.parametrize("crowd, cell", [(20_000, 24_000), (4, 24_000), (1, 60), (60, 300)])
def test_crowds_lose_and_repeat_no_pair(spark, crowd, cell):
    rng = random.Random(crowd)
    words = invented(rng, 700)
    n = {word: rng.choice([2, 3, 3, 30, 500]) for word in words}
    near = neighbours(words)
    expected = sorted((w, len(near[w]), *min((-n[v], v) for v in near[w])) for w in words if near[w])
    frame = spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n bigint"), crowd, cell)
    assert sorted((row.word, row.n_near, -row.near_n, row.near) for row in frame.collect()) == expected


def test_a_large_crowd_that_shares_both_ends(spark):
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    words = ["prefix" + a + b + "suffix" for a in letters[:40] for b in letters[:12]] + ["prefix" + a + "suffix" for a in letters]
    near = neighbours(words)
    rows = spelling.crowds(spark.createDataFrame([(w, 2) for w in words], "word string, n bigint"), 30).collect()
    crowds = Counter(row.key for row in rows if row.size - row.front - row.back > 1)
    assert max(crowds.values()) <= 30
    frame = spelling.near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n bigint"), 30, 500)
    assert {row.word: row.n_near for row in frame.collect()} == {w: len(v) for w, v in near.items() if v}


def test_index_finds_all_strings():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 30, 300)
    letters = rng.integers(1, 4, lengths.sum()).astype(np.uint8)
    ends = np.cumsum(lengths)
    words = [bytes(letters[e - k : e]) for e, k in zip(ends, lengths)]
    index = spelling.Index(letters, lengths, 4)
    for pattern in (b"\1", b"\1\2", b"\3\3\3", b"\2\1\2\1", b"\1" * 9):
        low, high = np.array([0]), np.array([index.words])
        for code in reversed(pattern):
            low, high = index.extend(np.array([code]), low, high)
        assert high[0] - low[0] == sum(word.endswith(pattern) for word in words)


def test_forms_lead_to_roots(spark, documents):
    word = "thunderstorm"
    chain = [(word, 2000), (word[:-1] + "n", 200), (word[:-2] + "nn", 20), (word[:-2] + "nnn", 2)]
    doc_id = next(i for i in range(99) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w, _ in chain))
    rows = [(doc_id, " ".join(" ".join([w] * n) for w, n in chain))]
    docs = documents(rows)
    assert result(spelling.variants(docs)) == brute(counted(rows))
    roots = {row.word: row.root for row in spelling.variants(docs).collect()}
    assert set(roots.values()) == {word}


def test_odd_rows(odd_documents):
    rows = [(row.doc_id, row.text) for row in odd_documents.collect()]
    assert result(spelling.variants(odd_documents)) == brute(counted(rows))


def test_ties_go_to_the_smallest_word(documents):
    docs = documents([(None, "aaaaaaab " * 30 + "aaaaaaac " * 30 + "aaaaaaa " * 3)])
    rows = {row.word: row for row in spelling.variants(docs).collect()}
    assert (rows["aaaaaaa"].form, rows["aaaaaaa"].n_near, rows["aaaaaaab"].form) == ("aaaaaaab", 2, None)


def test_empty_table(documents):
    assert spelling.variants(documents([])).collect() == []
    assert spelling.variants(documents([(1, "short words only")])).collect() == []
