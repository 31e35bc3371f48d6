import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    found = {}
    for item, text in items:
        held = words(text)
        for i in range(max(1, len(held) - size + 1)) if held else ():
            found.setdefault(tuple(held[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        held, hit, names = words(text), set(), set()
        for n in {len(window) for window in found}:
            for i in range(len(held) - n + 1):
                window = tuple(held[i : i + n])
                if window in found:
                    hit.update(range(i, i + n))
                    names |= found[window]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(held), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=repr)


def result(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def test_given_tables_agree_with_brute_force(table):
    docs, items = table("documents"), table("benchmark")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert result(dc.decontaminate(docs, items)) == expected
    assert any(row[-1] for row in expected)


def test_odd_rows_and_odd_items(spark, odd_documents):
    items = [(1, "one line"), (1, "another line of"), (None, "LINE another"), (2, None), (3, " .,- "), (10, "word " * 12), (11, "é 😀 ünï code")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [(row.doc_id, row.text) for row in odd_documents.collect()]
    assert result(dc.decontaminate(odd_documents, bench)) == brute(docs, items)
    flagged = {(r[0]) for r in brute(docs, items) if r[-1]}
    kept = dc.without_contaminated(odd_documents, bench)
    assert kept.columns == odd_documents.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((d or 0) for d, _ in docs if d not in flagged)


def test_several_passes_give_the_same(monkeypatch, table):
    docs, items = table("documents"), table("benchmark")
    once = result(dc.decontaminate(docs, items))
    monkeypatch.setattr(dc, "PASS_BYTES", 30_000)
    assert result(dc.decontaminate(docs, items)) == once


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert result(dc.decontaminate(documents([(1, "some words")]), none)) == brute([(1, "some words")], [])
    assert dc.decontaminate(documents([]), none).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=12), min_size=1, max_size=6, unique=True), st.text("ab ", max_size=300))
def test_search_finds_every_occurrence(patterns, text):
    patterns, data = [p.encode() for p in patterns], text.encode()
    expected = sorted((i, n) for n, p in enumerate(patterns) for i in range(len(data)) if data.startswith(p, i))
    starts, numbers = dc.Searcher(patterns).find(np.frombuffer(data, np.uint8))
    assert sorted(zip(starts.tolist(), numbers.tolist())) == expected


def test_long_text_is_searched_to_its_end():
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcd ") for _ in range(200_000))
    patterns = [data[i : i + n] for i, n in ((0, 40), (70_000, 25), (199_970, 30))]
    starts, numbers = dc.Searcher(patterns).find(np.frombuffer(data, np.uint8))
    assert {(0, 0), (70_000, 1), (199_970, 2)} <= set(zip(starts.tolist(), numbers.tolist()))
