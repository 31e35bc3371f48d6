import random
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import line_dedup
from plumbline.llm.common import with_row_key


def plain(line):
    return line_dedup.normalised(line.encode()).decode()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    """The kept line numbers of every document; ids must be distinct."""
    first = {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for n, line in enumerate((text or "").split("\n")):
            if plain(line):
                first.setdefault(plain(line), (doc is None, doc or 0, n))
    lines = sorted(first)
    root = {line: line for line in lines}

    def find(line):
        while root[line] != line:
            line = root[line]
        return line

    long = [line for line in lines if len(line) >= line_dedup.LEAST_CHARS]
    for i, a in enumerate(long):
        for b in long[:i]:
            if one_edit(a, b):
                root[find(a)] = find(b)
    best = {}
    for line in lines:
        best[find(line)] = min(best.get(find(line), first[line]), first[line])
    kept = defaultdict(list)
    for missing, doc, n in best.values():
        kept[None if missing else doc].append(n)
    return {doc: (sum(bool(plain(line)) for line in (text or "").split("\n")), sorted(kept[doc])) for doc, text in rows}


def result(docs):
    return {r.doc_id: (r.n_lines, [int(n) for n in r.kept.split(",") if n]) for r in line_dedup.dedup_lines(docs).collect()}


def edited(rng, line):
    chars, at = list(line), rng.randrange(len(line))
    kind = rng.random()
    if kind < 0.4:
        chars[at] = rng.choice("xyz")
    elif kind < 0.6:
        chars.insert(at, rng.choice("pq"))
    elif kind < 0.8:
        del chars[at]
    else:
        for _ in range(3):
            chars[rng.randrange(len(chars))] = rng.choice("xyz")
    return "".join(chars)


@pytest.mark.parametrize("crowd", [32, 3])
def test_lines_agree_with_brute_force(monkeypatch, documents, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    rng = random.Random(4)
    base = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(i, f"{edited(rng, base)}\nrow number {i} of the table has value {i * 7}\n\n x\nshort {i}") for i in range(200)]
    rows += [(1000 + i, f"une phrase assez longue n° {i:03d} à voir 😀\nshort {i}") for i in range(120)]
    rng.shuffle(rows)
    docs = documents(rows).repartition(5)
    assert result(docs) == brute(rows)


def test_given_documents_agree_with_brute_force(table):
    docs = table("documents")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_banded_distance():
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
    pairs = [(text(), text()) for _ in range(3000)]
    codes = lambda line: np.array([ord(c) for c in line], np.int64)
    for edits in (1, 2, 3):
        found = line_dedup.within([codes(a) for a, _ in pairs], [codes(b) for _, b in pairs], edits)
        assert found.tolist() == [distance(a, b) <= edits for a, b in pairs]


def test_odd_rows(odd_documents):
    found = line_dedup.kept_lines(with_row_key(odd_documents)).collect()
    by_id = defaultdict(list)
    for row in found:
        by_id[row.doc_id].append((row.n_lines, row.kept))
    assert sorted(by_id[None]) == [(0, []), (1, [0])]
    assert by_id[1] == by_id[2] == by_id[3] == [(0, [])]
    assert sorted(by_id[6]) == [(3, []), (3, [0, 1])] and by_id[7] == [(3, [])]
    assert by_id[4] == by_id[5] == by_id[8] == [(1, [0])]


def test_texts_lose_repeated_lines(documents):
    long = "a line that is long enough to be compared by edits"
    docs = documents([(1, f"{long}\n\nown text"), (2, f"{long}!\nmore\n"), (3, f"  {long.upper()}"), (4, None), (5, " \n ")], clashing=True)
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (f"{long}\n\nown text", len(long) + 10), 2: ("more\n", 5), 4: (None, 0), 5: (" \n ", 3)}


def test_empty_table(documents):
    assert line_dedup.dedup_lines(documents([])).collect() == []
    assert line_dedup.without_repeated_lines(documents([])).collect() == []
