import math
import re
import zlib
from collections import Counter

import numpy as np

from plumbline.llm import lm_score, tallies


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def brute(rows):
    """Base columns and model scores, the mixture weights learned token by token."""
    learned = [tokens(t) for d, t in rows if not held_out(d)]
    single = Counter(w for each in learned for w in each)
    pairs = Counter(p for each in learned for p in zip([None, *each], each))
    n, v = sum(single.values()), len(single)
    frequency = lambda c: min(int(math.log2(c)), 47)
    evidence = {}
    for each in learned:
        own, own_pairs = Counter(each), Counter(zip([None, *each], each))
        for before, word in zip([None, *each], each):
            context = single[before] - own[before]
            if context > 0:
                p1 = (single[word] - own[word] + 0.5) / (n - len(each) + 0.5 * (v + 1))
                evidence.setdefault(frequency(context), []).append(((pairs[before, word] - own_pairs[before, word]) / context, p1))
    weights = {}
    for f, cases in evidence.items():
        p2, p1 = (np.array(x) for x in zip(*cases))
        weight = 0.5
        for _ in range(500):
            weight = float(np.mean(weight * p2 / (weight * p2 + (1 - weight) * p1)))
        weights[f] = min(max(weight, 1e-6), 1 - 1e-6)
    out = {}
    for doc, text in rows:
        base = score = 0.0
        each = tokens(text)
        for before, word in zip([None, *each], each):
            p1 = (single[word] + 0.5) / (n + 0.5 * (v + 1))
            context = single[before]
            lower = [f for f in weights if context and f <= frequency(context)]
            weight = weights[max(lower)] if lower else (weights[min(weights)] if weights and context else 0.0)
            base += math.log10(p1)
            score += math.log10(weight * pairs[before, word] / max(context, 1) + (1 - weight) * p1)
        out[doc] = (held_out(doc), len(each), sum(single[w] > 0 for w in each), n, base, score)
    return out


def agree(found, expected):
    assert found.keys() == expected.keys()
    for doc, (*exact, base, score) in expected.items():
        row = found[doc]
        assert [row.held_out, row.n_tokens, row.n_known, row.train_tokens] == exact
        assert abs(row.base_score - base) < 1e-6 * max(1, abs(base))
        assert abs(row.score - score) < 0.01 * max(1, abs(score))


def test_given_documents_agree_with_brute_force(table):
    docs = table("documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    agree({r.doc_id: r for r in lm_score.score(docs).collect()}, brute(rows))


def test_blocks_do_not_change_scores(monkeypatch, table):
    docs = table("documents")
    whole = {r.doc_id: r for r in lm_score.score(docs).collect()}
    monkeypatch.setattr(tallies, "BLOCK_BYTES", 20_000)
    parts = {r.doc_id: r for r in lm_score.score(docs.repartition(3)).collect()}
    for doc, row in whole.items():
        assert parts[doc][:5] == row[:5]
        assert abs(parts[doc].base_score - row.base_score) < 1e-6 and abs(parts[doc].score - row.score) < 1e-6


def test_model_beats_the_base_on_held_out_documents(table):
    rows = [r for r in lm_score.score(table("documents", "sf0.01")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.9


def test_odd_rows(documents):
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "word " * 20_000), (5, "É é A a"), (6, "x" * 50_000), (7, "É é A a")]
    docs = documents(rows, clashing=True)
    agree({r.doc_id: r for r in lm_score.score(docs).collect()}, brute(rows))


def test_repeated_rows_come_out_as_often(documents):
    out = lm_score.score(documents([(5, "a b"), (5, "a b"), (None, "c"), (None, "d")])).collect()
    assert sorted(str(r.doc_id) for r in out) == ["5", "5", "None", "None"]


def test_nothing_to_learn_from(documents):
    doc = next(i for i in range(100) if held_out(i))
    row = lm_score.score(documents([(doc, "a b")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_mixture_weights_follow_the_evidence():
    strong, weak = int((5 - lm_score.LOWEST) * lm_score.CELLS), int((-3 - lm_score.LOWEST) * lm_score.CELLS)
    weights = lm_score.mixture_weights({(2, strong): 90.0, (2, -1): 10.0, (5, weak): 10.0, (5, -1): 90.0})
    assert abs(weights[2] - 0.9) < 0.01 and weights[5] < 0.01
    assert weights[0] == weights[2] == weights[4] and weights[6] == weights[5]
    assert not lm_score.mixture_weights({}).any()


def test_empty_table(documents):
    assert lm_score.score(documents([])).collect() == []
