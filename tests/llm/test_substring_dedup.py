import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import substring_dedup as sd


def text_of(rng, words):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(words))


def shared(texts, size):
    held = defaultdict(set)
    for doc, text in texts.items():
        words = (text or "").split()
        for i in range(len(words) - size + 1):
            held[tuple(words[i : i + size])].add(doc)
    return set().union(*[docs for docs in held.values() if len(docs) > 1])


def test_given_documents(table):
    docs = table("documents", "sf0.01")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r for r in sd.passages(docs).collect()}
    assert found.keys() == texts.keys()
    assert all(found[i].n_words == len(text.split()) for i, text in texts.items())
    flagged = {i for i, row in found.items() if row.repeated}
    assert shared(texts, 51) <= flagged
    assert not flagged & (texts.keys() - shared(texts, 12))


def test_a_passage_is_found_wherever_it_stands(documents):
    rng = random.Random(6)
    passage = text_of(rng, 60)
    rows = [(i, text_of(rng, 100)) for i in range(200)]
    rows += [(1000 + i, f"{text_of(rng, rng.randint(0, 90))}{' ' * (i % 4)} {passage} {text_of(rng, 30)}") for i in range(40)]
    found = {r.doc_id: r for r in sd.passages(documents(rows)).collect()}
    assert {i for i, r in found.items() if r.repeated} == set(range(1000, 1040))
    assert all(30 <= r.longest_words <= 62 for i, r in found.items() if i >= 1000)
    firsts = [r.doc_id for r in found.values() if r.repeated and not r.later_spans]
    assert len(firsts) == 1


def test_texts_lose_later_copies(documents):
    rng = random.Random(7)
    passage = text_of(rng, 300)
    docs = documents([(1, f"one {passage} uno"), (2, f"two {passage} dos"), (3, "three"), (4, None)], clashing=True).coalesce(1)
    out = sd.without_later_passages(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    whole, cut = sorted((texts[1], texts[2]), key=len, reverse=True)
    assert passage in whole and len(cut) < 300 and cut[:3] in ("one", "two") and cut[-3:] in ("uno", "dos")
    assert texts[3] == "three" and texts[4] is None


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab é😀\n", max_size=200), max_size=5))
def test_chunks_make_up_the_texts(texts):
    data = [text.encode() for text in texts]
    doc, begins, ends, whole = sd._cut(data)
    for i, text in enumerate(data):
        parts = [whole[a:b] for d, a, b in zip(doc, begins, ends) if d == i]
        assert b"".join(parts) == text
        assert all(parts) and all(part.decode() is not None for part in parts)


def test_long_runs_are_cut():
    for text in ("x" * 20_000, "é" * 20_000, " " * 20_000):
        doc, begins, ends, whole = sd._cut([text.encode()])
        assert (ends - begins).max() <= sd.LONGEST + 3
        assert b"".join(whole[a:b] for a, b in zip(begins, ends)) == text.encode()
        assert all(whole[a:b].decode() for a, b in zip(begins, ends))


def test_insertions_move_no_distant_boundary():
    rng = random.Random(8)
    text = text_of(rng, 400).encode()
    ends = sd.chunk_ends(np.frombuffer(text, np.uint8))
    moved = sd.chunk_ends(np.frombuffer(text[:500] + b"inserted" + text[500:], np.uint8))
    assert set(ends[ends > 520] + 8) <= set(moved) and set(ends[ends < 500]) <= set(moved)


def test_odd_rows(odd_documents):
    found = defaultdict(list)
    for row in sd.passages(odd_documents).collect():
        found[row.doc_id].append(row)
    assert sum(map(len, found.values())) == odd_documents.count()
    assert all(r.n_chunks == 0 and not r.repeated for i in (1, 2) for r in found[i])
    assert all(r.n_repeated_chunks == r.n_chunks > 0 for i in (6, 7) for r in found[i])


def test_empty_table(documents):
    assert sd.passages(documents([])).collect() == []


def test_a_passage_repeated_within_one_document(documents):
    rng = random.Random(9)
    passage = text_of(rng, 500)
    text = " ".join(f"{passage} {text_of(rng, 30)}" for _ in range(8))
    docs = documents([(1, text), (2, text_of(rng, 500))]).coalesce(1)
    found = {r.doc_id: r for r in sd.passages(docs).collect()}
    assert found[1].repeated_within and not found[1].repeated and found[1].repeated_words > 8 * 480 and len(found[1].later_spans.split(",")) >= 7
    assert not found[2].repeated_within and not found[2].spans
    kept = {r.doc_id: r.text for r in sd.without_later_passages(docs).collect()}
    assert kept[1].startswith(passage) and kept[1].count(passage) == 1 and len(kept[1].split()) < 500 + 8 * 50


def test_chance_repeats_of_phrases_make_no_passage(documents):
    rng = random.Random(10)
    phrases = [text_of(rng, 8) for _ in range(40)]
    # Every phrase stands in many rows, and no two of them follow each other twice.
    pairs = [(i, j) for i in range(40) for j in range(40) if i != j]
    rng.shuffle(pairs)
    rows, used = [], set()
    for n in range(60):
        line, at = [], rng.randrange(40)
        for _ in range(12):
            nxt = next((j for i, j in pairs if i == at and (i, j) not in used), None)
            if nxt is None:
                break
            used.add((at, nxt))
            line.append(phrases[at])
            at = nxt
        rows.append((n, " ".join(line)))
    docs = documents(rows).coalesce(1)
    found = sd.passages(docs).collect()
    assert sum(r.n_repeated_chunks for r in found) > sum(r.n_chunks for r in found) / 2
    assert not any(r.repeated or r.repeated_within or r.spans for r in found)
    assert {r.doc_id: r.text for r in sd.without_later_passages(docs).collect()} == dict(rows)


def test_overlapping_copies_leave_the_first_whole(documents):
    docs = documents([(1, "and so on again " * 400)]).coalesce(1)
    kept = sd.without_later_passages(docs).first().text
    assert 20 <= len(kept.split()) < 600 and set(kept.split()) == {"and", "so", "on", "again"}
