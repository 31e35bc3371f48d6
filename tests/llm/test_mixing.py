from collections import Counter, defaultdict
from math import ceil, floor

import numpy as np
import pytest

from plumbline.llm import mixing


def earliest_deadline_first(shares, slots):
    """Which source runs in each slot, slot by slot."""
    done, out = dict.fromkeys(shares, 0), []
    for slot in range(slots):
        ready = [(ceil((done[s] + 1) * slots / shares[s]), i, s) for i, s in enumerate(sorted(shares)) if floor(done[s] * slots / shares[s]) <= slot]
        source = min(ready)[2]
        done[source] += 1
        out.append(source)
    return out


@pytest.fixture
def weights(spark):
    return lambda rows: spark.createDataFrame(rows, "source string, weight double")


def test_shares_are_largest_remainders(weights):
    rows = [("a", 5.0), ("b", 3.0), ("c", 2.0), ("d", 0.0), ("e", None), ("a", 0.0)]
    assert {tuple(r) for r in mixing.shares(weights(rows), 10).collect()} == {("a", 5), ("b", 3), ("c", 2)}
    tiny = [("a", 1e9), ("b", 1.0), (None, 1.0)]
    assert {tuple(r) for r in mixing.shares(weights(tiny), 10).collect()} == {("a", 8), ("b", 1), (None, 1)}


@pytest.mark.parametrize("rows", [[("a", 5.0), ("b", 3.0), ("c", 2.0)], [("a", 1.0)], [(f"s{i}", float(i * i % 7 + 1)) for i in range(13)]])
def test_period_agrees_with_simulation(weights, rows):
    shares = mixing.shares(weights(rows), 100)
    found = {r.slot: r.source for r in mixing.period(shares, 100).collect()}
    assert [found[i] for i in range(100)] == earliest_deadline_first({r.source: r.slots for r in shares.collect()}, 100)


def test_mix_stays_within_one_block(documents, weights):
    rows = [(i, f"text {i}", "abc"[min(i % 5, 2)]) for i in range(1000)]
    out = mixing.schedule(documents(rows), weights([("a", 0.2), ("b", 0.5), ("c", 0.3)]), block=4, slots=20).collect()
    assert len(out) == 1000
    blocks = sorted({(r.slot, r.source) for r in out if r.in_mix})
    assert [slot for slot, _ in blocks] == list(range(len(blocks)))
    share, seen = {"a": 0.2, "b": 0.5, "c": 0.3}, Counter()
    for n, (_, source) in enumerate(blocks, 1):
        seen[source] += 1
        assert all(abs(seen[s] - n * w) < 1 for s, w in share.items())
    sizes = Counter((r.source, r.block) for r in out)
    assert all(n == 4 for (s, b), n in sizes.items() if (s, b + 1) in sizes)
    assert all(r.released <= r.slot < r.deadline for r in out)
    # The mix ends where a source first lacks a full block: 200 rows of b give 50 blocks, half of all slots.
    assert len(blocks) == min(r.slot for r in out if not r.in_mix) or len(blocks) >= 99


def test_numbers_of_a_source_have_no_gaps(monkeypatch, documents):
    monkeypatch.setattr(mixing, "NUMBERED", 50)
    monkeypatch.setattr(mixing, "BUCKETS_PER_TASK", 0)
    docs = documents([(i // 2, f"t{i}", "hot" if i % 3 else f"s{i % 7}") for i in range(900)])
    out = mixing.schedule(docs, block=1).collect()
    blocks = defaultdict(list)
    for r in out:
        blocks[r.source].append(r.block)
    assert all(sorted(b) == list(range(len(b))) for b in blocks.values())


def test_odd_rows(odd_documents):
    out = mixing.mix(odd_documents)
    assert out.columns == [c for c in odd_documents.columns if c not in mixing.PLACE] + list(mixing.PLACE)
    rows = out.collect()
    assert len(rows) == odd_documents.count() and all(r.slot is not None for r in rows)


def test_sources_without_weight_are_left_out_of_the_mix(documents, weights):
    out = mixing.schedule(documents([(1, "x", "a"), (2, "y", "b")]), weights([("a", 1.0)]), block=1).collect()
    assert {(r.source, r.slot, r.in_mix) for r in out} == {("a", 0, True), ("b", None, False)}


def test_empty_table(documents):
    assert mixing.schedule(documents([])).collect() == []


@pytest.mark.parametrize("target", [{"a": 0.9, "b": 0.1}, {"hot": 300.0, **{f"s{i}": 1.0 for i in range(600)}}, {f"s{i}": i % 17 + 0.3 for i in range(1300)}], ids=["unequal", "hot", "many"])
def test_weights_are_kept_as_given(target):
    total, n = sum(target.values()), 12_000
    held = [ceil(n * w / total) + 1 for w in target.values()]
    places, end = mixing.earliest_deadlines(list(target.values()), held, held)
    assert end >= n and list(places["slot"][:n]) == list(range(n))
    tasks, seen = np.array(places["task"][:n]), np.arange(1, n + 1)
    for i, w in enumerate(target.values()):
        assert np.abs(np.cumsum(tasks == i) - seen * (w / total)).max() < 1 + 1e-9


def test_more_sources_than_slots_of_a_period(documents, weights):
    docs = documents([(i, "x", f"s{i % 1200}") for i in range(3600)] + [(9000 + i, "y", "hot") for i in range(1800)])
    target = [(f"s{i}", 1.0) for i in range(1200)] + [("hot", 600.0)]
    out = mixing.schedule(docs, weights(target), block=1).collect()
    assert all(r.released <= r.slot < r.deadline for r in out)
    assert len({r.slot for r in out}) == len(out) == 5400
    mixed = [r for r in out if r.in_mix]
    assert len(mixed) > 3600 and abs(sum(r.source == "hot" for r in mixed) - len(mixed) / 3) < 1
