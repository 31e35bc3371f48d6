import random
import re

import xxhash

from plumbline.llm import simhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for shingle in shingles:
        digest = xxhash.xxh64_intdigest(shingle.encode(), 42)
        for bit in range(64):
            ones[bit] += digest >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(shingles))


def linked(fps, bits):
    root = {fp: fp for fp in fps}

    def find(fp):
        while root[fp] != fp:
            fp = root[fp]
        return fp

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {fp: find(fp) for fp in fps}


def brute(rows):
    fps = [fingerprint(text) for _, text in rows]
    roots = linked(fps, 2)
    smallest = {}
    for (doc, _), fp in zip(rows, fps):
        if doc is not None:
            smallest[roots[fp]] = min(doc, smallest.get(roots[fp], doc))
    return sorted(((doc, f"{fp:016x}", smallest.get(roots[fp])) for (doc, _), fp in zip(rows, fps)), key=repr)


def result(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def test_given_documents_agree_with_brute_force(table):
    docs = table("documents")
    rows = [(row.doc_id, row.text) for row in docs.collect()]
    assert result(simhash.near_duplicates(docs)) == brute(rows)


def test_odd_rows(odd_documents):
    rows = [(row.doc_id, row.text) for row in odd_documents.collect()]
    assert result(simhash.near_duplicates(odd_documents)) == brute(rows)


def test_crowded_buckets_are_cut_again_and_lose_no_link(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(150):
        fp = centre
        for bit in rng.sample(range(64), rng.randint(1, 4)):
            fp ^= 1 << bit
        fps.add(fp)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    signed = [fp - (1 << 64) if fp >> 63 else fp for fp in fps]
    frame = spark.createDataFrame([(fp,) for fp in signed], "fp bigint")
    for bits in (1, 2):
        expected = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
        for bucket in (128, 8):
            assert {frozenset(row) for row in simhash.links(frame, bits, bucket).collect()} == expected


def test_one_of_each_keeps_the_smallest_id(documents):
    rows = [(5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, "quite another text here"), (9, "quite another text here"), (None, "alone with no id"), (2, None), (1, "")]
    docs = documents(rows, clashing=True)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [(1, ""), (3, "a b c d"), (9, "quite another text here"), (None, "alone with no id")]


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.one_of_each(documents([])).collect() == []
