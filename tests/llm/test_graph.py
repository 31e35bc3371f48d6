import random

from pyspark.sql import functions as F

from plumbline.llm import graph
from plumbline.llm.graph import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for x in root:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def groups(frame):
    found = {}
    for row in frame.collect():
        found.setdefault(row.root, set()).add(row.node)
    return sorted(map(sorted, found.values()))


def test_random_graphs_paths_and_stars(spark):
    rng = random.Random(9)
    names = rng.sample(range(-(10**12), 10**12), 400)
    edges = [tuple(rng.sample(names[:200], 2)) for _ in range(120)]
    edges += list(zip(names[200:260], names[201:261]))
    edges += [(names[300], name) for name in names[301:380]]
    frame = spark.createDataFrame(edges + edges[:20], "a bigint, b bigint")
    assert groups(components(frame)) == brute(edges)


def test_binary_nodes_loops_and_nulls(spark):
    rows = [(b"a", b"b"), (b"c", b"c"), (None, b"d"), (b"b", b"e")]
    assert groups(components(spark.createDataFrame(rows, "a binary, b binary"))) == [[b"a", b"b", b"e"]]


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_a_chain_of_scattered_ids_takes_few_rounds(spark, monkeypatch):
    writes = []
    monkeypatch.setattr(graph, "written", lambda df, of=graph.written: writes.append(1) or of(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)], "a bigint, b bigint").select(*(graph.scattered(F.col(c)).alias(c) for c in "ab"))
    rows = graph.components(edges).select(graph.gathered(F.col("node")).alias("node"), "root").collect()
    assert {row.node for row in rows} == set(range(401)) and len({row.root for row in rows}) == 1
    assert len(writes) < 45


def test_scattered_ids_are_gathered_again(spark):
    rng = random.Random(4)
    ids = [0, -1, 1, 2**63 - 1, -(2**63), 2**32, -(2**32), *(rng.randrange(-(2**63), 2**63) for _ in range(2000))]
    frame = spark.createDataFrame([(i,) for i in ids], "id bigint").withColumn("s", graph.scattered(F.col("id")))
    rows = frame.select("id", "s", graph.gathered(F.col("s")).alias("back")).collect()
    assert all(row.id == row.back for row in rows) and len({row.s for row in rows}) == len(set(ids))
