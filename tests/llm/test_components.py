import random

import pytest

from memloom.llm import components
from memloom.llm.components import connected_components, pair_edges


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return sorted((x, find(x)) for x in root)


def run(spark, edges, kind="string"):
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}")
    return sorted(tuple(r) for r in connected_components(df, "a", "b").collect())


@pytest.mark.parametrize("hubs", [1_000_000, 5])
def test_random_chains_and_hubs(spark, monkeypatch, hubs):
    monkeypatch.setattr(components, "_HUB_LEAST", hubs)
    rnd = random.Random(hubs)
    edges = [(f"c{i}", f"c{i + 1}") for i in range(40)]
    edges += [("hub", f"h{i}") for i in range(60)] + [(f"é{i}", f"Z{rnd.randrange(9)}") for i in range(20)]
    edges += [(f"r{rnd.randrange(50)}", f"r{rnd.randrange(50)}") for _ in range(30)] + [("x", "x"), (None, "y"), ("y", None)]
    edges += [(b, a) for a, b in edges[::3]]
    rnd.shuffle(edges)
    assert run(spark, edges) == union_find(edges)


def test_empty_and_numbers(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, 2), (10, 3)], "long") == [(2, 2), (3, 2), (10, 2)]


def test_pairs_that_count(spark):
    rows = [(" a", "b\t", 0.75), ("b", "c", 0.7), ("", "d", 0.9), ("e", "e ", 1.0), (None, "f", 1.0), ("g", "h", None), ("g", "h", float("nan"))]
    df = spark.createDataFrame(rows, "a_key string, b_key string, cos double")
    assert [tuple(r) for r in pair_edges(df).collect()] == [("a", "b")]
