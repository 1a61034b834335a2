"""Graph operators against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import graph as G


def frame(spark, edges):
    return spark.createDataFrame([(a, b, "CALLS", 1.0) for a, b in edges], "src long, dst long, label string, weight double")


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id long")


CHAIN = [(1, 2), (2, 3), (3, 4), (7, 7), (4, 2), (5, 6)]


def test_reach_and_paths(spark):
    e = frame(spark, CHAIN)
    assert {(r.id, r.depth) for r in G.reach(e, ids(spark, 1), 10).collect()} == {(2, 1), (3, 2), (4, 3)}
    assert {(r.id, r.depth) for r in G.reach(e, ids(spark, 4), 1, reverse=True).collect()} == {(3, 1)}
    assert G.reach(e, ids(spark, 99), 3).count() == 0
    assert [r.id for r in G.shortest_path(e, 1, 4).orderBy("step").collect()] == [1, 2, 3, 4]
    assert G.shortest_path(e, 4, 1).count() == 0
    nodes, inside = G.khop_subgraph(e, ids(spark, 3), 1)
    assert {r.id for r in nodes.collect()} == {2, 3, 4} and inside.count() == 3


def pagerank(edges, seeds, d, n):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, {}).setdefault(b, 0.0)
        out[a][b] += w
    total = sum(seeds.values())
    p0 = {k: v / total for k, v in seeds.items()}
    r = dict(p0)
    for _ in range(n):
        new = {}
        for a, x in r.items():
            s = sum(out.get(a, {}).values())
            for b, w in out.get(a, {}).items():
                new[b] = new.get(b, 0) + d * x * w / s
        rest = 1 - sum(new.values())
        for k, v in p0.items():
            new[k] = new.get(k, 0) + v * rest
        r = new
    return r


def test_pagerank(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(20), rnd.randrange(25), rnd.choice([0.5, 1.0, 2.0])) for _ in range(60)]
    df = spark.createDataFrame([*edges, (1, 2, -1.0), (1, 2, None), (2, 3, float("nan"))], "src long, dst long, w double")
    seeds = {1: 1.0, 4: 3.0}
    start = spark.createDataFrame([*seeds.items(), (9, 0.0)], "id long, weight double")
    got = {r.id: r["rank"] for r in G.pagerank(df, start, iterations=12).collect()}
    want = pagerank(edges, seeds, 0.85, 12)
    assert sum(got.values()) == pytest.approx(1.0)
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    early = {r.id: r["rank"] for r in G.pagerank(df, start, tolerance=1e-6).collect()}
    assert sum(early.values()) == pytest.approx(1.0)
    gone = G.pagerank(df, start, iterations=5, superseded=ids(spark, 4, 7))
    assert not {4, 7} & {r.id for r in gone.collect()}
    assert G.pagerank(df, start.limit(0)).count() == 0


def sccs(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    grew = True
    while grew:
        grew = False
        for a, b in edges:
            for n in nodes:
                if a in reach[n] and b not in reach[n]:
                    reach[n].add(b)
                    grew = True
    out = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    size = {}
    for c in out.values():
        size[c] = size.get(c, 0) + 1
    loops = {a for a, b in edges if a == b}
    return {n: c for n, c in out.items() if size[c] > 1 or n in loops}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(25), rnd.randrange(25)) for _ in range(35)] + [(30, 31), (31, 30), (40, 41)]
    assert {r.id: r.component for r in G.strong_components(frame(spark, edges)).collect()} == sccs(edges)


def test_no_cycles(spark):
    assert G.strong_components(frame(spark, [(1, 2), (2, 3)])).count() == 0


def test_communities(spark):
    groups = [range(0, 6), range(10, 16)]
    edges = [(a, b) for g in groups for a in g for b in g if a < b] + [(5, 10), (3, 3)]
    e = frame(spark, edges).withColumn("w", F.col("weight"))
    labels = G.propagate_labels(e)
    got = {r.id: r.community for r in labels.collect()}
    assert len({got[x] for x in groups[0]}) == 1 and len({got[x] for x in groups[1]}) == 1 and got[0] != got[15]
    assert G.modularity(e, labels).first().q == pytest.approx(30 / 31 - 2 * (31 / 62) ** 2)


def test_degrees_hubs_coupling_dead(spark):
    e = frame(spark, CHAIN)
    d = {r.id: (r.in_degree, r.out_degree) for r in G.degrees(e).collect()}
    assert d[2] == (2, 1) and d[7] == (1, 1)
    nodes = spark.createDataFrame([(i, f"n{i}", "Function", "", f"f{i % 2}") for i in range(1, 9)], "id long, label string, node_type string, description string, file_path string")
    assert [r.id for r in G.hubs(nodes, e).orderBy("id").collect()] == [2, 3, 4]
    assert {(r.file_path, r.afferent, r.efferent) for r in G.coupling(nodes, e).collect()} == {("f0", 1, 1), ("f1", 1, 1)}
    dead = G.dead_nodes(nodes, e, ["Function"], ["CALLS"], ["ROUTE"], F.when(F.col("id") == 1, "main"))
    assert {r.id for r in dead.collect()} == {5, 7, 8}


def test_elbow(spark):
    hits = lambda *s: spark.createDataFrame([(i, x) for i, x in enumerate(s)], "id long, score double")
    kept = lambda df: [r.id for r in G.elbow_cut(df).orderBy("id").collect()]
    assert kept(hits(1.0, 0.8, 0.7, 0.2, 0.19)) == [0, 1, 2]
    assert kept(hits(1.0, 0.6, 0.35, 0.2, 0.14)) == [0, 1, 2, 3]
    assert kept(hits(0.0, -1.0)) == []


def test_cochange_and_coimport(spark):
    rows = [("c1", "a"), ("c1", "b"), ("c1", "b"), ("c2", "a"), ("c2", "b"), ("c3", "b"), ("c3", "a"), ("c4", "a")] + [("bulk", f"x{i}") for i in range(11)]
    df = spark.createDataFrame(rows, "t string, i string")
    assert [tuple(r) for r in G.cochange_pairs(df, "t", "i").collect()] == [("a", "b", 3, 0.5)]
    near = {(r.a, r.b): r.w for r in G.coimport_weights(df, "i", "t").collect()}
    assert near[("a", "b")] == pytest.approx(1.5) and near[("x0", "x10")] == pytest.approx(1 / 11, abs=1e-6) and len(near) == 56
