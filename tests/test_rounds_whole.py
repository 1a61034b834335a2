from memloom.operators import graph as G
from memloom.plans import graph_queries as Q


def _chain(spark, n):
    return spark.range(1, n).selectExpr("id AS src", "id + 1 AS dst", "'manual' AS label", "1.0D AS weight", "1L AS seen")


def test_rank_goes_twenty_steps(spark, monkeypatch):
    monkeypatch.setattr(Q, "graph_edges", lambda s, d, n=None: _chain(spark, 30))
    ids = {r.id for r in Q.gr_1(spark, "").collect()}
    assert ids == set(range(1, 24))  # the seeds are 1, 2 and 3


def test_zones_take_ten_rounds(spark, monkeypatch):
    monkeypatch.setattr(Q, "graph_edges", lambda s, d, n=None: _chain(spark, 80))
    e = _chain(spark, 80).selectExpr("src", "dst", "src % 40 + 1 AS w")
    monkeypatch.setattr(Q, "graph_edges", lambda s, d, n=None: e.selectExpr("src", "dst", "w AS weight"))
    zones = lambda rounds: sorted(tuple(r) for r in G.propagate_labels(e, rounds).groupBy("community").count().filter("count >= 3").collect())
    got = sorted((r.community, r.n) for r in Q.gr_13(spark, "").collect())
    assert got == zones(10) and got != zones(6)
