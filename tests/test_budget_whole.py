import numpy as np

from memloom.operators import lifecycle as L
from memloom.operators import sessions as T
from memloom.plans import relational_queries as Q


def test_greedy_reaches_all_rows(spark):
    sizes = np.random.default_rng(1).integers(1, 90, 400).tolist()
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    used, want = 0, []
    for i, s in enumerate(sizes):
        if used + s <= 600:
            used, want = used + s, want + [i]
    got = sorted(r.id for r in L.greedy_budget(df, ["id"], "size", 600, ["id"], pool_most=7).collect())
    assert got == want


def test_win_7_beyond_500(spark, monkeypatch):
    rows = [(i, "x" * 7_000, 0.9) for i in range(600)] + [(1_000, "small", 0.1)]
    df = spark.createDataFrame(rows, "mem_id long, content string, importance double").selectExpr("*", "CAST(NULL AS timestamp) AS deleted_at")
    monkeypatch.setattr(Q, "_memories", lambda s, d: df)
    assert [r.mem_id for r in Q.win_7(spark, "").collect()] == [1_000]


def test_st_1_all_user_turns(spark):
    df = spark.range(1_501).selectExpr("'s' AS session", "id AS turn", "IF(id < 1500, 'user', 'assistant') AS role", "concat('t', id) AS content")
    (pair,) = T.conversation_pairs(df).collect()
    assert pair.user_text.split("\n") == [f"t{i}" for i in range(1_500)]
