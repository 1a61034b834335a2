from memloom.plans import lifecycle_queries as Q


def test_jn_17_reads_all_memories(spark, monkeypatch):
    rows = [(1, "alpha", "it talks to beta"), (2, "alpha", "zzz"), (3, "beta", "nothing"), (4, "beta", "near alpha here")]
    df = spark.createDataFrame(rows, "mem_id long, project_id string, content string").selectExpr("*", "CAST(NULL AS timestamp) AS deleted_at")
    monkeypatch.setattr(Q, "read", lambda s, d, t: df)
    assert {(r.source, r.target) for r in Q.jn_17(spark, "").collect()} == {("alpha", "beta"), ("beta", "alpha")}
