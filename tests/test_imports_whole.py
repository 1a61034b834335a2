from memloom.plans import graph_queries as Q


def test_gr_22_takes_all_names(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a/b.py", "use numpy.linalg and pandas.core and numpy.linalg")], "doc_id long, path string, text string")
    monkeypatch.setattr(Q, "read", lambda s, d, t: df)
    assert sorted(r.dst for r in Q.gr_22(spark, "").collect()) == ["pkg:pypi:numpy", "pkg:pypi:pandas"]


def test_xo_18_documents_keeps_the_chunk(spark, monkeypatch):
    text = "\n".join(["def f(x):"] + [f"    y{i} = x + {i}" for i in range(39)])
    df = spark.createDataFrame([(1, "a/b.py", text)], "doc_id long, path string, text string")
    monkeypatch.setattr(Q, "read", lambda s, d, t: df)
    assert max(len(r.chunk) for r in Q.xo_18_documents(spark, "").collect()) > 400
