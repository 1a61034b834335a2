from memloom.operators import graph as G


def test_large_module_gives_all_pairs(spark):
    df = spark.range(450).selectExpr("id AS f", "1L AS m").unionAll(spark.sql("SELECT * FROM VALUES (3L, 7L), (4L, 7L)"))
    got = {(r.a, r.b): r.w for r in G.coimport_weights(df, "f", "m").collect()}
    want = {(a, b): round(1 / 450, 6) for b in range(450) for a in range(b)}
    want[3, 4] = round(1 / 450 + 1 / 2, 6)
    assert got == want
