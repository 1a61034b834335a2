import random

import pytest
from pyspark.sql import functions as F

from memloom.operators.lifecycle import auto_links, capped_running_mean
from memloom.operators.ordering import global_rank, running


@pytest.mark.parametrize("partitions", ["1", "6"])
def test_against_loop(spark, partitions):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), i, rnd.choice([1, 2, None]), rnd.choice([None, "x", "y"])) for i in range(300)]
    rnd.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "k string, i long, v long, s string")
        out = running(df, ["k"], [F.asc("i")], totals={"n": F.lit(1), "sum": F.coalesce("v", F.lit(0))}, before={"p": F.col("v")}, carried={"c": F.col("s")})
        got = sorted(((r.k or "", r.i, r.n, r.sum, r.p, r.c) for r in out.collect()), key=str)
        ranks = sorted((r.i, r["rank"]) for r in global_rank(df, [F.desc("i")]).collect())
        empty = running(df.limit(0), ["k"], [F.asc("i")], totals={"n": F.lit(1)}).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want, state = [], {}
    for k, i, v, s in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        n, total, prev, last = state.get(k, (0, 0, None, None))
        last = s if s is not None else last
        want.append((k or "", i, n + 1, total + (v or 0), prev, last))
        state[k] = (n + 1, total + (v or 0), v, last)
    assert got == sorted(want, key=str)
    assert ranks == [(i, 300 - i) for i in range(300)] and empty == 0


def test_links_and_means(spark):
    df = spark.createDataFrame([(i, "g" if i % 4 else "h", i) for i in range(20)], "id long, g string, u long")
    got = {(r.from_id, r.to_id) for r in auto_links(df, "id", "g", "u", 2).collect()}
    members = {"g": [i for i in range(20) if i % 4], "h": [i for i in range(20) if not i % 4]}
    assert got == {(m[i], m[j]) for m in members.values() for i in range(len(m)) for j in (i - 1, i - 2) if j >= 0}
    xs = {"a": [1.0, 5.0, 9.0], "b": [float(x) for x in range(30)], "c": [7.0, 9999.0]}
    mean = {}
    for k, v in xs.items():
        avg = n = 0
        for x in v:
            if x <= 3600:
                avg += (x - avg) / min(n + 1, 10)
                n += 1
        mean[k] = pytest.approx(avg, abs=1e-5)
    rows = [(k, i, x) for k, v in xs.items() for i, x in enumerate(v)]
    assert {r.k: r.mean for r in capped_running_mean(spark.createDataFrame(rows, "k string, i long, x double"), "k", ["i"], "x").collect()} == mean
