"""Replay of a change feed against a plain loop over sorted rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memloom.operators.change_feed import current_memories, is_delete, replay_changes

SCHEMA = "feed_id long, k string, ts timestamp, seq long, op string, a string, b long"


def brute(rows, patch):
    state, last = {}, {}
    floor = datetime(1, 1, 1)
    keyed = [(str(r[1]).strip(), r) for r in rows if r[1] is not None and r[1].strip()]
    for k, r in sorted(keyed, key=lambda x: (x[0], x[1][2] or floor, x[1][3], x[1][0])):
        at = (r[2] or floor, r[3])
        if last.get(k) == at:
            continue
        last[k] = at
        if r[4] == "delete":
            state.pop(k, None)
        elif patch and k in state:
            a, b = state[k]
            state[k] = (r[5] if r[5] is not None else a, r[6] if r[6] is not None else b)
        else:
            state[k] = (r[5], r[6])
    return sorted((k, *v) for k, v in state.items())


def feed(n, seed, keys=7):
    rnd = random.Random(seed)
    base = datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        k = "hot" if rnd.random() < 0.4 else rnd.choice([f"k{rnd.randrange(keys)}", f" k{rnd.randrange(keys)}\t", None, " "])
        ts = None if rnd.random() < 0.05 else base + timedelta(minutes=rnd.randrange(200))
        op = rnd.choices(["insert", "update", "delete"], [3, 5, 1])[0]
        rows.append((i, k, ts, i, op, rnd.choice([None, "x", "y"]), rnd.choice([None, 1, 2])))
    rows += [(10_000 + i, *rows[rnd.randrange(n)][1:]) for i in range(n // 5)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("patch", [False, True])
@pytest.mark.parametrize("partitions", [1, 5])
def test_against_loop(spark, patch, partitions):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        rows = feed(400, 3)
        out = replay_changes(
            spark.createDataFrame(rows, SCHEMA), key="k", order=["ts", "seq"], tie=["feed_id"],
            deleted=is_delete("op"), values=["a", "b"], patch=patch, partitions=partitions,
        )
        got = sorted(((r["key"], r["a"], r["b"]) for r in out.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(brute(rows, patch), key=str)


def test_empty_and_deleted(spark):
    empty = spark.createDataFrame([], SCHEMA)
    kw = dict(key="k", order=["ts", "seq"], deleted=is_delete("op"), values=["a"])
    assert replay_changes(empty, **kw).count() == 0
    one = spark.createDataFrame([(1, "x", None, 1, " Delete ", "v", 1)], SCHEMA)
    assert replay_changes(one, **kw).count() == 0
    assert [r.is_deleted for r in replay_changes(one, keep_deleted=True, **kw).collect()] == [True]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "x", None, 1, "insert", "v", 1)], SCHEMA).withColumn("key", F.lit("other")).withColumn("order_0", F.lit(9))
    assert replay_changes(df, key="k", order=["ts", "seq"], deleted=is_delete("op"), values=["a"]).first()["key"] == "x"


def test_delete_time_decides(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, "update", None), (2, "b", 1, None, datetime(2026, 1, 1)), (3, "c", 1, None, None)],
        "feed_id long, mem_key string, seq long, op string, deleted_at timestamp",
    )
    for c in ("content", "category", "source", "origin", "project_id"):
        df = df.withColumn(c, F.lit("v"))
    df = df.withColumn("importance", F.lit(1.0)).withColumn("trust", F.lit(1.0)).withColumn("updated_at", F.lit(None).cast("timestamp"))
    assert sorted(r.mem_key for r in current_memories(df).collect()) == ["a", "c"]
