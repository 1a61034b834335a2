from datetime import datetime

from pyspark.sql import functions as F

from memloom.llm.survivors import choose_survivors, memory_fields, survivor_fields, vote_survivors

SCHEMA = "mem_id long, mem_key string, content string, category string, importance double, trust double, source string, updated_at timestamp, deleted_at timestamp, project_id string, group_key string"
DAY = lambda d: datetime(2026, 1, d)
NAN = float("nan")
ROWS = [
    (1, "a", "short", "fact", 0.5, 0.9, "n/a", DAY(1), None, " ", "clash"),
    (2, "b", "the longest", "fact", 0.5, 1.7, "agent", DAY(9), None, "p2", "clash"),
    (3, "c", "the-longest", "Fact", 0.9, 0.9, None, DAY(2), None, "p1", "clash"),
    (4, "d", None, None, None, NAN, " - ", None, None, None, None),
    (5, "e", "", "x", 0.1, 0.2, "none", DAY(3), None, "unknown", None),
    (6, "f", "gone", "x", 1.0, 1.0, "agent", DAY(3), DAY(4), "p", None),
    (7, "g", "alone", "x", 1.0, 1.0, "agent", DAY(3), None, "p", None),
]
GROUPS = [("a", "g1"), ("b", "g1"), ("c", "g1"), ("purged", "g1"), ("d", "g2"), ("e", "g2"), ("f", "g3"), ("g", "g3")]


def frames(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(GROUPS, "mem_key string, group_key string")


def chosen(memories, groups):
    return survivor_fields(choose_survivors(memories, groups), list(memory_fields()))


def test_fields_come_from_the_right_members(spark):
    got = {(r.group_key, r.field_name): r.from_key for r in chosen(*frames(spark)).collect()}
    assert got == {
        ("g1", "canonical"): "c", ("g1", "content"): "c", ("g1", "source"): "b", ("g1", "project_id"): "b",
        ("g2", "canonical"): "e",
    }


def test_repeated_groups_and_empty(spark):
    memories, groups = frames(spark)
    assert choose_survivors(memories.limit(0), groups).count() == 0
    assert choose_survivors(memories, groups.limit(0)).count() == 0
    assert vote_survivors(memories.limit(0), groups, as_of="2026-02-01").count() == 0


def test_votes_sum_over_spellings(spark):
    memories, groups = frames(spark)
    out = {r.group_key: r for r in vote_survivors(memories, groups, as_of="2026-02-01").collect()}
    assert out["g1"].category == "Fact"  # both spellings vote together, the best ranked member's stands
    assert out["g1"].source == "agent" and out["g1"].project_id in ("p1", "p2")
    assert out["g2"].content is None and out["g2"].canonical in ("d", "e")


def test_one_large_group(spark):
    memories = spark.range(3000).select(
        F.col("id").alias("mem_id"), F.format_string("k%05d", "id").alias("mem_key"), F.lit("c").alias("content"), F.lit("x").alias("category"),
        F.lit(0.5).alias("importance"), F.lit(0.5).alias("trust"), F.lit("s").alias("source"), F.lit(DAY(1)).alias("updated_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"), F.lit("p").alias("project_id"),
    )
    groups = memories.select("mem_key", F.lit("g").alias("group_key"))
    assert {r.from_key for r in chosen(memories, groups).collect()} == {"k00000"}
