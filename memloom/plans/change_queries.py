"""Queries of the change-feed operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.functions.keys import WHITE_SPACE
from memloom.operators.change_feed import DELETE_WORDS, current_memories, is_delete, replay_changes


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = spark.read.parquet(f"{sf_dir}/memory_feed.parquet")
    return replay_changes(
        feed,
        key="mem_key",
        order=["updated_at", "seq"],
        deleted=is_delete("op", "deleted_at"),
        values=["seq"],
        tie=["feed_id"],
        key_name="mem_key",
    ).select("mem_key", "seq")


def p4_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_memories(spark.read.parquet(f"{sf_dir}/memory_feed.parquet"))


def p4_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed read as partial-column updates: a null field stays as it was, a delete forgets all of them."""
    return replay_changes(
        spark.read.parquet(f"{sf_dir}/memory_feed.parquet"), key="mem_key", order=["updated_at", "seq"], tie=["feed_id"], deleted=is_delete("op", "deleted_at"),
        values=["seq", "importance", "trust", "source", "project_id"], key_name="mem_key", patch=True,
    ).drop("order_0", "order_1")


_TRIM = "trim(mem_key, '" + WHITE_SPACE + "')"
_GONE = "(coalesce(lower(trim(op)) IN (" + ", ".join(f"'{w}'" for w in DELETE_WORDS) + "), false) OR deleted_at IS NOT NULL)"
_RANKED = f"""
WITH ranked AS (
  SELECT *, {_TRIM} AS k, {_GONE} AS gone,
         row_number() OVER (PARTITION BY {_TRIM} ORDER BY updated_at DESC NULLS LAST, seq DESC NULLS LAST, feed_id) AS rn
  FROM memory_feed WHERE {_TRIM} <> ''
)"""

_LATEST = lambda c: f"arg_max({c}, n) FILTER ({c} IS NOT NULL) AS {c}"

QUERIES = {"p4_found": p4_found, "p4_state": p4_state, "p4_patched": p4_patched}
ORACLES = {
    "p4_found": f"{_RANKED} SELECT k AS mem_key, seq FROM ranked WHERE rn = 1 AND NOT gone",
    "p4_state": f"""{_RANKED}
SELECT k AS mem_key, seq, content, category, importance, trust, source, origin, updated_at, project_id
FROM ranked WHERE rn = 1 AND NOT gone""",
    "p4_patched": f"""
WITH once AS (
  SELECT {_TRIM} AS k, coalesce(updated_at, '0001-01-01'::timestamp) AS u, coalesce(seq, -1) AS q, *, {_GONE} AS gone FROM memory_feed WHERE {_TRIM} <> ''
  QUALIFY row_number() OVER (PARTITION BY k, u, q ORDER BY feed_id) = 1
),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY u, q) AS n FROM once),
r AS (SELECT *, coalesce(max(CASE WHEN gone THEN n END) OVER (PARTITION BY k), 0) AS forgot, max(n) OVER (PARTITION BY k) AS last FROM n)
SELECT k AS mem_key, {', '.join(_LATEST(c) for c in ('seq', 'importance', 'trust', 'source', 'project_id'))} FROM r WHERE forgot < last AND n > forgot GROUP BY k""",
}
