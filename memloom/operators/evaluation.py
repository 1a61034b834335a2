"""Retrieval metrics and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, golden: DataFrame, store: DataFrame | None = None, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row: queries, empty, mrr, and for each k recall, all-hit and any-hit shares.

    ranked: query, id, rank; golden: query, id (expected); expected ids missing from
    ``store`` (id) are taken out first, queries without expected ids don't count.
    """
    want = golden.select("query", "id").distinct()
    if store is not None:
        want = want.join(store.select("id").distinct(), "id", "left_semi")
    hits = want.join(ranked.select("query", "id", "rank"), ["query", "id"], "left")
    each = hits.groupBy("query").agg(
        F.count("*").alias("n"), F.min("rank").alias("first"), *[F.sum(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"h{k}") for k in ks]
    )
    got = ranked.select("query").distinct().withColumn("got", F.lit(1))
    each = each.join(got, "query", "left")
    return each.agg(
        F.count("*").alias("queries"), F.sum(F.col("got").isNull().cast("int")).alias("empty"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        *[F.round(F.avg(F.col(f"h{k}") / F.col("n")), 6).alias(f"recall_{k}") for k in ks],
        *[F.round(F.avg((F.col(f"h{k}") == F.col("n")).cast("double")), 6).alias(f"all_{k}") for k in ks],
        *[F.round(F.avg((F.col(f"h{k}") > 0).cast("double")), 6).alias(f"any_{k}") for k in ks],
    )


def nearest_rank(values: DataFrame, value: str, p: float) -> DataFrame:
    """One row ``value``: the nearest-rank percentile, the ceil(p / 100 n)-th smallest value."""
    return values.filter(F.col(value).isNotNull()).agg(F.expr(f"percentile_disc({p / 100.0}) WITHIN GROUP (ORDER BY {value})").alias("value"))


def is_degraded(recall_before: Column, mrr_before: Column, recall_now: Column, mrr_now: Column) -> Column:
    """True if recall fell by more than 10 % or MRR by more than 15 % of what it was; nothing falls from 0."""
    fell = lambda a, b, most: F.when(a > 0, (a - b) / a > most).otherwise(False)
    return fell(recall_before, recall_now, 0.10) | fell(mrr_before, mrr_now, 0.15)


def history_verdict(runs: DataFrame) -> DataFrame:
    """One row (runs, p95_off, p95_on, gain, verdict) of latency runs (index_on, p95): insufficient below 30 runs or 10 of either kind, positive from 30 % gain."""
    med = lambda on: F.expr(f"percentile(CASE WHEN index_on = {on} THEN p95 END, 0.5)")
    r = runs.agg(F.count("*").alias("runs"), F.sum(F.col("index_on").cast("int")).alias("on"), med("false").alias("p95_off"), med("true").alias("p95_on"))
    gain = F.when(F.col("p95_off") > 0, (F.col("p95_off") - F.col("p95_on")) / F.col("p95_off"))
    few = (F.col("runs") < 30) | (F.col("on") < 10) | (F.col("runs") - F.col("on") < 10)
    return r.select("runs", F.round("p95_off", 6).alias("p95_off"), F.round("p95_on", 6).alias("p95_on"), F.round(gain, 6).alias("gain"), F.when(few, "insufficient").when(gain >= 0.3, "positive").otherwise("negative").alias("verdict"))


def guarded(candidate: DataFrame, fallback: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """The candidate version, or the fallback if the metrics (one row each: recall, mrr) got worse."""
    m = F.broadcast(before.select(F.col("recall").alias("rb"), F.col("mrr").alias("mb")).join(now.select(F.col("recall").alias("rn"), F.col("mrr").alias("mn"))))
    bad = is_degraded(F.col("rb"), F.col("mb"), F.col("rn"), F.col("mn"))
    keep = lambda df, c: df.join(m.select(bad.alias("__bad"))).filter(c).drop("__bad")
    return keep(candidate, ~F.col("__bad")).unionByName(keep(fallback, F.col("__bad")))


def triplet_accuracy(triplets: DataFrame, positive: Column, negative: Column) -> DataFrame:
    """One row ``accuracy``: share of triplets whose positive similarity is above the negative one."""
    return triplets.agg(F.round(F.avg((positive > negative).cast("double")), 6).alias("accuracy"))


def set_f1(found: DataFrame, golden: DataFrame, keys: list[str]) -> DataFrame:
    """One row (tp, fp, fn, f1) of two sets of rows (full outer join)."""
    from memloom.functions.scoring import f1

    j = found.select(*keys).distinct().withColumn("f", F.lit(1)).join(golden.select(*keys).distinct().withColumn("g", F.lit(1)), keys, "full")
    s = j.agg(*[F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(n) for n, c in (("tp", F.col("f").isNotNull() & F.col("g").isNotNull()), ("fp", F.col("g").isNull()), ("fn", F.col("f").isNull()))])
    return s.withColumn("f1", F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 6))


def rank_of(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
