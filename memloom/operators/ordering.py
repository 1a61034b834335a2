"""Ranks, running totals and predecessors over orders of any length, for keys of any size.

A window over a whole table, or over a key that holds a third of it, is one task.
Here rows are range-partitioned by key and order, so that such a key lies in many
tasks; each partition runs its own window, and what precedes it is added from one
row per partition and key.  A key is cut only at partition borders, so at most
one such row per partition is needed, and those are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.session import materialize

#: Rows of a shuffle partition where their number is known: some tens of megabytes of narrow rows.
ROWS_PER_TASK = 2_000_000


def partitions_for(spark: SparkSession, n_rows: int, per_task: int = ROWS_PER_TASK) -> int:
    """Shuffle partitions for ``n_rows``: those of the session, more if a task would get more than ``per_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // per_task))


def spread_out(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input has fewer parts than that: for work that is slow against its input."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def running(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], *, totals: Mapping[str, Column] | None = None, before: Mapping[str, Column] | None = None, carried: Mapping[str, Column] | None = None
) -> DataFrame:
    """The rows with columns computed in order within each key.

    ``totals``: sums up to and with the row; ``before``: values of the row before, null in
    the first; ``carried``: the last value that isn't null up to and with the row.
    The order should be total; rows equal in it may stand in any order.
    """
    totals, before, carried = totals or {}, before or {}, carried or {}
    parts = df
    for kind, exprs in (("t", totals), ("b", before), ("c", carried)):
        for j, c in enumerate(exprs.values()):
            parts = parts.withColumn(f"__{kind}{j}", c)
    sort = [F.col(c).asc_nulls_first() for c in by] + list(order)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = parts.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("__i", F.monotonically_increasing_id())
    placed, _ = materialize(placed.withColumn("__p", F.shiftright("__i", 33)), "ordered")
    w = Window.partitionBy("__p", *by).orderBy("__i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns(
        {f"__T{j}": F.sum(f"__t{j}").over(upto) for j in range(len(totals))}
        | {f"__B{j}": F.lag(f"__b{j}").over(w) for j in range(len(before))}
        | {f"__C{j}": F.last(f"__c{j}", ignorenulls=True).over(upto) for j in range(len(carried))}
        | {"__first": F.row_number().over(w) == 1}
    )
    ends = placed.groupBy("__p", *by).agg(
        F.count("*").alias("__n"),
        *[F.sum(f"__t{j}").alias(f"__t{j}") for j in range(len(totals))],
        *[F.max_by(F.struct(f"__b{j}"), "__i").alias(f"__b{j}") for j in range(len(before))],
        *[F.max_by(f"__c{j}", F.when(F.col(f"__c{j}").isNotNull(), F.col("__i"))).alias(f"__c{j}") for j in range(len(carried))],
    )
    # only keys that go over a border have a part before them: at most one a partition
    several = Window.partitionBy(*by).orderBy("__p")
    earlier = several.rowsBetween(Window.unboundedPreceding, -1)
    if by:
        cut = ends.groupBy(*by).agg(F.count("*").alias("__k")).filter("__k > 1").drop("__k")
        ends = ends.join(cut, list(by), "left_semi")
    offsets = ends.select(
        F.col("__p").alias("__po"), *[F.col(c).alias(f"__k{j}") for j, c in enumerate(by)], F.lag(F.lit(1)).over(several).alias("__has"),
        *[F.sum(f"__t{j}").over(earlier).alias(f"__to{j}") for j in range(len(totals))],
        *[F.lag(f"__b{j}").over(several).alias(f"__bo{j}") for j in range(len(before))],
        *[F.last(f"__c{j}", ignorenulls=True).over(earlier).alias(f"__co{j}") for j in range(len(carried))],
    ).filter("__has = 1").drop("__has")
    match = F.col("__p") == F.col("__po")
    for j, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"__k{j}"))
    joined = out.join(F.broadcast(offsets), match, "left")
    result = [F.col(f"`{c}`") for c in df.columns if c not in totals and c not in before and c not in carried]
    result += [(F.col(f"__T{j}") + F.coalesce(f"__to{j}", F.lit(0))).alias(name) for j, name in enumerate(totals)]
    result += [F.when(F.col("__first"), F.col(f"__bo{j}.__b{j}")).otherwise(F.col(f"__B{j}")).alias(name) for j, name in enumerate(before)]
    result += [F.coalesce(f"__C{j}", f"__co{j}").alias(name) for j, name in enumerate(carried)]
    return joined.select(*result)


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """The rows with their 1-based position in the order."""
    return running(df, [], order, totals={name: F.lit(1).cast("long")})
