"""Connected components by alternating large-star and small-star rewrites.

Each round replaces the edges by edges towards the smallest neighbour until
nothing changes; then every record hangs on the smallest identifier of its
component.  A round is three shuffles whose size is that of the edges.  Nodes
with very many edges (a hub may hold a third of all) are not gathered in one
task: their minimum is pre-aggregated and their edges meet it part by part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.session import materialize, release

#: Edge ends from which on a node may be too many for one task.
_HUB_LEAST = 1_000_000
#: So many hubs at most are broadcast.
_HUBS_BROADCAST = 100_000


def _towards_minimum(arcs: DataFrame, n_arcs: int) -> DataFrame:
    """arcs (u, v) with m, the smallest of u and all v of u."""
    if n_arcs <= _HUB_LEAST:  # no node has more, so each fits a task
        return arcs.withColumn("m", F.least(F.min("v").over(Window.partitionBy("u")), F.col("u")))
    least = arcs.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m")).withColumn("parts", (F.floor(F.col("n") / _HUB_LEAST) + 1).cast("int"))
    hubs = least.filter("parts > 1").select("u", "parts")
    if n_arcs // _HUB_LEAST <= _HUBS_BROADCAST:
        hubs = F.broadcast(hubs)
    part = F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"), F.lit(0))
    spread = arcs.join(hubs, "u", "left").withColumn("part", part).drop("parts")
    minima = least.select("u", F.least("m", "u").alias("m"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return spread.join(minima, ["u", "part"]).drop("part")


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, str, tuple[int, int]]:
    """The edges as a table, its path, and a mark of what they are."""
    table, path = materialize(edges, name)
    r = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return table, path, (r["n"], int(r["h"] or 0))


def connected_components(edges: DataFrame, a: str, b: str, *, node: str = "node", component: str = "component", max_rounds: int = 60) -> DataFrame:
    """One row per node that stands in an edge to another node: ``node``, ``component``.

    The component is the smallest node reachable (strings compare by bytes).
    Edges may repeat and stand in both directions; rows with a null end and loops
    are no edges.  No edges give an empty table; other columns are ignored.
    """
    spark = edges.sparkSession
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    now, path, mark = _written(edges.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_minimum(both, 2 * mark[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_path = materialize(large, "large")
        # every u > v here, so u's smallest neighbour is at the same time its new root
        small = _towards_minimum(large, mark[0])
        links = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new, new_path, new_mark = _written(links.filter("u <> v").distinct(), "edges")
        release(spark, path, large_path)
        now, path = new, new_path
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    members = now.select(F.col("u").alias(node), F.col("v").alias(component))
    roots = now.select(F.col("v").alias(node), F.col("v").alias(component)).distinct()
    return members.unionByName(roots)


def pair_edges(pairs: DataFrame, *, least_cos: float = 0.75) -> DataFrame:
    """The pairs of ``guess_pairs`` that count: trimmed keys, not empty, different, cos high enough.

    A null or NaN cos doesn't count.
    """
    from memloom.functions.keys import trimmed

    cos = F.col("cos")
    return (
        pairs.filter((cos >= least_cos) & ~F.isnan(cos))
        .select(trimmed("a_key").alias("a_key"), trimmed("b_key").alias("b_key"))
        .filter("a_key <> '' AND b_key <> '' AND a_key <> b_key")
    )
