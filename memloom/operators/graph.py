"""Graph operators: degrees, reachability, paths, rankings, components, communities.

Edges are (src, dst, ..), node columns ``id``.  Loops run on the driver but every
step is a join over the whole frontier; lineage is cut by tables in the shared
folder.  Nothing but counts and convergence measures comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.ordering import running
from memloom.session import materialize, release


# ---- degrees and files ---------------------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree) of all nodes with an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.select("e.*").groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, leave_out: tuple[str, ...] = (), *, group: str | None = None) -> DataFrame:
    """The nodes of highest degree: a tenth of them, 3 to 20; ties to the smaller id; types in ``leave_out`` don't count."""
    d = nodes.filter(~F.col("node_type").isin(*leave_out)) if leave_out else nodes
    d = d.join(degrees(edges).select("id", "degree"), "id").filter("degree > 0")
    n = F.broadcast(d.agg(F.count("*").alias("n")))  # one row
    limit = F.least(F.col("n"), F.greatest(F.lit(3), F.least(F.lit(20), F.floor(F.col("n") / 10))))
    top = d.orderBy(F.desc("degree"), "id").limit(20).withColumn("r", F.row_number().over(Window.orderBy(F.desc("degree"), "id")))
    return top.join(n).filter(F.col("r") <= limit).drop("r", "n")


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, afferent, efferent, instability, grade) over files linked across files."""
    f = nodes.select("id", "file_path")
    pairs = edges.join(f.select(F.col("id").alias("src"), F.col("file_path").alias("a")), "src").join(f.select(F.col("id").alias("dst"), F.col("file_path").alias("b")), "dst")
    pairs = pairs.filter("a <> b").select("a", "b").distinct()
    ce = pairs.groupBy(F.col("a").alias("file_path")).agg(F.count("*").alias("efferent"))
    ca = pairs.groupBy(F.col("b").alias("file_path")).agg(F.count("*").alias("afferent"))
    both = ca.join(ce, "file_path", "full").fillna(0, ["afferent", "efferent"])
    i = F.col("efferent") / (F.col("afferent") + F.col("efferent"))
    grade = F.when(i < 0.3, "stable").when(i <= 0.7, "balanced").otherwise("unstable")
    return both.select("file_path", "afferent", "efferent", F.round(i, 6).alias("instability"), grade.alias("grade"))


# ---- reachability --------------------------------------------------------------------------------

#: Levels of a walk that are kept as tables of their own.
_LEVELS = 24


def reach(edges: DataFrame, start: DataFrame, depth: int, *, reverse: bool = False, labels: list[str] | None = None, least_weight: float | None = None) -> DataFrame:
    """(id, depth, via, parent): nodes reached from the start ids within ``depth`` steps, start left out.

    ``depth`` is that of the first visit; among edges of that step the smallest
    (parent, label) counts.  ``reverse`` follows edges backwards.
    """
    spark = edges.sparkSession
    step = edges.filter(F.col("label").isin(*labels)) if labels else edges
    if least_weight is not None:
        step = step.filter(F.coalesce("weight", F.lit(1.0)) >= least_weight)
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = step.select(F.col(a).alias("from"), F.col(b).alias("to"), "label")
    first = start.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"), F.col("id").alias("parent"))
    frontier, path = materialize(first, "frontier")
    schema, paths = first.schema, [path]
    for d in range(1, depth + 1):
        seen = spark.read.schema(schema).parquet(*paths)
        found = step.join(frontier.select(F.col("id").alias("from")), "from").join(seen.select(F.col("id").alias("to")), "to", "left_anti")
        first = found.groupBy("to").agg(F.min(F.struct("from", "label")).alias("m")).select(F.col("to").alias("id"), F.lit(d).alias("depth"), F.col("m.label").alias("via"), F.col("m.from").alias("parent"))
        frontier, path = materialize(first, "frontier")
        if frontier.isEmpty():
            release(spark, path)
            break
        paths.append(path)
        if len(paths) > _LEVELS:  # long walks: many small levels become one table
            _, whole = materialize(spark.read.schema(schema).parquet(*paths), "seen")
            release(spark, *paths[:-1])
            paths = [whole]
            frontier = spark.read.schema(schema).parquet(whole).filter(F.col("depth") == d)
            release(spark, path)
    return spark.read.schema(schema).parquet(*paths).filter("depth > 0")


def shortest_path(edges: DataFrame, source: int, target: int, depth: int = 12, labels: list[str] | None = None) -> DataFrame:
    """(step, id): one shortest directed path, by smallest parents; empty without one within ``depth``."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(source,)], "id long")
    seen, _ = materialize(reach(edges, start, depth, labels=labels), "reached")
    walk: list[int] = [target]
    if source != target:
        while walk[-1] != source:
            row = seen.filter(F.col("id") == walk[-1]).select("parent").first()  # one row a step, at most ``depth``
            if row is None:
                return spark.createDataFrame([], "step long, id long")
            walk.append(row["parent"])
    return spark.createDataFrame(list(enumerate(reversed(walk))), "step long, id long")


def khop_subgraph(edges: DataFrame, seeds: DataFrame, hops: int = 2, most: int = 8_000) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, hop) within ``hops`` undirected steps of the seeds, nearest and smallest first up to ``most``, and the edges among them, each once."""
    both = edges.select("src", "dst", "label").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label"))
    near = reach(both, seeds, hops).select("id", F.col("depth").alias("hop")).unionByName(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    kept, _ = materialize(near.orderBy("hop", "id").limit(most), "khop")
    inside = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept, inside.dropDuplicates(["src", "dst", "label"])


def impact_grade(target_hub: Column, hub_hit: Column, n: Column) -> Column:
    """High if the target or a node it affects is a hub or more than 8 are affected, Medium above 2, else Low."""
    return F.when(target_hub | hub_hit | (n > 8), "High").when(n > 2, "Medium").otherwise("Low")


def dead_nodes(nodes: DataFrame, edges: DataFrame, types: list[str], usage: list[str], serving: list[str], entrypoint: Column) -> DataFrame:
    """Nodes of the types without incoming usage edges (loops don't count), without outgoing serving edges, that are no entry points."""
    used = edges.filter(F.col("label").isin(*usage) & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("id"))
    serves = edges.filter(F.col("label").isin(*serving)).select(F.col("src").alias("id"))
    symbols = nodes.filter(F.col("node_type").isin(*types) & entrypoint.isNull())
    return symbols.join(used, "id", "left_anti").join(serves, "id", "left_anti")


# ---- ranking -------------------------------------------------------------------------------------


def pagerank(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, iterations: int = 20, tolerance: float | None = None, superseded: DataFrame | None = None) -> DataFrame:
    """(id, rank): personalised PageRank; edges (src, dst, w), seeds (id, weight).

    Weights of a source are normalised; what dangling nodes hold and the teleport
    go to the seeds.  Damping lies in 0.5..0.85, iterations are at most 20; with
    ``tolerance`` it ends early once the ranks change by less in sum.  Nodes in
    ``superseded`` neither get nor give anything.  Edges whose weight isn't
    positive don't count; without seeds the result is empty.

    A step is linear, so the ranks are a sum of what the seeds' own weights become after 0, 1, 2, .. steps
    over edges alone.  Only these powers are computed, one join and one aggregate each;
    how much of each counts follows from their sums, which is all the driver sees.
    """
    spark = edges.sparkSession
    damping, iterations = min(0.85, max(0.5, damping)), min(20, max(1, iterations))
    good = edges.filter(F.col("w").isNotNull() & ~F.isnan("w") & (F.col("w") > 0) & (F.col("w") < float("inf")))
    start = seeds.filter("weight > 0")
    if superseded is not None:
        gone = superseded.select("id").distinct()
        good = good.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        start = start.join(gone, "id", "left_anti")
    total = good.groupBy("src").agg(F.sum("w").alias("total"))
    arcs, arcs_path = materialize(good.join(total, "src").groupBy("src", "dst").agg(F.sum(F.col("w") / F.col("total")).alias("p")), "arcs")
    seed_sum = F.broadcast(start.agg(F.sum("weight").alias("s")))  # one row
    first = start.groupBy("id").agg(F.sum("weight").alias("weight")).join(seed_sum).select("id", (F.col("weight") / F.col("s")).alias("rank"), F.lit(0).alias("step"))
    power, path = materialize(first, "powers")
    schema, paths, shares = power.schema, [path], [1.0]
    for i in range(1, iterations + 1):
        moved = power.join(arcs, power["id"] == arcs["src"]).groupBy(F.col("dst").alias("id")).agg((damping * F.sum(F.col("rank") * F.col("p"))).alias("rank"))
        power, path = materialize(moved.withColumn("step", F.lit(i)), "powers")
        paths.append(path)
        if tolerance is not None:
            powers = spark.read.schema(schema).parquet(*paths)
            before, shares = shares, _shares(_sums(powers), i)
            change = _weighted_sum(powers, [b - a for a, b in zip([*before, 0.0], shares)]).agg(F.sum(F.abs("rank")).alias("c")).first()["c"]
            if (change or 0.0) < tolerance:
                break
    powers = spark.read.schema(schema).parquet(*paths)
    release(spark, arcs_path)
    return _weighted_sum(powers, _shares(_sums(powers), len(paths) - 1))


def _sums(powers: DataFrame) -> dict[int, float]:
    return {r["step"]: r["s"] for r in powers.groupBy("step").agg(F.sum("rank").alias("s")).collect()}  # a row a step


def _shares(sums: dict[int, float], steps: int) -> list[float]:
    """How much of each power the ranks after so many steps hold: all move on by one, and what got lost starts anew."""
    shares = [1.0]
    for _ in range(steps):
        moved = sum(c * sums.get(j + 1, 0.0) for j, c in enumerate(shares))
        shares = [1.0 - moved, *shares]
    return shares


def _weighted_sum(powers: DataFrame, shares: list[float]) -> DataFrame:
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("step") + 1)
    return powers.groupBy("id").agg(F.sum(F.col("rank") * share).alias("rank"))


def elbow_cut(hits: DataFrame, score: str = "score", order: tuple[str, ...] = ("id",)) -> DataFrame:
    """The ranked hits up to where the score falls below 0.15 of the best or by more than half at once; none if the best isn't positive."""
    placed = running(hits, [], [F.desc(score), *map(F.col, order)], totals={"__n": F.lit(1)}, before={"__before": F.col(score)})
    best = F.broadcast(hits.agg(F.max(score).alias("__best")))  # one row
    drop = (F.col(score) < 0.15 * F.col("__best")) | ((F.col("__before") > 0) & ((F.col("__before") - F.col(score)) / F.col("__before") > 0.5)) | (F.col("__best") <= 0)
    placed, _ = materialize(placed.join(best).withColumn("__d", F.coalesce(drop, F.lit(False))), "placed")
    stop = F.broadcast(placed.agg(F.min(F.when(F.col("__d"), F.col("__n"))).alias("__stop")))  # one row
    return placed.join(stop).filter(F.col("__stop").isNull() | (F.col("__n") < F.col("__stop"))).select(*hits.columns)


# ---- components ----------------------------------------------------------------------------------


def strong_components(edges: DataFrame, *, rounds: int = 200) -> DataFrame:
    """(id, component): strongly connected components of more than one node, or of one node with a loop; named by their smallest id.

    Colouring: every node takes the smallest id that reaches it, and the nodes of
    a colour that reach its root are one component; they leave, and the rest go on.
    Nodes without incoming or outgoing edges leave first, as they are no part of a cycle.
    """
    spark = edges.sparkSession
    loops = edges.filter("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component")).distinct()
    left, left_path = materialize(edges.filter("src <> dst").select("src", "dst").distinct(), "left")
    done: list[DataFrame] = []
    for _ in range(rounds):
        while True:  # trim
            n = left.count()
            if n == 0:
                break
            kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            kept, kept_path = materialize(kept, "left")
            release(spark, left_path)
            left, left_path = kept, kept_path
            if kept.count() == n:
                break
        if left.isEmpty():
            break
        colour = _smallest_reaching(left)
        inner = left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst").filter("cs = cd")
        roots = colour.filter("id = colour").select("id")
        # a node reached backwards from a root within its colour belongs to that root
        back = reach(inner.select("src", "dst", F.lit("x").alias("label")), roots, 1_000_000, reverse=True)
        members = back.select("id").unionByName(roots).distinct().join(colour, "id").select("id", F.col("colour").alias("component"))
        members, _ = materialize(members, "component")
        done.append(members)
        out = members.select("id")
        rest, rest_path = materialize(left.join(out.withColumnRenamed("id", "src"), "src", "left_anti").join(out.withColumnRenamed("id", "dst"), "dst", "left_anti"), "left")
        release(spark, left_path)
        left, left_path = rest, rest_path
    else:
        raise RuntimeError(f"components not found within {rounds} rounds")
    if not done:
        return loops
    whole = done[0]
    for m in done[1:]:
        whole = whole.unionByName(m)
    sizes = whole.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    return whole.join(sizes, "component", "left_semi").select("id", "component").unionByName(loops).groupBy("id").agg(F.min("component").alias("component"))


def _smallest_reaching(edges: DataFrame) -> DataFrame:
    """(id, colour): the smallest node from which each node can be reached, itself included."""
    spark = edges.sparkSession
    colour, path = materialize(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").alias("colour")), "colour")
    while True:
        came = edges.join(colour.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("came"))
        new = colour.join(came, "id", "left").select("id", F.least("colour", "came").alias("colour"), (F.col("came") < F.col("colour")).alias("changed"))
        new, new_path = materialize(new, "colour")
        release(spark, path)
        colour, path = new.select("id", "colour"), new_path
        if new.filter("changed").isEmpty():
            return colour


def propagate_labels(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): weighted undirected label propagation; edges (src, dst, w).

    Rounds take turns over even and odd ids, so that labels don't swing; a node takes the label with
    the largest sum of edge weights among its neighbours, ties to the smallest label.
    Loops don't count.  Ends early when a pair of rounds changes nothing.
    """
    spark = edges.sparkSession
    both = edges.filter("src <> dst").select("src", "dst", "w")
    both, _ = materialize(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")), "both")
    labels, path = materialize(both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")), "labels")
    still = 0
    for r in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.min(F.struct((-F.round("w", 9)).alias("m"), "community")).alias("b")).select("id", F.col("b.community").alias("new"))
        turn = F.pmod(F.col("id"), F.lit(2)) == r % 2
        new = labels.join(best, "id", "left").select("id", F.when(turn & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("community")).alias("community"), (turn & (F.col("new") != F.col("community"))).alias("changed"))
        new, new_path = materialize(new, "labels")
        quiet = new.filter("changed").isEmpty()
        release(spark, path)
        labels, path = new.select("id", "community"), new_path
        still = still + 1 if quiet else 0
        if still == 2:
            break
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``q``: Σ over communities of (inner weight / m - (degree sum / 2m)²); undirected weights ``w``, loops left out."""
    e = edges.filter("src <> dst")
    a, b = (labels.select(F.col("id").alias(x), F.col("community").alias(f"c_{x}")) for x in ("src", "dst"))
    m = F.broadcast(e.agg(F.sum("w").alias("m")))  # one row
    placed = e.join(a, "src").join(b, "dst")
    inner = placed.filter("c_src = c_dst").groupBy(F.col("c_src").alias("c")).agg(F.sum("w").alias("inside"))
    deg = placed.select(F.explode(F.array("c_src", "c_dst")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("d"))
    q = deg.join(inner, "c", "left").join(m).agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("q"))
    return q


# ---- files and transactions -----------------------------------------------------------------------


def cochange_pairs(items: DataFrame, txn: str, item: str, *, most_items: int = 10, least_count: int = 3) -> DataFrame:
    """(a, b, n, confidence): unordered pairs of items in at least ``least_count`` transactions of 2 to ``most_items`` different items.

    A transaction has at most 45 pairs, formed inside it from its sorted items.
    """
    each = items.select(txn, item).distinct()
    small = each.groupBy(txn).agg(F.count("*").alias("k")).filter(F.col("k").between(2, most_items)).select(txn)
    sets = each.join(small, txn, "left_semi").groupBy(txn).agg(F.array_sort(F.collect_list(item)).alias("s"))  # at most ``most_items``
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.lit(most_items)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    counted = pairs.select("p.*").groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)
    return counted.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.5 + 0.1 * (F.col("n") - 3)), 6))


#: Files of a module in one block.
_FILES_BLOCK = 200


def coimport_weights(imports: DataFrame, file: str, module: str) -> DataFrame:
    """(a, b, w): files sharing a module, Σ over shared modules of 1 / files of the module; the files of a large module meet block by block."""
    m = imports.select(F.col(file).alias("f"), F.col(module).alias("m")).distinct()
    n = m.groupBy("m").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / _FILES_BLOCK).cast("int")
    members = m.join(n, "m").withColumns({"own": F.pmod(F.xxhash64("f"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    left = members.select("m", "n", F.col("own").alias("i"), F.col("other").alias("j"), F.col("f").alias("a"))
    right = members.select("m", F.col("other").alias("i"), F.col("own").alias("j"), F.col("f").alias("b"))
    near = left.join(right, ["m", "i", "j"]).filter("a < b").select("a", "b", (1.0 / F.col("n")).alias("w"))
    return near.groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("w"))


def recent_edit_hint(nodes: DataFrame, edges: DataFrame, as_of: str, usage: list[str], *, minutes: int = 30, most: int = 5) -> DataFrame:
    """(id, caller): the node edited last within ``minutes`` (one with callers if any) and up to ``most`` of its callers."""
    ts = F.lit(as_of).cast("timestamp")
    fresh = nodes.filter((F.col("updated_at") <= ts) & (F.col("updated_at") >= ts - F.expr(f"INTERVAL {minutes} MINUTES"))).select("id", "updated_at")
    calls = edges.filter(F.col("label").isin(*usage) & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("id"), F.col("src").alias("caller")).distinct()
    called = fresh.join(calls.select("id").distinct().withColumn("has", F.lit(1)), "id", "left")
    one = called.orderBy(F.desc(F.coalesce("has", F.lit(0))), F.desc("updated_at"), "id").limit(1).select("id")
    return F.broadcast(one).join(calls, "id", "left").orderBy("caller").limit(most)
