"""Documents mixed so that every source has its target share of the tokens.

Budgets go down a tree of any depth, such as mix, domain, language, source.  What a
node can't give its siblings give, as far as they last; only then its parent's
siblings do, and so on up.  A leaf gives whole epochs of its documents and, of one
more epoch in seeded order, a prefix: the longest within the rest of its budget, and
the document after it where that brings its source nearer to its own.

Only the sums of the leaves come to the driver (one row per leaf); running sums
over a leaf are formed over ranges of the order first, so a leaf may hold any
part of the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.keys import trimmed
from memloom.llm.tokens import TOKENIZER, with_token_counts
from memloom.session import materialize

LEAVES_MOST = 100_000


def usual_spelling(c: Column | str) -> Column:
    """A source or language name in its usual spelling: trimmed, small letters, underscores."""
    return F.regexp_replace(F.lower(trimmed(c)), "[\\s-]+", "_")


def fill_children(budget: float, children: Mapping[str, tuple[float, float]]) -> dict[str, float]:
    """``budget`` over children (weight, capacity) by weight; what one can't take goes to those with room, by weight.

    Gives less than the budget only if all are full.
    """
    given = dict.fromkeys(children, 0.0)
    open_ = {k for k, (w, c) in children.items() if w > 0 and c > 0}
    left = min(budget, sum(children[k][1] for k in open_))
    while open_ and left > 1e-9:
        total = sum(children[k][0] for k in open_)
        full = {k for k in open_ if given[k] + left * children[k][0] / total >= children[k][1]}
        if not full:
            for k in open_:
                given[k] += left * children[k][0] / total
            break
        for k in full:
            left -= children[k][1] - given[k]
            given[k] = children[k][1]
        open_ -= full
    return given


def largest_exact_total(sources: Mapping[str, tuple[float, float]]) -> float:
    """The largest total at which every source that exists can give its share; sources (share, capacity)."""
    there = {k: (w, c) for k, (w, c) in sources.items() if w > 0 and c > 0}
    whole = sum(w for w, _ in there.values())
    return min((c * whole / w for w, c in there.values()), default=0.0)


def tree_budgets(budget: float, leaves: Mapping[tuple, tuple[float, float]], weights: Mapping[tuple, float] | None = None, at: tuple = ()) -> dict[tuple, float]:
    """``budget`` over the leaves (path: weight, capacity) of a tree, from the node ``at`` down.

    A node's weight is that of its leaves, unless ``weights`` gives it one (by path).
    """
    if at in leaves:
        return {at: min(budget, leaves[at][1])}
    children: dict[tuple, dict] = {}
    for path, leaf in leaves.items():
        children.setdefault(path[: len(at) + 1], {})[path] = leaf
    size = lambda path, below: ((weights or {}).get(path, sum(w for w, _ in below.values())), sum(c for w, c in below.values() if w > 0))
    given = fill_children(budget, {path: size(path, below) for path, below in children.items()})
    out: dict[tuple, float] = {}
    for path, below in children.items():
        out |= tree_budgets(given[path], below, weights, path)
    return out


def leaf_budgets(
    targets: Iterable, leaves: Iterable, levels: Sequence[str], total_tokens: Mapping[str, float] | float | str | None = None, weights: Mapping[tuple, float] | None = None
) -> list[tuple]:
    """(mix, path of the leaf, budget) of every leaf with documents.

    targets: rows mix_name, source, target_share, max_repeats; leaves: rows with the levels and tokens.
    A leaf's weight is the share of its source times its part of the source's tokens.
    ``total_tokens`` "listed" is as many tokens as the sources of a mix have.
    """
    source_at = list(levels).index("source")
    sizes = {tuple(x[c] for c in levels): float(x["tokens"]) for x in leaves}
    of_source: dict[str, float] = {}
    for path, n in sizes.items():
        of_source[path[source_at]] = of_source.get(path[source_at], 0.0) + n
    mixes: dict[str, dict] = {}
    for t in targets:
        mixes.setdefault(t["mix_name"], {})[t["source"]] = (float(t["target_share"]), t["max_repeats"])
    out = []
    for mix, rows in sorted(mixes.items()):
        wanted = total_tokens.get(mix) if isinstance(total_tokens, Mapping) else total_tokens
        if wanted is None:
            wanted = largest_exact_total({s: (share, of_source.get(s, 0.0) * most) for s, (share, most) in rows.items()})
        elif wanted == "listed":
            wanted = sum(of_source.get(s, 0.0) for s in rows)
        mine = {p: (rows[p[source_at]][0] * n / of_source[p[source_at]], n * rows[p[source_at]][1]) for p, n in sizes.items() if p[source_at] in rows}
        if mine:
            out += [(mix, path, b) for path, b in tree_budgets(float(wanted), mine, weights).items()]
    return out


def _fill_up(cut: DataFrame, levels: Sequence[str]) -> DataFrame:
    """(leaf, taken): which leaves give the document after their prefix too, to fill what the prefixes of their source leave.

    The largest that fits goes first; at last the smallest left if that comes nearer.
    One document a leaf is gathered, over the leaves of one source.
    """
    of_leaf = cut.groupBy("mix_name", *levels).agg(
        (F.first("rest") - F.first("before") - F.sum(F.when(F.col("fits"), F.col("tokens")).otherwise(0))).alias("left"), F.max(F.when(F.col("next"), F.col("tokens"))).alias("tokens")
    )
    leaf = F.struct(*levels)
    of_source = of_leaf.groupBy("mix_name", "source").agg(
        F.sum("left").alias("left"), F.array_sort(F.collect_list(F.when(F.col("tokens").isNotNull(), F.struct((-F.col("tokens")).alias("minus"), leaf.alias("leaf"))))).alias("items")
    )
    kind = of_source.schema["items"].dataType.elementType["leaf"].dataType.simpleString()
    start = F.struct(F.col("left").alias("left"), F.array().cast(f"array<{kind}>").alias("taken"))

    def take(acc: Column, x: Column) -> Column:
        fits = -x["minus"] <= acc["left"]
        return F.struct(F.when(fits, acc["left"] + x["minus"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.array_append(acc["taken"], x["leaf"])).otherwise(acc["taken"]).alias("taken"))

    folded = of_source.withColumn("f", F.aggregate("items", start, take))
    folded = folded.withColumn("rest_items", F.filter("items", lambda x: ~F.array_contains(F.col("f.taken"), x["leaf"])))
    last = F.try_element_at("rest_items", F.lit(-1))
    nearer = (F.size("rest_items") > 0) & (-last["minus"] < 2 * F.col("f.left"))
    taken = F.when(nearer, F.array_append("f.taken", last["leaf"])).otherwise(F.col("f.taken"))
    return folded.select("mix_name", F.explode(taken).alias("t")).select("mix_name", "t.*", F.lit(True).alias("taken"))


def mix_sources(
    docs: DataFrame, id_col: str, text_col: str, levels: Mapping[str, Column], targets: DataFrame, *,
    total_tokens: Mapping[str, float] | float | str | None = None, weights: Mapping[tuple, float] | None = None, seed: int = 17, tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """Selection (mix_name, levels.., doc, tokens, repeats) and report, one row per target.

    ``levels`` are the levels of the tree below a mix, from the top down, as names and
    expressions; one is ``source``, which the targets name.  Null values of others are ``und``.
    ``weights`` sets the weight of inner nodes by their path (see :func:`tree_budgets`).

    The report has mix_name, source, target_share, budget_tokens, tokens,
    actual_share, documents, most_repeats.  ``total_tokens`` is the size of the mix, for
    all or by name, or "listed" for the tokens of its sources counted once; unset it is the
    largest at which no source that exists falls
    short.  A source that doesn't exist gets nothing and the others its share.
    No document is used more than ``max_repeats`` times.  Null or empty texts are
    never chosen; rows with the same id are documents of their own.
    """
    spark = docs.sparkSession
    names = list(levels)
    wanted = targets.select("mix_name", usual_spelling("source").alias("source"), "target_share", "max_repeats").limit(LEAVES_MOST + 1).collect()
    if len(wanted) > LEAVES_MOST:
        raise ValueError(f"more than {LEAVES_MOST} targets")
    keep = {n: c if n == "source" else F.coalesce(c, F.lit("und")) for n, c in levels.items()}
    listed = docs.filter(keep["source"].isin(*{t["source"] for t in wanted})) if wanted else docs.limit(0)
    sized = with_token_counts(listed, id_col, text_col, keep=keep, tokenizer=tokenizer).filter("tokens > 0")
    sized, _ = materialize(sized, "sized")
    leaves = sized.groupBy(*names).agg(F.sum("tokens").alias("tokens")).limit(LEAVES_MOST + 1).collect()
    if len(leaves) > LEAVES_MOST:
        raise ValueError(f"more than {LEAVES_MOST} leaves")
    of_leaf = {tuple(x[n] for n in names): x["tokens"] for x in leaves}
    rows = []
    for mix, path, budget in leaf_budgets(wanted, leaves, names, total_tokens, weights):
        epochs = int((budget + 0.5) // of_leaf[path])
        rows.append((mix, *path, epochs, float(budget - epochs * of_leaf[path])))
    schema = "mix_name string, " + ", ".join(f"`{n}` string" for n in names) + ", epochs int, rest double"
    plan = F.broadcast(spark.createDataFrame(rows, schema))  # a row per mix and leaf

    leaf = ["mix_name", *names]
    turn = F.xxhash64(F.lit(seed), "mix_name", "epochs", "id")
    drawn = sized.join(plan, names).withColumns({"turn": turn, "range": F.shiftright(turn, 64 - 10)})
    ranges = drawn.groupBy(*leaf, "range").agg(F.sum("tokens").alias("n"))
    ranges = ranges.select(*leaf, "range", (F.sum("n").over(Window.partitionBy(*leaf).orderBy("range")) - F.col("n")).alias("before"), "n")
    placed = drawn.join(ranges, [*leaf, "range"])
    # a range lies before, across or after the end of the prefix; only one across needs the order within
    across = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest"))
    order = Window.partitionBy(*leaf, "range").orderBy("turn", "id")
    cut = placed.filter(across).withColumn("upto", F.col("before") + F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.withColumn("fits", F.col("upto") <= F.col("rest"))
    nth = F.row_number().over(Window.partitionBy(*leaf, "fits").orderBy("turn", "id"))
    cut = cut.withColumn("next", ~F.col("fits") & (nth == 1))
    cut = cut.join(_fill_up(cut, names), leaf, "left").withColumn("more", (F.col("fits") | (F.col("next") & F.coalesce("taken", F.lit(False)))).cast("int"))
    columns = [*leaf, "id", "tokens", "epochs", "more"]
    sure = placed.filter(~across).withColumn("more", (F.col("before") + F.col("n") <= F.col("rest")).cast("int"))
    chosen = sure.select(*columns).unionByName(cut.select(*columns)).withColumn("repeats", F.col("epochs") + F.col("more")).filter("repeats > 0")
    chosen = chosen.select(*leaf, F.col("id").alias("doc"), "tokens", "repeats")

    sums = chosen.groupBy("mix_name", "source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats")
    )
    budgets: dict[tuple[str, str], float] = {}
    for mix, *path, epochs, rest in rows:
        at = mix, path[names.index("source")]
        budgets[at] = budgets.get(at, 0.0) + epochs * of_leaf[tuple(path)] + rest
    asked = spark.createDataFrame(
        [(t["mix_name"], t["source"], float(t["target_share"]), round(budgets.get((t["mix_name"], t["source"]), 0.0))) for t in wanted],
        "mix_name string, source string, target_share double, budget_tokens long",
    )
    whole = Window.partitionBy("mix_name")  # a row per target
    report = asked.join(sums, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents", "most_repeats"])
    share = F.when(F.sum("tokens").over(whole) > 0, F.round(F.col("tokens") / F.sum("tokens").over(whole), 6)).otherwise(0.0)
    return chosen, report.withColumn("actual_share", share)
