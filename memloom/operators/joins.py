"""Join-shaped operators over records, links, nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators.ordering import running
from memloom.session import materialize


def labelled_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the labels of both ends (inner on both)."""
    s = nodes.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    t = nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(s, "src").join(t, "dst")


def edges_with_target_type(edges: DataFrame, nodes: DataFrame, instead: str = "ExternalModule") -> DataFrame:
    """Edges with the type of their target, another word where the target isn't a node (left outer)."""
    t = nodes.select(F.col("id").alias("dst"), "node_type")
    return edges.join(t, "dst", "left").withColumn("node_type", F.coalesce("node_type", F.lit(instead)))


def without_outgoing(nodes: DataFrame, edges: DataFrame, labels: list[str]) -> DataFrame:
    """Nodes that no edge with one of the labels starts from (anti join)."""
    starts = edges.filter(F.col("label").isin(*labels)).select(F.col("src").alias("id"))
    return nodes.join(starts, "id", "left_anti")


def in_set(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Rows all of whose named columns are ids of the set (semi joins)."""
    for c in columns:
        df = df.join(ids.select(F.col("id").alias(c)).distinct(), c, "left_semi")
    return df


def neighbours_of(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): nodes one step from a seed in either direction, seeds left out."""
    s = seeds.select("id").distinct()
    out = edges.join(s.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    into = edges.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return out.unionByName(into).distinct().join(s, "id", "left_anti")


def conflicts_within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, dst, weight): ``contradicts`` edges with both ends in the set."""
    return in_set(edges.filter("label = 'contradicts' AND src <> dst"), ids, "src", "dst").select("src", "dst", "weight")


def superseded_within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id): members of the set that another member supersedes."""
    return in_set(edges.filter("label = 'supersedes' AND src <> dst"), ids, "src", "dst").select(F.col("dst").alias("id")).distinct()


def without_superseded(pool: DataFrame, edges: DataFrame) -> DataFrame:
    """The pool (id) without members that another supersedes, unless that would empty it."""
    old = superseded_within(edges, pool)
    counts = F.broadcast(old.agg(F.count("*").alias("o")).join(pool.agg(F.count("*").alias("p"))))  # one row
    marked = pool.join(old.withColumn("old", F.lit(True)), "id", "left").join(counts)
    return marked.filter((F.col("o") == F.col("p")) | F.col("old").isNull()).drop("old", "o", "p")


def last_start_before(events: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str | None = None) -> DataFrame:
    """Each event with the span of its group that starts last at or before it; with ``end`` only spans that reach it.

    Both sides are merged in one sorted pass (union and a running last value), so
    no group is joined with itself.  Events without a span are left out.
    """
    e_cols = [c for c in events.columns if c not in by]
    s_cols = [c for c in spans.columns if c not in by]
    s_struct, e_struct = F.struct(*s_cols), F.struct(*e_cols)
    both = spans.select(*by, F.col(start).alias("__at"), F.lit(0).alias("__e"), s_struct.alias("__span")).unionByName(
        events.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__e"), e_struct.alias("__event")), allowMissingColumns=True
    )
    placed = running(both, by, [F.asc("__at"), F.asc("__e")], carried={"__last": F.col("__span")})
    out = placed.filter("__e = 1 AND __last IS NOT NULL").select(*by, "__event.*", "__last.*")
    return out.filter(F.col(end) >= F.col(at)) if end else out


#: Rows of a table of patterns, at most, that are broadcast for a condition that isn't an equality.
TARGETS_MOST = 10_000


def first_match(refs: DataFrame, targets: DataFrame, ref_id: str, condition: Column, order: Column | str) -> DataFrame:
    """Each ref with its first matching target by ``order``, under any condition.

    The targets are broadcast; more than ``TARGETS_MOST`` are refused.  Where the
    condition is a prefix, suffix or equality use the joins below, which have no such limit.
    """
    if targets.limit(TARGETS_MOST + 1).count() > TARGETS_MOST:
        raise ValueError(f"more than {TARGETS_MOST} targets; join by a key instead")
    joined = refs.join(F.broadcast(targets), condition)
    best = joined.groupBy(ref_id).agg(F.min_by(F.struct(*targets.columns), order).alias("t"))
    return best.select(ref_id, "t.*")


def suffix_matches(paths: DataFrame, suffixes: DataFrame, path: str, suffix: str) -> DataFrame:
    """(path, suffix): all suffixes, whole components of a path, by which a path ends.

    A path is exploded into its own suffixes and joined by equality, so suffixes may be many.
    """
    parts = F.split(F.col(path), "/")
    own = paths.select(path).distinct().withColumn("__s", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))))
    return own.join(suffixes.select(F.col(suffix).alias("__s")).distinct(), "__s").select(path, F.col("__s").alias(suffix))


def shadowed(rows: DataFrame, key: str, scope: str, project: str | None) -> DataFrame:
    """Per key the project's row if there is one, else the global (blank scope) one."""
    wanted = F.coalesce(F.col(scope), F.lit(""))
    kept = rows.filter((wanted == "") | (wanted == F.lit(project or "")))
    return kept.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), wanted).alias("__s")).select(key, "__s.*")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change): added, removed or modified between two snapshots (full outer join); unchanged rows are left out."""
    b = before.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    a = after.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__in_a"))
    change = F.when(F.col("__in_b").isNull(), "added").when(F.col("__in_a").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "modified")
    return b.join(a, keys, "full").select(*keys, change.alias("change")).filter("change IS NOT NULL")


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str, root: str) -> DataFrame:
    """Each path with the longest registered root that is a prefix of whole path components.

    A path is exploded into its own prefixes and joined by equality, so roots may be many.
    """
    parts = F.split(F.rtrim(F.col(path), F.lit("/")), "/")
    own = paths.withColumn("__p", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    joined = own.join(roots.select(F.rtrim(F.col(root), F.lit("/")).alias("__p"), F.col(root).alias(root)).distinct(), "__p")
    return joined.groupBy(path).agg(F.max_by(root, F.length("__p")).alias(root))


def first_existing(candidates: DataFrame, files: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """(id, path): of each row's ordered candidate paths the first that exists."""
    each = candidates.select(id_col, F.posexplode(list_col).alias("pos", "path"))
    return each.join(files.select("path").distinct(), "path").groupBy(id_col).agg(F.min_by("path", "pos").alias("path"))


#: Rows of a key from which on a join splits it, and how many such keys are broadcast at most.
HOT_ROWS = 200_000
_HOT_BROADCAST = 100_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, hot: DataFrame, *, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys`` where some keys hold very many rows of ``left``.

    ``hot``: keys and ``n``, the rows that each such key has on the left (about).  A hot
    key falls into one part for every ``HOT_ROWS`` rows, by the hash of column ``by``, and its
    rows on the right are repeated for each part; so no task gets a whole hot key.
    Null keys match nothing.  ``how`` is inner or left_semi.
    """
    hot, _ = materialize(hot.select(*keys, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("__parts")), "hot")
    n_hot = hot.count()
    if not n_hot:
        return left.join(right, keys, how)
    tag = F.broadcast(hot) if n_hot <= _HOT_BROADCAST else hot
    part = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("__parts")).cast("int"))
    parts = F.when(F.col("__parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__parts") - 1))
    a = left.join(tag, keys, "left").withColumn("__part", part).drop("__parts")
    b = right.join(tag, keys, "left").withColumn("__part", F.explode(parts)).drop("__parts")
    return a.join(b, [*keys, "__part"], how).drop("__part")
