"""Life cycle of memories, lessons and slots: merging, trust, decay, purging, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import text as X
from memloom.functions.keys import trimmed
from memloom.functions.scoring import round3
from memloom.operators.ordering import global_rank, running
from memloom.session import materialize

IDENTITY, SUSPICION, CONFLICT = 0.98, 0.75, 0.82
# How feedback and revision verdicts change trust.
TRUST_STEPS = {
    "touch": 0.02, "helpful": 0.15, "unhelpful": -0.2, "outdated": -0.3,
    "confirmed": 0.1, "revised_outdated": -0.4, "contradicted": -0.5,
}
# Parts of a newer text that say that it corrects an older one.
CORRECTION_MARKERS = ("не ", "вместо ", "исправ", "на самом деле", "ошиб", "отмен", "not ", "instead", "actually", "wrong")


def _map(c: Column | str) -> Column:
    return F.coalesce(F.from_json(F.col(c) if isinstance(c, str) else c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def _merged(over: Column, under: Column) -> Column:
    """JSON of two maps; ``over`` wins."""
    keep = F.map_filter(under, lambda k, v: ~F.map_contains_key(over, k))
    return F.to_json(F.map_concat(keep, over))


def merge_meta_existing(existing: Column | str, incoming: Column | str) -> Column:
    """Union of two JSON objects; the existing value of a field wins.  What isn't a JSON object counts as empty."""
    return _merged(_map(existing), _map(incoming))


def merge_meta_incoming(existing: Column | str, incoming: Column | str) -> Column:
    """Union of two JSON objects; the incoming value of a field wins."""
    return _merged(_map(incoming), _map(existing))


def save_action(cos: Column) -> Column:
    """What saving a record does whose closest neighbour has this cosine: update it, mark a merge candidate, or insert."""
    return F.when(cos >= IDENTITY, "update").when(cos >= SUSPICION, "merge_candidate").otherwise("insert")


def auto_links(records: DataFrame, id_col: str, group: str, updated: str, most: int = 5) -> DataFrame:
    """(from_id, to_id): each record with the ``most`` records of its group updated last before it.

    Records are numbered within their group and meet by (group, number), so a
    group of any size is spread and none is joined with itself.
    """
    rows = records.filter(F.col(group).isNotNull()).select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.col(updated).alias("u"))
    n = running(rows, ["g"], [F.asc_nulls_first("u"), F.asc("id")], totals={"n": F.lit(1).cast("long")})
    later = n.select("g", F.col("id").alias("from_id"), F.explode(F.sequence(F.col("n") - most, F.col("n") - 1)).alias("n"))
    return later.join(n.select("g", "n", F.col("id").alias("to_id")), ["g", "n"]).select("from_id", "to_id")


def duplicate_report(pairs: DataFrame, records: DataFrame, id_col: str, trust: Column, importance: Column) -> DataFrame:
    """(a, b, cos, is_identity, canonical): each record's closest pair, each pair once; canonical has more trust, then importance, then the smaller id."""
    from memloom.operators.similarity import best_neighbour

    best = best_neighbour(pairs)
    once = best.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), "cos").distinct()
    r = records.select(F.col(id_col).alias("id"), F.struct(trust.alias("t"), importance.alias("i")).alias("k"))
    joined = once.join(r.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(r.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    return joined.select("a", "b", "cos", (F.col("cos") >= IDENTITY).alias("is_identity"), F.when(F.col("kb") > F.col("ka"), F.col("b")).otherwise(F.col("a")).alias("canonical"))


def merge_records(records: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """(canonical, members, importance, access_count, first_created): groups of ``mapping`` (key, canonical) merged: highest importance, summed access."""
    joined = records.join(mapping, key)
    return joined.groupBy("canonical").agg(
        F.count("*").alias("members"), F.max("importance").alias("importance"), F.sum("access_count").alias("access_count"), F.min("created_at").alias("first_created")
    )


def redirect_links(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct links (src, dst, label) with both ends moved to their canonical id; loops that this makes are dropped.  mapping: id, canonical."""
    a, b = (mapping.select(F.col("id").alias(x), F.col("canonical").alias(f"c_{x}")) for x in ("src", "dst"))
    moved = links.join(a, "src", "left").join(b, "dst", "left")
    return moved.select(F.coalesce("c_src", "src").alias("src"), F.coalesce("c_dst", "dst").alias("dst"), "label").filter("src <> dst").distinct()


def weak_records(records: DataFrame, *, trust: float = 0.35, importance: float = 0.35, access: int = 20) -> DataFrame:
    """Records weak enough to be compacted: low trust, low importance, seldom used."""
    return records.filter((F.col("trust") < trust) & (F.col("importance") < importance) & (F.col("access_count") < access))


def _folded(first, d):
    """(d, lo, hi) of each run of clamped additions; runs begin at ``first``.  Neighbours in a run are composed, half as many are left, and so on."""
    import numpy as np

    run = np.zeros(len(d), np.int64)
    run[first] = 1
    run = np.cumsum(run) - 1
    lo, hi = np.clip(d, 0.0, 1.0), np.clip(1.0 + d, 0.0, 1.0)
    while len(d) > len(first):
        at = np.arange(len(d)) - np.searchsorted(run, run)  # place within the run
        left = np.flatnonzero(at % 2 == 0)
        pair = np.append(run[1:] == run[:-1], False)[left]
        i, j = left[pair], left[pair] + 1
        d2, lo2, hi2 = d[left], lo[left], hi[left]
        d2[pair] += d[j]
        lo2[pair] = np.minimum(hi[j], np.maximum(lo[j], lo[i] + d[j]))
        hi2[pair] = np.minimum(hi[j], np.maximum(lo[j], hi[i] + d[j]))
        d, lo, hi, run = d2, lo2, hi2, run[left]
    return d, lo, hi


def trust_after(events: DataFrame, start: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, trust): the start trust after all events in order, each step clamped to 0..1.

    Clamped additions compose: k of them map x to min(hi, max(lo, x + d)), with
    lo and hi the results of 0 and 1, since the map is monotone.  So runs of a
    key's events are folded range by range and the few ranges in order, and a key
    with very many events is never gathered.  events: key, verdict and the order columns.
    """
    step = F.lit(0.0)
    for name, d in TRUST_STEPS.items():
        step = F.when(F.col("verdict") == name, F.lit(d)).otherwise(step)
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = events.select(F.col(key).alias("__k"), *order, step.alias("__d")).repartitionByRange(n, "__k", *order).sortWithinPartitions("__k", *order)
    kind = ranged.schema["__k"].dataType.simpleString()

    def fold(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            k, d = batch.column(0), batch.column(2).to_numpy()
            code = k.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            runs = _folded(first, d)
            yield pa.RecordBatch.from_arrays([k.take(pa.array(first)), batch.column(1).take(pa.array(first)), *map(pa.array, runs)], names=["__k", "first", "d", "lo", "hi"])

    numbered = ranged.select("__k", F.monotonically_increasing_id().alias("i"), F.col("__d").alias("d"))
    parts = numbered.mapInArrow(fold, f"__k {kind}, first long, d double, lo double, hi double")
    chains = parts.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("first", "d", "lo", "hi"))).alias("__parts"))  # one an Arrow batch at most
    after = F.aggregate("__parts", F.col("trust"), lambda x, p: F.least(p["hi"], F.greatest(p["lo"], x + p["d"])))
    out = start.join(chains, F.col(key) == F.col("__k"), "left")
    return out.select(key, F.round(F.when(F.col("__parts").isNull(), F.col("trust")).otherwise(after), 6).alias("trust"))


def decayed(records: DataFrame, rate: float) -> DataFrame:
    """Importance times (1 - rate) but at least 0.01, trust times (1 - rate) but at least 0; tombstones too."""
    return records.withColumns({"importance": F.greatest(F.lit(0.01), F.col("importance") * (1 - rate)), "trust": F.greatest(F.lit(0.0), F.col("trust") * (1 - rate))})


def reinforced(confidence: Column, times: Column) -> Column:
    """Confidence after n reinforcements, each c + 0.1 (1 - c) rounded to 3 digits."""
    return F.aggregate(F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>")), confidence.cast("double"), lambda c, _: round3(c + 0.1 * (1 - c)))


def decay_sweep(lessons: DataFrame, as_of: str) -> DataFrame:
    """Live lessons with their confidence after the sweep: less by rate times idle weeks, at least 0.05, unchanged within the first week or without a rate."""
    base = F.coalesce("last_decayed_at", "last_reinforced_at", "created_at")
    weeks = (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(base)) / (7 * 86400.0)
    rate = F.when(~F.isnan("decay_rate"), F.col("decay_rate"))
    new = round3(F.greatest(F.lit(0.05), F.col("confidence") - rate * weeks))
    return lessons.filter(F.col("deleted_at").isNull()).withColumn("new_confidence", F.when((weeks >= 1) & rate.isNotNull(), new).otherwise(F.col("confidence")))


def conflict_pairs(records: DataFrame, pairs: DataFrame, *, least: float = CONFLICT) -> DataFrame:
    """(a, b, cos): pairs above ``least`` of one category, of no two different projects, and about a common entity.

    records: id, category, project (null: none), content, entities.  A record without
    entities fits if its text contains one of the other's; two without fit.
    """
    r = records.select("id", "category", "project", F.lower("content").alias("text"), "entities")
    side = lambda x: r.select(*[F.col(c).alias(f"{c}_{x}") for c in r.columns])
    joined = pairs.filter(F.col("cos") > least).join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    none_a, none_b = F.size("entities_a") == 0, F.size("entities_b") == 0
    named_in = lambda ents, text: F.exists(ents, lambda e: F.contains(F.col(text), e))
    about = (
        F.when(none_a & none_b, True).when(none_a, named_in("entities_b", "text_a")).when(none_b, named_in("entities_a", "text_b"))
        .otherwise(F.arrays_overlap("entities_a", "entities_b"))
    )
    same_project = F.col("project_a").isNull() | F.col("project_b").isNull() | (F.col("project_a") == F.col("project_b"))
    return joined.filter((F.col("category_a") == F.col("category_b")) & same_project & about).select("a", "b", "cos")


def classify_conflicts(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(older, newer, relation): COEXISTS, CONTRADICTS or SUPERSEDES; pairs with equal trimmed texts are none.

    records: id, content, updated_at.  Equal times make the smaller id the older.
    """
    r = records.select("id", "content", "updated_at")
    j = pairs.join(r.select(F.col("id").alias("a"), F.col("content").alias("ca"), F.col("updated_at").alias("ua")), "a").join(
        r.select(F.col("id").alias("b"), F.col("content").alias("cb"), F.col("updated_at").alias("ub")), "b"
    )
    first = (F.col("ua") <= F.col("ub")) | F.col("ua").isNull()
    j = j.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("older"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("newer"),
        F.when(first, F.col("ca")).otherwise(F.col("cb")).alias("old"), F.when(first, F.col("cb")).otherwise(F.col("ca")).alias("new"),
    ).filter(trimmed("old") != trimmed("new"))
    eo, en = X.mentioned_environments("old"), X.mentioned_environments("new")
    apart = (F.size(eo) > 0) & (F.size(en) > 0) & ~F.arrays_overlap(eo, en)
    corrects = F.lit(False)
    for m in CORRECTION_MARKERS:
        corrects = corrects | F.contains(F.lower("new"), F.lit(m))
    return j.select("older", "newer", F.when(apart, "COEXISTS").when(corrects, "CONTRADICTS").otherwise("SUPERSEDES").alias("relation"))


def apply_resolutions(records: DataFrame, resolutions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with status and valid_until, new edges): superseded and contradicted older rows are closed once; edges are added only where absent."""
    new = resolutions.select(F.col("newer").alias("src"), F.col("older").alias("dst"), F.lower("relation").alias("label")).distinct()
    added = new.join(edges.select("src", "dst", "label"), ["src", "dst", "label"], "left_anti")
    closed = resolutions.filter(F.col("relation").isin("SUPERSEDES", "CONTRADICTS")).groupBy(F.col("older").alias("id")).agg(F.min("newer").alias("closed_by"))
    out = records.join(closed, "id", "left").withColumn("status", F.when(F.col("closed_by").isNotNull(), "SUPERSEDED").otherwise("ACTIVE"))
    return out, added


def pinned_context(slots: DataFrame, project: str | None, budget: int = 1500) -> DataFrame:
    """(label, content): the project's view of pinned, non-blank slots in alphabetical order, those that still fit the budget of characters.

    Slots are few (a person's scratchpads); they are folded in one array.
    """
    from memloom.operators.joins import shadowed

    rows = shadowed(slots.filter(F.col("pinned") & (trimmed("content") != "")), "label", "project", project)
    size = F.octet_length(F.concat(F.lit("## "), F.col("label"), F.lit("\n"), trimmed("content"), F.lit("\n\n")))
    return greedy_budget(rows.select("label", F.col("content"), size.alias("size")), ["label"], "size", budget - 14, ["label", "content"])


def greedy_budget(rows: DataFrame, order: list[str | Column], size: str, budget: int, keep: list[str], *, pool_most: int = 10_000) -> DataFrame:
    """The rows that fit a budget when taken in order, skipping those too large for what is left.

    ``pool_most`` rows are folded at a time; the next ones are the first after them that are no
    larger than the room left, until there are none.  Only the room and the place come to the driver.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    placed, _ = materialize(global_rank(rows.select("*", F.col(size).cast("long").alias("__s")), order, "__n"), "placed")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("taken"))
    room, last = budget, 0
    parts = []
    while True:
        pool = placed.filter((F.col("__n") > last) & (F.col("__s") <= room)).select("__n", "__s").orderBy("__n").limit(pool_most)
        left = room

        def step(acc: Column, x: Column) -> Column:
            ok = acc["used"] + x["__s"] <= left  # noqa: B023
            return F.struct(F.when(ok, acc["used"] + x["__s"]).otherwise(acc["used"]).alias("used"), F.when(ok, F.array_append(acc["taken"], x["__n"])).otherwise(acc["taken"]).alias("taken"))

        items = pool.agg(F.array_sort(F.collect_list(F.struct("__n", "__s"))).alias("items"))  # at most ``pool_most``
        folded = items.select(F.size("items").alias("seen"), F.array_max("items.__n").alias("last"), F.aggregate("items", start, step).alias("f"))
        folded, _ = materialize(folded.select("seen", "last", "f.used", "f.taken"), "folded")
        at = folded.select("seen", "last", "used").first()
        parts.append(folded.select(F.explode("taken").alias("__n")))
        if at["seen"] < pool_most:
            break
        room, last = room - at["used"], at["last"]
    taken = parts[0]
    for p in parts[1:]:
        taken = taken.unionByName(p)
    return placed.join(taken, "__n", "left_semi").select(*keep)


def prefix_budget(rows: DataFrame, order: list[Column], size: str, budget: int) -> DataFrame:
    """The longest prefix in order whose sizes sum to at most the budget."""
    placed = running(rows, [], order, totals={"__run": F.col(size).cast("long")})
    return placed.filter(F.col("__run") <= budget).drop("__run")


def capped_running_mean(samples: DataFrame, key: str, order: list[str], value: str, cap: int = 10, stale: float = 3600.0) -> DataFrame:
    """(key, mean): avg += (x - avg) / min(n + 1, cap) over the samples in order; larger samples than ``stale`` are ignored.

    The result is a weighted sum whose weights follow from a sample's number and
    the count: 1 / count up to ``cap`` samples; beyond, a sample loses 1 / cap of its weight
    with each later one.  So nothing is gathered per key.
    """
    s = samples.filter((F.col(value) <= stale) & F.col(value).isNotNull()).select(key, *order, F.col(value).alias("x"))
    n = running(s, [key], [F.asc(o) for o in order], totals={"i": F.lit(1).cast("long")})
    counts = s.groupBy(key).agg(F.count("*").alias("n"))
    keep = 1.0 - 1.0 / cap
    late = F.when(F.col("i") >= cap, F.pow(F.lit(keep), F.col("n") - F.col("i")) / cap).otherwise(F.pow(F.lit(keep), F.col("n") - cap + 1) / (cap - 1))
    weight = F.when(F.col("n") < cap, 1.0 / F.col("n")).otherwise(late)
    return n.join(counts, key).groupBy(key).agg(F.round(F.sum(weight * F.col("x")), 6).alias("mean"))


def upsert_records(existing: DataFrame, incoming: DataFrame, key: str, *, values: list[str], project: str = "project_id", deleted: str = "deleted_at") -> DataFrame:
    """Records after saving incoming ones by key: their values replace what was there, a null project keeps the old one, a tombstone is cleared.

    Both sides have the key once, ``values``, the project and, where there is one, the tombstone
    column.  Records that nothing comes in for stay as they are, dead ones too.
    """
    a = existing.select(key, F.struct(*values, project, deleted).alias("__a"))
    b = incoming.select(key, F.struct(*values, project).alias("__b"))
    j = a.join(b, key, "full")
    came = F.col("__b").isNotNull()
    return j.select(
        key, *[F.when(came, F.col(f"__b.{v}")).otherwise(F.col(f"__a.{v}")).alias(v) for v in values],
        F.coalesce(f"__b.{project}", f"__a.{project}").alias(project), F.when(~came, F.col(f"__a.{deleted}")).alias(deleted),
    )


def audit_entries(ledger: DataFrame, *, action: str | None = None, limit: int = 50) -> DataFrame:
    """The last entries of a ledger (entry_id, ts, action, ..), of one action if given."""
    rows = ledger if action is None else ledger.filter(F.col("action") == action)
    return rows.orderBy(F.desc("ts"), F.desc("entry_id")).limit(limit)


def audit_pruned(ledger: DataFrame, as_of: str, days: int) -> DataFrame:
    """The ledger without entries older than ``days``; entries without a time stay."""
    oldest = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return ledger.filter(F.col("ts").isNull() | (F.col("ts") >= oldest))
