"""Queries of life cycle, replicas, extraction, evaluation and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import scoring as S
from memloom.functions import text as X
from memloom.functions.keys import trimmed, unit_interval
from memloom.operators import evaluation as E
from memloom.operators import extraction as O
from memloom.operators import graph as G
from memloom.operators import joins as J
from memloom.operators import lifecycle as L
from memloom.operators import replica as P
from memloom.operators import search as R
from memloom.operators import sessions as T
from memloom.operators.similarity import approximate_recall, best_neighbour
from memloom.plans.graph_queries import rank_sql
from memloom.plans.base import AS_OF, SQL_GRAPH, Catalog, read, sql_trim, sql_unit, graph_edges, graph_nodes
from memloom.plans.relational_queries import _BEST, _FACTS, _MAPPING, _MSGS, _PAIRS, _SLOTS, _STATS, USAGE, canonical_mapping, close_memories, facts, memory_stats, slots
from memloom.plans.search_queries import _NEAR, _VEC, _bm25_sql, _hybrid, _query_vector, _vectors, hits_rank_sql
from memloom.sources.tables import live

C = Catalog()
QUERIES, ORACLES = C.QUERIES, C.ORACLES
G_ = f"WITH {SQL_GRAPH}"
_TRUST = f"coalesce({sql_unit('trust')}, 0.5)"
_IMP = f"coalesce({sql_unit('importance')}, 0.5)"


def _m(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "memories").withColumns({"trust": F.coalesce(unit_interval("trust"), F.lit(0.5)), "importance": F.coalesce(unit_interval("importance"), F.lit(0.5))})


@C.add("lc_1", f"WITH {_PAIRS}, {_BEST} SELECT mem_id, CASE WHEN cos >= 0.98 THEN 'update' WHEN cos >= 0.75 THEN 'merge_candidate' ELSE 'insert' END AS action FROM memories LEFT JOIN best ON id = mem_id WHERE deleted_at IS NULL")
def lc_1(spark: SparkSession, d: str) -> DataFrame:
    best = best_neighbour(close_memories(spark, d)).select(F.col("id").alias("mem_id"), "cos")
    return live(read(spark, d, "memories")).join(best, "mem_id", "left").select("mem_id", L.save_action(F.col("cos")).alias("action"))


@C.add(
    "lc_2",
    """WITH l AS (SELECT mem_id, unnest([lag(mem_id, 1) OVER w, lag(mem_id, 2) OVER w, lag(mem_id, 3) OVER w, lag(mem_id, 4) OVER w, lag(mem_id, 5) OVER w]) AS to_id
FROM memories WHERE deleted_at IS NULL AND project_id IS NOT NULL WINDOW w AS (PARTITION BY project_id ORDER BY updated_at, mem_id)) SELECT mem_id AS from_id, to_id FROM l WHERE to_id IS NOT NULL""",
)
def lc_2(spark: SparkSession, d: str) -> DataFrame:
    return L.auto_links(live(read(spark, d, "memories")), "mem_id", "project_id", "updated_at")


@C.add(
    "lc_3",
    f"""WITH {_PAIRS}, {_BEST}, o AS (SELECT DISTINCT least(id, neighbour) AS a, greatest(id, neighbour) AS b FROM best)
SELECT o.a, o.b, p.cos >= 0.98 AS is_identity, CASE WHEN ({_TRUST.replace('trust', 'y.trust')}, {_IMP.replace('importance', 'y.importance')}) > ({_TRUST.replace('trust', 'x.trust')}, {_IMP.replace('importance', 'x.importance')}) THEN o.b ELSE o.a END AS canonical
FROM o JOIN pairs p ON p.a = o.a AND p.b = o.b JOIN memories x ON x.mem_id = o.a JOIN memories y ON y.mem_id = o.b""",
)
def lc_3(spark: SparkSession, d: str) -> DataFrame:
    pairs = close_memories(spark, d).withColumn("cos", F.round("cos", 9))
    return L.duplicate_report(pairs, _m(spark, d), "mem_id", F.col("trust"), F.col("importance")).select("a", "b", "is_identity", "canonical")


@C.add(
    "lc_4",
    f"""{G_}, {_MAPPING}, m AS (SELECT a.mem_id AS id, c.mem_id AS canonical FROM mapping JOIN memories a ON a.mem_key = mapping.mem_key JOIN memories c ON c.mem_key = mapping.canonical)
SELECT DISTINCT coalesce(x.canonical, src) AS src, coalesce(y.canonical, dst) AS dst, label FROM edges LEFT JOIN m x ON x.id = src LEFT JOIN m y ON y.id = dst WHERE coalesce(x.canonical, src) <> coalesce(y.canonical, dst)""",
)
def lc_4(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "memories").select("mem_id", "mem_key")
    m = canonical_mapping(spark, d).join(ids.withColumnRenamed("mem_id", "id"), "mem_key").select("id", F.col("canonical").alias("mem_key"))
    return L.redirect_links(graph_edges(spark, d), m.join(ids.withColumnRenamed("mem_id", "canonical"), "mem_key").select("id", "canonical"))


@C.add("lc_5", f"SELECT mem_id FROM memories WHERE deleted_at IS NULL AND {_TRUST} < 0.35 AND {_IMP} < 0.35 AND access_count < 20")
def lc_5(spark: SparkSession, d: str) -> DataFrame:
    return L.weak_records(live(_m(spark, d))).select("mem_id")


@C.add(
    "lc_6",
    """WITH e AS (SELECT user_id, list(CASE event_type WHEN 'purchase' THEN 0.15 WHEN 'error' THEN -0.2 WHEN 'click' THEN -0.3 ELSE 0.02 END::double ORDER BY ts, event_id) AS d FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(d, lambda t, x: least(1.0, greatest(0.0, t + x)), 0.5::double), 6) AS trust FROM e""",
)
def lc_6(spark: SparkSession, d: str) -> DataFrame:
    """Trust of users after their events: views touch, purchases help, errors don't."""
    e = read(spark, d, "events")
    verdict = F.when(F.col("event_type") == "purchase", "helpful").when(F.col("event_type") == "error", "unhelpful").when(F.col("event_type") == "click", "outdated").otherwise("touch")
    start = e.select("user_id").distinct().withColumn("trust", F.lit(0.5))
    return L.trust_after(e.select("user_id", "ts", "event_id", verdict.alias("verdict")), start, "user_id", ["ts", "event_id"])


@C.add("lc_7", f"SELECT mem_id FROM memories WHERE deleted_at IS NULL AND {_TRUST} < 0.15")
def lc_7(spark: SparkSession, d: str) -> DataFrame:
    return live(_m(spark, d)).filter("trust < 0.15").select("mem_id")


@C.add("lc_8", f"SELECT mem_id, round(greatest(0.01, {_IMP} * 0.95), 6) AS importance, round(greatest(0, {_TRUST} * 0.95), 6) AS trust FROM memories")
def lc_8(spark: SparkSession, d: str) -> DataFrame:
    return L.decayed(_m(spark, d), 0.05).select("mem_id", F.round("importance", 6).alias("importance"), F.round("trust", 6).alias("trust"))


@C.add("lc_9", f"SELECT mem_id, CASE WHEN deleted_at IS NOT NULL AND deleted_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'purged' WHEN deleted_at IS NULL AND {_IMP} < 0.1 AND access_count < 2 THEN 'tombstone' ELSE 'kept' END AS fate FROM memories")
def lc_9(spark: SparkSession, d: str) -> DataFrame:
    old = F.col("deleted_at") < F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 30 DAYS")
    weak = F.col("deleted_at").isNull() & (F.col("importance") < 0.1) & (F.col("access_count") < 2)
    return _m(spark, d).select("mem_id", F.when(old, "purged").when(weak, "tombstone").otherwise("kept").alias("fate"))


@C.add("lc_10", "SELECT lesson_id, round(list_reduce(list_transform(range(0, reinforcements), lambda x: 0.0::double), lambda c, x: round((c + 0.1 * (1 - c)) * 1000) / 1000, confidence), 3) AS confidence FROM lessons")
def lc_10(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lessons").select("lesson_id", F.round(L.reinforced(F.col("confidence"), F.col("reinforcements")), 3).alias("confidence"))


_WEEKS = f"(epoch(TIMESTAMP '{AS_OF}') - floor(epoch(coalesce(last_decayed_at, last_reinforced_at, created_at)::timestamp))) / 604800.0"


@C.add("lc_11", f"SELECT lesson_id, CASE WHEN {_WEEKS} >= 1 AND decay_rate IS NOT NULL AND NOT isnan(decay_rate) THEN round(greatest(0.05, confidence - decay_rate * {_WEEKS}) * 1000) / 1000 ELSE confidence END AS new_confidence FROM lessons WHERE deleted_at IS NULL")
def lc_11(spark: SparkSession, d: str) -> DataFrame:
    return L.decay_sweep(read(spark, d, "lessons"), AS_OF).select("lesson_id", "new_confidence")


@C.add(
    "lc_12",
    f"""WITH {_SLOTS}, v AS (SELECT label, content, strlen('## ' || label || chr(10) || {sql_trim('content')} || chr(10) || chr(10)) AS size
  FROM slots WHERE label <> 'todo' AND {sql_trim('content')} <> '' QUALIFY row_number() OVER (PARTITION BY label ORDER BY project DESC) = 1),
o AS (SELECT list_reduce(list(struct_pack(used := size, taken := [label], label := label) ORDER BY label),
  lambda a, x: CASE WHEN a.used + x.used <= 1486 THEN struct_pack(used := a.used + x.used, taken := list_append(a.taken, x.label), label := '') ELSE a END,
  struct_pack(used := 0::bigint, taken := []::varchar[], label := '')) AS r FROM v)
SELECT label, content FROM v WHERE list_contains((SELECT r.taken FROM o), label)""",
)
def lc_12(spark: SparkSession, d: str) -> DataFrame:
    return L.pinned_context(slots(spark, d).withColumn("pinned", F.col("label") != "todo"), "prj_hub")


@C.add("lc_13", "SELECT event_id AS entry_id, event_type AS action FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 16 DAY AND event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def lc_13(spark: SparkSession, d: str) -> DataFrame:
    """The last errors of the ledger after pruning what is older than its retention."""
    ledger = read(spark, d, "events").select(F.col("event_id").alias("entry_id"), "ts", F.col("event_type").alias("action"))
    return L.audit_entries(L.audit_pruned(ledger, "2024-01-31 00:00:00", 16), action="error").select("entry_id", "action")


@C.add("lc_13_kept", "SELECT event_type AS action, count(*) AS n, min(event_id) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 16 DAY GROUP BY 1")
def lc_13_kept(spark: SparkSession, d: str) -> DataFrame:
    ledger = read(spark, d, "events").select(F.col("event_id").alias("entry_id"), "ts", F.col("event_type").alias("action"))
    return L.audit_pruned(ledger, "2024-01-31 00:00:00", 16).groupBy("action").agg(F.count("*").alias("n"), F.min("entry_id").alias("first"))


_ENVS = "list_filter([CASE WHEN list_has_any(w, ['prod', 'production']) THEN 'prod' END, CASE WHEN list_has_any(w, ['dev', 'development']) THEN 'dev' END, " + ", ".join(f"CASE WHEN list_contains(w, '{e}') THEN '{e}' END" for e in ("staging", "local", "vps", "windows", "linux", "macos")) + "], lambda x: x IS NOT NULL)"
_SPLIT = lambda c: rf"string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+')"
_CLASSES = f"""cp AS (SELECT CASE WHEN x.updated_at <= y.updated_at OR x.updated_at IS NULL THEN c.a ELSE c.b END AS older, CASE WHEN x.updated_at <= y.updated_at OR x.updated_at IS NULL THEN c.b ELSE c.a END AS newer,
  CASE WHEN x.updated_at <= y.updated_at OR x.updated_at IS NULL THEN x.content ELSE y.content END AS o, CASE WHEN x.updated_at <= y.updated_at OR x.updated_at IS NULL THEN y.content ELSE x.content END AS n
  FROM conflicts c JOIN facts x ON x.id = c.a JOIN facts y ON y.id = c.b),
ce AS (SELECT older, newer, o, n, (SELECT {_ENVS} FROM (SELECT {_SPLIT('o')} AS w)) AS eo, (SELECT {_ENVS} FROM (SELECT {_SPLIT('n')} AS w)) AS en FROM cp WHERE {sql_trim('o')} <> {sql_trim('n')}),
classes AS (SELECT older, newer, CASE WHEN len(eo) > 0 AND len(en) > 0 AND NOT list_has_any(eo, en) THEN 'COEXISTS' WHEN {' OR '.join(f"contains(lower(n), '{w}')" for w in L.CORRECTION_MARKERS)} THEN 'CONTRADICTS' ELSE 'SUPERSEDES' END AS relation FROM ce)"""


def resolutions(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    return L.classify_conflicts(L.conflict_pairs(f, close_memories(spark, d)), f)


@C.add("lc_14", f"WITH {_PAIRS}, {_FACTS}, {_CLASSES} SELECT * FROM classes")
def lc_14(spark: SparkSession, d: str) -> DataFrame:
    return resolutions(spark, d)


@C.add("lc_15", f"WITH {_PAIRS}, {_FACTS}, {_CLASSES} SELECT mem_id AS id, CASE WHEN mem_id IN (SELECT older FROM classes WHERE relation <> 'COEXISTS') THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status FROM memories WHERE deleted_at IS NULL")
def lc_15(spark: SparkSession, d: str) -> DataFrame:
    m = live(read(spark, d, "memories")).select(F.col("mem_id").alias("id"))
    return L.apply_resolutions(m, resolutions(spark, d), graph_edges(spark, d))[0].select("id", "status")


@C.add("lc_16", f"SELECT mem_id AS id, {_TRUST} AS trust FROM memories WHERE deleted_at IS NULL")
def lc_16(spark: SparkSession, d: str) -> DataFrame:
    """A version that loses a third of recall is rolled back."""
    now = live(_m(spark, d)).select(F.col("mem_id").alias("id"), "trust")
    metrics = lambda r: spark.createDataFrame([(r, 0.5)], "recall double, mrr double")
    return E.guarded(now.filter("trust > 0.5"), now, metrics(0.6), metrics(0.4))


@C.add("lc_17", "WITH r AS (SELECT DISTINCT lesson_id, unnest(source_ids) AS k FROM lessons) SELECT lesson_id, k AS source_ref, k IN (SELECT mem_key FROM memories) AS found FROM r WHERE k IS NOT NULL")
def lc_17(spark: SparkSession, d: str) -> DataFrame:
    """What lessons cite and whether it exists."""
    refs = read(spark, d, "lessons").select("lesson_id", F.explode("source_ids").alias("source_ref")).filter("source_ref IS NOT NULL").distinct()
    known = read(spark, d, "memories").select(F.col("mem_key").alias("source_ref")).distinct().withColumn("found", F.lit(True))
    return refs.join(known, "source_ref", "left").select("lesson_id", "source_ref", F.coalesce("found", F.lit(False)).alias("found"))


@C.add("lc_18", f"{G_} SELECT id, round(trust * CASE WHEN node_type = 'todo' THEN 0.3 ELSE 1 END, 6) AS trust FROM nodes")
def lc_18(spark: SparkSession, d: str) -> DataFrame:
    return graph_nodes(spark, d).select("id", F.round(F.col("trust") * F.when(F.col("node_type") == "todo", 0.3).otherwise(1.0), 6).alias("trust"))


@C.add(
    "lc_19",
    f"""{G_}, ch AS (SELECT id FROM nodes WHERE updated_at >= TIMESTAMP '2026-10-01'), callers AS (SELECT DISTINCT src AS id FROM edges WHERE dst IN (FROM ch) AND label IN ('causes', 'supersedes', 'manual')),
f AS (SELECT DISTINCT file_path FROM nodes WHERE id IN (FROM callers)), s AS (SELECT label FROM nodes WHERE file_path IN (FROM f))
SELECT lesson_id FROM lessons WHERE list_has_any(source_ids, (SELECT list(label) FROM s))""",
)
def lc_19(spark: SparkSession, d: str) -> DataFrame:
    """Lessons that cite something in a file that calls what changed."""
    n = graph_nodes(spark, d)
    e = graph_edges(spark, d, n).filter(F.col("label").isin(*USAGE))
    changed = n.filter("updated_at >= TIMESTAMP '2026-10-01 00:00:00'").select(F.col("id").alias("dst"))
    callers = e.join(changed, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    files = n.join(callers, "id", "left_semi").select("file_path").distinct()
    names = n.join(files, "file_path", "left_semi").select(F.col("label").alias("k"))
    cites = read(spark, d, "lessons").select("lesson_id", F.explode("source_ids").alias("k"))
    return cites.join(names, "k", "left_semi").select("lesson_id").distinct()


_SIDE = lambda r: f"(SELECT trim(mem_key) AS k, content, updated_at, seq, origin FROM memory_feed WHERE feed_id % 2 = {r} AND trim(mem_key) <> '' QUALIFY row_number() OVER (PARTITION BY trim(mem_key) ORDER BY updated_at DESC NULLS LAST, seq DESC, feed_id) = 1)"


def _side(spark: SparkSession, d: str, r: int) -> DataFrame:
    f = read(spark, d, "memory_feed").filter(F.col("feed_id") % 2 == r).withColumn("k", F.trim("mem_key")).filter("k <> ''")
    at = F.struct(F.coalesce(F.unix_micros("updated_at"), F.lit(-(2**62))), "seq", -F.col("feed_id"))
    return f.groupBy("k").agg(F.max_by(F.struct("content", "updated_at", "seq", "origin"), at).alias("s")).select("k", "s.*")


@C.add("lc_20", f"WITH b AS (SELECT *, 0 AS side FROM {_SIDE(0)} UNION ALL SELECT *, 1 FROM {_SIDE(1)}) SELECT k, content, CASE WHEN side = 1 THEN 'incoming' ELSE 'local' END AS won FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY updated_at DESC NULLS LAST, length(origin), side DESC) = 1")
def lc_20(spark: SparkSession, d: str) -> DataFrame:
    return P.lww_merge(_side(spark, d, 0), _side(spark, d, 1), "k", "updated_at", F.char_length("origin"), ["content"])


@C.add("lc_20_journal", f"SELECT a.k, CASE WHEN b.updated_at >= a.updated_at OR a.updated_at IS NULL THEN a.content ELSE b.content END AS lost FROM {_SIDE(0)} a JOIN {_SIDE(1)} b ON a.k = b.k WHERE a.content IS DISTINCT FROM b.content")
def lc_20_journal(spark: SparkSession, d: str) -> DataFrame:
    return P.merge_journal(_side(spark, d, 0), _side(spark, d, 1), "k", "updated_at", "content").select("k", "lost")


@C.add("lc_21", f"WITH a AS ({_STATS}), b AS ({_STATS} WHERE mem_id % 2 = 0) SELECT 'total' AS field, a.total = b.total AS same FROM a, b UNION ALL SELECT 'alive', a.alive = b.alive FROM a, b UNION ALL SELECT 'mean_trust', a.mean_trust = b.mean_trust FROM a, b")
def lc_21(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "memories")
    return P.compare_stats(memory_stats(m), memory_stats(m.filter("mem_id % 2 = 0")))


@C.add("snk_6", "SELECT 'memory' AS row_type, count(*) AS n FROM memories WHERE greatest(updated_at, deleted_at) >= TIMESTAMP '2026-09-01' UNION ALL SELECT 'lesson', count(*) FROM lessons WHERE greatest(updated_at, deleted_at) >= TIMESTAMP '2026-09-01'")
def snk_6(spark: SparkSession, d: str) -> DataFrame:
    parts = {"memory": read(spark, d, "memories").drop("embedding"), "lesson": read(spark, d, "lessons")}
    return P.export_bundle(parts, "2026-09-01 00:00:00").groupBy("row_type").agg(F.count("*").alias("n"))


@C.add("st_8", "SELECT bundle_id, count(*) AS n FROM (SELECT DISTINCT bundle_id, mem_key, seq, op, updated_at, deleted_at FROM memory_feed) WHERE bundle_id NOT IN (SELECT min(bundle_id) FROM memory_feed) GROUP BY 1")
def st_8(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "memory_feed").select("bundle_id", "mem_key", "seq", "op", "updated_at", "deleted_at")
    return P.once_per_bundle(f, "bundle_id", f.agg(F.min("bundle_id").alias("bundle_id"))).groupBy("bundle_id").agg(F.count("*").alias("n"))


@C.add("xo_14", f"WITH b AS (SELECT trim(mem_key) AS k, row_type, seq FROM memory_feed WHERE trim(mem_key) <> '' AND row_type = 'mem') SELECT k, count(DISTINCT seq) AS changes, max(seq) AS last_seq FROM b GROUP BY k")
def xo_14(spark: SparkSession, d: str) -> DataFrame:
    """A bundle's memory rows: different changes per key."""
    f = read(spark, d, "memory_feed").withColumn("k", F.trim("mem_key")).filter("k <> '' AND row_type = 'mem'")
    return P.once_per_bundle(f.select("k", "seq"), "k").groupBy("k").agg(F.count("*").alias("changes"), F.max("seq").alias("last_seq"))


# ---- extraction ----------------------------------------------------------------------------------

_ENT = r"""ents AS (SELECT doc_id AS doc, unnest(list_distinct(regexp_extract_all(text, '\b[A-Z][a-z]+[A-Z][A-Za-z]+\b'))) AS label, coalesce(title, '') AS description FROM documents WHERE text IS NOT NULL)"""


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Camel-case names in documents as entities."""
    docs = read(spark, d, "documents").filter("text IS NOT NULL")
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+[A-Z][A-Za-z]+)\b"), 1))
    return docs.select(F.col("doc_id").alias("doc"), F.explode(names).alias("label"), F.lit("Identifier").alias("type"), F.coalesce("title", F.lit("")).alias("description"))


_JUNK = """'который', 'которая', 'которое', 'которые', 'этот', 'эта', 'это', 'эти', 'также', 'где', 'что', 'как', 'или', 'для', 'при', 'все', 'весь', 'вся',
'однако', 'кроме', 'только', 'очень', 'когда', 'тогда', 'такой', 'такая', 'it', 'the', 'this', 'that', 'and', 'for'"""


@C.add("flt_8", f"WITH {_ENT} SELECT doc, label FROM ents WHERE length(label) >= 3 AND lower(label) NOT IN ({_JUNK})")
def flt_8(spark: SparkSession, d: str) -> DataFrame:
    return O.without_junk(entities(spark, d)).select("doc", "label")


_SPEAKS = "CASE " + " ".join(f"WHEN contains(lower(description), '{w}') THEN '{r}'" for w, r in O.RELATION_WORDS) + " END"


@C.add(
    "jn_17",
    f"""WITH e AS (SELECT project_id AS label, 'использует ' || content AS description FROM memories WHERE deleted_at IS NULL AND project_id IS NOT NULL),
o AS (SELECT DISTINCT label AS target FROM e WHERE label <> '')
SELECT 0::bigint AS doc, e.label AS source, target, {_SPEAKS} AS label, min('inferred: ' || substr(description, 1, 200)) AS context FROM e JOIN o ON contains(lower(description), lower(target)) AND e.label <> target WHERE {_SPEAKS} IS NOT NULL GROUP BY ALL""",
)
def jn_17(spark: SparkSession, d: str) -> DataFrame:
    """Relations that descriptions speak of."""
    m = live(read(spark, d, "memories"))
    e = m.select(F.lit(0).cast("long").alias("doc"), F.col("project_id").alias("label"), "content").filter("label IS NOT NULL")
    return O.infer_relations(e.select("doc", "label", F.concat(F.lit("использует "), "content").alias("description")))


@C.add(
    "ex_1",
    f"""WITH {_ENT}, kept AS (SELECT * FROM ents WHERE length(label) >= 3 AND lower(label) NOT IN ({_JUNK})),
texts AS (SELECT label, left(string_agg(description, ' ' ORDER BY encode(description)), 1000) AS description FROM (SELECT DISTINCT label, description FROM kept WHERE description <> '') GROUP BY label)
SELECT label, count(*) AS seen, any_value(texts.description) AS description FROM kept LEFT JOIN texts USING (label) GROUP BY label""",
)
def ex_1(spark: SparkSession, d: str) -> DataFrame:
    return O.merged_entities(O.without_junk(entities(spark, d))).select("label", "seen", "description")


@C.add("ex_2", r"WITH c AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\b[A-Z][a-z]+[A-Z][A-Za-z]+\b')))::bigint AS names FROM c")
def ex_2(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into chunks, names taken from each and put together again."""
    docs = read(spark, d, "documents").filter("text IS NOT NULL")
    chunks = docs.select("doc_id", F.explode_outer(X.split_into_chunks("text", 3000, 300)).alias("chunk"))
    names = F.regexp_extract_all("chunk", F.lit(r"\b([A-Z][a-z]+[A-Z][A-Za-z]+)\b"), 1)
    each = chunks.select("doc_id", F.explode_outer(names).alias("name"))
    return each.groupBy("doc_id").agg(F.count_distinct("name").alias("names"))


@C.add("ex_3", r"SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(text, '[A-Z]{3}-[0-9]+'))) AS label FROM documents WHERE text IS NOT NULL")
def ex_3(spark: SparkSession, d: str) -> DataFrame:
    """A pluggable extractor, here one that finds ticket numbers."""
    import re

    from memloom.functions.register import extract_chunks

    tickets = lambda texts: [[(x, "Ticket", "") for x in dict.fromkeys(re.findall("[A-Z]{3}-[0-9]+", t))] for t in texts]
    docs = read(spark, d, "documents").filter("text IS NOT NULL")
    return extract_chunks(docs, "doc_id", "text", tickets).select("id", "label")


_VERSION_OF = lambda r: f"""(SELECT {sql_trim('mem_key')} AS mem_key, arg_max(struct_pack(c := content, p := project_id, d := deleted_at), feed_id) AS v FROM memory_feed WHERE feed_id % 2 = {r} AND {sql_trim('mem_key')} <> '' GROUP BY 1)"""


@C.add(
    "snk_1",
    f"""SELECT mem_key, CASE WHEN b.v IS NOT NULL THEN b.v.c ELSE a.v.c END AS content, coalesce(b.v.p, a.v.p) AS project_id, CASE WHEN b.v IS NULL THEN a.v.d END IS NOT NULL AS dead
FROM {_VERSION_OF(0)} a FULL JOIN {_VERSION_OF(1)} b USING (mem_key)""",
)
def snk_1(spark: SparkSession, d: str) -> DataFrame:
    """The last versions of keys in one half of the feed saved over those in the other."""
    f = read(spark, d, "memory_feed").withColumn("mem_key", trimmed("mem_key")).filter("mem_key <> ''")
    last = lambda r: f.filter(F.col("feed_id") % 2 == r).groupBy("mem_key").agg(F.max_by(F.struct("content", "project_id", "deleted_at"), "feed_id").alias("v")).select("mem_key", "v.*")
    out = L.upsert_records(last(0), last(1), "mem_key", values=["content"])
    return out.select("mem_key", "content", "project_id", F.col("deleted_at").isNotNull().alias("dead"))


@C.add("snk_2", f"{G_} SELECT src, dst, label, (2 * seen)::double AS weight FROM (SELECT from_id AS src, to_id AS dst, lower({sql_trim('kind')}) AS label, count(*) AS seen FROM memory_links GROUP BY ALL)")
def snk_2(spark: SparkSession, d: str) -> DataFrame:
    """Edges added twice: weights count up."""
    raw = read(spark, d, "memory_links").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lower(trimmed("kind")).alias("label"), F.array(F.lit("seen")).alias("contexts"))
    empty = raw.limit(0).withColumn("weight", F.lit(0.0))
    once = O.upsert_edges(empty, raw)
    return O.upsert_edges(once, raw).select("src", "dst", "label", "weight")


# ---- evaluation ----------------------------------------------------------------------------------


@C.add(
    "ev_1",
    f"""WITH {_bm25_sql('(SELECT * FROM memories WHERE deleted_at IS NULL)', 'mem_id', 'content', ['ledger'], 20)}, g AS (SELECT mem_id AS id FROM memories WHERE deleted_at IS NULL AND contains(lower(content), 'ledger') AND category = 'rule'),
h AS (SELECT g.id, rank FROM g LEFT JOIN fts USING (id)) SELECT 1::bigint AS queries, round(coalesce(1.0 / min(rank), 0), 6) AS mrr, round(sum(coalesce(rank <= 5, false)::int) / count(*), 6) AS recall_5, round(sum(coalesce(rank <= 10, false)::int) / count(*), 6) AS recall_10 FROM h""",
)
def ev_1(spark: SparkSession, d: str) -> DataFrame:
    m = live(read(spark, d, "memories"))
    ranked = R.bm25_search(m, "mem_id", "content", "ledger", 20).withColumn("query", F.lit("ledger"))
    golden = m.filter(F.contains(F.lower("content"), F.lit("ledger")) & (F.col("category") == "rule")).select(F.lit("ledger").alias("query"), F.col("mem_id").alias("id"))
    return E.retrieval_metrics(ranked, golden, m.select(F.col("mem_id").alias("id"))).select("queries", "mrr", "recall_5", "recall_10")


@C.add("ev_2", f"WITH {_VEC}, {_NEAR(10)} SELECT 1.0::double AS recall WHERE (SELECT count(*) FROM vs) > 0")
def ev_2(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d), _query_vector(spark, d)
    exact = R.exact_search(v, "mem_id", "embedding", q, 10)
    return approximate_recall(exact, R.int8_search(v, "mem_id", "embedding", q, 10, oversample=2))


_FELL = lambda a, b, most: f"CASE WHEN {a} > 0 THEN ({a} - {b}) / {a} > {most} ELSE false END"


@C.add("ev_3", f"WITH m AS (SELECT mem_id, {_TRUST} AS t, {_IMP} AS i, access_count AS n FROM memories) SELECT mem_id, ({_FELL('t', '(t - n / 400.0)', 0.1)}) OR ({_FELL('i', '(i - n / 300.0)', 0.15)}) AS degraded FROM m")
def ev_3(spark: SparkSession, d: str) -> DataFrame:
    """The gate over many pairs of runs, here trust and importance as recall and MRR before, and less by use as now."""
    n = F.col("access_count")
    bad = E.is_degraded(F.col("trust"), F.col("importance"), F.col("trust") - n / 400.0, F.col("importance") - n / 300.0)
    return _m(spark, d).select("mem_id", bad.alias("degraded"))


@C.add(
    "ev_3_gate",
    """WITH r AS (SELECT count(*) AS runs, count(*) FILTER (user_id % 2 = 0) AS on_, quantile_cont(value, 0.5) FILTER (user_id % 2 <> 0) AS o, quantile_cont(value, 0.5) FILTER (user_id % 2 = 0) AS n FROM events),
g AS (SELECT *, CASE WHEN o > 0 THEN (o - n) / o END AS gain FROM r)
SELECT runs, round(o, 6) AS p95_off, round(n, 6) AS p95_on, round(gain, 6) AS gain, CASE WHEN runs < 30 OR on_ < 10 OR runs - on_ < 10 THEN 'insufficient' WHEN gain >= 0.3 THEN 'positive' ELSE 'negative' END AS verdict FROM g""",
)
def ev_3_gate(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return E.history_verdict(e.select((F.col("user_id") % 2 == 0).alias("index_on"), F.col("value").alias("p95")))


@C.add("ev_4", "WITH e AS (SELECT a.embedding::double[] AS a, b.embedding::double[] AS p, c.embedding::double[] AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2) SELECT round(avg((list_dot_product(a, p) / sqrt(list_dot_product(p, p)) > list_dot_product(a, n) / sqrt(list_dot_product(n, n)))::int), 6) AS accuracy FROM e")
def ev_4(spark: SparkSession, d: str) -> DataFrame:
    from memloom.functions.vectors import cosine

    e = read(spark, d, "embeddings")
    at = lambda i, n: e.select((F.col("vec_id") - i).alias("vec_id"), F.col("embedding").alias(n))
    return E.triplet_accuracy(at(0, "a").join(at(1, "p"), "vec_id").join(at(2, "n"), "vec_id"), cosine("a", "p"), cosine("a", "n"))


@C.add("ev_5", "SELECT * FROM (VALUES ('symbols', 26::bigint, 0::bigint, 0::bigint, 1.0::double, true), ('calls', 25, 0, 0, 1.0, true)) t(what, tp, fp, fn, f1, passes)")
def ev_5(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and calls found in the golden sources against those listed by hand, with the gates 0.95 and 0.90."""
    from memloom.operators.outline import parse_edges, parse_sources
    from memloom.plans import golden_code as GC

    files = spark.createDataFrame(list(GC.SOURCES.items()), "path string, text string")
    kinds = "path string, kind string, name string, line long, line_end long, owner string"
    blank = lambda df, *keys: df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys])
    gate = lambda found, golden, keys, what, least: E.set_f1(blank(found, *keys), blank(golden, *keys), keys).select(F.lit(what).alias("what"), "tp", "fp", "fn", "f1", (F.col("f1") >= least).alias("passes"))
    symbols = parse_sources(files, "path", "path", "text").filter("kind <> 'Import'")
    calls = parse_edges(files, "path", "path", "text").filter("label = 'CALLS'")
    a = gate(symbols, spark.createDataFrame(GC.SYMBOLS, kinds), ["path", "kind", "name", "line", "line_end", "owner"], "symbols", 0.95)
    return a.unionByName(gate(calls, spark.createDataFrame(GC.CALLS, "path string, src string, dst string, owner string"), ["path", "src", "dst", "owner"], "calls", 0.90))


@C.add("ev_5_links", "WITH f AS (SELECT DISTINCT from_id, to_id FROM memory_links WHERE deleted_at IS NULL), g AS (SELECT DISTINCT from_id, to_id FROM memory_links WHERE weight >= 0.3), s AS (SELECT (SELECT count(*) FROM (FROM f INTERSECT FROM g)) AS tp, (SELECT count(*) FROM (FROM f EXCEPT FROM g)) AS fp, (SELECT count(*) FROM (FROM g EXCEPT FROM f)) AS fn) SELECT tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s")
def ev_5_links(spark: SparkSession, d: str) -> DataFrame:
    links = read(spark, d, "memory_links")
    return E.set_f1(live(links), links.filter("weight >= 0.3"), ["from_id", "to_id"])


@C.add(
    "ev_6",
    lambda: f"""{G_}, seeds AS (SELECT DISTINCT src AS id FROM edges ORDER BY 1 LIMIT 3), {rank_sql(20, 'SELECT src, dst, weight AS w FROM edges')},
u AS (SELECT src, dst, greatest(1e-9, CASE WHEN weight > 0 AND NOT isnan(weight) THEN weight ELSE 0.5 END / greatest(1.0, ln(1.0 + count(*) OVER (PARTITION BY dst)))
  * least(3.0, 1.0 + ln(1 + access_count) * CASE WHEN access_count < 4 THEN 0.25 ELSE 0.5 END) * (0.1 + 0.9 * trust)) AS w FROM edges JOIN nodes ON nodes.id = dst),
{rank_sql(20, 'SELECT * FROM u', x='u')} SELECT id, round(r20.rank, 6) AS plain, round(r20u.rank, 6) AS weighted FROM r20 FULL JOIN r20u USING (id)""",
)
def ev_6(spark: SparkSession, d: str) -> DataFrame:
    """Ranks with plain against use-weighted edges."""
    n = graph_nodes(spark, d)
    e = graph_edges(spark, d, n)
    seeds = e.select(F.col("src").alias("id")).distinct().orderBy("id").limit(3).withColumn("weight", F.lit(1.0))
    indeg = e.groupBy("dst").agg(F.count("*").alias("indeg"))
    target = n.select(F.col("id").alias("dst"), "access_count", "trust")
    used = e.join(indeg, "dst").join(target, "dst")
    w = S.usage_edge_weight(F.col("weight"), F.col("indeg"), F.col("access_count"), F.lit(True), F.lit(0.0), F.col("trust"))
    plain = G.pagerank(e.select("src", "dst", F.col("weight").alias("w")), seeds).withColumnRenamed("rank", "plain")
    weighted = G.pagerank(used.select("src", "dst", w.alias("w")), seeds).withColumnRenamed("rank", "weighted")
    return plain.join(weighted, "id", "full").select("id", F.round("plain", 6).alias("plain"), F.round("weighted", 6).alias("weighted"))


# ---- sessions ------------------------------------------------------------------------------------


@C.add(
    "st_1",
    f"""WITH {_MSGS}, g AS (SELECT *, sum((role = 'assistant')::int) OVER (PARTITION BY session ORDER BY turn) - (role = 'assistant')::int AS pair FROM msgs)
SELECT session, max(turn) FILTER (role = 'assistant') AS turn, coalesce(string_agg(content, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS user_text, max(content) FILTER (role = 'assistant') AS assistant_text
FROM g GROUP BY session, pair HAVING max(turn) FILTER (role = 'assistant') IS NOT NULL""",
)
def st_1(spark: SparkSession, d: str) -> DataFrame:
    return T.conversation_pairs(T.log_messages(read(spark, d, "daily_log")))


@C.add(
    "st_2",
    f"""WITH {_MSGS}, n AS (SELECT session, content, row_number() OVER w AS n, lag(role) OVER w AS prev FROM msgs WINDOW w AS (PARTITION BY session ORDER BY turn)),
b AS (SELECT session, floor((n - 1 - (coalesce(prev = 'user' AND n % 60 = 1, false))::int) / 60.0)::bigint AS batch, sum(greatest(1, length(content) // 3))::bigint AS tokens FROM n GROUP BY ALL)
SELECT session, batch, tokens, sum(tokens) OVER (PARTITION BY session ORDER BY batch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > 2000 AND batch < 5 AS summarised FROM b""",
)
def st_2(spark: SparkSession, d: str) -> DataFrame:
    return T.consolidation_rounds(T.log_messages(read(spark, d, "daily_log")), 2_000)


@C.add("st_3", "SELECT round(epoch(TIMESTAMP '2026-12-01' - TIMESTAMP '2026-11-01') / 3600.0, 3)::double AS hours, count(*) FILTER (ingested_at > TIMESTAMP '2026-11-01') AS fresh, fresh >= 10 AS run, CASE WHEN fresh < 10 THEN 'too few entries' ELSE 'due' END AS reason FROM daily_log")
def st_3(spark: SparkSession, d: str) -> DataFrame:
    """Whether enough time went by and enough entries came since the last run."""
    return T.trigger_policy(read(spark, d, "daily_log"), F.col("ingested_at"), "2026-11-01 00:00:00", "2026-12-01 00:00:00")


@C.add(
    "src_8",
    """WITH k(lang, endings) AS (VALUES ('rust', ['rs']), ('python', ['py', 'pyi']), ('ts-js', ['ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs']), ('go', ['go']), ('sql', ['sql']), ('markdown', ['md', 'markdown']))
SELECT path, lang, CASE WHEN lang IS NOT NULL THEN 2097152 END::bigint AS cap_bytes FROM (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL) LEFT JOIN k ON list_contains(endings, regexp_extract(path, '[.]([a-z]+)$', 1))""",
)
def src_8(spark: SparkSession, d: str) -> DataFrame:
    """Every path with the format that the registry has for it, and its cap."""
    from memloom.operators.parsers import format_column, registry

    paths = read(spark, d, "documents").filter("path IS NOT NULL").select("path").distinct().withColumn("lang", format_column("path"))
    caps = F.broadcast(registry(spark).select(F.col("format").alias("lang"), "cap_bytes"))  # a row per format
    return paths.join(caps, "lang", "left").select("path", "lang", "cap_bytes")


@C.add("snk_5", "SELECT entry_id FROM daily_log QUALIFY row_number() OVER (ORDER BY entry_id DESC) <= 100")
def snk_5(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "daily_log").orderBy(F.desc("entry_id")).limit(100).select("entry_id")


@C.add(
    "xo_2",
    lambda: f"""WITH {hits_rank_sql()}, t AS (SELECT id, rank FROM r20 ORDER BY rank DESC, id LIMIT 20),
old AS (SELECT DISTINCT dst AS id FROM edges WHERE label = 'supersedes' AND src <> dst AND src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t))
SELECT id, round(rank, 6) AS score, {_TRUST} AS trust FROM t JOIN memories ON mem_id = id WHERE (SELECT count(*) FROM old) = (SELECT count(*) FROM t) OR id NOT IN (SELECT id FROM old)""",
)
def xo_2(spark: SparkSession, d: str) -> DataFrame:
    """Hits, ranked over links, superseded ones out, with the confidence of what is left."""
    hits = _hybrid(spark, d, 10, 20).select("id", F.col("score").alias("weight"))
    e = graph_edges(spark, d)
    ranks = G.pagerank(e.select("src", "dst", (S.kind_weight("label") * F.col("weight")).alias("w")), hits)
    top = R.ranked(ranks.select("id", F.col("rank").alias("score")), 20).select("id", "score")
    kept = J.without_superseded(top.select("id"), e).join(top, "id")
    trust = _m(spark, d).select(F.col("mem_id").alias("id"), "trust").join(F.broadcast(kept), "id")  # 20 rows
    return trust.select("id", F.round("score", 6).alias("score"), "trust")


