"""Queries of filters, joins, aggregates, windows, orders and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text as X
from memloom.functions.keys import has_value, trimmed, unit_interval
from memloom.operators import browse as B
from memloom.operators import codegraph as K
from memloom.operators import evaluation as E
from memloom.operators import graph as G
from memloom.operators import joins as J
from memloom.operators import lifecycle as L
from memloom.operators import replica as P
from memloom.operators import sessions as T
from memloom.operators.similarity import best_neighbour, similar_pairs
from memloom.operators.vectors import usable
from memloom.plans.base import SQL_GRAPH, SQL_USABLE, WS, Catalog, graph_edges, graph_nodes, read, sql_cos, sql_trim, sql_unit, sql_value, vectors
from memloom.plans.function_queries import document_chunks, _CHUNKS
from memloom.sources.tables import cleaned, live

C = Catalog()
QUERIES, ORACLES = C.QUERIES, C.ORACLES
G_ = f"WITH {SQL_GRAPH}"
USAGE = ["causes", "supersedes", "manual"]
_USAGE = "('causes', 'supersedes', 'manual')"


def _memories(spark, d):
    return read(spark, d, "memories")



# ---- filters -------------------------------------------------------------------------------------


@C.add("flt_1", "SELECT mem_id, mem_key FROM memories WHERE deleted_at IS NULL")
def flt_1(spark: SparkSession, d: str) -> DataFrame:
    return live(_memories(spark, d)).select("mem_id", "mem_key")


@C.add(
    "flt_2",
    """SELECT mem_key, category, importance FROM memories WHERE deleted_at IS NULL AND category = 'decision' AND trust >= 0.3 AND (contains(lower(coalesce(content, '')), 'the ') OR contains(lower(mem_key), 'the '))
ORDER BY importance DESC NULLS LAST, updated_at DESC NULLS LAST, mem_key LIMIT 50""",
)
def flt_2(spark: SparkSession, d: str) -> DataFrame:
    m = live(_memories(spark, d)).withColumn("importance", F.nanvl("importance", F.lit(float("inf"))))
    return B.browse(m, query="the ", least_trust=0.3, category="decision").select("mem_key", "category", "importance")


@C.add("flt_3", "SELECT mem_id FROM memories WHERE CASE WHEN coalesce(json_valid(meta), false) THEN coalesce(json_extract_string(meta, '$.author') = 'vargo', true) ELSE true END")
def flt_3(spark: SparkSession, d: str) -> DataFrame:
    return _memories(spark, d).filter(B.author_allows("meta", "vargo")).select("mem_id")


@C.add("flt_4", "SELECT lesson_id FROM lessons WHERE source = 'agent'")
def flt_4(spark: SparkSession, d: str) -> DataFrame:
    return B.where_given(read(spark, d, "lessons"), {"source": "agent", "project_id": None}).select("lesson_id")


@C.add(
    "flt_5",
    f"""{G_} SELECT id, label FROM (SELECT *, CASE WHEN label = 'hub' THEN 0 WHEN file_path = 'hub' THEN 1 WHEN contains(lower(label), 'hub') THEN 2 END AS how FROM nodes) WHERE how IS NOT NULL ORDER BY how, length(label), id LIMIT 1""",
)
def flt_5(spark: SparkSession, d: str) -> DataFrame:
    return K.resolve_symbol(graph_nodes(spark, d), "hub").select("id", "label")


@C.add("flt_6", f"{_CHUNKS} SELECT doc_id, ordinal FROM chunks WHERE length(trim(chunk, {WS})) >= 80 AND (regexp_matches(chunk, '[.!?…]') OR length(trim(chunk, {WS})) >= 300)")
def flt_6(spark: SparkSession, d: str) -> DataFrame:
    return document_chunks(spark, d).filter(X.worth_extracting("chunk")).select("doc_id", "ordinal")


_ELBOW = """
f AS (SELECT id, score, max(score) OVER () AS best, lag(score) OVER (ORDER BY score DESC, id) AS prev FROM hits),
e AS (SELECT id, score, max((score < 0.15 * best OR coalesce(prev > 0 AND (prev - score) / prev > 0.5, false) OR best <= 0)::int) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS cut FROM f)"""


@C.add("flt_7", f"WITH hits AS (SELECT mem_id AS id, access_count::double AS score FROM memories WHERE deleted_at IS NULL), {_ELBOW} SELECT id, score FROM e WHERE cut = 0")
def flt_7(spark: SparkSession, d: str) -> DataFrame:
    hits = live(_memories(spark, d)).select(F.col("mem_id").alias("id"), F.col("access_count").cast("double").alias("score"))
    return G.elbow_cut(hits)


C.QUERIES["win_4"], C.ORACLES["win_4"] = C.QUERIES["flt_7"], C.ORACLES["flt_7"]


@C.add("flt_9", f"{G_} SELECT src, dst, label FROM edges WHERE weight >= 0.6")
def flt_9(spark: SparkSession, d: str) -> DataFrame:
    return graph_edges(spark, d).filter(F.coalesce("weight", F.lit(1.0)) >= 0.6).select("src", "dst", "label")


_ENTRY = """CASE WHEN title IN ('main', 'Main') OR title LIKE '%::main' THEN 'main'
 WHEN contains(p, 'alembic/') OR contains(p, 'migrations/') OR contains(p, '/migration') OR contains(p, 'conftest') THEN 'migration or environment'
 WHEN title IN ('upgrade', 'downgrade', 'setup', 'teardown', 'setup_module', 'teardown_module', 'setup_class', 'teardown_class', '__init__', '__main__') THEN 'lifecycle name'
 WHEN contains(p, 'tests/') OR contains(p, '/test') OR contains(p, '_test.') THEN 'test path' WHEN starts_with(p, 'test_') THEN 'test file'
 WHEN starts_with(title, 'test_') OR starts_with(title, 'should_') OR starts_with(title, 'Test') THEN 'test name'
 WHEN contains(t, 'pub fn') OR contains(t, 'pub async fn') OR contains(t, 'pub struct') OR contains(t, 'pub enum') OR contains(t, 'pub trait') OR contains(t, 'export ') THEN 'public API'
 WHEN contains(t, 'pydantic') OR contains(t, 'dataclass') THEN 'model'
 WHEN (contains(t, 'декоратор') OR contains(t, 'decorator')) AND NOT regexp_matches(t, '@(property|staticmethod|classmethod|abstractmethod|lru_cache|cache|overload|contextmanager|setter|getter|cached_property)') THEN 'decorator' END"""


@C.add("flt_10", f"SELECT doc_id, {_ENTRY} AS reason FROM (SELECT doc_id, coalesce(title, '') AS title, lower(coalesce(path, '')) AS p, lower(coalesce(text, '')) AS t FROM documents)")
def flt_10(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", K.entrypoint_reason("title", "path", "text").alias("reason"))


@C.add("flt_11", "SELECT DISTINCT lower(category) AS label, regexp_full_match(lower(category), '[a-z][a-z0-9_]{0,63}') AS valid FROM memories WHERE category IS NOT NULL")
def flt_11(spark: SparkSession, d: str) -> DataFrame:
    label = F.lower("category")
    return _memories(spark, d).filter("category IS NOT NULL").select(label.alias("label"), B.valid_slot_label(label).alias("valid")).distinct()


@C.add("flt_12", "SELECT DISTINCT source FROM memories WHERE source IS NOT NULL AND source <> ''")
def flt_12(spark: SparkSession, d: str) -> DataFrame:
    return B.distinct_values(_memories(spark, d), "source")


# ---- joins ---------------------------------------------------------------------------------------


@C.add("jn_1", f"{G_} SELECT s.label AS src_label, e.label, t.label AS dst_label FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes t ON t.id = e.dst")
def jn_1(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    return J.labelled_edges(graph_edges(spark, d, n), n).select("src_label", "label", "dst_label")


_RAW = f"raw AS (SELECT from_id AS src, to_id AS dst, lower({sql_trim('kind')}) AS label FROM memory_links)"


def _raw_links(spark, d):
    return read(spark, d, "memory_links").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lower(trimmed("kind")).alias("label"))


@C.add("jn_2", f"{G_}, {_RAW} SELECT DISTINCT src, dst, r.label, coalesce(node_type, 'ExternalModule') AS node_type FROM raw r LEFT JOIN nodes ON id = dst")
def jn_2(spark: SparkSession, d: str) -> DataFrame:
    return J.edges_with_target_type(_raw_links(spark, d), graph_nodes(spark, d)).select("src", "dst", "label", "node_type").distinct()


@C.add("jn_3", f"SELECT mem_id, person_id FROM memories m LEFT JOIN (SELECT project_id, min(person_id) AS person_id FROM roster GROUP BY 1) r ON r.project_id = m.project_id")
def jn_3(spark: SparkSession, d: str) -> DataFrame:
    """Memories with the first person of their project, if any."""
    r = read(spark, d, "roster").groupBy("project_id").agg(F.min("person_id").alias("person_id"))
    return _memories(spark, d).join(r, "project_id", "left").select("mem_id", "person_id")


@C.add("jn_4", f"{G_} SELECT id FROM nodes WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = id AND label IN ('summary', 'category'))")
def jn_4(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    return J.without_outgoing(n, graph_edges(spark, d, n), ["summary", "category"]).select("id")


@C.add("jn_5", f"{G_} SELECT src, dst, label FROM edges WHERE src IN (SELECT id FROM nodes WHERE node_type = 'rule') AND dst IN (SELECT id FROM nodes WHERE node_type = 'rule')")
def jn_5(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    return J.in_set(graph_edges(spark, d, n), n.filter("node_type = 'rule'"), "src", "dst").select("src", "dst", "label")


@C.add("jn_6", "SELECT mem_id, mem_key FROM memories WHERE mem_key IN (SELECT a_key FROM guess_pairs WHERE is_identity)")
def jn_6(spark: SparkSession, d: str) -> DataFrame:
    keys = read(spark, d, "guess_pairs").filter("is_identity").select(F.col("a_key").alias("mem_key"))
    return _memories(spark, d).join(keys, "mem_key", "left_semi").select("mem_id", "mem_key")


_SEEDS = "seeds AS (SELECT id FROM nodes WHERE id % 20 = 0)"


def _seeds(n: DataFrame) -> DataFrame:
    return n.filter("id % 20 = 0").select("id")


@C.add("jn_7", f"{G_}, {_SEEDS} SELECT DISTINCT id FROM (SELECT dst AS id FROM edges WHERE src IN (FROM seeds) UNION ALL SELECT src FROM edges WHERE dst IN (FROM seeds)) WHERE id NOT IN (FROM seeds)")
def jn_7(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    return J.neighbours_of(graph_edges(spark, d, n), _seeds(n))


C.QUERIES["set_1"], C.ORACLES["set_1"] = C.QUERIES["jn_7"], C.ORACLES["jn_7"]


@C.add("jn_8", f"{G_} SELECT src, dst, weight FROM edges WHERE label = 'contradicts' AND src <> dst AND src IN (SELECT id FROM nodes WHERE trust >= 0.5) AND dst IN (SELECT id FROM nodes WHERE trust >= 0.5)")
def jn_8(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    return J.conflicts_within(graph_edges(spark, d, n), n.filter("trust >= 0.5"))


@C.add("jn_9", f"{G_} SELECT DISTINCT dst AS id FROM edges WHERE label = 'supersedes' AND src <> dst AND src IN (SELECT id FROM nodes WHERE trust >= 0.5) AND dst IN (SELECT id FROM nodes WHERE trust >= 0.5)")
def jn_9(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    return J.superseded_within(graph_edges(spark, d, n), n.filter("trust >= 0.5"))


_PAIRS = f"""vec AS (SELECT mem_id AS id, embedding FROM memories WHERE deleted_at IS NULL AND {SQL_USABLE}),
pairs AS (SELECT a.id AS a, b.id AS b, {sql_cos('a.embedding', 'b.embedding')} AS cos FROM vec a JOIN vec b ON a.id < b.id WHERE cos >= 0.75)"""


def close_memories(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(vectors(spark, d).select("mem_id", "embedding"), "mem_id", "embedding", 0.75)


@C.add("jn_10", f"WITH {_PAIRS} SELECT a, b, round(cos, 5) AS cos FROM pairs")
def jn_10(spark: SparkSession, d: str) -> DataFrame:
    return close_memories(spark, d).select("a", "b", F.round("cos", 5).alias("cos"))


_FACTS = rf"""facts AS (
  SELECT mem_id AS id, CASE WHEN {sql_value('category')} THEN lower({sql_trim('category')}) ELSE 'general' END AS category, CASE WHEN {sql_value('project_id')} THEN {sql_trim('project_id')} END AS project,
         content, updated_at, list_distinct(list_transform(list_filter(string_split_regex(content, '[\s,;:()\x22'']+'), lambda t: strlen(t) >= 2 AND (regexp_matches(t, '\p{{Lu}}') OR regexp_matches(t, '[/_.]'))), lambda t: lower(t))) AS entities
  FROM memories WHERE deleted_at IS NULL
),
conflicts AS (
  SELECT p.a, p.b, p.cos FROM pairs p JOIN facts x ON x.id = p.a JOIN facts y ON y.id = p.b
  WHERE p.cos > 0.82 AND x.category = y.category AND (x.project IS NULL OR y.project IS NULL OR x.project = y.project)
    AND CASE WHEN len(x.entities) = 0 AND len(y.entities) = 0 THEN true
             WHEN len(x.entities) = 0 THEN len(list_filter(y.entities, lambda e: contains(lower(x.content), e))) > 0
             WHEN len(y.entities) = 0 THEN len(list_filter(x.entities, lambda e: contains(lower(y.content), e))) > 0
             ELSE list_has_any(x.entities, y.entities) END
)"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    m = live(_memories(spark, d))
    return m.select(
        F.col("mem_id").alias("id"), cleaned("category", "general", lower=True).alias("category"), F.when(has_value("project_id"), trimmed("project_id")).alias("project"),
        "content", "updated_at", X.named_entities("content").alias("entities"),
    )


@C.add("jn_11", f"WITH {_PAIRS}, {_FACTS} SELECT a, b, round(cos, 5) AS cos FROM conflicts")
def jn_11(spark: SparkSession, d: str) -> DataFrame:
    return L.conflict_pairs(facts(spark, d), close_memories(spark, d)).select("a", "b", F.round("cos", 5).alias("cos"))


_BEST = "best AS (SELECT id, arg_min(n, (-round(cos, 9), n)) AS neighbour, max(cos) AS cos FROM (SELECT a AS id, b AS n, cos FROM pairs UNION ALL SELECT b, a, cos FROM pairs) GROUP BY id)"


@C.add("jn_12", f"WITH {_PAIRS}, {_BEST} SELECT id, neighbour, round(cos, 5) AS cos FROM best")
def jn_12(spark: SparkSession, d: str) -> DataFrame:
    pairs = close_memories(spark, d).withColumn("cos", F.round("cos", 9))
    return best_neighbour(pairs).select("id", "neighbour", F.round("cos", 5).alias("cos"))


@C.add(
    "jn_13",
    """WITH s AS (SELECT log_file, line_no AS line_start, min(entry_id) AS starter FROM daily_log WHERE line_no % 3 = 1 GROUP BY ALL)
SELECT e.entry_id, s.line_start, s.starter FROM daily_log e JOIN s ON s.log_file = e.log_file AND s.line_start <= e.line_no QUALIFY row_number() OVER (PARTITION BY e.entry_id ORDER BY s.line_start DESC) = 1""",
)
def jn_13(spark: SparkSession, d: str) -> DataFrame:
    """As-of: each log line with the last block that starts at or before it in its file."""
    log = read(spark, d, "daily_log").select("log_file", "line_no", "entry_id")
    spans = log.filter("line_no % 3 = 1").groupBy("log_file", F.col("line_no").alias("line_start")).agg(F.min("entry_id").alias("starter"))
    return J.last_start_before(log, spans, ["log_file"], "line_no", "line_start").select("entry_id", "line_start", "starter")


@C.add(
    "jn_14",
    """WITH p AS (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL), s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z_]+/[a-z_0-9]+[.](?:py|ts|rs|go|sql)')) AS mention FROM documents)
SELECT path, mention FROM p JOIN s ON path = mention OR ends_with(path, '/' || mention)""",
)
def jn_14(spark: SparkSession, d: str) -> DataFrame:
    """Paths that end, in whole components, with a file that some text mentions."""
    docs = read(spark, d, "documents")
    mentions = docs.select(F.explode(F.regexp_extract_all("text", F.lit("([a-z_]+/[a-z_0-9]+[.](?:py|ts|rs|go|sql))"), 1)).alias("mention")).distinct()
    return J.suffix_matches(docs.filter("path IS NOT NULL"), mentions, "path", "mention")


@C.add("jn_15", "WITH r AS (SELECT path, min(doc_id)::varchar AS route FROM documents WHERE path IS NOT NULL GROUP BY path) SELECT DISTINCT CASE WHEN project_id IS NULL THEN '' ELSE project_id || '#' END || doc_id AS client, route FROM documents d JOIN r ON lower(d.path) = lower(r.path)")
def jn_15(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one project whose paths are the same API path."""
    docs = read(spark, d, "documents").filter("path IS NOT NULL")
    own = docs.select(F.concat_ws("#", "project_id", F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("/"), "path").alias("path"), F.lit("get").alias("method"))
    routes = docs.groupBy("path").agg(F.min("doc_id").cast("string").alias("id")).select("id", F.concat(F.lit("/"), F.upper("path"), F.lit("/")).alias("path"), F.lit("GET").alias("method"))
    return K.contract_bridges(own, routes)


@C.add(
    "jn_16",
    """WITH c AS (SELECT doc_id, unnest([path || '.bak', regexp_replace(path, '_test', ''), path]) AS p, unnest([1, 2, 3]) AS pos FROM documents WHERE path IS NOT NULL)
SELECT doc_id, arg_min(p, pos) AS path FROM c WHERE p IN (SELECT path FROM documents) GROUP BY doc_id""",
)
def jn_16(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("path IS NOT NULL")
    options = F.array(F.concat("path", F.lit(".bak")), F.regexp_replace("path", "_test", ""), F.col("path"))
    return J.first_existing(docs.select("doc_id", options.alias("options")), docs.select("path"), "doc_id", "options")


_SLOTS = "slots AS (SELECT lower(category) AS label, CASE WHEN project_id = 'prj_hub' THEN 'prj_hub' ELSE '' END AS project, max(content) AS content FROM memories WHERE deleted_at IS NULL AND category IS NOT NULL AND category <> '' GROUP BY ALL)"


def slots(spark: SparkSession, d: str) -> DataFrame:
    """Longest text per category as a scratchpad, of one project or global."""
    m = live(_memories(spark, d)).filter("category <> ''")
    project = F.when(F.col("project_id") == "prj_hub", F.lit("prj_hub")).otherwise("")
    return m.groupBy(F.lower("category").alias("label"), project.alias("project")).agg(F.max("content").alias("content"))


@C.add("jn_18", f"WITH {_SLOTS} SELECT label, project, content FROM slots QUALIFY row_number() OVER (PARTITION BY label ORDER BY project DESC) = 1")
def jn_18(spark: SparkSession, d: str) -> DataFrame:
    return J.shadowed(slots(spark, d), "label", "project", "prj_hub")


_VERSION = lambda side: f"SELECT trim(mem_key, {WS}) AS mem_key, arg_max(coalesce(content, ''), (coalesce(updated_at, '0001-01-01'::timestamp), seq)) AS content FROM memory_feed WHERE trim(mem_key, {WS}) <> '' AND {side} GROUP BY 1"


@C.add(
    "jn_19",
    f"""WITH b AS ({_VERSION('feed_id % 2 = 0')}), a AS ({_VERSION('feed_id % 2 = 1')})
SELECT mem_key, change FROM (SELECT coalesce(b.mem_key, a.mem_key) AS mem_key, CASE WHEN b.mem_key IS NULL THEN 'added' WHEN a.mem_key IS NULL THEN 'removed' WHEN a.content <> b.content THEN 'modified' END AS change FROM b FULL JOIN a ON a.mem_key = b.mem_key) WHERE change IS NOT NULL""",
)
def jn_19(spark: SparkSession, d: str) -> DataFrame:
    """Two halves of the feed as two snapshots."""
    f = read(spark, d, "memory_feed").withColumn("mem_key", trimmed("mem_key")).filter("mem_key <> ''")
    at = F.struct(F.coalesce("updated_at", F.lit("0001-01-01 00:00:00").cast("timestamp")), "seq")
    half = lambda r: f.filter(F.col("feed_id") % 2 == r).groupBy("mem_key").agg(F.max_by(F.coalesce("content", F.lit("")), at).alias("content"))
    return J.snapshot_diff(half(0), half(1), ["mem_key"], "content")


# ---- aggregates ----------------------------------------------------------------------------------


@C.add("agg_1", f"{G_} SELECT node_type, count(*) AS n FROM nodes GROUP BY 1")
def agg_1(spark: SparkSession, d: str) -> DataFrame:
    return B.top_counts(graph_nodes(spark, d), F.col("node_type"), "node_type", None)


@C.add("agg_2", f"{G_} SELECT t.dst AS id, n, nodes.label FROM (SELECT dst, count(*) AS n FROM edges GROUP BY 1 ORDER BY n DESC, dst LIMIT 10) t JOIN nodes ON id = dst")
def agg_2(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    top = F.broadcast(B.top_counts(graph_edges(spark, d, n), F.col("dst"), "id", 10))  # 10 rows
    return n.select("id", "label").join(top, "id").select("id", "n", "label")


@C.add("agg_3", f"{G_} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM lessons WHERE deleted_at IS NULL) AS lessons")
def agg_3(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    parts = {"nodes": n, "edges": graph_edges(spark, d, n), "documents": read(spark, d, "documents"), "lessons": live(read(spark, d, "lessons"))}
    counts = [df.agg(F.count("*").alias(k)) for k, df in parts.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(F.broadcast(c))  # one row each
    return out


_STATS = f"SELECT count(*) AS total, count(*) FILTER (deleted_at IS NULL) AS alive, round(avg({sql_unit('trust')}), 6) AS mean_trust FROM memories"


def memory_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.sum(F.col("deleted_at").isNull().cast("long")).alias("alive"), F.round(F.avg(unit_interval("trust")), 6).alias("mean_trust"))


@C.add("agg_4", _STATS)
def agg_4(spark: SparkSession, d: str) -> DataFrame:
    return memory_stats(_memories(spark, d))


@C.add("agg_5", "WITH h AS (SELECT sha256(mem_key || '|' || epoch_us(updated_at::timestamp)::varchar) AS h FROM memories) SELECT bit_xor(('0x' || substr(h, 1, 8))::bigint) AS high, bit_xor(('0x' || substr(h, 9, 8))::bigint) AS low FROM h")
def agg_5(spark: SparkSession, d: str) -> DataFrame:
    return P.checksum(_memories(spark, d), F.col("mem_key"), F.unix_micros("updated_at"))


_DEG = "deg AS (SELECT id, sum(i)::bigint AS in_degree, sum(o)::bigint AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY id)"


@C.add("agg_6", f"{G_}, {_DEG} SELECT * FROM deg")
def agg_6(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(graph_edges(spark, d))


_HUBS = f"""{_DEG}, ranked AS (SELECT n.id, degree, row_number() OVER (ORDER BY degree DESC, n.id) AS r, count(*) OVER () AS n FROM nodes n JOIN deg ON deg.id = n.id WHERE node_type NOT IN ('general', 'todo', 'environment')),
hubs AS (SELECT id, degree FROM ranked WHERE r <= least(n, greatest(3, least(20, n // 10))))"""
NO_HUBS = ("general", "todo", "environment")


@C.add("agg_7", f"{G_}, {_HUBS} SELECT id, degree FROM hubs")
def agg_7(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    return G.hubs(n, graph_edges(spark, d, n), NO_HUBS).select("id", "degree")


@C.add(
    "agg_8",
    f"""{G_}, p AS (SELECT DISTINCT a.file_path AS a, b.file_path AS b FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.file_path <> b.file_path),
f AS (SELECT coalesce(x.f, y.f) AS file_path, coalesce(ca, 0) AS afferent, coalesce(ce, 0) AS efferent FROM (SELECT b AS f, count(*) AS ca FROM p GROUP BY 1) x FULL JOIN (SELECT a AS f, count(*) AS ce FROM p GROUP BY 1) y ON x.f = y.f)
SELECT *, round(efferent / (afferent + efferent), 6) AS instability, CASE WHEN efferent / (afferent + efferent) < 0.3 THEN 'stable' WHEN efferent / (afferent + efferent) <= 0.7 THEN 'balanced' ELSE 'unstable' END AS grade FROM f""",
)
def agg_8(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    return G.coupling(n, graph_edges(spark, d, n))


@C.add("agg_9", "SELECT 'category' AS facet, coalesce(category, '—') AS v, count(*) AS n FROM memories GROUP BY 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, v) <= 8 UNION ALL SELECT 'project', coalesce(project_id, '—') AS v, count(*) AS n FROM memories GROUP BY 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, v) <= 8")
def agg_9(spark: SparkSession, d: str) -> DataFrame:
    m = _memories(spark, d)
    top = lambda c, name: B.top_counts(m, F.col(c), "v", 8, "—").select(F.lit(name).alias("facet"), "v", "n")
    return top("category", "category").unionByName(top("project_id", "project"))


@C.add("agg_10", f"{G_} SELECT project_id, count(*) AS n FROM nodes GROUP BY 1")
def agg_10(spark: SparkSession, d: str) -> DataFrame:
    return B.top_counts(graph_nodes(spark, d), F.col("project_id"), "project_id", None)


_COCHANGE = """sets AS (SELECT DISTINCT l_orderkey AS t, l_partkey AS i FROM lineitem), k AS (SELECT t FROM sets GROUP BY t HAVING count(*) BETWEEN 2 AND 10),
pairs AS (SELECT a.i AS a, b.i AS b, count(*) AS n FROM sets a JOIN sets b ON a.t = b.t AND a.i < b.i WHERE a.t IN (FROM k) GROUP BY 1, 2 HAVING count(*) >= 3)"""


@C.add("agg_11", f"WITH {_COCHANGE} SELECT a, b, n, round(least(1.0, 0.5 + 0.1 * (n - 3)), 6) AS confidence FROM pairs")
def agg_11(spark: SparkSession, d: str) -> DataFrame:
    return G.cochange_pairs(read(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@C.add(
    "agg_12",
    """WITH m AS (SELECT DISTINCT l_suppkey AS f, l_partkey AS m FROM lineitem), n AS (SELECT m, count(*) AS n FROM m GROUP BY m)
SELECT a.f AS a, b.f AS b, round(sum(1.0 / n.n), 6) AS w FROM m a JOIN m b ON a.m = b.m AND a.f < b.f JOIN n ON n.m = a.m GROUP BY 1, 2""",
)
def agg_12(spark: SparkSession, d: str) -> DataFrame:
    return G.coimport_weights(read(spark, d, "lineitem"), "l_suppkey", "l_partkey")


_MAPPING = "mapping AS (SELECT mem_key, coalesce(arg_min(canonical_key, pair_id), mem_key) AS canonical FROM (SELECT a_key AS mem_key, canonical_key, pair_id FROM guess_pairs WHERE is_identity UNION ALL SELECT b_key, canonical_key, pair_id FROM guess_pairs WHERE is_identity) WHERE canonical_key IS NOT NULL GROUP BY mem_key)"


def canonical_mapping(spark: SparkSession, d: str) -> DataFrame:
    """(mem_key, canonical): the canonical key that the first identity pair of a key names."""
    p = read(spark, d, "guess_pairs").filter("is_identity AND canonical_key IS NOT NULL")
    each = p.select(F.explode(F.array("a_key", "b_key")).alias("mem_key"), "canonical_key", "pair_id").filter("mem_key IS NOT NULL")
    return each.groupBy("mem_key").agg(F.min_by("canonical_key", "pair_id").alias("canonical"))


@C.add(
    "agg_14",
    f"WITH {_MAPPING} SELECT canonical, count(*) AS members, max(importance) AS importance, sum(access_count)::bigint AS access_count, min(created_at) AS first_created FROM (SELECT * REPLACE (CASE WHEN isnan(importance) THEN NULL ELSE importance END AS importance) FROM memories) JOIN mapping USING (mem_key) GROUP BY 1",
)
def agg_14(spark: SparkSession, d: str) -> DataFrame:
    m = _memories(spark, d).withColumn("importance", F.when(~F.isnan("importance"), F.col("importance")))
    return L.merge_records(m, canonical_mapping(spark, d), "mem_key")


@C.add("agg_15", "SELECT mem_id, access_count + coalesce(n, 0) AS access_count, last_hit FROM memories LEFT JOIN (SELECT user_id AS id, count(*) AS n, max(ts) AS last_hit FROM events WHERE event_type = 'view' GROUP BY 1) ON id = mem_id")
def agg_15(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "events").filter("event_type = 'view'").select(F.col("user_id").alias("id"), "ts")
    return B.telemetry_fold(_memories(spark, d).select("mem_id", "access_count"), hits, "mem_id", "access_count")


@C.add(
    "agg_16",
    """WITH w AS (SELECT lag(event_type) OVER o AS prev, event_type, row_number() OVER o AS r FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT sum((r > 1)::int)::bigint AS pairs, sum(coalesce(r > 1 AND prev = event_type, false)::int)::bigint AS repeats, round(sum((r > 1 AND prev = event_type)::int) / sum((r > 1)::int), 6) AS rate FROM w""",
)
def agg_16(spark: SparkSession, d: str) -> DataFrame:
    return T.repeat_failures(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


C.QUERIES["win_6"], C.ORACLES["win_6"] = C.QUERIES["agg_16"], C.ORACLES["agg_16"]


@C.add("agg_17", "SELECT event_id, CASE WHEN (props->>'$.k')::bigint % 3 > 0 THEN 'failed' WHEN (props->>'$.k')::bigint > 0 THEN 'verified' ELSE 'unconfirmed' END AS verdict FROM events")
def agg_17(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    summary = F.to_json(F.struct((k % 3).alias("failed"), k.alias("passed")))
    return read(spark, d, "events").select("event_id", T.auto_verdict(summary).alias("verdict"))


@C.add(
    "agg_18",
    f"""{G_}, e AS (SELECT src, dst, weight AS w FROM edges WHERE src <> dst), m AS (SELECT sum(w) AS m FROM e),
p AS (SELECT w, a.node_type AS ca, b.node_type AS cb FROM e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst),
dg AS (SELECT c, sum(w) AS d FROM (SELECT ca AS c, w FROM p UNION ALL SELECT cb, w FROM p) GROUP BY c), ins AS (SELECT ca AS c, sum(w) AS i FROM p WHERE ca = cb GROUP BY 1)
SELECT round(sum(coalesce(i, 0) / m - (d / (2 * m)) ** 2), 6) AS q FROM dg LEFT JOIN ins USING (c), m""",
)
def agg_18(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the node types as communities."""
    n = graph_nodes(spark, d)
    e = graph_edges(spark, d, n).withColumn("w", F.col("weight"))
    return G.modularity(e, n.select("id", F.col("node_type").alias("community"))).select(F.round("q", 6).alias("q"))


@C.add(
    "agg_19",
    """WITH l AS (SELECT log_file AS day, entry_id, unnest(string_split(coalesce(user_text, ''), chr(10)) || string_split(coalesce(assistant_text, ''), chr(10))) AS line FROM daily_log)
SELECT day, count(DISTINCT entry_id) AS entries, count(DISTINCT CASE WHEN contains(lower(line), 'todo') THEN substr(trim(line), 1, 200) END) AS todo_lines, sum((contains(lower(line), 'error') OR contains(lower(line), 'ошибка'))::int)::bigint AS error_lines FROM l GROUP BY day""",
)
def agg_19(spark: SparkSession, d: str) -> DataFrame:
    return T.day_patterns(read(spark, d, "daily_log"), F.col("log_file"), ["user_text", "assistant_text"])


# ---- windows -------------------------------------------------------------------------------------

_POS = "pos AS (SELECT *, row_number() OVER (ORDER BY try_cast(logged_at AS timestamptz) NULLS FIRST, log_file, line_no, entry_id) AS pos FROM daily_log)"


def placed_log(spark: SparkSession, d: str) -> DataFrame:
    return T.timeline(read(spark, d, "daily_log"), T.parsed_time("logged_at"), ["log_file", "line_no", "entry_id"])


@C.add("win_1", f"WITH {_POS}, a AS (SELECT min(pos) AS a FROM pos WHERE try_cast(logged_at AS timestamptz)::timestamp::date = DATE '2026-06-01') SELECT entry_id, pos FROM pos, a WHERE pos BETWEEN a - 5 AND a + 5")
def win_1(spark: SparkSession, d: str) -> DataFrame:
    p = placed_log(spark, d)
    anchor = T.resolve_anchor(p, "2026-06-01", ["user_text", "assistant_text"], T.parsed_time("logged_at"))
    return T.window_around(p, anchor, 5, 5).select("entry_id", "pos")


@C.add("win_2", f"WITH {_POS} SELECT min(pos) AS anchor FROM pos WHERE contains(lower(user_text), 'ledger') OR contains(lower(assistant_text), 'ledger')")
def win_2(spark: SparkSession, d: str) -> DataFrame:
    return T.resolve_anchor(placed_log(spark, d), "Ledger", ["user_text", "assistant_text"], T.parsed_time("logged_at"))


@C.add("win_5", f"SELECT {sql_trim('mem_key')} AS mem_key, arg_max(feed_id, (coalesce(updated_at, '0001-01-01'::timestamp), seq, -feed_id)) AS feed_id FROM memory_feed WHERE {sql_trim('mem_key')} <> '' GROUP BY 1")
def win_5(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "memory_feed").withColumn("mem_key", trimmed("mem_key")).filter("mem_key <> ''")
    at = F.struct(F.coalesce("updated_at", F.lit("0001-01-01 00:00:00").cast("timestamp")), "seq", -F.col("feed_id"))
    return f.groupBy("mem_key").agg(F.max_by("feed_id", at).alias("feed_id"))


@C.add(
    "win_7",
    f"""WITH m AS (SELECT mem_id, length(content) AS size, row_number() OVER (ORDER BY coalesce({sql_unit('importance')}, 0.5) DESC, mem_id) AS n FROM memories WHERE deleted_at IS NULL),
o AS (SELECT list_reduce(list(struct_pack(used := size::bigint, taken := [mem_id], id := mem_id) ORDER BY n),
  lambda a, x: CASE WHEN a.used + x.used <= 6000 THEN struct_pack(used := a.used + x.used, taken := list_append(a.taken, x.id), id := x.id) ELSE a END,
  struct_pack(used := 0::bigint, taken := []::bigint[], id := 0::bigint)) AS r FROM m WHERE size IS NOT NULL)
SELECT unnest(r.taken) AS mem_id FROM o""",
)
def win_7(spark: SparkSession, d: str) -> DataFrame:
    """The most important memories within 6 000 characters, larger ones skipped."""
    m = live(_memories(spark, d)).select("mem_id", F.coalesce(unit_interval("importance"), F.lit(0.5)).alias("imp"), F.char_length("content").alias("size"))
    return L.greedy_budget(m, [F.desc("imp"), F.asc("mem_id")], "size", 6_000, ["mem_id"])


@C.add(
    "win_8",
    f"WITH m AS (SELECT mem_id, coalesce({sql_unit('importance')}, 0.5) AS imp, length(content) AS size FROM memories WHERE deleted_at IS NULL) SELECT mem_id FROM m QUALIFY sum(size) OVER (ORDER BY imp DESC, mem_id ROWS UNBOUNDED PRECEDING) <= 6000",
)
def win_8(spark: SparkSession, d: str) -> DataFrame:
    m = live(_memories(spark, d)).select("mem_id", F.coalesce(unit_interval("importance"), F.lit(0.5)).alias("imp"), F.char_length("content").alias("size"))
    return L.prefix_budget(m, [F.desc("imp"), F.asc("mem_id")], "size", 6_000).select("mem_id")


_MSGS = """msgs AS (SELECT coalesce(meta.session_id, '') AS session, entry_id * 2 AS turn, 'user' AS role, user_text AS content FROM daily_log WHERE user_text <> ''
UNION ALL SELECT coalesce(meta.session_id, ''), entry_id * 2 + 1, 'assistant', assistant_text FROM daily_log WHERE assistant_text <> '')"""


@C.add(
    "win_9",
    f"""WITH {_MSGS}, n AS (SELECT session, turn, role, row_number() OVER w AS n, lag(role) OVER w AS prev FROM msgs WINDOW w AS (PARTITION BY session ORDER BY turn))
SELECT session, turn, (floor((n - 1 - (coalesce(prev = 'user' AND n % 60 = 1, false))::int) / 60.0))::bigint AS batch FROM n""",
)
def win_9(spark: SparkSession, d: str) -> DataFrame:
    return T.pair_batches(T.log_messages(read(spark, d, "daily_log"))).select("session", "turn", "batch")


@C.add("win_10", "SELECT quantile_disc(length(text), 0.95)::bigint AS value FROM documents WHERE text IS NOT NULL")
def win_10(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "documents").select(F.char_length("text").cast("long").alias("n"))
    return E.nearest_rank(n, "n", 95)


@C.add("win_11", f"WITH {_POS} SELECT entry_id FROM pos WHERE pos > 100 ORDER BY pos LIMIT 40")
def win_11(spark: SparkSession, d: str) -> DataFrame:
    return T.beyond_prefix(placed_log(spark, d), 100).select("entry_id")


# ---- orders and sets -----------------------------------------------------------------------------


@C.add("top_3", f"SELECT mem_id FROM memories WHERE deleted_at IS NULL ORDER BY coalesce({sql_unit('trust')}, 0.5), access_count, updated_at NULLS FIRST, mem_id LIMIT 20")
def top_3(spark: SparkSession, d: str) -> DataFrame:
    m = live(_memories(spark, d)).withColumn("t", F.coalesce(unit_interval("trust"), F.lit(0.5)))
    return m.orderBy("t", "access_count", F.asc_nulls_first("updated_at"), "mem_id").limit(20).select("mem_id")


@C.add("top_4", "SELECT mem_id FROM memories WHERE deleted_at IS NULL ORDER BY updated_at DESC, mem_id LIMIT 50")
def top_4(spark: SparkSession, d: str) -> DataFrame:
    return live(_memories(spark, d)).orderBy(F.desc("updated_at"), "mem_id").limit(50).select("mem_id")


@C.add("top_5", f"{G_}, {_DEG}, top AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 100) SELECT src, dst, label FROM edges WHERE src IN (FROM top) AND dst IN (FROM top)")
def top_5(spark: SparkSession, d: str) -> DataFrame:
    e = graph_edges(spark, d)
    return B.degree_capped_subgraph(e, G.degrees(e), 100)[1].select("src", "dst", "label")


@C.add("top_7", "SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 25")
def top_7(spark: SparkSession, d: str) -> DataFrame:
    return B.where_given(read(spark, d, "events"), {"event_type": "error"}).orderBy(F.desc("event_id")).limit(25).select("event_id", "event_type")


@C.add(
    "top_8",
    r"""WITH w AS (SELECT DISTINCT doc_id AS doc, unnest(string_split_regex(text, '[^\p{L}\p{N}_.:-]+')) AS label FROM documents WHERE text IS NOT NULL), l AS (SELECT DISTINCT project_id AS label FROM memories WHERE project_id IS NOT NULL)
SELECT doc, label FROM w WHERE length(label) >= 4 AND label IN (FROM l)""",
)
def top_8(spark: SparkSession, d: str) -> DataFrame:
    labels = _memories(spark, d).filter("project_id IS NOT NULL").select(F.col("project_id").alias("label")).distinct()
    return B.mentioned_labels(read(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("doc"), "text"), labels)


@C.add("set_2", "SELECT DISTINCT from_id, to_id, kind FROM memory_links")
def set_2(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "memory_links").select("from_id", "to_id", "kind").distinct()


@C.add("set_3", "SELECT lesson_id, len(list_intersect(a, b))::bigint AS shared, len(list_distinct(a || b))::bigint AS either FROM (SELECT lesson_id, list_distinct(tags) AS a, list_distinct(list_filter(string_split(lower(content), ' '), lambda x: x <> '')) AS b FROM lessons)")
def set_3(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_remove(F.array_distinct(F.split(F.lower("content"), " ")), "")
    return read(spark, d, "lessons").select("lesson_id", F.size(F.array_intersect("tags", words)).cast("long").alias("shared"), F.size(F.array_union("tags", words)).cast("long").alias("either"))


@C.add("set_4", f"SELECT mem_id FROM memories WHERE updated_at >= TIMESTAMP '2026-06-01' EXCEPT SELECT mem_id FROM memories WHERE {sql_unit('trust')} < 0.3")
def set_4(spark: SparkSession, d: str) -> DataFrame:
    m = _memories(spark, d)
    low = m.filter(unit_interval("trust") < 0.3)
    return m.filter("updated_at >= TIMESTAMP '2026-06-01 00:00:00'").join(low.select("mem_id"), "mem_id", "left_anti").select("mem_id")


@C.add(
    "set_5",
    """WITH d AS (SELECT *, created_at < (SELECT min(created_at) + (max(created_at) - min(created_at)) / 2 FROM documents) AS old FROM documents WHERE path IS NOT NULL AND text IS NOT NULL AND created_at IS NOT NULL),
b AS (SELECT path, sha256(arg_max(text, doc_id)) AS h FROM d WHERE old GROUP BY path), a AS (SELECT path, sha256(arg_max(text, doc_id)) AS h FROM d WHERE NOT old GROUP BY path)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.h IS NULL THEN 'new' WHEN a.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS state FROM b FULL JOIN a ON a.path = b.path""",
)
def set_5(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the first and of the second half of the time as two scans of a tree."""
    all_ = read(spark, d, "documents")
    at = F.unix_micros("created_at")
    cut = F.broadcast(all_.agg((F.min(at) + F.floor((F.max(at) - F.min(at)) / 2)).alias("cut")))  # one row
    docs = all_.filter("path IS NOT NULL AND text IS NOT NULL AND created_at IS NOT NULL").join(cut).withColumn("old", at < F.col("cut"))
    pick = lambda old: docs.filter("old" if old else "NOT old").groupBy("path").agg(F.max_by("text", "doc_id").alias("text")).select("path", K.manifest_hash(F.col("text")).alias("hash"))
    return K.manifest_diff(pick(True), pick(False))


@C.add("set_6", "SELECT project_id FROM memories INTERSECT SELECT project_id FROM documents")
def set_6(spark: SparkSession, d: str) -> DataFrame:
    return _memories(spark, d).select("project_id").intersect(read(spark, d, "documents").select("project_id"))


# ---- smaller ones --------------------------------------------------------------------------------


@C.add("xo_1", "WITH r AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS root FROM documents WHERE path IS NOT NULL) SELECT path, arg_max(root, length(root)) AS root FROM (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL) JOIN r ON starts_with(path, root || '/') OR path = root GROUP BY path")
def xo_1(spark: SparkSession, d: str) -> DataFrame:
    paths = read(spark, d, "documents").filter("path IS NOT NULL").select("path").distinct()
    roots = paths.select(F.regexp_replace("path", "/[^/]*$", "").alias("root")).distinct()
    return J.longest_prefix(paths, roots, "path", "root")


@C.add("xo_3", f"SELECT mem_id, coalesce({sql_unit('trust')}, 0.5) AS trust FROM memories WHERE mem_id IN (SELECT to_id FROM memory_links)")
def xo_3(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "memory_links").select(F.col("to_id").alias("mem_id"))
    return _memories(spark, d).join(ids, "mem_id", "left_semi").select("mem_id", F.coalesce(unit_interval("trust"), F.lit(0.5)).alias("trust"))


@C.add("xo_4", "WITH e AS (SELECT user_id, list({'a': value, 'n': 1} ORDER BY ts, event_id) AS l FROM events WHERE value <= 3600 GROUP BY 1) SELECT user_id, round(list_reduce(l, lambda s, x: {'a': s.a + (x.a - s.a) / least(s.n + 1, 10), 'n': s.n + 1}).a, 6) AS mean FROM e")
def xo_4(spark: SparkSession, d: str) -> DataFrame:
    return L.capped_running_mean(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


@C.add("xo_5", "SELECT event_type AS stage, sum(round(value * 1000)::bigint)::bigint AS total_us, count(*) AS n FROM events GROUP BY 1")
def xo_5(spark: SparkSession, d: str) -> DataFrame:
    from memloom.operators.browse import stage_latency

    return stage_latency(read(spark, d, "events").select(F.col("event_type").alias("stage"), F.round(F.col("value") * 1000).cast("long").alias("us")))


@C.add("xo_6", f"{G_}, {_HUBS}, n AS (SELECT id FROM nodes WHERE contains(lower(label), 'index') OR contains(lower(coalesce(description, '')), 'index') ORDER BY id LIMIT 5) SELECT 'hub' AS what, id FROM hubs QUALIFY row_number() OVER (ORDER BY degree DESC, id) <= 8 UNION ALL SELECT 'match', id FROM n")
def xo_6(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    top = G.hubs(n, graph_edges(spark, d, n), NO_HUBS).orderBy(F.desc("degree"), "id").limit(8).select(F.lit("hub").alias("what"), "id")
    q = F.lit("index")
    match = n.filter(F.contains(F.lower("label"), q) | F.contains(F.lower(F.coalesce("description", F.lit(""))), q)).orderBy("id").limit(5)
    return top.unionByName(match.select(F.lit("match").alias("what"), "id"))


@C.add("xo_7", "SELECT feed_id, op FROM memory_feed WHERE contains(lower(content), 'ledger') ORDER BY feed_id DESC LIMIT 50")
def xo_7(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "memory_feed").filter(F.contains(F.lower("content"), F.lit("ledger"))).orderBy(F.desc("feed_id")).limit(50).select("feed_id", "op")


@C.add("xo_8", "SELECT source, count(*) AS n, sum((CASE WHEN coalesce(json_valid(meta), false) THEN json_extract_string(meta, '$.author') IS NULL ELSE true END)::int)::bigint AS without_author FROM memories GROUP BY source")
def xo_8(spark: SparkSession, d: str) -> DataFrame:
    """Per source how many records lack a field of their JSON."""
    author = F.try_variant_get(F.try_parse_json("meta"), "$.author", "string")
    return _memories(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum(author.isNull().cast("long")).alias("without_author"))


@C.add("xo_9", "SELECT lesson_id, reinforcements FROM lessons WHERE confidence >= 0.5 ORDER BY updated_at DESC, lesson_id LIMIT 30")
def xo_9(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lessons").filter("confidence >= 0.5").orderBy(F.desc("updated_at"), "lesson_id").limit(30).select("lesson_id", "reinforcements")


@C.add("xo_10", "WITH c AS (SELECT path, max(created_at) AS changed FROM documents WHERE path IS NOT NULL GROUP BY path) SELECT doc_id, created_at < changed AS stale FROM documents JOIN c USING (path)")
def xo_10(spark: SparkSession, d: str) -> DataFrame:
    """A text is stale if its path has a later version."""
    docs = read(spark, d, "documents").filter("path IS NOT NULL")
    changed = docs.groupBy("path").agg(F.max("created_at").alias("changed"))
    return docs.join(changed, "path").select("doc_id", (F.col("created_at") < F.col("changed")).alias("stale"))


@C.add("xo_11", f"{G_} SELECT e.label, e.weight, n.label AS neighbour FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.src = (SELECT min(src) FROM edges)")
def xo_11(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    e = graph_edges(spark, d, n)
    one = F.broadcast(e.agg(F.min("src").alias("src")))  # one row
    return e.join(one, "src").join(n.select(F.col("id").alias("dst"), F.col("label").alias("neighbour")), "dst").select("label", "weight", "neighbour")


@C.add("xo_12", f"SELECT count(*) AS pending FROM memories WHERE deleted_at IS NULL AND NOT coalesce({SQL_USABLE}, false)")
def xo_12(spark: SparkSession, d: str) -> DataFrame:
    return live(_memories(spark, d)).filter(~usable("embedding")).agg(F.count("*").alias("pending"))


@C.add("xo_13", "SELECT count(*) AS vectors, sum(len(embedding))::bigint AS bytes_after, sum(4 * len(embedding))::bigint AS bytes_before FROM embeddings")
def xo_13(spark: SparkSession, d: str) -> DataFrame:
    """What int8 vectors save."""
    from memloom.functions.vectors import int8_quantize

    q = read(spark, d, "embeddings").select(F.size(int8_quantize("embedding")["q"]).cast("long").alias("n"), F.size("embedding").cast("long").alias("m"))
    return q.agg(F.count("*").alias("vectors"), F.sum("n").alias("bytes_after"), F.sum(4 * F.col("m")).alias("bytes_before"))


@C.add("xo_15", f"{G_} SELECT n.project_id, count(*) AS nodes, count(*) FILTER (n.node_type = 'fact') AS facts, sum(coalesce(o, 0))::bigint AS edges FROM nodes n LEFT JOIN (SELECT src, count(*) AS o FROM edges GROUP BY 1) ON src = n.id GROUP BY 1")
def xo_15(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    out = graph_edges(spark, d, n).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    return n.join(out, "id", "left").groupBy("project_id").agg(F.count("*").alias("nodes"), F.sum((F.col("node_type") == "fact").cast("long")).alias("facts"), F.sum(F.coalesce("o", F.lit(0))).alias("edges"))


@C.add("xo_17", f"WITH {_SLOTS} SELECT label, project, CASE WHEN length(content) + 1 + 5 > 300 THEN NULL ELSE content || chr(10) || 'added' END AS content, length(content) + 1 + 5 > 300 AS rejected FROM slots")
def xo_17(spark: SparkSession, d: str) -> DataFrame:
    """Text appended to scratchpads of at most 300 characters."""
    new = F.concat("content", F.lit("\nadded"))
    over = F.char_length(new) > 300
    return slots(spark, d).select("label", "project", F.when(~over, new).alias("content"), over.alias("rejected"))


