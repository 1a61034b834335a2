"""Queries of graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import scoring as S
from memloom.operators import codegraph as K
from memloom.operators import graph as G
from memloom.operators import lifecycle as L
from memloom.operators import outline
from memloom.operators import search as R
from memloom.operators.ordering import global_rank
from memloom.operators.similarity import nth_of
from memloom.plans import golden_code
from memloom.plans.base import SQL_GRAPH, Catalog, read, graph_edges, graph_nodes
from memloom.plans.relational_queries import _DEG, _ENTRY, _HUBS, _USAGE, NO_HUBS, USAGE

C = Catalog()
QUERIES, ORACLES = C.QUERIES, C.ORACLES
G_ = f"WITH RECURSIVE {SQL_GRAPH}"
_KIND = "CASE lower(label) WHEN 'manual' THEN 1.0 WHEN 'contradicts' THEN 0.8 WHEN 'causes' THEN 0.8 WHEN 'category' THEN 0.5 WHEN 'same_project' THEN 0.3 ELSE 0.5 END"
_SEEDED = "seeds AS (SELECT DISTINCT src AS id FROM edges ORDER BY 1 LIMIT 3)"


def _seeds(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).distinct().orderBy("id").limit(3)


def _weighted(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", (S.kind_weight("label") * F.col("weight")).alias("w"))


def rank_sql(iterations: int, arcs: str, d: float = 0.85, *, seeds: str = "seeds", p0: str = "1.0::double / count(*) OVER ()", x: str = "") -> str:
    """PageRank unrolled: arcs (src, dst, w), seeds (id); the last table is r<iterations>, names end on ``x``."""
    out = [
        f"a0{x} AS ({arcs})",
        f"arcs{x} AS (SELECT src, dst, sum(w / total) AS p FROM a0{x} JOIN (SELECT src, sum(w) AS total FROM a0{x} WHERE w > 0 GROUP BY src) USING (src) WHERE w > 0 GROUP BY src, dst)",
        f"p0{x} AS (SELECT id, {p0} AS p0 FROM {seeds})",
        f"r0{x} AS (SELECT id, p0 AS rank FROM p0{x})",
    ]
    for i in range(1, iterations + 1):
        out.append(f"m{i}{x} AS MATERIALIZED (SELECT dst AS id, {d} * sum(rank * p) AS rank FROM r{i - 1}{x} JOIN arcs{x} ON src = id GROUP BY dst)")
        out.append(f"r{i}{x} AS MATERIALIZED (SELECT id, sum(rank) AS rank FROM (SELECT * FROM m{i}{x} UNION ALL SELECT id, p0 * (1 - coalesce((SELECT sum(rank) FROM m{i}{x}), 0)) FROM p0{x}) GROUP BY id)")
    return ", ".join(out)


KIND_ARCS = _ARCS = f"SELECT src, dst, {_KIND} * weight AS w FROM edges"


@C.add("gr_1", f"{G_}, {_SEEDED}, {rank_sql(20, _ARCS)} SELECT id, round(rank, 6) AS rank FROM r20")
def gr_1(spark: SparkSession, d: str) -> DataFrame:
    e = graph_edges(spark, d)
    return G.pagerank(_weighted(e), _seeds(e).withColumn("weight", F.lit(1.0))).select("id", F.round("rank", 6).alias("rank"))


_GONE = "gone AS (SELECT DISTINCT dst AS id FROM edges WHERE label = 'supersedes')"


@C.add(
    "gr_2",
    f"""{G_}, {_GONE}, seeds AS (SELECT DISTINCT src AS id FROM edges WHERE src NOT IN (FROM gone) ORDER BY 1 LIMIT 3),
{rank_sql(20, _ARCS + ' WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone)')} SELECT id, round(rank, 6) AS rank FROM r20""",
)
def gr_2(spark: SparkSession, d: str) -> DataFrame:
    e = graph_edges(spark, d)
    gone = e.filter("label = 'supersedes'").select(F.col("dst").alias("id")).distinct()
    seeds = e.select(F.col("src").alias("id")).distinct().join(gone, "id", "left_anti").orderBy("id").limit(3).withColumn("weight", F.lit(1.0))
    return G.pagerank(_weighted(e), seeds, superseded=gone).select("id", F.round("rank", 6).alias("rank"))




@C.add(
    "gr_3",
    f"""{G_}, {_SEEDED}, ways AS (SELECT src AS f, dst AS t FROM edges UNION SELECT dst, src FROM edges),
walk(id, depth) AS (SELECT id, 0 FROM seeds UNION SELECT t, depth + 1 FROM walk JOIN ways ON f = id WHERE depth < 2)
SELECT id, min(depth)::bigint AS hop FROM walk GROUP BY id""",
)
def gr_3(spark: SparkSession, d: str) -> DataFrame:
    e = graph_edges(spark, d)
    nodes, _ = G.khop_subgraph(e, _seeds(e), 2)
    return nodes.select("id", F.col("hop").cast("long").alias("hop"))


@C.add(
    "gr_4",
    f"""{G_}, top AS (SELECT id FROM nodes ORDER BY importance DESC, updated_at DESC, id LIMIT 500),
seeds AS (SELECT id FROM top ORDER BY id LIMIT 3), {rank_sql(20, _ARCS + ' WHERE src IN (FROM top) AND dst IN (FROM top)')} SELECT id, round(rank, 6) AS rank FROM r20""",
)
def gr_4(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    top = F.broadcast(n.orderBy(F.desc("importance"), F.desc("updated_at"), "id").limit(500).select("id"))  # 500 rows
    e = graph_edges(spark, d, n)
    inside = e.join(top.withColumnRenamed("id", "src"), "src", "left_semi").join(top.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return G.pagerank(_weighted(inside), top.orderBy("id").limit(3).withColumn("weight", F.lit(1.0))).select("id", F.round("rank", 6).alias("rank"))


@C.add("gr_5", f"{G_} SELECT DISTINCT label, ({_KIND})::double AS weight FROM edges")
def gr_5(spark: SparkSession, d: str) -> DataFrame:
    return graph_edges(spark, d).select("label", S.kind_weight("label").alias("weight")).distinct()


@C.add("gr_6", f"{G_} SELECT id, round(trust * CASE WHEN starts_with(file_path, 'prj_hub/') THEN 1.2 ELSE 1 END, 6) AS weight FROM nodes")
def gr_6(spark: SparkSession, d: str) -> DataFrame:
    return graph_nodes(spark, d).select("id", F.round(S.working_set_boost("trust", F.col("file_path").startswith("prj_hub/")), 6).alias("weight"))


_HUBTO = "target AS (SELECT dst AS id FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


def _most_linked(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


_IMPACT = f"""{_HUBTO}, walk(id, depth) AS (SELECT id, 0 FROM target UNION SELECT src, depth + 1 FROM walk JOIN edges ON dst = id WHERE depth < 3 AND weight >= 0.4),
impact AS (SELECT id, min(depth)::bigint AS depth FROM walk WHERE id NOT IN (FROM target) GROUP BY id)"""


@C.add("gr_7", f"{G_}, {_IMPACT} SELECT * FROM impact")
def gr_7(spark: SparkSession, d: str) -> DataFrame:
    e = graph_edges(spark, d)
    return G.reach(e, _most_linked(e), 3, reverse=True, least_weight=0.4).select("id", F.col("depth").cast("long").alias("depth"))


@C.add(
    "gr_8",
    f"""{G_}, {_IMPACT}, {_HUBS} SELECT t.id, (SELECT count(*) FROM impact) AS affected,
CASE WHEN t.id IN (SELECT id FROM hubs) OR EXISTS (SELECT 1 FROM impact JOIN hubs USING (id)) OR (SELECT count(*) FROM impact) > 8 THEN 'High' WHEN (SELECT count(*) FROM impact) > 2 THEN 'Medium' ELSE 'Low' END AS risk FROM target t""",
)
def gr_8(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    e = graph_edges(spark, d, n)
    target = _most_linked(e)
    hubs = G.hubs(n, e, NO_HUBS).select("id", F.lit(1).alias("hub"))
    hit = G.reach(e, target, 3, reverse=True, least_weight=0.4).join(hubs, "id", "left").agg(F.count("*").alias("affected"), F.max("hub").alias("hit"))
    one = target.join(hubs, "id", "left").join(F.broadcast(hit))  # one row each
    return one.select("id", "affected", G.impact_grade(F.col("hub").isNotNull(), F.col("hit").isNotNull(), F.col("affected")).alias("risk"))


@C.add("gr_9", f"{G_}, {_SEEDED}, walk(id, depth) AS (SELECT id, 0 FROM seeds UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = id WHERE depth < 4 AND label IN {_USAGE}) SELECT id, min(depth)::bigint AS depth FROM walk WHERE id NOT IN (FROM seeds) GROUP BY id")
def gr_9(spark: SparkSession, d: str) -> DataFrame:
    e = graph_edges(spark, d)
    return G.reach(e, _seeds(e), 4, labels=USAGE).select("id", F.col("depth").cast("long").alias("depth"))


@C.add(
    "gr_10",
    f"""{G_}, s AS (SELECT min(src) AS id FROM edges), walk(id, depth) AS (SELECT id, 0 FROM s UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = id WHERE depth < 6),
far AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id ORDER BY 2 DESC, 1 LIMIT 1) SELECT count(*) AS steps FROM (SELECT unnest(range(0, depth + 1)) FROM far)""",
)
def gr_10(spark: SparkSession, d: str) -> DataFrame:
    """Length in nodes of a shortest path to the node that is farthest within 6 steps."""
    e = graph_edges(spark, d)
    start = e.agg(F.min("src").alias("id"))
    far = G.reach(e, start, 6).orderBy(F.desc("depth"), "id").select("id").first()
    s = start.first()["id"]
    return G.shortest_path(e, s, far["id"] if far else s, 6).agg(F.count("*").alias("steps"))


@C.add(
    "gr_11",
    f"""{G_} SELECT id FROM nodes WHERE node_type IN ('fact', 'rule', 'decision') AND id NOT IN (SELECT dst FROM edges WHERE label IN {_USAGE} AND src <> dst) AND id NOT IN (SELECT src FROM edges WHERE label IN ('summary'))
AND (SELECT {_ENTRY} FROM (SELECT nodes.label AS title, lower(nodes.file_path) AS p, lower(coalesce(nodes.description, '')) AS t)) IS NULL""",
)
def gr_11(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    return G.dead_nodes(n, graph_edges(spark, d, n), ["fact", "rule", "decision"], USAGE, ["summary"], K.entrypoint_reason("label", "file_path", "description")).select("id")


@C.add(
    "gr_12",
    f"""{G_}, e AS (SELECT DISTINCT src, dst FROM edges WHERE label IN {_USAGE} AND src <> dst), walk(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM walk JOIN e ON src = b),
cyc AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM walk x JOIN walk y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a),
loops AS (SELECT DISTINCT src AS id, src AS component FROM edges WHERE src = dst AND label IN {_USAGE})
SELECT id, min(component) AS component FROM (SELECT * FROM cyc UNION ALL SELECT * FROM loops) GROUP BY id""",
)
def gr_12(spark: SparkSession, d: str) -> DataFrame:
    return G.strong_components(graph_edges(spark, d).filter(F.col("label").isin(*USAGE)))


def _labels_sql(rounds: int) -> str:
    """Label propagation unrolled: ways (src, dst, w)."""
    out = ["l0 AS (SELECT DISTINCT src AS id, src AS c FROM ways)"]
    for r in range(rounds):
        out.append(f"b{r} AS MATERIALIZED (SELECT id, arg_min(c, (-round(w, 9), c)) AS n FROM (SELECT src AS id, c, sum(w) AS w FROM ways JOIN l{r} ON l{r}.id = dst GROUP BY 1, 2) GROUP BY id)")
        out.append(f"l{r + 1} AS MATERIALIZED (SELECT l{r}.id, CASE WHEN l{r}.id % 2 = {r % 2} AND n IS NOT NULL THEN n ELSE c END AS c FROM l{r} LEFT JOIN b{r} ON b{r}.id = l{r}.id)")
    return ", ".join(out)


@C.add(
    "gr_13",
    f"""{G_}, ways AS (SELECT src, dst, sum(weight) AS w FROM (SELECT src, dst, weight FROM edges WHERE src <> dst UNION ALL SELECT dst, src, weight FROM edges WHERE src <> dst) GROUP BY 1, 2), {_labels_sql(10)}
SELECT c AS community, count(*) AS n FROM l10 GROUP BY 1 HAVING count(*) >= 3""",
)
def gr_13(spark: SparkSession, d: str) -> DataFrame:
    e = graph_edges(spark, d).select("src", "dst", F.col("weight").alias("w"))
    labels = G.propagate_labels(e)
    zones = labels.groupBy("community").agg(F.count("*").alias("n")).filter("n >= 3")
    return zones


@C.add(
    "gr_14",
    f"""{G_}, f AS (SELECT id, updated_at, EXISTS (SELECT 1 FROM edges WHERE dst = nodes.id AND src <> dst AND label IN {_USAGE}) AS called FROM nodes WHERE updated_at <= TIMESTAMP '2026-06-01' AND updated_at >= TIMESTAMP '2026-06-01' - INTERVAL 30 DAY),
o AS (SELECT id FROM f ORDER BY called DESC, updated_at DESC, id LIMIT 1) SELECT o.id, c.src AS caller FROM o LEFT JOIN (SELECT DISTINCT src, dst FROM edges WHERE src <> dst AND label IN {_USAGE}) c ON c.dst = o.id ORDER BY c.src LIMIT 5""",
)
def gr_14(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    return G.recent_edit_hint(n, graph_edges(spark, d, n), "2026-06-01 00:00:00", USAGE, minutes=30 * 24 * 60)


_FILES = f"""fe AS (SELECT a.file_path AS src, b.file_path AS dst, count(*)::double AS w FROM edges JOIN nodes a ON a.id = edges.src JOIN nodes b ON b.id = edges.dst WHERE a.file_path <> b.file_path AND edges.label IN {_USAGE} GROUP BY 1, 2)"""


def file_graph(n: DataFrame, e: DataFrame) -> DataFrame:
    f = n.select("id", "file_path")
    j = e.filter(F.col("label").isin(*USAGE)).join(f.select(F.col("id").alias("src"), F.col("file_path").alias("a")), "src").join(f.select(F.col("id").alias("dst"), F.col("file_path").alias("b")), "dst")
    return j.filter("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").cast("double").alias("w"))


@C.add("gr_15", f"{G_}, {_FILES}, seeds AS (SELECT src AS id FROM fe UNION SELECT dst FROM fe), {rank_sql(20, 'SELECT * FROM fe')} SELECT id AS file_path, round(rank, 6) AS rank FROM r20")
def gr_15(spark: SparkSession, d: str) -> DataFrame:
    """Files ranked over their links, all alike as seeds."""
    n = graph_nodes(spark, d)
    fe = file_graph(n, graph_edges(spark, d, n))
    seeds = fe.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("weight", F.lit(1.0))
    return G.pagerank(fe, seeds).select(F.col("id").alias("file_path"), F.round("rank", 6).alias("rank"))


@C.add(
    "top_6",
    f"""{G_}, {_HUBS}, {_FILES}, seeds AS (SELECT src AS id FROM fe UNION SELECT dst FROM fe), {rank_sql(20, 'SELECT * FROM fe')},
t AS (SELECT id AS file_path, round(rank, 6) AS rank, (id IN (SELECT file_path FROM nodes WHERE nodes.id IN (SELECT id FROM hubs)))::int AS hub FROM r20)
SELECT file_path, rank FROM t QUALIFY sum(length(file_path) + 20) OVER (ORDER BY hub DESC, rank DESC, file_path ROWS UNBOUNDED PRECEDING) <= 4000""",
)
def top_6(spark: SparkSession, d: str) -> DataFrame:
    """Files in order of rank, those with hubs first, as many as a budget of characters allows."""
    n = graph_nodes(spark, d)
    e = graph_edges(spark, d, n)
    hub_files = G.hubs(n, e, NO_HUBS).select("file_path", F.lit(1).alias("hub")).distinct()
    ranked = gr_15(spark, d).join(hub_files, "file_path", "left").fillna(0, ["hub"])
    blocks = ranked.withColumn("size", F.char_length("file_path") + 20)
    return L.prefix_budget(blocks, [F.desc("hub"), F.desc("rank"), F.asc("file_path")], "size", 4_000).select("file_path", "rank")


@C.add(
    "gr_16",
    f"""{G_}, {_SEEDED}, {rank_sql(20, _ARCS)}, hits AS (SELECT id, rank AS score FROM r20), f AS (SELECT id, score, max(score) OVER () AS best, lag(score) OVER (ORDER BY score DESC, id) AS prev FROM hits),
c AS (SELECT id, max((score < 0.15 * best OR coalesce(prev > 0 AND (prev - score) / prev > 0.5, false) OR best <= 0)::int) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS cut FROM f)
SELECT c.id, n.label, e.dst, round(e.weight, 6) AS weight FROM c JOIN nodes n ON n.id = c.id LEFT JOIN (SELECT src, dst, label, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, label, dst) AS r FROM edges) e ON e.src = c.id AND e.r <= 5 WHERE cut = 0""",
)
def gr_16(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    e = graph_edges(spark, d, n)
    hits = G.pagerank(_weighted(e), _seeds(e).withColumn("weight", F.lit(1.0))).select("id", F.col("rank").alias("score"))
    cut = G.elbow_cut(hits)
    out = nth_of(e, ["src"], [F.desc("weight"), F.asc("label"), F.asc("dst")], 5).select(F.col("src").alias("id"), "dst", F.round("weight", 6).alias("weight"))
    return n.select("id", "label").join(cut.select("id"), "id").join(out, "id", "left")


@C.add("gr_17", f"{G_}, {_DEG} SELECT 'nodes of type ' || node_type AS item, count(*)::double AS value FROM nodes GROUP BY 1 UNION ALL SELECT 'edges', count(*)::double FROM edges UNION ALL SELECT 'most linked', max(degree)::double FROM deg")
def gr_17(spark: SparkSession, d: str) -> DataFrame:
    n = graph_nodes(spark, d)
    e = graph_edges(spark, d, n)
    types = n.groupBy(F.concat(F.lit("nodes of type "), "node_type").alias("item")).agg(F.count("*").cast("double").alias("value"))
    links = e.agg(F.count("*").cast("double").alias("value")).select(F.lit("edges").alias("item"), "value")
    most = G.degrees(e).agg(F.max("degree").cast("double").alias("value")).select(F.lit("most linked").alias("item"), "value")
    return types.unionByName(links).unionByName(most)


@C.add(
    "gr_18",
    """WITH s AS (SELECT DISTINCT l_orderkey AS t, l_partkey AS i FROM lineitem), k AS (SELECT t FROM s GROUP BY t HAVING count(*) BETWEEN 2 AND 10), p AS (SELECT a.i AS a, b.i AS b, count(*) AS n FROM s a JOIN s b ON a.t = b.t AND a.i < b.i WHERE a.t IN (FROM k) GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT a, b, 'GIT_HISTORY' AS provenance FROM p WHERE a IN (SELECT p_partkey FROM part WHERE p_size > 10) AND b IN (SELECT p_partkey FROM part WHERE p_size > 10)""",
)
def gr_18(spark: SparkSession, d: str) -> DataFrame:
    """Items that change together, as edges between those that are nodes."""
    pairs = G.cochange_pairs(read(spark, d, "lineitem"), "l_orderkey", "l_partkey")
    files = read(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("id"))
    both = pairs.join(files.withColumnRenamed("id", "a"), "a", "left_semi").join(files.withColumnRenamed("id", "b"), "b", "left_semi")
    return both.select("a", "b", F.lit("GIT_HISTORY").alias("provenance"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return outline.parse_sources(read(spark, d, "documents"), "doc_id", "path", "text")


@C.add("parse_sources")
def parse_sources(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d)


def _import_edges(spark: SparkSession, d: str) -> DataFrame:
    """Paths that texts mention after ``through`` or ``as in``, as imports of their own path."""
    docs = read(spark, d, "documents").filter("path IS NOT NULL AND text IS NOT NULL")
    named = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([a-z]+/[a-z]+/[a-z_0-9]+)[.](?:py|ts|rs|go|sql)"), 1)))
    e = docs.select("doc_id", F.concat(F.lit("file:"), "path").alias("src"), named.alias("m"))
    return e.select(F.concat_ws("#", F.col("doc_id").cast("string"), "m").alias("id"), "src", F.concat(F.lit("module:"), F.translate("m", "/", ".")).alias("dst"))


@C.add(
    "gr_19",
    """WITH e AS (SELECT DISTINCT doc_id, path, unnest(regexp_extract_all(text, '([a-z]+/[a-z]+/[a-z_0-9]+)[.](?:py|ts|rs|go|sql)', 1)) AS m FROM documents WHERE path IS NOT NULL AND text IS NOT NULL),
c AS (SELECT e.*, f.n * 2 + g.n AS pos, f.f || m || g.e AS p FROM e, (VALUES (0, 'backend/app/services/'), (1, 'backend/app/'), (2, 'backend/'), (3, 'app/'), (4, '')) f(n, f), (VALUES (0, '.py'), (1, '/__init__.py')) g(n, e)),
h AS (SELECT doc_id, m, arg_min(p, pos) AS p FROM c WHERE p IN (SELECT path FROM documents) GROUP BY ALL)
SELECT e.doc_id || '#' || e.m AS id, 'file:' || path AS src, coalesce('file:' || h.p, 'module:' || replace(e.m, '/', '.')) AS dst, h.p IS NOT NULL AS resolved FROM e LEFT JOIN h ON h.doc_id = e.doc_id AND h.m = e.m""",
)
def gr_19(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "documents").filter("path IS NOT NULL").select("path").distinct()
    return K.resolve_imports(_import_edges(spark, d), files)


@C.add(
    "gr_20",
    """SELECT caller, target, provenance FROM (VALUES
('store/cache.py#get', 'store/cache.py#load', 'RESOLVED'), ('store/cache.py#load', 'store/cache.py#get', 'RESOLVED'), ('store/cache.py#load', 'store/cache.py#decode', 'RESOLVED'),
('store/cache.py#create_row', 'store/cache.py#Cache', 'RESOLVED'), ('store/cache.py#create_row', 'store/cache.py#get', 'RESOLVED'), ('src/graph.rs#step', 'src/graph.rs#visit', 'RESOLVED'),
('src/graph.rs#visit', 'src/graph.rs#check', 'RESOLVED'), ('web/client.ts#main', 'web/client.ts#load', 'RESOLVED'), ('web/client.ts#main', 'web/client.ts#format', 'RESOLVED'),
('web/client.ts#main', 'cmd/server.go#log', 'HEURISTIC'), ('cmd/server.go#Serve', 'cmd/server.go#log', 'RESOLVED'), ('cmd/server.go#Serve', 'cmd/server.go#check', 'RESOLVED'),
('cmd/server.go#main', 'cmd/server.go#newServer', 'RESOLVED'), ('app/jobs.py#nightly', 'store/cache.py#decode', 'RESOLVED'), ('app/jobs.py#nightly', 'store/cache.py#create_row', 'RESOLVED')
) t(caller, target, provenance)""",
)
def gr_20(spark: SparkSession, d: str) -> DataFrame:
    """The calls of the golden sources, resolved over their own symbols and imports."""
    files = spark.createDataFrame(list(golden_code.SOURCES.items()), "path string, text string")
    named = F.concat_ws("#", "path", "name")
    defined = outline.parse_sources(files, "path", "path", "text").filter("kind <> 'Import'").groupBy("path", "name").agg(F.min("owner").alias("owner"))
    defined = defined.select(named.alias("id"), F.col("path").alias("file"), "name", "owner")
    edges = outline.parse_edges(files, "path", "path", "text")
    sites = edges.filter("label = 'CALLS'").select(F.concat_ws("#", "path", "line", "src", "dst").alias("id"), F.col("path").alias("file"), F.concat_ws("#", "path", "src").alias("caller"), F.col("dst").alias("name"), "owner")
    modules = edges.filter("label = 'IMPORTS'").select(F.concat_ws("#", "path", "dst").alias("id"), F.concat(F.lit("file:"), "path").alias("src"), F.concat(F.lit("module:"), "dst").alias("dst"))
    found = K.resolve_imports(modules, files.select("path")).filter("resolved")
    bare = lambda c: F.regexp_replace(c, "^file:", "")
    return K.resolve_calls(sites.distinct(), defined, found.select(bare("src").alias("file"), bare("dst").alias("target_file")).distinct())


@C.add(
    "gr_21",
    r"""WITH r AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\b[A-Z][a-z]+[A-Z][a-z]+\b')) AS rpc FROM documents), h AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\b[a-z]+_[a-z]+\b')) AS handler FROM documents)
SELECT rpc, handler FROM r JOIN h ON handler = lower(regexp_replace(rpc, '([a-z])([A-Z])', '\1_\2'))""",
)
def gr_21(spark: SparkSession, d: str) -> DataFrame:
    """Names in the form of rpc methods and in the form of functions that are the same in snake case."""
    named = lambda p: read(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"\b({p})\b"), 1))).alias("name")).distinct().withColumn("id", F.col("name"))
    return K.rpc_bridges(named("[A-Z][a-z]+[A-Z][a-z]+"), named("[a-z]+_[a-z]+"))


@C.add("gr_22", "SELECT doc_id, 'pkg:pypi:' || split_part(m, '.', 1) AS dst FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[a-z]+[.][a-z]+'))) AS m FROM documents WHERE path IS NOT NULL AND ends_with(path, '.py'))")
def gr_22(spark: SparkSession, d: str) -> DataFrame:
    """All dotted names of a text as imports of its file."""
    docs = read(spark, d, "documents").filter(F.col("path").endswith(".py"))
    module = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]+[.][a-z]+)"), 1)))
    docs = docs.select("doc_id", "path", module.alias("module"))
    edges = docs.select("doc_id", F.concat(F.lit("file:"), "path").alias("src"), F.concat(F.lit("module:"), "module").alias("dst"), F.lit("python").alias("lang"))
    return K.consolidate_external(edges).select("doc_id", "dst")


@C.add("gr_23", "SELECT DISTINCT 'file:' || path AS node_id, 'File' AS node_type, path AS label FROM documents WHERE path IS NOT NULL AND doc_id % 2 = 0 AND path NOT IN (SELECT path FROM documents WHERE path IS NOT NULL AND doc_id % 2 = 1)")
def gr_23(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("path IS NOT NULL")
    node = F.concat(F.lit("file:"), "path")
    return K.missing_nodes(docs.filter("doc_id % 2 = 0").select(node.alias("dst")), docs.filter("doc_id % 2 = 1").select(node.alias("node_id")).distinct())


@C.add(
    "gr_24",
    f"""{G_}, h AS (SELECT id, (CASE WHEN contains(lower(label), 'ledger') THEN 10.0 WHEN contains(lower(coalesce(description, '')), 'ledger') THEN 1.0 ELSE 0 END) AS score FROM nodes QUALIFY score > 0 AND row_number() OVER (ORDER BY score DESC, id) <= 10)
SELECT s.label AS source, e.label AS relation, t.label AS target FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes t ON t.id = e.dst WHERE e.src IN (SELECT id FROM h) OR e.dst IN (SELECT id FROM h) ORDER BY e.weight DESC, e.src, e.dst, e.label LIMIT 40""",
)
def gr_24(spark: SparkSession, d: str) -> DataFrame:
    """Facts around the hits of a query."""
    n = graph_nodes(spark, d)
    e = graph_edges(spark, d, n)
    hits = F.broadcast(R.ranked(R.graph_lexical(n, "ledger"), 10).select("id"))  # 10 rows
    near = e.join(hits.withColumn("s", F.lit(1)).withColumnRenamed("id", "src"), "src", "left").join(hits.withColumn("t", F.lit(1)).withColumnRenamed("id", "dst"), "dst", "left")
    top = F.broadcast(near.filter("s = 1 OR t = 1").orderBy(F.desc("weight"), "src", "dst", "label").limit(40).select("src", "dst", F.col("label").alias("relation")))
    named = n.select(F.col("id").alias("src"), F.col("label").alias("source")).join(top, "src")
    return n.select(F.col("id").alias("dst"), F.col("label").alias("target")).join(named, "dst").select("source", "relation", "target")


@C.add("xo_16", f"{G_}, {_SEEDED}, {rank_sql(20, _ARCS)}, r AS (SELECT id, row_number() OVER (ORDER BY round(rank, 9) DESC, id) AS rank FROM r20) SELECT count(*) AS expected, round(avg(coalesce(1.0 / r.rank, 0)), 6) AS mrr FROM (SELECT DISTINCT dst AS id FROM edges WHERE src IN (FROM seeds)) g LEFT JOIN r USING (id)")
def xo_16(spark: SparkSession, d: str) -> DataFrame:
    """Where the seeds' own neighbours stand in the ranking."""
    e = graph_edges(spark, d)
    seeds = F.broadcast(_seeds(e))  # 3 rows
    ranks = G.pagerank(_weighted(e), seeds.withColumn("weight", F.lit(1.0)))
    placed = global_rank(ranks.select("id", F.round("rank", 9).alias("r")), [F.desc("r"), F.asc("id")])
    want = e.join(seeds.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return want.join(placed, "id", "left").agg(F.count("*").alias("expected"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def _golden_rows() -> str:
    """The golden sources and, by hand, their symbols as SQL rows."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    files = ", ".join(f"({q(p)}, {q(t)})" for p, t in golden_code.SOURCES.items())
    spans = ", ".join(f"({q(p)}, {q(n)}, {a}, {b if b > a else a + 40})" for p, _, n, a, b, _ in golden_code.SYMBOLS)
    return f"files(path, text) AS (VALUES {files}), spans(path, name, a, b) AS (VALUES {spans})"


def span_chunks(files: DataFrame) -> DataFrame:
    """(id, chunk) of the symbols of files (path, content)."""
    found = outline.parse_sources(files, "path", "path", "content").filter("kind <> 'Import'")
    line_end = F.when(F.col("line_end") > F.col("line"), F.col("line_end"))
    spans = found.select(F.concat_ws("#", "path", "name", "line").alias("id"), "path", F.col("line").alias("line_start"), line_end.alias("line_end"), F.col("name").alias("scope"))
    return K.span_chunk(files, spans).select("id", "chunk")


@C.add(
    "xo_18",
    f"""WITH {_golden_rows()}, b AS (SELECT path, name, a, '// ' || path || ' :: ' || name AS head, string_split(text, chr(10))[a:b] AS l FROM spans JOIN files USING (path)),
r AS (SELECT *, list_transform(range(1, len(l) + 1), lambda i: length(head || chr(10) || array_to_string(l[1:i], chr(10))) <= 1500) AS ok FROM b)
SELECT path || '#' || name || '#' || a AS id, CASE WHEN ok[1] THEN head || chr(10) || array_to_string(l[1:len(list_filter(ok, lambda x: x))], chr(10)) ELSE head END AS chunk FROM r""",
)
def xo_18(spark: SparkSession, d: str) -> DataFrame:
    """The golden sources cut into the spans of their symbols."""
    return span_chunks(spark.createDataFrame(list(golden_code.SOURCES.items()), "path string, content string"))


@C.add("xo_18_documents")
def xo_18_documents(spark: SparkSession, d: str) -> DataFrame:
    """One file per path of the documents cut into the spans of its symbols."""
    docs = read(spark, d, "documents").filter("path IS NOT NULL AND text IS NOT NULL")
    return span_chunks(docs.groupBy("path").agg(F.min_by("text", "doc_id").alias("content")))
