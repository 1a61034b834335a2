"""Queries of retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import scoring as S
from memloom.functions import vectors as V
from memloom.functions.keys import unit_interval
from memloom.operators import graph as G
from memloom.operators import joins as J
from memloom.operators import search as R
from memloom.operators.vectors import usable
from memloom.plans.base import AS_OF, SQL_GRAPH, SQL_USABLE, Catalog, live_memories, prepared, read, vectors, sql_cos, sql_unit, graph_edges, graph_nodes
from memloom.sources.tables import live

C = Catalog()
QUERIES, ORACLES = C.QUERIES, C.ORACLES
QUERY = "ledger stale"
PROJECT = "prj_hub"


_live, _vectors = live_memories, vectors


def _query_vector(spark: SparkSession, d: str, mask: bool = False) -> DataFrame:
    """The embedding of the first live memory that has one, as a query of its own."""
    build = lambda: _vectors(spark, d).orderBy("mem_id").limit(1).select(F.col("embedding").alias("q"), F.col("mask").alias("q_mask")).coalesce(1)
    one = prepared(spark, d, "query", build)
    return one if mask else one.select("q")


def _bm25_sql(table: str, id_col: str, text: str, terms: list[str], k: int | None, every: bool = True) -> str:
    dl = "greatest(length(t) - 2, 0)"
    dfs = ", ".join(f"sum(contains(t, '{w}')::int) AS df{i}" for i, w in enumerate(terms))
    part = lambda i, w: (
        f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * ((length(t) - length(replace(t, '{w}', ''))) / {len(w)}) * 2.2 "
        f"/ ((length(t) - length(replace(t, '{w}', ''))) / {len(w)} + 1.2 * (0.25 + 0.75 * {dl} / mean))"
    )
    return f"""
fts_base AS (SELECT {id_col} AS id, lower(coalesce({text}, '')) AS t FROM {table}),
fts_stats AS (SELECT count(*) AS n, avg({dl}) AS mean, {dfs} FROM fts_base),
fts AS (
  SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
    SELECT id, {' + '.join(part(i, w) for i, w in enumerate(terms))} AS score FROM fts_base, fts_stats
    WHERE {(' AND ' if every else ' OR ').join(f"contains(t, '{w}')" for w in terms)})
  {'' if k is None else f'QUALIFY rank <= {k}'}
)"""


_LIVE = "(SELECT * FROM memories WHERE deleted_at IS NULL)"
_VEC = f"vec AS (SELECT mem_id AS id, embedding, project_id FROM memories WHERE deleted_at IS NULL AND {SQL_USABLE}), qv AS (SELECT embedding AS q FROM vec ORDER BY id LIMIT 1)"
_NEAR = lambda k, least=0.0, where="true": (
    f"vs AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, {sql_cos('embedding', 'q')} AS score FROM vec, qv WHERE {where}) WHERE score >= {least} QUALIFY rank <= {k})"
)
_TERMS = QUERY.split()


@C.add("ret_1", f"WITH {_bm25_sql(_LIVE, 'mem_id', 'content', _TERMS, 50)} SELECT id, round(score, 6) AS score, rank FROM fts")
def ret_1(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_search(_live(spark, d), "mem_id", "content", QUERY, 50).select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@C.add("ret_1_index", f"SELECT mem_id AS id FROM memories WHERE deleted_at IS NULL AND {' AND '.join(f'contains(lower(content), {chr(39)}{w}{chr(39)})' for w in _TERMS)}")
def ret_1_index(spark: SparkSession, d: str) -> DataFrame:
    """Phrase matches by way of the trigram index."""
    docs = _live(spark, d)
    found = R.index_candidates(R.gram_index(docs, "mem_id", "content"), QUERY)
    text = F.lower("content")
    kept = docs.select(F.col("mem_id").alias("id"), "content").join(found, "id", "left_semi")
    return kept.filter(F.contains(text, F.lit(_TERMS[0])) & F.contains(text, F.lit(_TERMS[1]))).select("id")


_HAMMING = "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (embedding[i] > 0) <> (q[i] > 0) THEN 1 ELSE 0 END))"
_TWO = lambda where="true": f"""
pre AS (SELECT id, embedding FROM vec, qv WHERE {where} ORDER BY {_HAMMING}, id LIMIT 400),
two AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, {sql_cos('embedding', 'q')} AS score FROM pre, qv) WHERE score >= 0.1 QUALIFY rank <= 10)"""  # noqa: E731


@C.add("ret_2", f"WITH {_VEC}, {_TWO()} SELECT id, round(score, 6) AS score, rank FROM two")
def ret_2(spark: SparkSession, d: str) -> DataFrame:
    masked = _vectors(spark, d)
    return _hits(R.two_stage_search(masked, "mem_id", "embedding", _query_vector(spark, d, True), 10, 0.1))


def _hits(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@C.add("ret_3", f"WITH {_VEC}, {_NEAR(20, 0.1)} SELECT id, round(score, 6) AS score, rank FROM vs")
def ret_3(spark: SparkSession, d: str) -> DataFrame:
    return _hits(R.exact_search(_vectors(spark, d), "mem_id", "embedding", _query_vector(spark, d), 20, 0.1))


@C.add(
    "ret_3_batch",
    f"""WITH {_VEC}, n AS (SELECT id, embedding::double[] AS e, sqrt(list_dot_product(embedding::double[], embedding::double[])) AS n FROM vec)
SELECT q.id AS query, r.id, round(round(list_dot_product(q.e, r.e) / (q.n * r.n), 9), 6) AS score FROM n q JOIN n r ON q.id <> r.id WHERE q.id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.e, r.e) / (q.n * r.n), 9) DESC, r.id) <= 10""",
)
def ret_3_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector as a query, against all."""
    v = _vectors(spark, d)
    queries = v.filter("mem_id % 20 = 0").select(F.col("mem_id").alias("query"), F.col("embedding").alias("q"))
    return R.batch_search(v, "mem_id", "embedding", queries, 10).select("query", "id", F.round("score", 6).alias("score"))


@C.add("ret_4", f"WITH {_VEC}, {_TWO(f'project_id = {chr(39)}{PROJECT}{chr(39)}')} SELECT id, round(score, 6) AS score, rank FROM two")
def ret_4(spark: SparkSession, d: str) -> DataFrame:
    masked = _vectors(spark, d)
    return _hits(R.two_stage_search(masked, "mem_id", "embedding", _query_vector(spark, d, True), 10, 0.1, namespace=F.col("project_id") == PROJECT))


@C.add("ret_5", f"WITH {_VEC}, {_NEAR(10)} SELECT id, round(score, 6) AS score, rank FROM vs")
def ret_5(spark: SparkSession, d: str) -> DataFrame:
    return _hits(R.int8_search(_vectors(spark, d), "mem_id", "embedding", _query_vector(spark, d), 10, oversample=2))


_RRF = lambda k: f"""
rrf AS (
  SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank, match_type FROM (
    SELECT id, sum(s) AS score, CASE WHEN count(*) > 1 THEN 'hybrid' ELSE max(m) END AS match_type
    FROM (SELECT id, 1.0::double / (60 + rank) AS s, 'fts' AS m FROM fts UNION ALL SELECT id, 1.0::double / (60 + rank), 'vector' FROM vs) GROUP BY id)
  QUALIFY rank <= {k}
)"""  # noqa: E731


def _hybrid(spark: SparkSession, d: str, k: int, deep: int) -> DataFrame:
    fts = R.bm25_search(_live(spark, d), "mem_id", "content", QUERY, deep)
    near = R.exact_search(_vectors(spark, d), "mem_id", "embedding", _query_vector(spark, d), deep)
    return R.rrf_fuse([fts, near], k)


_HYBRID = lambda k, deep: f"{_bm25_sql(_LIVE, 'mem_id', 'content', _TERMS, deep)}, {_VEC}, {_NEAR(deep)}, {_RRF(k)}"


@C.add("ret_6", f"WITH {_HYBRID(1000, 200)} SELECT id, round(score, 6) AS score, rank, match_type FROM rrf")
def ret_6(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, 1000, 200).select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "match_type")


@C.add("ret_7", f"WITH {_HYBRID(10, 20)} SELECT id, mem_key, content, round(score, 6) AS score, match_type FROM rrf JOIN memories ON mem_id = id")
def ret_7(spark: SparkSession, d: str) -> DataFrame:
    hits = F.broadcast(_hybrid(spark, d, 10, 20))  # 10 rows
    records = _live(spark, d).select(F.col("mem_id").alias("id"), "mem_key", "content")
    return records.join(hits, "id").select("id", "mem_key", "content", F.round("score", 6).alias("score"), "match_type")


_GQ = ["schema", "index"]


@C.add(
    "ret_8",
    f"""WITH {SQL_GRAPH},
s AS (SELECT id, {' + '.join(f"CASE WHEN contains(lower(label), '{w}') THEN 10.0 WHEN contains(lower(coalesce(description, '')), '{w}') THEN 1.0 ELSE 0.0 END" for w in _GQ)} AS lex FROM nodes),
{_VEC},
t AS (SELECT s.id, lex + 5.0 * coalesce({sql_cos('v.embedding', 'q')}, 0) AS score FROM s CROSS JOIN qv LEFT JOIN vec v ON v.id = s.id WHERE lex > 0 ORDER BY score DESC, s.id LIMIT 20)
SELECT t.id, round(score, 6) AS score, (SELECT count(*) FROM edges WHERE src = t.id OR dst = t.id)::bigint AS incident FROM t""",
)
def ret_8(spark: SparkSession, d: str) -> DataFrame:
    nodes = graph_nodes(spark, d)
    lex = R.graph_lexical(nodes, "schemaIndex")
    vec = _vectors(spark, d).select(F.col("mem_id").alias("id"), "embedding").join(F.broadcast(_query_vector(spark, d)))
    scored = lex.join(vec, "id", "left").select("id", (F.col("score") + 5.0 * F.coalesce(V.cosine("embedding", "q"), F.lit(0.0))).alias("score"))
    top = F.broadcast(R.ranked(scored, 20).select("id", "score"))  # 20 rows
    edges = graph_edges(spark, d, nodes)
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    incident = ends.join(top.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("incident"))
    return top.join(incident, "id", "left").select("id", F.round("score", 6).alias("score"), F.coalesce("incident", F.lit(0)).alias("incident"))


@C.add(
    "ret_9",
    f"""WITH {SQL_GRAPH},
s AS (SELECT id, (CASE WHEN contains(lower(label), 'stale ledger') THEN 50.0 WHEN contains(trim(regexp_replace(lower(label), '[_. -]+', ' ', 'g')), 'stale ledger') THEN 25.0
   WHEN contains(lower(coalesce(description, '')), 'stale ledger') THEN 20.0 WHEN contains(lower(file_path), 'stale ledger') THEN 15.0 ELSE 0.0 END)
   + {' + '.join(f"(CASE WHEN contains(lower(label), '{w}') THEN 8.0 ELSE 0 END + CASE WHEN contains(lower(coalesce(description, '')), '{w}') THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(file_path), '{w}') THEN 2.0 ELSE 0 END + CASE WHEN contains(id::varchar, '{w}') THEN 5.0 ELSE 0 END)" for w in ('stale', 'ledger'))} AS score FROM nodes),
fts AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 100),
{_VEC}, {_NEAR(100)}
SELECT id, round(sum(s), 6) AS score FROM (SELECT id, 1.0::double / (60 + rank - 1) AS s FROM fts UNION ALL SELECT id, 1.0::double / (60 + rank - 1) FROM vs) GROUP BY id ORDER BY sum(s) DESC, id LIMIT 15""",
)
def ret_9(spark: SparkSession, d: str) -> DataFrame:
    scored = graph_nodes(spark, d).select("id", R.project_node_score("stale ledger").alias("score")).filter("score > 0")
    near = R.exact_search(_vectors(spark, d), "mem_id", "embedding", _query_vector(spark, d), 100)
    return R.rrf_fuse([R.ranked(scored, 100), near], 15, base=0).select("id", F.round("score", 6).alias("score"))


_POOL_SQL = f"""WITH {_HYBRID(20, 40)},
c AS (
  SELECT r.id, 0.35 * (r.score / greatest(max(r.score) OVER (), 1e-9)) + 0.25 * coalesce({sql_unit('importance')}, 0.5)
     + 0.1 * exp(-coalesce(greatest(0, floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(updated_at::timestamp))) / 86400.0)), 0) / 90.0)
     + 0.1 * least(1.0, ln(1 + greatest(0, access_count)) / ln(50)) AS score
  FROM rrf r JOIN memories m ON m.mem_id = r.id
)"""


def context_pool(spark: SparkSession, d: str) -> DataFrame:
    pool = F.broadcast(_hybrid(spark, d, 20, 40).select(F.col("id").alias("mem_id"), F.col("score").alias("rrf")))  # 20 rows
    m = _live(spark, d).join(pool, "mem_id")
    rel = F.col("rrf") / F.greatest(F.max("rrf").over(Window.partitionBy()), F.lit(1e-9))
    score = S.context_score(rel, F.coalesce(unit_interval("importance"), F.lit(0.5)), F.lit(0.0), S.recency_decay("updated_at", AS_OF), S.access_saturation("access_count"))
    return m.select(F.col("mem_id").alias("id"), score.alias("score"), "embedding", "content", "category")


@C.add("ret_10", f"{_POOL_SQL} SELECT id, round(score, 6) AS score FROM c")
def ret_10(spark: SparkSession, d: str) -> DataFrame:
    return context_pool(spark, d).select("id", F.round("score", 6).alias("score"))


@C.add(
    "ret_11",
    f"""WITH top AS (SELECT mem_id, content, coalesce({sql_unit('importance')}, 0.5) AS imp FROM memories WHERE deleted_at IS NULL ORDER BY imp DESC, mem_id LIMIT 100)
SELECT mem_id AS id, round(0.6 * imp + 0.4 * ({' + '.join(f"contains(lower(content), '{w}')::int" for w in _TERMS)}) / 2, 6) AS score FROM top ORDER BY score DESC, id LIMIT 10""",
)
def ret_11(spark: SparkSession, d: str) -> DataFrame:
    imp = F.coalesce(unit_interval("importance"), F.lit(0.5))
    top = _live(spark, d).select("mem_id", "content", imp.alias("imp")).orderBy(F.desc("imp"), "mem_id").limit(100)
    score = F.round(0.6 * F.col("imp") + 0.4 * R.word_overlap(F.coalesce("content", F.lit("")), _TERMS), 6)
    return top.select(F.col("mem_id").alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(10)


def _mmr_sql(k: int) -> str:
    """Greedy picks unrolled: pool (id, rel, e)."""
    out = ["sims AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.e IS NULL OR b.e IS NULL THEN 0 ELSE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) END AS s FROM pool a, pool b)"]
    for i in range(1, k + 1):
        done = " UNION ALL ".join(f"SELECT id FROM k{j}" for j in range(1, i)) or "SELECT id FROM pool WHERE false"
        out.append(
            f"k{i} AS MATERIALIZED (SELECT p.id, {i}::bigint AS pick FROM pool p WHERE p.id NOT IN ({done}) "
            f"ORDER BY 0.7 * rel - 0.3 * greatest(-1, coalesce((SELECT max(s) FROM sims WHERE a = p.id AND b IN ({done})), -1)) DESC, rel DESC, p.id LIMIT 1)"
        )
    return ", ".join(out)


@C.add(
    "ret_12",
    f"""{_POOL_SQL}, pool AS (SELECT c.id, c.score / greatest(max(c.score) OVER (), 1e-9) AS rel, CASE WHEN {SQL_USABLE} THEN embedding::double[] END AS e FROM c JOIN memories ON mem_id = c.id),
{_mmr_sql(10)} SELECT '{QUERY}' AS query, id, pick FROM ({' UNION ALL '.join(f'SELECT * FROM k{i}' for i in range(1, 11))})""",
)
def ret_12(spark: SparkSession, d: str) -> DataFrame:
    pool = context_pool(spark, d)
    rel = F.col("score") / F.greatest(F.max("score").over(Window.partitionBy()), F.lit(1e-9))
    vec = F.when(usable("embedding"), F.col("embedding"))
    return R.mmr_select(pool.select(F.lit(QUERY).alias("query"), "id", rel.alias("rel"), vec.alias("vec")), "query", 10)


@C.add(
    "ret_13",
    f"""{_POOL_SQL}, {SQL_GRAPH},
old AS (SELECT DISTINCT dst AS id FROM edges WHERE label = 'supersedes' AND src IN (SELECT id FROM c) AND dst IN (SELECT id FROM c) AND src <> dst)
SELECT id FROM c WHERE (SELECT count(*) FROM old) = (SELECT count(*) FROM c) OR id NOT IN (SELECT id FROM old)""",
)
def ret_13(spark: SparkSession, d: str) -> DataFrame:
    pool = context_pool(spark, d).select("id")
    return J.without_superseded(pool, graph_edges(spark, d))


@C.add(
    "ret_14",
    f"""WITH live AS (SELECT lesson_id, content, confidence, last_reinforced_at, created_at FROM lessons WHERE deleted_at IS NULL AND confidence >= 0.2),
{_bm25_sql('live', 'lesson_id', 'content', ['slot'], None)}
SELECT lesson_id, round(score / max(score) OVER () * confidence * coalesce(1.0 / (1.0 + greatest(0, (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(coalesce(last_reinforced_at, created_at)::timestamp))) / 86400.0) * 0.01), 1.0), 6) AS score
FROM fts JOIN live ON lesson_id = id ORDER BY score DESC, lesson_id LIMIT 10""",
)
def ret_14(spark: SparkSession, d: str) -> DataFrame:
    lessons = live(read(spark, d, "lessons")).filter("confidence >= 0.2")
    hits = R.bm25_search(lessons, "lesson_id", "content", "slot", None).select(F.col("id").alias("lesson_id"), "score")
    best = F.broadcast(hits.agg(F.max("score").alias("best")))  # one row
    scored = hits.join(best).join(lessons, "lesson_id")
    score = F.round(F.col("score") / F.col("best") * F.col("confidence") * S.recency_boost("last_reinforced_at", "created_at", AS_OF), 6)
    return scored.select("lesson_id", score.alias("score")).orderBy(F.desc("score"), "lesson_id").limit(10)


def hits_rank_sql() -> str:
    """Ranks r20 of personalised PageRank from the hits of the hybrid search, weighted by their scores."""
    from memloom.plans.graph_queries import KIND_ARCS, rank_sql

    return f"{SQL_GRAPH}, {_HYBRID(10, 20)}, {rank_sql(20, KIND_ARCS, seeds='rrf', p0='score / sum(score) OVER ()')}"


@C.add("ret_15", lambda: f"WITH {hits_rank_sql()} SELECT id, round(rank, 6) AS score FROM r20 WHERE id NOT IN (SELECT id FROM rrf) ORDER BY rank DESC, id LIMIT 10")
def ret_15(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the hits by personalised PageRank, hits left out."""
    hits = _hybrid(spark, d, 10, 20).select("id", F.col("score").alias("weight"))
    edges = graph_edges(spark, d).select("src", "dst", (S.kind_weight("label") * F.col("weight")).alias("w"))
    ranks = G.pagerank(edges, hits)
    return R.ranked(ranks.join(F.broadcast(hits.select("id")), "id", "left_anti").select("id", F.col("rank").alias("score")), 10).select("id", F.round("score", 6).alias("score"))


@C.add(
    "ret_16",
    """WITH t AS (SELECT DISTINCT content, sha256(content) AS h FROM memories WHERE content IS NOT NULL),
v AS (SELECT content, list_transform(range(0, 64), lambda i: (('0x' || substr(h, ((i % 32) * 2 + 1)::bigint, 2))::int / 255.0::double - 0.5) * sin(i + 1)) AS v FROM t)
SELECT content, round((v[1] / sqrt(list_dot_product(v, v)))::float::double, 4) AS v1, round((v[64] / sqrt(list_dot_product(v, v)))::float::double, 4) AS v64 FROM v""",
)
def ret_16(spark: SparkSession, d: str) -> DataFrame:
    e = R.hash_embedding(read(spark, d, "memories"), "content")
    at = lambda i: F.round(F.element_at("vec", i).cast("double"), 4)
    return e.select("content", at(1).alias("v1"), at(64).alias("v64"))


@C.add("ret_17", "SELECT count(*) AS texts, count(DISTINCT lower(trim(content))) AS to_embed FROM memories WHERE content IS NOT NULL")
def ret_17(spark: SparkSession, d: str) -> DataFrame:
    """How many texts a cache keyed by the trimmed small-letter text saves embedding."""
    m = read(spark, d, "memories").filter("content IS NOT NULL")
    return m.agg(F.count("*").alias("texts"), F.count_distinct(F.lower(F.trim("content"))).alias("to_embed"))


@C.add("ret_18", "SELECT mem_id, length(content) > 0 AS has_text FROM memories WHERE deleted_at IS NULL")
def ret_18(spark: SparkSession, d: str) -> DataFrame:
    """All live memories embedded anew, each different text once."""
    m = _live(spark, d)
    e = R.hash_embedding(m, "content")
    return m.select("mem_id", "content").join(e, "content", "left").select("mem_id", (F.col("vec").isNotNull() & (F.char_length("content") > 0)).alias("has_text"))


@C.add("top_1", f"WITH {_VEC}, {_NEAR(10, 0.2)} SELECT id, round(score, 6) AS score FROM vs")
def top_1(spark: SparkSession, d: str) -> DataFrame:
    return R.exact_search(_vectors(spark, d), "mem_id", "embedding", _query_vector(spark, d), 10, 0.2).select("id", F.round("score", 6).alias("score"))


@C.add("top_2", f"WITH {_VEC} SELECT id, {_HAMMING}::bigint AS bits FROM vec, qv ORDER BY bits, id LIMIT 100")
def top_2(spark: SparkSession, d: str) -> DataFrame:
    q = F.broadcast(_query_vector(spark, d, True).select("q_mask"))  # one row
    near = _vectors(spark, d).select(F.col("mem_id").alias("id"), V.sign_mask("embedding").alias("m")).join(q)
    return near.select("id", V.hamming("m", "q_mask").cast("long").alias("bits")).orderBy("bits", "id").limit(100)


@C.add("agg_13", "SELECT i - 1 AS dim, round(avg(v), 6) AS mean FROM (SELECT unnest(embedding::double[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i")
def agg_13(spark: SparkSession, d: str) -> DataFrame:
    means = R.dimension_means(read(spark, d, "embeddings"), "embedding")
    return means.select(F.posexplode("means").alias("dim", "m")).select(F.col("dim").cast("long").alias("dim"), F.round("m", 6).alias("mean"))


@C.add("agg_20", f"WITH {_HYBRID(20, 40)} SELECT round(sum(score * coalesce({sql_unit('trust')}, 0.5)) / sum(score), 6) AS confidence FROM rrf JOIN memories ON mem_id = id")
def agg_20(spark: SparkSession, d: str) -> DataFrame:
    hits = F.broadcast(_hybrid(spark, d, 20, 40).select(F.col("id").alias("mem_id"), "score"))  # 20 rows
    trust = F.coalesce(unit_interval("trust"), F.lit(0.5))
    return _live(spark, d).join(hits, "mem_id").agg(F.round(S.weighted_confidence(F.col("score"), trust), 6).alias("confidence"))


@C.add("win_3", f"WITH {_bm25_sql(_LIVE, 'mem_id', 'content', ['ledger'], None)} SELECT id, rank FROM fts")
def win_3(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_search(_live(spark, d), "mem_id", "content", "ledger", None).select("id", F.col("rank").cast("long").alias("rank"))
