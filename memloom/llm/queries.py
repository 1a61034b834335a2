"""Queries of the training-text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.keys import NO_VALUE_WORDS, WHITE_SPACE
from memloom.llm.components import connected_components, pair_edges
from memloom.llm.mixing import mix_sources, usual_spelling
from memloom.llm.neardup import duplicate_groups, duplicate_pairs, near_duplicates
from memloom.llm.neighbours import most_similar, neighbour_pairs
from memloom.llm.packing import pack_documents, pack_fill, pack_list
from memloom.llm.pii import KINDS, find_mentions, lexicon_of, redact
from memloom.llm.spans import shared_passages, shared_share, sharing_pairs
from memloom.llm.survivors import choose_survivors, memory_fields, survivor_fields, vote_survivors


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = pair_edges(_read(spark, sf_dir, "guess_pairs"))
    return connected_components(edges, "a_key", "b_key", node="mem_key", component="group_key")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = lexicon_of(_read(spark, sf_dir, "roster"))
    log = find_mentions(_read(spark, sf_dir, "daily_log"), "entry_id", ["user_text", "assistant_text"], lexicon)
    memories = find_mentions(_read(spark, sf_dir, "memories"), "mem_id", ["content"], lexicon)
    both = log.select(F.lit("daily_log").alias("table_name"), "*").unionByName(memories.select(F.lit("memories").alias("table_name"), "*"))
    return both.filter(F.col("kind").isin(*KINDS)).select("table_name", "row_id", "field_name", "kind", "start_at")


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = lexicon_of(_read(spark, sf_dir, "roster"))
    log = redact(_read(spark, sf_dir, "daily_log"), ["user_text", "assistant_text"], lexicon)
    memories = redact(_read(spark, sf_dir, "memories"), ["content"], lexicon)
    return log.select(F.lit("daily_log").alias("table_name"), F.col("entry_id").alias("row_id"), "user_text", "assistant_text", F.lit(None).cast("string").alias("content")).unionByName(
        memories.select(F.lit("memories").alias("table_name"), F.col("mem_id").alias("row_id"), F.lit(None).cast("string").alias("user_text"), F.lit(None).cast("string").alias("assistant_text"), "content")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    survivors = choose_survivors(_read(spark, sf_dir, "memories"), _groups(spark, sf_dir))
    return survivor_fields(survivors, list(memory_fields())).select("group_key", "field_name", "from_key")


def p2_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote_survivors(_read(spark, sf_dir, "memories"), _groups(spark, sf_dir), as_of="2026-12-31 00:00:00")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "memories").filter("deleted_at IS NULL")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbour_pairs(most_similar(_live(spark, sf_dir), "mem_id", "embedding"))
    return pairs.selectExpr("a AS mem_id_a", "b AS mem_id_b")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_pairs(*near_duplicates(_live(spark, sf_dir), "mem_id", "content")).selectExpr("a AS mem_id_a", "b AS mem_id_b")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(*near_duplicates(_live(spark, sf_dir), "mem_id", "content")).withColumnRenamed("id", "mem_id")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = pack_list(_read(spark, sf_dir, "pack_sizes"))
    return pack_documents(_read(spark, sf_dir, "documents"), "doc_id", "text", packs).withColumnRenamed("doc", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_fill(p7_packed(spark, sf_dir), _read(spark, sf_dir, "pack_sizes"))


def _mixed(spark: SparkSession, sf_dir: str, **kw) -> tuple[DataFrame, DataFrame]:
    source = usual_spelling("source")
    # the last word of a source's name says what kind of text it is: its domain
    levels = {"domain": F.regexp_extract(source, "([^_]*)$", 1), "lang": usual_spelling("lang"), "source": source}
    return mix_sources(_read(spark, sf_dir, "documents"), "doc_id", "text", levels, _read(spark, sf_dir, "mix_targets"), **kw)


def p8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0].withColumnRenamed("doc", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_shares_when_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares where a mix must be as large as its sources are together, which small ones can't keep up with even if repeated."""
    return _mixed(spark, sf_dir, total_tokens="listed")[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sharing_pairs(shared_passages(_read(spark, sf_dir, "documents"), "doc_id", "text"))
    return pairs.selectExpr("a AS doc_id_a", "b AS doc_id_b")


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_share(_read(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


_WS = "'" + WHITE_SPACE + "'"
_TREE = f"""
pairs AS (
  SELECT DISTINCT trim(a_key, {_WS}) AS a, trim(b_key, {_WS}) AS b FROM guess_pairs
  WHERE cos >= 0.75 AND NOT isnan(cos) AND trim(a_key, {_WS}) <> '' AND trim(b_key, {_WS}) <> '' AND trim(a_key, {_WS}) <> trim(b_key, {_WS})
),
arcs AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(node, root) AS (
  SELECT DISTINCT a, a FROM arcs
  UNION
  SELECT arcs.b, reach.root FROM reach JOIN arcs ON arcs.a = reach.node WHERE reach.root < arcs.b
),
groups AS (SELECT node AS mem_key, min(root) AS group_key FROM reach GROUP BY node)"""
_VALUE = lambda c: f"(trim({c}, {_WS}) <> '' AND lower(trim({c}, {_WS})) NOT IN ({', '.join(repr(w) for w in NO_VALUE_WORDS)}))"
_UNIT = lambda c: f"CASE WHEN NOT isnan({c}) AND {c} BETWEEN 0 AND 1 THEN {c} ELSE -1 END"
_RANK = f"{_UNIT('trust')} DESC, {_UNIT('importance')} DESC, updated_at DESC NULLS LAST, mem_key"
_PICK = lambda name, order, where: (
    f"SELECT group_key, '{name}' AS field_name, mem_key AS from_key FROM members WHERE n >= 2 AND {where} "
    f"QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY {order}{_RANK}) = 1"
)

_VOTED = ("canonical", "content", "category", "source", "project_id")

QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_votes": p2_votes, "p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found, "p6_groups": p6_groups, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_mixed": p8_mixed, "p8_shares": p8_shares, "p8_shares_when_short": p8_shares_when_short, "p9_found": p9_found, "p9_share": p9_share}
ORACLES = {
    "p3_found": f"WITH RECURSIVE {_TREE} SELECT mem_key, group_key FROM groups",
    "p2_found": f"""WITH RECURSIVE {_TREE},
members AS (
  SELECT m.*, g.group_key, count(*) OVER (PARTITION BY g.group_key) AS n FROM memories m JOIN groups g USING (mem_key) WHERE m.deleted_at IS NULL
)
{_PICK('canonical', '', 'true')} UNION ALL {_PICK('content', 'length(content) DESC, ', _VALUE('content'))}
UNION ALL {_PICK('source', '', _VALUE('source'))} UNION ALL {_PICK('project_id', 'updated_at DESC NULLS LAST, ', _VALUE('project_id'))}""",
    "p5_found": f"""
WITH v AS (SELECT mem_id, embedding::double[] AS e FROM memories WHERE deleted_at IS NULL AND embedding IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT mem_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
p AS (SELECT a.mem_id AS a, b.mem_id AS b, round(list_dot_product(a.e, b.e) / (a.n * b.n), 9) AS cos FROM n a JOIN n b ON a.mem_id < b.mem_id WHERE cos >= 0.8),
near AS (SELECT x, y FROM (SELECT a AS x, b AS y, cos FROM p UNION ALL SELECT b, a, cos FROM p) QUALIFY row_number() OVER (PARTITION BY x ORDER BY cos DESC, y) <= 5)
SELECT DISTINCT least(x, y) AS mem_id_a, greatest(x, y) AS mem_id_b FROM near""",
    "p6_found": r"""
WITH w AS (SELECT mem_id, list_distinct(list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM memories WHERE deleted_at IS NULL AND content IS NOT NULL),
s AS (SELECT mem_id, w, len(w) AS n FROM w WHERE len(w) >= 12),
p AS (SELECT a.mem_id AS a, b.mem_id AS b, a.n + b.n AS total, len(list_intersect(a.w, b.w)) AS shared FROM s a JOIN s b ON a.mem_id < b.mem_id AND 10 * a.n >= 6 * b.n AND 10 * b.n >= 6 * a.n)
SELECT a AS mem_id_a, b AS mem_id_b FROM p WHERE 5 * shared >= 3 * (total - shared)""",
    "p9_found": """
WITH s AS (SELECT DISTINCT doc_id, substr(text, i, 120) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 118)) AS i FROM documents WHERE length(text) >= 120)),
r AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1),
d AS (SELECT doc_id, md5_number(s) AS k FROM s SEMI JOIN r USING (s))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.k = b.k AND a.doc_id < b.doc_id""",
    "p2_votes": f"""WITH RECURSIVE {_TREE},
members AS (
  SELECT m.*, g.group_key, CASE WHEN NOT isnan(trust) AND trust BETWEEN 0 AND 1 THEN trust ELSE 0.5 END
    * pow(0.5, coalesce(greatest(0, (epoch(TIMESTAMP '2026-12-31') - floor(epoch(updated_at))) / 86400.0), 3650.0) / 90.0) AS w,
    row_number() OVER (ORDER BY {_RANK}) AS place
  FROM memories m JOIN groups g USING (mem_key) WHERE m.deleted_at IS NULL
),
long AS ({' UNION ALL '.join(f"SELECT group_key, '{c}' AS f, {'mem_key' if c == 'canonical' else c} AS v, w, place FROM members WHERE {'true' if c == 'canonical' else _VALUE(c)}" for c in _VOTED)}),
votes AS (SELECT group_key, f, lower(trim(v, {_WS})) AS norm, round(sum(w), 9) AS votes, arg_min(v, place) AS v, min(place) AS place FROM long GROUP BY ALL),
won AS (SELECT group_key, f, arg_min(v, (-votes, place)) AS v FROM votes GROUP BY ALL)
SELECT group_key, {', '.join(f"max(v) FILTER (f = '{c}') AS {c}" for c in _VOTED)} FROM won GROUP BY group_key""",
    "p6_groups": r"""
WITH RECURSIVE w AS (SELECT mem_id, list_sort(list_distinct(list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS w FROM memories WHERE deleted_at IS NULL AND content IS NOT NULL),
s AS (SELECT mem_id, w, len(w) AS n, min(mem_id) OVER (PARTITION BY w) AS rep FROM w WHERE len(w) >= 12),
c AS (SELECT * FROM s WHERE mem_id = rep),
p AS (SELECT a.rep AS a, b.rep AS b, a.n + b.n AS total, len(list_intersect(a.w, b.w)) AS shared FROM c a JOIN c b ON a.rep < b.rep AND 10 * a.n >= 6 * b.n AND 10 * b.n >= 6 * a.n),
e AS (SELECT a, b FROM p WHERE 5 * shared >= 3 * (total - shared)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(x, root) AS (SELECT DISTINCT a, a FROM ways UNION SELECT b, root FROM reach JOIN ways ON a = x WHERE root < b),
g AS (SELECT x, min(root) AS group_id FROM reach GROUP BY x)
SELECT s.mem_id, rep, coalesce(group_id, rep) AS group_id, (SELECT count(*) FROM ways WHERE a = rep) AS links FROM s LEFT JOIN g ON x = rep""",
    "p9_share": """
WITH s AS (SELECT doc_id, i, md5_number(substr(text, i, 120)) AS k FROM (SELECT doc_id, text, unnest(range(1, length(text) - 118)) AS i FROM documents WHERE length(text) >= 120)),
r AS (SELECT k FROM s GROUP BY k HAVING min(doc_id) <> max(doc_id)),
d AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM s SEMI JOIN r USING (k)),
n AS (SELECT doc_id, sum(CASE WHEN gap IS NULL OR gap > 120 THEN 120 ELSE gap END)::bigint AS shared_chars, count(*) FILTER (gap IS NULL OR gap > 120) AS passages FROM d GROUP BY doc_id)
SELECT doc_id, coalesce(length(text), 0)::bigint AS n_chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(passages, 0) AS passages,
  CASE WHEN length(text) > 0 THEN round(coalesce(shared_chars, 0) / length(text), 6) ELSE 0 END AS shared_share FROM documents LEFT JOIN n USING (doc_id)""",
}
