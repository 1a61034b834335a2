"""Queries of the column expressions, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import scoring as S
from memloom.functions import text as X
from memloom.functions import vectors as V
from memloom.functions.keys import has_value, trimmed, unit_interval
from memloom.operators.codegraph import manifest_hash, node_type_of_id, package_of_module
from memloom.operators.lifecycle import merge_meta_existing, merge_meta_incoming
from memloom.plans.base import AS_OF, SQL_GRAPH, WS, Catalog, read, sql_cos, sql_trim, sql_unit, sql_value, graph_edges, graph_nodes

C = Catalog()
QUERIES, ORACLES = C.QUERIES, C.ORACLES

_CONTENT = sql_trim("content")


@C.add("fn_1", f"SELECT mem_id, 'm_' || substr(sha256({_CONTENT}), 1, 12) AS gen_key FROM memories")
def fn_1(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "memories").select("mem_id", X.memory_key("content").alias("gen_key"))


@C.add("fn_2", f"WITH {SQL_GRAPH} SELECT id, substr(sha256(label || '|' || node_type), 1, 24) AS node_id FROM nodes")
def fn_2(spark: SparkSession, d: str) -> DataFrame:
    return graph_nodes(spark, d).select("id", X.node_key("label", "node_type").alias("node_id"))


@C.add("fn_3", f"SELECT lesson_id, 'lsn_' || substr(sha256(lower({_CONTENT})), 1, 16) AS fingerprint FROM lessons")
def fn_3(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lessons").select("lesson_id", X.lesson_fingerprint("content").alias("fingerprint"))


_DECOMPOSED = lambda c: rf"trim(regexp_replace(lower(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[_. -]+', ' ', 'g'))"


@C.add("fn_4", f"SELECT doc_id, {_DECOMPOSED('path')} AS path_parts, {_DECOMPOSED('title')} AS title_parts FROM documents")
def fn_4(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", X.decompose_identifier("path").alias("path_parts"), X.decompose_identifier("title").alias("title_parts"))


@C.add(
    "fn_5",
    r"""SELECT mem_id, list_aggregate(list_filter(list_transform(string_split_regex(trim(regexp_replace(replace(lower(content), 'ё', 'е'), '[^\p{L}\p{N}_-]+', ' ', 'g')), ' +'),
       lambda t: regexp_replace(t, '[_-]', '', 'g')), lambda t: length(t) > 1), 'string_agg', ' ') AS entity FROM memories""",
)
def fn_5(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "memories").select("mem_id", F.nullif(X.normalize_entity("content"), F.lit("")).alias("entity"))


_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?…])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: trim(s, {WS})), lambda s: s <> '')"


@C.add("fn_6", f"SELECT doc_id, len(s)::bigint AS n, s[1] AS first, s[-1] AS last, list_sum(list_transform(s, lambda x: length(x)))::bigint AS chars FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL)")
def fn_6(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.split_sentences("text").alias("s"))
    chars = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    return s.select(
        "doc_id", F.size("s").cast("long").alias("n"), F.try_element_at("s", F.lit(1)).alias("first"), F.try_element_at("s", F.lit(-1)).alias("last"),
        F.when(F.size("s") > 0, chars).alias("chars"),
    )


_CHUNKS = f"""
WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, flatten(list_transform(s, lambda x: list_transform(range(0, ((length(x) - 1) // 3000 + 1)::bigint), lambda i: substr(x, i * 3000 + 1, 3000)))) AS p FROM s),
f AS (
  SELECT doc_id, list_reduce(list_transform(p, lambda x: {{'chunks': []::varchar[], 'cur': x}}), lambda a, x: CASE WHEN length(a.cur || ' ' || x.cur) > 3000
    THEN {{'chunks': list_append(a.chunks, a.cur), 'cur': right(a.cur, 300) || ' ' || x.cur}} ELSE {{'chunks': a.chunks, 'cur': a.cur || ' ' || x.cur}} END) AS f
  FROM p WHERE len(p) > 0
),
chunks AS (SELECT doc_id, unnest(list_append(f.chunks, f.cur)) AS chunk, generate_subscripts(list_append(f.chunks, f.cur), 1) - 1 AS ordinal FROM f)"""


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(X.split_into_chunks("text")).alias("ordinal", "chunk")).withColumn("ordinal", F.col("ordinal").cast("long"))


@C.add("fn_7", f"{_CHUNKS} SELECT doc_id, ordinal, length(chunk) AS chars, substr(sha256(chunk), 1, 16) AS digest FROM chunks")
def fn_7(spark: SparkSession, d: str) -> DataFrame:
    return document_chunks(spark, d).select("doc_id", "ordinal", F.char_length("chunk").cast("long").alias("chars"), F.substring(F.sha2("chunk", 256), 1, 16).alias("digest"))


@C.add(
    "fn_8",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, l, unnest(range(0, greatest(0, ceil((len(l) - 40) / 30.0))::bigint + 1)) AS i FROM l)
SELECT doc_id, i AS ordinal, substr(sha256(array_to_string(l[i * 30 + 1 : i * 30 + 40], chr(10))), 1, 16) AS digest FROM w""",
)
def fn_8(spark: SparkSession, d: str) -> DataFrame:
    chunks = read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(X.fixed_window_chunks("text", 40, 10)).alias("ordinal", "chunk"))
    return chunks.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.substring(F.sha2("chunk", 256), 1, 16).alias("digest"))


@C.add(
    "fn_9",
    """WITH d AS (SELECT doc_id, '// ' || path || CASE WHEN coalesce(title, '') <> '' THEN ' :: ' || title ELSE '' END AS head, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND path IS NOT NULL),
r AS (SELECT doc_id, head, l, list_transform(range(1, len(l) + 1), lambda i: length(head || chr(10) || array_to_string(l[1:i], chr(10))) <= 1500) AS ok FROM d)
SELECT doc_id, CASE WHEN ok[1] THEN head || chr(10) || array_to_string(l[1:len(list_filter(ok, lambda x: x))], chr(10)) ELSE head END AS chunk FROM r""",
)
def fn_9(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("text IS NOT NULL AND path IS NOT NULL")
    return docs.select("doc_id", X.scoped_chunk("path", F.coalesce("title", F.lit("")), "text").alias("chunk"))


# token by token: what stands at odd places is white space or the other way round, so the word before is two places back
_MASKED = r"""CASE WHEN NOT regexp_full_match(x, '\S+') THEN x
WHEN i > 2 AND lower(t[i - 2]) = 'bearer' AND NOT coalesce(i > 4 AND lower(t[i - 4]) = 'bearer' AND lower(x) <> 'bearer', false) THEN '[REDACTED:bearer]'
WHEN starts_with(x, 'sk-') AND length(regexp_replace(substr(x, 4), '[^\p{L}\p{N}_-]', '', 'g')) >= 16 THEN '[REDACTED:sk-key]'
WHEN regexp_matches(x, '^gh[posu]_') AND length(regexp_replace(substr(x, 5), '[^\p{L}\p{N}]', '', 'g')) >= 20 THEN '[REDACTED:gh-token]'
WHEN regexp_matches(x, '^\S*?://[^\s/@]*:[^\s/@]*@') THEN regexp_replace(x, '^(\S*?://)[^\s/@]*(@\S*)', '\1[REDACTED]\2')
WHEN regexp_matches(x, '^(api\.key|vault\.token)[=:]') THEN regexp_replace(x, '^(api\.key|vault\.token)([=:]).*$', '\1\2[REDACTED:vault]')
WHEN NOT contains(x, '://') AND regexp_matches(x, '(?i)^([^\s=]*_)?(key|token|secret|password|passwd)=') THEN regexp_replace(x, '(?i)^((?:[^\s=]*_)?(?:key|token|secret|password|passwd))=.*$', '\1=[REDACTED]')
ELSE x END"""


@C.add("fn_10", f"SELECT doc_id, array_to_string(list_transform(t, lambda x, i: {_MASKED}), '') AS masked FROM (SELECT doc_id, regexp_extract_all(text, '\\S+|\\s+') AS t FROM documents)")
def fn_10(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", X.mask_secrets("text", ["api.key", "vault.token"]).alias("masked"))


_TS = f"TIMESTAMP '{AS_OF}'"
_SECONDS = lambda c: f"epoch({_TS}) - floor(epoch({c}::timestamp))"


@C.add("fn_11", f"SELECT lesson_id, round(coalesce(1.0 / (1.0 + greatest(0, ({_SECONDS('coalesce(last_reinforced_at, created_at)')}) / 86400.0) * 0.01), 1.0), 6) AS boost FROM lessons")
def fn_11(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lessons").select("lesson_id", F.round(S.recency_boost("last_reinforced_at", "created_at", AS_OF), 6).alias("boost"))


@C.add("fn_12", f"SELECT mem_id, round(exp(-coalesce(greatest(0, floor(({_SECONDS('updated_at')}) / 86400.0)), 0) / 90.0), 6) AS recency FROM memories")
def fn_12(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "memories").select("mem_id", F.round(S.recency_decay("updated_at", AS_OF), 6).alias("recency"))


@C.add("fn_13", "SELECT mem_id, round(least(1.0, ln(1 + greatest(0, access_count)) / ln(50)), 6) AS saturation FROM memories")
def fn_13(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "memories").select("mem_id", F.round(S.access_saturation("access_count"), 6).alias("saturation"))


@C.add("fn_14", f"SELECT vec_id, round({sql_cos('embedding', 'q')}, 6) AS cos FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)")
def fn_14(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    q = F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    return e.join(q).select("vec_id", F.round(V.cosine("embedding", "q"), 6).alias("cos"))


@C.add(
    "fn_15",
    """WITH s AS (SELECT vec_id, embedding::double[] AS v, list_max(list_transform(embedding::double[], lambda x: abs(x))) AS top FROM embeddings)
SELECT vec_id, round(CASE WHEN top > 0 THEN top / 127.0 ELSE 1.0 END, 6) AS scale,
       list_sum(list_transform(v, lambda x: greatest(-127, least(127, round(x / (CASE WHEN top > 0 THEN top / 127.0 ELSE 1.0 END))))))::bigint AS q_sum FROM s""",
)
def fn_15(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "embeddings").select("vec_id", V.int8_quantize("embedding").alias("s"))
    return q.select("vec_id", F.round(F.col("s.scale").cast("double"), 6).alias("scale"), F.aggregate("s.q", F.lit(0).cast("long"), lambda a, x: a + x).alias("q_sum"))


_BITS = lambda test: f"list_sum(list_transform(range(0, 64), lambda i: CASE WHEN {test} THEN 1::hugeint << i::int ELSE 0 END))"
_SIGNED = lambda x: f"(CASE WHEN {x} >= 9223372036854775808 THEN {x} - 18446744073709551616 ELSE {x} END)::bigint"


@C.add(
    "fn_16",
    f"""WITH m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(v) AS a FROM (SELECT unnest(embedding::double[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)),
b AS (SELECT vec_id, {_BITS('(embedding::double[])[i + 1] > m[i + 1]')}::hugeint AS x FROM embeddings, m)
SELECT vec_id, {_SIGNED('x')} AS mask FROM b""",
)
def fn_16(spark: SparkSession, d: str) -> DataFrame:
    from memloom.operators.search import dimension_means

    e = read(spark, d, "embeddings")
    means = F.broadcast(dimension_means(e, "embedding"))  # one row
    return e.join(means).select("vec_id", F.element_at(V.centred_mask("embedding", F.col("means")), 1).alias("mask"))


@C.add("fn_17", f"WITH b AS (SELECT vec_id, {_BITS('embedding[i + 1] > 0')}::hugeint AS x FROM embeddings) SELECT vec_id, {_SIGNED('x')} AS mask FROM b")
def fn_17(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.element_at(V.sign_mask("embedding"), 1).alias("mask"))


@C.add(
    "fn_18",
    """SELECT e.vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (e.embedding[i] > 0) <> (q.embedding[i] > 0) THEN 1 ELSE 0 END))::bigint AS bits
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q""",
)
def fn_18(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", V.sign_mask("embedding").alias("m"))
    q = F.broadcast(e.filter("vec_id = 0").select(F.col("m").alias("q")))  # one row
    return e.join(q).select("vec_id", V.hamming("m", "q").cast("long").alias("bits"))


_KEY_TOKENS = lambda c: f"list_filter(list_distinct(string_split_regex(lower({c}), '[-/_]+')), lambda x: x <> '')"


@C.add(
    "fn_19",
    f"""WITH t AS (SELECT pair_id, {_KEY_TOKENS('a_key')} AS a, {_KEY_TOKENS('b_key')} AS b FROM guess_pairs WHERE a_key IS NOT NULL AND b_key IS NOT NULL)
SELECT pair_id, round(CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b)) ELSE 0 END, 6) AS jaccard FROM t""",
)
def fn_19(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "guess_pairs").filter("a_key IS NOT NULL AND b_key IS NOT NULL")
    return p.select("pair_id", F.round(V.jaccard(V.key_tokens("a_key"), V.key_tokens("b_key")), 6).alias("jaccard"))


@C.add("fn_20", "SELECT doc_id, greatest(1, length(text) // 3)::bigint AS tokens FROM documents WHERE text IS NOT NULL")
def fn_20(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.estimate_tokens("text").alias("tokens"))


@C.add("fn_21", "SELECT doc_id, rtrim(lower('/Api/' || regexp_replace(path, '[0-9]+', ':param', 'g')), '/') AS api_path FROM documents WHERE path IS NOT NULL")
def fn_21(spark: SparkSession, d: str) -> DataFrame:
    """Paths of documents as API paths, with numbers as parameters."""
    path = F.concat(F.lit("/Api/"), F.regexp_replace("path", "[0-9]+", "{n}"), F.lit("/"))
    return read(spark, d, "documents").filter("path IS NOT NULL").select("doc_id", X.normalize_api_path(path).alias("api_path"))


_ENV = "list_sort(list_distinct(list_filter([" + ", ".join(
    f"CASE WHEN list_contains(w, '{w}') THEN '{t}' END" for w, t in (("prod", "prod"), ("production", "prod"), ("dev", "dev"), ("development", "dev"), ("staging", "staging"), ("local", "local"), ("vps", "vps"), ("windows", "windows"), ("linux", "linux"), ("macos", "macos"))
) + "], lambda x: x IS NOT NULL)))"
_ENTITIES = r"list_sort(list_distinct(list_transform(list_filter(string_split_regex(content, '[\s,;:()\x22'']+'), lambda t: strlen(t) >= 2 AND (regexp_matches(t, '\p{Lu}') OR regexp_matches(t, '[/_.]'))), lambda t: lower(t))))"


@C.add(
    "fn_22",
    rf"""WITH t AS (SELECT mem_id, content, string_split_regex(lower(content), '[^\p{{L}}\p{{N}}]+') AS w FROM memories)
SELECT mem_id, array_to_string({_ENV}, ' ') AS envs, array_to_string(regexp_extract_all(content, '[0-9]+'), ' ') AS numbers, array_to_string({_ENTITIES}, ' ') AS entities FROM t""",
)
def fn_22(spark: SparkSession, d: str) -> DataFrame:
    joined = lambda c: F.array_join(c, " ")
    return read(spark, d, "memories").select(
        "mem_id", joined(X.mentioned_environments("content")).alias("envs"), joined(X.numbers_in("content")).alias("numbers"), joined(X.named_entities("content")).alias("entities")
    )


@C.add(
    "fn_23",
    """WITH m AS (SELECT mem_id, CASE WHEN json_valid(meta) THEN meta END AS m FROM memories),
p AS (SELECT mem_id, json_extract_string(m, '$.author') AS author, json_extract_string(m, '$.session_id') AS session FROM m)
SELECT mem_id, coalesce(author, 'incoming') AS author_kept, 'incoming' AS author_taken, session FROM p""",
)
def fn_23(spark: SparkSession, d: str) -> DataFrame:
    incoming = F.lit('{"author": "incoming"}')
    field = lambda c, f: F.try_variant_get(F.try_parse_json(c), f"$.{f}", "string")
    kept, taken = merge_meta_existing("meta", incoming), merge_meta_incoming("meta", incoming)
    return read(spark, d, "memories").select(
        "mem_id", field(kept, "author").alias("author_kept"), field(taken, "author").alias("author_taken"), field(kept, "session_id").alias("session")
    )


@C.add("fn_24", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS short FROM documents")
def fn_24(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", X.trim_chars("text", 80).alias("short"))


@C.add("fn_25", "SELECT mem_id, CASE WHEN json_valid(meta) THEN trim(meta) END AS json FROM memories")
def fn_25(spark: SparkSession, d: str) -> DataFrame:
    from memloom.operators.extraction import first_json_value

    prose = F.concat(F.lit("Here it is:\n```json\n"), F.coalesce("meta", F.lit("")), F.lit("\n```\nand that is all {"))
    return read(spark, d, "memories").select("mem_id", first_json_value(prose).alias("json"))


@C.add(
    "fn_26",
    """WITH p AS (SELECT doc_id, path, split_part(path, '/', 1) AS top FROM documents WHERE path IS NOT NULL)
SELECT doc_id, CASE WHEN top = '' THEN NULL ELSE 'pkg:npm:' || top END AS package, 'File' AS node_type, path AS label FROM p""",
)
def fn_26(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("path IS NOT NULL")
    kind = node_type_of_id(F.concat(F.lit("file:"), F.col("path")))
    return docs.select("doc_id", package_of_module(F.lit("ts-js"), F.col("path")).alias("package"), kind["node_type"].alias("node_type"), kind["label"].alias("label"))


@C.add("fn_27", r"SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM documents")
def fn_27(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", X.normalize_spaces("text").alias("norm"))


@C.add("fn_28", f"SELECT mem_id, round(({sql_unit('trust')}) * 1000) / 1000 AS trust3, round(({sql_unit('importance')}) * 1000) / 1000 AS importance3 FROM memories")
def fn_28(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "memories").select("mem_id", S.round3(unit_interval("trust")).alias("trust3"), S.round3(unit_interval("importance")).alias("importance3"))


@C.add("fn_29", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def fn_29(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", manifest_hash("text").alias("digest"))


_INDEG = "deg AS (SELECT dst, count(*) AS indeg FROM edges GROUP BY dst)"


@C.add(
    "fn_30",
    f"""WITH {SQL_GRAPH}, {_INDEG}, n AS (SELECT count(*) AS n FROM nodes)
SELECT id, round(greatest(0.5, ln(1 + n.n / (1.0 + coalesce(indeg, 0)))) * (0.1 + 0.9 * trust), 6) AS seed FROM nodes CROSS JOIN n LEFT JOIN deg ON dst = id""",
)
def fn_30(spark: SparkSession, d: str) -> DataFrame:
    nodes = graph_nodes(spark, d)
    indeg = graph_edges(spark, d, nodes).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("indeg"))
    n = F.broadcast(nodes.agg(F.count("*").alias("n")))  # one row
    joined = nodes.join(indeg, "id", "left").join(n)
    return joined.select("id", F.round(S.seed_weight(F.col("n"), F.coalesce("indeg", F.lit(0)), "trust"), 6).alias("seed"))


@C.add(
    "fn_31",
    f"""WITH {SQL_GRAPH}, {_INDEG}
SELECT src, e.dst, e.label, round(greatest(1e-9, e.weight / greatest(1, ln(1 + indeg)) * least(3, 1 + ln(1 + access_count) * CASE WHEN access_count < 4 THEN 0.25 ELSE 0.5 END)
  * exp(-(CASE WHEN access_count < 4 THEN 0 ELSE 0.015 END) * greatest(0, ({_SECONDS('updated_at')}) / 86400.0)) * (0.1 + 0.9 * trust)), 6) AS w
FROM edges e JOIN deg ON deg.dst = e.dst JOIN nodes ON nodes.id = e.dst WHERE e.weight > 0""",
)
def fn_31(spark: SparkSession, d: str) -> DataFrame:
    nodes = graph_nodes(spark, d)
    edges = graph_edges(spark, d, nodes).filter("weight > 0")
    indeg = graph_edges(spark, d, nodes).groupBy("dst").agg(F.count("*").alias("indeg"))
    target = nodes.select(F.col("id").alias("dst"), "access_count", "trust", "updated_at")
    age = (F.unix_seconds(F.lit(AS_OF).cast("timestamp")) - F.unix_seconds("updated_at")) / 86400.0
    w = S.usage_edge_weight(F.col("weight"), F.col("indeg"), F.col("access_count"), F.lit(False), age, F.col("trust"))
    return edges.join(indeg, "dst").join(target, "dst").select("src", "dst", "label", F.round(w, 6).alias("w"))


@C.add(
    "fn_32",
    f"""WITH x AS (SELECT lower({sql_trim('category')}) AS category, sum((deleted_at IS NULL)::int) AS tp, sum((deleted_at IS NOT NULL)::int) AS fp FROM memories WHERE {sql_value('category')} GROUP BY 1)
SELECT category, round(2.0 * tp / (2 * tp + fp), 6) AS f1 FROM x""",
)
def fn_32(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "memories").filter(has_value("category")).groupBy(F.lower(trimmed("category")).alias("category"))
    x = m.agg(F.sum(F.col("deleted_at").isNull().cast("int")).alias("tp"), F.sum(F.col("deleted_at").isNotNull().cast("int")).alias("fp"))
    return x.select("category", F.round(S.f1(F.col("tp"), F.col("fp"), F.lit(0)), 6).alias("f1"))




@C.add("udf_1", f"SELECT mem_id, 'm_' || substr(sha256(trim(content)), 1, 12) AS k, greatest(1, length(content) // 3)::bigint AS tokens, round(least(1.0, ln(1 + greatest(0, access_count)) / ln(50)), 6) AS saturation FROM memories")
def udf_1(spark: SparkSession, d: str) -> DataFrame:
    """Expressions called from SQL."""
    from memloom.functions.register import register_functions

    register_functions(spark)
    return read(spark, d, "memories").selectExpr("mem_id", "memory_key(content) AS k", "estimate_tokens(content) AS tokens", "round(access_saturation(access_count), 6) AS saturation")
