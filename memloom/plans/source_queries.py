"""Queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import sessions as T
from memloom.plans.base import Catalog, read
from memloom.session import materialize, scratch_folder
from memloom.sources import readers, writers
from memloom.streaming import sessions as ST

C = Catalog()
QUERIES, ORACLES = C.QUERIES, C.ORACLES


@C.add("src_1", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def src_1(spark: SparkSession, d: str) -> DataFrame:
    """Every other text as windows-1251 bytes if it can be, decoded again."""
    docs = read(spark, d, "documents").filter("text IS NOT NULL")
    cyrillic = (F.col("doc_id") % 2 == 0) & F.col("text").rlike(r"^[\x00-\x7FА-Яа-яЁё]*[А-Яа-я][\x00-\x7FА-Яа-яЁё]*$")

    @F.pandas_udf("binary")
    def encoded(texts):
        return texts.map(lambda t: t.encode("cp1251") if t is not None else None)

    raw = F.when(cyrillic, encoded(F.when(cyrillic, F.col("text")))).otherwise(F.encode("text", "utf-8"))
    return docs.select("doc_id", readers.decoded(raw).alias("text"))


@C.add(
    "src_2",
    """WITH t AS (SELECT lower(lang) AS lang, doc_id, title FROM documents WHERE title IS NOT NULL AND lang IS NOT NULL)
SELECT lang, 'txt' AS format, sum(strlen(title) + 1)::bigint AS size_bytes, sha256(string_agg(title || chr(10), '' ORDER BY doc_id)) AS digest FROM t GROUP BY lang""",
)
def src_2(spark: SparkSession, d: str) -> DataFrame:
    """Titles as one text file per language, read back with name, format and size."""
    folder = scratch_folder(spark, "titles")
    titles = read(spark, d, "documents").filter("title IS NOT NULL AND lang IS NOT NULL").select(F.lower("lang").alias("l"), "doc_id", "title")
    titles.repartition("l").sortWithinPartitions("l", "doc_id").select("l", "title").write.partitionBy("l").text(folder)
    files = readers.read_texts(spark, folder, glob="*.txt")
    lang = F.regexp_extract("path", "/l=([^/]*)/", 1)
    return files.select(lang.alias("lang"), "format", "size_bytes", F.sha2("text", 256).alias("digest"))


def _log_days(spark: SparkSession, d: str) -> str:
    """The log as a folder of days, lines in order."""
    folder = scratch_folder(spark, "days")
    log = read(spark, d, "daily_log").filter("logged_at <> ''").withColumn("day", F.regexp_extract("log_file", r"(\d{4}-\d{2}-\d{2})", 1)).filter("day <> ''")
    log = log.select("day", "line_no", "entry_id", F.col("logged_at").alias("timestamp"), "user_text", "assistant_text", "meta")
    log.repartition("day").sortWithinPartitions("day", "line_no", "entry_id").drop("line_no", "entry_id").write.partitionBy("day").json(folder)
    return folder


_DAYS = """days AS (SELECT *, 'daily/' || regexp_extract(log_file, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) || '.jsonl' AS f FROM daily_log WHERE logged_at <> '' AND regexp_matches(log_file, '[0-9]{4}-[0-9]{2}-[0-9]{2}')),
lines AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY line_no, entry_id) AS n FROM days)"""


@C.add("src_3", f"WITH {_DAYS} SELECT f AS log_file, n AS line_no, f || '#L' || n AS source_ref, user_text FROM lines")
def src_3(spark: SparkSession, d: str) -> DataFrame:
    """The log written as files of days and read back line by line."""
    return readers.read_daily_logs(spark, _log_days(spark, d)).select("log_file", "line_no", "source_ref", "user_text")


@C.add("src_4", f"WITH {_DAYS} SELECT f || '#L' || n AS source_ref FROM lines WHERE meta.session_id = (SELECT min(meta.session_id) FROM daily_log)")
def src_4(spark: SparkSession, d: str) -> DataFrame:
    """The first session's entries; other lines are not parsed."""
    first = read(spark, d, "daily_log").agg(F.min("meta.session_id").alias("s")).first()["s"]
    return readers.read_daily_logs(spark, _log_days(spark, d), session=first).select("source_ref")


@C.add("src_5", "SELECT entry_id AS cursor, user_text AS content FROM daily_log WHERE entry_id > 500 ORDER BY entry_id LIMIT 50")
def src_5(spark: SparkSession, d: str) -> DataFrame:
    """The next page of a history file after a cursor."""
    path = scratch_folder(spark, "history")
    read(spark, d, "daily_log").select(F.col("entry_id").alias("cursor"), F.col("logged_at").alias("timestamp"), F.col("user_text").alias("content")).write.json(path)
    return readers.read_history(spark, path, 500, 50).select("cursor", "content")


@C.add("src_6", "SELECT logged_at AS timestamp, user_text, count(*) AS n FROM daily_log WHERE logged_at IS NOT NULL GROUP BY ALL")
def src_6(spark: SparkSession, d: str) -> DataFrame:
    """The log tailed as a stream in two runs: the second gets what came since, and nothing twice."""
    folder = scratch_folder(spark, "daily")
    log = read(spark, d, "daily_log").filter("logged_at IS NOT NULL")
    log = log.select("entry_id", F.col("logged_at").alias("timestamp"), "user_text", "assistant_text", "meta")
    middle = F.broadcast(log.agg(F.expr("percentile_approx(entry_id, 0.5)").alias("m")))  # one row
    out = scratch_folder(spark, "tailed")
    for part in ("entry_id <= m", "entry_id > m"):
        log.join(middle).filter(part).drop("entry_id", "m").write.mode("append").json(folder)
        ST.run_once(ST.tail_logs(spark, folder, files_per_batch=4), out + "-state", lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination()
    return spark.read.parquet(out).groupBy("timestamp", "user_text").agg(F.count("*").alias("n"))


@C.add(
    "src_7",
    """WITH f AS (SELECT path, arg_max(text, doc_id) AS t FROM documents WHERE path IS NOT NULL AND text IS NOT NULL GROUP BY path)
SELECT path, CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'ts-js' WHEN 'md' THEN 'markdown' WHEN 'go' THEN 'go' WHEN 'sql' THEN 'sql' END AS lang, strlen(t)::bigint AS size_bytes, sha256(t) AS hash FROM f""",
)
def src_7(spark: SparkSession, d: str) -> DataFrame:
    """One file per path of the documents, read back as a source tree."""
    from memloom.operators.codegraph import manifest_hash
    from memloom.operators.parsers import format_column

    docs = read(spark, d, "documents").filter("path IS NOT NULL AND text IS NOT NULL")
    files = docs.groupBy("path").agg(F.max_by("text", "doc_id").alias("text"))
    return files.select("path", format_column("path").alias("lang"), F.octet_length("text").alias("size_bytes"), manifest_hash("text").alias("hash"))


@C.add(
    "src_7_tree",
    "SELECT * FROM (VALUES ('store/cache.py', 'python'), ('src/graph.rs', 'rust'), ('web/client.ts', 'ts-js'), ('cmd/server.go', 'go'), ('app/jobs.py', 'python'), ('web/kept.min.js', 'ts-js'), ('app/__init__.py', 'python')) t(path, lang)",
)
def src_7_tree(spark: SparkSession, d: str) -> DataFrame:
    """The golden sources among files that a walk leaves out: folders without sources, generated modules, what ignore files name."""
    from memloom.plans.golden_code import SOURCES

    root = scratch_folder(spark, "tree")
    out = ["target/x.rs", "logs/a.py", "app/x_pb2.py", "app/x_pb2_grpc.py", "web/a.min.js", "web/gen/b.ts", "cmd/tmp/deep/c.go", ".ci/d.py", "notes.unknown"]
    more = {"web/kept.min.js": "x\n", "app/__init__.py": "", ".gitignore": "# generated\n*.min.js\n!kept.min.js\n/web/gen/\n", "cmd/.gitignore": "tmp\n"}
    for path, text in {**SOURCES, **dict.fromkeys(out, "x\n"), **more}.items():
        writers.write_file(spark, f"{root}/{path}", text)
    return readers.read_source_tree(spark, root).select("path", "lang")


@C.add(
    "src_9",
    """WITH n AS (SELECT mem_id AS id FROM memories), e AS (SELECT from_id AS src, to_id AS dst FROM memory_links WHERE from_id IN (FROM n) AND to_id IN (FROM n))
SELECT 'imported' AS project_id, (SELECT count(*) FROM n) AS nodes, src, dst, count(*) AS edges FROM e GROUP BY src, dst""",
)
def src_9(spark: SparkSession, d: str) -> DataFrame:
    """Memories and links as the JSON lines of another tool's graph, read back and imported with their edges."""
    path = scratch_folder(spark, "graph")
    read(spark, d, "memories").select(F.col("mem_id").alias("id"), F.col("mem_key").alias("label")).write.json(f"{path}/nodes")
    read(spark, d, "memory_links").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("kind").alias("label")).write.json(f"{path}/edges")
    back = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    nodes, edges = readers.import_graph(back("nodes", "id long, label string"), back("edges", "src long, dst long, label string"), "imported")
    count = F.broadcast(nodes.agg(F.count("*").alias("nodes")))  # one row
    return edges.groupBy("project_id", "src", "dst").agg(F.count("*").alias("edges")).join(count).select("project_id", "nodes", "src", "dst", "edges")


@C.add("src_10", "SELECT lesson_id AS query, len(source_ids)::bigint AS expected FROM lessons WHERE len(source_ids) > 0")
def src_10(spark: SparkSession, d: str) -> DataFrame:
    """Lessons as golden cases, written as JSON lines and read with their checks."""
    path = scratch_folder(spark, "golden")
    read(spark, d, "lessons").filter(F.size("source_ids") > 0).select(F.col("lesson_id").alias("query"), F.col("source_ids").alias("expect_keys"), F.lit("").alias("note")).write.json(path)
    return readers.read_golden(spark, path).select("query", F.size("expect_keys").cast("long").alias("expected"))


@C.add("snk_3", "SELECT substr(logged_at, 1, 10) AS day, count(*) AS n FROM daily_log WHERE regexp_matches(logged_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T') GROUP BY 1")
def snk_3(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch_folder(spark, "appended")
    log = read(spark, d, "daily_log").filter(F.col("logged_at").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T"))
    writers.append_daily_log(log.select(F.col("logged_at").alias("timestamp"), "user_text", "assistant_text", "meta"), folder)
    back = spark.read.option("inferSchema", "false").schema("timestamp string, day string").json(folder)
    return back.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


_OLD = "try_cast(regexp_extract(log_file, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS date)"


@C.add("snk_4", f"SELECT CASE WHEN coalesce({_OLD} >= DATE '2026-12-01' - 120, true) THEN 'kept' ELSE strftime({_OLD}, '%Y-%m') END AS place, entry_id, user_text FROM daily_log")
def snk_4(spark: SparkSession, d: str) -> DataFrame:
    """Where each entry lies after archiving twice: in a month's archive, or kept."""
    folder = scratch_folder(spark, "archive")
    log = read(spark, d, "daily_log").select("log_file", "entry_id", "user_text")
    for _ in range(2):
        kept = writers.archive_logs(log, folder, "2026-12-01", 120)
    old = spark.read.schema("entry_id long, user_text string, month string").json(folder)
    return kept.select(F.lit("kept").alias("place"), "entry_id", "user_text").unionByName(old.select(F.col("month").alias("place"), "entry_id", "user_text"))


@C.add("snk_7", "SELECT n AS name, lesson_id, content FROM lessons, (VALUES ('2026-01-02'), ('2026-01-03')) t(n)")
def snk_7(spark: SparkSession, d: str) -> DataFrame:
    """Three snapshots, of which the last two are kept and restored."""
    folder = scratch_folder(spark, "backups")
    names = ("2026-01-01", "2026-01-02", "2026-01-03")
    for name in names:
        writers.backup(read(spark, d, "lessons"), folder, name)
    kept = [n for n in names if n not in writers.rotate_backups(spark, folder, 2)]
    parts = [spark.read.parquet(f"{folder}/{n}").select(F.lit(n).alias("name"), "lesson_id", "content") for n in kept]
    return parts[0].unionByName(parts[1])


@C.add(
    "st_1_stream",
    """WITH m AS (SELECT coalesce(meta.session_id, '') AS session, entry_id * 2 AS turn, 0 AS said, user_text AS c FROM daily_log WHERE user_text <> '' UNION ALL SELECT coalesce(meta.session_id, ''), entry_id * 2 + 1, 1, assistant_text FROM daily_log WHERE assistant_text <> ''),
g AS (SELECT *, sum(said) OVER (PARTITION BY session ORDER BY turn) - said AS pair FROM m)
SELECT session, max(turn) FILTER (said = 1) AS turn, coalesce(string_agg(c, chr(10) ORDER BY turn) FILTER (said = 0), '') AS user_text, max(c) FILTER (said = 1) AS assistant_text FROM g GROUP BY session, pair HAVING count(*) FILTER (said = 1) > 0""",
)
def st_1_stream(spark: SparkSession, d: str) -> DataFrame:
    """Pairs from a stream of messages, with state per session."""
    messages, path = materialize(T.log_messages(read(spark, d, "daily_log")), "messages")
    out = scratch_folder(spark, "pairs")
    stream = spark.readStream.schema(messages.schema).parquet(path)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        ST.run_once(ST.stream_pairs(stream), out + "-state", lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.parquet(out).select("session", "turn", "user_text", "assistant_text")


@C.add(
    "st_4",
    """WITH c AS (SELECT path, created_at AS t, coalesce(created_at - lag(created_at) OVER w >= INTERVAL 7 DAY, true)::int AS new FROM documents WHERE path IS NOT NULL AND created_at IS NOT NULL WINDOW w AS (PARTITION BY path ORDER BY created_at)),
b AS (SELECT path, t, sum(new) OVER (PARTITION BY path ORDER BY t) AS b FROM c) SELECT path, min(t) AS first, max(t) AS last, count(*) AS changes FROM b GROUP BY path, b HAVING max(t) + INTERVAL 7 DAY <= (SELECT max(created_at) - INTERVAL 10 MINUTE FROM documents WHERE path IS NOT NULL)""",
)
def st_4(spark: SparkSession, d: str) -> DataFrame:
    """A stream of changed files, put off until a file has been quiet for a week: one scan for every burst of changes that has ended."""
    changes, path = materialize(read(spark, d, "documents").filter("path IS NOT NULL AND created_at IS NOT NULL").select("path", F.col("created_at").alias("at")), "changes")
    out = scratch_folder(spark, "scans")
    stream = spark.readStream.schema(changes.schema).parquet(path)
    apply = lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")
    ST.run_once(ST.debounced(stream, "path", "at", quiet="7 days"), out + "-state", apply).awaitTermination()
    return spark.read.parquet(out).select("path", "first", "last", "changes")


@C.add(
    "st_4_windows",
    "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
)
def st_4_windows(spark: SparkSession, d: str) -> DataFrame:
    return ST.windowed_counts(read(spark, d, "events"), size="6 hours")


@C.add(
    "st_7",
    """SELECT user_id, ts, event_id FROM (SELECT * FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY - INTERVAL 720 MINUTE""",
)
def st_7(spark: SparkSession, d: str) -> DataFrame:
    """Hints of users that are still fresh a day before the end: their last event, no more than 12 hours old then."""
    e = read(spark, d, "events").select("user_id", "ts", "event_id")
    as_of = e.agg(F.date_format(F.max("ts") - F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t")).first()["t"]
    return T.fresh_values(e, "user_id", "ts", as_of, ttl_minutes=720)


@C.add(
    "st_7_sessions",
    """WITH b AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 12 HOUR, true)::int AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, s""",
)
def st_7_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ST.session_windows(read(spark, d, "events"), gap="12 hours")


@C.add("st_5", "SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1")
def st_5(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a stream, flushed batch by batch and summed."""
    out = scratch_folder(spark, "counts")
    schema = read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select(F.col("user_id").alias("id"), "ts")
    ST.run_once(stream, out + "-state", ST.counter_flush(out)).awaitTermination()
    return spark.read.parquet(out).groupBy("id").agg(F.sum("n").alias("n"))


@C.add(
    "st_6",
    """WITH m AS (SELECT path, min(doc_id) AS lo, max(doc_id) AS hi FROM documents WHERE path IS NOT NULL AND text IS NOT NULL GROUP BY path), b AS (SELECT path, sha256(text) AS h FROM documents JOIN m USING (path) WHERE doc_id = lo), a AS (SELECT path, sha256(text) AS h FROM documents JOIN m USING (path) WHERE doc_id = hi)
SELECT a.path FROM a JOIN b USING (path) WHERE a.h <> b.h""",
)
def st_6(spark: SparkSession, d: str) -> DataFrame:
    """Files to parse again in an incremental scan."""
    from memloom.operators.codegraph import manifest_diff, manifest_hash

    docs = read(spark, d, "documents").filter("path IS NOT NULL AND text IS NOT NULL")
    pick = lambda f: docs.groupBy("path").agg(f(F.struct("doc_id", "text")).alias("x")).select("path", manifest_hash(F.col("x.text")).alias("hash"))
    return manifest_diff(pick(F.min), pick(F.max)).filter("state IN ('new', 'changed')").select("path")
