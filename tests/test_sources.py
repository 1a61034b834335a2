"""Readers, writers and streams over temporary folders."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memloom.sources import readers, writers
from memloom.streaming import sessions as ST


def test_text_decoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("мир".encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.PDF").write_bytes("мир".encode("cp1251"))
    (tmp_path / "c.bin").write_bytes(b"ok \x98\xff")
    got = {r.file_name: (r.format, r.size_bytes, r.text) for r in readers.read_texts(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("txt", 6, "мир") and got["b.PDF"] == ("pdf", 3, "мир")
    assert got["c.bin"][2].startswith("ok ")


def test_source_tree(spark, tmp_path):
    for name in ("src/a.py", "src/x_pb2.py", "node_modules/b.js", "target/c.rs", "Dockerfile", "notes.unknown"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / "big.py").write_text("#" * (2 * 1024 * 1024 + 1))
    got = {r.path: r.lang for r in readers.read_source_tree(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": "python", "Dockerfile": "dockerfile"}


def log_line(ts, user, session="s1"):
    return json.dumps({"timestamp": ts, "user_text": user, "assistant_text": "a", "meta": {"session_id": session}})


def test_daily_logs(spark, tmp_path):
    (tmp_path / "2026-01-01.jsonl").write_text(log_line("2026-01-01T00:00:00Z", "one") + "\nbroken\n\n" + log_line("2026-01-01T01:00:00Z", "two", "s2") + "\n")
    (tmp_path / "other.jsonl").write_text(log_line("2026-01-01T00:00:00Z", "foreign"))
    got = readers.read_daily_logs(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.source_ref, r.user_text) for r in got] == [("daily/2026-01-01.jsonl#L1", "one"), ("daily/2026-01-01.jsonl#L4", "two")]
    assert [r.user_text for r in readers.read_daily_logs(spark, str(tmp_path), session="s2", most=5).collect()] == ["two"]


def test_golden_and_history(spark, tmp_path):
    good = tmp_path / "g.jsonl"
    good.write_text('{"query": "q", "expect_keys": ["k"]}\n')
    assert readers.read_golden(spark, str(good)).count() == 1
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"query": " ", "expect_keys": ["k"]}\n')
    with pytest.raises(ValueError):
        readers.read_golden(spark, str(bad))
    history = tmp_path / "h.jsonl"
    history.write_text("".join(json.dumps({"cursor": i, "timestamp": "t", "content": str(i)}) + "\n" for i in range(9)))
    assert [r.cursor for r in readers.read_history(spark, str(history), 3, 2).collect()] == [4, 5]


def test_archive_is_repeatable_and_backup_is_counted(spark, tmp_path):
    df = spark.createDataFrame([("daily/2026-01-05.jsonl", "a"), ("daily/2026-03-05.jsonl", "b"), ("foreign", "c")], "log_file string, user_text string")
    for _ in range(2):
        left = writers.archive_logs(df, str(tmp_path / "arc"), "2026-03-10", 30)
    assert sorted(r.user_text for r in left.collect()) == ["b", "c"]
    assert [(r.user_text, str(r.month)) for r in spark.read.json(str(tmp_path / "arc")).collect()] == [("a", "2026-01")]
    for name in ("1", "2", "3"):
        assert writers.backup(df, str(tmp_path / "bak"), name) == 3
    assert writers.rotate_backups(spark, str(tmp_path / "bak"), 2) == ["1"]
    assert writers.rotate_backups(spark, str(tmp_path / "absent"), 2) == []


def test_append_masks_secrets(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z", "API_KEY=1", "ok", None)], "timestamp string, user_text string, assistant_text string, meta struct<session_id:string>")
    writers.append_daily_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first().user_text == "API_KEY=[REDACTED]"


def test_stream_reads_each_line_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        ST.run_once(ST.tail_logs(spark, str(folder)), state, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination()

    (folder / "a.jsonl").write_text(log_line("2026-01-01T00:00:00Z", "one") + "\nbroken\n")
    run()
    (folder / "b.jsonl").write_text(log_line("2026-01-02T00:00:00Z", "two") + "\n")
    run()
    run()
    assert sorted(r.user_text for r in spark.read.parquet(out).collect()) == ["one", "two"]


def test_stateful_pairs(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, folder = "session string, turn long, role string, content string", str(tmp_path / "in")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = ST.stream_pairs(spark.readStream.schema(schema).parquet(folder))
        ST.run_once(stream, state, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination()

    feed([("s", 1, "user", "a"), ("s", 2, "user", "b")])
    feed([("s", 1, "user", "a"), ("s", 2, "user", "b"), ("s", 3, "assistant", "c"), ("s", 4, "user", "open")])
    assert [(r.turn, r.user_text, r.assistant_text) for r in spark.read.parquet(out).collect()] == [(3, "a\nb", "c")]


def test_windows(spark):
    t = datetime(2026, 1, 1)
    rows = [(1, t.replace(minute=m), "x", 1.0) for m in (0, 5, 9, 50)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, value double")
    assert sorted(r.n for r in ST.windowed_counts(df).collect()) == [1, 3]
    assert sorted(r.n for r in ST.session_windows(df, gap="10 minutes").collect()) == [1, 3]


def test_import_graph(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    n, e = readers.import_graph(nodes, edges, "p")
    assert n.filter(F.col("project_id") == "p").count() == 2 and e.count() == 1
