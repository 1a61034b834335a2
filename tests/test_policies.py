"""Policies, upserts, ledgers, ignore rules and scratch tables on small frames."""

import threading
from datetime import datetime

from pyspark.sql import functions as F

from memloom import session
from memloom.operators import lifecycle as L
from memloom.operators import sessions as T
from memloom.operators.ordering import partitions_for
from memloom.sources import readers

DAY = lambda d: datetime(2026, 1, d)


def test_trigger_policy(spark):
    log = spark.createDataFrame([(DAY(d),) for d in (1, 5, 6, 7)] + [(None,)], "at timestamp")
    run = lambda last, now, n: tuple(T.trigger_policy(log, F.col("at"), last, now, least_new=n).first())
    assert run("2026-01-02", "2026-01-08", 3) == (144.0, 3, True, "due")
    assert run("2026-01-02", "2026-01-02 10:00:00", 1)[2:] == (False, "too soon")
    assert run("2026-01-02", "2026-01-08", 4)[2:] == (False, "too few entries")
    assert tuple(T.trigger_policy(log.limit(0), F.col("at"), "2026-01-02", "2026-01-08").first())[1:] == (0, False, "too few entries")


def test_upsert(spark):
    schema = "k string, content string, project_id string, deleted_at timestamp"
    old = spark.createDataFrame([("a", "x", "p", None), ("b", "y", "q", DAY(1)), ("c", "z", None, DAY(2))], schema)
    new = spark.createDataFrame([("b", "Y", None, None), ("d", None, "r", None)], schema)
    got = {r.k: (r.content, r.project_id, r.deleted_at) for r in L.upsert_records(old, new, "k", values=["content"]).collect()}
    assert got == {"a": ("x", "p", None), "b": ("Y", "q", None), "c": ("z", None, DAY(2)), "d": (None, "r", None)}
    assert L.upsert_records(old.limit(0), new.limit(0), "k", values=["content"]).count() == 0


def test_ledger(spark):
    ledger = spark.createDataFrame([(1, DAY(1), "save"), (2, DAY(9), "forget"), (3, None, "save"), (4, DAY(9), "save")], "entry_id long, ts timestamp, action string")
    assert sorted(r.entry_id for r in L.audit_pruned(ledger, "2026-01-10", 5).collect()) == [2, 3, 4]
    assert [r.entry_id for r in L.audit_entries(ledger, limit=2).collect()] == [4, 2]
    assert [r.entry_id for r in L.audit_entries(ledger, action="save").collect()] == [4, 1, 3]


def test_trust_in_long_runs(spark):
    verdicts = list(L.TRUST_STEPS)
    events = [(i % 3 if i % 2 else 0, i, verdicts[(i * 7 + i // 5) % len(verdicts)]) for i in range(5_000)]
    want = {k: 0.5 for k in range(4)}
    for k, _, v in events:
        want[k] = min(1.0, max(0.0, want[k] + L.TRUST_STEPS[v]))
    start = spark.createDataFrame([(k, 0.5) for k in want], "k long, trust double")
    got = {r.k: r.trust for r in L.trust_after(spark.createDataFrame(events, "k long, i long, verdict string"), start, "k", ["i"]).collect()}
    assert got == {k: round(v, 6) for k, v in want.items()}


def test_timeline_with_many_undated(spark):
    log = spark.range(90).select("id", F.when(F.col("id") % 3 == 0, F.lit(DAY(1)) + F.make_interval(secs=F.col("id"))).alias("at"))
    got = {r.id: r.pos for r in T.timeline(log, F.col("at"), ["id"]).collect()}
    order = sorted(range(90), key=lambda i: (i % 3 == 0, i))
    assert got == {i: n for n, i in enumerate(order, 1)}


def test_ignore_patterns():
    import re

    def ignored(path, *lines, folder=""):
        out = False
        for line in lines:
            p = readers.ignore_pattern(line, folder)
            if p and re.search(p[0], path):
                out = p[1]
        return out

    assert ignored("a/b.log", "*.log") and not ignored("a/b.log", "/*.log") and not ignored("a/blog", "*.log")
    assert ignored("a/tmp/x.py", "tmp/") and not ignored("a/tmp", "tmp/") and ignored("x/y/z.py", "x/**/z.py") and ignored("x/z.py", "x/**/z.py")
    assert not ignored("keep.log", "*.log", "!keep.log") and ignored("s/gen/a.ts", "gen", folder="s") and not ignored("gen/a.ts", "gen", folder="s")
    assert readers.ignore_pattern("# x", "") is None and readers.ignore_pattern("  ", "") is None


def test_days_of_several_files(spark, tmp_path):
    day = tmp_path / "day=2026-01-02"
    day.mkdir()
    line = lambda t: '{"timestamp": "2026-01-02T00:00:00Z", "user_text": "%s"}\n' % t
    (day / "part-1.json").write_text(line("c"))
    (day / "part-0.json").write_text(line("a") + "\n" + line("b"))
    got = sorted((r.line_no, r.user_text) for r in readers.read_daily_logs(spark, str(tmp_path)).collect())
    assert got == [(1, "a"), (3, "b"), (4, "c")]


def test_tables_are_released_and_settings_come_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    done = []

    def work(i):
        df, path = session.materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), f"t{i}")
        done.append((df.count(), path))

    threads = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [n for n, _ in done] == [7] * 4 and spark.conf.get(name) == before
    session.release(spark, *[p for _, p in done])
    assert not session._LEFT & {p for _, p in done}
    assert partitions_for(spark, 10**9, 10**6) == 1000
