"""Search, joins, life cycle, replicas, sessions, extraction, evaluation."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memloom.operators import browse as B
from memloom.operators import codegraph as K
from memloom.operators import evaluation as E
from memloom.operators import extraction as O
from memloom.operators import joins as J
from memloom.operators import lifecycle as L
from memloom.operators import outline, parsers
from memloom.operators import replica as P
from memloom.operators import search as R
from memloom.operators import sessions as T
from memloom.operators.similarity import approximate_recall, similar_pairs


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# ---- search --------------------------------------------------------------------------------------


def test_bm25_and_index(spark):
    docs = spark.createDataFrame([(1, "ledger ledger stale"), (2, "Stale Ledger and much more text around it"), (3, "nothing"), (4, None), (5, "")], "id long, t string")
    hits = R.bm25_search(docs, "id", "t", "ledger stale")
    assert [r.id for r in hits.orderBy("rank").collect()] == [1, 2]
    assert R.bm25_search(docs, "id", "t", "ab x").count() == 0
    assert rows(R.index_candidates(R.gram_index(docs, "id", "t"), "ledger stale"), "id") == [(1,), (2,)]


def test_vector_searches_agree(spark):
    rnd = random.Random(0)
    data = [(i, [rnd.gauss(0, 1) for _ in range(16)]) for i in range(300)]
    df = spark.createDataFrame(data, "id long, v array<float>")
    from memloom.functions.vectors import sign_mask

    q = df.filter("id = 7").select(F.col("v").alias("q")).withColumn("q_mask", sign_mask("q"))
    exact = R.exact_search(df, "id", "v", q, 10)
    two = R.two_stage_search(R.with_mask(df, "v"), "id", "v", q, 10, oversample=150)
    int8 = R.int8_search(df, "id", "v", q, 10, oversample=2)
    assert exact.orderBy("rank").first().id == 7
    assert approximate_recall(exact, two).first().recall >= 0.9 and approximate_recall(exact, int8).first().recall >= 0.9
    assert approximate_recall(exact.limit(0), int8).first().recall == 1.0


def test_fusion_and_mmr(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank long")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank long")
    fused = R.rrf_fuse([a, b])
    assert [(r.id, r.match_type) for r in fused.orderBy("rank").collect()] == [(2, "hybrid"), (1, "fts"), (3, "vector")]
    assert rows(fused, "id", "score") == rows(R.rrf_fuse([b, a]), "id", "score")
    pool = spark.createDataFrame([("q", 1, 1.0, [1.0, 0.0]), ("q", 2, 0.95, [1.0, 0.0]), ("q", 3, 0.9, [0.0, 1.0])], "query string, id long, rel double, vec array<float>")
    assert [r.id for r in R.mmr_select(pool, "query", 2).orderBy("pick").collect()] == [1, 3]


def test_similar_pairs(spark):
    rnd = random.Random(4)
    base = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(40)]
    data = [(i, [x + rnd.gauss(0, 0.35) for x in base[i % 40]]) for i in range(200)]
    import numpy as np

    v = np.array([x for _, x in data], "f4").astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if v[i] @ v[j] >= 0.75}
    got = {(r.a, r.b) for r in similar_pairs(spark.createDataFrame(data, "id long, v array<float>"), "id", "v", 0.75).collect()}
    assert got <= want and len(got) >= 0.995 * len(want)


# ---- joins ---------------------------------------------------------------------------------------


def test_as_of_and_prefix(spark):
    spans = spark.createDataFrame([("f", 1, 5, "a"), ("f", 10, 12, "b"), ("g", 3, 9, "c")], "file string, s long, e long, name string")
    events = spark.createDataFrame([("f", 0), ("f", 1), ("f", 7), ("f", 11), ("f", 99), ("g", 3), ("h", 1)], "file string, at long")
    assert rows(J.last_start_before(events, spans, ["file"], "at", "s"), "file", "at", "name") == [("f", 1, "a"), ("f", 11, "b"), ("f", 7, "a"), ("f", 99, "b"), ("g", 3, "c")]
    assert rows(J.last_start_before(events, spans, ["file"], "at", "s", "e"), "file", "at", "name") == [("f", 1, "a"), ("f", 11, "b"), ("g", 3, "c")]
    paths = spark.createDataFrame([("/a/b/c",), ("/ab/x",), ("/z",)], "p string")
    roots = spark.createDataFrame([("/a",), ("/a/b/",)], "r string")
    assert rows(J.longest_prefix(paths, roots, "p", "r"), "p", "r") == [("/a/b/c", "/a/b/")]


def test_diff_shadow_candidates(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "k string, v string")
    after = spark.createDataFrame([("a", "2"), ("c", None), ("d", "1")], "k string, v string")
    assert rows(J.snapshot_diff(before, after, ["k"], "v"), "k", "change") == [("a", "modified"), ("b", "removed"), ("d", "added")]
    slots = spark.createDataFrame([("x", "", "global"), ("x", "p", "own"), ("y", None, "only"), ("z", "q", "other")], "label string, project string, c string")
    assert rows(J.shadowed(slots, "label", "project", "p"), "label", "c") == [("x", "own"), ("y", "only")]
    cand = spark.createDataFrame([(1, ["no", "b", "a"]), (2, ["no"])], "id long, paths array<string>")
    assert rows(J.first_existing(cand, spark.createDataFrame([("a",), ("b",)], "path string"), "id", "paths"), "id", "path") == [(1, "b")]


def test_superseded_never_empties(spark):
    edges = spark.createDataFrame([(1, 2, "supersedes", 1.0), (2, 1, "supersedes", 1.0), (3, 3, "supersedes", 1.0)], "src long, dst long, label string, weight double")
    pool = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert rows(J.without_superseded(pool(1, 2, 3), edges), "id") == [(3,)]
    assert rows(J.without_superseded(pool(1, 2), edges), "id") == [(1,), (2,)]


# ---- life cycle ----------------------------------------------------------------------------------


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_trust_folds_in_order(spark, partitions):
    rnd = random.Random(2)
    names = list(L.TRUST_STEPS)
    events = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(5)}", i, rnd.choice(names)) for i in range(400)]
    start = {"hot": 0.5, **{f"k{i}": 0.2 * i for i in range(5)}, "quiet": 0.7}
    want = dict(start)
    for k, _, v in events:
        want[k] = min(1.0, max(0.0, want[k] + L.TRUST_STEPS[v]))
    shuffled = events[:]
    rnd.shuffle(shuffled)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = L.trust_after(spark.createDataFrame(shuffled, "k string, i long, verdict string").withColumnRenamed("k", "key").withColumnRenamed("i", "i0"), spark.createDataFrame(list(start.items()), "key string, trust double"), "key", ["i0"])
        got = {r.key: r.trust for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_budgets(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 4), (4, 1)], "id long, size long")
    assert rows(L.greedy_budget(df, ["id"], "size", 10, ["id"]), "id") == [(1,), (3,), (4,)]
    assert rows(L.prefix_budget(df, [F.asc("id")], "size", 10), "id") == [(1,)]
    assert L.greedy_budget(df.limit(0), ["id"], "size", 10, ["id"]).count() == 0


def test_lessons_and_decay(spark):
    c = spark.createDataFrame([(0.5, 2), (0.5, 0)], "c double, n long").select(L.reinforced(F.col("c"), F.col("n")).alias("c"))
    assert [r.c for r in c.collect()] == [0.595, 0.5]
    d = L.decayed(spark.createDataFrame([(0.001, 0.5)], "importance double, trust double"), 0.5).first()
    assert (d.importance, d.trust) == (0.01, 0.25)
    t = datetime(2026, 1, 1)
    lessons = spark.createDataFrame(
        [(0.5, 0.05, None, None, t, None), (0.5, 0.05, t + timedelta(days=13), None, t, None), (0.06, 0.9, None, None, t, None), (0.5, None, None, None, t, None), (0.5, 0.1, None, None, t, t)],
        "confidence double, decay_rate double, last_decayed_at timestamp, last_reinforced_at timestamp, created_at timestamp, deleted_at timestamp",
    )
    assert sorted(r.new_confidence for r in L.decay_sweep(lessons, "2026-01-15 00:00:00").collect()) == [0.05, 0.4, 0.5, 0.5]


def test_conflicts(spark):
    m = spark.createDataFrame(
        [(1, "In prod AuthService uses 10", datetime(2026, 1, 1)), (2, "In dev AuthService uses 10", datetime(2026, 1, 2)), (3, "Actually AuthService uses 12", datetime(2026, 1, 3)), (4, "AuthService uses 13", datetime(2026, 1, 4)), (5, " AuthService uses 13 ", datetime(2026, 1, 5))],
        "id long, content string, updated_at timestamp",
    )
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a long, b long")
    assert rows(L.classify_conflicts(pairs, m), "older", "newer", "relation") == [(1, 2, "COEXISTS"), (2, 3, "CONTRADICTS"), (3, 4, "SUPERSEDES")]
    facts = spark.createDataFrame([(1, "c", "p", "about AuthService", ["authservice"]), (2, "c", None, "about Billing", ["billing"]), (3, "c", "p", "the authservice", []), (4, "x", "p", "AuthService", ["authservice"])], "id long, category string, project string, content string, entities array<string>")
    close = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (1, 4, 0.9), (2, 3, 0.9), (1, 3, 0.5)], "a long, b long, cos double")
    assert rows(L.conflict_pairs(facts, close), "a", "b") == [(1, 3)]


def test_merge_redirect_meta(spark):
    links = spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (1, 3, "x")], "src long, dst long, label string")
    mapping = spark.createDataFrame([(2, 1)], "id long, canonical long")
    assert rows(L.redirect_links(links, mapping), "src", "dst") == [(1, 3)]
    df = spark.createDataFrame([('{"a":"1"}', '{"a":"2","b":"3"}'), ("broken", '{"b":"3"}')], "x string, y string")
    out = df.select(F.from_json(L.merge_meta_existing("x", "y"), "map<string,string>").alias("e"), F.from_json(L.merge_meta_incoming("x", "y"), "map<string,string>").alias("i")).collect()
    assert out[0].e == {"a": "1", "b": "3"} and out[0].i == {"a": "2", "b": "3"} and out[1].e == {"b": "3"}


# ---- replicas ------------------------------------------------------------------------------------


def test_lww(spark):
    t = datetime(2026, 1, 1)
    schema = "k string, u timestamp, rank int, v string"
    local = spark.createDataFrame([("a", t, 1, "old"), ("b", t, 1, "mine"), ("c", None, 1, "x")], schema)
    incoming = spark.createDataFrame([("a", t + timedelta(1), 2, "new"), ("b", t, 2, "theirs"), ("c", t, 2, "y"), ("d", t, 1, "z")], schema)
    merged = P.lww_merge(local, incoming, "k", "u", "rank", ["v"])
    assert rows(merged, "k", "v", "won") == [("a", "new", "incoming"), ("b", "mine", "local"), ("c", "y", "incoming"), ("d", "z", "incoming")]
    again = merged.select("k", F.lit(t).alias("u"), F.lit(1).alias("rank"), "v")
    assert rows(P.lww_merge(again, again, "k", "u", "rank", ["v"]), "k", "v") == rows(merged, "k", "v")
    assert rows(P.merge_journal(local, incoming, "k", "u", "v"), "k", "lost", "kept") == [("a", "old", "new"), ("b", "mine", "theirs"), ("c", "x", "y")]
    assert P.checksum(local, F.col("k")).first() == P.checksum(local.orderBy(F.desc("k")), F.col("k")).first() != P.checksum(incoming, F.col("k")).first()


# ---- sessions ------------------------------------------------------------------------------------


def test_pairs(spark):
    m = [("s", 0, "system", "x"), ("s", 1, "user", "a"), ("s", 2, "user", "b"), ("s", 3, "assistant", "c"), ("s", 4, "assistant", "d"), ("s", 5, "user", "open"), ("t", 0, "assistant", "e")]
    df = spark.createDataFrame(m, "session string, turn long, role string, content string")
    assert rows(T.conversation_pairs(df), "session", "turn", "user_text", "assistant_text") == [("s", 3, "a\nb", "c"), ("s", 4, "", "d"), ("t", 0, "", "e")]
    done = spark.createDataFrame([("s", 3)], "session string, turn long")
    assert rows(T.conversation_pairs(df, already=done), "session", "turn") == [("s", 4), ("t", 0)]


def test_batches_never_cut_a_pair(spark):
    m = [("s", i, "user" if i % 2 == 1 else "assistant") for i in range(130)]
    out = T.pair_batches(spark.createDataFrame(m, "session string, turn long, role string"), 10).orderBy("turn").collect()
    for a, b in zip(out, out[1:]):
        assert not (a.role == "user" and a.batch != b.batch)


def test_timeline(spark):
    log = [(i, f"2026-01-0{1 + i % 3}T10:00:0{i % 6}Z" if i else "broken", "Find ME" if i == 4 else "x", None) for i in range(9)]
    df = spark.createDataFrame(log, "entry_id long, logged_at string, user_text string, assistant_text string")
    p = T.timeline(df, T.parsed_time("logged_at"), ["entry_id"])
    assert sorted(r.pos for r in p.collect()) == list(range(1, 10)) and p.filter("pos = 1").first().entry_id == 0
    a = T.resolve_anchor(p, "find me", ["user_text", "assistant_text"], T.parsed_time("logged_at"))
    at = a.first().anchor
    assert rows(T.window_around(p, a, 1, 2), "pos") == [(x,) for x in range(at - 1, at + 3)]
    none = T.resolve_anchor(p, "absent", ["user_text", "assistant_text"], T.parsed_time("logged_at"))
    assert rows(T.window_around(p, none, 2, 2), "pos") == [(8,), (9,)]
    assert T.resolve_anchor(p, "2026-01-02", ["user_text"], T.parsed_time("logged_at")).first().anchor == p.filter("logged_at LIKE '2026-01-02%'").agg(F.min("pos")).first()[0]


def test_verdicts(spark):
    df = spark.createDataFrame([('{"failed": 1, "passed": 3}',), ('{"passed": 3}',), ("no",), (None,)], "s string")
    assert [r[0] for r in df.select(T.auto_verdict("s")).collect()] == ["failed", "verified", "unconfirmed", "unconfirmed"]


# ---- extraction, code, evaluation -----------------------------------------------------------------


def test_extraction(spark):
    e = spark.createDataFrame([(1, "Anna", "p", "Anna работает в Acme"), (1, "Acme", "o", ""), (1, "it", "x", ""), (2, "Anna", "p", "other text")], "doc long, label string, type string, description string")
    clean = O.without_junk(e)
    assert rows(O.infer_relations(clean), "source", "target", "label") == [("Anna", "Acme", "works_at")]
    assert rows(O.merged_entities(clean), "label", "seen") == [("Acme", 1), ("Anna", 2)]
    r = spark.createDataFrame([(1, "Anna", "Acme"), (1, "Anna", "it"), (1, "Anna", "Anna"), (2, "Anna", "Acme")], "doc long, source string, target string")
    assert rows(O.valid_relations(r, clean), "doc", "target") == [(1, "Acme")]
    df = spark.createDataFrame([('x ```json\n{"a": "}", "b": [1]} y',), ("[1, {2}",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(O.first_json_value("t")).collect()] == ['{"a": "}", "b": [1]}', "{2}", None, None]


def test_entry_points_and_packages(spark):
    df = spark.createDataFrame([("main", "", ""), ("f", "tests/a.py", ""), ("f", "a.py", "export x"), ("f", "a.py", "decorator @route"), ("f", "a.py", "decorator @property"), (None, None, None)], "l string, p string, d string")
    assert [r[0] for r in df.select(K.entrypoint_reason("l", "p", "d")).collect()] == ["main", "test path", "public API", "decorator", None, None]
    m = [("rust", "serde::de", "pkg:rust:serde"), ("rust", "crate::x", None), ("python", "a.b", "pkg:pypi:a"), ("python", ".a", None), ("ts-js", "@s/p/q", "pkg:npm:@s"), ("ts-js", "./x", None), ("php", "A\\B\\C", "pkg:composer:a/b"), ("dart", "package:x/y", "pkg:pub:x"), ("go", '"a/b"', "pkg:go:a/b"), ("c", "x", None)]
    got = spark.createDataFrame([x[:2] for x in m], "l string, m string").select(K.package_of_module("l", "m")).collect()
    assert [r[0] for r in got] == [x[2] for x in m]


def test_module_paths(spark):
    df = spark.createDataFrame([("crate::a::b", "src/x.rs"), (".auth", "app/api/v.py"), ("..", "app/api/v.py"), ("app.x", "m.py"), ("./u", "web/i.ts"), ("", "x")], "m string, f string")
    got = [r[0] for r in df.select(K.module_paths("m", "f")).collect()]
    assert got[0][:2] == ["src/a/b.rs", "src/a/b/mod.rs"] and got[1] == ["app/api/auth.py", "app/api/auth/__init__.py"] and got[2] == ["app/__init__.py"]
    assert "app/x.py" in got[3] and got[4][0] == "web/u.ts" and got[5] == []


def test_parsers(spark):
    files = [(1, "a.py", "import os\nclass A(B):\n    async def f(self): pass\n"), (2, "b.rs", "use std::io;\npub struct S;\npub fn go() {}\n"), (3, "x.unknown", "def f(): pass"), (4, "c.ts", "import x from './y'\nexport class T {}\nconst g = async (a) => a\n"), (5, "d.sql", None)]
    out = outline.parse_sources(spark.createDataFrame(files, "i long, p string, t string"), "i", "p", "t")
    assert rows(out, "file_id", "kind", "name", "line") == sorted([(1, "Import", "os", 1), (1, "Class", "A", 2), (1, "Function", "f", 3), (2, "Import", "std::io", 1), (2, "Struct", "S", 2), (2, "Function", "go", 3), (4, "Import", "./y", 1), (4, "Class", "T", 2), (4, "Function", "g", 3)], key=str)
    for name, (_, patterns) in parsers.FORMATS.items():
        assert patterns and outline.outline("", name) == ([], [])


def test_call_resolution(spark):
    sites = spark.createDataFrame([(1, "a", 100, "f", None), (2, "a", 100, "g", None), (3, "a", 100, "h", None), (4, "a", 100, "dup", None)], "id long, file string, caller long, name string, owner string")
    syms = spark.createDataFrame([(10, "a", "f", None), (11, "b", "f", None), (12, "b", "g", None), (13, "c", "h", None), (14, "c", "dup", None), (15, "d", "dup", None)], "id long, file string, name string, owner string")
    imports = spark.createDataFrame([("a", "b")], "file string, target_file string")
    assert rows(K.resolve_calls(sites, syms, imports), "target", "provenance") == [(10, "RESOLVED"), (12, "RESOLVED"), (13, "HEURISTIC")]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q1", 1, 1), ("q1", 2, 2), ("q2", 9, 1)], "query string, id long, rank long")
    golden = spark.createDataFrame([("q1", 2), ("q1", 3), ("q2", 5), ("q3", 6), ("q4", 404)], "query string, id long")
    store = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 9)], "id long")
    m = E.retrieval_metrics(ranked, golden, store).first()
    assert (m.queries, m.empty, m.mrr, m.recall_5, m.all_5, m.any_5) == (3, 1, pytest.approx(0.5 / 3, abs=1e-6), pytest.approx(0.5 / 3, abs=1e-6), 0.0, pytest.approx(1 / 3, abs=1e-6))
    v = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    assert E.nearest_rank(v, "x", 95).first().value == 10.0 and E.nearest_rank(v, "x", 50).first().value == 5.0
    bad = spark.createDataFrame([(0.5, 0.5, 0.45, 0.5), (0.5, 0.5, 0.44, 0.5), (0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    assert [r[0] for r in bad.select(E.is_degraded(*map(F.col, "abcd"))).collect()] == [False, True, False]


def test_browse(spark):
    df = spark.createDataFrame([("a", '{"author": "x"}'), ("b", '{"auth'), ("c", None), ("d", '{"author": "y"}')], "k string, meta string")
    assert rows(df.filter(B.author_allows("meta", "x")), "k") == [("a",), ("b",), ("c",)]
    labels = spark.createDataFrame([("ok_1",), ("1no",), ("No",), ("a" * 65,), (None,)], "l string")
    assert [r[0] for r in labels.select(B.valid_slot_label("l")).collect()] == [True, False, False, False, False]


def test_batch_search(spark):
    rnd = random.Random(7)
    data = [(i, [float(rnd.randrange(-2, 3)) or 1.0 for _ in range(6)]) for i in range(90)]
    df = spark.createDataFrame(data, "id long, v array<float>")
    queries = df.filter("id % 10 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    got = {}
    for r in R.batch_search(df, "id", "v", queries, 4, block=20).orderBy("query", F.desc("score"), "id").collect():
        got.setdefault(r.query, []).append(r.id)

    def cos(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return round(dot / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 9)

    want = {i: [j for _, j in sorted((-cos(v, w), j) for j, w in data if j != i)[:4]] for i, v in data if i % 10 == 0}
    assert got == want
    assert R.batch_search(df, "id", "v", queries.limit(0), 4).count() == 0 and R.batch_search(df.limit(0), "id", "v", queries, 4).count() == 0
