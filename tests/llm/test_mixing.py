import random

from pyspark.sql import functions as F

from memloom.llm.mixing import fill_children, largest_exact_total, leaf_budgets, mix_sources, tree_budgets, usual_spelling

LEVELS = lambda: {"source": usual_spelling("source"), "lang": usual_spelling("lang")}

DOCS = "i long, t string, source string, lang string"
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def docs(n=600, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = rnd.choices(["big", " Big", "mid", "Small-One", None, "other"], [50, 5, 20, 3, 2, 20])[0]
        rows.append((i, rnd.choice([None, "", "word " * rnd.randrange(1, 60), "more words here " * rnd.randrange(1, 9)]), source, rnd.choice(["en", "EN", "ru", None, "und"])))
    return rows


def test_budgets():
    assert fill_children(100, {"a": (1, 10), "b": (1, 1000), "c": (2, 1000)}) == {"a": 10, "b": 30, "c": 60}
    assert fill_children(100, {"a": (1, 10), "b": (1, 20), "z": (1, 0)}) == {"a": 10, "b": 20, "z": 0}
    assert fill_children(5, {}) == {} and largest_exact_total({}) == 0
    assert largest_exact_total({"a": (0.5, 50), "b": (0.25, 100), "gone": (0.25, 0)}) == 75
    leaves = [{"source": "a", "lang": "x", "tokens": 10}, {"source": "a", "lang": "y", "tokens": 30}, {"source": "b", "lang": "x", "tokens": 1000}]
    targets = [{"mix_name": "m", "source": s, "target_share": 0.5, "max_repeats": 2} for s in ("a", "b")]
    # siblings first: a's languages are emptied before b gives more than its half
    levels = ["source", "lang"]
    assert leaf_budgets(targets, leaves, levels, 100.0) == [("m", ("a", "x"), 12.5), ("m", ("a", "y"), 37.5), ("m", ("b", "x"), 50.0)]
    assert leaf_budgets(targets, leaves, levels, 400.0) == [("m", ("a", "x"), 20.0), ("m", ("a", "y"), 60.0), ("m", ("b", "x"), 320.0)]
    assert sum(b for *_, b in leaf_budgets(targets, leaves, levels, "listed")) == 1040


def test_shortage_goes_to_siblings_before_ancestors():
    # domains d (languages x, y of sources a, b) and e; by hand: a in d/x lacks 15, which b in d/x gives first (10), then d/y (5)
    leaves = {("d", "x", "a"): (0.25, 10.0), ("d", "x", "b"): (0.15, 25.0), ("d", "y", "a"): (0.1, 100.0), ("e", "x", "c"): (0.5, 1000.0)}
    assert tree_budgets(100.0, leaves) == {("d", "x", "a"): 10.0, ("d", "x", "b"): 25.0, ("d", "y", "a"): 15.0, ("e", "x", "c"): 50.0}
    # the whole of d falls short by 15: only then e gives more
    leaves[("d", "y", "a")] = (0.1, 0.0)
    assert tree_budgets(100.0, leaves) == {("d", "x", "a"): 10.0, ("d", "x", "b"): 25.0, ("d", "y", "a"): 0.0, ("e", "x", "c"): 65.0}
    # weights of inner nodes by path
    wide = {p: (w, 1000.0) for p, (w, _) in leaves.items()}
    got = tree_budgets(100.0, wide, {("d",): 3.0, ("e",): 1.0, ("d", "x"): 1.0, ("d", "y"): 2.0})
    assert {p: round(b, 9) for p, b in got.items()} == {("d", "x", "a"): 15.625, ("d", "x", "b"): 9.375, ("d", "y", "a"): 50.0, ("e", "x", "c"): 25.0}


def test_three_levels_keep_the_shares_of_sources(spark):
    targets = [("m", "big", 0.6, 1), ("m", "mid", 0.4, 2)]
    levels = {"domain": F.when(F.col("i") % 2 == 0, "even").otherwise("odd"), "lang": usual_spelling("lang"), "source": usual_spelling("source")}
    chosen, report = mix_sources(spark.createDataFrame(docs(), DOCS), "i", "t", levels, spark.createDataFrame(targets, TARGETS))
    assert chosen.columns == ["mix_name", "domain", "lang", "source", "doc", "tokens", "repeats"]
    assert all(abs(r.actual_share - r.target_share) < 0.02 for r in report.collect())


def test_shares_and_repeats(spark):
    targets = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small_one", 0.1, 6), ("m", "absent", 0.1, 9), ("n", "small_one", 1.0, 3)]
    df = spark.createDataFrame(docs(), DOCS).selectExpr("*", "1 AS id", "2 AS tokens", "3 AS rest", "'z' AS range")
    chosen, report = mix_sources(df, "i", "t", LEVELS(), spark.createDataFrame(targets, TARGETS))
    rows, limits = chosen.collect(), {(m, s): r for m, s, _, r in targets}
    assert all(1 <= r.repeats <= limits[r.mix_name, r.source] for r in rows)
    assert len({(r.mix_name, r.doc) for r in rows}) == len(rows)
    got = {(r.mix_name, r.source): r for r in report.collect()}
    for source, share in (("big", 5 / 9), ("mid", 3 / 9), ("small_one", 1 / 9)):
        assert abs(got["m", source].actual_share - share) < 0.02
    assert got["m", "absent"].tokens == 0 and got["n", "small_one"].actual_share == 1
    assert got["n", "small_one"].most_repeats == 3


def test_shortage_goes_to_the_others(spark):
    targets = [("m", "big", 0.5, 1), ("m", "small_one", 0.5, 1)]
    df = spark.createDataFrame(docs(), DOCS)
    _, report = mix_sources(df, "i", "t", LEVELS(), spark.createDataFrame(targets, TARGETS), total_tokens=3000.0)
    got = {r.source: r for r in report.collect()}
    assert got["small_one"].most_repeats == 1 and abs(got["small_one"].tokens + got["big"].tokens - 3000) < 60


def test_empty(spark):
    df, targets = spark.createDataFrame(docs(20), DOCS), spark.createDataFrame([("m", "big", 1.0, 1)], TARGETS)
    chosen, report = mix_sources(df.limit(0), "i", "t", LEVELS(), targets)
    assert chosen.count() == 0 and report.first().actual_share == 0
    chosen, report = mix_sources(df, "i", "t", LEVELS(), targets.limit(0))
    assert chosen.count() == 0 and report.count() == 0
