from pyspark.sql import functions as F

from memloom.operators import joins as J
from memloom.operators.extraction import _first_json, infer_relations, merged_entities


def test_hot_keys_join_as_others(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT_ROWS", 10)
    left = spark.range(400).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") == 1, None).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = left.groupBy("k").agg(F.count("*").alias("n")).filter("n > 10")
    for how in ("inner", "left_semi"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()))
        assert sorted(map(tuple, J.spread_join(left, right, ["k"], "id", hot, how=how).collect())) == want
    assert J.spread_join(left, right, ["k"], "id", hot.limit(0)).count() == left.join(right, "k").count()
    assert J.spread_join(left.limit(0), right, ["k"], "id", hot).count() == 0


def test_suffixes(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("xb/c.py",), ("c.py",), (None,)], "p string")
    wanted = spark.createDataFrame([("b/c.py",), ("c.py",), ("z",)], "s string")
    assert {tuple(r) for r in J.suffix_matches(paths, wanted, "p", "s").collect()} == {("a/b/c.py", "b/c.py"), ("a/b/c.py", "c.py"), ("xb/c.py", "c.py"), ("c.py", "c.py")}


def test_labels_of_any_length_within_words(spark):
    rows = [(1, "Anna", "она работает в Союзе Писателей Города Новой Земли"), (1, "Союзе Писателей Города Новой Земли", "большой союз"), (1, "ЮЗ", ""), (2, "союз", "x"), (1, None, "x"), (1, "", None)]
    got = {(r.source, r.target, r.label) for r in infer_relations(spark.createDataFrame(rows, "doc long, label string, description string")).collect()}
    assert got == {("Anna", "Союзе Писателей Города Новой Земли", "works_at"), ("Anna", "ЮЗ", "works_at")}


def test_many_short_descriptions(spark):
    df = spark.range(700).select(F.lit("L").alias("label"), F.lit("T").alias("type"), F.format_string("%03d", "id").alias("description"))
    row = merged_entities(df).first()
    assert row.description == " ".join(f"{i:03d}" for i in range(700))[:1000] and row.seen == 700


def test_first_json():
    assert _first_json('see {"a": [1, "}"]} and {"b": 2}') == '{"a": [1, "}"]}'
    assert _first_json("a } ] [1] x") == "[1]" and _first_json("{ [1] [2]") == "[1]" and _first_json("[ { ] [3]") == "[3]"
    assert _first_json('it\'s 5" wide: {"q": "\\" {"}') == '{"q": "\\" {"}'
    assert _first_json("no") is None and _first_json("[" * 200_000) is None
