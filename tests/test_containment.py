import random

import numpy as np
from pyspark.sql import functions as F

from memloom.operators import containment as C
from memloom.operators.extraction import infer_relations


def test_descriptions_are_not_shuffled(spark, request):
    """What is shuffled grows with the relations, not with the characters of the descriptions."""
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables whose size isn't known
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.sha2(F.concat(F.col("id").cast("string"), i.cast("string")), 256).substr(1, 8)), " ")
    df = spark.range(0, 2000, 1, 4).select(F.lit(1).alias("doc"), F.concat(F.lit("Project Number "), F.col("id") % 10).alias("label"), F.concat(F.lit("использует project number 3 "), words).alias("description"))
    before = _shuffled(spark)
    got = infer_relations(df).collect()
    assert sorted(r.source[-1] for r in got) == list("012456789") and {r.target for r in got} == {"Project Number 3"}
    size = df.agg(F.sum(F.octet_length("description"))).first()[0]
    assert _shuffled(spark) - before < size / 5


def _shuffled(spark):
    """Bytes of shuffle written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    none = spark._jvm.java.util.ArrayList()
    found = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))


def test_relations_equal_brute_force(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("aAb я😀-") for _ in range(n))
    rows = [(doc, word(rnd.choice([0, 1, 2, 3, 7, 8, 9, 12])), rnd.choice(["входит в ", "", "содержит "]) + word(rnd.randrange(60))) for doc in (1, 2, 3) for _ in range(25)]
    rows += [(doc, description[9 + k : 9 + k + n], "") for doc, _, description in rows for k, n in ((0, 8), (3, 10), (5, 14)) if len(description) > 30]
    want = {}
    for doc, source, description in rows:
        text = description.lower()
        kind = "part_of" if "входит в" in text else "contains" if "содержит" in text else None
        for other, target, _ in rows if kind else []:
            if other == doc and target and target != source and target.lower() in text:
                key = (doc, source, target, kind)
                want[key] = min(want.get(key, "\U0010ffff"), "inferred: " + description)
    got = infer_relations(spark.createDataFrame(rows, "doc long, label string, description string").repartition(3)).collect()
    assert len(got) == len(want) > 100 and {tuple(r)[:4]: r.context for r in got} == want


def test_texts_in_parts(monkeypatch):
    """A name that two parts of a long text share is found; names of other scopes are hardly ever."""
    monkeypatch.setattr(C, "_SLICE", 16)
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("ab") for _ in range(n)) for n in (0, 1, 15, 16, 17, 33, 400)] + [None]
    one, two = 0x1F3D5B79A2C4E68D, 0x2B992DDFA23249D6
    scopes = np.array([one] * 6 + [two, one], np.uint64)
    names = sorted({texts[6][i : i + n] for i in range(0, 380, 7) for n in (1, 3, 8, 11, 20)})
    batch = C.pa.RecordBatch.from_arrays([C.pa.array(names), C.pa.array([two] * len(names), C.pa.int64())], ["name", "scope"])
    table = np.zeros(1 << 14, np.uint64)
    for b in C._marks(20)([batch]):
        table[b["word"].to_numpy()] |= b["mask"].to_numpy().view(np.uint64)
    got = C._search(texts, scopes, table, 20, sorted({len(n) for n in names}))
    assert set(got[6]) >= {n for n in names if n in texts[6]} == set(names)
    assert not any(got[:6]) and not got[7]


def test_no_names(spark):
    df = spark.createDataFrame([(1, None, "содержит x"), (1, "", "содержит y")], "doc long, label string, description string")
    assert infer_relations(df).count() == 0
