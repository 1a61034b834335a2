import random
import re

import pytest

from memloom.operators import collisions
from memloom.llm.neardup import distinct_words, duplicate_groups, duplicate_pairs, near_duplicates

WORD = re.compile(r"[^\W_]+")


def texts(n, seed):
    rnd = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "Ру", "zö") for b in range(60)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.5:
            words = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.randrange(0, 6)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                rnd.shuffle(words)
        else:
            words = [rnd.choice(vocab) for _ in range(rnd.randrange(8, 40))]
        rows.append((i, " ".join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "  _ "), (n + 3, rows[0][1]), (n + 4, "word " * 5000)]


def brute(rows):
    sets = {i: set(WORD.findall(t.lower())) for i, t in rows if t}
    ids = sorted(i for i, s in sets.items() if len(s) >= 12)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("hot", [8192, 32])
def test_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(collisions, "_HOT_LEAST", hot)
    rows = texts(300, hot)
    df = spark.createDataFrame(rows, "mem_id long, words string").selectExpr("mem_id", "words", "'x' AS id", "1 AS rep")
    pairs, members = near_duplicates(df, "mem_id", "words")
    want = brute(rows)
    got = {tuple(r) for r in duplicate_pairs(pairs, members).collect()}
    assert got <= want
    assert len(got) >= 0.99 * len(want)


def test_groups_and_copies(spark):
    base = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join(base)) for i in range(5)] + [(9, " ".join(base[:-2] + ["other"])), (20, " ".join(f"q{i}" for i in range(15)))]
    pairs, members = near_duplicates(spark.createDataFrame(rows, "i long, t string"), "i", "t")
    assert pairs.count() == 1
    assert {r.id: (r.group_id, r.links) for r in duplicate_groups(pairs, members).collect()} == {**{i: (0, 1) for i in range(5)}, 9: (0, 1), 20: (20, 0)}
    assert duplicate_pairs(pairs, members).count() == 15


def test_empty(spark):
    pairs, members = near_duplicates(spark.createDataFrame([], "i long, t string"), "i", "t")
    assert pairs.count() == 0 and members.count() == 0
    assert duplicate_groups(pairs, members).count() == 0


def test_words(spark):
    t = ["Ab-ab_c1 Ünï½ x²", "мир, Мир!", "", None]
    got = [set(r[0]) for r in spark.createDataFrame([(x,) for x in t], "t string").select(distinct_words("t")).collect()]
    assert got == [set(WORD.findall((x or "").lower())) for x in t]
