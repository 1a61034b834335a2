import random

import pytest

from memloom.llm.spans import shared_passages, shared_share, sharing_pairs


def texts(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij äжк😀") for _ in range(rnd.randrange(3, 12)))
    make = lambda k: " ".join(word() for _ in range(k))
    rows = []
    for i in range(n):
        t = make(rnd.randrange(5, 60))
        for _ in range(rnd.randrange(0, 3)):
            if rows:
                source = rnd.choice(rows)[1] or ""
                a = rnd.randrange(max(1, len(source)))
                size = rnd.choice([60, 118, 119, 120, 121, 150, 300])
                at = rnd.randrange(len(t))
                t = t[:at] + source[a : a + size] + t[at:]
        rows.append((i, t))
    for i in range(3):
        rows.append((n + i, "=" * (130 + i)))
    return rows + [(n + 3, None), (n + 4, ""), (n + 5, rows[0][1]), (n + 6, "ab" * 20_000), (n + 7, "x" * 119)]


def brute(rows, least):
    where = {}
    for i, t in rows:
        for a in range(len(t or "") - least + 1):
            where.setdefault(t[a : a + least], set()).add(i)
    pairs = {(a, b) for s in where.values() for a in s for b in s if a < b}
    shared = {}
    for i, t in rows:
        hit = [False] * len(t or "")
        for a in range(len(t or "") - least + 1):
            if len(where[t[a : a + least]]) > 1:
                hit[a : a + least] = [True] * least
        shared[i] = (sum(hit), sum(1 for x, y in zip([False, *hit], hit) if y and not x))
    return pairs, shared


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "i long, t string").selectExpr("i", "t", "1 AS doc", "'x' AS text", "2 AS path")
    pairs, shared = brute(rows, 120)
    assert {tuple(r) for r in sharing_pairs(shared_passages(df, "i", "t")).collect()} == pairs
    got = {r.doc: r for r in shared_share(df, "i", "t").collect()}
    assert {i: r.shared_chars for i, r in got.items()} == {i: n for i, (n, _) in shared.items()}
    assert all(r.n_chars == len(t or "") for (i, t) in rows for r in [got[i]])


def test_hot_passage_and_empty(spark, monkeypatch):
    from memloom.llm import spans

    monkeypatch.setattr(spans, "_BLOCK", 7)
    rnd = random.Random(0)
    hot = " ".join(str(rnd.random()) for _ in range(8))
    df = spark.createDataFrame([(i, f"{rnd.random()} {hot} {rnd.random()}") for i in range(40)], "i long, t string")
    assert sharing_pairs(shared_passages(df, "i", "t")).count() == 40 * 39 // 2
    assert sharing_pairs(shared_passages(df.limit(0), "i", "t")).count() == 0
    assert shared_share(df.limit(0), "i", "t").count() == 0
    assert sharing_pairs(shared_passages(df.limit(1), "i", "t")).count() == 0


def test_hot_anchors_are_spread(spark, monkeypatch):
    from memloom.llm import spans
    from memloom.operators import collisions, joins

    for module, name, value in ((collisions, "SAMPLED", 1), (spans, "SAMPLED", 1), (spans, "_HOT_ROWS", 12), (joins, "HOT_ROWS", 6)):
        monkeypatch.setattr(module, name, value)
    rnd = random.Random(4)
    standing = "".join(rnd.choice("abcdefgh ijkl") for _ in range(260))
    rows = texts(7, 30) + [(1000 + i, f"{rnd.random()} {standing[: 200 + i]} {rnd.random()}") for i in range(40)]
    df = spark.createDataFrame(rows, "i long, t string")
    pairs, shared = brute(rows, 120)
    assert {tuple(r) for r in sharing_pairs(shared_passages(df, "i", "t")).collect()} == pairs
    assert {r.doc: r.shared_chars for r in shared_share(df, "i", "t").collect()} == {i: n for i, (n, _) in shared.items()}
