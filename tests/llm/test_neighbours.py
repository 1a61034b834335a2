import numpy as np
import pytest

from memloom.llm import neighbours
from memloom.llm.neighbours import most_similar, neighbour_pairs


def brute(rows, k, least):
    ok = [(i, np.asarray(v, float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None for x in v) and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in ok:
        near = [(-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 9), j) for j, w in ok if j != i]
        out[i] = [j for c, j in sorted(near) if -c >= least][:k]
    return out


def test_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 8))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 40] + 0.25 * rng.standard_normal(8)]) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(12)] + [(2000 + i, [2 * x for x in rows[5][1]]) for i in range(3)]
    nan = float("nan")
    rows += [(3000, None), (3001, []), (3002, [0.0] * 8), (3003, [1.0] * 7), (3004, [nan] * 8), (3005, [None] * 8), (3006, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "mem_id long, v array<float>").selectExpr("mem_id", "v", "0 AS id", "'x' AS vec", "1 AS h1")
    got = {}
    for r in most_similar(df, "mem_id", "v", dim=8, leaf=64).orderBy("cos", ascending=False).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = brute(rows, 5, 0.8)
    total = sum(map(len, want.values()))
    assert sum(len(got.get(i, set()) & set(n)) for i, n in want.items()) >= 0.97 * total
    assert all(len(n) <= 5 for n in got.values())
    for i in [5, *range(1000, 1012), *range(2000, 2003)]:
        assert got[i] == set(want[i])


@pytest.mark.parametrize("noise", [0.002, 0.1])
def test_third_in_one_cluster(spark, noise, monkeypatch):
    monkeypatch.setattr(neighbours, "_BLOCK", 300)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    x = np.concatenate([centre + noise * rng.standard_normal((1000, 16)), rng.standard_normal((2000, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<float>")
    got = {}
    for r in most_similar(df, "i", "v", dim=16, leaf=64).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = np.round(y[:1000] @ y.T, 9)
    cos[np.arange(1000), np.arange(1000)] = -2
    want = [set(np.lexsort((np.arange(3000), -c))[:5].tolist()) for c in cos]
    assert sum(len(got.get(i, set()) & w) for i, w in enumerate(want)) >= 0.99 * 5000


def test_one_vector_for_all(spark):
    df = spark.range(500).selectExpr("id AS i", "array(1f, 2f, 0f) AS v")
    pairs = {tuple(r) for r in neighbour_pairs(most_similar(df, "i", "v", dim=3, leaf=8)).collect()}
    assert pairs == {(a, b) for b in range(500) for a in range(min(b, 6)) if a < 5 or b == 5} - {(5, 5)} | {(a, 5) for a in range(5)}


def test_empty(spark):
    assert most_similar(spark.createDataFrame([], "i long, v array<float>"), "i", "v").count() == 0
