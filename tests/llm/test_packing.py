import numpy as np
import pytest

from memloom.llm.packing import _pack_shard, assign_by_cost, pack_documents, pack_fill, pack_list
from memloom.llm.tokens import TOKENIZER, load_tokenizer


@pytest.mark.parametrize("seed", range(4))
def test_assignment_is_whole_and_full(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 257, 3000)
    place, used = assign_by_cost(sizes, 256)
    load = np.bincount(place, weights=sizes, minlength=used)
    assert load.max() <= 256 and load.min() > 0 and len(load) == used
    assert sizes.sum() / (used * 256) > 0.95


def test_cost_is_even():
    sizes = np.array([8, 7, 6, 5, 4, 3, 2, 1] * 50)
    place, used = assign_by_cost(sizes, 36 * 2)
    cost = np.bincount(place, weights=sizes + sizes**2 / 12_288, minlength=used)
    assert used == sizes.sum() // 72 and cost.std() / cost.mean() < 0.05


def test_cut_only_if_larger():
    c, d, p, s, n = _pack_shard(np.array([5, 6, 7, 8]), np.array([25, 10, 0, 9]), 10)
    rows = sorted(zip(d.tolist(), p.tolist(), s.tolist(), n.tolist()))
    assert rows == [(5, 0, 0, 10), (5, 1, 10, 10), (5, 2, 20, 5), (6, 0, 0, 10), (7, 0, 0, 0), (8, 0, 0, 9)]
    assert np.bincount(c, weights=n).max() <= 10


def test_tables(spark):
    texts = [None, "", "word", "word " * 3000, "слово " * 40, "x" * 5000] + [f"some text number {i} " * (i % 9) for i in range(60)]
    df = spark.createDataFrame([(i % 60, t) for i, t in enumerate(texts)], "i long, t string").selectExpr("i", "t", "1 AS id", "2 AS tokens", "3 AS shard")
    out = pack_documents(df, "i", "t", [("a", 64), ("b", 100_000)], shard_docs=20).toPandas()
    encode = load_tokenizer(TOKENIZER).encode_ordinary
    total = sum(len(encode(t or "")) for t in texts)
    for name, cap in (("a", 64), ("b", 100_000)):
        part = out[out.pack_name == name]
        assert part.tokens.sum() == total and part.groupby("container").tokens.sum().max() <= cap
        assert part[part.start_token == 0].shape[0] == len(texts)
    assert (out[out.pack_name == "b"].piece == 0).all()
    assert pack_documents(df.limit(0), "i", "t", [("a", 64)]).count() == 0
    with pytest.raises(ValueError):
        pack_documents(df, "i", "t", [("a", 0)])
    sizes = spark.createDataFrame([("a", 64), ("a", 64)], "pack_name string, capacity_tokens long")
    assert pack_list(sizes) == [("a", 64)]
    assert pack_fill(pack_documents(df, "i", "t", [("a", 64)]), sizes.distinct()).first().tokens == total
