"""All pairs of vectors above a cosine, by banded sign hashes and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import vectors as V
from memloom.operators.collisions import colliding_pairs, in_sample, split_hot_keys
from memloom.operators.ordering import partitions_for
from memloom.session import materialize

_SKETCH = 4


#: Vectors that a key should hold, and rows that a vector is hashed into at most.
_PER_KEY = 1_024
_BANDS_MOST = 256


def _plan(n: int, least: float, recall: float) -> tuple[int, int, int]:
    """Bits of a band, number of bands, and sketch bits that may differ, for n vectors.

    A band has as many bits as keep a key small, but no more than let ``_BANDS_MOST``
    bands reach the recall: beyond, keys grow and are met block by block, and
    the rows of a vector don't.
    """
    apart = math.acos(least) / math.pi
    bands_of = lambda bits: max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - apart) ** bits)))
    bits = min(24, max(4, math.ceil(math.log2(max(2, n) / _PER_KEY))))
    while bits > 4 and bands_of(bits) > _BANDS_MOST:
        bits -= 1
    size = 64 * _SKETCH
    return bits, bands_of(bits), math.ceil(size * apart + 3.1 * math.sqrt(size * apart * (1 - apart)))


def _banded(bits: int, bands: int, dim: int, seed: int):
    def keys(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from memloom.operators.collisions import mix64

        planes = np.random.default_rng(seed).standard_normal((dim, bits * bands + 64 * _SKETCH)).astype(np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().astype(np.float32).reshape(-1, dim)
            on = (x / np.abs(x).max(axis=1, keepdims=True)) @ planes > 0
            weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64)).astype(np.uint64)
            code = (on[:, : bits * bands].reshape(len(ids), bands, bits) * weights).sum(axis=2, dtype=np.uint64)
            key = mix64(code + (np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40)))
            sketch = np.packbits(on[:, bits * bands :], axis=1).view(">u8").astype(np.uint64)
            words = [pa.array(np.repeat(sketch[:, i], bands).view(np.int64)) for i in range(_SKETCH)]
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, bands)), *words], names=["key", "id", *(f"s{i}" for i in range(_SKETCH))])

    return keys


def similar_pairs(vectors: DataFrame, id_col: str, vec_col: str, least: float, *, dim: int = 64, recall: float = 0.9999, seed: int = 3) -> DataFrame:
    """(a, b, cos), a < b: pairs of vectors whose cosine is at least ``least``.

    Every pair is verified exactly; one at the limit is met with probability
    ``recall``, closer ones more surely.  Takes usable vectors of length ``dim``.
    """
    vec = F.col(vec_col).cast("array<float>")
    rows, _ = materialize(vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), V.dot(vec, vec).alias("sq")), "vectors")
    n = rows.count()
    bits, bands, most = _plan(n, least, recall)
    schema = "key long, id long, " + ", ".join(f"s{i} long" for i in range(_SKETCH))
    hashed = lambda df: df.select("id", "vec").mapInArrow(_banded(bits, bands, dim, seed), schema)
    hot = split_hot_keys(hashed(rows), hashed(rows.filter(in_sample())))
    met, _ = materialize(colliding_pairs(hot, [(_SKETCH, most)], partitions=partitions_for(rows.sparkSession, n * bands)), "met")
    a, b = (rows.select(F.col("id").alias(x), F.col("vec").alias(f"v{x}"), F.col("sq").alias(f"sq{x}")) for x in "ab")
    scored = met.join(a, "a").join(b, "b").select("a", "b", (V.dot("va", "vb") / F.sqrt(F.col("sqa") * F.col("sqb"))).alias("cos"))
    return scored.filter(F.col("cos") >= least)


def both_ways(pairs: DataFrame) -> DataFrame:
    """(id, neighbour, cos) from pairs (a, b, cos), each pair once for either end."""
    sides = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("neighbour")), F.struct(F.col("b").alias("id"), F.col("a").alias("neighbour")))
    return pairs.select(F.explode(sides).alias("s"), "cos").select("s.id", "s.neighbour", "cos")


def best_neighbour(pairs: DataFrame) -> DataFrame:
    """(id, neighbour, cos): each id's closest, ties to the smaller id."""
    best = F.min(F.struct((-F.col("cos")).alias("minus"), "neighbour"))
    return both_ways(pairs).groupBy("id").agg(best.alias("b")).select("id", "b.neighbour", (-F.col("b.minus")).alias("cos"))


def approximate_recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """One row ``recall``: the share of the exact ids that the approximate list has; 1 for an empty exact list."""
    hit = exact.select("id").join(approximate.select("id").withColumn("hit", F.lit(1)), "id", "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))


def nth_of(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
