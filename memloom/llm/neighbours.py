"""The most similar vectors of every vector, over a hash-prefix forest.

Each tree gives a vector a long hash string of random-hyperplane bits.  The
strings of a tree form one sorted array, spread over the cluster by range
partitioning; a vector's candidates are those under its longest prefix that has
no more than ``leaf`` members, which is where a descent to the longest match and
a synchronous ascent until enough candidates are seen end up.  A 256-bit sketch
prunes the candidates, exact cosines decide.

Where a leaf is full of vectors that the sketch can't tell apart, it holds a part
of a crowd and says nothing about the rest of it.  Crowded vectors are therefore
told by the leaves and meet each other block by block, all of them, by exact cosines.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.vectors import usable
from memloom.operators.ordering import partitions_for
from memloom.session import materialize

TREES = 26
#: Bits in which the first 128, and all 256, of the sketch may differ: each lets 0.998 of the pairs of cosine 0.8 pass.
SKETCH_BITS_MOST = (40, 72)
_SKETCH = [f"s{i}" for i in range(4)]
_ROWS = "tree int, string long, id long, " + ", ".join(f"{c} long" for c in _SKETCH)
_STRING_BITS = 63
#: Members of a leaf that each of its vectors is compared with to tell whether it is crowded.
_CROWD_SAMPLE = 64
#: Crowded vectors a block; two blocks meet in a task.
_BLOCK = 8_192
_STRIP = 512
#: Rows of the sorted arrays, of 52 bytes each, that a task holds.
_ROWS_PER_TASK = 500_000
#: So many ids of crowded vectors at most are broadcast.
_CROWD_BROADCAST = 10_000


def _hasher(trees: int, dim: int, seed: int):
    def hashed(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        planes = np.random.default_rng(seed).standard_normal((dim, (trees + len(_SKETCH)) * 64)).astype(np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().astype(np.float32).reshape(-1, dim)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            words = np.packbits((x @ planes) > 0, axis=1).view(">u8").astype(np.uint64)
            n = len(ids)
            strings = words[:, :trees].T >> np.uint64(64 - _STRING_BITS)  # not negative as longs
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(trees, dtype=np.int32), n)),
                    pa.array(strings.reshape(-1).view(np.int64)),
                    pa.array(np.tile(ids, trees)),
                    *[pa.array(np.tile(words[:, trees + i], trees).view(np.int64)) for i in range(len(_SKETCH))],
                ],
                names=["tree", "string", "id", *_SKETCH],
            )

    return hashed


def _leaf_ends(strings, lo: int, hi: int, leaf: int, end) -> None:
    """Cut the sorted strings lo..hi into the largest prefix nodes of at most ``leaf`` members; fill ``end``."""
    import numpy as np

    stack = [(lo, hi, _STRING_BITS - 1)]
    while stack:
        a, b, bit = stack.pop()
        if b - a <= leaf:
            end[a:b] = b
        elif bit < 0:  # equal strings: the sketch, sorted too, goes on as the string
            for c in range(a, b, leaf):
                end[c : min(c + leaf, b)] = min(c + leaf, b)  # not past b, where other leaves are
        else:
            first = int(strings[a])
            split = ((first >> bit) | 1) << bit
            m = a + int(np.searchsorted(strings[a:b], split))
            if a < m < b:
                stack += [(a, m, bit - 1), (m, b, bit - 1)]
            else:
                stack.append((a, b, bit - 1))


def _crowded(end, words, leaf: int, bits: int):
    """True for the rows of which a quarter of a full leaf (32 at least), by a sample of their own leaf, is within ``bits``."""
    import numpy as np

    least = max(32, leaf // 4)
    out = np.zeros(len(end), bool)
    a = 0
    while a < len(end):
        b = int(end[a])
        if b - a >= least:
            at = a + np.arange(_CROWD_SAMPLE) * (b - a) // _CROWD_SAMPLE
            near = sum(np.bitwise_count(w[a:b, None] ^ w[at]).astype(np.int16) for w in words) <= bits
            out[a:b] = near.sum(axis=1) * (b - a) >= least * _CROWD_SAMPLE
        a = b
    return out


def _leaf_pairs(leaf: int, most: tuple[int, int]):
    """Pairs (a < b) under one leaf, without those of two crowded vectors; a crowded vector comes as a pair with itself."""

    def pairs(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from memloom.operators.collisions import close_in_runs

        held = [[batch.column(i).to_numpy() for i in range(3 + len(_SKETCH))] for batch in batches if batch.num_rows]
        if not held:
            return
        tree, string, ids, *words = (np.concatenate(x) for x in zip(*held))
        words = [w.view(np.uint64) for w in words]
        held.clear()
        end = np.empty(len(ids), np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, tree[1:] != tree[:-1])), len(tree))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            _leaf_ends(string, int(lo), int(hi), leaf, end)
        # some leaves at a time, to bound what is found at once
        at = 0
        while at < len(ids):
            to = int(end[min(at + 100_000, len(ids)) - 1])
            part, part_ids, part_end = [w[at:to] for w in words], ids[at:to], end[at:to] - at
            full = _crowded(part_end, part[:2], leaf, most[0])
            if full.any():
                # the crowded last in their leaf, where no run starts from them
                order = np.lexsort((full, part_end))
                part, part_ids, full = [w[order] for w in part], part_ids[order], full[order]
                part_end = np.where(full, 0, part_end)
                own = pa.array(np.unique(part_ids[full]))
                yield pa.RecordBatch.from_arrays([own, own], names=["a", "b"])
            found = close_in_runs(part_end, part_ids, [part[:2], part], most)
            if found.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])
            at = to

    return pairs


def _block_pairs(k: int, least_cos: float):
    """Pairs (a < b) of the vectors of two blocks, or of one, of which one is among the ``k`` most similar to the other; ties to the smaller id."""

    def nearest(cell):
        import numpy as np
        import pyarrow as pa

        block, ids = cell["block"].to_numpy(), cell["rep"].to_numpy()
        x = cell["vec"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
        order = np.lexsort((ids, block))
        block, ids, x = block[order], ids[order], x[order]
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        n, cut = len(ids), int(np.searchsorted(block, block[-1]))
        found = [np.empty((2, 0), np.int64)]
        # of two blocks only pairs across them
        for lo, hi, other, to in [(0, n, 0, n)] if cut == 0 else [(0, cut, cut, n), (cut, n, 0, cut)]:
            top = min(k, to - other)
            for a in range(lo, hi, _STRIP):
                b = min(a + _STRIP, hi)
                cos = np.rint(x[a:b] @ x[other:to].T * 1e9)
                if cut == 0:
                    cos[np.arange(b - a), np.arange(a, b)] = -2e9
                place = np.argpartition(np.arange(to - other) - cos * 2.0**20, top - 1, axis=1)[:, :top]  # exact: below 2^53
                i, j = np.nonzero(np.take_along_axis(cos, place, 1) >= np.rint(least_cos * 1e9) - 1)
                u, v = ids[a + i], ids[other + place[i, j]]
                found.append(np.stack([np.minimum(u, v), np.maximum(u, v)]))
        pairs = np.concatenate(found, axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    return nearest


def _crowd_pairs(crowd: DataFrame, n: int, k: int, least_cos: float) -> DataFrame:
    """(a, b): every two of the ``n`` vectors (rep, vec) meet, block by block; the ``k`` most similar of each are kept per block."""
    blocks = -(-n // _BLOCK)
    block = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
    placed = crowd.select("rep", "vec", block.alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    cells = placed.select("rep", "vec", "block", other).withColumn("cell", F.least("block", "other") * F.lit(blocks).cast("long") + F.greatest("block", "other"))
    return cells.select("cell", "rep", "vec", "block").groupBy("cell").applyInArrow(_block_pairs(k, least_cos), "a long, b long")


def _cosines(batches: Iterable) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.num_rows
        x, y = (batch.column(i).flatten().to_numpy().astype(np.float64).reshape(n, -1) for i in (2, 3))
        cos = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        # vectors that are equal but for their length must tie
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(cos, 9))], names=["a", "b", "cos"])


def most_similar(
    records: DataFrame, id_col: str, vec_col: str, *, k: int = 5, least_cos: float = 0.8, dim: int = 64,
    trees: int = TREES, leaf: int | None = None, sketch_bits: tuple[int, int] = SKETCH_BITS_MOST, seed: int = 11,
) -> DataFrame:
    """(id, neighbour, cos): for every record its ``k`` most similar others of at least ``least_cos``; ties to the smaller id.

    Records without a usable vector are left out (see :func:`memloom.operators.vectors.usable`).
    Equal vectors are indexed once and their records written out at the end, so
    any number of them may be equal.  ``leaf`` is the number of candidates a tree
    gives; unset it is twice the square root of the number of different
    vectors.  Vectors with more near ones than a quarter of that meet all their
    like, which takes time in the square of their number.  The
    sketch parameter suits cosines of 0.8 and more.
    """
    vec = F.col(f"`{vec_col}`")
    chosen = records.filter(usable(vec, dim)).select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.cast("array<float>").alias("vec"))
    chosen = chosen.filter("id IS NOT NULL").withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), "vec")})
    reps, _ = materialize(chosen.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min_by("vec", "id").alias("vec")), "reps")
    n = reps.count()
    leaf = leaf or max(128, round(2 * n**0.5))
    # a task holds its part of the arrays in memory, so parts grow in number, not in size; a border
    # between them cuts one leaf, so a part holds many.  Equal strings are told apart by sketch and id.
    parts = max(1, min(partitions_for(records.sparkSession, n * trees, _ROWS_PER_TASK), n * trees // (64 * leaf)))
    strings = reps.select("rep", "vec").mapInArrow(_hasher(trees, dim, seed), _ROWS)
    order = ["tree", "string", "s0", "id"]
    arrays = strings.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    met, _ = materialize(arrays.mapInArrow(_leaf_pairs(leaf, sketch_bits), "a long, b long").distinct(), "met")
    crowd = met.filter("a = b").select(F.col("a").alias("rep"))
    n_crowd = crowd.count()
    if n_crowd:
        crowd = F.broadcast(crowd) if n_crowd <= _CROWD_BROADCAST else crowd
        close = _crowd_pairs(reps.select("rep", "vec").join(crowd, "rep", "left_semi"), n_crowd, k + 1, least_cos)
        close, _ = materialize(close.distinct(), "close")
        # two crowded vectors may have met under a leaf that isn't full of them
        a, b = (crowd.select(F.col("rep").alias(c), F.lit(True).alias(f"crowded_{c}")) for c in ("a", "b"))
        met = met.filter("a <> b").join(a, "a", "left").join(b, "b", "left").filter("crowded_a IS NULL OR crowded_b IS NULL")
        met = met.select("a", "b").unionByName(close)
    ids = met.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    vectors = reps.select("rep", "vec").join(ids, "rep", "left_semi")
    both = met.join(vectors.select(F.col("rep").alias("a"), F.col("vec").alias("va")), "a").join(
        vectors.select(F.col("rep").alias("b"), F.col("vec").alias("vb")), "b"
    )
    close = both.select("a", "b", "va", "vb").mapInArrow(_cosines, "a long, b long, cos double").filter(F.col("cos") >= least_cos)
    sides = close.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("s"), "cos")
    sides = sides.select("s.x", "s.y", "cos")

    keys = ["h1", "h2"]
    ids_of = chosen.select("id", *keys)
    # of each class only the smallest k + 1 ids can be anybody's neighbours
    few = ids_of.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("r") <= k + 1)
    few = few.join(reps.select(*keys, "rep"), keys).select(F.col("rep").alias("y"), "id")
    own = few.groupBy("y").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("y").alias("x"), "y", F.lit(1.0).alias("cos"))
    listed = sides.unionByName(own).join(few, "y").withColumn(
        "r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("cos"), "id"))
    ).filter(F.col("r") <= k + 1)
    lists = listed.groupBy("x").agg(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("minus"), "id"))).alias("list"))  # k + 1 at most
    lists, _ = materialize(lists.join(reps.select(*keys, F.col("rep").alias("x")), "x").select(*keys, "list"), "lists")
    own_id = F.col("id")
    taken = F.slice(F.filter("list", lambda e: e["id"] != own_id), 1, k)
    return ids_of.join(lists, keys).select("id", F.explode(taken).alias("e")).select("id", F.col("e.id").alias("neighbour"), (-F.col("e.minus")).alias("cos"))


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of records of which one is among the other's neighbours."""
    return neighbours.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
