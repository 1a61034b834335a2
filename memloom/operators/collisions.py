"""Rows that share a key, compared by the Hamming distance of their sketches.

The similarity operators turn each record into rows (key, id, s0, s1, ..): equal
keys mean "look at this pair", the 64-bit sketch words tell at once which
pairs are far apart.  Rows meet by a shuffle on the key and are compared in
sorted runs over Arrow batches; only pairs within the distance are emitted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.session import materialize

#: One id in so many tells where rows pile up.
SAMPLED = 32
#: Rows of a key from which on it is split, however many rows there are in all.
_HOT_LEAST = 8_192
#: So many hot keys at most are broadcast; more are joined by a shuffle.
_HOT_BROADCAST = 100_000
PAIR_SCHEMA = "a long, b long"


def mix64(x):
    """A 64-bit finaliser over numpy uint64 arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def close_in_runs(end, ids, sketches, most):
    """Pairs (a < b) of rows i < j < end[i] that are close by every one of ``sketches``.

    ``end[i]`` is the end of the run that row i is in.  A sketch is a list of
    arrays of 64-bit words, ``most`` the bits in which it may differ; later sketches
    are looked at only where the earlier ones agree.  Works by distance: row i
    against i + 1, then i + 2, and so on, as long as any run is that long.
    """
    import numpy as np

    n = len(ids)
    found_a, found_b = [], []
    at = np.flatnonzero(end > np.arange(n) + 1)
    d = 1
    while len(at):
        if len(at) > 0.5 * (n - d):
            i = np.flatnonzero(sum(np.bitwise_count(w[:-d] ^ w[d:]).astype(np.int16) for w in sketches[0]) <= most[0])
            i = i[end[i] > i + d]
        else:
            i = at[sum(np.bitwise_count(w[at] ^ w[at + d]).astype(np.int16) for w in sketches[0]) <= most[0]]
        for sketch, bits in zip(sketches[1:], most[1:]):
            i = i[sum(np.bitwise_count(w[i] ^ w[i + d]).astype(np.int16) for w in sketch) <= bits]
        if len(i):
            found_a.append(ids[i])
            found_b.append(ids[i + d])
        d += 1
        at = at[end[at] > at + d]
    if not found_a:
        return np.empty((2, 0), np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b)])
    pairs = pairs[:, pairs[0] != pairs[1]]
    order = np.lexsort((pairs[1], pairs[0]))
    pairs = pairs[:, order]
    keep = np.ones(pairs.shape[1], bool)
    keep[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
    return pairs[:, keep]


def _compare_runs(most: Sequence[tuple[int, int]]):
    def compare(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def out(rows):
            key, ids, *words = rows
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(start, len(key)))
            full = np.repeat(sizes > 1, sizes)  # rows alone under their key are most of all
            if not full.any():
                return None
            end = np.repeat(np.cumsum(sizes[sizes > 1]), sizes[sizes > 1])
            words = [w[full].view(np.uint64) for w in words]
            pairs = close_in_runs(end, ids[full], [words[:n] for n, _ in most], [bits for _, bits in most])
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"]) if pairs.shape[1] else None

        held, n_held = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n_held += batch.num_rows
            if n_held < 200_000 and len(held) < 64:
                continue
            rows = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))[-1])
            if cut:  # the last run may go on in the next batch
                if (done := out([x[:cut] for x in rows])) is not None:
                    yield done
            held, n_held = [[x[cut:] for x in rows]], 0
        if held:
            if (done := out([np.concatenate(x) for x in zip(*held)])) is not None:
                yield done

    return compare


def in_sample(id_col: str = "id") -> Column:
    """One id in 32, by hash; used only to tell where rows pile up."""
    return F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(SAMPLED)) == 0


def split_hot_keys(rows: DataFrame, sampled: DataFrame) -> DataFrame:
    """Rows (key, id, ..) with the keys that hold very many rows split over block pairs.

    Members of a hot key fall into blocks by their id, and each two blocks meet
    under a key of their own, so every pair still meets and no task gets the
    whole key.  A block has about ``_HOT_LEAST`` rows whatever the size of the table.  Hot keys
    are told by ``sampled``, the rows of a sample of the ids (see :func:`in_sample`); that
    they are told only roughly changes how work is spread and nothing else.
    """
    hot = (
        sampled.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > _HOT_LEAST // SAMPLED)
        .select("key", F.ceil(F.col("n") * SAMPLED / _HOT_LEAST).cast("int").alias("blocks"))
    )
    hot, _ = materialize(hot, "hot")
    n_hot = hot.count()
    if not n_hot:
        return rows
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.xxhash64("key", F.least(block, j), F.greatest(block, j)),
    )
    # with two blocks or more the mixed cells hold the pairs within a block too
    cells = F.when(F.col("blocks") > 1, F.array_remove(cells, F.xxhash64("key", block, block))).otherwise(F.array("key"))
    rest = [c for c in rows.columns if c != "key"]
    joined = rows.join(F.broadcast(hot) if n_hot <= _HOT_BROADCAST else hot, "key", "left")
    return joined.withColumn("keys", F.when(F.col("blocks").isNull(), F.array("key")).otherwise(cells)).select(F.explode("keys").alias("key"), *rest)


def colliding_pairs(rows: DataFrame, most: Sequence[tuple[int, int]], *, partitions: int | None = None) -> DataFrame:
    """Distinct (a, b), a < b, of ids under one key whose sketches are close.

    rows: key, id and the words s0, s1, .. of the sketch, all longs and not null.
    ``most`` lists (words, bits): how many of the first words may differ in how many bits;
    ``partitions`` should grow with the rows (see :func:`memloom.operators.ordering.partitions_for`).
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = [f"s{i}" for i in range(max(w for w, _ in most))]
    met = rows.select("key", "id", *words).repartition(n, "key").sortWithinPartitions("key")
    return met.mapInArrow(_compare_runs(most), PAIR_SCHEMA).distinct()
