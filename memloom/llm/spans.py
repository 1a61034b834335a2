"""Long passages that stand verbatim in more than one document.

The tokens of a text are anchors: k-grams of characters picked by their own
content alone (closed syncmers), so that equal passages have equal anchors
wherever they stand and every passage of 2k - s - 1 characters holds a whole one.
Anchors that occur in several documents are the nodes of a De Bruijn graph, the
steps between neighbouring anchors (token pairs with their distance) its edges.
Paths without branches are compacted through joins with the nodes' degrees; all
documents on such a path share its text.  The source text at the path's
coordinates verifies it, by a digest of its characters, and decides about passages
that reach beyond the path.

The result is exact: a passage of ``least`` characters holds an anchor, that
anchor lies on one compacted path, and either the path itself is long enough or
one of the ``least``-character windows around it is the same in both documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.collisions import SAMPLED, in_sample
from memloom.operators.joins import spread_join
from memloom.operators.ordering import partitions_for
from memloom.session import materialize

LEAST = 120
_CHUNK = 1 << 20
_BLOCK = 2_000
_ANCHORS = "h long, doc long, at int, nth int"
#: Rows of an anchor or passage from which on they are spread over tasks; and how many such anchors are broadcast at most.
_HOT_ROWS = 65_536
_HOT_BROADCAST = 100_000


def _anchor_size(least: int) -> tuple[int, int]:
    """k and s with 2k - s - 1 <= least, k about half of ``least``."""
    s = 8
    return (least + s + 1) // 2, s


def _levels(code, most: int):
    """Hashes of all substrings of length 1, 2, 4, .. up to ``most``; level i starts at each position."""
    import numpy as np

    odd = np.random.default_rng(5).integers(1, 2**63, 32, dtype=np.uint64) | np.uint64(1)
    from memloom.operators.collisions import mix64

    level = [mix64(code.astype(np.uint64) + np.uint64(0x9E3779B9))]
    n = 1
    while 2 * n <= most and len(level[-1]) > n:
        h = level[-1]
        level.append(h[:-n] * odd[len(level)] + h[n:])
        n *= 2
    return level


def _substring_hashes(level, size: int):
    """Hash of the substring of ``size`` characters from each position on, from the powers of two in it."""
    import numpy as np

    from memloom.operators.collisions import mix64

    n = len(level[0]) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, at = np.zeros(n, np.uint64), 0
    for i in reversed(range(len(level))):
        if size >> i & 1:
            out = out * np.uint64(0xD6E8FEB86659FD93) + level[i][at : at + n]
            at += 1 << i
    return mix64(out)


def _codes(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _anchors(code, k: int, s: int):
    """Start positions and hashes of the anchors in one array of code points."""
    import numpy as np

    if len(code) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    level = _levels(code, k)
    grams = _substring_hashes(level, s)
    w = k - s + 1  # s-grams in a k-gram
    least, size = grams, 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = len(grams) - w + 1
    least = np.minimum(least[:n], least[w - size : w - size + n])
    at = np.flatnonzero((grams[:n] == least) | (grams[w - 1 :] == least))
    return at, _substring_hashes(level, k)[at]


def _occurrences(k: int, s: int):
    def occurrences(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def out(docs, texts):
            codes = [_codes(t) for t in texts]
            sizes = np.array([len(c) for c in codes])
            begin = np.append(0, np.cumsum(sizes))
            at, h = _anchors(np.concatenate(codes), k, s)
            doc = np.searchsorted(begin, at, "right") - 1
            inside = at + k <= begin[doc + 1]  # not across two texts
            at, h, doc = at[inside], h[inside], doc[inside]
            first = np.searchsorted(doc, np.arange(len(docs)))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    pa.array(np.asarray(docs, np.int64)[doc]),
                    pa.array((at - begin[doc]).astype(np.int32)),
                    pa.array((np.arange(len(at)) - first[doc]).astype(np.int32)),
                ],
                names=["h", "doc", "at", "nth"],
            )

        for batch in batches:
            docs, texts, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if len(text) < k:
                    continue
                docs.append(doc)
                texts.append(text)
                held += len(text)
                if held >= _CHUNK:
                    yield out(docs, texts)
                    docs, texts, held = [], [], 0
            if docs:
                yield out(docs, texts)

    return occurrences


def _repeated(batches: Iterable) -> Iterator:
    """Of rows sorted by (h, doc) those whose h stands in two documents at least.

    Holds back no more than the rows of one document.
    """
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        known = held is not None and held[1]
        if held is not None:
            t = pa.concat_tables([held[0], t])
        h, doc = t.column(0).to_numpy(), t.column(1).to_numpy()
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        end = np.append(start[1:], len(h))
        several = doc[start] != doc[end - 1]
        several[0] |= known  # the part of the first run that went out before had several
        last = int(start[-1])
        keep = np.repeat(several, end - start)
        if several[-1]:  # the last run may go on: all but one row can go out
            keep[-1] = False
            held = (t.slice(len(h) - 1), True)
        else:
            keep[last:] = False
            held = (t.slice(last), False)
        if keep.any():
            yield from t.filter(pa.array(keep)).combine_chunks().to_batches()
    if held is not None and held[1]:
        yield from held[0].combine_chunks().to_batches()


def _hot_anchors(source: DataFrame, k: int, s: int) -> tuple[DataFrame, int]:
    """(h, n): anchors of very many documents and about how often they stand, told by one document in 32; and about how many rows there are in all.

    What is counted in the sample stands in several documents for sure; that others stay
    untold changes how work is spread and nothing else.
    """
    sampled = source.filter(in_sample("doc")).mapInArrow(_occurrences(k, s), _ANCHORS)
    counts, _ = materialize(sampled.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("d"), F.max("doc").alias("e")), "sampled")
    rows = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    return counts.filter((F.col("n") > _HOT_ROWS // SAMPLED) & (F.col("d") != F.col("e"))).select("h", (F.col("n") * SAMPLED).alias("n")), rows * SAMPLED


def repeated_anchors(docs: DataFrame, id_col: str, text_col: str, *, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(h, doc, at, nth): occurrences of the anchors that stand in more than one document; and (h, n) of the hot ones."""
    k, s = _anchor_size(least)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    source = source.filter((F.char_length("text") >= least) & F.col("doc").isNotNull())
    found = source.mapInArrow(_occurrences(k, s), _ANCHORS)
    hot, n_rows = _hot_anchors(source, k, s)
    hot, _ = materialize(hot, "hot")
    n = partitions_for(docs.sparkSession, n_rows)
    n_hot = hot.count()
    if not n_hot:
        return found.repartition(n, "h").sortWithinPartitions("h", "doc").mapInArrow(_repeated, _ANCHORS), hot
    # hot anchors are known to be repeated and need not meet
    tag = hot.select("h", F.lit(True).alias("hot"))
    tagged = found.join(F.broadcast(tag) if n_hot <= _HOT_BROADCAST else tag, "h", "left")
    tagged, _ = materialize(tagged, "anchors")
    rest = tagged.filter("hot IS NULL").drop("hot").repartition(n, "h").sortWithinPartitions("h", "doc").mapInArrow(_repeated, _ANCHORS)
    return rest.unionByName(tagged.filter("hot").drop("hot")), hot


def compact_paths(anchors: DataFrame, k: int, hot: DataFrame) -> DataFrame:
    """(path, doc, start, stop): the branchless paths of repeated anchors, at each place where they occur.

    A node's neighbours are compared by (anchor, distance); a text that begins,
    ends or goes on with an anchor of its own at a node makes that node a branch.
    ``hot``: (h, n) of the anchors that stand in very many places.
    """
    order = Window.partitionBy("doc").orderBy("nth")
    step = lambda f: F.when(F.abs(f("nth").over(order) - F.col("nth")) == 1, F.xxhash64(f("h").over(order), F.abs(f("at").over(order) - F.col("at"))))
    walked = anchors.withColumns({"before": step(F.lag), "after": step(F.lead)})
    single = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    nodes = walked.groupBy("h").agg(
        F.coalesce(single("before"), F.lit(False)).alias("one_in"), F.coalesce(single("after"), F.lit(False)).alias("one_out")
    )
    placed = spread_join(walked.select("h", "doc", "at", "nth"), nodes, ["h"], "doc", hot)
    joined = F.coalesce(F.col("one_in") & F.lag("one_out").over(order) & (F.lag("nth").over(order) == F.col("nth") - 1), F.lit(False))
    runs = placed.withColumn("run", F.sum(F.when(joined, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", "run").agg(
        F.min_by("h", "nth").alias("path"), F.min("at").alias("start"), (F.max("at") + k).cast("int").alias("stop")
    ).select("path", "doc", "start", "stop")


def _windows(least: int, k: int, flanks: bool):
    """Keys of the passages around each path, from the source text: (path, key, doc, start, stop)."""

    def windows(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            cols = ([], [], [], [], [])

            def add(path, doc, code, start, size):
                n = len(start)
                cols[1].extend(_digest(code[a : a + size]) for a in start.tolist())  # noqa: B023
                for i, x in ((0, np.full(n, path)), (2, np.full(n, doc)), (3, start), (4, start + size)):
                    cols[i].append(x)  # noqa: B023

            for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                code = _codes(text)
                for x in spans:
                    a, b = x["start"], x["stop"]
                    if b - a >= least:
                        add(x["path"], doc, code, np.array([a]), b - a)
                        reach = []
                        if flanks:  # windows with the first or the last anchor that go beyond the path
                            reach = [np.arange(max(0, a + k - least), a), np.arange(b - least + 1, min(b - k, len(code) - least) + 1)]
                    else:  # all windows with the whole path, or with its first or last anchor
                        low, high = (a + k - least, b - k) if flanks else (b - least, a)
                        reach = [np.arange(max(0, low), min(high, len(code) - least) + 1)]
                    for at in reach:
                        if len(at):
                            add(x["path"], doc, code, at, least)
            if cols[0]:
                arrays = [pa.array(c, pa.binary()) if i == 1 else pa.array(np.concatenate(c).astype(np.int32 if i > 2 else np.int64)) for i, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "key", "doc", "start", "stop"])

    return windows


def _digest(code) -> bytes:
    """128 bits of a cryptographic digest of the characters themselves: equal digests are equal texts."""
    return blake2b(code.tobytes(), digest_size=16).digest()


def shared_passages(docs: DataFrame, id_col: str, text_col: str, *, least: int = LEAST, flanks: bool = False) -> DataFrame:
    """(path, key, doc, start, stop) of passages that stand in two documents at least; equal (path, key): equal text, as ``key`` is a digest of its characters.

    With ``flanks`` the passages of a document together are all that it shares;
    without, every two documents that share a passage have a (path, key) in common.
    Documents with null or short text have none; rows with the same id count as
    one document.
    """
    k, _ = _anchor_size(least)
    anchors, hot = repeated_anchors(docs, id_col, text_col, least=least)
    anchors, _ = materialize(anchors, "anchors")
    paths = compact_paths(anchors, k, hot).groupBy("doc").agg(F.collect_list(F.struct("path", "start", "stop")).alias("spans"))  # bounded by the text
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")).filter(F.char_length("text") >= least)
    schema = "path long, key binary, doc long, start int, stop int"
    keys, _ = materialize(source.join(paths, "doc").select("doc", "text", "spans").mapInArrow(_windows(least, k, flanks), schema), "keys")
    shared = keys.groupBy("path", "key").agg(F.min("doc").alias("d"), F.max("doc").alias("e"), F.count("*").alias("n")).filter("d <> e")
    if hot.isEmpty():  # a passage stands no more often than its anchors
        return keys.join(shared, ["path", "key"], "left_semi")
    shared, _ = materialize(shared.select("path", "key", "n"), "shared")
    return spread_join(keys, shared.select("path", "key"), ["path", "key"], "doc", shared.filter(F.col("n") > _HOT_ROWS).select("path", "key", "n"), how="left_semi")


def sharing_pairs(passages: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of documents with a passage in common.

    Passages found in the same documents are one group; the members of a large
    group meet block by block.
    """
    held = passages.select("path", "key", "doc").distinct()
    sets = held.groupBy("path", "key").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64(F.lit(3), "doc").cast("decimal(38,0)")).alias("y")
    )
    chosen = sets.groupBy("n", "x", "y").agg(F.min(F.struct("path", "key")).alias("g")).select("n", "g.path", "g.key")
    chosen, _ = materialize(chosen, "chosen")
    members = spread_join(held, chosen, ["path", "key"], "doc", chosen.filter(F.col("n") > _HOT_ROWS).select("path", "key", "n"))
    blocks = F.ceil(F.col("n") / _BLOCK).cast("int")
    members = members.withColumns({"own": F.pmod(F.xxhash64("doc"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    left = members.select("path", "key", F.col("own").alias("i"), F.col("other").alias("j"), F.col("doc").alias("a"))
    right = members.select("path", "key", F.col("other").alias("i"), F.col("own").alias("j"), F.col("doc").alias("b"))
    return left.join(right, ["path", "key", "i", "j"]).filter("a < b").select("a", "b").distinct()


def shared_share(docs: DataFrame, id_col: str, text_col: str, *, least: int = LEAST) -> DataFrame:
    """One row per document: doc, n_chars, shared_chars, shared_share, passages (maximal stretches of shared text)."""
    spans = shared_passages(docs, id_col, text_col, least=least, flanks=True).select("doc", "start", "stop").distinct()
    order = Window.partitionBy("doc").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(reach, F.lit(0))))
    parts = spans.select("doc", new.alias("new"), F.when(reach.isNull() | (reach < F.col("start")), 1).otherwise(0).alias("begins"))
    sums = parts.groupBy("doc").agg(F.sum("new").cast("long").alias("shared_chars"), F.sum("begins").cast("long").alias("passages"))
    chars: Column = F.coalesce(F.char_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), chars.alias("n_chars"))
    out = texts.join(sums, "doc", "left").fillna(0, ["shared_chars", "passages"])
    return out.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0))
