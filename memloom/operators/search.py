"""Lexical, vector and fused retrieval.

A query's own side is always tiny (a few terms, one vector row, a pool of at most
a few thousand hits) and is broadcast; the corpus side is filtered and scored
where it lies and cut by top-k, so that no shuffle grows with the corpus beyond
the matching rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import vectors as V
from memloom.functions.text import decompose_identifier
from memloom.operators.ordering import global_rank

K1, B = 1.2, 0.75
RRF_K = 60
POOL_MOST = 2_000


# ---- lexical ---------------------------------------------------------------------------------


def query_terms(query: str, least: int = 3) -> list[str]:
    """The query's different words of at least ``least`` characters, lower-cased; shorter ones never match trigrams."""
    return list(dict.fromkeys(t for t in query.lower().split() if len(t) >= least))


def _occurrences(text: Column, term: str) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(term), F.lit("")))) / len(term)


def bm25_search(docs: DataFrame, id_col: str, text_col: str, query: str, k: int | None = 10, *, all_terms: bool = True) -> DataFrame:
    """(id, score, rank): documents with the query's terms as substrings, by BM25 over phrases.

    Length is the number of trigrams; document counts and the mean length are over
    all documents given.  Terms below three characters never match; without any
    term the result is empty.  Ties go to the smaller id; ``k`` None keeps all.
    """
    terms = query_terms(query)
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    if not terms:
        return base.limit(0).select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    length = F.greatest(F.char_length("text") - 2, F.lit(0))
    hit = [F.contains("text", F.lit(t)) for t in terms]
    stats = base.agg(
        F.count("*").alias("n"), F.avg(length).alias("mean"), *[F.sum(h.cast("int")).alias(f"df{i}") for i, h in enumerate(hit)]
    )
    wanted = hit[0]
    for h in hit[1:]:
        wanted = (wanted & h) if all_terms else (wanted | h)
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)))
        tf = _occurrences(F.col("text"), t)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("mean")))
    hits = base.filter(wanted).join(F.broadcast(stats)).select("id", score.alias("score"))  # stats: one row
    return ranked(hits, k)


def ranked(hits: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """The hits with their 1-based ``rank`` by descending score, then id; the first ``k`` of them."""
    order = order or (F.desc("score"), F.asc("id"))
    if k is None:
        return global_rank(hits, order)
    return hits.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def gram_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The inverted index (gram, id): distinct trigrams of the lower-cased texts."""
    text = F.lower(F.col(text_col))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("text") - 2))
    grams = F.array_distinct(F.transform(at, lambda i: F.substring("text", i, F.lit(3))))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).filter(F.char_length("text") >= 3).select("id", F.explode(grams).alias("gram"))


def index_candidates(index: DataFrame, query: str) -> DataFrame:
    """(id): documents that hold all trigrams of the query's terms; a superset of the phrase matches."""
    grams = sorted({t[i : i + 3] for t in query_terms(query) for i in range(len(t) - 2)})
    found = index.filter(F.col("gram").isin(*grams)) if grams else index.limit(0)
    return found.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("id")


# ---- vectors ---------------------------------------------------------------------------------


def dimension_means(vectors: DataFrame, vec_col: str, least: int = 16) -> DataFrame:
    """One row ``means``: the mean of each coordinate; null with fewer than ``least`` vectors."""
    each = vectors.filter(F.col(vec_col).isNotNull()).select(F.posexplode(F.col(vec_col).cast("array<double>")).alias("i", "x"))
    by = each.groupBy("i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    means = by.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("means"), F.max("n").alias("n"))  # a row per dimension
    return means.select(F.when(F.col("n") >= least, F.col("means")).alias("means"))


def oversample_for(k: int, wanted: int = 400) -> int:
    """How many candidates the first stage keeps for ``k`` results."""
    return min(2000, max(min(2000, max(100, wanted)), 4 * k))


def exact_search(vectors: DataFrame, id_col: str, vec_col: str, query: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    """(id, score, rank) by exact cosine; query: one row ``q``.  Vectors of another length score 0 and are left out.

    Where ``vectors`` has a column ``norm`` it is taken as the length of the vector.
    """
    one = query.limit(1).select("q", F.sqrt(V.dot("q", "q")).alias("q_norm"))
    if "norm" in vectors.columns:
        score = F.when((F.col("norm") > 0) & (F.col("q_norm") > 0), V.dot(vec_col, "q") / (F.col("norm") * F.col("q_norm"))).otherwise(0.0)
    else:
        score = V.cosine(vec_col, "q")
    hits = vectors.join(F.broadcast(one)).filter(F.size(vec_col) == F.size("q")).select(F.col(id_col).alias("id"), score.alias("score"))
    return ranked(hits.filter(F.col("score") >= min_score), k)


def batch_search(vectors: DataFrame, id_col: str, vec_col: str, queries: DataFrame, k: int, min_score: float = -1.0, *, block: int = 50_000, slice_: int = 20_000) -> DataFrame:
    """(query, id, score): for each of many queries (query, q) its ``k`` nearest by exact cosine, itself left out; ties to the smaller id.

    Rows are spread over blocks of about ``block``, queries over slices of about ``slice_``; every block meets
    every slice in a task of its own, as one matrix product, and hands on its best ``k`` of each
    query; these are merged per query, at most ``k`` a block.  For many queries on many
    rows the work is their product; nothing else grows with it.
    """
    n_blocks, n_slices = max(1, -(-vectors.count() // block)), max(1, -(-queries.count() // slice_))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    rows = vectors.select(part(id_col, n_blocks).alias("b"), every(n_slices).alias("s"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    wanted = queries.select(every(n_blocks).alias("b"), part("query", n_slices).alias("s"), F.col("query").cast("long").alias("query"), F.col("q").cast("array<float>").alias("v"))

    def nearest(left, right):
        import numpy as np
        import pyarrow as pa

        def unit(t):
            x = t.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(t.num_rows, -1)
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, names = left.column("id").to_numpy(), right.column("query").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x, q = ids[order], unit(left)[order], unit(right)
        out = []
        for a in range(0, len(q), 256):
            s = np.round(q[a : a + 256] @ x.T, 9)
            s[names[a : a + 256, None] == ids[None, :]] = -2.0
            # ids ascend, so among equal scores the first are the smaller ones
            top = np.argsort(-s, axis=1, kind="stable")[:, :k] if k * 8 > len(ids) else _top_columns(s, k)
            score = np.take_along_axis(s, top, axis=1)
            keep = score >= max(min_score, -1.5)
            out.append((np.repeat(names[a : a + 256], top.shape[1]).reshape(top.shape)[keep], ids[top][keep], score[keep]))
        query, i, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"query": query, "id": i, "score": score})

    best = rows.groupBy("b", "s").cogroup(wanted.groupBy("b", "s")).applyInArrow(nearest, "query long, id long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return best.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def _top_columns(s, k: int):
    """Columns of the ``k`` largest values of each row, equal values by column."""
    import numpy as np

    limit = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(s), k), np.int64)
    for i, row in enumerate(s):
        at = np.flatnonzero(row >= limit[i])
        out[i] = at[np.argsort(-row[at], kind="stable")[:k]]
    return out


def with_mask(vectors: DataFrame, vec_col: str, means: DataFrame | None = None) -> DataFrame:
    """The vectors with their bit mask, mean-centred if means (one row) are given: what the first stage reads."""
    if means is None:
        return vectors.withColumn("mask", V.sign_mask(vec_col))
    return vectors.join(F.broadcast(means)).withColumn("mask", V.centred_mask(vec_col, F.col("means"))).drop("means")


def two_stage_search(
    masked: DataFrame, id_col: str, vec_col: str, query: DataFrame, k: int, min_score: float = 0.0, *, oversample: int | None = None, namespace: Column | None = None
) -> DataFrame:
    """(id, score, rank): the nearest by Hamming distance of masks, rescored by exact cosine.

    ``masked`` has a ``mask``; query: one row ``q``, ``q_mask``.  ``namespace`` restricts the
    scan first.  The first stage orders ids and distances only; the vectors are
    read for its survivors alone.
    """
    rows = masked.filter(namespace) if namespace is not None else masked
    one = F.broadcast(query.limit(1))
    near = rows.select(F.col(id_col).alias("id"), "mask").join(one.select("q_mask")).select("id", V.hamming("mask", "q_mask").alias("bits"))
    kept = near.orderBy("bits", "id").limit(oversample or oversample_for(k)).select("id")
    again = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).join(F.broadcast(kept), "id", "left_semi")  # at most 2 000 ids
    hits = again.join(one.select("q")).select("id", V.cosine("vec", "q").alias("score"))
    return ranked(hits.filter(F.col("score") >= min_score), k)


def int8_search(vectors: DataFrame, id_col: str, vec_col: str, query: DataFrame, k: int, *, oversample: int = 2) -> DataFrame:
    """(id, score, rank): cosine over int8 vectors keeps ``k * oversample`` candidates, exact cosine orders them.

    Where ``vectors`` has the columns ``q8`` and ``q8_norm`` they are taken as the quantised vector and its length.
    """
    q8 = V.int8_quantize("q")
    one = F.broadcast(query.limit(1).select("q", q8.alias("qs")))
    stored = "q8" in vectors.columns
    quantised = vectors.select(F.col(id_col).alias("id"), "q8" if stored else V.int8_quantize(vec_col)["q"].alias("q8"), "q8_norm" if stored else F.lit(None).cast("double").alias("q8_norm"))
    quantised = quantised if stored else quantised.withColumn("q8_norm", F.sqrt(V.dot("q8", "q8")))
    ones = one.select(F.col("qs.q").alias("qs"))
    rough = quantised.join(ones).select("id", F.when(F.col("q8_norm") > 0, V.dot("q8", "qs") / F.col("q8_norm")).otherwise(0.0).alias("c"))  # the query's length orders nothing
    kept = rough.orderBy(F.desc("c"), "id").limit(k * oversample).select("id")
    again = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).join(F.broadcast(kept), "id", "left_semi")
    return ranked(again.join(one.select("q")).select("id", V.cosine("vec", "q").alias("score")), k)


def hash_embedding(texts: DataFrame, text_col: str, dim: int = 64, *, prefix: str = "") -> DataFrame:
    """(text_col, vec): a reproducible stand-in for an embedding model, once per different text.

    Coordinate i is (byte i mod 32 of the text's SHA-256 / 255 - 0.5) sin(i + 1), at unit length.
    """
    digest = F.sha2(F.concat(F.lit(prefix), F.col(text_col)), 256)
    at = lambda h, i: (F.conv(F.substring(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 - 0.5) * F.sin(i + 1.0)
    # a one-element array holds what must not be computed once per coordinate
    raw = F.element_at(F.transform(F.array(digest), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: at(h, i))), 1)
    return texts.select(text_col).filter(F.col(text_col).isNotNull()).distinct().withColumn("vec", V.l2_normalize(raw).cast("array<float>"))


def fingerprint_matches(stored: dict, current: dict) -> bool:
    """True if vectors of one origin may be searched with queries of the other: model, backend, quantisation, size, prefix and chunker agree."""
    return all(stored.get(k) == current.get(k) for k in ("model", "backend", "quant", "dim", "prefix", "chunker"))


# ---- fusion ----------------------------------------------------------------------------------


def rrf_fuse(lists: Sequence[DataFrame], k: int | None = 10, *, constant: int = RRF_K, base: int = 1) -> DataFrame:
    """(id, score, rank, match_type): Σ 1 / (constant + rank) over ranked lists (id, rank); rank counts from ``base``.

    match_type names the one list a hit is in (fts, vector) or hybrid.
    """
    names = ("fts", "vector")
    parts = [x.select("id", (1.0 / (constant + F.col("rank") - 1 + base)).alias("s"), F.lit(names[i] if i < len(names) else f"list{i}").alias("m")) for i, x in enumerate(lists)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    fused = whole.groupBy("id").agg(F.sum("s").alias("score"), F.when(F.count("*") > 1, "hybrid").otherwise(F.max("m")).alias("match_type"))
    return ranked(fused, k)


def mmr_select(pool: DataFrame, query_col: str, k: int, lam: float = 0.7) -> DataFrame:
    """(query, id, pick): greedy picks by relevance less similarity to what is picked, per query.

    pool: query, id, rel, vec (null: similarity 0), at most ``POOL_MOST`` rows a query;
    equal scores go to the earlier row by (rel descending, id).
    """
    lam = min(1.0, max(0.0, lam))

    def pick(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["rel", "id"], ascending=[False, True]).reset_index(drop=True)
        if len(pdf) > POOL_MOST:
            raise ValueError(f"a pool of more than {POOL_MOST} rows")
        n = len(pdf)
        unit: list = [None] * n
        for i, v in enumerate(pdf["vec"]):
            if v is not None and len(v):
                x = np.asarray(v, float)
                unit[i] = x / (np.linalg.norm(x) or 1.0)
        most = np.full(n, -1.0)
        left, out = list(range(n)), []
        while left and len(out) < k:
            s = lam * pdf["rel"].to_numpy() - (1 - lam) * most
            best = max(left, key=lambda i: (s[i], -i))
            left.remove(best)
            out.append(best)
            for i in left:
                sim = float(unit[i] @ unit[best]) if unit[i] is not None and unit[best] is not None and len(unit[i]) == len(unit[best]) else 0.0
                most[i] = max(most[i], sim)
        return pd.DataFrame({query_col: pdf[query_col].iloc[out], "id": pdf["id"].iloc[out], "pick": range(1, len(out) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in pool.schema.fields}
    return pool.groupBy(query_col).applyInPandas(pick, f"{query_col} {kinds[query_col]}, id {kinds['id']}, pick long")


def word_overlap(text: Column, words: Iterable[str]) -> Column:
    """Share of the words that the text contains."""
    words = list(words)
    if not words:
        return F.lit(0.0)
    return sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0)) / len(words)


def graph_lexical(nodes: DataFrame, query: str, *, least: int = 3) -> DataFrame:
    """(id, score): 10 for every word of the decomposed query in the label, else 1 if in the description; only hits."""
    words = [w for w in dict.fromkeys(_decomposed(query).split()) if len(w) >= least]
    if not words:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    label, text = F.lower("label"), F.lower(F.coalesce("description", F.lit("")))
    score = sum((F.when(F.contains(label, F.lit(w)), 10.0).when(F.contains(text, F.lit(w)), 1.0).otherwise(0.0) for w in words), F.lit(0.0))
    return nodes.select("id", score.alias("score")).filter("score > 0")


def _decomposed(s: str) -> str:
    import re

    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", s))
    return re.sub(r"[_. -]+", " ", s.lower()).strip()


def project_node_score(query: str) -> Column:
    """Whole query in label, decomposed label, description or path (50, 25, 20, 15), and per word 8, 3, 2, 5 for label, description, path, id."""
    q = query.lower().strip()
    label, text, path, own = F.lower("label"), F.lower(F.coalesce("description", F.lit(""))), F.lower(F.coalesce("file_path", F.lit(""))), F.col("id").cast("string")
    has = lambda c, w: F.contains(c, F.lit(w))
    score = F.when(has(label, q), 50.0).when(has(decompose_identifier("label"), q), 25.0).when(has(text, q), 20.0).when(has(path, q), 15.0).otherwise(0.0)
    for w in query_terms(query):
        score = score + F.when(has(label, w), 8.0).otherwise(0) + F.when(has(text, w), 3.0).otherwise(0) + F.when(has(path, w), 2.0).otherwise(0) + F.when(has(own, w), 5.0).otherwise(0)
    return score
