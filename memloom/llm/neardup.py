"""Near-duplicate texts by word-set similarity, over deletion-variant signatures.

Each word set is described by minhash components, cut into segments.  A pair as
similar as asked for seldom agrees in a whole segment but nearly surely has one
segment in which at most one component differs; so each segment is indexed
under its variants with one component deleted, and an equality join of the
variants brings the pair together.  What meets is pruned by a 192-bit sketch and
then verified exactly on the words.

With 9 segments of 4 components a pair of similarity 0.6 meets with probability
0.997 and passes the sketch with 0.998; at 0.75 both round to 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators.collisions import colliding_pairs, in_sample, split_hot_keys
from memloom.operators.ordering import partitions_for
from memloom.llm.components import connected_components
from memloom.session import materialize, release

SEGMENTS = 9
COMPONENTS = 4
#: How many of the first 128, and of all 192, sketch bits may differ.
SKETCH_BITS_MOST = ((2, 39), (3, 55))
_WORDS = 3
_ROWS = "key long, id long, " + ", ".join(f"s{i} long" for i in range(_WORDS))
_NOT_WORD = r"[^\p{L}\p{N}]+"


def distinct_words(text: Column | str) -> Column:
    """The distinct maximal runs of letters and digits, lower-cased; empty for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.array_remove(F.array_distinct(F.split(F.lower(c), _NOT_WORD)), ""), F.array().cast("array<string>"))


def _signer(segments: int, components: int):
    def sign(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from memloom.operators.collisions import mix64

        n_key = segments * components
        seeds = np.random.default_rng(20_260_101).integers(1, 2**63, (n_key + 64 * _WORDS, 2), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            words = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sizes = np.asarray(lists.value_lengths())
            start = np.append(0, np.cumsum(sizes)[:-1])
            hashed = mix64(words * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
            low = lambda i: np.minimum.reduceat((hashed ^ seeds[i, 0]) * seeds[i, 1], start)  # noqa: E731, B023
            sketch = np.zeros((_WORDS, len(ids)), np.uint64)
            for i in range(64 * _WORDS):
                sketch[i // 64] |= (mix64(low(n_key + i)) >> np.uint64(63)) << np.uint64(i % 64)
            keys = []
            for s in range(segments):
                parts = [mix64(low(s * components + c) + np.uint64(c + 1)) for c in range(components)]
                whole = sum(parts[1:], parts[0])
                for c in range(components):
                    keys.append(mix64((whole - parts[c]) ^ mix64(np.full(1, s * components + c + 1, np.uint64))))
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.tile(ids, n)),
                    *[pa.array(np.tile(w, n).view(np.int64)) for w in sketch],
                ],
                names=["key", "id", *(f"s{i}" for i in range(_WORDS))],
            )

    return sign


def near_duplicate_classes(records: DataFrame, id_col: str, text_col: str, *, least_words: int = 12) -> DataFrame:
    """(id, h1, h2) of the records with enough distinct words; equal (h1, h2): the same word set."""
    words = F.array_sort(F.col("words"))
    return (
        records.select(F.col(f"`{id_col}`").cast("long").alias("id"), distinct_words(F.col(f"`{text_col}`")).alias("words"))
        .filter((F.size("words") >= least_words) & F.col("id").isNotNull())
        .select("id", "words", F.xxhash64(words).alias("h1"), F.xxhash64(F.lit(7), words).alias("h2"))
    )


def near_duplicates(
    records: DataFrame, id_col: str, text_col: str, *, similarity: float = 0.6, least_words: int = 12,
    segments: int = SEGMENTS, components: int = COMPONENTS, sketch_bits: tuple[tuple[int, int], ...] = SKETCH_BITS_MOST,
) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a, b, shared, either) and membership (id, rep).

    A class are the records with the same word set, named by its smallest id; a
    and b are such names, a < b, with shared / either >= ``similarity``.  Null and
    blank texts, and those with fewer than ``least_words`` distinct words, are in
    no class.  Rows with the same id count once each; the id must be an integer.
    The parameters of the signatures suit similarities of 0.6 and more.
    """
    described = near_duplicate_classes(records, id_col, text_col, least_words=least_words)
    numbers = F.transform("words", lambda w: F.hash(w))
    reps, _ = materialize(
        described.select("id", "h1", "h2", numbers.alias("w")).groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min_by("w", "id").alias("w")),
        "reps",
    )
    n = reps.count()
    sign = lambda df: df.select("rep", "w").mapInArrow(_signer(segments, components), _ROWS)
    rows = split_hot_keys(sign(reps), sign(reps.filter(in_sample("rep"))))
    parts = partitions_for(records.sparkSession, n * segments * components)
    met, met_path = materialize(colliding_pairs(rows, sketch_bits, partitions=parts), "met")
    # first on word numbers, which are short; one word is allowed for equal numbers of different words
    numbered = met.join(reps.select(F.col("rep").alias("a"), F.col("w").alias("wa")), "a").join(reps.select(F.col("rep").alias("b"), F.col("w").alias("wb")), "b")
    alike = F.size(F.array_intersect("wa", "wb")) + 1
    near, _ = materialize(numbered.filter(alike >= (F.size("wa") + F.size("wb") - alike) * similarity - 1e-9).select("a", "b"), "near")
    release(records.sparkSession, met_path)
    ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    words = described.select("id", "words").join(ids, "id", "left_semi").dropDuplicates(["id"])
    words, _ = materialize(words, "words")
    both = near.join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(
        words.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b"
    )
    shared = F.size(F.array_intersect("wa", "wb"))
    pairs = both.select("a", "b", shared.alias("shared"), (F.size("wa") + F.size("wb")).alias("sum")).select(
        "a", "b", "shared", (F.col("sum") - F.col("shared")).alias("either")
    )
    pairs = pairs.filter(F.col("shared") >= F.col("either") * similarity - 1e-9)
    members = described.select("id", "h1", "h2").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep")
    return pairs, members


def duplicate_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of records (a < b): the classes' pairs and the copies within a class, written out."""
    own = members.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("rep").alias("x"), F.col("rep").alias("y"))
    links = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(own)
    out = links.join(members.select(F.col("id").alias("i"), F.col("rep").alias("x")), "x").join(
        members.select(F.col("id").alias("j"), F.col("rep").alias("y")), "y"
    )
    out = out.filter((F.col("x") != F.col("y")) | (F.col("i") < F.col("j")))
    return out.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def duplicate_groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record in a class: id, rep (its class), group_id (all classes linked directly or not), links of its class."""
    groups = connected_components(pairs, "a", "b", node="rep", component="group_id")
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return (
        members.join(groups, "rep", "left").join(links, "rep", "left")
        .select("id", "rep", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    )
