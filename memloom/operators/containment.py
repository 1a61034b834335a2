"""Which of many names texts contain, anywhere and within words too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a name that are looked for before the whole of it.
_ANCHOR = 8
#: Characters searched at once.
_SLICE = 1 << 17
#: The table of marks has 32 bits a name, between these powers of two (8 KB to 8 MB); with more names it only sifts less.
_BITS = (16, 26)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Runs:
    """Hashes of runs of characters in texts laid end to end, by sums of their codes times powers."""

    def __init__(self, texts: list[str]) -> None:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(codes * _powers(_BASE, self.n), out=self.sums[1:])
        self.inverse = _powers(pow(_BASE, -1, 2**64), self.n)

    def at(self, i: np.ndarray, m: np.ndarray | int) -> np.ndarray:
        return (self.sums[i + m] - self.sums[i]) * self.inverse[i]

    def everywhere(self, m: int) -> np.ndarray:
        return (self.sums[m:] - self.sums[: self.n + 1 - m]) * self.inverse[: self.n + 1 - m]


def _places(hashes: np.ndarray, within: np.ndarray, m: np.ndarray | int, bits: int) -> np.ndarray:
    """The bits for runs of ``m`` characters (0: the first characters of a longer name) in texts of the scope ``within``."""
    x = hashes + within + np.asarray(m).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x >> np.uint64(64 - bits)


def _slices(texts: list[str | None], longest: int) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers of texts and texts of about ``_SLICE`` characters together; long ones in parts that overlap by a name."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for r, t in enumerate(texts):
        for o in range(0, len(t or ""), _SLICE):
            rows.append(r)
            parts.append(t[o : o + _SLICE + longest - 1])
            size += len(parts[-1])
            if size >= _SLICE:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _marks(bits: int):
    def run(batches):
        for b in batches:
            names, scopes = b["name"].to_pylist(), b["scope"].to_numpy(zero_copy_only=False).view(np.uint64)
            for rows, parts in _slices(names, max(map(len, names), default=1)):
                runs, within = _Runs(parts), scopes[rows]
                long = runs.sizes >= _ANCHOR
                places = np.concatenate([_places(runs.at(runs.starts, runs.sizes), within, runs.sizes, bits), _places(runs.at(runs.starts[long], _ANCHOR), within[long], 0, bits)])
                places = np.unique(places)
                words, first = np.unique(places >> np.uint64(6), return_index=True)
                masks = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first) if len(first) else places
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(masks.view(np.int64))], ["word", "mask"])

    return run


def _search(texts: list[str | None], scopes: np.ndarray, table: np.ndarray, bits: int, lengths: list[int]) -> list[list[str]]:
    found: list[set[str]] = [set() for _ in texts]
    marked = lambda places: (table[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) > 0
    rest = [m for m in lengths if m >= _ANCHOR]
    for rows, parts in _slices(texts, lengths[-1]) if lengths else ():
        runs = _Runs(parts)
        of = np.repeat(np.arange(len(parts)), runs.sizes)
        within = scopes[rows][of]
        left = (runs.starts + runs.sizes)[of] - np.arange(runs.n)

        def take(i: np.ndarray, m: int) -> None:
            for p, at in zip(of[i].tolist(), (i - runs.starts[of[i]]).tolist()):
                found[rows[p]].add(parts[p][at : at + m])

        def begins(m: int, mark: int) -> np.ndarray:
            """Where a marked run of ``m`` characters begins that ends within its text."""
            n = max(0, runs.n + 1 - m)
            return np.flatnonzero(marked(_places(runs.everywhere(m), within[:n], mark, bits)) & (left[:n] >= m)) if n else np.zeros(0, np.int64)

        for m in lengths:
            if m < _ANCHOR:
                take(begins(m, m), m)
        hit = begins(_ANCHOR, 0) if rest else np.zeros(0, np.int64)
        for m in rest:
            hit = hit[left[hit] >= m]
            if not len(hit):
                break
            take(hit[marked(_places(runs.at(hit, m), within[hit], m, bits))], m)
    return [list(x) for x in found]


def names_within(names: DataFrame, name: str, scope: str):
    """A function of a text and a scope column: the different runs of characters in the text that may be names of the scope.

    All names of the scope that the text contains are among them, and hardly anything else: what
    isn't one drops out in a join by (scope, name).  The names are marked in a table of bits of bounded size
    that all tasks get; each text is searched where it lies, in time of its length, so
    neither texts nor their parts are shuffled.  Empty and null names are in no text.
    """
    spark = names.sparkSession
    wanted = names.filter(F.char_length(name) > 0).select(F.col(name).alias("name"), F.xxhash64(scope).alias("scope"))
    seen = wanted.agg(F.count("*").alias("n"), F.collect_set(F.char_length("name")).alias("lengths")).first()
    bits = min(max((32 * seen["n"]).bit_length(), _BITS[0]), _BITS[1])
    marks = wanted.mapInArrow(_marks(bits), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[marks["word"].to_numpy()] = marks["mask"].to_numpy().view(np.uint64)
    shared, lengths = spark.sparkContext.broadcast(table), sorted(seen["lengths"])

    @F.pandas_udf("array<string>")
    def search(texts: pd.Series, scopes: pd.Series) -> pd.Series:
        return pd.Series(_search([t if isinstance(t, str) else None for t in texts], scopes.to_numpy(np.int64).view(np.uint64), shared.value, bits, lengths))

    def of(text: Column | str, within: Column | str) -> Column:
        return search(text, F.xxhash64(within))

    return of
