"""Vector expressions: cosine, quantised forms, bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in double; 0 for unequal lengths, empty vectors and zero norms."""
    norms = dot(a, a) * dot(b, b)
    return F.when((F.size(_d(a)) == F.size(_d(b))) & (norms > 0), dot(a, b) / F.sqrt(norms)).otherwise(0.0)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not again for every element of an inner lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def l2_normalize(v: Column | str) -> Column:
    """The vector at unit length; a zero vector stays."""
    parts = F.struct(_d(v).alias("v"), F.sqrt(dot(v, v)).alias("n"))
    return _once(parts, lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))


def int8_quantize(v: Column | str) -> Column:
    """(scale, q): q = v / scale rounded half away from zero within -127..127, scale = max |v| / 127 or 1."""
    top = F.greatest(F.array_max(_d(v)), -F.array_min(_d(v)))
    parts = F.struct(_d(v).alias("v"), F.when(top > 0, top / 127.0).otherwise(1.0).alias("scale"))
    return _once(
        parts,
        lambda s: F.struct(
            s["scale"].cast("float").alias("scale"), F.transform(s["v"], lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / s["scale"]))).cast("byte")).alias("q")
        ),
    )


def int8_restore(s: Column | str) -> Column:
    c = F.col(s) if isinstance(s, str) else s
    return F.transform(c["q"], lambda x: (x * c["scale"]).cast("float"))


def _words(bits: Column) -> Column:
    """Booleans as 64-bit words, bit i of a word for the i-th of its 64 values."""
    n = F.ceil(F.size(bits) / 64).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda w: F.aggregate(
            F.transform(F.slice(bits, w * 64 + 1, 64), lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
            F.lit(0).cast("long"),
            lambda s, x: s.bitwiseOR(x),
        ),
    )


def centred_mask(v: Column | str, means: Column | None = None) -> Column:
    """Bit i set where v[i] is above the mean of its dimension, or above the vector's own mean if ``means`` is not given or does not fit."""
    parts = F.struct(_d(v).alias("v"), (F.aggregate(_d(v), F.lit(0.0), lambda s, x: s + x) / F.size(_d(v))).alias("mean"))
    by_own = _once(parts, lambda s: F.transform(s["v"], lambda x: x > s["mean"]))
    if means is None:
        return _words(by_own)
    return F.when(F.size(means) == F.size(_d(v)), _words(F.zip_with(_d(v), means, lambda x, m: x > m))).otherwise(_words(by_own))


def sign_mask(v: Column | str) -> Column:
    """Bit i set where v[i] is positive."""
    return _words(F.transform(_d(v), lambda x: x > 0))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Bits in which two masks differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty arrays."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def key_tokens(key: Column | str) -> Column:
    """The distinct parts of a key between ``-``, ``/`` and ``_``, lower-cased."""
    c = F.col(key) if isinstance(key, str) else key
    return F.array_remove(F.array_distinct(F.split(F.lower(c), "[-/_]+")), "")
