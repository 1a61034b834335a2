"""Which vectors can be compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: Column | str, dim: int = 64) -> Column:
    """True for a vector of ``dim`` finite values, not all zero; never null."""
    v = F.col(vec) if isinstance(vec, str) else vec
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
