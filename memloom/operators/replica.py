"""Replicas: last-writer-wins merge, bundles, checksums, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_bundle(relations: dict[str, DataFrame], watermark: str) -> DataFrame:
    """Rows of all relations changed or deleted since the watermark, as one typed table (``row_type`` and all columns)."""
    since = F.lit(watermark).cast("timestamp")
    out = None
    for name, df in relations.items():
        times = [F.col(c) for c in ("updated_at", "deleted_at") if c in df.columns] or [F.col("created_at")]
        latest = F.greatest(*times, F.lit(None).cast("timestamp")) if len(times) == 1 else F.greatest(*times)
        part = df.filter(latest >= since).withColumn("row_type", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no relations")
    return out


def lww_merge(local: DataFrame, incoming: DataFrame, key: str, updated: str, rank: Column | str, values: list[str]) -> DataFrame:
    """One row per key with the latest values and ``won`` (local or incoming).

    Later ``updated`` wins; on equal times the smaller rank, then the incoming row.
    Null times are oldest.  A maximum over structs, so that hot keys are pre-aggregated.
    """
    rank = F.col(rank) if isinstance(rank, str) else rank
    tag = lambda df, side: df.select(key, F.struct(F.coalesce(F.unix_micros(F.col(updated)), F.lit(-(2**62))).alias("u"), (-rank).alias("r"), F.lit(side).alias("w"), *values).alias("s"))
    both = tag(local, 0).unionByName(tag(incoming, 1))
    best = both.groupBy(key).agg(F.max_by("s", F.struct("s.u", "s.r", "s.w")).alias("s"))
    return best.select(key, *[f"s.{v}" for v in values], F.when(F.col("s.w") == 1, "incoming").otherwise("local").alias("won"))


def merge_journal(local: DataFrame, incoming: DataFrame, key: str, updated: str, content: str) -> DataFrame:
    """(key, lost, kept): the contents of the losing side where both sides have a key with different contents; equal times lose locally."""
    a = local.select(key, F.col(content).alias("c_local"), F.col(updated).alias("u_local"))
    b = incoming.select(key, F.col(content).alias("c_in"), F.col(updated).alias("u_in"))
    j = a.join(b, key).filter(~F.col("c_local").eqNullSafe(F.col("c_in")))
    wins = F.coalesce(F.col("u_in") >= F.col("u_local"), F.col("u_local").isNull())
    return j.select(key, F.when(wins, F.col("c_local")).otherwise(F.col("c_in")).alias("lost"), F.when(wins, F.col("c_in")).otherwise(F.col("c_local")).alias("kept"))


def once_per_bundle(rows: DataFrame, bundle: str, applied: DataFrame | None = None) -> DataFrame:
    """Rows of bundles that were not applied before, repeated deliveries of a row dropped."""
    fresh = rows.join(applied.select(bundle).distinct(), bundle, "left_anti") if applied is not None else rows
    return fresh.distinct()


def checksum(rows: DataFrame, *columns: Column) -> DataFrame:
    """One row ``checksum``: XOR over the rows of the first 8 bytes of SHA-256 of the columns joined by bars; order doesn't matter."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)
    # two halves of 32 bits, as a signed 64-bit number can't be read from 16 hex digits directly
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return rows.agg(F.bit_xor(half(1)).alias("h"), F.bit_xor(half(9)).alias("l")).select(F.coalesce("h", F.lit(0)).alias("high"), F.coalesce("l", F.lit(0)).alias("low"))


def compare_stats(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(field, same): field-wise equality of two one-row tables of numbers."""
    fields = local.columns
    joined = local.select(F.struct(*fields).alias("a")).join(remote.select(F.struct(*fields).alias("b")))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")).alias("same")) for f in fields])
    return joined.select(F.explode(rows).alias("r")).select("r.*")
