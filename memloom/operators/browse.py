"""Filters, facets and counts over records and graphs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows equal to every parameter that isn't None; nothing is put into the plan for the others."""
    for c, v in wanted.items():
        if v is not None:
            df = df.filter(F.col(c) == F.lit(v))
    return df


def browse(records: DataFrame, *, query: str | None = None, least_trust: float | None = None, limit: int = 50, **equal: object) -> DataFrame:
    """Records by query (in content or key), facets and trust, most important and latest first."""
    df = where_given(records, equal)
    if least_trust is not None:
        df = df.filter(F.col("trust") >= least_trust)
    if query:
        q = F.lit(query.lower())
        df = df.filter(F.contains(F.lower(F.coalesce("content", F.lit(""))), q) | F.contains(F.lower("mem_key"), q))
    return df.orderBy(F.desc_nulls_last("importance"), F.desc_nulls_last("updated_at"), "mem_key").limit(limit)


def author_allows(meta: Column | str, wanted: str | None) -> Column:
    """True if the record names no author or the wanted one; broken JSON names none."""
    if wanted is None:
        return F.lit(True)
    c = F.col(meta) if isinstance(meta, str) else meta
    author = F.try_variant_get(F.try_parse_json(c), "$.author", "string")
    return author.isNull() | (author == wanted)


def valid_slot_label(label: Column | str) -> Column:
    """A small Latin letter first, then small letters, digits and underscores, at most 64."""
    c = F.col(label) if isinstance(label, str) else label
    return F.coalesce(c.rlike("^[a-z][a-z0-9_]{0,63}$"), F.lit(False))


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    """The different values of a column that are neither null nor empty."""
    return df.select(c).filter(F.col(c).isNotNull() & (F.col(c) != "")).distinct()


def top_counts(df: DataFrame, c: Column, name: str, n: int | None, instead: str | None = None) -> DataFrame:
    """(name, n) by count, then name, the first ``n``; nulls under another word if given."""
    c = F.coalesce(c, F.lit(instead)) if instead is not None else c
    counts = df.groupBy(c.alias(name)).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), name).limit(n) if n is not None else counts


def degree_capped_subgraph(edges: DataFrame, degrees: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The ``n`` nodes of highest degree (ties to the smaller id) and the edges among them."""
    top = degrees.orderBy(F.desc("degree"), "id").limit(n).select("id", "degree")
    inside = edges.join(top.select(F.col("id").alias("src")), "src", "left_semi").join(top.select(F.col("id").alias("dst")), "dst", "left_semi")
    return top, inside


def mentioned_labels(texts: DataFrame, labels: DataFrame, *, least: int = 4, most: int = 400) -> DataFrame:
    """(doc, label): labels of at least ``least`` characters that stand as words in a text.

    Texts are split into words that are joined with the labels by equality; up to
    ``most`` labels a text, in order.
    """
    words = F.array_distinct(F.split("text", r"[^\p{L}\p{N}_.:-]+"))
    each = texts.select("doc", F.explode(words).alias("label")).filter(F.char_length("label") >= least)
    found = each.join(labels.select("label").distinct(), "label")
    order = Window.partitionBy("doc").orderBy("label")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("doc", "label")


def telemetry_fold(records: DataFrame, hits: DataFrame, id_col: str, count: str) -> DataFrame:
    """Records with their buffered hits (id, ts) added to the count, and the last hit's time."""
    sums = hits.groupBy("id").agg(F.count("*").alias("more"), F.max("ts").alias("last_hit"))
    out = records.join(sums, F.col(id_col) == F.col("id"), "left").drop("id")
    return out.withColumn(count, F.col(count) + F.coalesce("more", F.lit(0))).drop("more")


def stage_latency(samples: DataFrame) -> DataFrame:
    """(stage, total_us, n) of timed samples (stage, us)."""
    return samples.groupBy("stage").agg(F.sum("us").alias("total_us"), F.count("*").alias("n"))
