"""Adapters: the test tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.keys import has_value, trimmed, unit_interval


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cleaned(c: str, instead: str, *, lower: bool = False) -> Column:
    """The trimmed value of a column, or another word where it has none."""
    v = F.lower(trimmed(c)) if lower else trimmed(c)
    return F.when(has_value(c), v).otherwise(F.lit(instead))


def live(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live memories as nodes: id, label, node_type, description, project_id, trust, importance, access_count, updated_at, file_path."""
    project = cleaned("project_id", "none")
    return live(table(spark, sf_dir, "memories")).select(
        F.col("mem_id").alias("id"),
        F.col("mem_key").alias("label"),
        cleaned("category", "general", lower=True).alias("node_type"),
        F.col("content").alias("description"),
        project.alias("project_id"),
        F.coalesce(unit_interval("trust"), F.lit(0.5)).alias("trust"),
        F.coalesce(unit_interval("importance"), F.lit(0.5)).alias("importance"),
        "access_count",
        "updated_at",
        F.concat_ws("/", project, cleaned("source", "none", lower=True)).alias("file_path"),
    )


def graph_edges(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    """Live links with both ends live, one row per (src, dst, label): weight, seen."""
    ids = (nodes if nodes is not None else graph_nodes(spark, sf_dir)).select("id")
    links = live(table(spark, sf_dir, "memory_links")).select(
        F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lower(trimmed("kind")).alias("label"), F.coalesce("weight", F.lit(0.5)).alias("weight")
    )
    edges = links.groupBy("src", "dst", "label").agg(F.max("weight").alias("weight"), F.count("*").alias("seen"))
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "label", "weight", "seen")
