"""Registration of named queries, and SQL shared by the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import vectors as V
from memloom.functions.keys import NO_VALUE_WORDS, WHITE_SPACE
from memloom.operators.vectors import usable
from memloom.session import materialize
from memloom.sources import tables

AS_OF = "2026-12-01 00:00:00"


class Catalog:
    """Queries of one module and the SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLES: dict[str, str | Callable[[], str]] = {}

    def add(self, name: str, sql: str | Callable[[], str] | None = None):
        """Registers a query and its SQL, or what makes the SQL once all modules are loaded."""

        def register(f: Callable[[SparkSession, str], DataFrame]):
            if name in self.QUERIES:
                raise ValueError(f"{name} stands twice")
            self.QUERIES[name] = f
            if sql is not None:
                self.ORACLES[name] = sql
            return f

        return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_PREPARED: dict[tuple[str, str, str], DataFrame] = {}


def prepared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that a store keeps beside its records (search columns, vectors, graph), written once per application and folder.

    The folder's tables must not change while the application runs.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PREPARED:
        df = build()
        few = df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
        _PREPARED[key], _ = materialize(df.repartition(spark.sparkContext.defaultParallelism) if few else df, name, keep=True)
    return _PREPARED[key]


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir, "nodes", lambda: tables.graph_nodes(spark, sf_dir))


def graph_edges(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    return prepared(spark, sf_dir, "edges", lambda: tables.graph_edges(spark, sf_dir, graph_nodes(spark, sf_dir)))


def live_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live memories."""
    return prepared(spark, sf_dir, "live", lambda: tables.live(read(spark, sf_dir, "memories")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the store that can be searched, with their lengths, masks and quantised forms."""

    def build() -> DataFrame:
        q8 = V.int8_quantize("embedding")["q"]
        found = live_memories(spark, sf_dir).filter(usable("embedding"))
        found = found.select("mem_id", "embedding", "project_id", F.sqrt(V.dot("embedding", "embedding")).alias("norm"), V.sign_mask("embedding").alias("mask"), q8.alias("q8"))
        return found.withColumn("q8_norm", F.sqrt(V.dot("q8", "q8")))

    return prepared(spark, sf_dir, "vectors", build)


WS = "'" + WHITE_SPACE + "'"


def sql_trim(c: str) -> str:
    return f"trim({c}, {WS})"


def sql_value(c: str) -> str:
    """True where a column holds a value."""
    words = ", ".join(f"'{w}'" for w in NO_VALUE_WORDS)
    return f"coalesce({sql_trim(c)} <> '' AND lower({sql_trim(c)}) NOT IN ({words}), false)"


def sql_unit(c: str) -> str:
    """The number where it lies in 0..1, else null."""
    return f"CASE WHEN NOT isnan({c}) AND {c} BETWEEN 0 AND 1 THEN {c} END"


def sql_cos(a: str, b: str) -> str:
    """Cosine of two float lists in double; 0 for a zero norm."""
    return (
        f"CASE WHEN list_dot_product({a}::double[], {a}::double[]) > 0 AND list_dot_product({b}::double[], {b}::double[]) > 0 "
        f"THEN list_dot_product({a}::double[], {b}::double[]) / sqrt(list_dot_product({a}::double[], {a}::double[]) * list_dot_product({b}::double[], {b}::double[])) ELSE 0 END"
    )


#: A vector of 64 finite values, not all zero.
SQL_USABLE = "(embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"

#: Live memories as graph nodes, and live links between them as labelled edges.
SQL_GRAPH = f"""
nodes AS (
  SELECT mem_id AS id, mem_key AS label, CASE WHEN {sql_value('category')} THEN lower({sql_trim('category')}) ELSE 'general' END AS node_type, content AS description,
         CASE WHEN {sql_value('project_id')} THEN {sql_trim('project_id')} ELSE 'none' END AS project_id, coalesce({sql_unit('trust')}, 0.5) AS trust,
         coalesce({sql_unit('importance')}, 0.5) AS importance, access_count, updated_at,
         (CASE WHEN {sql_value('project_id')} THEN {sql_trim('project_id')} ELSE 'none' END) || '/' || (CASE WHEN {sql_value('source')} THEN lower({sql_trim('source')}) ELSE 'none' END) AS file_path
  FROM memories WHERE deleted_at IS NULL
),
edges AS (
  SELECT from_id AS src, to_id AS dst, lower({sql_trim('kind')}) AS label, max(coalesce(weight, 0.5)) AS weight, count(*) AS seen
  FROM memory_links WHERE deleted_at IS NULL AND from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT id FROM nodes)
  GROUP BY ALL
)"""
