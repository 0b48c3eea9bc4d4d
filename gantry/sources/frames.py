"""The canonical frames (commits, file changes, nodes, edges) as read from the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.sources.tables import table


def commits(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").cast("timestamp").alias("ts"), (F.col("o_orderpriority") == "1-URGENT").alias("is_fix"))


def changes(spark: SparkSession, folder: str, path: str = "l_partkey") -> DataFrame:
    x = table(spark, folder, "lineitem")
    return x.select(F.col("l_orderkey").alias("sha"), F.col(path).alias("path"), F.col("l_quantity").alias("added"), (F.col("l_quantity") * F.col("l_discount")).alias("deleted"), F.col("l_shipdate").cast("timestamp").alias("ts"))


def file_edges(spark: SparkSession, folder: str, *types: str) -> DataFrame:
    """Distinct edges of some types, without the rows that lack an end; scope is the repository."""
    e = table(spark, folder, "graph_edges").filter(F.col("target_node_id").isNotNull())
    if types:
        e = e.filter(F.col("edge_type").isin(*types))
    return e.select(F.col("repository_id").alias("scope"), F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"), "edge_type", "confidence", "resolution_origin").distinct()


#: The same frames as SQL.
SQL = {
    "commits": "commits AS (SELECT o_orderkey AS sha, o_custkey AS author, o_orderdate AS ts, o_orderpriority = '1-URGENT' AS is_fix FROM orders)",
    "changes": "changes AS (SELECT l_orderkey AS sha, l_partkey AS path, l_quantity AS added, l_quantity * l_discount AS deleted, l_shipdate AS ts FROM lineitem)",
    "supplies": "changes AS (SELECT l_orderkey AS sha, l_suppkey AS path, l_quantity AS added, l_quantity * l_discount AS deleted, l_shipdate AS ts FROM lineitem)",
}
