"""Sinks: tables replaced by scope, rows added once, exports, and checks between stores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_scope(df: DataFrame, path: str, scope: str) -> None:
    """Replaces the partitions of the scopes that df has and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)


def add_once(new: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Appends the rows whose keys the table doesn't have yet, one a key, and gives them; nulls are keys like any other.

    The rows to add are written aside first, so that what is counted is what was added.
    """
    spark = new.sparkSession
    once = new.dropDuplicates(keys)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        same = F.lit(True)
        for k in keys:
            same &= F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
        once = once.alias("n").join(spark.read.parquet(path).select(*keys).distinct().alias("o"), same, "left_anti")
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    once.write.parquet(aside)
    added = spark.read.schema(new.schema).parquet(aside)
    added.write.mode("append").parquet(path)
    return added


def swap(frames: dict[str, DataFrame], root: str) -> str:
    """Writes several tables to a new version of a folder and only then names it the current one; a failure leaves the old version current."""
    version = uuid.uuid4().hex
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        df.write.parquet(f"{root.rstrip('/')}/{version}/{name}.parquet")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/CURRENT")
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current version."""
    version = spark.read.text(f"{root.rstrip('/')}/CURRENT").first()["value"]
    return spark.read.parquet(f"{root.rstrip('/')}/{version}/{name}.parquet")


def drift(counts: DataFrame) -> DataFrame:
    """population, a, b, drift of counts(population, a, b): |a - b| as a share of a, at least 1."""
    return counts.select("population", "a", "b", F.round(F.abs(F.col("a") - F.col("b")) / F.greatest("a", F.lit(1)), 6).alias("drift"))


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """value: a graph as JSON lines, nodes as {"id": ...} and edges as {"source": ..., "target": ...}, with their other columns."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), *nodes.columns)).alias("value"))
    return n.unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), *edges.columns)).alias("value")))


def mermaid(edges: DataFrame) -> DataFrame:
    """value: the lines of a diagram of edges(a, b), in order; meant for graphs of containers, not of files."""
    clean = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9]+", "_")
    body = edges.select("a", "b").distinct().orderBy("a", "b").select(F.concat(F.lit("  "), clean("a"), F.lit(" --> "), clean("b")).alias("value"))
    return edges.sparkSession.createDataFrame([("graph LR",)], "value string").unionByName(body)


def upsert_vectors(new: DataFrame, path: str, key: str = "id", buckets: int = 64) -> None:
    """Keeps one vector a key, the new one where both have it; only the buckets of new keys are rewritten."""
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    fresh = new.dropDuplicates([key]).select("*", bucket)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets` rows
        old = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
        fresh = old.join(fresh.select(key), key, "left_anti").select(*fresh.columns).unionByName(fresh)
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    fresh.write.parquet(aside)
    replace_scope(spark.read.schema(fresh.schema).parquet(aside), path, "bucket")
