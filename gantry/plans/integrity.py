"""Queries p3 (orphan references) and p5 (hierarchies), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.operators.hierarchy import descendants, resolve_hierarchy
from gantry.operators.orphans import orphan_counts, orphan_references
from gantry.sources.tables import table

EXTERNAL = "external:"


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    edges = table(spark, folder, "graph_edges")
    ends = F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("ref")) for side, c in (("source", "source_node_id"), ("target", "target_node_id"))])
    refs = edges.select(F.col("id").alias("ref_id"), F.col("repository_id").alias("scope"), F.col("created_at").alias("at"), F.explode(ends).alias("x"))
    outside = F.col("x.ref").startswith(EXTERNAL)
    key = F.when(outside, F.substring("x.ref", len(EXTERNAL) + 1, 2**31 - 1)).otherwise(F.col("x.ref"))
    refs = refs.select("ref_id", "x.side", "scope", "at", F.when(outside, "external").otherwise("node").alias("kind"), key.alias("key"))
    nodes = table(spark, folder, "graph_nodes").select(F.col("repository_id").alias("scope"), F.lit("node").alias("kind"), F.col("node_id").alias("key"), F.col("created_at").alias("born"))
    systems = table(spark, folder, "external_systems").select(F.col("repository_id").alias("scope"), F.lit("external").alias("kind"), F.col("name").alias("key"), F.lit(None).cast("timestamp").alias("born"))
    gone = table(spark, folder, "node_removals").select(F.col("repository_id").alias("scope"), F.lit("node").alias("kind"), F.col("node_id").alias("key"), "removed_at")
    return orphan_references(refs, nodes.unionByName(systems), gone)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select(F.col("ref_id").alias("edge_id"), "side", "reason")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_counts(_orphans(spark, folder)).withColumnRenamed("scope", "repository_id")


_P3 = """
WITH refs AS (
  SELECT DISTINCT id, repository_id, created_at, side, ref FROM (
    SELECT id, repository_id, created_at, 'source' AS side, source_node_id AS ref FROM graph_edges
    UNION ALL SELECT id, repository_id, created_at, 'target', target_node_id FROM graph_edges)
  WHERE ref IS NOT NULL),
nodes AS (SELECT repository_id, node_id, min(created_at) AS born, bool_or(created_at IS NULL) AS unknown FROM graph_nodes GROUP BY ALL),
gone AS (SELECT repository_id, node_id, min(removed_at) AS removed_at FROM node_removals GROUP BY ALL),
ext AS (SELECT DISTINCT repository_id, name FROM external_systems),
judged AS (
  SELECT r.id AS edge_id, r.side, r.repository_id, r.created_at, CASE
    WHEN r.ref LIKE 'external:%' THEN CASE WHEN e.name IS NULL THEN 'missing' END
    WHEN n.node_id IS NULL THEN 'missing'
    WHEN NOT n.unknown AND n.born > r.created_at THEN 'late'
    WHEN g.removed_at <= r.created_at THEN 'deleted' END AS reason
  FROM refs r
  LEFT JOIN nodes n ON r.repository_id = n.repository_id AND r.ref = n.node_id
  LEFT JOIN gone g ON r.repository_id = g.repository_id AND r.ref = g.node_id
  LEFT JOIN ext e ON r.repository_id = e.repository_id AND r.ref = 'external:' || e.name)
"""


def _extends(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "resolved_heritage").filter("edge_type = 'extends'")
    return links.select(F.col("repository_id").alias("scope"), F.col("child_id").alias("child"), F.col("parent_id").alias("parent"))


def _hierarchy(spark: SparkSession, folder: str, with_paths: bool = False) -> DataFrame:
    return resolve_hierarchy(_extends(spark, folder), with_paths)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _hierarchy(spark, folder).select(F.col("scope").alias("repository_id"), F.col("node").alias("node_id"), "root_id", "depth")


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Full path of every type, its root and depth, and how many descendants it has."""
    return _hierarchy(spark, folder, with_paths=True).select(
        F.col("scope").alias("repository_id"), F.col("node").alias("node_id"), "root_id", "depth",
        F.array_join("path", " > ").alias("path"), (F.col("subtree_size") - 1).alias("descendants"),
    )


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """All descendants of every type, those on and below cycles included."""
    return descendants(_extends(spark, folder)).select(F.col("scope").alias("repository_id"), F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"))


_P5 = """
WITH RECURSIVE links AS (SELECT repository_id, child_id, max(parent_id) AS parent_id FROM resolved_heritage WHERE edge_type = 'extends' GROUP BY ALL),
ids AS (SELECT repository_id, child_id AS node_id FROM links UNION SELECT repository_id, parent_id FROM links WHERE parent_id IS NOT NULL),
roots AS (SELECT i.* FROM ids i LEFT JOIN links l ON i.repository_id = l.repository_id AND i.node_id = l.child_id WHERE l.parent_id IS NULL),
down AS (
  SELECT repository_id, node_id, node_id AS root_id, 0 AS depth, node_id AS path FROM roots
  UNION ALL SELECT l.repository_id, l.child_id, d.root_id, d.depth + 1, d.path || ' > ' || l.child_id FROM down d JOIN links l ON l.repository_id = d.repository_id AND l.parent_id = d.node_id)
"""

_P5_PATHS = _P5 + """, up AS (
  SELECT repository_id, node_id, node_id AS anc FROM down
  UNION ALL SELECT u.repository_id, u.node_id, l.parent_id FROM up u JOIN links l ON l.repository_id = u.repository_id AND l.child_id = u.anc WHERE l.parent_id IS NOT NULL),
below AS (SELECT repository_id, anc AS node_id, count(*) - 1 AS descendants FROM up GROUP BY ALL)
SELECT i.repository_id, i.node_id, coalesce(d.root_id, '') AS root_id, coalesce(d.depth, -1) AS depth, d.path, b.descendants
FROM ids i LEFT JOIN down d USING (repository_id, node_id) LEFT JOIN below b USING (repository_id, node_id)"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants}

SQL = {
    "p3_found": _P3 + "SELECT edge_id, side, reason FROM judged WHERE reason IS NOT NULL",
    "p3_report": _P3 + "SELECT repository_id, strftime(created_at, '%Y-%m') AS month, side, reason, count(*) AS orphans FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_found": _P5 + "SELECT i.repository_id, i.node_id, coalesce(d.root_id, '') AS root_id, coalesce(d.depth, -1) AS depth FROM ids i LEFT JOIN down d USING (repository_id, node_id)",
    "p5_paths": _P5_PATHS,
}
