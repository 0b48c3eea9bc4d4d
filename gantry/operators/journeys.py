"""Walks that join graph, files and texts: reach of sinks, impact, tours, package blast, backlinks, code health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.operators import graph as G
from gantry.operators.health import band, health_scores
from gantry.operators.skew import distributed_rank, lookup

#: What a hop of a change between repositories is worth, and nodes named as most affected.
HOP_FACTOR, MOST_AFFECTED = 0.6, 3


def reach_to_sinks(edges: DataFrame, sinks: DataFrame, depth: int = 3) -> DataFrame:
    """scope, node, hops: the least number of steps from a node to any of sinks(scope, node), up to `depth`."""
    seeds = sinks.select("scope", F.lit("").alias("seed"), "node").distinct()
    return G.reach(seeds, edges, depth, backward=True).filter("hops > 0").select("scope", "node", "hops")


def impact_surface(edges: DataFrame, changed: DataFrame, ranks: DataFrame) -> DataFrame:
    """scope, seed, node, place: of the nodes that depend on a changed node within two steps, the three of the greatest rank, ties by name."""
    near = G.reach(changed.select("scope", F.col("node").alias("seed"), "node"), edges, 2, backward=True).filter("hops > 0")
    known = lookup(near, ranks.select("scope", "node", "rank"), ["scope", "node"]).fillna(0.0, ["rank"])
    placed = distributed_rank(known, ["scope", "seed"], [F.col("rank").desc(), F.col("node")], "place")
    return placed.filter(F.col("place") <= MOST_AFFECTED).select("scope", "seed", "node", "place")


def guided_tour(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """scope, node, depth, stop: nodes that the entry points lead to, nearest first, the most used first among equals."""
    depth = G.reach(entries.select("scope", F.lit("").alias("seed"), "node"), edges, None).groupBy("scope", "node").agg(F.min("hops").alias("depth"))
    used = G.degrees(edges).select("scope", "node", "in_degree")
    known = lookup(depth, used, ["scope", "node"]).fillna(0, ["in_degree"])
    return distributed_rank(known, ["scope"], [F.col("depth"), F.col("in_degree").desc(), F.col("node")], "stop").select("scope", "node", "depth", "stop")


def package_blast(uses: DataFrame) -> DataFrame:
    """package, repositories, files, score of uses(scope, src, package, confidence): what a change of a package reaches, each repository by its surest use."""
    by = uses.groupBy("package", "scope").agg(F.count_distinct("src").alias("files"), F.max("confidence").alias("sure"))
    return by.groupBy("package").agg(F.count(F.lit(1)).alias("repositories"), F.sum("files").alias("files"), F.round(F.sum(F.coalesce("sure", F.lit(0.0)) * HOP_FACTOR), 6).alias("score"))


def backlinks(docs: DataFrame, nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """scope, node, texts, state of docs(scope, node): what texts point at, and whether it exists, was removed or never was."""
    counts = docs.filter("node is not null and scope is not null").groupBy("scope", "node").agg(F.count(F.lit(1)).alias("texts"))
    known = nodes.select("scope", "node").distinct().withColumn("known", F.lit(True))
    gone = removed.select("scope", "node").distinct().withColumn("gone", F.lit(True))
    state = F.when(F.col("gone"), "removed").when(F.col("known"), "live").otherwise("missing")
    return counts.join(known, ["scope", "node"], "left").join(gone, ["scope", "node"], "left").select("scope", "node", "texts", state.alias("state"))


def code_health(findings: DataFrame, clones: DataFrame, files: DataFrame) -> DataFrame:
    """repository_id, node_id, findings, dup_pct, score, band: the health of files by what their code shows.

    findings(repository_id, node_id, finding, severity); clones as of `duplication`: 8 % or more in
    stretches of six lines or more are a finding of their own. Files without findings score 10.
    """
    path = F.concat_ws("\0", "repository_id", "node_id").alias("path")
    dry = clones.filter("dup_pct >= 8 and clone_lines >= 6").select(path, F.lit("dry_violation").alias("finding"), F.when(F.col("dup_pct") >= 25, "medium").otherwise("low").alias("severity"))
    every = findings.select(path, "finding", "severity").unionByName(dry)
    scored = health_scores(every, files.select(path)).join(every.groupBy("path").agg(F.count(F.lit(1)).alias("findings")), "path", "left").fillna(0, ["findings"])
    keyed = files.select("repository_id", "node_id", path).distinct().join(scored, "path").join(clones.select("repository_id", "node_id", "dup_pct"), ["repository_id", "node_id"], "left")
    return keyed.select("repository_id", "node_id", "findings", "dup_pct", "score", band(F.col("score")).alias("band"))
