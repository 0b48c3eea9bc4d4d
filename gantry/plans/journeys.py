"""Queries for walks over graph, files and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gantry.operators import code as C
from gantry.operators import journeys as J
from gantry.operators import summary as S
from gantry.operators.graph import degrees
from gantry.plans import code as P
from gantry.plans.graph import _reach_sql
from gantry.plans.views import _FILES, _edges, _entries, _files, _imports
from gantry.session import Scratch
from gantry.sources.formats import contract_links as link
from gantry.sources.formats import endpoints
from gantry.sources.tables import table


def reach_to_packages(spark, folder):
    """Files that reach an external package within three imports."""
    e = _imports(spark, folder)
    return J.reach_to_sinks(e, e.filter("dst like 'external:%'").select("scope", F.col("dst").alias("node")))


def impact_surface(spark, folder):
    """The most affected dependents of the removed files."""
    gone = table(spark, folder, "node_removals").filter("node_id not like '%::%'").select(F.col("repository_id").alias("scope"), F.col("node_id").alias("node")).distinct()
    return J.impact_surface(_imports(spark, folder), gone, _files(spark, folder))


def guided_tour(spark, folder):
    return J.guided_tour(_imports(spark, folder), _entries(spark, folder))


def package_blast(spark, folder):
    e = table(spark, folder, "graph_edges").filter("target_node_id like 'external:%'").select(F.col("repository_id").alias("scope"), F.col("source_node_id").alias("src"), F.expr("substring(target_node_id, 10)").alias("package"), "confidence").distinct()
    return J.package_blast(e)


def backlinks(spark, folder):
    d = table(spark, folder, "documents").select(F.col("repository_id").alias("scope"), F.col("target_path").alias("node"))
    n, r = (table(spark, folder, t).select(F.col("repository_id").alias("scope"), F.col("node_id").alias("node")) for t in ("graph_nodes", "node_removals"))
    return J.backlinks(d, n, r)


def code_health(spark, folder):
    """Scores from the syntax of the files, their clones and what their functions do in loops."""
    scratch = Scratch(spark, "health")
    files = table(spark, folder, "source_text")
    facts = scratch.write(C.code_facts(files))
    nodes = table(spark, folder, "graph_nodes").filter("node_type = 'file'")
    calls = table(spark, folder, "graph_edges").filter("edge_type = 'calls' and target_node_id is not null").select("repository_id", F.col("target_node_id").alias("callee"))
    found = C.structural_findings(facts, nodes, calls).unionByName(C.performance_findings(facts))
    return J.code_health(found, scratch.write(P.duplication(spark, folder)), facts.select("repository_id", "node_id"))


def refactoring_queue(spark, folder):
    """Files by what mending them is worth: lines, dependents and code health."""
    lines = P.duplication(spark, folder).select("repository_id", "node_id", F.col("nloc").alias("lines"))
    used = degrees(_imports(spark, folder)).select(F.col("scope").alias("repository_id"), F.col("node").alias("node_id"), F.col("in_degree").alias("dependents"))
    wide = code_health(spark, folder).join(lines, ["repository_id", "node_id"]).join(used, ["repository_id", "node_id"], "left").fillna(0, ["dependents"])
    return S.priorities(wide.withColumn("path", F.concat_ws(":", "repository_id", "node_id")))


def contract_links(spark, folder):
    """Calls of HTTP routes in the files of one repository and the files of others that serve them."""
    t = C.latest(table(spark, folder, "source_text"))
    found = endpoints(t.withColumn("path", F.concat_ws(":", "repository_id", "node_id")))
    return link(found.withColumn("scope", F.substring_index("path", ":", 1)))


QUERIES = {q.__name__: q for q in (reach_to_packages, impact_surface, guided_tour, package_blast, backlinks, code_health, refactoring_queue, contract_links)}

SQL = {
    "reach_to_packages": _reach_sql("SELECT DISTINCT scope, '' AS seed, dst AS node, 0 AS hops FROM edges WHERE dst LIKE 'external:%'", 3, True) + " SELECT scope, node, hops FROM reached",
    "impact_surface": _reach_sql("SELECT DISTINCT repository_id AS scope, node_id AS seed, node_id AS node, 0 AS hops FROM node_removals WHERE node_id NOT LIKE '%::%'", 2, True) + f", {_FILES}, k AS (SELECT r.*, row_number() OVER (PARTITION BY r.scope, seed ORDER BY coalesce(rank, 0) DESC, r.node) AS place FROM reached r LEFT JOIN f ON f.scope = r.scope AND f.node = r.node WHERE r.node <> r.seed) SELECT scope, seed, node, place FROM k WHERE place <= 3",
    "package_blast": "WITH u AS (SELECT DISTINCT repository_id AS scope, source_node_id AS src, substr(target_node_id, 10) AS package, confidence FROM graph_edges WHERE target_node_id LIKE 'external:%'), b AS (SELECT package, scope, count(DISTINCT src) AS files, max(confidence) AS sure FROM u GROUP BY ALL) SELECT package, count(*) AS repositories, sum(files)::BIGINT AS files, round(sum(coalesce(sure, 0) * 0.6), 6) AS score FROM b GROUP BY ALL",
    "backlinks": "WITH c AS (SELECT repository_id AS scope, target_path AS node, count(*) AS texts FROM documents WHERE target_path IS NOT NULL AND repository_id IS NOT NULL GROUP BY ALL) SELECT c.*, CASE WHEN (scope, node) IN (SELECT (repository_id, node_id) FROM node_removals) THEN 'removed' WHEN (scope, node) IN (SELECT (repository_id, node_id) FROM graph_nodes) THEN 'live' ELSE 'missing' END AS state FROM c",
    "guided_tour": f"WITH RECURSIVE {_edges('imports')}, {_FILES}, walk AS (SELECT scope, node, 0 AS hops FROM f WHERE entry UNION SELECT w.scope, e.dst, w.hops + 1 FROM walk w JOIN e ON e.scope = w.scope AND e.src = w.node WHERE w.hops < 40), d AS (SELECT scope, node, min(hops)::INT AS depth FROM walk GROUP BY ALL), i AS (SELECT scope, dst AS node, count(*) AS n FROM e GROUP BY ALL) SELECT d.scope, d.node, depth, row_number() OVER (PARTITION BY d.scope ORDER BY depth, coalesce(n, 0) DESC, d.node) AS stop FROM d LEFT JOIN i ON i.scope = d.scope AND i.node = d.node",
}
