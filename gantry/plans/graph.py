"""Graph queries over the edges of each repository, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gantry.operators import graph as G
from gantry.sources.frames import SQL as FRAMES
from gantry.sources.frames import changes, commits, file_edges
from gantry.sources.tables import table

FOLDER = r"^([^/]+(?:/[^/]+)?)/"
RULES = [("no_app_from_libs", "^libs/", "^app/"), ("no_tests_from_src", "^(src|app|libs)/", r"^tests/")]


def _imports(spark, folder):
    return file_edges(spark, folder, "imports")


def _calls(spark, folder):
    return G.walkable(file_edges(spark, folder, "calls"))


def _nodes(spark, folder, kind):
    n = table(spark, folder, "graph_nodes").filter(F.col("node_type") == kind)
    return n.groupBy(F.col("repository_id").alias("scope"), F.col("node_id").alias("node")).agg(F.max("visibility").alias("visibility"), F.max("name").alias("name"), F.bool_or("is_entry_point").alias("is_entry_point"), F.bool_or("is_test").alias("is_test"))


def _groups(spark, folder):
    return G.nodes_of(_imports(spark, folder)).withColumn("group", F.regexp_extract("node", FOLDER, 1))


def degrees(spark, folder):
    return G.degrees(_imports(spark, folder))


def pagerank(spark, folder):
    return G.pagerank(_imports(spark, folder), 10).withColumn("rank", F.round("rank", 9))


def label_communities(spark, folder):
    return G.communities(_imports(spark, folder), 3)


def pagerank_20(spark, folder):
    """PageRank after the 20 rounds of the survey."""
    return G.pagerank(_imports(spark, folder)).withColumn("rank", F.round("rank", 9))


def settled_communities(spark, folder):
    return G.settled_communities(_imports(spark, folder))


def folder_cohesion(spark, folder):
    return G.cohesion(_imports(spark, folder), _groups(spark, folder))


def super_graph(spark, folder):
    return G.super_graph(_imports(spark, folder), _groups(spark, folder))


def short_cycles(spark, folder):
    return G.short_cycles(_imports(spark, folder))


def scc(spark, folder):
    return G.strongly_connected(_imports(spark, folder))


def blast_radius(spark, folder):
    """Files that the entry points' changes reach within three imports backward, at the least distance."""
    seeds = _nodes(spark, folder, "file").filter("is_entry_point").select("scope", F.lit("").alias("seed"), "node")
    return G.reach(seeds, _imports(spark, folder), 3, backward=True).filter("hops > 0").drop("seed")


def tests_reaching(spark, folder):
    """Per file the number of tests that reach it within three imports."""
    seeds = _nodes(spark, folder, "file").filter("is_test").select("scope", F.col("node").alias("seed"), "node")
    return G.reach(seeds, _imports(spark, folder), 3).filter("hops > 0").groupBy("scope", "node").agg(F.count(F.lit(1)).alias("tests"), F.min("hops").alias("nearest"))


def path_lengths(spark, folder):
    """Shortest distances of up to four imports from each entry point."""
    seeds = _nodes(spark, folder, "file").filter("is_entry_point").select("scope", F.col("node").alias("seed"), "node")
    return G.reach(seeds, _imports(spark, folder), 4).filter("hops > 0")


def execution_flows(spark, folder):
    """Walks from every symbol that calls and is called by none."""
    entries = G.degrees(_calls(spark, folder)).filter("in_degree = 0 and out_degree > 0")
    return G.execution_flows(entries, _calls(spark, folder), 4)


def execution_flows_8(spark, folder):
    """The same walks of up to the eight steps of the survey."""
    entries = G.degrees(_calls(spark, folder)).filter("in_degree = 0 and out_degree > 0")
    return G.execution_flows(entries, _calls(spark, folder))


def entry_scores(spark, folder):
    return G.entry_scores(_nodes(spark, folder, "symbol"), G.degrees(_calls(spark, folder))).select("scope", "node", "entry_score")


def unreferenced_files(spark, folder):
    return G.unreferenced(_nodes(spark, folder, "file"), file_edges(spark, folder, "imports", "references", "type_use"))


def conformance(spark, folder):
    return G.conformance(_imports(spark, folder), RULES)


def propagation_cost(spark, folder):
    return G.propagation_cost(_imports(spark, folder), 3)


def propagation_closure(spark, folder):
    """The propagation cost over walks of any length."""
    return G.propagation_cost(_imports(spark, folder), None)


def shortest_paths(spark, folder):
    """Shortest distances of any length from each entry point."""
    seeds = _nodes(spark, folder, "file").filter("is_entry_point").select("scope", F.col("node").alias("seed"), "node")
    return G.reach(seeds, _imports(spark, folder), None).filter("hops > 0")


def shortest_cycles(spark, folder):
    """The 50 shortest import cycles of each repository, of any length."""
    return G.shortest_cycles(_imports(spark, folder))


def betweenness(spark, folder):
    return G.betweenness(_imports(spark, folder))


def system_graph(spark, folder):
    """Repositories and the packages that their files use, by type of edge."""
    e = table(spark, folder, "graph_edges").filter(F.col("target_node_id").startswith("external:")).dropDuplicates(["id"])
    return G.system_graph(e.select(F.col("repository_id").alias("source"), F.expr("substring(target_node_id, 10)").alias("target"), F.col("edge_type").alias("kind"), "confidence"))


def breaking_changes(spark, folder):
    """Brands as contracts and parts as their fields, in two states."""
    p = table(spark, folder, "part")
    key = F.col("p_partkey")
    before = p.filter(key % 10 != 0).select(F.col("p_brand").alias("contract"), key.alias("field"), F.col("p_type").alias("type"), (F.col("p_size") > 25).alias("required"))
    after = p.filter(key % 10 != 1).select(F.col("p_brand").alias("contract"), key.alias("field"), F.when(F.col("p_size") > 45, "CHANGED").otherwise(F.col("p_type")).alias("type"), (F.col("p_size") > 20).alias("required"))
    return G.breaking_changes(before, after)


def decision_currency(spark, folder):
    """For each urgent order as a decision: later orders that touch one of its suppliers."""
    return G.decision_currency(changes(spark, folder, "l_suppkey"), commits(spark, folder))


QUERIES = {f.__name__: f for f in (betweenness, system_graph, breaking_changes, decision_currency, degrees, pagerank, label_communities, folder_cohesion, super_graph, short_cycles, scc, blast_radius, tests_reaching, path_lengths, execution_flows, entry_scores, unreferenced_files, conformance, propagation_cost, propagation_closure, shortest_paths, shortest_cycles, pagerank_20, settled_communities, execution_flows_8)}

_E = "edges AS (SELECT DISTINCT repository_id AS scope, source_node_id AS src, target_node_id AS dst FROM graph_edges WHERE target_node_id IS NOT NULL AND edge_type = 'imports'), nodes AS (SELECT scope, src AS node FROM edges UNION SELECT scope, dst FROM edges)"
_N = "n AS (SELECT repository_id AS scope, node_id AS node, max(visibility) AS visibility, max(name) AS name, bool_or(is_entry_point) AS is_entry_point, bool_or(is_test) AS is_test FROM graph_nodes WHERE node_type = '{0}' GROUP BY ALL)"
_GROUP = "g AS (SELECT scope, node, regexp_extract(node, '^([^/]+(?:/[^/]+)?)/', 1) AS \"group\" FROM nodes)"
_C = "calls AS (SELECT DISTINCT repository_id AS scope, source_node_id AS src, target_node_id AS dst FROM graph_edges WHERE target_node_id IS NOT NULL AND edge_type = 'calls' AND (resolution_origin IS NULL OR resolution_origin <> 'global_unique') AND confidence >= 0.5)"


def _pagerank_sql(rounds: int) -> str:
    sql = f"WITH {_E}, deg AS (SELECT scope, src, count(*) AS deg FROM edges GROUP BY ALL), base AS (SELECT n.scope, node, deg, count(*) OVER (PARTITION BY n.scope) AS n FROM nodes n LEFT JOIN deg d ON d.scope = n.scope AND src = node), r0 AS (SELECT *, 1.0::DOUBLE / n AS rank FROM base)"
    for i in range(rounds):
        sql += f", f{i} AS (SELECT e.scope, e.dst AS node, sum(rank / deg) AS got FROM edges e JOIN r{i} r ON r.scope = e.scope AND r.node = e.src GROUP BY ALL), l{i} AS (SELECT scope, sum(rank) AS lost FROM r{i} WHERE deg IS NULL GROUP BY scope)"
        sql += f", r{i + 1} AS (SELECT r.scope, r.node, deg, n, 0.15 / n + 0.85 * (coalesce(got, 0) + coalesce(lost, 0) / n) AS rank FROM r{i} r LEFT JOIN f{i} f ON f.scope = r.scope AND f.node = r.node LEFT JOIN l{i} l ON l.scope = r.scope)"
    return sql + f" SELECT scope, node, round(rank, 9) AS rank FROM r{rounds}"


def _labels_sql(rounds: int) -> str:
    sql = f"WITH {_E}, both_ways AS (SELECT scope, src, dst FROM edges WHERE src <> dst UNION SELECT scope, dst, src FROM edges WHERE src <> dst), c0 AS (SELECT scope, node, node AS community FROM nodes)"
    for i in range(rounds):
        sql += f", v{i} AS (SELECT b.scope, b.dst AS node, community, count(*) AS votes FROM both_ways b JOIN c{i} c ON c.scope = b.scope AND c.node = b.src GROUP BY ALL), w{i} AS (SELECT scope, node, community FROM v{i} QUALIFY row_number() OVER (PARTITION BY scope, node ORDER BY votes DESC, community) = 1)"
        sql += f", c{i + 1} AS (SELECT c.scope, c.node, coalesce(w.community, c.community) AS community FROM c{i} c LEFT JOIN w{i} w ON w.scope = c.scope AND w.node = c.node)"
    return sql + f" SELECT * FROM c{rounds}"


def _reach_sql(seeds: str, depth: int, backward: bool = False) -> str:
    a, b = ("dst", "src") if backward else ("src", "dst")
    return f"""WITH RECURSIVE {_E}, {_N.format('file')}, walk AS ({seeds} UNION SELECT w.scope, w.seed, e.{b} AS node, w.hops + 1 FROM walk w JOIN edges e ON e.scope = w.scope AND e.{a} = w.node AND e.src <> e.dst WHERE w.hops < {depth}),
reached AS (SELECT scope, seed, node, min(hops) AS hops FROM walk GROUP BY ALL HAVING min(hops) > 0)"""


def _flows_sql(steps: int) -> str:
    sql = f"WITH {_C}, c AS (SELECT * FROM calls WHERE src <> dst), fan AS (SELECT scope, src, count(*) AS fan FROM c GROUP BY ALL), s0 AS (SELECT DISTINCT a.scope, a.src AS entry, a.src AS at_node, [a.src] AS trace FROM calls a ANTI JOIN calls b ON b.scope = a.scope AND b.dst = a.src)"
    for i in range(steps):
        sql += f", s{i + 1} AS (SELECT s.scope, s.entry, c.dst AS at_node, list_append(trace, c.dst) AS trace FROM s{i} s JOIN c ON c.scope = s.scope AND c.src = s.at_node AND NOT list_contains(trace, c.dst) LEFT JOIN fan f ON f.scope = c.scope AND f.src = c.dst QUALIFY row_number() OVER (PARTITION BY s.scope, s.entry ORDER BY coalesce(fan, 0) DESC, c.dst) = 1)"
    every = " UNION ALL ".join(f"SELECT scope, entry, trace FROM s{i}" for i in range(steps + 1))
    return sql + f", u AS ({every}) SELECT scope, entry, array_to_string(trace, ' > ') AS trace, len(trace) AS length FROM u QUALIFY row_number() OVER (PARTITION BY scope, entry ORDER BY len(trace) DESC) = 1"


SQL = {
    "degrees": f"WITH {_E}, d AS (SELECT scope, src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT scope, dst, 1, 0 FROM edges) SELECT scope, node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM d GROUP BY ALL",
    "pagerank": _pagerank_sql(10),
    "label_communities": _labels_sql(3),
    "folder_cohesion": f"WITH {_E}, {_GROUP}, p AS (SELECT DISTINCT scope, least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE src <> dst), i AS (SELECT p.scope, a.\"group\", count(*) AS edges FROM p JOIN g a ON a.scope = p.scope AND a.node = src JOIN g b ON b.scope = p.scope AND b.node = dst WHERE a.\"group\" = b.\"group\" GROUP BY ALL), s AS (SELECT scope, \"group\", count(*) AS size FROM g GROUP BY ALL) SELECT s.scope, s.\"group\", size, round(CASE WHEN size < 2 THEN 1 ELSE coalesce(edges, 0) / (size * (size - 1) / 2) END, 4) AS cohesion FROM s LEFT JOIN i ON i.scope = s.scope AND i.\"group\" = s.\"group\"",
    "super_graph": f"WITH {_E}, {_GROUP} SELECT e.scope, a.\"group\" AS from_group, b.\"group\" AS to_group, count(*) AS edges FROM edges e JOIN g a ON a.scope = e.scope AND a.node = src JOIN g b ON b.scope = e.scope AND b.node = dst GROUP BY ALL",
    "short_cycles": f"WITH {_E}, e AS (SELECT * FROM edges WHERE src <> dst) SELECT a.scope, a.src || ' > ' || a.dst AS cycle, 2 AS length FROM e a JOIN e b ON b.scope = a.scope AND b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT a.scope, a.src || ' > ' || a.dst || ' > ' || b.dst, 3 FROM e a JOIN e b ON b.scope = a.scope AND b.src = a.dst JOIN e c ON c.scope = a.scope AND c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND b.dst <> a.dst",
    "scc": f"WITH RECURSIVE {_E}, e AS (SELECT scope, src, dst FROM edges WHERE src <> dst), c AS (SELECT scope, src, dst FROM e UNION SELECT c.scope, c.src, e.dst FROM c JOIN e ON e.scope = c.scope AND e.src = c.dst), m AS (SELECT a.scope, a.src AS node, least(a.src, min(a.dst)) AS component FROM c a JOIN c b ON b.scope = a.scope AND b.src = a.dst AND b.dst = a.src WHERE a.src <> a.dst GROUP BY a.scope, a.src) SELECT * FROM m",
    "blast_radius": _reach_sql("SELECT scope, '' AS seed, node, 0 AS hops FROM n WHERE is_entry_point", 3, True) + " SELECT scope, node, hops FROM reached",
    "tests_reaching": _reach_sql("SELECT scope, node AS seed, node, 0 AS hops FROM n WHERE is_test", 3) + " SELECT scope, node, count(*) AS tests, min(hops) AS nearest FROM reached GROUP BY ALL",
    "path_lengths": _reach_sql("SELECT scope, node AS seed, node, 0 AS hops FROM n WHERE is_entry_point", 4) + " SELECT * FROM reached",
    "execution_flows": _flows_sql(4),
    "entry_scores": f"WITH {_C}, {_N.format('symbol')}, d AS (SELECT scope, node, sum(i) AS i, sum(o) AS o FROM (SELECT scope, src AS node, 0 AS i, 1 AS o FROM calls UNION ALL SELECT scope, dst, 1, 0 FROM calls) GROUP BY ALL) SELECT n.scope, n.node, round(0.35 * least(coalesce(o, 0) / 10.0, 1) + 0.25 / (1 + coalesce(i, 0)) + CASE WHEN visibility = 'public' THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(lower(name), '^(main|run|start|serve|handle|handler|execute|app|init)') THEN 0.15 ELSE 0 END + CASE WHEN is_entry_point THEN 0.05 ELSE 0 END, 6)::DOUBLE AS entry_score FROM n LEFT JOIN d ON d.scope = n.scope AND d.node = n.node",
    "unreferenced_files": f"WITH {_N.format('file')}, u AS (SELECT DISTINCT repository_id AS scope, target_node_id AS node FROM graph_edges WHERE target_node_id IS NOT NULL AND source_node_id <> target_node_id AND edge_type IN ('imports', 'references', 'type_use')) SELECT n.scope, n.node, (CASE WHEN regexp_matches(lower(n.node), '(^|[/_.-])(plugin|hook|handler|migration|config|settings|main|index|setup|conftest|register)') THEN 0.4 WHEN is_test IS NULL THEN 0.7 ELSE 0.9 END)::DOUBLE AS confidence FROM n ANTI JOIN u ON u.scope = n.scope AND u.node = n.node WHERE NOT coalesce(is_entry_point, false) AND NOT coalesce(is_test, false)",
    "conformance": f"WITH {_E} SELECT scope, src, dst, 'no_app_from_libs' AS rule FROM edges WHERE regexp_matches(src, '^libs/') AND regexp_matches(dst, '^app/') UNION ALL SELECT scope, src, dst, 'no_tests_from_src' FROM edges WHERE regexp_matches(src, '^(src|app|libs)/') AND regexp_matches(dst, '^tests/')",
    "propagation_cost": f"WITH {_E}, e AS (SELECT scope, src, dst FROM edges WHERE src <> dst), two AS (SELECT a.scope, a.src, b.dst FROM e a JOIN e b ON b.scope = a.scope AND b.src = a.dst), three AS (SELECT a.scope, a.src, b.dst FROM two a JOIN e b ON b.scope = a.scope AND b.src = a.dst), p AS (SELECT * FROM e UNION SELECT * FROM two UNION SELECT * FROM three), c AS (SELECT scope, count(*) AS pairs FROM p WHERE src <> dst GROUP BY scope), s AS (SELECT scope, count(*) AS n FROM nodes GROUP BY scope) SELECT scope, n, round(CASE WHEN n > 1 THEN coalesce(pairs, 0) / (n * (n - 1)) ELSE 0 END, 6) AS cost FROM s LEFT JOIN c USING (scope)",
    "system_graph": "WITH e AS (SELECT DISTINCT id, repository_id, target_node_id, edge_type, confidence FROM graph_edges WHERE starts_with(target_node_id, 'external:')) SELECT repository_id AS source, substr(target_node_id, 10) AS target, edge_type AS kind, count(*) AS weight, max(confidence) AS confidence FROM e GROUP BY ALL",
    "breaking_changes": """WITH b AS (SELECT p_brand AS contract, p_partkey::VARCHAR AS field, p_type AS t0, p_size > 25 AS r0 FROM part WHERE p_partkey % 10 <> 0), a AS (SELECT p_brand AS contract, p_partkey::VARCHAR AS field, CASE WHEN p_size > 45 THEN 'CHANGED' ELSE p_type END AS t1, p_size > 20 AS r1 FROM part WHERE p_partkey % 10 <> 1),
x AS (SELECT coalesce(a.contract, b.contract) AS contract, coalesce(a.field, b.field) AS field, CASE WHEN a.field IS NULL THEN 'removed' WHEN b.field IS NULL THEN 'added' WHEN t0 <> t1 THEN 'type_changed' WHEN NOT r0 AND r1 THEN 'newly_required' END AS change FROM b FULL JOIN a ON a.contract = b.contract AND a.field = b.field)
SELECT *, change <> 'added' AS breaking FROM x WHERE change IS NOT NULL""",
    "decision_currency": f"WITH {FRAMES['commits']}, {FRAMES['supplies']}, own AS (SELECT DISTINCT sha, path FROM changes), g AS (SELECT own.sha AS decision, path, ts AS since FROM own JOIN commits USING (sha) WHERE is_fix), l AS (SELECT own.sha, path, ts FROM own JOIN commits USING (sha)) SELECT decision, count(DISTINCT sha) AS later_commits FROM g JOIN l USING (path) WHERE ts > since GROUP BY decision",
}
