"""Queries for views over nodes and edges, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gantry.operators import graph as G
from gantry.operators import views as V
from gantry.plans import graph as P
from gantry.sources.frames import file_edges
from gantry.sources.tables import table


def _imports(spark, folder):
    return file_edges(spark, folder, "imports")


def _calls(spark, folder):
    return file_edges(spark, folder, "calls")


def _files(spark, folder):
    n = table(spark, folder, "graph_nodes").filter("node_type = 'file'")
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return n.groupBy(F.col("repository_id").alias("scope"), F.col("node_id").alias("node")).agg(F.max("symbol_count").alias("symbols"), F.max(known("pagerank")).alias("rank"), F.max(known("betweenness")).alias("between"), F.bool_or("is_entry_point").alias("entry"))


def _entries(spark, folder):
    return _files(spark, folder).filter("entry").select("scope", "node")


def layer_order(spark, folder):
    return V.layer_order(_imports(spark, folder))


def module_adjacency(spark, folder):
    return V.module_adjacency(_imports(spark, folder))


def entry_subgraph(spark, folder):
    return V.ego_edges(_imports(spark, folder), _entries(spark, folder))


def callers_callees(spark, folder):
    return V.neighbours(_calls(spark, folder))


def hub_cutoffs(spark, folder):
    return V.hub_cutoffs(G.degrees(_calls(spark, folder)))


def flow_neighbourhood(spark, folder):
    e = _imports(spark, folder)
    return V.flow_neighbourhood(e, _entries(spark, folder), G.degrees(e))


def dominant_language(spark, folder):
    n = table(spark, folder, "graph_nodes").filter("node_type = 'file'").select("repository_id", "node_id", F.lower(F.trim("language")).alias("language")).distinct()
    return V.dominant(n, "repository_id", "language")


def central_files(spark, folder):
    return V.central(_files(spark, folder), "rank")


def feature_envy(spark, folder):
    return V.feature_envy(_calls(spark, folder).select("scope", "src", "dst").distinct(), 1)


def core_periphery(spark, folder):
    return V.core_periphery(G.degrees(_imports(spark, folder)))


def names_used_elsewhere(spark, folder):
    s = table(spark, folder, "wiki_symbols").filter("name is not null").select(F.col("repository_id").alias("scope"), F.col("file_path").alias("file"), "name")
    t = table(spark, folder, "source_text").select(F.col("repository_id").alias("scope"), F.col("node_id").alias("file"), "text")
    return V.names_used_elsewhere(s, t)


def classified_packages(spark, folder):
    return V.classified_packages(table(spark, folder, "external_systems").withColumnRenamed("repository_id", "scope"))


def container_edges(spark, folder):
    return V.container_edges(file_edges(spark, folder))


def extraction_diagnostics(spark, folder):
    e = table(spark, folder, "graph_edges").distinct().select(F.col("repository_id").alias("scope"), F.col("target_node_id").alias("dst"), "edge_type")
    n = table(spark, folder, "graph_nodes").select(F.col("repository_id").alias("scope"), F.col("node_id").alias("node"))
    return V.extraction_diagnostics(e, n)


def page_candidacy(spark, folder):
    return V.page_candidacy(_files(spark, folder))


def path_factors(spark, folder):
    return V.path_factors(_files(spark, folder))


def dead_code_summary(spark, folder):
    """Unreferenced files by confidence."""
    return P.unreferenced_files(spark, folder).groupBy("confidence").agg(F.count(F.lit(1)).alias("files"))


def symbol_search(spark, folder):
    """Names that contain cache or merge_, case apart: a pattern with an escaped wildcard."""
    n = table(spark, folder, "graph_nodes").filter(F.col("name").ilike("%cache%") | F.expr(r"name ILIKE '%merge/_%' ESCAPE '/'"))
    return n.select("repository_id", "node_id", "name").distinct()


def included_paths(spark, folder):
    """File nodes that no exclude pattern names (a folder anywhere, an ending, a path from the top)."""
    n = _files(spark, folder).select("scope", "node")
    return n.filter(~F.col("node").rlike(r"(^|/)(vendor|node_modules|fixtures)/|\.(min\.js|lock)$|^scripts/"))


QUERIES = {q.__name__: q for q in (layer_order, module_adjacency, entry_subgraph, callers_callees, hub_cutoffs, flow_neighbourhood, dominant_language, central_files, feature_envy, core_periphery, names_used_elsewhere, classified_packages, container_edges, extraction_diagnostics, page_candidacy, path_factors, dead_code_summary, symbol_search, included_paths)}


def _edges(*types: str) -> str:
    among = f" AND edge_type IN ({', '.join(repr(t) for t in types)})" if types else ""
    return f"e AS (SELECT DISTINCT repository_id AS scope, source_node_id AS src, target_node_id AS dst FROM graph_edges WHERE target_node_id IS NOT NULL{among})"


_X = "x AS (SELECT scope, regexp_extract(src, '^([^/]+)/', 1) AS a, regexp_extract(dst, '^([^/]+)/', 1) AS b, count(*) AS n FROM e GROUP BY ALL), c AS (SELECT * FROM x WHERE a <> b AND a <> '' AND b <> '')"
_DEG = "d AS (SELECT scope, node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT scope, src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT scope, dst, 1, 0 FROM e) GROUP BY ALL)"
_FILES = "f AS (SELECT repository_id AS scope, node_id AS node, max(symbol_count) AS symbols, max(CASE WHEN NOT isnan(pagerank) THEN pagerank END) AS rank, max(CASE WHEN NOT isnan(betweenness) THEN betweenness END) AS between_, bool_or(is_entry_point) AS entry FROM graph_nodes WHERE node_type = 'file' GROUP BY ALL)"
_CASES = lambda rules, other: "CASE " + " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{other}' END"
SQL = {
    "layer_order": f"WITH {_edges('imports')}, {_X}, s AS (SELECT scope, a AS layer, n AS o, 0 AS i FROM c UNION ALL SELECT scope, b, 0, n FROM c), g AS (SELECT scope, layer, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM s GROUP BY ALL) SELECT *, incoming - outgoing AS net, row_number() OVER (PARTITION BY scope ORDER BY incoming - outgoing DESC, layer) AS place FROM g",
    "module_adjacency": f"WITH {_edges('imports')}, {_X}, o AS (SELECT scope, a AS module, sum(n)::BIGINT AS imports, count(*) AS uses FROM c GROUP BY ALL), i AS (SELECT scope, b AS module, sum(n)::BIGINT AS imported_by, count(*) AS used_by FROM c GROUP BY ALL) SELECT scope, module, coalesce(imports, 0) AS imports, coalesce(uses, 0) AS uses, coalesce(imported_by, 0) AS imported_by, coalesce(used_by, 0) AS used_by FROM o FULL JOIN i USING (scope, module)",
    "entry_subgraph": f"WITH {_edges('imports')}, {_FILES}, s AS (SELECT scope, node FROM f WHERE entry) SELECT e.* FROM e WHERE (scope, src) IN (SELECT (scope, node) FROM s) OR (scope, dst) IN (SELECT (scope, node) FROM s)",
    "callers_callees": f"WITH {_edges('calls')} SELECT scope, src AS node, 'callee' AS direction, dst AS other FROM e UNION ALL SELECT scope, dst, 'caller', src FROM e",
    "hub_cutoffs": f"WITH {_edges('calls')}, {_DEG} SELECT scope, in_degree AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY in_degree, node) AS rn, count(*) OVER (PARTITION BY scope) AS n FROM d) WHERE rn - 1 = floor(n * 0.95)",
    "flow_neighbourhood": f"WITH {_edges('imports')}, {_DEG}, {_FILES}, s AS (SELECT scope, node FROM f WHERE entry), k AS (SELECT scope, in_degree AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY in_degree, node) AS rn, count(*) OVER (PARTITION BY scope) AS n FROM d) WHERE rn - 1 = floor(n * 0.95)), h AS (SELECT scope, node FROM d JOIN k USING (scope) WHERE in_degree >= cutoff), a AS (SELECT DISTINCT e.scope, dst AS node FROM e JOIN s ON e.scope = s.scope AND e.src = s.node), b AS (SELECT DISTINCT e.scope, dst AS node FROM e JOIN a ON e.scope = a.scope AND e.src = a.node WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.scope = a.scope AND h.node = a.node)) SELECT scope, node, min(hops)::INT AS hops FROM (SELECT *, 1 AS hops FROM a UNION ALL SELECT *, 2 FROM b) z WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.scope = z.scope AND s.node = z.node) GROUP BY ALL",
    "dominant_language": "WITH c AS (SELECT repository_id, lower(trim(language)) AS language, count(DISTINCT node_id) AS n FROM graph_nodes WHERE node_type = 'file' AND language IS NOT NULL GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY n DESC, language) = 1",
    "central_files": f"WITH {_FILES}, r AS (SELECT scope, node, row_number() OVER (PARTITION BY scope ORDER BY rank DESC, node) AS place, count(*) OVER (PARTITION BY scope) AS n FROM f WHERE rank IS NOT NULL) SELECT scope, node, place FROM r WHERE place <= ceil(n * 0.2)",
    "feature_envy": f"WITH {_edges('calls')}, c AS (SELECT scope, src, split_part(dst, '::', 1) AS target, split_part(src, '::', 1) AS home, count(*) AS n FROM e WHERE contains(src, '::') AND contains(dst, '::') GROUP BY ALL), p AS (SELECT scope, src, coalesce(sum(n) FILTER (target = home), 0)::BIGINT AS own, max(n) FILTER (target <> home) AS away FROM c GROUP BY ALL) SELECT c.scope, c.src, min(target) AS target, max(away) AS away, max(own) AS own FROM c JOIN p USING (scope, src) WHERE target <> home AND n = away AND away > own GROUP BY ALL",
    "core_periphery": f"WITH {_edges('imports')}, {_DEG}, m AS (SELECT scope, quantile_cont(in_degree, 0.5) AS mi, quantile_cont(out_degree, 0.5) AS mo FROM d GROUP BY ALL) SELECT scope, CASE WHEN in_degree > mi AND out_degree > mo THEN 'core' WHEN in_degree > mi THEN 'shared' WHEN out_degree > mo THEN 'control' ELSE 'peripheral' END AS role, count(*) AS nodes FROM d JOIN m USING (scope) GROUP BY ALL",
    "names_used_elsewhere": "WITH s AS (SELECT DISTINCT repository_id AS scope, file_path AS file, name FROM wiki_symbols WHERE name IS NOT NULL), t AS (SELECT DISTINCT repository_id AS scope, node_id AS file, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM source_text WHERE text IS NOT NULL) SELECT s.*, EXISTS (SELECT 1 FROM t WHERE t.scope = s.scope AND t.name = s.name AND t.file <> s.file) AS elsewhere FROM s",
    "classified_packages": f"SELECT DISTINCT repository_id AS scope, name, coalesce(category, {_CASES(V.CATEGORIES, 'library')}) AS category, {_CASES(V.IO_KINDS, 'none')} AS io_kind FROM external_systems",
    "container_edges": "WITH x AS (SELECT DISTINCT repository_id AS scope, source_node_id AS src, target_node_id AS dst, edge_type FROM graph_edges WHERE target_node_id IS NOT NULL), c AS (SELECT scope, regexp_extract(src, '^([^/]+)/', 1) AS a, regexp_extract(dst, '^([^/]+)/', 1) AS b, edge_type, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY scope, a, b) AS total FROM c WHERE a <> b AND a <> '' AND b <> '') SELECT scope, a, b, edge_type AS verb, CASE WHEN total = 1 THEN 'single' WHEN total <= 5 THEN 'few' WHEN total <= 20 THEN 'some' ELSE 'many' END AS strength FROM t QUALIFY row_number() OVER (PARTITION BY scope, a, b ORDER BY n DESC, edge_type) = 1",
    "extraction_diagnostics": "WITH x AS (SELECT DISTINCT * FROM graph_edges), k AS (SELECT DISTINCT repository_id, node_id FROM graph_nodes), j AS (SELECT x.repository_id AS scope, edge_type, target_node_id AS dst, k.node_id AS known FROM x LEFT JOIN k ON x.repository_id = k.repository_id AND x.target_node_id = k.node_id), g AS (SELECT scope, edge_type, count(*) AS edges, count(*) FILTER (dst IS NULL) AS unnamed, count(*) FILTER (dst LIKE 'external:%') AS external, count(*) FILTER (dst IS NOT NULL AND dst NOT LIKE 'external:%' AND known IS NULL) AS unmatched FROM j GROUP BY ALL) SELECT *, round(1 - (unnamed + unmatched) / edges, 6) AS matched_share FROM g",
    "page_candidacy": f"WITH {_FILES}, b AS (SELECT scope, max(rank) AS mr, max(between_) AS mb FROM f GROUP BY ALL) SELECT scope, node, round(0.01 * least(coalesce(symbols, 0), 5) + CASE WHEN mr > 0 THEN coalesce(rank, 0) / mr ELSE 0 END + 0.5 * CASE WHEN mb > 0 THEN coalesce(between_, 0) / mb ELSE 0 END, 9) AS candidacy FROM f JOIN b USING (scope)",
    "path_factors": f"WITH {_FILES}, w AS (SELECT scope, node, unnest(regexp_split_to_array(lower(node), '[^a-z0-9]+')) AS w FROM f), t AS (SELECT DISTINCT scope, node, CASE {' '.join(f'WHEN w = {k!r} THEN {v!r}' for k, v in V.RISK_WORDS.items())} END AS tag FROM w) SELECT scope, node, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS factors, count(tag) = 0 AS safe_path FROM t GROUP BY ALL",
    "dead_code_summary": f"SELECT confidence, count(*) AS files FROM ({P.SQL['unreferenced_files']}) GROUP BY ALL",
    "symbol_search": "SELECT DISTINCT repository_id, node_id, name FROM graph_nodes WHERE name ILIKE '%cache%' OR name ILIKE '%merge/_%' ESCAPE '/'",
    "included_paths": f"WITH {_FILES} SELECT scope, node FROM f WHERE NOT regexp_matches(node, '(^|/)(vendor|node_modules|fixtures)/|\\.(min\\.js|lock)$|^scripts/')",
}
