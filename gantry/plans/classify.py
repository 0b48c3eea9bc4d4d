"""Classifier queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gantry.functions import predicates as P
from gantry.operators import history as H
from gantry.sources.frames import changes, commits
from gantry.plans.history import _ACTIVITY
from gantry.sources.tables import table


def _subjects(spark, folder):
    d = table(spark, folder, "documents").filter("source in ('commit_message', 'changelog') and text is not null")
    return d.select("doc_id", F.substring_index("text", "\n", 1).alias("subject"), F.coalesce("repository_id", F.lit("")).alias("author"))


def commit_categories(spark, folder):
    s = F.col("subject")
    return _subjects(spark, folder).select("doc_id", P.is_fix(s).alias("is_fix"), P.commit_category(s).alias("category"), P.evolution_category(s).alias("evolution"), P.is_significant(s, F.col("author")).alias("significant"))


def change_pattern(spark, folder):
    """Per repository the category that makes up half of its named commits, else mixed."""
    s = table(spark, folder, "documents").filter("source = 'commit_message' and text is not null and repository_id is not null")
    by = s.select("repository_id", P.commit_category(F.substring_index("text", "\n", 1)).alias("category")).filter("category is not null").groupBy("repository_id", "category").agg(F.count(F.lit(1)).alias("n"))
    top = by.groupBy("repository_id").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.min_by("category", F.struct(-F.col("n"), "category")).alias("dominant"))
    return top.select("repository_id", F.when(F.col("most") / F.col("total") >= 0.5, F.col("dominant")).otherwise("mixed-activity").alias("pattern"), "total")


def risk_velocity(spark, folder):
    return H.file_activity(changes(spark, folder)).select("path", P.risk_velocity(F.col("c30"), F.col("c90")).alias("velocity"))


def test_paths(spark, folder):
    n = table(spark, folder, "graph_nodes").filter("node_type = 'file'").select("repository_id", "node_id").distinct()
    return n.select("repository_id", "node_id", P.is_test_path(F.col("node_id")).alias("is_test"))


def minified_files(spark, folder):
    return table(spark, folder, "source_text").filter(P.is_minified(F.col("text"))).select("repository_id", "node_id").distinct()


def content_refs(spark, folder):
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", P.content_ref(F.col("text")).alias("ref"), P.significant_digits(F.col("n_chars").cast("double"), 2).alias("size"))


def repository_totals(spark, folder):
    """Files, symbols, edges and their average confidence per repository: three pre-aggregated sides, joined on the key."""
    nodes = table(spark, folder, "graph_nodes").groupBy("repository_id", "node_id").agg(F.max("node_type").alias("t")).groupBy("repository_id").agg(F.count_if(F.col("t") == "file").alias("files"), F.count_if(F.col("t") == "symbol").alias("symbols"))
    edges = table(spark, folder, "graph_edges").dropDuplicates(["id"]).groupBy("repository_id").agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg("confidence"), 6).alias("confidence"))
    r = table(spark, folder, "repositories").select(F.col("id").alias("repository_id"), "name")
    return r.join(nodes, "repository_id", "left").join(edges, "repository_id", "left")


QUERIES = {f.__name__: f for f in (commit_categories, change_pattern, risk_velocity, test_paths, minified_files, content_refs, repository_totals)}


def _m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(?i){pattern}')"


_FIX = " OR ".join(_m("subject", p) for p in P.FIX)
_NO = " OR ".join(_m("subject", p) for p in P.NO_FIX)
_CAT = "CASE " + " ".join(f"WHEN {_m('subject', p)} THEN '{n}'" for n, p in P.CATEGORIES.items()) + " END"
_EVO = "CASE " + " ".join(f"WHEN prefix = '{k}' THEN '{v}'" for k, v in P.PREFIXES.items()) + " " + " ".join(f"WHEN {_m('subject', p)} THEN '{n}'" for n, p in P.KEYWORDS) + " ELSE 'other' END"
_ROUTINE = " OR ".join(f"starts_with(t, '{p}')" for p in P.SKIPPED)
_DECIDES = " OR ".join(f"contains(lower(t), '{w}')" for w in P.DECISIONS)

SQL = {
    "commit_categories": rf"""WITH s AS (SELECT doc_id, split_part(text, chr(10), 1) AS subject, trim(split_part(text, chr(10), 1), ' ') AS t, lower(regexp_extract(split_part(text, chr(10), 1), '(?i)^\s*([a-z]+)(?:\([^)]*\))?!?:', 1)) AS prefix FROM documents WHERE source IN ('commit_message', 'changelog') AND text IS NOT NULL)
SELECT doc_id, ({_FIX}) AND NOT ({_NO}) AS is_fix, {_CAT} AS category, {_EVO} AS evolution, len(t) >= 12 AND NOT starts_with(t, 'Merge ') AND (NOT ({_ROUTINE}) OR ({_DECIDES})) AS significant FROM s""",
    "change_pattern": f"WITH s AS (SELECT repository_id, split_part(text, chr(10), 1) AS subject FROM documents WHERE source = 'commit_message' AND text IS NOT NULL AND repository_id IS NOT NULL), c AS (SELECT repository_id, {_CAT} AS category FROM s), n AS (SELECT repository_id, category, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY repository_id) AS total, row_number() OVER (PARTITION BY repository_id ORDER BY n DESC, category) AS rn FROM n) SELECT repository_id, CASE WHEN n / total >= 0.5 THEN category ELSE 'mixed-activity' END AS pattern, total::BIGINT AS total FROM r WHERE rn = 1",
    "risk_velocity": _ACTIVITY + " SELECT path, CASE WHEN c90 = 0 THEN 'stable' WHEN c90 = c30 THEN CASE WHEN c30 > 0 THEN 'increasing' ELSE 'stable' END WHEN (c30 / 30.0) / ((c90 - c30) / 60.0) > 1.5 THEN 'increasing' WHEN (c30 / 30.0) / ((c90 - c30) / 60.0) < 0.5 THEN 'decreasing' ELSE 'stable' END AS velocity FROM activity",
    "test_paths": r"SELECT DISTINCT repository_id, node_id, regexp_matches(node_id, '(?i)(^|/)(tests?|__tests__|specs?|testing)/|(^|/)test_[^/]*$|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$|Tests?\.java$') AS is_test FROM graph_nodes WHERE node_type = 'file'",
    "minified_files": "SELECT DISTINCT repository_id, node_id FROM source_text WHERE len(text) / len(string_split(text, chr(10))) > 200 OR list_max([len(x) FOR x IN string_split(text, chr(10))]) > 2000",
    "content_refs": "SELECT doc_id, substr(sha256(text), 1, 12) AS ref, CASE WHEN n_chars IS NULL OR n_chars = 0 THEN n_chars::DOUBLE ELSE round(n_chars * pow(10.0, 1 - floor(log10(abs(n_chars))))) / pow(10.0, 1 - floor(log10(abs(n_chars)))) END AS size FROM documents WHERE text IS NOT NULL",
    "repository_totals": "WITH n AS (SELECT repository_id, node_id, max(node_type) AS t FROM graph_nodes GROUP BY ALL), a AS (SELECT repository_id, count(*) FILTER (t = 'file') AS files, count(*) FILTER (t = 'symbol') AS symbols FROM n GROUP BY ALL), e AS (SELECT repository_id, count(*) AS edges, round(avg(confidence), 6) AS confidence FROM (SELECT DISTINCT id, repository_id, confidence FROM graph_edges) GROUP BY ALL) SELECT r.id AS repository_id, name, files, symbols, edges, confidence FROM repositories r LEFT JOIN a ON a.repository_id = r.id LEFT JOIN e ON e.repository_id = r.id",
}
