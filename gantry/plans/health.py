"""Health queries over the activity of files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gantry.operators import health as K
from gantry.operators import history as H
from gantry.plans.history import _ACTIVITY, _FEATURES, SQL as _HISTORY
from gantry.sources.frames import changes, commits
from gantry.sources.tables import table


def _wide(spark, folder):
    """Per part: activity, fixes, owners; lines and coverage from the part's attributes."""
    activity = H.file_activity(changes(spark, folder))
    fixes = H.fix_history(changes(spark, folder), commits(spark, folder)).select("path", "prior_defects")
    owners = H.ownership(changes(spark, folder), commits(spark, folder))
    part = table(spark, folder, "part")
    base = part.select(F.col("p_partkey").alias("path"), (F.col("p_size") * 8).alias("nloc"), (F.col("p_partkey") % 101).cast("double").alias("coverage"), (F.col("p_size") * 6).alias("coverable"), F.col("p_brand").alias("module"), (F.col("p_partkey") % 13).alias("dependents"), (F.col("p_partkey") % 40).cast("double").alias("dup_pct"))
    x = base.join(activity, "path").join(fixes, "path").join(owners, "path")
    null = lambda kind: F.lit(None).cast(kind)
    return x.select(
        "*", F.lit(0.8).alias("churn_pct"), (F.col("c90") >= 3).alias("hot"), null("double").alias("entropy"), null("double").alias("entropy_pct"), null("int").alias("partners"), F.lit(False).alias("stable"),
        F.lit(False).alias("small_team"), F.lit(False).alias("is_test"), F.lit(False).alias("reached"), (F.col("path") % 20).alias("clone_lines"), (F.col("path") % 5).alias("co_changes"),
    )


def _findings(spark, folder):
    return K.find(_wide(spark, folder), K.detectors(), ["path"])


def biomarkers(spark, folder):
    return _findings(spark, folder)


def _scored(spark, folder):
    wide = _wide(spark, folder)
    return K.health_scores(_findings(spark, folder), wide).join(wide.select("path", "nloc", "module", "prior_defects"), "path")


def health_score(spark, folder):
    return _scored(spark, folder).select("path", "score")


def health_bands(spark, folder):
    return K.distribution(_scored(spark, folder))


def module_rollup(spark, folder):
    return K.module_rollup(_scored(spark, folder))


def severity_pivot(spark, folder):
    return K.severity_pivot(_findings(spark, folder))


def defect_accuracy(spark, folder):
    return K.defect_accuracy(_scored(spark, folder).select("path", "score", (F.col("prior_defects") >= 1).alias("defective")), 200)


def churn_complexity(spark, folder):
    """Files by commits of 90 days times size, the hundred most dangerous."""
    x = H.file_activity(changes(spark, folder)).join(table(spark, folder, "part").select(F.col("p_partkey").alias("path"), "p_size"), "path").filter("c90 > 0")
    return x.select("path", "c90", "p_size", (F.col("c90") * F.col("p_size")).alias("danger")).orderBy(F.col("danger").desc(), "path").limit(100)


def function_findings(spark, folder):
    """Findings per function of the stored symbols: lengths from their spans, parameters from their signatures."""
    s = table(spark, folder, "wiki_symbols").filter("kind in ('function', 'method')").distinct()
    params = F.when(F.col("signature").contains("("), F.size(F.split("signature", ",")))
    null = lambda kind: F.lit(None).cast(kind)
    rows = s.select("repository_id", "symbol_id", "start_line", (F.col("end_line") - F.col("start_line") + 1).alias("nloc"), ((F.col("end_line") - F.col("start_line")) / 2).cast("int").alias("ccn"), params.alias("params"), F.lit(100).alias("file_nloc"), F.lit(False).alias("constructor"), null("int").alias("nesting"), null("int").alias("bumps"), null("int").alias("dependents"), null("int").alias("dependents_p80"), null("int").alias("operators"), null("int").alias("assertions"), F.lit(False).alias("is_test"))
    return K.find(rows, K.function_detectors(), ["repository_id", "symbol_id", "start_line"])


def trend_alerts(spark, folder):
    """Mean event value per user and day as a score series."""
    e = table(spark, folder, "events").groupBy(F.col("user_id").alias("path"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("taken_at")).agg(F.round(F.avg("value"), 4).alias("score"))
    return K.trends(e)


_CTE = _ACTIVITY + ", " + _HISTORY["fix_history"].split("WITH ", 1)[1].split("x AS", 1)[1].join(["fx AS", ""]).replace("FROM x GROUP", "FROM fx GROUP").rsplit("SELECT *", 1)[0].rstrip() + ", own AS (" + "WITH aged AS" + _HISTORY["ownership"].split("aged AS", 1)[1] + """),
wide AS (SELECT a.*, f.prior_defects, o.* EXCLUDE (path), p_size * 8 AS nloc, a.path % 101 AS coverage, p_size * 6 AS coverable, p_brand AS module, a.path % 13 AS dependents, a.path % 40 AS dup_pct, c90 >= 3 AS hot, a.path % 20 AS clone_lines, a.path % 5 AS co_changes,
  (added_90 + deleted_90) / greatest(p_size * 8, 1) AS rel, p_size * 6 * (100 - a.path % 101) / 100.0 AS unc FROM activity a JOIN f USING (path) JOIN own o USING (path) JOIN part ON p_partkey = a.path),
found AS (
  SELECT path, 'churn_risk' AS finding, CASE WHEN rel >= 4 AND hot THEN 'critical' WHEN rel >= 2.5 THEN 'high' WHEN rel >= 1.5 THEN 'medium' ELSE 'low' END AS severity FROM wide WHERE c90 >= 5 AND rel >= 1
  UNION ALL SELECT path, 'ownership_risk', CASE WHEN minor_authors >= 6 AND hot THEN 'critical' WHEN minor_authors >= 5 OR (minor_authors >= 3 AND hot) THEN 'high' WHEN minor_authors >= 3 THEN 'medium' ELSE 'low' END FROM wide WHERE commits >= 5 AND (minor_authors >= 3 OR owner_share < 0.4)
  UNION ALL SELECT path, 'knowledge_loss', CASE WHEN hot THEN 'high' WHEN (recent_owner IS NULL OR recent_owner <> owner) AND recent_share < 0.2 THEN 'medium' ELSE 'low' END FROM wide WHERE (c90 >= 1 OR hot) AND bus_factor = 1 AND (recent_owner IS NULL OR recent_owner <> owner OR recent_share < 0.2)
  UNION ALL SELECT path, 'developer_congestion', CASE WHEN contributors >= 10 AND c90 >= 20 THEN 'high' WHEN contributors >= 7 OR c90 >= 12 THEN 'medium' ELSE 'low' END FROM wide WHERE contributors >= 5 AND c90 >= 6 AND owner_share < 0.5
  UNION ALL SELECT path, 'prior_defect', CASE WHEN prior_defects >= 5 OR (prior_defects >= 3 AND hot) THEN 'critical' WHEN prior_defects >= 3 THEN 'high' WHEN prior_defects >= 2 THEN 'medium' ELSE 'low' END FROM wide WHERE prior_defects >= 1
  UNION ALL SELECT path, 'untested_hotspot', CASE WHEN coverage <= 15 AND dependents >= 10 THEN 'critical' WHEN coverage <= 15 OR dependents >= 10 THEN 'high' ELSE 'medium' END FROM wide WHERE (hot OR c90 >= 8 OR temporal >= 0.8) AND dependents >= 4 AND coverage < 40
  UNION ALL SELECT path, 'coverage_gap', CASE WHEN coverage < 30 AND coverable >= 50 AND unc >= 100 THEN 'high' WHEN coverage < 30 AND coverable >= 50 THEN 'medium' ELSE 'low' END FROM wide WHERE (coverage < 30 AND coverable >= 50) OR (coverage < 60 AND unc >= 25)
  UNION ALL SELECT path, 'coverage_gradient', CASE WHEN coverage < 40 THEN 'high' WHEN coverage < 70 THEN 'medium' ELSE 'low' END FROM wide WHERE coverage < 100
  UNION ALL SELECT path, 'dry_violation', CASE WHEN co_changes >= 3 AND dup_pct >= 25 THEN 'high' WHEN co_changes >= 3 OR dup_pct >= 25 THEN 'medium' ELSE 'low' END FROM wide WHERE dup_pct >= 8 AND clone_lines >= 6),
costs AS (SELECT path, CASE finding WHEN 'untested_hotspot' THEN 'test_coverage' WHEN 'coverage_gap' THEN 'test_coverage' WHEN 'coverage_gradient' THEN 'gradient' WHEN 'dry_violation' THEN 'duplication' ELSE 'organizational' END AS category,
  sum(CASE severity WHEN 'low' THEN 0.3 WHEN 'medium' THEN 0.7 WHEN 'high' THEN 1.2 ELSE 2.0 END * CASE finding WHEN 'churn_risk' THEN 1.2 WHEN 'ownership_risk' THEN 1.38 WHEN 'knowledge_loss' THEN 0.4 WHEN 'developer_congestion' THEN 0.5 WHEN 'untested_hotspot' THEN 1.3 WHEN 'dry_violation' THEN 0.5 ELSE 1.0 END) AS cost FROM found GROUP BY ALL),
lost AS (SELECT path, sum(least(cost, CASE category WHEN 'organizational' THEN 3.5 WHEN 'duplication' THEN 1.0 ELSE 2.0 END)) AS lost FROM costs GROUP BY path),
scored AS (SELECT path, round(greatest(1.0, 10 - coalesce(lost, 0))::DOUBLE, 4) AS score, nloc, module, prior_defects FROM wide LEFT JOIN lost USING (path))
"""

QUERIES = {f.__name__: f for f in (biomarkers, health_score, health_bands, module_rollup, severity_pivot, defect_accuracy, churn_complexity, function_findings, trend_alerts)}

SQL = {
    "biomarkers": _CTE + "SELECT * FROM found",
    "health_score": _CTE + "SELECT path, score FROM scored",
    "health_bands": _CTE + ", b AS (SELECT CASE WHEN score < 4 THEN 'alert' WHEN score < 8 THEN 'warning' ELSE 'healthy' END AS band, count(*) AS files, sum(greatest(nloc, 1))::BIGINT AS nloc FROM scored GROUP BY 1) SELECT *, round(nloc / sum(nloc) OVER (), 6) AS share FROM b",
    "module_rollup": _CTE + "SELECT module, round(sum(score * greatest(nloc, 1)) / sum(greatest(nloc, 1)), 4) AS score, count(*) AS files, arg_min(path, score * 1000000 + path / 1e6) AS worst FROM scored GROUP BY module",
    "severity_pivot": _CTE + "SELECT finding, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical, count(*) AS total FROM found GROUP BY finding",
    "defect_accuracy": _CTE + ", w AS (SELECT avg((prior_defects >= 1)::INT) AS p FROM (SELECT * FROM scored ORDER BY score, path LIMIT 200)), b AS (SELECT avg((prior_defects >= 1)::INT) AS b, count(*) AS n, count(*) FILTER (prior_defects >= 1) AS pos FROM scored) SELECT round(p, 6) AS precision, round(b, 6) AS base_rate, round(p / b, 6) AS lift FROM w, b WHERE n >= 25 AND pos >= 5",
    "churn_complexity": _ACTIVITY + " SELECT path, c90, p_size, c90 * p_size AS danger FROM activity JOIN part ON p_partkey = path WHERE c90 > 0 ORDER BY danger DESC, path LIMIT 100",
    "function_findings": """WITH s AS (SELECT DISTINCT * FROM wiki_symbols WHERE kind IN ('function', 'method')),
r AS (SELECT repository_id, symbol_id, start_line, end_line - start_line + 1 AS nloc, (end_line - start_line) // 2 AS ccn, CASE WHEN signature LIKE '%(%' THEN len(string_split(signature, ',')) END AS params FROM s)
SELECT repository_id, symbol_id, start_line, 'complex_method' AS finding, CASE WHEN ccn >= 25 THEN 'critical' WHEN ccn >= 15 THEN 'high' ELSE 'medium' END AS severity FROM r WHERE ccn >= 9
UNION ALL SELECT repository_id, symbol_id, start_line, 'large_method', CASE WHEN nloc >= 200 THEN 'critical' WHEN nloc >= 120 THEN 'high' WHEN nloc >= 90 THEN 'medium' ELSE 'low' END FROM r WHERE nloc >= 60 AND ccn >= 3
UNION ALL SELECT repository_id, symbol_id, start_line, 'primitive_obsession', CASE WHEN params >= 9 THEN 'high' WHEN params >= 7 THEN 'medium' ELSE 'low' END FROM r WHERE params >= 5""",
    "trend_alerts": """WITH e AS (SELECT user_id AS path, strftime(ts, '%Y-%m-%d') AS taken_at, round(avg(value), 4) AS score FROM events GROUP BY ALL)
SELECT path, taken_at, score, round(score - lag(score) OVER w, 4) AS delta, coalesce(round(score - lag(score, 5) OVER w, 4) <= -0.5, false) AS declining, coalesce(score < lag(score) OVER w AND lag(score) OVER w < lag(score, 2) OVER w AND lag(score, 2) OVER w < lag(score, 3) OVER w, false) AS predicted FROM e WINDOW w AS (PARTITION BY path ORDER BY taken_at)""",
}
