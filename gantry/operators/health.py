"""Health scores, bands, findings and trends of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the score: deduction by severity, cap by category, weight by finding.
DEDUCTIONS = {"low": 0.3, "medium": 0.7, "high": 1.2, "critical": 2.0}
CAPS = {"organizational": 3.5, "structural_complexity": 2.5, "test_coverage": 2.0, "test_coverage_gradient": 2.0, "size_and_complexity": 1.5, "duplication": 1.0, "test_quality": 0.5, "error_handling": 0.5}
WEIGHTS = {
    "co_change_scatter": 1.8, "change_entropy": 1.51, "ownership_risk": 1.38, "nested_complexity": 1.34, "complex_conditional": 1.33, "large_method": 1.25, "complex_method": 1.21, "function_hotspot": 1.16,
    "god_class": 1.13, "prior_defect": 1.0, "untested_hotspot": 1.3, "churn_risk": 1.2, "code_age_volatility": 1.1, "developer_congestion": 0.5, "low_cohesion": 0.5, "brain_method": 0.5, "bumpy_road": 0.5,
    "primitive_obsession": 0.5, "dry_violation": 0.5, "error_handling": 0.5, "knowledge_loss": 0.4, "contradictory_decision": 1.0, "stale_governance": 0.9, "ungoverned_hotspot": 0.7,
}
CATEGORIES = {
    "churn_risk": "organizational", "change_entropy": "organizational", "co_change_scatter": "organizational", "ownership_risk": "organizational", "knowledge_loss": "organizational", "developer_congestion": "organizational",
    "prior_defect": "organizational", "code_age_volatility": "organizational", "function_hotspot": "organizational", "hidden_coupling": "organizational", "untested_hotspot": "test_coverage", "coverage_gap": "test_coverage",
    "coverage_gradient": "test_coverage_gradient", "dry_violation": "duplication", "complex_method": "size_and_complexity", "large_method": "size_and_complexity", "primitive_obsession": "size_and_complexity",
    "nested_complexity": "structural_complexity", "bumpy_road": "structural_complexity", "brain_method": "structural_complexity", "god_class": "structural_complexity", "low_cohesion": "structural_complexity",
    "complex_conditional": "structural_complexity", "large_assertion_block": "test_quality", "duplicated_assertion_block": "test_quality", "error_handling": "error_handling",
}
_C = F.col


def _ladder(*steps: tuple[Column, str]) -> Column:
    """The first severity whose condition holds."""
    return reduce(lambda acc, s: acc.when(*s), steps[1:], F.when(*steps[0]))


def _true() -> Column:
    return F.lit(True)


def detectors() -> dict[str, tuple[Column, Column]]:
    """finding -> (fires, severity), over the columns of a wide row per file.

    c90, churn_pct, added_90, deleted_90, nloc, hot, entropy, entropy_pct, partners, commits, owner_share,
    minor_authors, stable, bus_factor, owner, recent_owner, recent_share, contributors, small_team,
    prior_defects, temporal, dependents, coverage, coverable, is_test, reached, dup_pct, clone_lines, co_changes.
    A null column makes its findings not fire: what isn't known is no finding.
    """
    relative = (_C("added_90") + _C("deleted_90")) / F.greatest(_C("nloc"), F.lit(1))
    hot, c90 = F.coalesce(_C("hot"), F.lit(False)), _C("c90")
    cov = _C("coverage")
    uncovered = _C("coverable") * (100 - cov) / 100
    small = F.coalesce(_C("small_team"), F.lit(False)) & ~hot
    gone = (_C("recent_owner") != _C("owner")) | _C("recent_owner").isNull()
    faint = _C("recent_share") < 0.2
    deep, shallow = (cov < 30) & (_C("coverable") >= 50), (cov < 60) & (uncovered >= 25)
    pct, active = _C("dup_pct"), _C("co_changes") >= 3
    return {
        "churn_risk": ((c90 >= 5) & (_C("churn_pct") >= 0.75) & (relative >= 1), _ladder(((relative >= 4) & hot, "critical"), (relative >= 2.5, "high"), (relative >= 1.5, "medium"), (_true(), "low"))),
        "change_entropy": ((_C("entropy") > 0) & (_C("entropy_pct") >= 0.8) & (c90 >= 3), _ladder(((_C("entropy_pct") >= 0.95) & hot, "critical"), (_C("entropy_pct") >= 0.9, "high"), (_true(), "medium"))),
        "co_change_scatter": ((_C("partners") >= 8) & (c90 >= 3), _ladder((_C("partners") >= 15, "high"), (_true(), "medium"))),
        "ownership_risk": ((_C("commits") >= 5) & ((_C("minor_authors") >= 3) | (_C("owner_share") < 0.4)), _ladder((small, "low"), ((_C("minor_authors") >= 6) & hot, "critical"), ((_C("minor_authors") >= 5) | ((_C("minor_authors") >= 3) & hot), "high"), (_C("minor_authors") >= 3, "medium"), (_true(), "low"))),
        "knowledge_loss": (~F.coalesce(_C("stable"), F.lit(False)) & ((c90 >= 1) | hot) & (_C("bus_factor") == 1) & _C("owner").isNotNull() & (gone | faint), _ladder((small, "low"), (hot, "high"), (gone & faint, "medium"), (_true(), "low"))),
        "developer_congestion": ((_C("contributors") >= 5) & (c90 >= 6) & (_C("owner_share") < 0.5), _ladder(((_C("contributors") >= 10) & (c90 >= 20), "high"), ((_C("contributors") >= 7) | (c90 >= 12), "medium"), (_true(), "low"))),
        "prior_defect": (_C("prior_defects") >= 1, _ladder((_C("prior_defects") >= 5, "critical"), ((_C("prior_defects") >= 3) & hot, "critical"), (_C("prior_defects") >= 3, "high"), (_C("prior_defects") >= 2, "medium"), (_true(), "low"))),
        "untested_hotspot": ((hot | (c90 >= 8) | (_C("temporal") >= 0.8)) & (_C("dependents") >= 4) & ((cov < 40) | (cov.isNull() & ~F.coalesce(_C("is_test"), F.lit(False)) & ~F.coalesce(_C("reached"), F.lit(False)))), _ladder(((cov <= 15) & (_C("dependents") >= 10), "critical"), ((cov <= 15) | (_C("dependents") >= 10), "high"), (_true(), "medium"))),
        "coverage_gap": (deep | shallow, _ladder((deep & (uncovered >= 100), "high"), (deep, "medium"), (_true(), "low"))),
        "coverage_gradient": (cov.isNotNull() & ~F.coalesce(_C("is_test"), F.lit(False)) & (cov < 100), _ladder((cov < 40, "high"), (cov < 70, "medium"), (_true(), "low"))),
        "dry_violation": ((pct >= 8) & (_C("clone_lines") >= 6), _ladder((active & (pct >= 25), "high"), (active | (pct >= 25), "medium"), (_true(), "low"))),
    }


def function_detectors() -> dict[str, tuple[Column, Column]]:
    """Like detectors(), over a row per function: ccn, nloc, nesting, bumps, params, dependents, dependents_p80, constructor, file_nloc, operators, assertions, is_test."""
    ccn, nloc = _C("ccn"), _C("nloc")
    central = _C("dependents") >= F.least(F.lit(8), F.greatest(F.coalesce(_C("dependents_p80"), F.lit(8)), F.lit(3)))
    limit = F.when(F.coalesce(_C("constructor"), F.lit(False)), 7).otherwise(5)
    return {
        "complex_method": (ccn >= 9, _ladder((ccn >= 25, "critical"), (ccn >= 15, "high"), (_true(), "medium"))),
        "large_method": ((nloc >= 60) & (ccn >= 3), _ladder((nloc >= 200, "critical"), (nloc >= 120, "high"), (nloc >= 90, "medium"), (_true(), "low"))),
        "nested_complexity": (_C("nesting") >= 4, _ladder((_C("nesting") >= 7, "critical"), (_C("nesting") >= 5, "high"), (_true(), "medium"))),
        "bumpy_road": ((_C("bumps") >= 3) & (ccn >= 5), _ladder((_C("bumps") >= 5, "high"), (_C("bumps") >= 4, "medium"), (_true(), "low"))),
        "brain_method": ((nloc >= 70) & (ccn >= 9) & central, _ladder(((ccn >= 20) & (nloc >= 150), "critical"), ((ccn >= 14) | (nloc >= 120), "high"), (_true(), "medium"))),
        "primitive_obsession": ((_C("file_nloc") >= 60) & (_C("params") >= limit), _ladder((_C("params") >= limit + 4, "high"), (_C("params") >= limit + 2, "medium"), (_true(), "low"))),
        "complex_conditional": (_C("operators") >= 3, _ladder((_C("operators") >= 6, "critical"), (_C("operators") >= 5, "high"), (_C("operators") >= 4, "medium"), (_true(), "low"))),
        "large_assertion_block": (F.coalesce(_C("is_test"), F.lit(False)) & (_C("assertions") >= 15), _ladder((_C("assertions") >= 30, "high"), (_true(), "medium"))),
    }


def class_detectors() -> dict[str, tuple[Column, Column]]:
    """Like detectors(), over a row per class: total_nloc, methods, brain_methods, lcom4."""
    n, m = _C("total_nloc"), _C("methods")
    return {
        "god_class": ((n >= 200) & (m >= 15) & (_C("brain_methods") >= 1), _ladder(((n >= 400) & (m >= 25), "critical"), ((n >= 300) | (m >= 20), "high"), (_true(), "medium"))),
        "low_cohesion": ((_C("lcom4") >= 2) & (m >= 5), _ladder(((_C("lcom4") >= 4) & (m >= 15), "critical"), ((_C("lcom4") >= 3) | (m >= 20), "high"), (_true(), "medium"))),
    }


def find(wide: DataFrame, rules: dict[str, tuple[Column, Column]], keys: list[str]) -> DataFrame:
    """keys, finding, severity: one row per rule that fires; one pass over the rows."""
    hits = F.array(*[F.when(fires, F.struct(F.lit(name).alias("finding"), severity.alias("severity"))) for name, (fires, severity) in rules.items()])
    return wide.select(*keys, F.explode(F.array_compact(hits)).alias("x")).select(*keys, "x.*")


def _lookup(names: dict, key: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col(key)]


def health_scores(findings: DataFrame, files: DataFrame) -> DataFrame:
    """path, score: 10 less the capped deductions of each category, at least 1; files without findings score 10.

    findings(path, finding, severity); files(path).
    """
    cost = _lookup(DEDUCTIONS, "severity") * F.coalesce(_lookup(WEIGHTS, "finding"), F.lit(1.0))
    by = findings.groupBy("path", F.coalesce(_lookup(CATEGORIES, "finding"), F.lit("performance")).alias("category")).agg(F.sum(cost).alias("cost"))
    capped = by.withColumn("cost", F.least("cost", F.coalesce(_lookup(CAPS, "category"), F.lit(1.0))))
    lost = capped.groupBy("path").agg(F.sum("cost").alias("lost"))
    return files.select("path").distinct().join(lost, "path", "left").select("path", F.round(F.greatest(F.lit(1.0), 10 - F.coalesce("lost", F.lit(0.0))), 4).alias("score"))


def band(score: Column) -> Column:
    return F.when(score < 4, "alert").when(score < 8, "warning").otherwise("healthy")


def distribution(scored: DataFrame) -> DataFrame:
    """Files, lines and share of lines per band; a file counts at least one line."""
    lines = F.greatest(F.col("nloc"), F.lit(1))
    by = scored.groupBy(band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("files"), F.sum(lines).alias("nloc"))
    return by.withColumn("share", F.round(F.col("nloc") / F.sum("nloc").over(Window.partitionBy()), 6))


def module_rollup(scored: DataFrame) -> DataFrame:
    """Line-weighted score per module, its worst file and number of files."""
    lines = F.greatest(F.col("nloc"), F.lit(1))
    return scored.groupBy("module").agg(F.round(F.sum(F.col("score") * lines) / F.sum(lines), 4).alias("score"), F.count(F.lit(1)).alias("files"), F.min_by("path", F.struct("score", "path")).alias("worst"))


def severity_pivot(findings: DataFrame) -> DataFrame:
    return findings.groupBy("finding").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in DEDUCTIONS], F.count(F.lit(1)).alias("total"))


def defect_accuracy(scored: DataFrame, k: int) -> DataFrame:
    """One row: precision among the k worst files, base rate and lift, of scored(path, score, defective); nothing below 25 files or 5 positives."""
    worst = scored.orderBy("score", "path").limit(k).agg(F.avg(F.col("defective").cast("int")).alias("p"))
    base = scored.agg(F.avg(F.col("defective").cast("int")).alias("b"), F.count(F.lit(1)).alias("n"), F.count_if("defective").alias("pos"))
    out = worst.crossJoin(F.broadcast(base)).filter("n >= 25 and pos >= 5")
    return out.select(F.round("p", 6).alias("precision"), F.round("b", 6).alias("base_rate"), F.round(F.col("p") / F.col("b"), 6).alias("lift"))


def trends(series: DataFrame) -> DataFrame:
    """Per path and time: score, change to the last one, declining (0.5 or more below five back) and predicted decline (three strict drops)."""
    w = Window.partitionBy("path").orderBy("taken_at")
    lag = [F.lag("score", i).over(w) for i in range(6)]
    falls = (lag[0] < lag[1]) & (lag[1] < lag[2]) & (lag[2] < lag[3])
    return series.select(
        "path", "taken_at", "score", F.round(lag[0] - lag[1], 4).alias("delta"), F.coalesce(F.round(lag[0] - lag[5], 4) <= -0.5, F.lit(False)).alias("declining"), F.coalesce(falls, F.lit(False)).alias("predicted"),
    )
