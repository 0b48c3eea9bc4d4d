"""Queries over commits and file changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gantry.operators import history as H
from gantry.sources.frames import SQL as FRAMES
from gantry.sources.frames import changes, commits
from gantry.sources.tables import table

_WITH = f"WITH {FRAMES['commits']}, {FRAMES['changes']}, "
_WITH_S = f"WITH {FRAMES['commits']}, {FRAMES['supplies']}, "
_AGE = "(SELECT max(epoch(ts)) FROM {0}) - epoch(ts)"


def _age(frame: str) -> str:
    return f"((SELECT max(floor(epoch(ts))) FROM {frame}) - floor(epoch(ts))) / 86400.0"


_ACTIVITY = _WITH + f"""aged AS (SELECT *, {_age('changes')} AS age FROM changes),
activity AS (SELECT path, count(DISTINCT sha) AS commits, count(*) FILTER (age <= 90) AS c90, count(*) FILTER (age <= 30) AS c30,
  round(sum(CASE WHEN age <= 90 THEN added ELSE 0 END), 4) AS added_90, round(sum(CASE WHEN age <= 90 THEN deleted ELSE 0 END), 4) AS deleted_90,
  round(max(age), 4) AS age_days, round(min(age), 4) AS idle_days,
  round(sum(exp(-ln(2) * age / 180) * least((added + deleted) / 100, 3)), 6) AS temporal FROM aged GROUP BY path)"""

_OWNERS = _WITH + f"""aged AS (SELECT c.path, m.author, {_age('changes').replace('epoch(ts))) F', 'epoch(ts))) F').replace('- floor(epoch(ts))', '- floor(epoch(c.ts))')} AS age FROM changes c JOIN commits m USING (sha)),
n AS (SELECT path, author, count(*) AS n, count(*) FILTER (age <= 90) AS n90 FROM aged GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY path) AS total, sum(n90) OVER (PARTITION BY path) AS recent, row_number() OVER w AS rn, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM n WINDOW w AS (PARTITION BY path ORDER BY n DESC, author)),
r AS (SELECT path, author FROM s WHERE n90 > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY n90 DESC, author) = 1)
SELECT s.path, max(CASE WHEN rn = 1 THEN s.author END) AS owner, round(max(n / total), 6) AS owner_share, max(r.author) AS recent_owner,
  round(max(CASE WHEN recent > 0 THEN n90 / recent END), 6) AS recent_share, count(*) AS contributors, min(CASE WHEN cum >= 0.8 * total THEN rn END) AS bus_factor, count(*) FILTER (n / total < 0.05) AS minor_authors
FROM s LEFT JOIN r ON r.path = s.path GROUP BY s.path"""

_FEATURES = _WITH + """per AS (SELECT c.sha, c.path, sum(added) AS la, sum(deleted) AS ld, any_value(p_brand) AS dir, any_value(p_type) AS subsystem FROM changes c LEFT JOIN part ON path = p_partkey GROUP BY ALL),
tot AS (SELECT *, la + ld AS churn, sum(la + ld) OVER (PARTITION BY sha) AS total FROM per),
features AS (SELECT sha, sum(la) AS la, sum(ld) AS ld, count(*) AS nf, count(DISTINCT dir) AS nd, count(DISTINCT subsystem) AS ns,
  CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(-sum(CASE WHEN total > 0 AND churn > 0 THEN churn / total * log2(churn / total) END), 0) END AS entropy FROM tot GROUP BY sha),
experience AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY ts, sha) - 1 AS exp FROM commits)"""
_Z = " + ".join(
    [f"{H.RISK_INTERCEPT}"] + [f"coalesce({c} * ({'entropy' if n == 'entropy' else f'ln(1 + {n})'} - {m}) / {s}, 0)" for n, m, s, c in zip(["la", "ld", "nf", "nd", "ns", "entropy", "exp"], H.RISK_MEAN, H.RISK_STD, H.RISK_COEF)]
)
_RISK = _FEATURES + f", risky AS (SELECT f.sha, round(10.0 / (1 + exp(-({_Z}))), 4) AS risk FROM features f JOIN experience e USING (sha))"

_PAIRS = _WITH_S + f"""files AS (SELECT DISTINCT sha, path FROM changes), sizes AS (SELECT sha, count(*) AS files FROM files GROUP BY sha),
aged AS (SELECT sha, ts, {_age('commits')} AS age FROM commits),
pairs AS (SELECT a.path, b.path AS partner, round(sum(exp(-age / 180)), 6) AS strength, count(*) AS joint, max(ts) AS last
  FROM files a JOIN files b ON a.sha = b.sha AND a.path < b.path JOIN sizes s ON s.sha = a.sha AND files BETWEEN 2 AND 200 JOIN aged g ON g.sha = a.sha GROUP BY ALL HAVING round(sum(exp(-age / 180)), 6) >= 2)"""


def file_activity(spark, folder):
    return H.file_activity(changes(spark, folder))


def hotspots(spark, folder):
    return H.hotspots(H.file_activity(changes(spark, folder))).select("path", "c90", "temporal", "percentile")


def ownership(spark, folder):
    return H.ownership(changes(spark, folder), commits(spark, folder))


def active_contributors(spark, folder):
    return H.active_contributors(commits(spark, folder))


def _people(spark, folder):
    key = F.col("c_custkey")
    name = F.concat(F.lit("dev"), (key % 400).cast("string"))
    email = F.when(key % 3 == 0, F.concat(key.cast("string"), F.lit("+"), name, F.lit("@users.noreply.example"))).otherwise(F.concat(name, F.lit("."), (key % 5).cast("string"), F.lit("@mail.example")))
    return table(spark, folder, "customer").select(key.alias("key"), name.alias("name"), email.alias("email"))


def identity_fold(spark, folder):
    return H.fold_identities(_people(spark, folder).drop("key"))


def _parts(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("dir"), F.col("p_type").alias("subsystem"))


def commit_features(spark, folder):
    f = H.commit_features(changes(spark, folder), _parts(spark, folder))
    return f.select("sha", F.round("la", 4).alias("la"), F.round("ld", 4).alias("ld"), "nf", "nd", "ns", F.round("entropy", 6).alias("entropy"))


def author_experience(spark, folder):
    return H.author_experience(commits(spark, folder)).select("sha", "author", "exp")


def _risk(spark, folder):
    f = H.commit_features(changes(spark, folder), _parts(spark, folder)).join(H.author_experience(commits(spark, folder)).select("sha", "exp"), "sha")
    return H.change_risk(f).select("sha", "risk", "risk_level")


def change_risk(spark, folder):
    return _risk(spark, folder)


def risk_percentile(spark, folder):
    return H.mid_rank_percentile(_risk(spark, folder).select("sha", "risk"), "risk")


def fix_history(spark, folder):
    return H.fix_history(changes(spark, folder), commits(spark, folder))


def _pairs(spark, folder):
    return H.co_change(changes(spark, folder, "l_suppkey"), commits(spark, folder))


def co_change_pairs(spark, folder):
    return _pairs(spark, folder)


def change_entropy(spark, folder):
    return H.change_entropy(changes(spark, folder, "l_suppkey"), commits(spark, folder))


def co_change_scatter(spark, folder):
    return H.coupling_scatter(_pairs(spark, folder))


def hidden_coupling(spark, folder):
    x = changes(spark, folder, "l_suppkey")
    nation = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("path"), "s_nationkey")
    pairs = _pairs(spark, folder)
    linked = pairs.select("path", "partner").join(nation, "path").join(nation.select(F.col("path").alias("partner"), "s_nationkey"), ["partner", "s_nationkey"]).select("path", "partner")
    per = x.groupBy("path").agg(F.countDistinct("sha").alias("commits"))
    return H.hidden_coupling(pairs, per, linked, least=0.01)


QUERIES = {f.__name__: f for f in (file_activity, hotspots, ownership, active_contributors, identity_fold, commit_features, author_experience, change_risk, risk_percentile, fix_history, co_change_pairs, change_entropy, co_change_scatter, hidden_coupling)}

SQL = {
    "file_activity": _ACTIVITY + " SELECT * FROM activity",
    "hotspots": _ACTIVITY + ", r AS (SELECT *, round((row_number() OVER (ORDER BY temporal, c90, path) - 1) / count(*) OVER (), 6) AS percentile FROM activity) SELECT path, c90, temporal, percentile FROM r WHERE percentile >= 0.75 AND (c90 >= 8 OR (c90 >= 3 AND temporal >= 0.5))",
    "ownership": _OWNERS,
    "active_contributors": f"WITH {FRAMES['commits']}, aged AS (SELECT author, {_age('commits')} AS age FROM commits) SELECT count(DISTINCT CASE WHEN age <= 90 THEN author END) AS active, count(DISTINCT author) AS ever FROM aged",
    "identity_fold": """WITH p AS (SELECT DISTINCT 'dev' || (c_custkey % 400) AS name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey || '+dev' || (c_custkey % 400) || '@users.noreply.example' ELSE 'dev' || (c_custkey % 400) || '.' || (c_custkey % 5) || '@mail.example' END AS email FROM customer),
real AS (SELECT name, min(email) AS one FROM p WHERE email NOT LIKE '%noreply%' GROUP BY name HAVING count(DISTINCT email) = 1)
SELECT name, email, CASE WHEN email LIKE '%noreply%' THEN coalesce(one, email) ELSE email END AS canonical FROM p LEFT JOIN real USING (name)""",
    "commit_features": _FEATURES + " SELECT sha, round(la, 4) AS la, round(ld, 4) AS ld, nf, nd, ns, round(entropy, 6) AS entropy FROM features",
    "author_experience": _FEATURES + " SELECT sha, author, exp FROM experience",
    "change_risk": _RISK + " SELECT sha, risk, CASE WHEN risk >= 7 THEN 'high' WHEN risk >= 4 THEN 'moderate' ELSE 'low' END AS risk_level FROM risky",
    "risk_percentile": _RISK + " SELECT sha, risk, round(100.0 * (rank() OVER (ORDER BY risk) - 1 + 0.5 * count(*) OVER (PARTITION BY risk)) / count(*) OVER (), 6) AS percentile FROM risky",
    "fix_history": _WITH + f"""x AS (SELECT c.path, is_fix, ((SELECT max(floor(epoch(ts))) FROM changes) - floor(epoch(c.ts))) / 86400.0 AS age FROM changes c JOIN commits m USING (sha)),
f AS (SELECT path, count(*) FILTER (is_fix AND age <= 180) AS prior_defects, round(sum(CASE WHEN is_fix THEN pow(0.5, age / 365) ELSE 0 END), 6) AS fix_pressure, round(sum(CASE WHEN is_fix THEN pow(0.5, age / 90) ELSE 0 END), 6) AS fix_mass, round(count(*) FILTER (is_fix) / count(*), 6) AS fix_share FROM x GROUP BY path)
SELECT *, fix_mass >= 3 AS bug_magnet FROM f""",
    "co_change_pairs": _PAIRS + " SELECT * FROM pairs",
    "change_entropy": _PAIRS.rsplit("pairs AS", 1)[0] + "e AS (SELECT path, round(sum(exp(-age / 180) * log2(files) / files), 6) AS entropy FROM files JOIN sizes USING (sha) JOIN aged USING (sha) WHERE files BETWEEN 2 AND 30 GROUP BY path) SELECT * FROM e",
    "co_change_scatter": _PAIRS + ", b AS (SELECT path, partner, strength FROM pairs UNION ALL SELECT partner, path, strength FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY strength DESC, partner) AS rn FROM b) SELECT path, count(*) AS partners, max(CASE WHEN rn = 1 THEN partner END) AS strongest, max(strength) AS strength FROM r GROUP BY path",
    "hidden_coupling": _PAIRS + """, per AS (SELECT path, count(DISTINCT sha) AS commits FROM changes GROUP BY path), b AS (SELECT path, partner, joint FROM pairs UNION ALL SELECT partner, path, joint FROM pairs),
x AS (SELECT b.path, partner, joint, round(joint / least(o.commits, t.commits), 6) AS correlation FROM b JOIN per o ON o.path = b.path JOIN per t ON t.path = partner JOIN supplier sa ON sa.s_suppkey = b.path JOIN supplier sb ON sb.s_suppkey = partner WHERE sa.s_nationkey <> sb.s_nationkey AND o.commits >= 5 AND t.commits >= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY correlation DESC, partner) AS rn FROM x WHERE correlation >= 0.01)
SELECT path, partner, joint, correlation, CASE WHEN joint < 8 THEN 'medium' WHEN correlation >= 0.8 THEN 'critical' WHEN correlation >= 0.65 THEN 'high' ELSE 'medium' END AS severity FROM r WHERE rn <= 3""",
}
