"""Activity, ownership, risk and co-change over commits and file changes.

Every operator takes its `as_of` from the newest row of its input, never from the clock.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gantry.operators.skew import distributed_rank
from gantry.session import Scratch

DAY = 86400.0
#: Decay times in days, floors and caps of the measures.
HOTSPOT_HALF_LIFE, CHURN_UNIT, CHURN_CAP = 180.0, 100.0, 3.0
CO_CHANGE_TAU, CO_CHANGE_FILES, CO_CHANGE_FLOOR, ENTROPY_FILES = 180.0, 200, 2.0, 30
PRESSURE_HALF_LIFE, MASS_HALF_LIFE, MAGNET, DEFECT_DAYS = 365.0, 90.0, 3.0, 180
#: Fixed values of the change-risk model: mean, deviation and coefficient of la, ld, nf, nd, ns, entropy, exp.
RISK_MEAN = [2.443, 1.723, 1.006, 0.795, 0.806, 0.537, 3.011]
RISK_STD = [1.414, 1.380, 0.465, 0.237, 0.285, 0.776, 2.270]
RISK_COEF = [1.1241, 0.0151, -0.1103, -0.0310, -0.0672, 0.1483, -0.0702]
RISK_INTERCEPT = -0.3797


def with_age(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds age_days: days from the row's time to the newest time of the frame (null times stay null)."""
    newest = df.agg(F.max(F.unix_timestamp(ts)).alias("_as_of"))
    return df.crossJoin(F.broadcast(newest)).withColumn("age_days", (F.col("_as_of") - F.unix_timestamp(ts)) / DAY).drop("_as_of")


def file_activity(changes: DataFrame) -> DataFrame:
    """Per path: commits in all, in 90 and in 30 days, lines added and deleted in 90 days, first and last change, decayed score."""
    x = with_age(changes)
    near, nearer = F.col("age_days") <= 90, F.col("age_days") <= 30
    churn = F.least((F.col("added") + F.col("deleted")) / CHURN_UNIT, F.lit(CHURN_CAP))
    return x.groupBy("path").agg(
        F.countDistinct("sha").alias("commits"), F.count_if(near).alias("c90"), F.count_if(nearer).alias("c30"),
        F.round(F.sum(F.when(near, F.col("added")).otherwise(0.0)), 4).alias("added_90"), F.round(F.sum(F.when(near, F.col("deleted")).otherwise(0.0)), 4).alias("deleted_90"),
        F.round(F.max("age_days"), 4).alias("age_days"), F.round(F.min("age_days"), 4).alias("idle_days"),
        F.round(F.sum(F.exp(-F.lit(math.log(2)) * F.col("age_days") / HOTSPOT_HALF_LIFE) * churn), 6).alias("temporal"),
    )


def hotspots(activity: DataFrame) -> DataFrame:
    """Adds the churn percentile (rank from below over the count) and keeps the rows above the floors.

    The rank over all files is a single order; it is found by range-partitioned ranks.
    """
    activity = Scratch(activity.sparkSession, "activity").write(activity)  # counted and ranked
    total = activity.agg(F.count(F.lit(1)).alias("_n"))
    ranked = distributed_rank(activity, [], [F.col("temporal"), F.col("c90"), F.col("path")], "_rank")
    scored = ranked.crossJoin(F.broadcast(total)).withColumn("percentile", F.round((F.col("_rank") - 1) / F.col("_n"), 6)).drop("_rank", "_n")
    floor = (F.col("c90") >= 8) | ((F.col("c90") >= 3) & (F.col("temporal") >= 0.5))
    return scored.filter((F.col("percentile") >= 0.75) & floor)


def ownership(changes: DataFrame, authors: DataFrame) -> DataFrame:
    """Per path: main author with share, main author of 90 days with share, contributors, bus factor.

    changes(sha, path, ts) joined with authors(sha, author). The bus factor is the least number of
    authors who made 80 % of the commits. Ties go to the smaller author.
    """
    x = with_age(changes).join(authors.select("sha", "author"), "sha")
    by = x.groupBy("path", "author").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("age_days") <= 90).alias("n90"))
    path = Window.partitionBy("path")
    order = path.orderBy(F.col("n").desc(), "author")
    shares = by.withColumn("total", F.sum("n").over(path)).withColumn("recent", F.sum("n90").over(path)).withColumn("rn", F.row_number().over(order))
    shares = shares.withColumn("cum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return shares.groupBy("path").agg(
        F.min_by("author", F.struct(-F.col("n"), "author")).alias("owner"), F.round(F.max(F.col("n") / F.col("total")), 6).alias("owner_share"),
        F.min_by(F.when(F.col("n90") > 0, F.col("author")), F.struct(-F.col("n90"), "author")).alias("recent_owner"),
        F.round(F.max(F.when(F.col("recent") > 0, F.col("n90") / F.col("recent"))), 6).alias("recent_share"),
        F.count(F.lit(1)).alias("contributors"), F.min(F.when(F.col("cum") >= 0.8 * F.col("total"), F.col("rn"))).alias("bus_factor"),
        F.count_if(F.col("n") / F.col("total") < 0.05).alias("minor_authors"),
    )


def active_contributors(commits: DataFrame) -> DataFrame:
    """One row: distinct authors within 90 days of the newest commit, and in all."""
    return with_age(commits).agg(F.countDistinct(F.when(F.col("age_days") <= 90, F.col("author"))).alias("active"), F.countDistinct("author").alias("ever"))


def fold_identities(people: DataFrame) -> DataFrame:
    """name, email, canonical: a no-reply address becomes the one real address of the same name, if there is exactly one."""
    noreply = F.col("email").rlike(r"(?i)noreply")
    real = people.filter(~noreply & F.col("email").isNotNull()).groupBy("name").agg(F.min("email").alias("_one"), F.countDistinct("email").alias("_n")).filter("_n = 1").drop("_n")
    return people.select("name", "email").distinct().join(real, "name", "left").withColumn("canonical", F.when(noreply, F.coalesce("_one", "email")).otherwise(F.col("email"))).drop("_one")


def commit_features(changes: DataFrame, parts: DataFrame) -> DataFrame:
    """Per commit: lines added and deleted, files, directories, subsystems, entropy of the churn shares (0 below two files).

    parts(path, dir, subsystem).
    """
    per = changes.groupBy("sha", "path").agg(F.sum("added").alias("la"), F.sum("deleted").alias("ld")).join(parts, "path", "left")
    per = per.withColumn("churn", F.col("la") + F.col("ld")).withColumn("total", F.sum("churn").over(Window.partitionBy("sha")))
    p = F.when((F.col("total") > 0) & (F.col("churn") > 0), F.col("churn") / F.col("total"))
    out = per.groupBy("sha").agg(
        F.sum("la").alias("la"), F.sum("ld").alias("ld"), F.count(F.lit(1)).alias("nf"), F.countDistinct("dir").alias("nd"), F.countDistinct("subsystem").alias("ns"),
        F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("entropy"),
    )
    return out.withColumn("entropy", F.when(F.col("nf") < 2, 0.0).otherwise(F.col("entropy")))


def author_experience(commits: DataFrame) -> DataFrame:
    """Adds exp: commits of the same author before this one, by time and sha."""
    ranked = distributed_rank(commits, ["author"], [F.col("ts"), F.col("sha")], "exp")  # an author of any size, as a bot
    return ranked.withColumn("exp", F.col("exp") - 1)


def change_risk(features: DataFrame) -> DataFrame:
    """Adds risk (0 to 10) and risk_level of features(la, ld, nf, nd, ns, entropy, exp); an unknown exp adds nothing."""
    z: Column = F.lit(RISK_INTERCEPT)
    for name, mean, std, coef in zip(["la", "ld", "nf", "nd", "ns", "entropy", "exp"], RISK_MEAN, RISK_STD, RISK_COEF):
        x = F.col(name).cast("double") if name == "entropy" else F.log1p(F.col(name).cast("double"))
        z = z + F.coalesce(F.lit(coef) * (x - F.lit(mean)) / F.lit(std), F.lit(0.0))
    risk = F.round(F.lit(10.0) / (F.lit(1.0) + F.exp(-z)), 4)
    level = F.when(F.col("risk") >= 7, "high").when(F.col("risk") >= 4, "moderate").otherwise("low")
    return features.withColumn("risk", risk).withColumn("risk_level", level)


def mid_rank_percentile(df: DataFrame, value: str, name: str = "percentile") -> DataFrame:
    """Adds 100 * (below + half of the equal) / n; equal values are counted before they are ordered."""
    df = Scratch(df.sparkSession, "scores").write(df)  # counted, then joined
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    upto = distributed_rank(counts, [], [F.col(value)], "_r", weight="_n", total="_upto").drop("_r")
    total = counts.agg(F.sum("_n").alias("_t"))
    pct = upto.crossJoin(F.broadcast(total)).select(value, F.round(100.0 * (F.col("_upto") - F.col("_n") / 2) / F.col("_t"), 6).alias(name))
    return df.join(pct, value)


def fix_history(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Per path: fixes in 180 days, fix pressure and mass (decayed sums), whether it is a bug magnet, share of fixes."""
    x = with_age(changes.join(commits.select("sha", "is_fix"), "sha"))
    decay = lambda days: F.pow(F.lit(0.5), F.col("age_days") / days)
    fix = F.col("is_fix")
    out = x.groupBy("path").agg(
        F.count_if(fix & (F.col("age_days") <= DEFECT_DAYS)).alias("prior_defects"), F.round(F.sum(F.when(fix, decay(PRESSURE_HALF_LIFE)).otherwise(0.0)), 6).alias("fix_pressure"),
        F.round(F.sum(F.when(fix, decay(MASS_HALF_LIFE)).otherwise(0.0)), 6).alias("fix_mass"), F.round(F.count_if(fix) / F.count(F.lit(1)), 6).alias("fix_share"),
    )
    return out.withColumn("bug_magnet", F.col("fix_mass") >= MAGNET)


def co_change(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Pairs of paths changed together: decayed strength of at least the floor, joint commits and the last of them.

    Commits of one file or of more than CO_CHANGE_FILES say nothing (a rule of the measure), which
    also bounds the pairs of a commit. Repeated rows of a path in a commit count once.
    """
    aged = with_age(commits).select("sha", "ts", "age_days")
    files = changes.select("sha", "path").distinct()
    sizes = files.groupBy("sha").agg(F.count(F.lit(1)).alias("files")).filter(F.col("files").between(2, CO_CHANGE_FILES))
    kept = files.join(sizes.select("sha"), "sha").join(aged, "sha")
    a, b = kept.alias("a"), kept.select("sha", F.col("path").alias("partner")).alias("b")
    pairs = a.join(b, "sha").filter(F.col("path") < F.col("partner"))
    w = F.exp(-F.col("age_days") / CO_CHANGE_TAU)
    out = pairs.groupBy("path", "partner").agg(F.round(F.sum(w), 6).alias("strength"), F.count(F.lit(1)).alias("joint"), F.max("ts").alias("last"))
    return out.filter(F.col("strength") >= CO_CHANGE_FLOOR)


def change_entropy(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Per path the decayed sum of log2(n) / n over its commits of 2 to ENTROPY_FILES files."""
    files = changes.select("sha", "path").distinct()
    sizes = files.groupBy("sha").agg(F.count(F.lit(1)).alias("files")).filter(F.col("files").between(2, ENTROPY_FILES))
    x = files.join(sizes, "sha").join(with_age(commits).select("sha", "age_days"), "sha")
    w = F.exp(-F.col("age_days") / CO_CHANGE_TAU)
    return x.groupBy("path").agg(F.round(F.sum(w * F.log2("files") / F.col("files")), 6).alias("entropy"))


def coupling_scatter(pairs: DataFrame) -> DataFrame:
    """Per path: partners of strength 2 or more, and the strongest partner."""
    both = pairs.select("path", "partner", "strength").unionByName(pairs.select(F.col("partner").alias("path"), F.col("path").alias("partner"), "strength"))
    return both.groupBy("path").agg(F.count(F.lit(1)).alias("partners"), F.min_by("partner", F.struct(-F.col("strength"), "partner")).alias("strongest"), F.max("strength").alias("strength"))


def hidden_coupling(pairs: DataFrame, commits_per_path: DataFrame, linked: DataFrame, least: float = 0.5) -> DataFrame:
    """The three strongest partners of each path that share `least` of the rarer side's commits without a link.

    commits_per_path(path, commits); linked(path, partner) in either direction.
    """
    both = pairs.select("path", "partner", "joint").unionByName(pairs.select(F.col("partner").alias("path"), F.col("path").alias("partner"), "joint"))
    known = linked.select("path", "partner").unionByName(linked.select(F.col("partner").alias("path"), F.col("path").alias("partner"))).distinct()
    own = commits_per_path.select("path", F.col("commits").alias("own"))
    other = commits_per_path.select(F.col("path").alias("partner"), F.col("commits").alias("theirs"))
    x = both.join(known, ["path", "partner"], "left_anti").join(own, "path").join(other, "partner").filter("own >= 5 and theirs >= 5")
    x = x.withColumn("correlation", F.round(F.col("joint") / F.least("own", "theirs"), 6)).filter(F.col("correlation") >= least)
    severity = F.when(F.col("joint") < 8, "medium").when(F.col("correlation") >= 0.8, "critical").when(F.col("correlation") >= 0.65, "high").otherwise("medium")
    top = Window.partitionBy("path").orderBy(F.col("correlation").desc(), "partner")
    return x.withColumn("severity", severity).withColumn("rn", F.row_number().over(top)).filter("rn <= 3").select("path", "partner", "joint", "correlation", "severity")
