"""Problem 7: one ranking from differently-scaled scores, by outranking net flow on percentiles.

Each score becomes a mid-rank percentile within its scope, so units, outliers and gaps don't
matter. For every score an item's flow is the mean preference over all others minus theirs over it,
with a linear preference between an indifference and a strict threshold. Both sums are exact, from
prefix sums over the sorted percentiles; no pair is formed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gantry.operators.skew import distributed_rank, lookup
from gantry.session import Scratch

#: Preference is 0 up to INDIFFERENT and 1 from STRICT on, as differences of percentiles (0 to 1).
INDIFFERENT, STRICT = 0.02, 0.5
#: Percentiles are whole numbers of this many steps, so that sums are exact; different values of one scope never share one below 5 * 10**14 items.
STEPS = 10**15
#: Blocks of the percentile axis; sums over whole blocks come first, then those within one.
BLOCKS = 10_000


def percentiles(values: DataFrame) -> DataFrame:
    """scope, metric, value, n (items of the value), at (its mid-rank percentile in STEPS).

    values: scope, metric, value without nulls. Equal values share one percentile.
    """
    scratch = Scratch(values.sparkSession, "percentiles")
    distinct = scratch.write(values.groupBy("scope", "metric", "value").agg(F.count(F.lit(1)).alias("n")))
    totals = distinct.groupBy("scope", "metric").agg(F.sum("n").alias("total"))
    ranked = distributed_rank(distinct, ["scope", "metric"], [F.col("value")], "_rn", weight="n", total="upto")
    joined = ranked.drop("_rn").join(totals, ["scope", "metric"])
    at = F.expr(f"((2 * upto - n) * {STEPS}BD) div (2 * total)")  # a decimal times steps: whole numbers throughout
    return joined.select("scope", "metric", "value", "n", at.alias("at"))


def net_flows(points: DataFrame) -> DataFrame:
    """scope, metric, at, flow of points(scope, metric, at, n): mean preference over all items less that of all over it."""
    q, p = round(INDIFFERENT * STEPS), round(STRICT * STEPS)
    points = Scratch(points.sparkSession, "flows").write(points.groupBy("scope", "metric", "at").agg(F.sum("n").alias("n")))
    zero, nothing = F.lit(0).cast("long"), F.lit(0).cast("decimal(38,0)")
    # a probe asks for count and sum of all points up to a place; places are named by what they are for
    probes = points.select("scope", "metric", F.explode(F.array(*[F.struct((F.col("at") + d).alias("place"), F.lit(name).alias("ask"), F.col("at")) for name, d in (("a", -p), ("b", -q), ("c", q), ("d", p))])).alias("x"))
    probes = probes.select("scope", "metric", "x.place", "x.ask", "x.at", zero.alias("n"), nothing.alias("s"))
    own = points.select("scope", "metric", F.col("at").alias("place"), F.lit(None).cast("string").alias("ask"), "at", "n", (F.col("n").cast("decimal(19,0)") * F.col("at").cast("decimal(18,0)")).cast("decimal(38,0)").alias("s"))
    rows = own.unionByName(probes).withColumn("block", F.expr(f"place div {STEPS // BLOCKS}"))
    sums = rows.groupBy("scope", "metric", "block").agg(F.sum("n").alias("bn"), F.sum("s").alias("bs"))
    before = Window.partitionBy("scope", "metric").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * BLOCKS rows
    sums = sums.select("scope", "metric", "block", F.coalesce(F.sum("bn").over(before), zero).alias("n0"), F.coalesce(F.sum("bs").over(before), nothing).alias("s0"))
    # within a block points come before the probes of the same place
    within = Window.partitionBy("scope", "metric", "block").orderBy("place", F.col("ask").asc_nulls_first(), "at").rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.withColumn("n1", F.sum("n").over(within)).withColumn("s1", F.sum("s").over(within)).join(sums, ["scope", "metric", "block"])
    answer = upto.filter("ask is not null").select("scope", "metric", "at", "ask", (F.col("n0") + F.col("n1")).cast("double").alias("n"), (F.col("s0") + F.col("s1")).cast("double").alias("s"))
    pick = lambda ask, c: F.max(F.when(F.col("ask") == ask, F.col(c))).alias(f"{ask}{c}")
    wide = answer.groupBy("scope", "metric", "at").agg(*[pick(a, c) for a in "abcd" for c in ("n", "s")])
    total = points.groupBy("scope", "metric").agg(F.sum("n").alias("total"))
    at = F.col("at").cast("double")
    span = float(p - q)
    over = F.col("an") + ((at - q) * (F.col("bn") - F.col("an")) - (F.col("bs") - F.col("as"))) / span
    under = (F.col("total") - F.col("dn")) + ((F.col("ds") - F.col("cs")) - (at + q) * (F.col("dn") - F.col("cn"))) / span
    flow = F.when(F.col("total") > 1, (over - under) / (F.col("total") - 1)).otherwise(0.0)
    return wide.join(total, ["scope", "metric"]).select("scope", "metric", "at", flow.alias("flow"))


def outranking(items: DataFrame, keys: list[str], unit: str, scores: dict[str, float]) -> DataFrame:
    """Adds net flows and ranks to items(*keys, unit, *scores), unique by their keys.

    scores: column -> weight. unit: the column within which a score has one unit (percentiles are
    taken there). Gives flow and unit_rank against the items of the same unit, and overall_flow and
    overall_rank against all, both from the unit's percentiles. Null and NaN scores are gaps: they
    prefer nothing and nothing is preferred to them. Ties are broken by the keys. Items with a null
    unit form a unit of their own.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "rank")
    pair = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in scores]))
    slim = scratch.write(items.select(*keys, *[F.col(m) for m in scores], F.coalesce(F.col(unit), F.lit("")).alias("scope")))
    long = slim.select(*keys, "scope", pair.alias("x")).select(*keys, "scope", "x.*").filter("value is not null and not isnan(value)")
    placed = scratch.write(percentiles(long.select("scope", "metric", "value")))
    local = net_flows(placed.select("scope", "metric", "at", "n"))
    everywhere = net_flows(placed.select(F.lit("").alias("scope"), "metric", "at", "n")).select("metric", "at", F.col("flow").alias("overall"))
    flows = placed.drop("n").join(local, ["scope", "metric", "at"]).join(everywhere, ["metric", "at"])
    weight = reduce(lambda acc, m: acc.when(F.col("metric") == m, F.lit(float(scores[m]))), list(scores)[1:], F.when(F.col("metric") == list(scores)[0], F.lit(float(scores[list(scores)[0]]))))
    scale = sum(scores.values())
    summed = lookup(long, flows, ["scope", "metric", "value"], "inner").groupBy(*keys).agg((F.sum(weight * F.col("flow")) / scale).alias("flow"), (F.sum(weight * F.col("overall")) / scale).alias("overall_flow"))
    joined = slim.join(summed, keys, "left").fillna(0.0, ["flow", "overall_flow"])
    joined = joined.withColumn("flow", F.round("flow", 9)).withColumn("overall_flow", F.round("overall_flow", 9))
    order = [F.col(k).asc_nulls_first() for k in keys]
    ranked = distributed_rank(joined, ["scope"], [F.col("flow").desc(), *order], "unit_rank")
    return distributed_rank(ranked, [], [F.col("overall_flow").desc(), *order], "overall_rank").drop("scope")
