"""Roll-ups of append-only logs: costs, sessions, rates, pairs of calls and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gantry.operators.skew import distributed_rank


def rollup(ledger: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Entries, sum and mean of an amount per group, nulls as 0."""
    value = F.coalesce(F.col(amount), F.lit(0.0))
    return ledger.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 4).alias("mean"))


def sessions(events: DataFrame, user: str, gap_minutes: int) -> DataFrame:
    """user, session_no, start, end, events: runs of a user's events with no gap above the limit."""
    w = Window.partitionBy(user).orderBy("ts", "event_id")
    new = F.when(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) <= gap_minutes * 60_000_000, 0).otherwise(1)
    x = events.withColumn("new", new).withColumn("session_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(user, "session_no").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("events"))


def rate_windows(events: DataFrame, user: str, seconds: int, limit: int) -> DataFrame:
    """Events that come when `limit` or more of the same user fall into the last `seconds` (their own included)."""
    w = Window.partitionBy(user).orderBy(F.unix_seconds("ts")).rangeBetween(-seconds, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(w)).filter(F.col("recent") >= limit).select("event_id", user, "recent")


def followed_by(events: DataFrame, user: str, first: str, then: str) -> DataFrame:
    """Per user how often an event of one type is directly followed by one of another."""
    w = Window.partitionBy(user).orderBy("ts", "event_id")
    x = events.withColumn("next", F.lead("event_type").over(w)).filter((F.col("event_type") == first) & (F.col("next") == then))
    return x.groupBy(user).agg(F.count(F.lit(1)).alias("times"))


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; order must be total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def within_budget(items: DataFrame, group: str, size: str, order: list, budget: int) -> DataFrame:
    """The rows of each group, in order, whose running size stays within the budget."""
    ranked = distributed_rank(items, [group], [F.col(c) if isinstance(c, str) else c for c in order], "_place", weight=size, total="used")
    return ranked.drop("_place").filter(F.col("used") <= budget)
