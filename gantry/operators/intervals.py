"""Interval, as-of and array-overlap joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a bucket: intervals are cut into buckets, so that an overlap is an equi-join.
BUCKET = 64


def _buckets(lo: str, hi: str):
    return F.explode(F.sequence(F.floor(F.col(lo) / BUCKET), F.floor(F.col(hi) / BUCKET)))


def overlaps(spans: DataFrame, ranges: DataFrame, on: list[str]) -> DataFrame:
    """Each span (span_id, lo, hi) with each range (range_id, rlo, rhi) of the same key that overlaps it, once.

    A pair is kept in the first bucket that both reach, so no pair comes out twice. Null or inverted
    bounds overlap nothing.
    """
    a = spans.filter("lo <= hi").withColumn("_b", _buckets("lo", "hi"))
    b = ranges.filter("rlo <= rhi").withColumn("_b", _buckets("rlo", "rhi"))
    met = a.join(b, [*on, "_b"]).filter((F.col("lo") <= F.col("rhi")) & (F.col("rlo") <= F.col("hi")))
    return met.filter(F.col("_b") == F.floor(F.greatest("lo", "rlo") / BUCKET)).drop("_b")


def innermost(pairs: DataFrame, range_id: str = "range_id") -> DataFrame:
    """Of the spans that overlap a range the shortest ones; equal spans all stay."""
    size = F.col("hi") - F.col("lo")
    return pairs.withColumn("_m", F.min(size).over(Window.partitionBy(range_id))).filter(size == F.col("_m")).drop("_m")


def as_of(left: DataFrame, right: DataFrame, on: list[str], at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time.

    One union and one window instead of a range join; among right rows of one time the greatest
    values win. Left rows without such a row get nulls.
    """
    names = [c for c in left.columns if c not in (*on, at)]
    l = left.select(*on, at, F.lit(1).alias("_side"), F.struct(*names).alias("_left"), *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    r = right.select(*on, at, F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), *values)
    order = Window.partitionBy(*on).orderBy(at, "_side", *values).rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("_side") == 0, F.struct(*values)), ignorenulls=True).over(order)
    out = l.unionByName(r).withColumn("_v", latest).filter("_side = 1")
    return out.select(*on, at, "_left.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def covered_tests(changed: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per changed file the tests whose covered lines meet its changed lines: changed(file, lines), coverage(test, file, lines)."""
    both = changed.join(coverage.select("test", "file", F.col("lines").alias("covered")), "file")
    shared = F.size(F.array_intersect("lines", "covered"))
    return both.withColumn("shared", shared).filter("shared > 0").select("file", "test", "shared")


def union_length(ranges: DataFrame, key: str) -> DataFrame:
    """Per key the number of lines in the union of its ranges (lo, hi), by gaps and islands."""
    before = Window.partitionBy(key).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    x = ranges.filter("lo <= hi").withColumn("reach", F.max("hi").over(before))
    fresh = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo") - 1, F.coalesce("reach", F.col("lo") - 1)))
    return x.groupBy(key).agg(F.sum(fresh).cast("long").alias("lines"))
