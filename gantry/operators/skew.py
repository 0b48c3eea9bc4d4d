"""Ranks, prefix sums and lookups whose largest task doesn't grow with the largest key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gantry.session import Scratch

#: Fewer rows of one key than this are left to one task.
HOT_ROWS = 200_000
#: A hot key holds at least this share of all rows, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.00001
#: A hot key is spread over one salt for so many of its rows, within these bounds.
SALT_ROWS, LEAST_SALTS, MOST_SALTS = 500_000, 8, 8192


def distributed_rank(df: DataFrame, groups: list[str], orders: list[Column], name: str = "rn", weight: str | None = None, total: str | None = None) -> DataFrame:
    """Adds the 1-based rank of each row within its group, and the running sum of `weight` as `total`.

    The rows are range-partitioned by (groups, orders), ranked within each slice of a group that
    one partition holds, and shifted by the sizes of the slices before it. A group of any size is
    thus spread over as many tasks as its rows need. `orders` must be a total order within a group.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "rank")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in groups]
    ranged = df.repartitionByRange(parts, *keys, *orders).withColumn("_slice", F.spark_partition_id())
    ranged = scratch.write(ranged)
    value = F.col(weight) if weight else F.lit(0)
    by = ["_slice", *groups]
    sizes = ranged.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_w"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0"))
    within = Window.partitionBy(*by).orderBy(*orders)
    out = ranged.withColumn("_r", F.row_number().over(within))
    if weight:
        out = out.withColumn("_s", F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.lit(True)
    offsets = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in by], "_n0", "_w0")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    out = out.join(offsets, same).withColumn(name, (F.col("_r") + F.col("_n0")).cast("long"))
    if weight and total:
        out = out.withColumn(total, F.col("_s") + F.col("_w0"))
    return out.drop("_slice", "_r", "_s", "_n0", "_w0", *[f"_o_{c}" for c in by])


def hot_keys(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame | None:
    """keys and _salts of the keys that hold HOT_SHARE of all rows or more (at most 1 / HOT_SHARE of them); None if no key is hot."""
    rows = df.count() if rows is None else rows
    if rows < HOT_ROWS:
        return None
    least = max(HOT_ROWS, int(rows * HOT_SHARE))
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= least)
    salts = F.least(F.greatest(F.ceil(F.col("_rows") / SALT_ROWS), F.lit(LEAST_SALTS)), F.lit(MOST_SALTS)).cast("int").alias("_salts")
    found = counted.select(*keys, salts)
    rows = found.collect()
    if not rows:
        return None
    return df.sparkSession.createDataFrame(rows, found.schema)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", rows: int | None = None, hot_from: DataFrame | None = None) -> DataFrame:
    """Joins `left` to `right`, which has one row per key; keys that are hot in `left` are salted.

    Only the hot keys (a bounded number) are broadcast; their rows of `right` are repeated once for
    each of their salts. `keys` must be non-null to match, as in any equi-join. hot_from: a frame with the keys of
    `left` that costs less to count, if `left` is dear to compute.
    """
    hot = hot_keys(left if hot_from is None else hot_from, keys, rows)
    if hot is None:
        return left.join(right, keys, how)
    mark = F.broadcast(hot)
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("_salts")).cast("int")).otherwise(0)
    salted = left.join(mark, keys, "left").withColumn("_salt", salt).drop("_salts")
    spread = F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
    repeated = right.join(mark, keys, "left").withColumn("_salt", F.explode(spread)).drop("_salts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
