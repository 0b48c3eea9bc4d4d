import random

from pyspark.sql import functions as F

from gantry.operators import skew


def test_distributed_rank_matches_a_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, rng.randint(1, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, w int")
    got = {r["x"]: (r["rn"], r["total"]) for r in skew.distributed_rank(df, ["g"], [F.col("x").desc()], "rn", weight="w", total="total").collect()}
    want = {r["x"]: (r["a"], r["b"]) for r in df.selectExpr("x", "row_number() over (partition by g order by x desc) a", "sum(w) over (partition by g order by x desc rows unbounded preceding) b").collect()}
    assert got == want
    assert skew.distributed_rank(df.limit(0), ["g"], [F.col("x")]).count() == 0
    every = sorted((r["rn"], r["x"]) for r in skew.distributed_rank(df, [], [F.col("x")]).collect())
    assert every == [(i + 1, i) for i in range(3000)]


def test_lookup_salts_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 7}" if i % 4 else None, i) for i in range(2000)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("k9", 3)], "k string, v int")
    assert skew.hot_keys(left, ["k"]) is not None
    for how in ("left", "inner", "left_semi"):
        assert sorted(map(str, skew.lookup(left, right, ["k"], how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
