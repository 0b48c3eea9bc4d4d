import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gantry.operators.hierarchy import descendants, resolve_hierarchy
from gantry.operators.orphans import BloomFilter, orphan_counts, orphan_references

REFS, PARENTS, GONE = "ref_id string, side string, scope string, kind string, key string, at timestamp", "scope string, kind string, key string, born timestamp", "scope string, kind string, key string, removed_at timestamp"


def _t(day):
    return datetime(2024, 1, day)


def test_orphan_reasons_nulls_and_duplicates(spark):
    refs = [
        ("1", "source", "r", "node", "a", _t(5)), ("1", "source", "r", "node", "a", _t(5)), ("2", "target", "r", "node", "zz", _t(5)), ("3", "target", "r", "node", "late", _t(5)), ("4", "target", "r", "node", "gone", _t(5)),
        ("5", "target", "r", "node", "gone", _t(2)), ("6", "target", "r", "node", "late", None), ("7", "target", "r", "node", "gone", None), ("8", "target", "r", "node", None, _t(5)), ("9", "target", "s", "node", "a", _t(5)),
        ("10", "target", "r", "external", "a", _t(5)), ("11", "target", "r", "node", "unborn", _t(5)), ("12", "target", "r", "node", "A", _t(5)), ("13", "target", "r", "node", "", _t(5)), ("14", "target", "r", "node", "gone", _t(3)),
    ]
    parents = [("r", "node", "a", _t(1)), ("r", "node", "a", _t(1)), ("r", "node", "late", _t(9)), ("r", "node", "gone", _t(1)), ("r", "node", "unborn", None), ("r", "node", None, _t(1))]
    gone = [("r", "node", "gone", _t(3)), ("r", "node", "gone", _t(8)), ("r", "node", "a", None)]
    found = orphan_references(spark.createDataFrame(refs, REFS).withColumn("v", F.lit(1)), spark.createDataFrame(parents, PARENTS), spark.createDataFrame(gone, GONE))
    assert {(r["ref_id"], r["reason"]) for r in found.collect()} == {("2", "missing"), ("3", "late"), ("4", "deleted"), ("14", "deleted"), ("9", "missing"), ("10", "missing"), ("12", "missing"), ("13", "missing")}
    assert found.count() == 8 and orphan_counts(found).agg(F.sum("orphans")).first()[0] == 8
    nothing = spark.createDataFrame([], PARENTS)
    assert orphan_references(spark.createDataFrame(refs, REFS), nothing, spark.createDataFrame([], GONE)).count() == 13
    assert orphan_references(spark.createDataFrame([], REFS), nothing, spark.createDataFrame([], GONE)).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    bloom = BloomFilter(keys, ["k"], 5000)
    assert keys.filter(~bloom.might_contain(["k"])).count() == 0
    assert spark.range(5000, 15000).select(F.concat(F.lit("k"), "id").alias("k")).filter(bloom.might_contain(["k"])).count() < 700


def _brute(links):
    parent, ids = {}, set()
    for s, c, p in links:
        if s is None or c is None:
            continue
        ids.add((s, c))
        if p is not None:
            ids.add((s, p))
            parent[s, c] = p
    out = {}
    for s, n in ids:
        path, at, seen = [], n, set()
        while at is not None and at not in seen:
            seen.add(at)
            path.append(at)
            at = parent.get((s, at))
        out[s, n] = ("", -1, None) if at is not None else (path[-1], len(path) - 1, list(reversed(path)))
    sizes = {k: sum(1 for (s, m), v in out.items() if s == k[0] and v[2] and k[1] in v[2]) for k in out}
    return {k: (*v, sizes[k] if v[1] >= 0 else None) for k, v in out.items()}


def _shapes():
    rng = random.Random(7)
    yield [("s", f"n{i:03}", f"n{i - 1:03}") for i in range(1, 120)]
    yield [("s", f"leaf{i}", "hub") for i in range(200)]
    yield [("s", "a", "b"), ("s", "b", "a"), ("s", "c", "a"), ("s", "self", "self"), ("s", "d", "c"), ("t", "a", "b"), ("t", "root", None), (None, "x", "y"), ("s", None, "y"), ("t", "a", "b")]
    yield [(rng.choice("st"), f"n{i}", f"n{rng.randrange(max(1, i - 6), i + 1) if rng.random() < 0.9 else rng.randrange(80)}") for i in range(1, 80)]


@pytest.mark.parametrize("links", list(_shapes()), ids=["chain", "star", "cycles", "random"])
def test_hierarchy_equals_brute_force(spark, links):
    df = spark.createDataFrame(links, "scope string, child string, parent string").withColumn("depth", F.lit("clash"))
    want = _brute([r for r in links])
    got = {(r["scope"], r["node"]): (r["root_id"], r["depth"], r["path"], r["subtree_size"]) for r in resolve_hierarchy(df, with_paths=True).collect()}
    assert got == want
    slim = {(r["scope"], r["node"]): (r["root_id"], r["depth"]) for r in resolve_hierarchy(df).collect()}
    assert slim == {k: v[:2] for k, v in want.items()}


@pytest.mark.parametrize("links", list(_shapes())[2:], ids=["cycles", "random"])
def test_descendants_equal_brute_force(spark, links):
    links = links + [("u", f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("u", "x0", "r3")] + [("u", f"x{i + 1}", f"x{i}") for i in range(6)] + [("u", "y", "x2")]
    parent = {(s, c): p for s, c, p in sorted(links, key=str) if None not in (s, c, p)}
    parent = {k: max(p for s, c, p in links if (s, c) == k and p is not None) for k in parent}
    want = set()
    for s, n in parent:
        at, seen = parent.get((s, n)), set()
        while at is not None and at not in seen:
            seen.add(at)
            at = parent.get((s, at))
        want |= {(s, a, n) for a in seen if a != n}
    got = [tuple(r) for r in descendants(spark.createDataFrame(links, "scope string, child string, parent string")).collect()]
    assert set(got) == want and len(got) == len(want)


def test_empty_hierarchy(spark):
    assert resolve_hierarchy(spark.createDataFrame([], "scope string, child string, parent string")).count() == 0
