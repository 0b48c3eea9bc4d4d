"""Views and summaries on frames with nulls, ties, self loops, extra columns, and on empty ones."""

from pyspark.sql import functions as F

from gantry.operators import graph as G
from gantry.operators import journeys as J
from gantry.operators import summary as S
from gantry.operators import views as V

EDGE = "scope string, src string, dst string, edge_type string, confidence double, n int"
ROWS = [("r", "a/x", "b/y", "imports", 0.9, 1), ("r", "a/x", "b/y", "imports", 0.9, 1), ("r", "b/y", "b/y", "imports", None, 1), ("r", "b/y", "c/z", "calls", 0.5, 2), ("r", "top", "c/z", "calls", 0.5, 2), ("q", "a/x", "external:p", "imports", 0.4, 3)]


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_graph_views(spark):
    edges = spark.createDataFrame(ROWS, EDGE)
    assert _rows(V.layer_order(edges), "scope", "layer", "net", "place") == [("r", "a", -1, 3), ("r", "b", 0, 2), ("r", "c", 1, 1)]
    assert _rows(V.module_adjacency(edges), "module", "imports", "imported_by") == [("a", 1, 0), ("b", 1, 1), ("c", 0, 1)]
    seeds = spark.createDataFrame([("r", "a/x"), (None, None)], "scope string, node string")
    assert _rows(V.ego_edges(edges, seeds), "src", "dst") == [("a/x", "b/y")]
    assert _rows(V.flow_neighbourhood(edges.filter("scope = 'r'"), seeds, G.degrees(edges).withColumn("in_degree", F.lit(0))), "node", "hops") == [("b/y", 1)]
    assert _rows(V.container_edges(edges), "a", "b", "verb", "strength") == [("a", "b", "imports", "single"), ("b", "c", "calls", "single")]
    known = spark.createDataFrame([("r", "b/y")], "scope string, node string")
    found = _rows(V.extraction_diagnostics(edges.unionByName(spark.createDataFrame([("r", "a", None, "calls", None, 1)], EDGE)), known), "scope", "edge_type", "edges", "unnamed", "external", "unmatched")
    assert found == [("q", "imports", 1, 0, 1, 0), ("r", "calls", 3, 1, 0, 2), ("r", "imports", 3, 0, 0, 0)]
    ties = spark.createDataFrame([("r", n, s) for n, s in (("a", 1.0), ("b", 1.0), ("c", None), ("d", float("nan")), ("e", 0.5))], "scope string, node string, rank double")
    assert _rows(V.central(ties, "rank"), "node", "place") == [("a", 1)]
    assert _rows(V.dominant(spark.createDataFrame([("r", "x"), ("r", "y"), ("r", None), ("s", None)], "g string, v string"), "g", "v"), "g", "v", "n") == [("r", "x", 1)]
    assert _rows(J.reach_to_sinks(edges, edges.filter("dst = 'c/z'").select("scope", F.col("dst").alias("node"))), "node", "hops") == [("a/x", 2), ("b/y", 1), ("top", 1)]
    methods = spark.createDataFrame([("r", "Base", "run", "f::Base.run"), ("r", "Sub", "run", "f::Sub.run"), ("r", "Sub", "other", "f::Sub.other")], "scope string, type string, name string, node string")
    assert _rows(G.override_dispatch(methods, spark.createDataFrame([("r", "Sub", "Base")], "scope string, type string, ancestor string")), "base", "impl") == [("f::Base.run", "f::Sub.run")]
    assert _rows(G.betweenness(spark.createDataFrame([("r", "a", "b"), ("r", "b", "c")], "scope string, src string, dst string")), "node", "betweenness") == [("a", 0.0), ("b", 0.5), ("c", 0.0)]


def test_empty_frames(spark):
    edges = spark.createDataFrame([], EDGE)
    nodes = spark.createDataFrame([], "scope string, node string")
    docs = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id bigint, text string, source string")
    for empty in (V.layer_order(edges), V.module_adjacency(edges), V.ego_edges(edges, nodes), V.neighbours(edges), V.hub_cutoffs(G.degrees(edges)), V.container_edges(edges), V.feature_envy(edges), V.core_periphery(G.degrees(edges)), S.reversals(docs), S.opening_frames(docs, "source"), S.vocabulary(docs, "source")):
        assert empty.count() == 0
    assert _rows(S.capped_lines(docs), "doc_id", "lines", "kept") == [(2, 1, 1)] and _rows(S.line_classes(docs), "class", "lines") == [("blank", 1)]


def test_summaries(spark):
    scores = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("c", 2.0), ("d", None), ("e", 5.0)], "path string, v double")
    assert _rows(S.rank_share(scores, "path", "v"), "path", "percentile") == [("a", 0.0), ("b", 0.0), ("c", 0.333333), ("d", 0.0), ("e", 0.666667)]
    assert _rows(S.strict_percentile(scores, "path", "v"), "path", "percentile") == [("a", 0), ("b", 25), ("c", 25), ("e", 75)]
    findings = spark.createDataFrame([("f", "x", "low"), ("f", "y", "critical"), ("g", "z", "high"), ("h", "w", None)], "path string, finding string, severity string")
    assert [r["finding"] for r in S.spread_over_files(findings, ["path", "finding"]).orderBy("place").collect()] == ["y", "z", "w", "x"]
    a, b = (spark.createDataFrame(x, "k int") for x in ([(1,), (2,), (None,)], [(2,), (3,)]))
    assert {(r["k"], r["source"]) for r in S.first_mention([("a", a), ("b", b)], "k").collect()} == {(1, "a"), (2, "a"), (None, "a"), (3, "b")}
    assert {r["k"] for r in S.retired(a, b, ["k"]).collect()} == {1, None}
    assert [r["total"] for r in S.paged(scores, [F.col("path")], 3, 5).collect()] == [5, 5]
