from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gantry.operators import graph as G
from gantry.operators import health as K
from gantry.operators import history as H
from gantry.operators import intervals as I
from gantry.operators import text as T
from gantry.plans import graph as P
from gantry.plans import history as HP
from gantry.plans import logs as L
from gantry.sources import readers as R
from gantry.streaming import twins as S

DAY = timedelta(days=1)
START = datetime(2024, 6, 1)


def test_ownership_ties_and_bus_factor(spark):
    rows = [(i, "p", START - i * DAY) for i in range(10)] + [(20, "q", START)]
    authors = [(i, "a" if i < 5 else "b") for i in range(10)] + [(20, "c")]
    got = {r["path"]: r for r in H.ownership(spark.createDataFrame(rows, "sha int, path string, ts timestamp"), spark.createDataFrame(authors, "sha int, author string")).collect()}
    assert (got["p"]["owner"], got["p"]["owner_share"], got["p"]["bus_factor"], got["p"]["contributors"]) == ("a", 0.5, 2, 2)
    assert (got["q"]["owner"], got["q"]["bus_factor"]) == ("c", 1)


def test_risk_ignores_unknown_experience(spark):
    f = spark.createDataFrame([(1, 10.0, 2.0, 3, 2, 1, 0.5, 4), (2, 10.0, 2.0, 3, 2, 1, 0.5, None)], "sha int, la double, ld double, nf int, nd int, ns int, entropy double, exp int")
    a, b = [r["risk"] for r in H.change_risk(f).orderBy("sha").collect()]
    assert a != b and 0 < b < 10


def test_co_change_leaves_out_single_and_huge_commits(spark):
    rows = [(s, p) for s in range(4) for p in "ab"] + [(9, "a")] + [(10, f"f{i}") for i in range(201)] + [(0, "a")]
    commits = spark.createDataFrame([(s, START) for s in (0, 1, 2, 3, 9, 10)], "sha int, ts timestamp")
    pairs = H.co_change(spark.createDataFrame(rows, "sha int, path string"), commits).collect()
    assert [(r["path"], r["partner"], r["joint"]) for r in pairs] == [("a", "b", 4)]


def test_identities_fold_only_onto_a_single_address(spark):
    people = [("x", "1+x@users.noreply.h"), ("x", "x@m"), ("y", "2+y@users.noreply.h"), ("y", "y@m"), ("y", "y@n"), ("z", None)]
    got = {(r["name"], r["email"]): r["canonical"] for r in H.fold_identities(spark.createDataFrame(people, "name string, email string")).collect()}
    assert got["x", "1+x@users.noreply.h"] == "x@m" and got["y", "2+y@users.noreply.h"] == "2+y@users.noreply.h" and got["z", None] is None


def test_all_people_are_folded(spark, tmp_path):
    spark.range(1, 801).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    want = {(f"dev{k % 400}", f"{k}+dev{k % 400}@users.noreply.example" if k % 3 == 0 else f"dev{k % 400}.{k % 5}@mail.example") for k in range(1, 801)}
    assert {(r["name"], r["email"]) for r in HP.identity_fold(spark, str(tmp_path)).collect()} == want


def test_imports_of_all_languages(spark, tmp_path):
    module = "import a from 'x'\nimport {\n  b,\n  c,\n} from \"./y\";\nimport './z.css'\nexport * from 'w'\nconst q = require('v')\nconst s = 'import'\n"
    texts = {f"m.{e}": (module, {"x", "./y", "./z.css", "w", "v"}) for e in ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")}
    texts["m.go"] = ('package m\n\nimport "fmt"\nimport (\n\t_ "embed"\n\tx "a.b/c-d/x" // why\n\t"os"\n)\n\nfunc f() string {\n\treturn "no"\n}\n', {"fmt", "embed", "a.b/c-d/x", "os"})
    texts["m.py"] = ("import a.b\nfrom c import d\n", {"a.b", "c"})
    texts["M.java"] = ("import static a.B.c;\nimport d.E;\n", {"a.B.c", "d.E"})
    spark.createDataFrame([("r", n, t) for n, (t, _) in texts.items()], "repository_id string, node_id string, text string").write.parquet(str(tmp_path / "source_text.parquet"))
    got = sorted((r["node_id"], r["module"]) for r in L.import_scan(spark, str(tmp_path)).collect())
    assert got == sorted((n, m) for n, (_, ms) in texts.items() for m in ms)


def test_health_caps_and_floor(spark):
    findings = [("a", "churn_risk", "critical"), ("a", "prior_defect", "critical"), ("a", "ownership_risk", "critical"), ("b", "error_handling", "low")] + [("c", f, "critical") for f in K.CATEGORIES]
    got = {r["path"]: r["score"] for r in K.health_scores(spark.createDataFrame(findings, "path string, finding string, severity string"), spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")).collect()}
    assert got == {"a": 6.5, "b": 9.85, "c": 1.0, "d": 10.0}
    bands = spark.createDataFrame([(3.9,), (4.0,), (8.0,)], "s double").select(K.band(F.col("s")).alias("b")).collect()
    assert [r["b"] for r in bands] == ["alert", "warning", "healthy"]


def test_trends(spark):
    scores = [9.0, 8.9, 8.8, 8.7, 8.7, 8.4]
    got = K.trends(spark.createDataFrame([("p", i, s) for i, s in enumerate(scores)], "path string, taken_at int, score double")).orderBy("taken_at").collect()
    assert [r["predicted"] for r in got] == [False, False, False, True, False, False] and [r["declining"] for r in got] == [False] * 5 + [True]


EDGES = [("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "c", "d"), ("s", "d", "e"), ("s", "e", "d"), ("s", "f", "f"), ("t", "a", "b")]


def test_graph_operators(spark):
    e = spark.createDataFrame(EDGES, "scope string, src string, dst string")
    assert {(r["node"], r["component"]) for r in G.strongly_connected(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    assert {r["cycle"] for r in G.short_cycles(e).collect()} == {"a > b > c", "d > e"}
    seeds = spark.createDataFrame([("s", "a", "a")], "scope string, seed string, node string")
    assert {(r["node"], r["hops"]) for r in G.reach(seeds, e, 5).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)}
    assert {r["node"] for r in G.reach(seeds, e, 1, backward=True).collect()} == {"a", "c"}
    ranks = G.pagerank(e, 5).groupBy("scope").agg(F.sum("rank").alias("r")).collect()
    assert all(r["r"] == pytest.approx(1) for r in ranks)
    empty = e.limit(0)
    assert G.strongly_connected(empty).count() == G.short_cycles(empty).count() == G.reach(seeds.limit(0), empty, 2).count() == 0


def test_graphs_of_any_diameter(spark):
    ring = "abcdefg"
    e = spark.createDataFrame([("s", a, ring[(i + 1) % 7]) for i, a in enumerate(ring)] + [("s", "d", "a"), ("s", "g", "h")], "scope string, src string, dst string")
    seeds = spark.createDataFrame([("s", "a", "a")], "scope string, seed string, node string")
    assert {r["node"]: r["hops"] for r in G.reach(seeds, e, None).collect()} == {n: i for i, n in enumerate("abcdefgh")}
    assert G.propagation_cost(e, None).first()["cost"] == pytest.approx(7 * 7 / 56)
    assert {(r["cycle"], r["length"]) for r in G.shortest_cycles(e).collect()} == {("a > b > c > d", 4), ("a > b > c > d > e > f > g", 7)}
    assert [r["length"] for r in G.shortest_cycles(e, 1).collect()] == [4]
    assert G.shortest_cycles(e.limit(0)).count() == 0


def test_rounds_of_the_survey(spark, tmp_path):
    chain = [(f"c{i}", "r", f"n{i:02}", f"n{i + 1:02}", kind, 1.0, None) for i in range(12) for kind in ("imports", "calls")]
    star = [(f"s{i}", "r", f"leaf{i}", "hub", "imports", 1.0, None) for i in range(3)]
    schema = "id string, repository_id string, source_node_id string, target_node_id string, edge_type string, confidence double, resolution_origin string"
    spark.createDataFrame(chain + star, schema).write.parquet(str(tmp_path / "graph_edges.parquet"))
    assert [r["length"] for r in P.execution_flows_8(spark, str(tmp_path)).collect()] == [9]
    edges = [(a[2], a[3]) for a in chain if a[4] == "imports"] + [(a[2], a[3]) for a in star]
    nodes = sorted({n for e in edges for n in e})
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        lost = sum(rank[n] for n in nodes if not out[n]) / len(nodes)
        rank = {n: 0.15 / len(nodes) + 0.85 * (lost + sum(rank[a] / len(out[a]) for a in nodes if n in out[a])) for n in nodes}
    assert {r["node"]: r["rank"] for r in P.pagerank_20(spark, str(tmp_path)).collect()} == pytest.approx(rank, abs=1e-8)
    label = {r["node"]: r["community"] for r in P.settled_communities(spark, str(tmp_path)).collect()}
    near = {n: [b if a == n else a for a, b in edges if n in (a, b)] for n in nodes}
    for n in nodes:
        votes = [label[m] for m in near[n]]
        assert votes.count(label[n]) == max(map(votes.count, votes)), n


def test_betweenness_equals_brute_force(spark):
    import itertools
    from collections import deque

    edges = [("s", a, b) for a, b in ["ab", "bc", "cd", "ad", "be", "ed", "df", "fa"]] + [("t", "x", "y")]
    nodes, out = sorted("abcdef"), {}

    def paths(a, b):
        best, found, queue = None, [], deque([[a]])
        while queue:
            p = queue.popleft()
            if best and len(p) > best:
                break
            if p[-1] == b:
                best = len(p)
                found.append(p)
            queue.extend(p + [d] for s, c, d in edges if s == "s" and c == p[-1] and d not in p)
        return found

    for v in nodes:
        total = 0.0
        for a, b in itertools.permutations(nodes, 2):
            if v not in (a, b) and (ps := paths(a, b)):
                total += sum(v in p for p in ps) / len(ps)
        out[v] = total / 20
    got = {r["node"]: r["betweenness"] for r in G.betweenness(spark.createDataFrame(edges, "scope string, src string, dst string")).filter("scope = 's'").collect()}
    assert got == pytest.approx(out, abs=1e-8)


def _random_graph(n, m, seed):
    import random

    rng = random.Random(seed)
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(i, i + 1) for i in range(n, n + 30)}
    return sorted(edges | {(7, 7), (n, 0)})


def test_searches_by_parts_equal_plain_ones():
    import numpy as np

    from gantry.operators import packed

    for n, m, seed in ((40, 60, 1), (90, 100, 2), (150, 700, 3)):
        edges = [(a, b) for a, b in _random_graph(n, m, seed) if a != b]
        size = n + 31
        src, dst = (np.array(x, np.int32) for x in zip(*edges))
        out = {v: [b for a, b in edges if a == v] for v in range(size)}
        pairs, total = 0, [0.0] * size
        for s in range(size):
            far, paths, order = {s: 0}, {s: 1}, [s]
            for v in order:
                for w in out[v]:
                    if w not in far:
                        far[w], paths[w] = far[v] + 1, 0
                        order.append(w)
                    if far[w] == far[v] + 1:
                        paths[w] += paths[v]
            pairs += len(order)
            delta = dict.fromkeys(order, 0.0)
            for v in reversed(order):
                delta[v] = sum(paths[v] / paths[w] * (1 + delta[w]) for w in out[v] if far[w] == far[v] + 1)
                total[v] += delta[v] if v != s else 0
        for parts in (1, 3):
            assert sum(int(packed.reached(src, dst, size, p, parts)["pairs"][0]) for p in range(parts)) == pairs
            got = np.zeros(size)
            for p in range(parts):
                x = packed.dependencies(src, dst, size, p, parts)
                got[x["at"]] += x["delta"]
            assert got.tolist() == pytest.approx(total)


def test_long_chains_need_no_round_a_hop(spark):
    e = spark.createDataFrame([("s", f"n{i:04}", f"n{i + 1:04}") for i in range(2000)] + [("t", "a", "b"), ("t", "b", "a"), ("u", "x", "x")], "scope string, src string, dst string")
    assert {r["scope"]: (r["n"], r["cost"]) for r in G.propagation_cost(e, None).collect()} == {"s": (2001, 0.5), "t": (2, 1.0), "u": (1, 0.0)}
    got = {r["node"]: r["betweenness"] for r in G.betweenness(e).filter("scope = 's'").collect()}
    assert got["n0000"] == 0 and got["n1000"] == pytest.approx(1000 * 1000 / (2000 * 1999), abs=1e-8)


def test_decision_currency_counts_without_pairs(spark):
    import random

    rng = random.Random(3)
    commits = [(i, datetime(2024, 1, 1 + rng.randrange(20)), rng.random() < 0.3) for i in range(60)] + [(3, datetime(2024, 2, 1), True), (4, None, True), (90, None, False), (None, datetime(2024, 3, 1), True), (91, datetime(2024, 3, 1), None)]
    changes = [(rng.randrange(95), rng.randrange(9)) for _ in range(300)] + [(3, None), (None, 2), (91, 1)]
    want = {}
    for d, since, fix in commits:
        for sha, ts, _ in commits:
            paths = {p for s, p in changes if s == d and p is not None} & {p for s, p in changes if s == sha}
            if fix and None not in (d, sha, since, ts) and ts > since and paths:
                want.setdefault(d, set()).add(sha)
    frames = lambda x, y: (spark.createDataFrame(x, "sha bigint, path bigint"), spark.createDataFrame(y, "sha bigint, ts timestamp, is_fix boolean"))
    assert {r["decision"]: r["later_commits"] for r in G.decision_currency(*frames(changes, commits)).collect()} == {d: len(x) for d, x in want.items()}
    # every commit touches one path and is a decision: two hundred million pairs if they were listed
    n = 20_000
    many = G.decision_currency(*frames([(i, 1) for i in range(n)], [(i, datetime.fromtimestamp(1_700_000_000 + i), True) for i in range(n)]))
    assert many.selectExpr("count(*)", "sum(later_commits)").first()[:] == (n - 1, n * (n - 1) // 2)


def test_intervals(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 500), ("f", "inner", 60, 70), ("f", "twin", 60, 70), ("f", "bad", 9, 3)], "file string, span_id string, lo int, hi int")
    ranges = spark.createDataFrame([("f", "r1", 62, 66), ("f", "r2", 63, 140), ("g", "r3", 1, 2), ("f", "r4", None, 2)], "file string, range_id string, rlo int, rhi int")
    met = I.overlaps(spans, ranges, ["file"])
    assert sorted((r["range_id"], r["span_id"]) for r in met.collect()) == [(r, s) for r in ("r1", "r2") for s in ("inner", "outer", "twin")]
    assert {(r["range_id"], r["span_id"]) for r in I.innermost(met).collect()} == {(r, s) for r in ("r1", "r2") for s in ("inner", "twin")}
    lines = I.union_length(spark.createDataFrame([("a", 1, 5), ("a", 3, 8), ("a", 8, 8), ("a", 20, 21), ("a", 4, 2)], "k string, lo int, hi int"), "k").collect()
    assert [(r["k"], r["lines"]) for r in lines] == [("a", 10)]


def test_jaccard_classes_equal_brute_force(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3
    docs = [(1, base), (2, base), (3, base + "extra"), (4, "quite another text with other words in it"), (5, None), (6, ""), (7, "short"), (8, "short"), (9, "extra start " + base + "extra")]
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in T.jaccard_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}

    def grams(t):
        w = t.split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    texts = {i: grams(t) for i, t in docs if t}
    similar = lambda a, b: len(a & b) / len(a | b) >= 0.8
    label = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if similar(texts[a], texts[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {i: c for i, (c, _) in got.items()} == label
    assert got[7] == (7, 1) and got[4] == (4, 0)


def test_jaccard_classes_of_long_and_edited_texts(spark):
    import random

    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 90))]
        for edits in range(5):
            texts.append(" ".join(f"x{rng.randrange(9)}" if k in {rng.randrange(len(base)) for _ in range(edits // 2)} else w for k, w in enumerate(base + base[: edits % 3])))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in map(str.split, texts)]
    similar = [[j for j, b in enumerate(sets) if a == b or len(a & b) / len(a | b) >= 0.8] for a in sets]
    label = list(range(len(sets)))
    for _ in sets:
        label = [min(label[j] for j in near) for near in similar]
    # long texts: split once, not once for each shingle
    long = " ".join(f"n{i}" for i in range(40_000))
    docs = [*enumerate(texts), (1000, long), (1001, long + " end")]
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in T.jaccard_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert (got.pop(1000), got.pop(1001)) == ((1000, 1), (1000, 1))
    assert {i: c for i, (c, _) in got.items()} == dict(enumerate(label))


def test_readers(spark, tmp_path):
    text = ["SF:a.py", "DA:1,2", "DA:3,0", "end_of_record", "SF:b.py", "DA:1,1", "junk"]
    lines = spark.createDataFrame([("r", i, v) for i, v in enumerate(text)], "report string, pos int, value string")
    assert {(r["file"], r["line"], r["hits"]) for r in R.lcov(lines).collect()} == {("a.py", 1, 2), ("a.py", 3, 0), ("b.py", 1, 1)}
    diff = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,2 +1,3 @@", " a", "+b", "-c", "+d"]
    rows = spark.createDataFrame([("d", i, v) for i, v in enumerate(diff)], "diff string, pos int, value string")
    assert {(r["file"], r["line"]) for r in R.unified_diff(rows).collect()} == {("x", 2), ("x", 3)}
    log = tmp_path / "log.txt"
    log.write_text("\x00abc\x01Ann\x01a@x\x01100\x01fix: it\n\n3\t1\tsrc/{old => new}/f.py\n-\t-\tb.png\n\x00def\x01Bob\x01b@x\x01200\x01Merge\n")
    commits, changes = R.commit_log(spark, str(log))
    assert {(r["sha"], r["author_name"]) for r in commits.collect()} == {("abc", "Ann"), ("def", "Bob")}
    assert {(r["path"], r["added"], r["deleted"]) for r in changes.collect()} == {("src/new/f.py", 3, 1), ("b.png", 0, 0)}


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i % 20, i % 60), i % 3, ["error", "purchase", "view"][i % 5 % 3], float(i), "{}") for i in range(200)]
    batch = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    batch.coalesce(1).write.parquet(str(tmp_path / "x"))
    import glob
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(glob.glob(str(tmp_path / "x/*.parquet"))[0], tmp_path / "in/events.parquet")
    stream = S.read_events(spark, str(tmp_path / "in"))
    same = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    got = S.drain(S.tumbling(stream, "2 hours"), "t_tumbling", "complete").collect()
    assert sorted(map(str, got)) == sorted(map(str, S.tumbling(same, "2 hours").collect()))
    assert S.drain(S.deduplicated(S.read_events(spark, str(tmp_path / "in"))), "t_dedup", "append").count() == 200
