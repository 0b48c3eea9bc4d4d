"""Readers of reports and manifests, and sinks, on small texts."""

import json

from pyspark.sql import functions as F

from gantry.sources import formats as R
from gantry.sources import sinks as K


def _texts(spark, *rows, key="report"):
    return spark.createDataFrame(list(rows), f"{key} string, text string")


def test_coverage_reports(spark):
    cob = '<coverage line-rate="0.5"><class name="A" filename="src/a.py"><methods><method><lines><line number="1" hits="2"/></lines></method></methods><lines><line number="1" hits="2"/><line hits="0" number="3"/></lines></class><class filename="b.py"><line number="x" hits="1"/></class></coverage>'
    clo = '<coverage generated="1"><file name="a.ts" path="src/a.ts"><line num="4" type="stmt" count="3"/><line num="5" type="method" count="9"/></file></coverage>'
    js = json.dumps({"files": {"c.py": {"executed_lines": [1, 2], "missing_lines": [2, 5]}}})
    key = lambda rows: sorted((r["file"], r["line"], r["hits"]) for r in rows)
    assert key(R.cobertura(_texts(spark, ("r", cob), ("n", None), ("e", ""))).collect()) == [("src/a.py", 1, 2), ("src/a.py", 3, 0)]
    assert key(R.clover(_texts(spark, ("r", clo), ("n", None))).collect()) == [("src/a.ts", 4, 3)]
    assert key(R.coverage_json(_texts(spark, ("r", js), ("bad", "{"), ("n", None))).collect()) == [("c.py", 1, 1), ("c.py", 2, 1), ("c.py", 5, 0)]
    kinds = _texts(spark, ("1", cob), ("2", clo), ("3", js), ("4", "TN:\nSF:a"), ("5", "hello"), ("6", None)).select("report", R.coverage_kind("text").alias("k"))
    assert {r["report"]: r["k"] for r in kinds.collect()} == {"1": "cobertura", "2": "clover", "3": "json", "4": "lcov", "5": None, "6": None}


def test_resolve_paths(spark):
    known = spark.createDataFrame([("src/a/x.py",), ("lib/x.py",), ("src/b/y.py",), ("x/src/b/y.py",), (None,)], "node string")
    asked = spark.createDataFrame([("/ci/src/a/x.py",), ("x.py",), ("y.py",), ("/w/x/src/b/y.py",), ("z.py",), ("lib\\x.py",), (None,)], "file string")
    got = {r["file"]: (r["node"], r["outcome"]) for r in R.resolve_paths(asked, known).collect()}
    assert got == {"/ci/src/a/x.py": ("src/a/x.py", "matched"), "x.py": (None, "ambiguous"), "y.py": (None, "ambiguous"), "/w/x/src/b/y.py": ("x/src/b/y.py", "matched"), "z.py": (None, "unmatched"), "lib\\x.py": ("lib/x.py", "matched")}


def test_blame(spark):
    def line(sha, n, who, at):
        return f"{sha * 40} {n} {n} 1\nauthor {who}\nauthor-mail <x@y>\nauthor-time {at}\nsummary s\nfilename f\n\tauthor fake\n"

    day = 86400
    text = line("a", 1, "Ann", 0) + line("b", 2, "Bob", 799 * day) + line("a", 3, "Ann", 0) + line("c", 4, "Bob", 790 * day) + line("a", 5, "Ann", 0)
    lines = R.blame(_texts(spark, ("f", text), ("n", None), key="file"))
    assert lines.count() == 5
    assert [(r["owner"], r["lines"], r["share"]) for r in R.blame_ownership(lines).collect()] == [("Ann", 3, 0.6)]
    functions = spark.createDataFrame([("f", "g", 1, 5), ("f", "h", 2, 2)], "file string, name string, start int, end int")
    ages = R.function_ages(lines, functions, F.timestamp_seconds(F.lit(800 * day)))
    assert {r["name"]: (r["median_age"], r["recent"]) for r in ages.collect()} == {"g": (800.0, 2), "h": (1.0, 1)}
    assert [(r["name"], r["severity"]) for r in R.age_volatility(ages).collect()] == [("g", "high")]


def test_manifests_and_pages(spark):
    files = _texts(
        spark, ("a/package.json", json.dumps({"dependencies": {"x": "^1"}, "devDependencies": {"y": "2"}})), ("package.json", "{"), ("requirements.txt", "# c\nreq-one==1.2  # why\nflask\n-r other\n"),
        ("go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n"), ("Cargo.toml", '[dependencies]\nserde = "1.0"\ntokio = { version = "1", features = ["x"] }\n'), ("pom.xml", "<dependency><groupId>g</groupId><artifactId>art</artifactId><version>3</version></dependency>"),
        ("packages.config", '<package id="N" version="4" />'), ("MODULE.bazel", 'bazel_dep(name = "r", version = "5")'), ("other.txt", "x"), ("requirements.txt", None), key="path",
    )
    got = {(r["ecosystem"], r["name"], r["version"], r["is_dev"]) for r in R.manifests(files).collect()}
    assert got == {("npm", "x", "^1", False), ("npm", "y", "2", True), ("pypi", "req-one", "==1.2", False), ("pypi", "flask", None, False), ("go", "github.com/a/b", "v1.2.3", False), ("cargo", "serde", "1.0", False), ("cargo", "tokio", "1", False), ("maven", "art", "3", False), ("nuget", "N", "4", False), ("bazel", "r", "5", False)}
    page = '<script src="js/a.js?v=1"></script><SCRIPT async src=\'https://cdn.x/y.js\'></SCRIPT><link rel="stylesheet" href="s.css"><link href="data:x">'
    assert {(r["tag"], r["target"]) for r in R.html_links(_texts(spark, ("i.html", page), ("n", None), key="path")).collect()} == {("script", "js/a.js"), ("link", "s.css")}


def test_contracts(spark):
    files = _texts(spark, ("a.py", "@app.get('/users/{id}')\ndef f(): ...\n"), ("b.js", "axios.get(`https://h/users/${id}`); axios.post('/lost/')"), ("c.js", "router.get('/users/:id', x)"), key="path")
    found = R.endpoints(files).withColumnRenamed("path", "scope")
    got = {(r["consumer"], r["provider"], r["method"], r["route"], r["match"]) for r in R.contract_links(found).collect()}
    assert got == {("b.js", "a.py", "GET", "/users/{}", "exact"), ("b.js", "c.js", "GET", "/users/{}", "exact"), ("b.js", None, "POST", "/lost", "none")}


def test_sinks(spark, tmp_path):
    schema = "scope string, k int, v string"
    K.replace_scope(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], schema), str(tmp_path / "t"), "scope")
    K.replace_scope(spark.createDataFrame([("a", 3, "z")], schema), str(tmp_path / "t"), "scope")
    assert {(r["scope"], r["k"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 3), ("b", 2)}
    first = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), (None, 1, "n")], schema)
    assert K.add_once(first, str(tmp_path / "o"), ["scope", "k"]).count() == 2
    assert K.add_once(first, str(tmp_path / "o"), ["scope", "k"]).count() == 0 and spark.read.parquet(str(tmp_path / "o")).count() == 2
    K.swap({"n": first}, str(tmp_path / "s"))
    K.swap({"n": first.limit(1)}, str(tmp_path / "s"))
    assert K.current(spark, str(tmp_path / "s"), "n").count() == 1
    assert [r["drift"] for r in K.drift(spark.createDataFrame([("p", 0, 3), ("q", 10, 9)], "population string, a int, b int")).orderBy("population").collect()] == [3.0, 0.1]
    nodes, edges = spark.createDataFrame([("x",)], "id string"), spark.createDataFrame([("x", "y")], "source string, target string")
    assert {json.loads(r["value"])["kind"] for r in K.node_link(nodes, edges).collect()} == {"node", "edge"}
    assert [r["value"] for r in K.mermaid(spark.createDataFrame([("a/b", "c")], "a string, b string")).collect()] == ["graph LR", "  a_b --> c"]
    vectors = "id string, vector array<float>"
    K.upsert_vectors(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], vectors), str(tmp_path / "v"), buckets=4)
    K.upsert_vectors(spark.createDataFrame([("b", [3.0]), ("c", [4.0])], vectors), str(tmp_path / "v"), buckets=4)
    assert {r["id"]: r["vector"][0] for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {"a": 1.0, "b": 3.0, "c": 4.0}
