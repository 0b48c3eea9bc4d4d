"""Facts of functions, findings and clones, against hand counts and brute force."""

import re

from pyspark.sql import functions as F

from gantry.functions.facts import go_hits, python_facts, script_hits, sql_hits
from gantry.operators import code as C

FILES = "repository_id string, node_id string, text string, ingested_at timestamp"
SOURCE = '''
import re, json, time, requests

class Box:
    def __init__(self, a, b):
        self.a = a
        self.b = b
    def get(self):
        return self.a
    def other(self):
        return self.b
    def both(self):
        return self.get()
    def far(self):
        return self.b + 1
    def alone(self):
        return 1

def deep(x, y, z, u, v):
    if x and y or z:
        for i in x:
            while i:
                if u:
                    return [a for a in v if a]
    elif y:
        return 1
    try:
        pass
    except Exception:
        pass
    return 2 if v else 3

async def slow(rows, lock):
    out, text = [], ""
    seen = []
    for r in rows:
        time.sleep(1)
        p = re.compile(r)
        text += json.dumps(r)
        out.insert(0, r)
        if r in seen:
            await fetch(r)
        requests.get(r)
        for s in r:
            open(s)
    with lock:
        requests.post(rows)

def fetch_one(r):
    return requests.get(r)

def outer(rows):
    for r in rows:
        fetch_one(r)
'''


def test_python_facts():
    functions, classes, conditions, hits = python_facts(SOURCE)
    by = {f[0]: f for f in functions}
    # branches: if, and, or, for, while, if, comprehension with its if, elif, except, conditional
    assert by["deep"][3] == 1 + 2 + 1 + 2 + 2 + 1 + 1 + 1 + 1 and by["deep"][5] == 4 and by["deep"][7] == 5
    assert by["Box.__init__"][7] == 2 and by["slow"][8] and not by["deep"][8]
    # get, both and __init__ share a; other and far share b, and __init__ joins the two; alone stands apart
    assert classes == [("Box", 4, 17, 14, 6, 2)]
    assert conditions == [("deep", 20, 2)]
    kinds = {(f, k) for f, k, _ in hits if ":" not in k}
    assert kinds == {("deep", "error_handling"), ("slow", "blocking_sync_in_async"), ("slow", "regex_compile_in_loop"), ("slow", "json_parse_in_loop"), ("slow", "string_concat_in_loop"), ("slow", "list_insert_zero_in_loop"), ("slow", "membership_test_against_list_in_loop"), ("slow", "serial_await_in_loop"), ("slow", "io_in_loop"), ("slow", "nested_loop_quadratic"), ("slow", "nested_loop_with_io"), ("slow", "blocking_io_under_lock"), ("slow", "io"), ("fetch_one", "io")}
    assert python_facts("def f(:") == ([], [], [], []) and python_facts("") == ([], [], [], [])


def test_hits_of_other_languages():
    go = "package a\nfunc f(xs []int) {\n\tdefer g()\n\tfor _, x := range xs {\n\t\tdefer h(x) // go x\n\t\tgo func() { defer k() }()\n\t}\n}\n"
    assert go_hits(go) == [("defer_in_loop", 5), ("goroutine_in_unbounded_loop", 6)]
    assert script_hits("const a = xs.reduce((acc, x) => [...acc, x], []);\nys.reduce((a, b) => a + b, 0)") == [("array_spread_in_reduce", 1)]
    sql = "-- delete from t\nDELETE FROM t;\nUPDATE t SET a = 1 WHERE b = ';';\nCREATE VIEW v AS SELECT * FROM t;\nSELECT a FROM t, u;\nSELECT a FROM t, u WHERE t.x = u.x;\nCREATE FUNCTION f() RETURNS int AS BEGIN IF a AND b THEN RETURN 1; END"
    assert sql_hits(sql) == [("sql_update_delete_without_where", 2), ("sql_select_star", 4), ("sql_cartesian_join", 5), ("sql_routine:3", 7)]


def test_findings(spark):
    rows = [("r", "a.py", SOURCE, None), ("r", "n.py", None, None), ("r", "e.py", "", None), ("r", "bad.py", "def f(:", None), ("r", "q.sql", "DELETE FROM t", None)]
    facts = C.code_facts(spark.createDataFrame(rows, FILES).withColumn("functions", F.lit("clash")))
    found = {(r["symbol"], r["finding"]) for r in C.performance_findings(facts).collect()}
    assert {("outer", "cross_function_n_plus_1"), ("slow", "io_in_loop"), ("", "sql_update_delete_without_where")} <= found and ("deep", "error_handling") not in found
    nodes = spark.createDataFrame([("r", "a.py", None)], "repository_id string, node_id string, is_test boolean")
    calls = spark.createDataFrame([("r", "a.py::deep")] * 3, "repository_id string, callee string")
    structural = {(r["symbol"], r["finding"], r["severity"]) for r in C.structural_findings(facts, nodes, calls).collect()}
    assert structural == {("deep", "complex_method", "medium"), ("deep", "nested_complexity", "medium"), ("deep", "primitive_obsession", "low") , ("Box", "low_cohesion", "medium"), ("deep", "error_handling", "low")} - ({("deep", "primitive_obsession", "low")} if len([x for x in SOURCE.split("\n") if x.strip()]) < 60 else set())
    empty = C.code_facts(spark.createDataFrame([], FILES))
    assert C.performance_findings(empty).count() == 0 and C.structural_findings(empty, nodes, calls).count() == 0


def test_clones_equal_brute_force(spark):
    body = "\n".join(f"    value_{i} = compute(left_{i}, {i}) + other_{i}[{i}]" for i in range(12))
    renamed = body.replace("value", "result").replace("left", "right")
    texts = {"a.py": "def f():\n" + body + "\n", "b.py": "import os\n\n\ndef g(x):\n    # a note\n" + renamed + "\n    return 1\n", "c.py": "x = 1\n", "d.py": None, "e.py": "\n".join(f"if a_{i} > {i}: return {i}" if i % 3 else f"while b[{i}]: pass" for i in range(9))}
    frame = spark.createDataFrame([("r", k, v, None) for k, v in texts.items()], FILES)
    window = 30
    words = set(C._KEPT_WORDS.split())

    def tokens(text):
        out = []
        for n, line in enumerate((text or "").split("\n")):
            line = re.sub(r"^\s*(?:#|//|\*|/\*).*$", "", line)
            for t in re.findall(C._TOKEN, line):
                out.append((n, "0" if t[0] in "\"'0123456789" else "n" if re.match(r"[A-Za-z_$]", t) and t.lower() not in words else t.lower()))
        return out

    places = {}
    for k, v in texts.items():
        t = tokens(v)
        for i in range(len(t) - window + 1):
            places.setdefault(tuple(x for _, x in t[i : i + window]), []).append((k, i))
    lines = set()
    for where in places.values():
        if len(where) > 1:
            for k, i in where:
                lines |= {(k, n + 1) for n, _ in tokens(texts[k])[i : i + window]}
    got = set()
    for r in C.clone_spans(frame, window).collect():
        assert r["members"] > 1
        got |= {(r["node_id"], n) for n in range(r["start_line"], r["end_line"] + 1)}
    # lines without tokens within a stretch, as a comment, belong to it
    assert {k for k, _ in got} == {"a.py", "b.py", "e.py"} and {x for x in got if tokens((texts[x[0]]).split("\n")[x[1] - 1])} == lines
    dup = {r["node_id"]: r for r in C.duplication(C.clone_spans(frame, window), frame).collect()}
    assert dup["a.py"]["dup_pct"] > 80 and dup["c.py"]["dup_pct"] == 0 and dup["d.py"]["nloc"] == 0 and len(dup) == 5
    assert C.clone_spans(frame.limit(0)).count() == 0
