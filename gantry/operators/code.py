"""Functions, classes and findings of source files, and code that occurs more than once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gantry.functions.facts import go_hits, python_facts, script_hits, sql_hits
from gantry.operators.health import class_detectors, find, function_detectors
from gantry.operators.skew import lookup
from gantry.session import Scratch

_KEY = ["repository_id", "node_id"]
_FUNCTION = {"name": pa.string(), "start": pa.int32(), "end": pa.int32(), "ccn": pa.int32(), "nloc": pa.int32(), "nesting": pa.int32(), "bumps": pa.int32(), "params": pa.int32(), "is_async": pa.bool_(), "assertions": pa.int32()}
_CLASS = {"name": pa.string(), "start": pa.int32(), "end": pa.int32(), "nloc": pa.int32(), "methods": pa.int32(), "lcom4": pa.int32()}
_CONDITION = {"function": pa.string(), "line": pa.int32(), "operators": pa.int32()}
_HIT = {"function": pa.string(), "kind": pa.string(), "line": pa.int32()}
_SQL = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}


def _struct(shape: dict) -> str:
    return "array<struct<" + ", ".join(f"{k}: {_SQL[t]}" for k, t in shape.items()) + ">>"


def latest(files: DataFrame) -> DataFrame:
    """One row per (repository_id, node_id), the latest by ingested_at; null texts stay."""
    return files.groupBy(*_KEY).agg(F.max_by("text", F.struct("ingested_at", F.xxhash64("text"))).alias("text"))


def code_facts(files: DataFrame) -> DataFrame:
    """repository_id, node_id, nloc, functions, classes, conditions, hits of files(repository_id, node_id, ingested_at, text).

    Python gives all of them, Go, scripts and SQL only hits; files that don't parse, null and empty
    texts give empty lists. One pass over each text, in Arrow batches.
    """
    shapes = [_FUNCTION, _CLASS, _CONDITION, _HIT]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, text in zip(batch["node_id"].to_pylist(), batch["text"].to_pylist()):
                end = (path or "").rpartition(".")[2].lower()
                text = text or ""
                if end in ("py", "pyi"):
                    found.append(python_facts(text.lstrip("﻿")))
                else:
                    hits = go_hits(text) if end == "go" else script_hits(text) if end in ("js", "ts", "mjs", "cjs", "mts", "cts", "jsx", "tsx") else sql_hits(text) if end == "sql" else []
                    found.append(([], [], [], [("", k, n) for k, n in hits]))
            columns = []
            for i, shape in enumerate(shapes):
                ends, rows = [0], []
                for f in found:
                    rows += f[i]
                    ends.append(len(rows))
                fields = list(zip(*rows)) or [[]] * len(shape)
                structs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(fields, shape.values())], list(shape))
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs))
            names = [*_KEY, "nloc"]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], *columns], [*names, "functions", "classes", "conditions", "hits"])

    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    nloc = F.size(F.filter(lines, lambda x: F.trim(x) != "")).alias("nloc")
    schema = "repository_id string, node_id string, nloc int, " + ", ".join(f"{n} {_struct(s)}" for n, s in zip(("functions", "classes", "conditions", "hits"), shapes))
    return latest(files).select(*_KEY, nloc, "text").mapInArrow(read, schema)


def structural_findings(facts: DataFrame, nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """repository_id, node_id, symbol, line, finding, severity of functions, classes and conditions.

    nodes(repository_id, node_id, is_test): files; calls(repository_id, callee): a row per call, the
    callee as path::name. A function's dependents are the calls of it; the repository's 80th
    percentile of them is the floor of brain_method. Null is_test counts as no test.
    """
    tests = nodes.groupBy(*_KEY).agg(F.bool_or("is_test").alias("is_test"))
    called = calls.groupBy("repository_id", F.col("callee").alias("symbol_id")).agg(F.count(F.lit(1)).alias("dependents"))
    p80 = called.groupBy("repository_id").agg(F.percentile_approx("dependents", 0.8, 10000).alias("dependents_p80"))
    functions = facts.select(*_KEY, F.col("nloc").alias("file_nloc"), F.explode("functions").alias("f")).select(*_KEY, "file_nloc", "f.*")
    functions = functions.withColumn("symbol_id", F.concat("node_id", F.lit("::"), F.substring_index("name", ".", -1)))
    wide = lookup(functions, called, ["repository_id", "symbol_id"]).join(F.broadcast(p80), "repository_id", "left").join(tests, _KEY, "left").fillna(0, ["dependents"])
    wide = wide.withColumn("constructor", F.col("name").endswith("__init__")).withColumn("operators", F.lit(None).cast("int"))
    of_functions = find(wide.withColumnRenamed("name", "symbol").withColumnRenamed("start", "line"), function_detectors(), [*_KEY, "symbol", "line"])
    conditions = facts.select(*_KEY, F.explode("conditions").alias("c")).select(*_KEY, F.col("c.function").alias("symbol"), "c.line", "c.operators")
    of_conditions = find(conditions, {"complex_conditional": _only(function_detectors(), "complex_conditional")}, [*_KEY, "symbol", "line"])
    brains = functions.filter((F.col("nloc") >= 70) & (F.col("ccn") >= 9)).groupBy(*_KEY, F.expr("left(name, greatest(length(name) - length(substring_index(name, '.', -1)) - 1, 0))").alias("symbol")).agg(F.count(F.lit(1)).alias("brain_methods"))
    classes = facts.select(*_KEY, F.explode("classes").alias("c")).select(*_KEY, F.col("c.name").alias("symbol"), F.col("c.start").alias("line"), F.col("c.nloc").alias("total_nloc"), "c.methods", "c.lcom4")
    of_classes = find(classes.join(brains, [*_KEY, "symbol"], "left"), class_detectors(), [*_KEY, "symbol", "line"])
    hits = facts.select(*_KEY, F.explode("hits").alias("h")).filter("h.kind = 'error_handling'").select(*_KEY, F.col("h.function").alias("symbol"), "h.line", F.lit("error_handling").alias("finding"), F.lit("low").alias("severity"))
    return of_functions.filter("finding <> 'complex_conditional'").unionByName(of_conditions).unionByName(of_classes).unionByName(hits)


def _only(rules: dict, name: str) -> tuple[Column, Column]:
    return rules[name]


def performance_findings(facts: DataFrame) -> DataFrame:
    """repository_id, node_id, symbol, line, finding, severity: patterns that cost time, within a function and across functions.

    Direct hits come as they are. cross_function_n_plus_1: a call in a loop of a function of the same
    repository that does I/O itself, if the name is that of one function only. hot_path_sync_io: I/O
    in a function that others call so often that no more than a fifth of the called are called more.
    SQL routines are findings of their own, high from complexity 20 on.
    """
    hits = facts.select(*_KEY, F.explode("hits").alias("h")).select(*_KEY, F.col("h.function").alias("symbol"), "h.kind", "h.line").distinct()
    direct = hits.filter(~F.col("kind").rlike(r"^(io|error_handling|call:.*|call_in_loop:.*|sql_routine:.*)$")).select(*_KEY, "symbol", "line", F.col("kind").alias("finding"), F.lit("medium").alias("severity"))
    routines = hits.filter(F.col("kind").startswith("sql_routine:")).withColumn("ccn", F.substring_index("kind", ":", -1).cast("int"))
    routines = routines.select(*_KEY, "symbol", "line", F.lit("sql_high_complexity").alias("finding"), F.when(F.col("ccn") >= 20, "high").otherwise("medium").alias("severity"))
    functions = facts.select(*_KEY, F.explode("functions.name").alias("symbol")).withColumn("name", F.substring_index("symbol", ".", -1))
    single = functions.groupBy("repository_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node_id", "symbol")).alias("at")).filter("n = 1").select("repository_id", "name", F.col("at.node_id").alias("t_node"), F.col("at.symbol").alias("t_symbol"))
    sinks = hits.filter("kind = 'io'").select("repository_id", F.col("node_id").alias("t_node"), F.col("symbol").alias("t_symbol"), "line").groupBy("repository_id", "t_node", "t_symbol").agg(F.min("line").alias("io_line"))
    targets = single.join(sinks, ["repository_id", "t_node", "t_symbol"])
    looped = hits.filter(F.col("kind").startswith("call_in_loop:")).withColumn("name", F.substring_index("kind", ":", -1))
    crossing = lookup(looped, targets, ["repository_id", "name"], "inner").filter("symbol <> t_symbol or node_id <> t_node").select(*_KEY, "symbol", "line", F.lit("cross_function_n_plus_1").alias("finding"), F.lit("high").alias("severity"))
    calls = hits.filter(F.col("kind").startswith("call:")).select("repository_id", F.substring_index("kind", ":", -1).alias("name"))
    counted = calls.groupBy("repository_id", "name").agg(F.count(F.lit(1)).alias("callers")).join(single, ["repository_id", "name"])
    floor = counted.groupBy("repository_id").agg(F.greatest(F.percentile_approx("callers", 0.8, 10000), F.lit(2)).alias("floor"))
    hot = counted.join(F.broadcast(floor), "repository_id").filter("callers >= floor").join(sinks, ["repository_id", "t_node", "t_symbol"])
    heated = hot.select("repository_id", F.col("t_node").alias("node_id"), F.col("t_symbol").alias("symbol"), F.col("io_line").alias("line"), F.lit("hot_path_sync_io").alias("finding"), F.lit("medium").alias("severity"))
    return direct.unionByName(routines).unionByName(crossing).unionByName(heated)


# -- clones --------------------------------------------------------------------------------------
#: Tokens of a clone's window, and lines a clone must span.
CLONE_TOKENS, CLONE_LINES = 50, 6
_TOKEN = r"[A-Za-z_$][A-Za-z0-9_$]*|\d[A-Za-z0-9_.]*|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|[^\s\w]"
#: Words that keep their own identity when the others become one.
_KEPT_WORDS = "and as assert async await break case catch class const continue def default del do elif else except export extends false finally for from func function go if implements import in interface is lambda let new none not null or package pass private protected public raise range return self static struct super switch this throw true try type var void while with yield"


_WORDS_KEPT = frozenset(_KEPT_WORDS.split())
_CODE_TOKEN = re.compile(r"\n|" + _TOKEN)
_NOTE_LINE = re.compile(r"^[ \t]*(?:#|//|\*|/\*).*$", re.M)
_POWER = np.uint64(0x9E3779B97F4A7C15)


class _TokenIds(dict):
    """Token -> a number for what it is normalised to; a line break is 0. Emptied when it grows too large, which changes nothing."""

    def __missing__(self, token: str) -> int:
        plain = token.lower()
        kind = "0" if token[0] in "\"'0123456789" else "n" if (token[0].isalpha() or token[0] in "_$") and plain not in _WORDS_KEPT else plain
        found = 0 if token == "\n" else int.from_bytes(hashlib.blake2b(kind.encode(), digest_size=8).digest(), "little") | 1
        if len(self) > 200_000:
            self.clear()
        self[token] = found
        return found


_IDS = _TokenIds()


def clone_windows(text: str, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of normalised tokens of a text, and the lines (from 0) of their first and last tokens."""
    tokens = _CODE_TOKEN.findall(_NOTE_LINE.sub("", text.replace("\r\n", "\n").replace("\r", "\n")))
    ids = np.fromiter(map(_IDS.__getitem__, tokens), np.uint64, len(tokens))
    ends = ids == 0
    lines, ids = np.cumsum(ends)[~ends], ids[~ends]
    n = len(ids) - window + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none, none, none
    hashes = np.zeros(n, np.uint64)
    for j in range(window):
        hashes = hashes * _POWER + ids[j : j + n]
    hashes ^= hashes >> np.uint64(29)
    return (hashes * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64), lines[:n], lines[window - 1 :]


def clone_spans(files: DataFrame, window: int = CLONE_TOKENS) -> DataFrame:
    """repository_id, node_id, start_line, end_line, class_id, members: stretches of code that occur more than once.

    Tokens are normalised (names become one, literals another), each window of `window` tokens gets a
    rolling hash, and windows with a hash of more than one place are merged to stretches by islands.
    The class of a stretch is the place of the first window like its first one; members counts those
    places. No pair is formed and no bucket is cut off. Texts shorter than a window have no clone.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [clone_windows(t, window) for t in batch["text"].to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
            fields = [pa.array(np.concatenate([f[i] for f in found]) if found else [], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64()))]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["hash", "first", "last"]))
            yield pa.RecordBatch.from_arrays([batch["repository_id"], batch["node_id"], lists], [*_KEY, "windows"])

    schema = "repository_id string, node_id string, windows array<struct<hash: bigint, first: bigint, last: bigint>>"
    hashes = latest(files).filter("text is not null").mapInArrow(read, schema).select(*_KEY, F.posexplode("windows").alias("i", "w"))
    places = Scratch(files.sparkSession, "clones").write(hashes.select(*_KEY, "i", "w.*"))  # counted, then joined
    repeated = places.groupBy("hash").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(*_KEY, "i")).alias("home")).filter("members > 1")
    shared = lookup(places, repeated, ["hash"], "inner")
    order = Window.partitionBy(*_KEY).orderBy("i")
    # a stretch goes on while windows follow each other here and at the home of their class
    step = (F.col("i") != F.lag("i").over(order) + 1) | F.lag("i").over(order).isNull()
    island = shared.withColumn("new", step.cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.groupBy(*_KEY, "island").agg(F.min("first").alias("a"), F.max("last").alias("b"), F.min_by("home", "i").alias("home"), F.min_by("members", "i").alias("members"))
    class_id = F.concat_ws(":", "home.repository_id", "home.node_id", F.col("home.i").cast("string"))
    return spans.filter(F.col("b") - F.col("a") + 1 >= CLONE_LINES).select(*_KEY, (F.col("a") + 1).cast("int").alias("start_line"), (F.col("b") + 1).cast("int").alias("end_line"), class_id.alias("class_id"), "members")


def duplication(spans: DataFrame, files: DataFrame) -> DataFrame:
    """repository_id, node_id, nloc, cloned_lines, dup_pct, clone_lines (of the longest stretch); files without clones have zeros."""
    total = latest(files).select(*_KEY, F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")).alias("nloc"))
    # stretches of one file don't overlap by tokens; a line that two of them share counts once
    order = Window.partitionBy(*_KEY).orderBy("start_line", "end_line")
    before = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end_line") - F.greatest(F.col("start_line"), F.coalesce(before + 1, F.lit(1))) + 1, F.lit(0))
    cloned = spans.withColumn("fresh", fresh).groupBy(*_KEY).agg(F.sum("fresh").alias("cloned_lines"), F.max(F.col("end_line") - F.col("start_line") + 1).alias("clone_lines"))
    share = F.round(F.least(100 * F.col("cloned_lines") / F.greatest("nloc", F.lit(1)), F.lit(100.0)), 4)
    return total.join(cloned, _KEY, "left").fillna(0, ["cloned_lines", "clone_lines"]).withColumn("dup_pct", share)
