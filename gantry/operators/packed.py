"""Searches from all nodes of edges(scope, src, dst), without a row per pair of nodes.

A scope's edges travel as packed integers; each task gets the edges of one scope and searches from
its share of the scope's nodes. A task's memory grows with the edges of one scope, never with pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.operators.skew import distributed_rank, lookup
from gantry.session import Scratch

#: Visits of edges that one task is given, and the most tasks of a scope (its edges are sent to each).
VISITS, MOST_PARTS = 40_000_000, 512
#: Cells of the arrays that a task works on at once: they stay in the cache.
CELLS = 1 << 18


def search(edges: DataFrame, nodes: DataFrame, kernel: Callable, schema: str, scratch: Scratch, share: int = 1) -> tuple[DataFrame, DataFrame]:
    """nodes with their index `at` in the scope, in order of a hash; and scope with the columns that the kernel gives.

    kernel(src, dst, n, part, parts) gets a scope's edges as indices and gives arrays by column; `schema`
    names the columns. share: edges that the kernel follows in the time of one.
    """
    known = nodes.filter("scope is not null and node is not null")
    ranked = scratch.write(distributed_rank(known, ["scope"], [F.xxhash64("scope", "node"), F.col("node")], "at").withColumn("at", F.col("at") - 1))
    step = edges.filter("src <> dst").select("scope", "src", "dst").distinct()
    a = lookup(step, ranked.withColumnsRenamed({"node": "src", "at": "a"}), ["scope", "src"], "inner")
    step = scratch.write(lookup(a, ranked.withColumnsRenamed({"node": "dst", "at": "b"}), ["scope", "dst"], "inner").select("scope", F.col("a").cast("int"), F.col("b").cast("int")))
    sizes = ranked.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).join(step.groupBy("scope").agg(F.count(F.lit(1)).alias("m")), "scope")
    parts = F.least(F.greatest(F.ceil(F.col("n") * F.col("m") / (VISITS * share)), F.lit(1)), F.lit(MOST_PARTS), F.col("n")).cast("int")
    sizes = scratch.write(sizes.select("scope", "n", parts.alias("parts"), F.monotonically_increasing_id().alias("id")))
    tasks = sizes.agg(F.coalesce(F.sum("parts"), F.lit(1))).first()[0]

    def pack(batches):
        for batch in batches:
            ids, ends = batch["id"].to_numpy(), [batch[c].to_numpy() for c in ("a", "b")]
            order = np.argsort(ids, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1) if len(order) else []:
                yield pa.RecordBatch.from_arrays([pa.array([ids[own[0]]]), *(pa.array([x[own].tobytes()], pa.binary()) for x in ends)], ["id", "a", "b"])

    def run(key, table):
        src, dst = (np.concatenate([np.frombuffer(x, np.int32) for x in table[c].to_pylist()]) for c in ("a", "b"))
        n, count = table["n"][0].as_py(), table["parts"][0].as_py()
        found = kernel(src, dst, n, key[1].as_py(), count)
        rows = len(next(iter(found.values())))
        return pa.table({"id": np.full(rows, key[0].as_py(), np.int64)} | found)

    packed = step.join(F.broadcast(sizes.select("scope", "id")), "scope").select("id", "a", "b").mapInArrow(pack, "id bigint, a binary, b binary")
    sent = packed.join(F.broadcast(sizes.drop("scope")), "id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition(max(tasks, 1), "id", "part")
    out = scratch.write(sent.groupBy("id", "part").applyInArrow(run, f"id bigint, {schema}"))
    return ranked, out.join(F.broadcast(sizes.select("scope", "id")), "id").drop("id")


def _by_source(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Successors in order of their source, the first place of each source and its number of successors."""
    out = np.bincount(src, minlength=n).astype(np.int32)
    return dst[np.argsort(src, kind="stable")], (np.cumsum(out) - out).astype(np.int32), out


def dependencies(src: np.ndarray, dst: np.ndarray, n: int, part: int, parts: int, sources: int | None = None) -> dict[str, np.ndarray]:
    """Brandes' dependencies of each node, summed over the part's share of the first `sources` nodes (None: all)."""
    near, first, out = _by_source(src, dst, n)
    total = np.zeros(n)
    starts = np.arange(part, n if sources is None else min(n, sources), parts)
    width = max(1, CELLS // n)
    for lo in range(0, len(starts), width):
        own = starts[lo : lo + width]
        keys = np.arange(len(own)) * n + own  # a cell for each source and node
        unmet, paths, delta, mark = np.ones(len(own) * n, bool), np.zeros(len(own) * n), np.zeros(len(own) * n), np.empty(len(own) * n, np.int64)
        at, node, waves = keys, own, []
        unmet[at], paths[at] = False, 1.0
        while len(at):
            fan = out[node]
            last = np.cumsum(fan)
            after = near[np.arange(last[-1]) + np.repeat(first[node] - last + fan, fan)]
            goal = after + np.repeat(at - node, fan)
            fresh = np.flatnonzero(unmet[goal])
            back, goal, after = np.repeat(at, fan)[fresh], goal[fresh], after[fresh]
            np.add.at(paths, goal, paths[back])
            waves.append((back, goal))
            mark[goal] = np.arange(len(goal))
            once = mark[goal] == np.arange(len(goal))
            at, node = goal[once], after[once]
            unmet[at] = False
        for back, goal in reversed(waves):
            np.add.at(delta, back, paths[back] * ((1 + delta[goal]) / paths[goal]))
        delta[keys] = 0.0
        total += delta.reshape(len(own), n).sum(0)
    found = np.flatnonzero(total)
    return {"at": found, "delta": total[found]}


def _components(near: np.ndarray, first: np.ndarray, out: np.ndarray, n: int) -> np.ndarray:
    """The strongly connected component of each node, numbered so that edges lead to lower numbers (Tarjan, without recursion)."""
    succ, place, ends = near.tolist(), first.tolist(), (first + out).tolist()
    order, low, comp, stack, met, number = [0] * n, [0] * n, [-1] * n, [], 0, 0
    for root in range(n):
        if order[root]:
            continue
        trail = [root]
        while trail:
            v = trail[-1]
            if not order[v]:
                met += 1
                order[v] = low[v] = met
                stack.append(v)
            i, end, deeper = place[v], ends[v], False
            while i < end:
                w = succ[i]
                if not order[w]:
                    deeper = True
                    break
                if comp[w] < 0 and low[w] < low[v]:
                    low[v] = low[w]
                i += 1
            place[v] = i
            if deeper:
                trail.append(w)
                continue
            trail.pop()
            if low[v] == order[v]:
                while True:
                    w = stack.pop()
                    comp[w] = number
                    if w == v:
                        break
                number += 1
    return np.array(comp, np.int64)


def reached(src: np.ndarray, dst: np.ndarray, n: int, part: int, parts: int) -> dict[str, np.ndarray]:
    """The number of ordered pairs of nodes of which the first reaches the second (itself too), for the part's share of second nodes.

    Nodes of one strongly connected component reach the same; the components are taken from the ends
    of the paths to their beginnings, each with a bit for each second node.
    """
    near, first, out = _by_source(src, dst, n)
    comp = _components(near, first, out, n)
    k = int(comp.max()) + 1
    size = np.bincount(comp, minlength=k)
    links = np.unique(np.stack([comp[src], comp[dst]], 1)[comp[src] != comp[dst]], axis=0)
    after, begin, fan = _by_source(links[:, 0], links[:, 1], k)
    level, succ = [0] * k, after.tolist()
    for c, (b, f) in enumerate(zip(begin.tolist(), fan.tolist())):
        if f:
            level[c] = 1 + max(level[x] for x in succ[b : b + f])
    level = np.array(level)
    order = np.argsort(level, kind="stable")
    steps = []
    for own in np.split(order, np.flatnonzero(np.diff(level[order])) + 1)[1:]:
        f = fan[own]
        last = np.cumsum(f)
        steps.append((own, after[np.arange(last[-1]) + np.repeat(begin[own] - last + f, f)], last - f))
    words = max(1, min(-(-n // 64), (CELLS * 16) // max(k, len(links), 1)))
    pairs = 0
    own = np.arange(part, n, parts)
    for lo in range(0, len(own), words * 64):
        goals = own[lo : lo + words * 64]
        bits = np.zeros((k, words), np.uint64)
        place = np.arange(len(goals))
        np.bitwise_or.at(bits, (comp[goals], place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
        for c, into, begins in steps:
            bits[c] |= np.bitwise_or.reduceat(bits[into], begins, axis=0)
        pairs += int(np.bitwise_count(bits).sum(1, dtype=np.int64) @ size)
    return {"pairs": np.array([pairs])}
