"""Graph measures over edges(scope, src, dst); every scope is a graph of its own.

Loops write their state to the shared folder each round, so plans stay short and lost executors
cost one round. Hubs are joined through salted lookups or pre-aggregated, never gathered.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gantry.operators import packed
from gantry.operators.skew import lookup
from gantry.session import Scratch

#: Damping of PageRank, edge origins that executions don't follow, least confidence they do.
DAMPING, UNRELIABLE, WALKABLE = 0.85, ["global_unique"], 0.5


def walkable(edges: DataFrame) -> DataFrame:
    """The edges an execution may follow; an unknown origin is trusted."""
    origin = F.col("resolution_origin")
    return edges.filter((origin.isNull() | ~origin.isin(UNRELIABLE)) & (F.col("confidence") >= WALKABLE))


def nodes_of(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array("src", "dst")).alias("node")
    return edges.select("scope", ends).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """scope, node, in_degree, out_degree over distinct pairs; self loops count on both sides."""
    pairs = edges.select("scope", "src", "dst").distinct()
    sides = pairs.select("scope", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return sides.groupBy("scope", F.col("x.node").alias("node")).agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def pagerank(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """scope, node, rank after so many rounds; the rank of nodes without successors is spread over all."""
    scratch = Scratch(edges.sparkSession, "pagerank")
    pairs = edges.select("scope", "src", "dst").distinct()
    out = pairs.groupBy("scope", "src").agg(F.count(F.lit(1)).alias("deg"))
    links = scratch.write(pairs.join(out, ["scope", "src"]))
    nodes = scratch.write(nodes_of(edges).join(out.withColumnRenamed("src", "node"), ["scope", "node"], "left"))
    sizes = nodes.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    state = nodes.join(F.broadcast(sizes), "scope").withColumn("rank", 1 / F.col("n"))
    path = None
    for i in range(rounds):
        flow = lookup(links, state.select("scope", F.col("node").alias("src"), "rank"), ["scope", "src"], "inner").groupBy("scope", F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        lost = state.filter("deg is null").groupBy("scope").agg(F.sum("rank").alias("lost"))
        rank = (1 - DAMPING) / F.col("n") + DAMPING * (F.coalesce("got", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) / F.col("n"))
        state = state.drop("rank").join(flow, ["scope", "node"], "left").join(F.broadcast(lost), "scope", "left").select("scope", "node", "deg", "n", rank.alias("rank"))
        if i % 4 == 3:
            last, (state, path) = path, scratch.keep(state)
            if last:
                scratch.drop(last)
    return state.select("scope", "node", "rank")


def reach(seeds: DataFrame, edges: DataFrame, depth: int | None, backward: bool = False) -> DataFrame:
    """scope, seed, node, hops: what each seed reaches within `depth` hops (None: any), at its least distance (the seed at 0).

    A wave only expands nodes that its seed meets for the first time, so cycles end.
    """
    scratch = Scratch(seeds.sparkSession, "reach")
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = scratch.write(edges.filter(F.col("src") != F.col("dst")).select("scope", F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    waves = [scratch.write(seeds.select("scope", "seed", "node").distinct().withColumn("hops", F.lit(0)))]
    for hop in count(1) if depth is None else range(1, depth + 1):
        met = waves[-1].join(step, ["scope", "node"]).select("scope", "seed", F.col("next").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, waves).select("scope", "seed", "node")
        waves.append(scratch.write(met.join(seen, ["scope", "seed", "node"], "left_anti").withColumn("hops", F.lit(hop))))
        if depth is None and not waves[-1].limit(1).count():
            break
    return reduce(DataFrame.unionByName, waves)


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """scope, node, community by synchronous label propagation: the commonest label of the neighbours, the least on ties."""
    scratch = Scratch(edges.sparkSession, "communities")
    both = edges.select("scope", "src", "dst").unionByName(edges.select("scope", F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both = scratch.write(both)
    state = nodes_of(edges).withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = lookup(both, state.withColumnRenamed("node", "src"), ["scope", "src"], "inner").groupBy("scope", F.col("dst").alias("node"), "community").agg(F.count(F.lit(1)).alias("votes"))
        best = votes.groupBy("scope", "node").agg(F.min_by("community", F.struct(-F.col("votes"), "community")).alias("best"))
        state = scratch.write(state.join(best, ["scope", "node"], "left").select("scope", "node", F.coalesce("best", "community").alias("community")))
    return state


def settled_communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """scope, node, community: communities() carried on until no node has a commoner label among its neighbours.

    From then on a node moves only to a label that strictly more of its neighbours bear, and no two
    neighbours move in one round: each move adds linked pairs of one label, so no label oscillates.
    """
    scratch = Scratch(edges.sparkSession, "settled")
    both = edges.select("scope", "src", "dst").unionByName(edges.select("scope", F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both = scratch.write(both)
    state, last = scratch.keep(communities(edges, rounds))
    while True:
        votes = lookup(both, state.withColumnRenamed("node", "src"), ["scope", "src"], "inner").groupBy("scope", F.col("dst").alias("node"), "community").agg(F.count(F.lit(1)).alias("votes"))
        seen = votes.join(state.withColumnRenamed("community", "own"), ["scope", "node"])
        best = seen.groupBy("scope", "node").agg(F.min_by("community", F.struct(-F.col("votes"), "community")).alias("best"), F.max("votes").alias("most"), F.coalesce(F.max(F.when(F.col("community") == F.col("own"), F.col("votes"))), F.lit(0)).alias("kept"))
        rank = F.struct(F.xxhash64("scope", "node").alias("h"), "node").alias("rank")
        wish = scratch.write(best.filter("most > kept").select("scope", "node", "best", rank))
        if not wish.limit(1).count():
            return state
        ahead = both.join(wish.select("scope", F.col("node").alias("src"), F.col("rank").alias("other")), ["scope", "src"]).groupBy("scope", F.col("dst").alias("node")).agg(F.min("other").alias("other"))
        moves = wish.join(ahead, ["scope", "node"], "left").filter(F.col("other").isNull() | (F.col("rank") < F.col("other"))).select("scope", "node", "best")
        old, (state, last) = last, scratch.keep(state.join(moves, ["scope", "node"], "left").select("scope", "node", F.coalesce("best", "community").alias("community")))
        scratch.drop(old)


def super_graph(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between groups(scope, node, group) with their number, and within a group as its own edge."""
    a = lookup(edges.select("scope", "src", "dst").distinct(), groups.select("scope", F.col("node").alias("src"), F.col("group").alias("from_group")), ["scope", "src"], "inner")
    b = lookup(a, groups.select("scope", F.col("node").alias("dst"), F.col("group").alias("to_group")), ["scope", "dst"], "inner")
    return b.groupBy("scope", "from_group", "to_group").agg(F.count(F.lit(1)).alias("edges"))


def cohesion(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: size and the share of its possible undirected pairs that are linked (1 for single nodes)."""
    pairs = edges.filter("src <> dst").select("scope", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    inner = super_graph(pairs, groups).filter("from_group = to_group").select("scope", F.col("from_group").alias("group"), "edges")
    sizes = groups.groupBy("scope", "group").agg(F.count(F.lit(1)).alias("size"))
    n = F.col("size")
    return sizes.join(inner, ["scope", "group"], "left").select("scope", "group", "size", F.round(F.when(n < 2, 1.0).otherwise(F.coalesce("edges", F.lit(0)) / (n * (n - 1) / 2)), 4).alias("cohesion"))


def short_cycles(edges: DataFrame) -> DataFrame:
    """scope, cycle: elementary cycles of two and three nodes, each once, from its least node."""
    e = edges.filter("src <> dst").select("scope", "src", "dst").distinct()
    back = e.select("scope", F.col("src").alias("dst"), F.col("dst").alias("src"))
    two = e.join(back, ["scope", "src", "dst"]).filter("src < dst").select("scope", F.array("src", "dst").alias("cycle"))
    second = e.select("scope", F.col("src").alias("dst"), F.col("dst").alias("third"))
    # the two-step paths start at their least node, and the closing edge is found by an equi-join
    walk = e.filter("src < dst").join(second, ["scope", "dst"]).filter("third > src and third <> dst")
    close = e.select("scope", F.col("src").alias("third"), F.col("dst").alias("src"))
    three = walk.join(close, ["scope", "third", "src"]).select("scope", F.array("src", "dst", "third").alias("cycle"))
    return two.unionByName(three).select("scope", F.array_join("cycle", " > ").alias("cycle"), F.size("cycle").alias("length"))


def shortest_cycles(edges: DataFrame, most: int = 50) -> DataFrame:
    """scope, cycle, length: the `most` shortest elementary cycles of each scope, of any length, each from its least node.

    Paths grow by a node a round within their strongly connected component, through nodes greater
    than their first; a scope is done when it has `most` cycles or no path is left.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    member = strongly_connected(edges)
    e = edges.filter("src <> dst").select("scope", "src", "dst").distinct()
    e = e.join(member.withColumnRenamed("node", "src"), ["scope", "src"]).join(member.withColumnRenamed("node", "dst"), ["scope", "dst", "component"])
    e = scratch.write(e.select("scope", "src", "dst"))
    paths = scratch.write(e.filter("src < dst").select("scope", F.col("src").alias("first"), F.col("dst").alias("src"), F.array("src", "dst").alias("path")))
    found = []
    while paths.limit(1).count():
        found.append(scratch.write(paths.join(e.withColumnRenamed("dst", "first"), ["scope", "src", "first"]).select("scope", F.col("path").alias("cycle"))))
        done = reduce(DataFrame.unionByName, found).groupBy("scope").count().filter(F.col("count") >= most)
        grown = paths.join(done, "scope", "left_anti").join(e, ["scope", "src"]).filter((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst")))
        paths = scratch.write(grown.select("scope", "first", F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path")))
    if not found:
        return e.limit(0).select("scope", F.col("src").alias("cycle"), F.lit(0).alias("length"))
    every = reduce(DataFrame.unionByName, found).withColumn("length", F.size("cycle"))
    order = Window.partitionBy("scope").orderBy("length", "cycle")
    return every.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).select("scope", F.array_join("cycle", " > ").alias("cycle"), "length")


def strongly_connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """scope, node, component (its least node), of the components of two nodes or more.

    Nodes without predecessors or successors are trimmed first; then each node learns the least node
    that reaches it, and the nodes that reach that one back under the same label are its component.
    """
    scratch = Scratch(edges.sparkSession, "scc")
    live, n = scratch.write(edges.filter("src <> dst").select("scope", "src", "dst").distinct()), -1
    found: list[DataFrame] = []
    while True:
        while True:
            left = live.count()
            if left in (n, 0):
                break
            n = left
            has_out, has_in = live.select("scope", F.col("src").alias("dst")).distinct(), live.select("scope", F.col("dst").alias("src")).distinct()
            live = scratch.write(live.join(has_out, ["scope", "dst"], "left_semi").join(has_in, ["scope", "src"], "left_semi"))
        if not live.count():
            break
        label = nodes_of(live).withColumn("label", F.col("node"))
        label, changed = scratch.write(label), 1
        while changed:  # the least node that reaches each node
            got = live.join(label.withColumnRenamed("node", "src"), ["scope", "src"]).groupBy("scope", F.col("dst").alias("node")).agg(F.min("label").alias("got"))
            new = scratch.write(label.join(got, ["scope", "node"], "left").select("scope", "node", F.least("label", F.coalesce("got", "label")).alias("label"), (F.col("got") < F.col("label")).alias("moved")))
            changed, label = new.filter("moved").limit(1).count(), new.drop("moved")
        same = live.join(label.select("scope", F.col("node").alias("src"), F.col("label").alias("la")), ["scope", "src"]).join(label.select("scope", F.col("node").alias("dst"), F.col("label").alias("lb")), ["scope", "dst"]).filter("la = lb")
        same = scratch.write(same.select("scope", "src", "dst", F.col("la").alias("label")))
        back = scratch.write(label.filter("node = label").select("scope", "node", "label"))
        grown = back
        while grown.limit(1).count():
            step = same.join(grown.select("scope", F.col("node").alias("dst"), "label"), ["scope", "dst", "label"]).select("scope", F.col("src").alias("node"), "label").distinct()
            grown = scratch.write(step.join(back, ["scope", "node", "label"], "left_anti"))
            back = scratch.write(back.unionByName(grown))
        found.append(back)
        gone = back.select("scope", "node")
        live = scratch.write(live.join(gone.withColumnRenamed("node", "src"), ["scope", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["scope", "dst"], "left_anti"))
        n = -1
    if not found:
        return nodes_of(edges).limit(0).withColumn("component", F.col("node"))
    every = reduce(DataFrame.unionByName, found)
    big = every.groupBy("scope", "label").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return every.join(big, ["scope", "label"]).select("scope", "node", F.col("label").alias("component"))


def execution_flows(entries: DataFrame, edges: DataFrame, steps: int = 8) -> DataFrame:
    """scope, entry, trace, length: from each entry the walk to the callee that calls most, never back, at most `steps` hops."""
    scratch = Scratch(entries.sparkSession, "flows")
    calls = edges.filter("src <> dst").select("scope", "src", "dst").distinct()
    out = calls.groupBy("scope", F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("fan"))
    ranked = scratch.write(lookup(calls, out, ["scope", "dst"]).select("scope", F.col("src").alias("at"), "dst", F.coalesce("fan", F.lit(0)).alias("fan")))
    state = entries.select("scope", F.col("node").alias("entry"), F.col("node").alias("at"), F.array("node").alias("trace"))
    done = []
    for _ in range(steps):
        options = state.join(ranked, ["scope", "at"]).filter(~F.array_contains("trace", F.col("dst")))
        chosen = options.groupBy("scope", "entry").agg(F.min_by("dst", F.struct(-F.col("fan"), "dst")).alias("next"))
        moved = scratch.write(state.join(chosen, ["scope", "entry"], "left"))
        done.append(moved.filter("next is null").select("scope", "entry", "trace"))
        state = moved.filter("next is not null").select("scope", "entry", F.col("next").alias("at"), F.concat("trace", F.array("next")).alias("trace"))
    done.append(state.select("scope", "entry", "trace"))
    return reduce(DataFrame.unionByName, done).select("scope", "entry", F.array_join("trace", " > ").alias("trace"), F.size("trace").alias("length"))


def entry_scores(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """Adds entry_score to nodes(scope, node, visibility, name, is_entry_point): fan-out, few callers, visibility, name, framework mark."""
    x = nodes.join(degree, ["scope", "node"], "left").fillna(0, ["in_degree", "out_degree"])
    score = (
        0.35 * F.least(F.col("out_degree") / 10.0, F.lit(1.0)) + 0.25 / (1.0 + F.col("in_degree")) + 0.2 * F.when(F.col("visibility") == "public", 1.0).otherwise(0.0)
        + 0.15 * F.when(F.lower("name").rlike("^(main|run|start|serve|handle|handler|execute|app|init)"), 1.0).otherwise(0.0) + 0.05 * F.when(F.col("is_entry_point"), 1.0).otherwise(0.0)
    )
    return x.withColumn("entry_score", F.round(score, 6))


def unreferenced(files: DataFrame, edges: DataFrame) -> DataFrame:
    """files(scope, node, is_test, is_entry_point) that no other file refers to, with a confidence that they are dead.

    Entry points and tests are rescued; unknown marks count as false and lower the confidence.
    """
    used = edges.filter("src <> dst").select("scope", F.col("dst").alias("node")).distinct()
    lone = files.filter(~F.coalesce("is_entry_point", F.lit(False)) & ~F.coalesce("is_test", F.lit(False))).join(used, ["scope", "node"], "left_anti")
    risky = F.lower("node").rlike(r"(^|[/_.-])(plugin|hook|handler|migration|config|settings|main|index|setup|conftest|register)")
    confidence = F.when(risky, 0.4).when(F.col("is_test").isNull(), 0.7).otherwise(0.9)
    return lone.select("scope", "node", confidence.alias("confidence"))


def conformance(edges: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Edges that a deny rule (name, source pattern, target pattern) forbids; rules are a short parameter list."""
    hits: list[Column] = [F.when(F.col("src").rlike(a) & F.col("dst").rlike(b), F.lit(name)) for name, a, b in rules]
    return edges.select("scope", "src", "dst", F.explode(F.array_compact(F.array(*hits))).alias("rule")).distinct()


def propagation_cost(edges: DataFrame, depth: int | None) -> DataFrame:
    """Per scope: nodes and the share of ordered pairs that are linked by a walk of at most `depth` hops (None: any)."""
    nodes = nodes_of(edges)
    if depth is None:  # counted in bits, without a row per pair
        scratch = Scratch(edges.sparkSession, "closure")
        nodes = scratch.write(nodes)
        ranked, parts = packed.search(edges, nodes, packed.reached, "pairs bigint", scratch, share=256)
        own = ranked.groupBy("scope").agg(F.count(F.lit(1)).alias("own"))  # every node reaches itself
        pairs = parts.groupBy("scope").agg(F.sum("pairs").alias("pairs")).join(own, "scope").select("scope", (F.col("pairs") - F.col("own")).alias("pairs"))
    else:
        pairs = reach(nodes.select("scope", F.col("node").alias("seed"), "node"), edges, depth).filter("hops > 0").groupBy("scope").agg(F.count(F.lit(1)).alias("pairs"))
    sizes = nodes.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(pairs, "scope", "left").select("scope", "n", F.round(F.when(F.col("n") > 1, F.coalesce("pairs", F.lit(0)) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0), 6).alias("cost"))


def override_dispatch(methods: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Pairs base method -> overriding method: methods(scope, type, name, node) of a type and of its ancestors(scope, type, ancestor)."""
    impl = methods.join(ancestors, ["scope", "type"])
    base = methods.select("scope", F.col("type").alias("ancestor"), "name", F.col("node").alias("base"))
    return impl.join(base, ["scope", "ancestor", "name"]).select("scope", "base", F.col("node").alias("impl")).distinct()


def betweenness(edges: DataFrame, sample: int | None = None) -> DataFrame:
    """scope, node, betweenness: Brandes' sums over shortest paths, scaled by (n - 1)(n - 2).

    Each task searches from a share of a scope's nodes (packed.dependencies); the sums per task and node are
    added up. Exact for every scope; with `sample`, scopes of more nodes count from that many hashed
    sources, scaled up.
    """
    scratch = Scratch(edges.sparkSession, "betweenness")
    nodes = scratch.write(nodes_of(edges))
    sizes = nodes.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    ranked, parts = packed.search(edges, nodes, partial(packed.dependencies, sources=sample), "at bigint, delta double", scratch)
    total = parts.groupBy("scope", "at").agg(F.sum("delta").alias("delta")).join(ranked, ["scope", "at"]).drop("at")
    n = F.col("n")
    asked = n if sample is None else F.least(n, F.lit(sample))
    scaled = F.when(n > 2, F.coalesce("delta", F.lit(0.0)) * (n / asked) / ((n - 1) * (n - 2))).otherwise(0.0)
    return nodes.join(sizes, "scope").join(total, ["scope", "node"], "left").select("scope", "node", F.round(scaled, 9).alias("betweenness"))


def system_graph(uses: DataFrame) -> DataFrame:
    """source, target, kind, weight, confidence of uses(source, target, kind, confidence): one edge per pair and kind."""
    return uses.groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("weight"), F.max("confidence").alias("confidence"))


def breaking_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """contract, field, change, breaking of two states (contract, field, type, required): removed, type_changed, newly_required or added.

    A contract that is missing on one side as a whole is removed or added as one row with a null field.
    """
    gone = before.select("contract").distinct().join(after.select("contract").distinct(), "contract", "left_anti").select("contract", F.lit(None).cast("string").alias("field"), F.lit("removed").alias("change"))
    both = before.join(after.select("contract").distinct(), "contract", "left_semi").select("contract", F.col("field").cast("string").alias("field"), F.col("type").alias("t0"), F.col("required").alias("r0"), F.lit(True).alias("had"))
    now = after.select("contract", F.col("field").cast("string").alias("field"), F.col("type").alias("t1"), F.col("required").alias("r1"), F.lit(True).alias("has"))
    x = both.join(now, ["contract", "field"], "full_outer")
    change = F.when(F.col("has").isNull(), "removed").when(F.col("had").isNull(), "added").when(F.col("t0") != F.col("t1"), "type_changed").when(~F.col("r0") & F.col("r1"), "newly_required")
    return x.select("contract", "field", change.alias("change")).filter("change is not null").unionByName(gone).withColumn("breaking", F.col("change") != "added")


def decision_currency(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """decision, later_commits: for each decision (a sha of commits(sha, ts, is_fix) with is_fix) the later commits that touch one of its paths in changes(sha, path).

    Per path the later commits are counted in order of time, without listing them. A commit that
    shares k paths with the decision is counted k times so, and k - 1 are taken off: such commits
    share k * (k - 1) / 2 pairs of paths with it, so only commits that meet in a pair are listed. A
    row per path holds the paths after it, so paths and pairs take one exchange.
    """
    sha = changes.schema["sha"].dataType
    span = commits.filter("sha is not null").groupBy("sha").agg(F.min(F.when(F.col("is_fix"), F.col("ts"))).alias("since"), F.max("ts").alias("last")).filter("last is not null")
    own = changes.filter("path is not null").groupBy("sha").agg(F.sort_array(F.collect_set("path")).alias("paths")).join(span, "sha")
    by_path = own.select("sha", "since", "last", "paths", F.posexplode("paths").alias("i", "a")).select("sha", "since", "last", "a", F.slice("paths", F.col("i") + 2, F.size("paths")).alias("rest")).repartition("a")
    alone = F.array(F.lit(None).cast(changes.schema["path"].dataType))
    met = by_path.select("sha", "since", "last", "a", F.explode(F.concat(alone, F.col("rest"))).alias("b"))
    # a commit is an event at its time, a decision another one, ahead of the commits of that time
    event = lambda at, asks: F.struct(F.col(at).alias("at"), F.lit(asks).alias("asks"))
    events = met.select("sha", "a", "b", F.explode(F.array_compact(F.array(event("last", False), F.when(F.col("since").isNotNull(), event("since", True))))).alias("x")).select("sha", "a", "b", "x.*")
    newer = Window.partitionBy("a", "b").orderBy(F.col("at").desc(), F.col("asks").desc()).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(~F.col("asks") & F.col("b").isNull(), 1).otherwise(0)).over(newer)
    shas = F.collect_list(F.when(~F.col("asks") & F.col("b").isNotNull(), F.col("sha"))).over(newer)
    found = events.withColumns({"n": n, "shas": shas}).filter("asks")
    single = F.when(F.col("b").isNull(), F.array(F.lit(None).cast(sha))).otherwise(F.col("shas"))
    listed = found.select(F.col("sha").alias("decision"), "n", F.explode(single).alias("sha")).repartition("decision").groupBy("decision", "sha").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"))
    shared = ((F.sqrt(1 + 8 * F.col("pairs")) - 1) / 2).cast("bigint")  # k - 1 of k * (k - 1) / 2
    return listed.groupBy("decision").agg(F.sum(F.when(F.col("sha").isNull(), F.col("n")).otherwise(-shared)).alias("later_commits")).filter("later_commits > 0")
