"""Parent-child links to full hierarchies by tree contraction.

A round rakes all leaves into their parents and splices out an independent set of unary chain
nodes. Every removal is recorded as "v hangs w links below p", where p goes in a later round or
stays; the records are then reversed by doubling their pointers, which gives each node its root,
depth, path and subtree. What neither rakes nor splices is a cycle: its nodes contract to one that
is its own parent. The rounds are logarithmic in the number of nodes for any shape, and every join
has unique keys on at least one side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.operators.skew import lookup
from gantry.session import Scratch

_STATE = ["parent", "w", "edge", "acc", "seg", "kids"]


def _rank(node: str):
    return F.xxhash64("scope", node)


def _marked(state: DataFrame) -> DataFrame:
    """Marks each node as raked, spliced or kept, by its children and its neighbours' hashes.

    All leaves are raked. A unary node is spliced out if its hash is the lowest of itself, its
    parent and its child, and its child isn't a leaf: so no two neighbours go in one round.
    """
    row = F.struct(*_STATE)
    none = F.lit(None).cast(state.select(row.alias("x")).schema["x"].dataType)
    own = F.struct(F.col("node").alias("key"), row.alias("own"), F.lit(None).cast("string").alias("child"), F.lit(None).cast("long").alias("below"), F.lit(None).cast("long").alias("between"))
    up = F.struct(F.col("parent").alias("key"), none.alias("own"), F.col("node").alias("child"), F.col("kids").alias("below"), F.col("edge").alias("between"))
    both = state.select("scope", F.explode(F.array(own, up)).alias("x")).select("scope", "x.*").filter("key is not null")
    seen = both.groupBy("scope", "key").agg(F.first("own", ignorenulls=True).alias("own"), F.max("child").alias("child"), F.max("below").alias("below"), F.max("between").alias("between"))
    seen = seen.select("scope", F.col("key").alias("node"), "own.*", "child", "below", "between")
    inner = F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))
    lowest = (_rank("node") < _rank("parent")) & (_rank("node") < _rank("child"))
    act = F.when(inner & (F.col("kids") == 0), "rake").when(inner & (F.col("kids") == 1) & (F.col("below") > 0) & lowest, "splice")
    return seen.withColumn("act", act.otherwise("keep")).drop("below")


def _contract(marked: DataFrame) -> DataFrame:
    """The state after the marked removals."""
    kind = marked.select(F.struct(*_STATE).alias("x")).schema["x"].dataType
    none = F.lit(None).cast(kind)
    act = F.col("act")
    key = F.when(act == "keep", F.col("node")).when(act == "rake", F.col("parent")).otherwise(F.col("child"))
    moved = marked.select(
        "scope",
        key.alias("node"),
        F.when(act == "keep", F.struct(*_STATE)).otherwise(none).alias("own"),
        F.when(act == "rake", F.col("acc") + F.col("edge")).otherwise(F.lit(0)).alias("more"),
        F.when(act == "rake", F.lit(1)).otherwise(F.lit(0)).alias("lost"),
        F.when(act == "splice", F.struct("parent", "w", (F.col("edge") + F.col("acc")).alias("edge"), F.lit(0).cast("long").alias("acc"), F.concat("seg", F.array("node")).alias("seg"), F.lit(0).cast("long").alias("kids"))).otherwise(none).alias("via"),
    )
    met = moved.groupBy("scope", "node").agg(F.first("own", ignorenulls=True).alias("own"), F.sum("more").alias("more"), F.sum("lost").alias("lost"), F.first("via", ignorenulls=True).alias("via"))
    through = F.col("via").isNotNull()
    return met.filter("own is not null").select(
        "scope",
        "node",
        F.when(through, F.col("via.parent")).otherwise(F.col("own.parent")).alias("parent"),
        (F.col("own.w") + F.when(through, F.col("via.w")).otherwise(0)).alias("w"),
        (F.col("own.edge") + F.when(through, F.col("via.edge")).otherwise(0)).alias("edge"),
        (F.col("own.acc") + F.col("more")).alias("acc"),
        F.when(through, F.concat("via.seg", "own.seg")).otherwise(F.col("own.seg")).alias("seg"),
        (F.col("own.kids") - F.col("lost")).alias("kids"),
    )


def _jump(table: DataFrame, scratch: Scratch, to: str, combine: dict, rounds: int, rows: int) -> DataFrame:
    """Follows the pointer column `to` to its end by doubling; combine: column -> (own, next's) -> value.

    A pointer leads to a node that was removed in a later round or never, so no chain is longer
    than the number of rounds, and log2 of that many doublings reach every end.
    """
    last = None
    for _ in range(max(1, rounds).bit_length()):
        ahead = table.select("scope", F.col("node").alias(to), F.col(to).alias("_to"), *[F.col(c).alias(f"_{c}") for c in combine], F.lit(True).alias("_hit"))
        met = lookup(table, ahead, ["scope", to], "left", rows)
        changed = [F.when(F.col("_hit"), f(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)).alias(c) for c, f in combine.items()]
        done = met.select("scope", "node", F.col("_to").alias(to), *changed)
        table, path = scratch.keep(done)
        if last:
            scratch.drop(last)
        last = path
    return table


def descendants(links: DataFrame) -> DataFrame:
    """scope, node, descendant: every node that lies below another, of links(scope, child, parent).

    A cycle's nodes are descendants of one another, and what hangs below one is a descendant of all
    of them; no node counts as its own.
    """
    path = F.array_distinct("full_path")
    pairs = resolve_hierarchy(links, True, True).select("scope", F.explode(path).alias("node"), F.col("node").alias("descendant"))
    return pairs.filter("node <> descendant")


def resolve_hierarchy(links: DataFrame, with_paths: bool = False, with_cycles: bool = False) -> DataFrame:
    """One row per node of links(scope, child, parent): scope, node, root_id, depth[, subtree_size, path].

    root_id is the topmost ancestor (the node itself for a root) and depth the number of links to it;
    nodes on a cycle or below one have root_id '', depth -1, and no path. subtree_size counts the
    node and all its descendants (null where the node's tree ends in a cycle). path lists the ids
    from the root to the node, so the descendants of x are the nodes whose path contains x.

    with_cycles adds full_path, for every node: where its tree ends in a cycle, that begins with the
    cycle's nodes, of which some follow again, so it has each ancestor once or more.

    Null scopes and children are no links; a null parent states a root. Repeated links count once.
    A child with several parents keeps the greatest one. Empty input gives no rows.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "tree")
    links = links.filter(F.col("scope").isNotNull() & F.col("child").isNotNull())
    parent = F.struct(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"))
    ends = links.select("scope", F.explode(F.array(F.struct(F.col("child").alias("node"), F.col("parent")), parent)).alias("x"))
    zero, one, empty = F.lit(0).cast("long"), F.lit(1).cast("long"), F.array().cast("array<string>")
    nodes = scratch.write(ends.select("scope", "x.*").filter("node is not null").groupBy("scope", "node").agg(F.max("parent").alias("parent")))
    kids = nodes.filter("parent is not null").groupBy("scope", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    state = nodes.join(kids, ["scope", "node"], "left").select(
        "scope", "node", "parent", F.when(F.col("parent").isNull(), zero).otherwise(one).alias("w"), zero.alias("edge"), one.alias("acc"), empty.alias("seg"), F.coalesce("kids", zero).alias("kids"),
    )
    records, total = [], 0
    while True:
        marked = scratch.write(_marked(state))
        removed = marked.filter("act <> 'keep'").count()
        if not removed:
            break
        total += removed
        records.append(marked.filter("act <> 'keep'"))
        state = _contract(marked)
        if not with_paths:
            state = state.withColumn("seg", empty)
    hung = reduce(DataFrame.unionByName, [*records, marked])
    core = F.col("act") == "keep"
    table = hung.select(
        "scope", "node", F.when(~core, F.col("parent")).alias("up"), F.when(~core, F.col("w")).otherwise(0).alias("depth"),
        F.when(core, F.col("node")).alias("root"), (core & F.col("parent").isNotNull()).alias("cyclic"),
        *([F.concat("seg", F.array("node")).alias("path")] if with_paths else []),
    )
    combine = {"root": lambda own, ahead: ahead, "depth": lambda own, ahead: own + ahead, "cyclic": lambda own, ahead: own | ahead}
    if with_paths:
        combine["path"] = lambda own, ahead: F.concat(ahead, own)
    found = _jump(table, scratch, "up", combine, len(records), total)
    cyclic = F.col("cyclic")
    out = found.select(
        "scope", "node", F.when(cyclic, "").otherwise(F.col("root")).alias("root_id"), F.when(cyclic, -1).otherwise(F.col("depth")).cast("int").alias("depth"),
        *([F.when(~cyclic, F.col("path")).alias("path")] if with_paths else []), *([F.col("path").alias("full_path")] if with_cycles else []),
    )
    if not with_paths or with_cycles:
        return out
    spliced = F.col("act") == "splice"
    sizes = hung.select("scope", "node", F.when(spliced, F.col("child")).alias("next"), (F.col("acc") + F.when(spliced, F.col("between")).otherwise(0)).alias("subtree_size"))
    sizes = _jump(sizes, scratch, "next", {"subtree_size": lambda own, ahead: own + ahead}, len(records), total)
    sized = out.join(sizes.drop("next"), ["scope", "node"])
    return sized.withColumn("subtree_size", F.when(F.col("depth") >= 0, F.col("subtree_size")))
