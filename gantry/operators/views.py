"""Views built from nodes, edges and their measures: layers, modules, hubs, candidates, diagnostics.

Windows only run over groups of bounded size (layers, languages, modules of a repository); orders over
files or symbols go through distributed_rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gantry.operators.skew import distributed_rank, lookup

#: Share of nodes that count as central, percentile from which a node is a hub, shares of a score.
CENTRAL_SHARE, HUB_PERCENTILE = 0.2, 0.95
#: Packages by what they do and by what they reach; the first match counts.
CATEGORIES = [("testing", r"(test|mock|assert|fixture)"), ("framework", r"(js|kit|react|django|spring|flask)$"), ("database", r"(sql|db|store|redis|cache)"), ("cloud", r"(aws|s3|gcp|azure|cloud)")]
IO_KINDS = [("network", r"(http|net|rpc|socket|hub)"), ("storage", r"(sql|db|store|file|zone)"), ("process", r"(exec|shell|run)")]
#: Words in a path that make deleting it risky.
RISK_WORDS = {"config": "config", "settings": "config", "migration": "migration", "migrations": "migration", "plugin": "dynamic", "plugins": "dynamic", "registry": "dynamic", "handler": "dynamic", "api": "public_api", "public": "public_api", "index": "entry", "main": "entry"}


def layer(path: str | Column) -> Column:
    """The first folder of a path; empty for files at the top."""
    return F.regexp_extract(path, r"^([^/]+)/", 1)


def _crossing(edges: DataFrame) -> DataFrame:
    x = edges.select("scope", "src", "dst").distinct().select("scope", layer("src").alias("a"), layer("dst").alias("b"))
    return x.filter("a <> b and a <> '' and b <> ''").groupBy("scope", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def layer_order(edges: DataFrame) -> DataFrame:
    """scope, layer, outgoing, incoming, net, place: layers of a repository, most depended on first."""
    pairs = _crossing(edges)
    sides = pairs.select("scope", F.explode(F.array(F.struct(F.col("a").alias("layer"), F.col("n").alias("o"), F.lit(0).cast("long").alias("i")), F.struct(F.col("b").alias("layer"), F.lit(0).cast("long").alias("o"), F.col("n").alias("i")))).alias("x"))
    nets = sides.groupBy("scope", "x.layer").agg(F.sum("x.o").alias("outgoing"), F.sum("x.i").alias("incoming")).withColumn("net", F.col("incoming") - F.col("outgoing"))
    return nets.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy(F.col("net").desc(), "layer")).cast("long"))


def module_adjacency(edges: DataFrame) -> DataFrame:
    """scope, module, imports, imported_by, uses, used_by: counts of edges and of modules on the other side."""
    pairs = _crossing(edges)
    out = pairs.groupBy("scope", F.col("a").alias("module")).agg(F.sum("n").alias("imports"), F.count(F.lit(1)).alias("uses"))
    into = pairs.groupBy("scope", F.col("b").alias("module")).agg(F.sum("n").alias("imported_by"), F.count(F.lit(1)).alias("used_by"))
    return out.join(into, ["scope", "module"], "full").fillna(0)


def ego_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """scope, src, dst: edges with a seed(scope, node) at an end."""
    pairs = edges.select("scope", "src", "dst").distinct()
    one = seeds.select("scope", "node").distinct().withColumn("seed", F.lit(True))
    marked = lookup(lookup(pairs, one.select("scope", F.col("node").alias("src"), F.col("seed").alias("s")), ["scope", "src"]), one.select("scope", F.col("node").alias("dst"), F.col("seed").alias("d")), ["scope", "dst"])
    return marked.filter("s or d").select("scope", "src", "dst")


def neighbours(edges: DataFrame) -> DataFrame:
    """scope, node, direction (caller or callee), other: both readings of each distinct edge."""
    both = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit("callee").alias("direction"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.lit("caller").alias("direction"), F.col("src").alias("other"))))
    return edges.select("scope", "src", "dst").distinct().select("scope", both.alias("x")).select("scope", "x.*")


def hub_cutoffs(degrees: DataFrame, share: float = HUB_PERCENTILE) -> DataFrame:
    """scope, cutoff: the in_degree at index floor(n * share) of the ascending order."""
    totals = degrees.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    ranked = distributed_rank(degrees.select("scope", "node", "in_degree"), ["scope"], [F.col("in_degree"), F.col("node")], "rn")
    return ranked.join(F.broadcast(totals), "scope").filter(F.col("rn") - 1 == F.floor(F.col("n") * share)).select("scope", F.col("in_degree").alias("cutoff"))


def flow_neighbourhood(edges: DataFrame, seeds: DataFrame, degrees: DataFrame) -> DataFrame:
    """scope, node, hops: nodes within two steps of the seeds, where no step leads on from a hub."""
    pairs = edges.select("scope", "src", "dst").distinct()
    hubs = degrees.join(F.broadcast(hub_cutoffs(degrees)), "scope").filter("in_degree >= cutoff").select("scope", F.col("node").alias("src"), F.lit(True).alias("hub"))
    start = seeds.select("scope", F.col("node").alias("src")).distinct().withColumn("seed", F.lit(True))
    first = lookup(pairs, start, ["scope", "src"], "inner").select("scope", F.col("dst").alias("node")).distinct()
    on = first.select("scope", F.col("node").alias("src")).join(hubs, ["scope", "src"], "left_anti").withColumn("seed", F.lit(True))
    second = lookup(pairs, on, ["scope", "src"], "inner").select("scope", F.col("dst").alias("node")).distinct()
    every = first.withColumn("hops", F.lit(1)).unionByName(second.withColumn("hops", F.lit(2)))
    near = every.groupBy("scope", "node").agg(F.min("hops").alias("hops"))
    return near.join(seeds.select("scope", "node").distinct(), ["scope", "node"], "left_anti")


def dominant(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, n: the commonest non-null value of a group, the least of equally common ones."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy(group).agg(F.max("n").alias("n"))
    return counts.join(most, [group, "n"]).groupBy(group).agg(F.min(value).alias(value), F.max("n").alias("n"))


def central(nodes: DataFrame, score: str, share: float = CENTRAL_SHARE) -> DataFrame:
    """The share of each scope's nodes(scope, node, score) with the greatest score, ties by node; gaps don't count."""
    known = nodes.filter(F.col(score).isNotNull() & ~F.isnan(score))
    totals = known.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    ranked = distributed_rank(known, ["scope"], [F.col(score).desc(), F.col("node")], "place")
    return ranked.join(F.broadcast(totals), "scope").filter(F.col("place") <= F.ceil(F.col("n") * share)).select("scope", "node", "place")


def feature_envy(calls: DataFrame, least: int = 2) -> DataFrame:
    """scope, src, target, away, own: symbols that call another file more often than their own, and at least `least` times."""
    file = lambda c: F.substring_index(c, "::", 1)
    counted = calls.filter(F.col("src").contains("::") & F.col("dst").contains("::")).groupBy("scope", "src", file("dst").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    own = F.col("target") == file("src")
    per = counted.groupBy("scope", "src").agg(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("own"), F.max(F.when(~own, F.col("n"))).alias("away"))
    best = counted.filter(~own).join(per, ["scope", "src"]).filter("n = away and away > own").filter(F.col("away") >= least)
    return best.groupBy("scope", "src").agg(F.min("target").alias("target"), F.max("away").alias("away"), F.max("own").alias("own"))


def core_periphery(degrees: DataFrame) -> DataFrame:
    """scope, role, nodes: core, shared, control and peripheral nodes, by the medians of in- and out-degree."""
    middle = degrees.groupBy("scope").agg(F.expr("percentile(in_degree, 0.5)").alias("mi"), F.expr("percentile(out_degree, 0.5)").alias("mo"))
    into, out = F.col("in_degree") > F.col("mi"), F.col("out_degree") > F.col("mo")
    role = F.when(into & out, "core").when(into, "shared").when(out, "control").otherwise("peripheral")
    return degrees.join(F.broadcast(middle), "scope").groupBy("scope", role.alias("role")).agg(F.count(F.lit(1)).alias("nodes"))


def names_used_elsewhere(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """scope, file, name, elsewhere: whether a symbol's name is a word of another file of the repository."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    seen = texts.filter("text is not null").select("scope", "file", F.explode(words).alias("name")).distinct()
    wanted = symbols.select("scope", "file", "name").distinct()
    needed = seen.join(wanted.select("scope", "name").distinct(), ["scope", "name"], "left_semi")
    where = needed.groupBy("scope", "name").agg(F.count(F.lit(1)).alias("files"), F.min("file").alias("one"))
    return lookup(wanted, where, ["scope", "name"]).select("scope", "file", "name", F.coalesce((F.col("files") > 1) | (F.col("one") != F.col("file")), F.lit(False)).alias("elsewhere"))


def _first_match(rules: list[tuple[str, str]], column: str, otherwise: str) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in rules:
        out = out.when(F.lower(column).rlike(pattern), name)
    return out.otherwise(otherwise)


def classified_packages(packages: DataFrame) -> DataFrame:
    """scope, name, category, io_kind: the declared category, else the one the name tells; distinct."""
    return packages.select("scope", "name", F.coalesce("category", _first_match(CATEGORIES, "name", "library")).alias("category"), _first_match(IO_KINDS, "name", "none").alias("io_kind")).distinct()


def container_edges(edges: DataFrame) -> DataFrame:
    """scope, a, b, verb, strength: edges between the top folders, with their commonest type and a bucket of their number."""
    x = edges.select("scope", "src", "dst", "edge_type").distinct().select("scope", layer("src").alias("a"), layer("dst").alias("b"), "edge_type").filter("a <> b and a <> '' and b <> ''")
    counts = x.groupBy("scope", "a", "b", "edge_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("scope", "a", "b").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    verb = counts.join(total, ["scope", "a", "b"]).filter("n = most").groupBy("scope", "a", "b").agg(F.min("edge_type").alias("verb"), F.max("total").alias("total"))
    return verb.select("scope", "a", "b", "verb", F.when(F.col("total") == 1, "single").when(F.col("total") <= 5, "few").when(F.col("total") <= 20, "some").otherwise("many").alias("strength"))


def extraction_diagnostics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """scope, edge_type, edges, unnamed, external, unmatched, matched_share of edges(scope, dst, edge_type)."""
    known = nodes.select("scope", F.col("node").alias("dst")).distinct().withColumn("known", F.lit(True))
    external = F.coalesce(F.col("dst").startswith("external:"), F.lit(False))
    x = lookup(edges, known, ["scope", "dst"])
    lost = F.col("dst").isNotNull() & ~external & F.col("known").isNull()
    out = x.groupBy("scope", "edge_type").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("dst").isNull()).alias("unnamed"), F.count_if(external).alias("external"), F.count_if(lost).alias("unmatched"))
    return out.withColumn("matched_share", F.round(1 - (F.col("unnamed") + F.col("unmatched")) / F.col("edges"), 6))


def page_candidacy(files: DataFrame) -> DataFrame:
    """scope, node, candidacy of files(scope, node, symbols, rank, between): 0.01 a symbol up to five, and the shares of the scope's best rank and half of betweenness."""
    best = files.groupBy("scope").agg(F.max("rank").alias("mr"), F.max("between").alias("mb"))
    share = lambda c, m: F.when(F.col(m) > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.col(m)).otherwise(0.0)
    score = 0.01 * F.least(F.coalesce("symbols", F.lit(0)), F.lit(5)) + share("rank", "mr") + 0.5 * share("between", "mb")
    return files.join(F.broadcast(best), "scope").select("scope", "node", F.round(score, 9).alias("candidacy"))


def path_factors(paths: DataFrame) -> DataFrame:
    """scope, node, factors, safe_path: the sorted risk tags of a path's words."""
    tags = F.create_map(*[F.lit(x) for pair in RISK_WORDS.items() for x in pair])
    found = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.lower("node"), r"[^a-z0-9]+"), lambda w: tags[w]), lambda t: t.isNotNull())))
    return paths.select("scope", "node", F.array_join(found, ",").alias("factors"), (F.size(found) == 0).alias("safe_path")).distinct()
