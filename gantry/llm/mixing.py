"""Problem 9: mixing sources to target weights, with capped repetition.

Weights are tempered: the sources' token shares, raised to a falling exponent, times the target
shares, raised to a rising one. The exponent is bisected to the repetition limit; the source that
binds there stays at its limit, and the exponent of the others is bisected on, up to the targets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gantry.llm.tokens import VOCABULARY, token_count
from gantry.session import Scratch

#: Documents of a block, in expectation: the last epoch of a source is spent block by block.
BLOCK_ROWS = 100_000


def temper(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to an exponent and normalised: 1 leaves them, 0 makes them equal."""
    powers = {s: x**exponent if x > 0 else 0.0 for s, x in shares.items()}
    total = sum(powers.values())
    return {s: x / total for s, x in powers.items()} if total else powers


def entropy(shares: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in shares.values() if x > 0)


def bisect(low: float, high: float, test, steps: int = 80) -> float:
    """The greatest x of [low, high] that passes a test which holds at low and fails from some x on."""
    if test(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if test(mid) else (low, mid)
    return low


def blend(natural: dict[str, float], target: dict[str, float], exponent: float) -> dict[str, float]:
    """Token shares to the power 1 - exponent times target shares to the power exponent, normalised."""
    powers = {s: natural[s] ** (1 - exponent) * target[s] ** exponent for s in natural}
    total = sum(powers.values())
    return {s: x / total for s, x in powers.items()}


def solve_weights(tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int], budget: float | None = None) -> tuple[dict[str, float], float, float, float]:
    """(weights, budget, exponent, entropy exponent).

    Without a budget it is the largest at which every source with tokens reaches its target share
    within its repeats. With one, the weights are those of `blend` at the greatest exponent that
    keeps all repeats. The sources whose repeats stop it there stay at their limit, and the others
    share what is left by a greater exponent, until it is 1: then all of them stand in the
    proportion of their targets. `exponent` is that of the first stop (1 if nothing stops it); the
    entropy exponent is the one at which the tempered token shares alone have the targets' entropy.
    """
    live = {s: t for s, t in targets.items() if t > 0 and tokens.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    if not live:
        return {}, 0.0, 0.0, 0.0
    total = sum(live.values())
    target = {s: t / total for s, t in live.items()}
    sizes = {s: tokens[s] for s in live}
    room = {s: float(repeats[s] * sizes[s]) for s in live}
    natural = {s: n / sum(sizes.values()) for s, n in sizes.items()}
    goal = entropy(target)
    flat = 1.0 - bisect(0.0, 1.0, lambda x: entropy(temper(natural, 1.0 - x)) <= goal)
    largest = min(room[s] / target[s] for s in live)
    budget = largest if budget is None else min(budget, sum(room.values()))
    stops: list[float] = []
    given: dict[str, float] = {}
    while True:  # each pass fixes at least one more source at its limit
        free = [s for s in live if s not in given]
        left = budget - sum(given.values())
        use = lambda x: {s: left * w for s, w in blend({s: natural[s] for s in free}, {s: target[s] for s in free}, x).items()}  # noqa: E731, B023
        # only a source whose target itself is out of reach may be stopped
        over = [s for s, n in use(1.0).items() if n > room[s] * (1 + 1e-12)]
        if not over:
            given |= use(1.0)
            break
        at = bisect(0.0, 1.0, lambda x: all(use(x)[s] <= room[s] for s in over))  # noqa: B023
        stops.append(at)
        there = use(at)
        least = min(room[s] / there[s] for s in over)
        given |= {s: room[s] for s in over if room[s] / there[s] <= max(least, 1.0) * (1 + 1e-9)}
    return {s: given[s] / budget for s in live}, budget, (stops or [1.0])[0], flat


def size_sources(documents: DataFrame, targets: DataFrame, seed: int = 17, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of the documents of the target sources, written once for several mixes."""
    wanted = [r["source"] for r in targets.select("source").distinct().collect() if r["source"] is not None]
    sized = documents.filter(F.col("source").isin(wanted)).select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("n_tokens")).filter("n_tokens > 0")
    return Scratch(documents.sparkSession, "mix").write(sized.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")))


def mix_sources(documents: DataFrame, targets: DataFrame, full: bool = False, sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: source, doc_id, copy_no, n_tokens; report: one row per target source.

    full: the budget is the size of all documents of the target sources; else the largest that meets
    every target exactly. A source's budget is spent on whole epochs (copy_no counts them) and a
    last partial one: its documents in random order by blocks, each block in random order within.
    A text is used at most max_repeats times. Documents without a source or tokens take no part;
    sources without targets neither. documents(doc_id, source, text) must have unique ids; targets
    is a small parameter table (source, target_share, max_repeats). sized: what size_sources gave.
    """
    spark = documents.sparkSession
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").distinct().collect() if r["source"] is not None}
    sized = size_sources(documents, targets) if sized is None else sized
    sums = sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    tokens, rows = {r["source"]: r["n"] for r in sums}, {r["source"]: r["rows"] for r in sums}
    goal = {s: float(t or 0) for s, (t, _) in wanted.items()}
    limits = {s: int(r or 0) for s, (_, r) in wanted.items()}
    weights, budget, exponent, flat = solve_weights(tokens, goal, limits, float(sum(tokens.values())) if full else None)
    plan = []
    for s, w in weights.items():
        epochs = math.floor(budget * w / tokens[s] + 1e-9)
        plan.append((s, epochs, float(max(0.0, budget * w - epochs * tokens[s])), 1 + rows[s] // BLOCK_ROWS))
    share = spark.createDataFrame(plan, "source string, epochs int, rest double, blocks int")
    planned = sized.join(F.broadcast(share), "source")
    whole = planned.filter("epochs > 0").select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("copy_no"), "n_tokens")
    block = F.pmod(F.xxhash64("_h", "epochs"), F.col("blocks")).alias("_b")
    last = planned.filter("rest > 0").select("source", "doc_id", "n_tokens", "_h", "epochs", "rest", block)
    sums = last.groupBy("source", "_b").agg(F.sum("n_tokens").alias("_n"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = last.join(F.broadcast(sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))), ["source", "_b"])
    inside = placed.filter(F.col("_before") + F.col("_n") <= F.col("rest"))
    # one block of each source, of about BLOCK_ROWS, straddles its budget; only that one needs a running sum
    edge = placed.filter((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_n") > F.col("rest")))
    running = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # the document on the budget itself is used if more than half of it fits
    cut = edge.withColumn("_sum", F.col("_before") + running).filter(F.col("_sum") - F.col("n_tokens") / 2 <= F.col("rest"))
    cols = ["source", "doc_id", (F.col("epochs") + 1).alias("copy_no"), "n_tokens"]
    mix = whole.unionByName(inside.select(*cols)).unionByName(cut.select(*cols))
    got = mix.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("uses"), F.max("copy_no").alias("most_repeats"))
    facts = [(s, goal[s], limits[s], tokens.get(s, 0), float(weights.get(s, 0.0)), float(budget), float(exponent), float(flat)) for s in sorted(wanted)]
    report = spark.createDataFrame(facts, "source string, target_share double, max_repeats int, available_tokens bigint, weight double, budget double, exponent double, entropy_exponent double")
    report = report.join(got, "source", "left").fillna(0, ["tokens", "documents", "uses", "most_repeats"])
    reached = F.col("tokens") / F.sum("tokens").over(Window.partitionBy())
    return mix, report.withColumn("reached_share", F.round(reached, 6))
