"""Problem 8: filling fixed-capacity containers by shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.tokens import VOCABULARY, token_count
from gantry.operators.skew import distributed_rank
from gantry.session import Scratch

#: Ranks of one length that meet the runs of packs together.
BUCKET = 64


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Packing patterns (count, lengths) for length -> count, every length at most the capacity.

    Lengths are placed longest first, each into the emptiest packs so far; packs of one pattern are
    handled as one count, so the work depends on the number of lengths, not of items.
    """
    packs: dict[int, list[tuple[int, tuple]]] = {}  # room left -> [(count, pattern)], a pattern links to what it extends
    rooms: list[int] = []
    for length in sorted(histogram, reverse=True):
        left, made = histogram[length], []
        while left and rooms and -rooms[0] >= length:
            room = -rooms[0]
            waiting = packs.get(room)
            if not waiting:
                heapq.heappop(rooms)
                packs.pop(room, None)
                continue
            count, pattern = waiting.pop()
            used = min(count, left)
            if count > used:
                waiting.append((count - used, pattern))
            left -= used
            # placed at once, so that a pack can take several items of this length
            if room - length not in packs:
                packs[room - length] = []
                heapq.heappush(rooms, -(room - length))
            packs[room - length].append((used, (pattern, length)))
        if left:
            each = capacity // length  # what no pack has room for opens new ones, filled evenly
            full, rest = divmod(left, each)
            made += [(full, each)] if full else []
            made += [(1, rest)] if rest else []
            for count, items in made:
                pattern: tuple | None = None
                for _ in range(items):
                    pattern = (pattern, length)
                room = capacity - items * length
                if room not in packs:
                    packs[room] = []
                    heapq.heappush(rooms, -room)
                packs[room].append((count, pattern))
    out = []
    for waiting in packs.values():
        for count, pattern in waiting:
            lengths = []
            while pattern:
                pattern, length = pattern
                lengths.append(length)
            out.append((count, lengths))
    return out


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first container, containers): which ranks of a length go to which containers, in turn.

    A pattern's items of one length are one run. A length splits at most one pattern and opens at
    most two, so there are no more than three patterns a length, each with no more than
    sqrt(2 * capacity) different lengths.
    """
    out = []
    taken: dict[int, int] = {}
    base = 0
    for count, lengths in patterns:
        for length, times in Counter(lengths).items():
            first = taken.get(length, 0)
            out.append((length, first, times * count, base, count))
            taken[length] = first + times * count
        base += count
    return out


def pack_documents(documents: DataFrame, windows: list[tuple[str, int]], vocabulary: str = VOCABULARY) -> DataFrame:
    """window_name, container_id, doc_id, part_no, first_token, n_tokens: each document once per window.

    A text longer than the capacity, and no other, is split into full containers and a rest. Null
    and empty texts have no tokens and go nowhere. documents(doc_id, text) must have unique ids. The
    driver only sees the histogram, at most `capacity` rows a window.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "pack")
    sized = scratch.write(documents.select("doc_id", token_count(F.col("text"), vocabulary).alias("size")).filter("size > 0"))
    if not windows:
        return spark.createDataFrame([], "window_name string, container_id bigint, doc_id bigint, part_no int, first_token bigint, n_tokens int")
    every = []
    for name, capacity in windows:
        part = F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / capacity).cast("int"))).alias("part_no")
        parts = sized.select("doc_id", "size", part)
        length = F.least(F.lit(capacity), F.col("size") - F.col("part_no") * F.lit(capacity)).cast("int")
        every.append(parts.select(F.lit(name).alias("window_name"), "doc_id", "part_no", (F.col("part_no").cast("long") * capacity).alias("first_token"), length.alias("n_tokens")))
    parts = reduce(DataFrame.unionByName, every)
    counted = parts.groupBy("window_name", "n_tokens").count().collect()
    runs = []
    for name, capacity in windows:
        patterns = pack_histogram({r["n_tokens"]: r["count"] for r in counted if r["window_name"] == name}, capacity)
        runs += [(name, *run) for run in slots(patterns)]
    ranked = distributed_rank(parts, ["window_name", "n_tokens"], [F.col("doc_id"), F.col("part_no")], "rank").withColumn("rank", F.col("rank") - 1)
    made = spark.createDataFrame(runs, "window_name string, n_tokens int, first long, ranks long, base long, containers long")
    # runs meet ranks by bucket, so that no rank is compared with more runs than a bucket has ranks
    spread = made.withColumn("bucket", F.explode(F.sequence(F.expr(f"first div {BUCKET}"), F.expr(f"(first + ranks - 1) div {BUCKET}"))))
    met = ranked.withColumn("bucket", F.expr(f"rank div {BUCKET}")).join(spread, ["window_name", "n_tokens", "bucket"])
    met = met.filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks")))
    container = F.col("base") + (F.col("rank") - F.col("first")) % F.col("containers")
    return met.select("window_name", container.alias("container_id"), "doc_id", "part_no", "first_token", "n_tokens")


def packing_report(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """Containers, tokens and unused share of each window (null where nothing was packed)."""
    filled = packed.groupBy("window_name").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("parts"))
    room = F.col("containers") * F.col("capacity_tokens")
    return windows.select("window_name", "capacity_tokens").distinct().join(filled, "window_name", "left").withColumn("unused_share", F.round(1 - F.col("tokens") / room, 6))
