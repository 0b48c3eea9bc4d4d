"""References to records that do not exist.

A Bloom filter of all parent keys proves most dangling references; only the references that pass
it are joined with the parents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.operators.skew import lookup

#: Bits of a filter per key, probes per key, and the bounds of a filter's size (2**27 bits are 16 MB).
BITS_PER_KEY, PROBES, LEAST_BITS, MOST_BITS = 10, 4, 1 << 16, 1 << 27
#: Words of the filter that come to the driver as one row.
PAGE = 1024


def _hash(keys: list[str | Column]) -> Column:
    return F.xxhash64(*keys)


class BloomFilter:
    """A Bloom filter over hashed keys, built by a bit_or aggregate and broadcast as one array of words.

    The array never exceeds MOST_BITS: with more keys than it is made for, more references pass the
    filter and are settled by the exact join, and the result stays the same.
    """

    def __init__(self, keys: DataFrame, columns: list[str], expected: int):
        bits = LEAST_BITS
        while bits < min(expected * BITS_PER_KEY, MOST_BITS):
            bits *= 2
        self.bits = bits
        spots = F.array(*[self._spot(F.col("_h"), i) for i in range(PROBES)])
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_b").bitwiseAND(F.lit(63)).cast("int"))
        words = keys.select(_hash(columns).alias("_h")).select(F.explode(spots).alias("_b")).groupBy(F.shiftright("_b", 6).alias("word")).agg(F.bit_or(one).alias("mask"))

        def pack(word: pd.Series, mask: pd.Series) -> bytes:
            part = np.zeros(PAGE, dtype=np.int64)
            part[word.to_numpy(dtype=np.int64) % PAGE] = mask.to_numpy(dtype=np.int64)
            return part.tobytes()

        # the driver takes whole pages, no more bytes than the filter has
        pages = words.groupBy(F.floor(F.col("word") / PAGE).alias("page")).agg(F.pandas_udf(pack, "binary")("word", "mask").alias("bits"))
        table = np.zeros(bits // 64, dtype=np.int64)
        for r in pages.collect():
            at = r["page"] * PAGE
            table[at : at + PAGE] = np.frombuffer(r["bits"], dtype=np.int64)[: len(table) - at]
        self.shared = keys.sparkSession.sparkContext.broadcast(table)

    def _spot(self, hashed: Column, i: int) -> Column:
        low = hashed.bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(hashed, 32)
        return (low + high * F.lit(i) + F.lit(i * i)).bitwiseAND(F.lit(self.bits - 1))

    def might_contain(self, columns: list[str]) -> Column:
        shared, bits = self.shared, self.bits

        def probe(hashed: pd.Series) -> pd.Series:
            table = shared.value
            h = hashed.to_numpy(dtype=np.int64)
            low, high = h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF
            hit = np.ones(len(h), dtype=bool)
            for i in range(PROBES):
                at = (low + high * i + i * i) & (bits - 1)
                hit &= (table[at >> 6] >> (at & 63)) & 1 == 1
            return pd.Series(hit)

        return F.pandas_udf(probe, "boolean")(_hash(columns))


def orphan_references(refs: DataFrame, parents: DataFrame, removals: DataFrame) -> DataFrame:
    """The references that hold no longer, not yet or never, with `reason` missing, late or deleted.

    refs: ref_id, side, scope, kind, key, at (time of the reference, may be null).
    parents: scope, kind, key, born (may be null). removals: scope, kind, key, removed_at.

    A null key is no reference. A null time proves nothing: such references can only be missing.
    Repeated parents count once, with their earliest time. Repeated references yield one row.
    """
    refs = refs.filter(F.col("key").isNotNull() & F.col("scope").isNotNull())
    on = ["scope", "kind", "key"]
    alive = parents.filter(F.col("key").isNotNull()).groupBy(*on).agg(F.min("born").alias("born"), F.count_if(F.col("born").isNull()).alias("unknown"))
    gone = removals.filter(F.col("removed_at").isNotNull() & F.col("key").isNotNull()).groupBy(*on).agg(F.min("removed_at").alias("removed_at"))
    bloom = BloomFilter(parents.filter(F.col("key").isNotNull()), on, parents.count())
    marked = refs.withColumn("maybe", bloom.might_contain(on))
    definite = marked.filter(~F.col("maybe")).select("ref_id", "side", "scope", "at", F.lit("missing").alias("reason"))
    facts = alive.join(gone, on, "left").withColumn("exists", F.lit(True))
    judged = lookup(marked.filter("maybe").drop("maybe"), facts, on, hot_from=refs)  # counted without the filter
    reason = (
        F.when(F.col("exists").isNull(), "missing")
        .when((F.col("unknown") == 0) & (F.col("born") > F.col("at")), "late")
        .when(F.col("removed_at") <= F.col("at"), "deleted")
    )
    verified = judged.select("ref_id", "side", "scope", "at", reason.alias("reason")).filter("reason is not null")
    return definite.unionByName(verified).dropDuplicates(["ref_id", "side", "reason"])


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per scope, month of the reference (null where unknown), side and reason."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return found.groupBy("scope", month, "side", "reason").agg(F.count(F.lit(1)).alias("orphans"))
