"""Problem 10: keyword-stuffed and link-list pages, by the mutual information of neighbouring words.

Pair and word counts over the distinct texts of the corpus give each pair of neighbouring words its
normalised pointwise mutual information, without the text's own occurrences, so that copies don't
vouch for each other. A page is spam if its words belong together far less than those of pages of
its length (word salad, product lists), less so if links or tags stand between most of them (link
lists), or if one collocation makes up too much of it. All of it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.operators.skew import lookup
from gantry.session import Scratch

#: Pages of fewer pairs of neighbouring words aren't judged, and by their commonest collocation not below COLLOCATION_PAIRS.
LEAST_PAIRS, COLLOCATION_PAIRS = 8, 12
#: Incoherent: so many deviations, and at least LEAST_GAP, below the median of pages of like length; fewer deviations if so large a share of the pairs has a link, tag or number.
DEVIATIONS, LEAST_GAP, MARKED_SHARE, MARKED_DEVIATIONS = 2.8, 0.08, 0.5, 1.5
#: Repeated: the share of all pairs that are one and the same.
ONE_COLLOCATION = 0.16
#: Pages of like length: powers of two of their word pairs, between these; with fewer pages than FEW the median is that of all pages.
LEAST_BIN, MOST_BIN, FEW = 2, 9, 50
#: Occurrences that a pair which no other text has counts for.
UNSEEN = 0.1

#: What a link looks like; the endings are those of names without a scheme.
_LINK = r"(?:https?://|www\.)[^\s<>\")\]]+|\b[\p{L}\p{N}_-]++(?:\.[\p{L}\p{N}_-]+)*\.(?:example|test|invalid|com|org|net|io|dev|app|info|biz|co)\b[^\s<>\")\]]*"
_TAG = r"<[^>\n]*>"
LINK, TAG, NUMBER = "\x01", "\x02", "\x03"


def page_words(text: Column) -> Column:
    """The words of a page in order; links, hash tags and numbers count as one word each."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, _TAG, " ")), _LINK, " \x01 ")
    words = F.regexp_extract_all(plain, F.lit(r"\x01|#[\p{L}\p{N}_]+|[\p{L}\p{N}_]+"), F.lit(0))
    return F.transform(words, lambda w: F.when(w.startswith("#"), TAG).when(w.rlike(r"^\p{N}"), NUMBER).otherwise(w))


def word_pairs(texts: DataFrame) -> DataFrame:
    """h, x, y, n: neighbouring words of texts(h, text), as hashes, and how often each text has them."""
    words = texts.select("h", F.transform(page_words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    # the last word has no neighbour; null ends drop with it
    pairs = words.select("h", F.explode(F.arrays_zip(F.col("w").alias("x"), F.slice("w", 2, 2**30).alias("y"))).alias("p")).select("h", "p.x", "p.y")
    return pairs.filter("y is not null").groupBy("h", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def judge_pages(pages: DataFrame) -> DataFrame:
    """doc_id, pairs, word_pairs, normalised, gap, deviation, repeated, spam of pages(doc_id, text).

    normalised: mean normalised information of the pairs of two words; gap: how far it lies below
    the median of pages of like length, deviation: the median distance from it there (scaled to a
    standard deviation). Null, empty and one-word pages have no pairs and are no spam. Whole texts
    are read, and counts and medians are those of the distinct texts, whose verdict goes to each
    page with that text.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    key = F.unhex(F.md5("text")).alias("h")
    ids = scratch.write(pages.select("doc_id", key))
    texts = pages.filter("text is not null").select(key, "text").groupBy("h").agg(F.first("text").alias("text"))
    rows = scratch.write(word_pairs(texts))
    counts = scratch.write(rows.groupBy("x", "y").agg(F.sum("n").alias("c")))
    # a word's count is that of the pairs it opens or closes; the total is that of all pairs
    first = counts.groupBy("x").agg(F.sum("c").alias("cx"))
    second = counts.groupBy("y").agg(F.sum("c").alias("cy"))
    total = counts.agg(F.sum("c").alias("m"))
    stats = lookup(lookup(counts, first, ["x"], "inner"), second, ["y"], "inner")
    met = lookup(rows, stats, ["x", "y"], "inner").crossJoin(F.broadcast(total))
    n, others = F.col("n"), F.greatest(F.col("c") - F.col("n"), F.lit(0)) + F.lit(UNSEEN)
    normalised = F.log(others * F.col("m") / (F.col("cx").cast("double") * F.col("cy"))) / -F.log(others / F.col("m"))
    mark = lambda c: F.col(c).isin(*[F.xxhash64(F.lit(m)) for m in (LINK, TAG, NUMBER)])
    words = ~mark("x") & ~mark("y")
    sums = met.groupBy("h").agg(
        F.sum(n).alias("pairs"), F.coalesce(F.sum(F.when(words, n)), F.lit(0)).alias("word_pairs"), F.sum(F.when(words, n * normalised)).alias("s"), (F.max(n) / F.sum(n)).alias("repeated"),
    )
    size = F.greatest(F.least(F.floor(F.log2(F.col("word_pairs"))), F.lit(MOST_BIN)), F.lit(LEAST_BIN))
    facts = scratch.write(sums.select("h", "pairs", "word_pairs", "repeated", (F.col("s") / F.col("word_pairs")).alias("normalised"), F.when(F.col("word_pairs") > 0, size).alias("size")))
    judged = facts.filter((F.col("pairs") >= LEAST_PAIRS) & F.col("size").isNotNull())
    middle = lambda c, name: F.percentile_approx(c, 0.5, 10000).alias(name)
    everywhere = judged.agg(middle("normalised", "all_median"))
    # at most MOST_BIN rows, and one for all
    by_size = judged.groupBy("size").agg(middle("normalised", "median"), F.count(F.lit(1)).alias("members")).crossJoin(F.broadcast(everywhere))
    medians = by_size.select("size", F.when(F.col("members") >= FEW, F.col("median")).otherwise(F.col("all_median")).alias("median"), (F.col("members") >= FEW).alias("enough"))
    away = judged.join(F.broadcast(medians), "size").withColumn("away", F.abs(F.col("normalised") - F.col("median")))
    spread = away.groupBy("size").agg(middle("away", "own")).crossJoin(F.broadcast(away.agg(middle("away", "overall"))))
    scale = medians.join(spread, "size").select("size", "median", (1.4826 * F.when(F.col("enough"), F.col("own")).otherwise(F.col("overall"))).alias("deviation"))
    gap = F.col("median") - F.col("normalised")
    far = F.when(1 - F.col("word_pairs") / F.col("pairs") > MARKED_SHARE, MARKED_DEVIATIONS).otherwise(DEVIATIONS)
    salad = (gap > LEAST_GAP) & (gap > far * F.col("deviation"))
    one = (F.col("repeated") > ONE_COLLOCATION) & (F.col("pairs") >= COLLOCATION_PAIRS)
    verdict = facts.join(F.broadcast(scale), "size", "left").select(
        "h", "pairs", "word_pairs", "normalised", gap.alias("gap"), "deviation", "repeated", ((F.col("pairs") >= LEAST_PAIRS) & (F.coalesce(salad, F.lit(False)) | one)).alias("spam"),
    )
    return lookup(ids, verdict, ["h"], "left").drop("h").fillna(0, ["pairs", "word_pairs"]).fillna(False, ["spam"])
