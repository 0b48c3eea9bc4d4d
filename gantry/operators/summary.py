"""Summaries, percentiles and orders over measures of files, people, events and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gantry.operators.skew import distributed_rank
from gantry.session import Scratch

#: Owners and silos of a knowledge map, weights of a module's composite, effort buckets in lines.
SILO_SHARE, TOP_OWNERS = 0.8, 10
EFFORT = [(50, "S"), (200, "M"), (500, "L")]
SEVERITIES = ["critical", "high", "medium", "low"]


def rank_share(df: DataFrame, key: str, value: str, name: str = "percentile") -> DataFrame:
    """key, value, and the share of rows ordered before a row (ties by key); rows whose value isn't positive have 0."""
    kept = Scratch(df.sparkSession, "share").write(df.select(key, value))
    positive = kept.filter(F.col(value) > 0)
    n = positive.agg(F.count(F.lit(1)).alias("_n"))
    ranked = distributed_rank(positive, [], [F.col(value), F.col(key)], "_rn").crossJoin(F.broadcast(n))
    share = ranked.select(key, value, F.round((F.col("_rn") - 1) / F.col("_n"), 6).alias(name))
    return share.unionByName(kept.filter(~(F.coalesce(value, F.lit(0)) > 0)).withColumn(name, F.lit(0.0)))


def strict_percentile(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, percentile: 100 times the share of rows with a smaller value, rounded to whole numbers."""
    kept = Scratch(df.sparkSession, "strict").write(df.select(key, value).filter(F.col(value).isNotNull()))
    counts = kept.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    upto = distributed_rank(counts, [], [F.col(value)], "_r", weight="_c", total="_upto")
    total = counts.agg(F.sum("_c").alias("_t"))
    below = upto.crossJoin(F.broadcast(total)).select(value, F.floor(100 * (F.col("_upto") - F.col("_c")) / F.col("_t") + 0.5).cast("int").alias("percentile"))
    return kept.join(below, value).select(key, value, "percentile")


def percentile_cut(scores: DataFrame, value: str, percentile: str, cuts: list[float]) -> DataFrame:
    """cut, value: the least value whose percentile reaches each cut; null if none does."""
    wanted = [F.struct(F.lit(float(c)).alias("cut"), F.min(F.when(F.col(percentile) >= c, F.col(value))).alias(value)) for c in cuts]
    return scores.agg(F.array(*wanted).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def paged(df: DataFrame, orders: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of a total order, with total, the number of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*orders).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def severity_rank(column: str = "severity") -> Column:
    """0 for critical to 3 for low, 4 for anything else."""
    out = F.when(F.lit(False), 0)
    for i, s in enumerate(SEVERITIES):
        out = out.when(F.col(column) == s, i)
    return out.otherwise(4)


def spread_over_files(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Adds place: findings by severity in rounds over their files, so that no file fills the head of the list."""
    order = [F.col("_severity"), *[F.col(k) for k in keys]]
    ranked = distributed_rank(findings.withColumn("_severity", severity_rank()), [keys[0]], order, "_round")
    return distributed_rank(ranked, [], [F.col("_round"), *order], "place").drop("_severity", "_round")


def first_mention(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """key, source: all keys of several frames, each with the first frame that mentions it."""
    every = None
    for i, (name, frame) in enumerate(sources):
        part = frame.select(key).distinct().select(key, F.struct(F.lit(i).alias("i"), F.lit(name).alias("source")).alias("m"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.min("m").alias("m")).select(key, "m.source")


def retired(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of a previous run that the current one has no more."""
    return before.select(*keys).distinct().join(after.select(*keys).distinct(), keys, "left_anti")


def knowledge_map(owners: DataFrame) -> DataFrame:
    """owner, files, silos of the TOP_OWNERS authors of most files; a silo is a file that its owner has more than SILO_SHARE of."""
    by = owners.groupBy("owner").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("owner_share") > SILO_SHARE).alias("silos"))
    return by.orderBy(F.col("files").desc(), "owner").limit(TOP_OWNERS)


def owner_profiles(changes: DataFrame, authors: DataFrame) -> DataFrame:
    """author, files, commits, lines: files touched, commits, and each file's lines by the author's share of its commits."""
    x = changes.join(authors.select("sha", "author"), "sha")
    mine = x.groupBy("path", "author").agg(F.count(F.lit(1)).alias("n"))
    every = x.groupBy("path").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("added") + F.col("deleted")).alias("lines"))
    return mine.join(every, "path").groupBy("author").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("commits"), F.round(F.sum(F.col("lines") * F.col("n") / F.col("total")), 3).alias("lines"))


def module_composite(files: DataFrame) -> DataFrame:
    """module, files, health of files(module, owner_share, bus_factor, hot, idle_days): 100 less the shares of silos, hot and idle files, more for shared knowledge, within 0 and 100."""
    g = files.groupBy("module").agg(
        F.count(F.lit(1)).alias("files"), F.avg((F.col("owner_share") > SILO_SHARE).cast("int")).alias("silo"), F.avg(F.col("hot").cast("int")).alias("hot"),
        F.avg((F.col("idle_days") > 365).cast("int")).alias("idle"), F.avg(F.when(F.col("bus_factor") >= 3, 1).when(F.col("bus_factor") == 1, -1).otherwise(0)).alias("bus"),
    )
    score = 100 - 25 * F.col("silo") - 20 * F.col("hot") - 25 * F.col("idle") + 10 * F.col("bus")
    return g.select("module", "files", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 4).alias("health"))


def fix_density(changes: DataFrame, fixes: DataFrame) -> DataFrame:
    """sha, density: the mean fix share of a commit's files, weighted by what it changes in them."""
    churn = F.col("added") + F.col("deleted")
    return changes.join(fixes.select("path", "fix_share"), "path").groupBy("sha").agg(F.round(F.sum(churn * F.col("fix_share")) / F.sum(churn), 4).alias("density"))


def priorities(files: DataFrame) -> DataFrame:
    """path, effort, priority of files(path, lines, dependents, score): (1 + benefit)(1 + leverage) over (1 + cost), and the effort bucket of the lines."""
    leverage = 0.5 * F.log1p(F.greatest(8 - F.col("score"), F.lit(0.0)) * F.col("lines")) + F.log1p("dependents")
    effort = F.when(F.lit(False), "S")
    for most, name in EFFORT:
        effort = effort.when(F.col("lines") <= most, name)
    return files.select("path", effort.otherwise("XL").alias("effort"), F.round((1 + F.greatest(10 - F.col("score"), F.lit(0.0))) * (1 + leverage) / (1 + F.log1p("lines")), 6).alias("priority"))


def price_estimates(events: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, low, median, high: totals if every event cost the 10th, 50th or 90th percentile."""
    q = lambda p, name: F.round(F.count(F.lit(1)) * F.expr(f"percentile({value}, {p})"), 4).alias(name)
    return events.groupBy(group).agg(F.count(F.lit(1)).alias("n"), q(0.1, "low"), q(0.5, "median"), q(0.9, "high"))


def amplification(events: DataFrame, by: str, reads: str, writes: str) -> DataFrame:
    """sessions, amplification: the median over `by` of the value read for each value written; those who wrote nothing don't count."""
    s = events.groupBy(by).agg(F.sum(F.when(F.col("event_type") == reads, F.col("value"))).alias("r"), F.sum(F.when(F.col("event_type") == writes, F.col("value"))).alias("w")).filter("w > 0")
    ratio = F.coalesce("r", F.lit(0.0)) / F.col("w")
    return s.select(ratio.alias("x")).agg(F.count(F.lit(1)).alias("sessions"), F.round(F.expr("percentile(x, 0.5)"), 6).alias("amplification"))


def repeats(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, times, avoidable: what was done more than once, and the value of all but the dearest time."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"), F.round(F.sum("value") - F.max("value"), 4).alias("avoidable")).filter("times > 1")


# -- texts ---------------------------------------------------------------------------------------
#: Words that give a reason, that take something back, and that report an error.
REASONS = r"(?i)\b(because|since|so that|otherwise|due to|in order to|to avoid|workaround)\b"
REVERSALS = r"(?i)\b(no longer|instead of|replaced by|deprecated|reverted|rolled back|superseded)\b"
ERRORS = r"(?i)\b(error|exception|failed|fatal|traceback|panic)\b"


def rationale_comments(texts: DataFrame) -> DataFrame:
    """scope, file, comments, reasons: line comments of a text and those that give a reason; files without a reason are left out."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\s*(#|//)"))
    x = texts.filter("text is not null").select("scope", "file", F.size(lines).alias("comments"), F.size(F.filter(lines, lambda x: x.rlike(REASONS))).alias("reasons"))
    return x.filter("reasons > 0").distinct()


def reversals(docs: DataFrame) -> DataFrame:
    """doc_id, signals: how often a text takes something back; texts that don't are left out."""
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(REVERSALS), F.lit(0))).alias("signals")).filter("signals > 0")


def opening_frames(docs: DataFrame, group: str, words: int = 3) -> DataFrame:
    """group, frame, uses: openings (first words, numbers masked) that more than one text of a group has."""
    frame = F.array_join(F.slice(F.regexp_extract_all(F.regexp_replace(F.lower("text"), r"\d+", "n"), F.lit(r"[a-z]+"), F.lit(0)), 1, words), " ")
    return docs.filter(F.col("text").isNotNull() & F.col(group).isNotNull()).select(group, frame.alias("frame")).groupBy(group, "frame").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1 and frame <> ''")


def capped_lines(docs: DataFrame, head: int = 5, tail: int = 5) -> DataFrame:
    """doc_id, lines, kept, text: the first and last lines of a text and, between them, those that report an error."""
    lines = F.split("text", "\n")
    n = F.size(lines)
    kept = F.filter(lines, lambda x, i: (i < head) | (i >= n - tail) | x.rlike(ERRORS))
    return docs.filter("text is not null").select("doc_id", n.alias("lines"), F.size(kept).alias("kept"), F.md5(F.array_join(kept, "\n")).alias("digest"))


def line_classes(docs: DataFrame) -> DataFrame:
    """class, lines: the lines of all texts as headings, bullets, code, diffs, errors, tables, blank ones and prose; the first that fits."""
    x = F.col("line")
    kind = (
        F.when(F.trim(x) == "", "blank").when(x.rlike(r"^#{1,6} "), "heading").when(x.rlike(r"^\s*([-*+]|\d+\.) "), "bullet").when(x.rlike(r"^(@@|\+\+\+|---) "), "diff")
        .when(x.rlike(ERRORS), "error").when(x.rlike(r"^\s*\|.*\|\s*$"), "table").when(x.rlike(r"^(    |\t|```)"), "code").otherwise("prose")
    )
    return docs.filter("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("lines"))


def vocabulary(docs: DataFrame, group: str, k: int = 20) -> DataFrame:
    """group, word, texts, place: the k words that most texts of a group have."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{4,}"), F.lit(0)))
    counts = docs.filter(F.col("text").isNotNull() & F.col(group).isNotNull()).select(group, F.explode(words).alias("word")).groupBy(group, "word").agg(F.count(F.lit(1)).alias("texts"))
    ranked = distributed_rank(counts, [group], [F.col("texts").desc(), F.col("word")], "place")
    return ranked.filter(F.col("place") <= k)


def symbol_matches(symbols: DataFrame, query: list[str]) -> DataFrame:
    """symbol_id, name, score: the share of the query's words among the humps of a name, 1 more if the name is the words."""
    humps = F.filter(F.split(F.lower(F.regexp_replace("name", r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+"), lambda w: w != "")
    wanted = F.array(*[F.lit(w) for w in query])
    score = F.size(F.array_intersect(wanted, humps)) / F.lit(len(query)) + F.when(humps == wanted, 1.0).otherwise(0.0)
    return symbols.select("symbol_id", "name", F.round(score, 6).alias("score")).filter("score > 0").distinct()
