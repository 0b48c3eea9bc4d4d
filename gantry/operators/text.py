"""Search, similarity and line analytics over texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gantry.operators.skew import lookup
from gantry.session import Scratch

#: BM25 parameters, the share of documents from which a term is too common, rank fusion.
K1, B, COMMON, FUSION = 1.2, 0.75, 0.2, 60
#: Words that queries ignore.
STOP_WORDS = "a an the and or of to in is are it for on with as by this that from be at not was were will can how what where when which who why does do".split()
#: What marks a risky line (kind, severity, pattern).
RISKS = [
    ("eval_call", "high", r"\beval\s*\("), ("exec_call", "high", r"\bexec\s*\("), ("pickle_load", "high", r"\bpickle\.loads?\s*\("), ("shell_true", "high", r"shell\s*=\s*True"), ("os_system", "medium", r"\bos\.system\s*\("),
    ("password", "high", r"(?i)\bpassword\s*=\s*[\"'][^\"']+[\"']"), ("secret", "high", r"(?i)\b(?:secret|api_key)\s*=\s*[\"'][^\"']+[\"']"), ("token", "high", r"(?i)\btoken\s*=\s*[\"'][^\"']+[\"']"), ("verify_off", "medium", r"verify\s*=\s*False"), ("md5", "low", r"\bmd5\b"), ("weak_sha", "low", r"\bsha1\b"),
]
#: What log lines differ in, masked in this order.
MASKS = [(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d\S*", "<ts>"), (r"\[\d\d:\d\d(:\d\d)?\]", "<ts>"), (r"\"[^\"]*\"|'[^']*'", "<str>"), (r"([A-Za-z_]+)=[^ ]+", "$1=<v>"), (r"0x[0-9a-fA-F]+|\b[0-9a-f]{8,}\b", "<hex>"), (r"\d+", "<n>")]


def terms(text: Column) -> Column:
    """The lower-case words of a text, without stop words and single letters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), 0)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf of docs(doc_id, text)."""
    return docs.select("doc_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """term, df, and whether it is too common to search by (in more than COMMON of the documents)."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return postings(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", "df", (F.col("df") > COMMON * F.col("n")).alias("common"))


def bm25(docs: DataFrame, query: list[str], k: int) -> DataFrame:
    """The k documents that match best; ties go to the smaller id. Only the query's terms are exploded."""
    kept = F.filter(terms(F.col("text")), lambda w: w.isin(query))
    sized = docs.select("doc_id", F.size(terms(F.col("text"))).alias("len"), kept.alias("hits"))
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    tf = sized.select("doc_id", "len", F.explode("hits").alias("term")).groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # at most as many terms as the query has
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return x.groupBy("doc_id").agg(F.round(F.sum(weight), 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(k)


def relevance(docs: DataFrame, query: list[str]) -> DataFrame:
    """Per document the share of the query's idf weight that it covers, where that is 0.6 or more."""
    found = docs.select("doc_id", F.explode(F.array_distinct(F.filter(terms(F.col("text")), lambda w: w.isin(query)))).alias("term"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    total = df.agg(F.sum("idf").alias("all"))
    x = found.join(F.broadcast(df.select("term", "idf")), "term").groupBy("doc_id").agg(F.sum("idf").alias("got")).crossJoin(F.broadcast(total))
    return x.select("doc_id", F.round(F.col("got") / F.col("all"), 6).alias("relevance")).filter("relevance >= 0.6")


def risky_lines(texts: DataFrame, key: str) -> DataFrame:
    """key, line, kind, severity, snippet: lines that match a risk pattern; one joint pattern gates the explode."""
    joint = "|".join(f"(?:{p})" for _, _, p in RISKS)
    lines = texts.filter(F.col("text").rlike(joint)).select(key, F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    hits = F.array_compact(F.array(*[F.when(F.col("content").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for k, s, p in RISKS]))
    return lines.select(key, (F.col("pos") + 1).alias("line"), F.explode(hits).alias("x"), F.substring(F.trim("content"), 1, 120).alias("snippet")).select(key, "line", "x.*", "snippet")


def log_templates(texts: DataFrame, key: str) -> DataFrame:
    """key, template, n, first: the masked shapes of a text's non-blank lines with their counts."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "content")).filter(F.length(F.trim("content")) > 0)
    masked = F.col("content")
    for pattern, mask in MASKS:
        masked = F.regexp_replace(masked, pattern, mask)
    return lines.groupBy(key, masked.alias("template")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def substance(texts: DataFrame, key: str) -> DataFrame:
    """key, kept_chars, substantial: characters left without headings, tables, fenced code and blank lines (60 or more are substantial)."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)```.*?(```|\z)", "")
    lines = F.filter(F.split(bare, "\n"), lambda x: ~x.rlike(r"^\s*(#|\||\*[^*]+\*\s*$)") & (F.length(F.trim(x)) > 0))
    kept = F.aggregate(lines, F.lit(0), lambda acc, x: acc + F.length(F.trim(x)))
    return texts.select(key, kept.alias("kept_chars")).withColumn("substantial", F.col("kept_chars") >= 60)


def token_savings(full: Column, short: Column) -> Column:
    """Percent of tokens saved by a shorter text (four characters a token), never below 0."""
    a, b = F.floor(F.length(full) / 4), F.floor(F.length(short) / 4)
    return F.when(a > 0, F.greatest(F.lit(0.0), F.round(100 * (a - b) / a, 2))).otherwise(0.0)


def quote_check(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """quotes(doc_id, quote) -> verdict: exact (verbatim in its document), fuzzy (60 % of its words are) or unverified."""
    x = quotes.join(docs.select("doc_id", "text"), "doc_id", "left")
    said = F.array_distinct(terms(F.col("quote")))
    share = F.size(F.array_intersect(said, terms(F.col("text")))) / F.greatest(F.size(said), F.lit(1))
    verdict = F.when(F.contains("text", F.col("quote")), "exact").when(share >= 0.6, "fuzzy").otherwise("unverified")
    return x.select("doc_id", "quote", F.when(F.col("text").isNull(), "unverified").otherwise(verdict).alias("verdict"))


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id, class_id, links: classes of documents whose word-shingle sets have a Jaccard similarity of the threshold or more.

    Equal texts are folded into one representative first. Candidates share a shingle in their
    prefixes (prefix and position filter over shingles in order of rarity), which loses no pair; each candidate is
    then compared in full. links counts the similar representatives and the exact copies; class_id
    is the least doc_id that is linked, directly or through others. Texts of fewer words than a
    shingle compare as a whole. Null and empty texts have no class.
    """
    scratch = Scratch(docs.sparkSession, "classes")
    words = F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"[^\W_]+"), 0)
    # a column of its own, read word by word: a lambda would split the text, and slice would copy all words, once for each shingle
    split = docs.filter(F.length(F.trim("text")) > 0).select("doc_id", words.alias("words"))
    grams = F.when(F.size("words") < shingle, F.array(F.xxhash64("words"))).otherwise(F.transform(F.sequence(F.lit(0), F.size("words") - shingle), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(shingle)])))
    whole, held = scratch.keep(split.select("doc_id", F.array_sort(F.array_distinct(grams)).alias("set")).withColumn("same", F.xxhash64("set")))
    sets = scratch.write(whole.select("doc_id", "same"))
    copies = scratch.write(sets.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    reps = scratch.write(whole.select(F.col("doc_id").alias("rep"), "set", "same").join(copies, ["rep", "same"]).select("rep", "set", "copies"))
    scratch.drop(held)
    rare = reps.select(F.explode("set").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ordered = reps.select("rep", F.size("set").alias("size"), F.explode("set").alias("gram")).join(rare, "gram")
    rank = Window.partitionBy("rep").orderBy("df", "gram")
    # a similar pair shares at least `threshold` of the larger set, so one of the first size - ceil(t * size) + 1 shingles of each
    lone = F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1
    prefix = ordered.withColumn("rn", F.row_number().over(rank)).filter((F.col("rn") <= lone) & (F.col("df") > 1)).select("gram", "rep", "size", (F.col("size") - F.col("rn")).alias("rest"))
    prefix = scratch.write(prefix)
    other = prefix.select("gram", F.col("rep").alias("mate"), F.col("size").alias("mate_size"), F.col("rest").alias("mate_rest"))
    # from their first common shingle on, a similar pair has enough shingles left to share
    enough = 1 + F.least("rest", "mate_rest") >= threshold / (1 + threshold) * (F.col("size") + F.col("mate_size")) - 1e-9
    pairs = prefix.join(other, "gram").filter(enough & (F.col("rep") < F.col("mate")) & (F.col("mate_size") >= threshold * F.col("size")) & (F.col("size") >= threshold * F.col("mate_size"))).select("rep", "mate").distinct()
    a, b = reps.select("rep", F.col("set").alias("sa")), reps.select(F.col("rep").alias("mate"), F.col("set").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    links = pairs.join(a, "rep").join(b, "mate").filter(shared / (F.size("sa") + F.size("sb") - shared) >= threshold).select("rep", "mate")
    links = scratch.write(links)
    both = links.unionByName(links.select(F.col("mate").alias("rep"), F.col("rep").alias("mate")))
    both, label = scratch.write(both), scratch.write(reps.select("rep", F.col("rep").alias("label")))
    while True:  # the least id among neighbours, then that of its own label: chains shorten by half each round
        near = both.join(label.withColumnRenamed("rep", "mate"), "mate").groupBy("rep").agg(F.min("label").alias("near"))
        new = label.join(near, "rep", "left").select("rep", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        up = label.select(F.col("rep").alias("low"), F.col("label").alias("upper"))
        new = scratch.write(lookup(new, up, ["low"]).select("rep", F.least("low", F.coalesce("upper", "low")).alias("label"), (F.least("low", F.coalesce("upper", "low")) < F.col("label")).alias("moved")))
        label = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            break
    degree = both.groupBy("rep").agg(F.count(F.lit(1)).alias("similar"))
    facts = label.join(degree, "rep", "left").join(reps.select("rep", "copies"), "rep")
    members = lookup(sets.select("doc_id", "same"), copies.select("same", "rep"), ["same"], "inner").select("doc_id", "rep")
    joined = lookup(members, facts, ["rep"], "inner")
    return joined.select("doc_id", F.col("label").alias("class_id"), (F.coalesce("similar", F.lit(0)) + F.col("copies") - 1).alias("links"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm(a) * norm(b) > 0, dot / (norm(a) * norm(b))).otherwise(0.0)


#: Vectors that travel as one block.
BLOCK = 2048


def _blocks(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """ids, data: vectors of one length packed to blocks of at most BLOCK, scaled to length 1; null vectors are left out."""
    import numpy as np
    import pyarrow as pa

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = np.array(part["embedding"].to_pylist(), dtype=np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([pa.array([part["vec_id"].to_pylist()], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary())], ["ids", "data"])

    return scratch.write(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null and embedding is not null").mapInArrow(pack, "ids array<bigint>, data binary"))


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int, low: float = -1.0, high: float = 2.0) -> DataFrame:
    """query_id, vec_id, similarity, rank: for each query the k nearest other vectors with low <= similarity < high.

    The queries are a stated set against all rows: both sides are tables of packed blocks, each block
    of queries meets each block of vectors on the executors, and a task keeps only the k nearest it
    has seen for each of its queries before the final ranking. Nothing comes to the driver. Ties go
    to the smaller vec_id; null vectors take no part.
    """
    import numpy as np
    import pyarrow as pa

    scratch = Scratch(vectors.sparkSession, "vectors")
    asked = _blocks(queries, scratch).select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    held = _blocks(vectors, scratch)

    def nearest(batches):
        best: dict[tuple, tuple] = {}
        for batch in batches:
            for q_ids, q_data, ids, data in zip(*[batch[c].to_pylist() for c in ("q_ids", "q_data", "ids", "data")]):
                asks, own = np.array(q_ids, np.int64), np.array(ids, np.int64)
                sims = np.round(np.frombuffer(q_data).reshape(len(asks), -1) @ np.frombuffer(data).reshape(len(own), -1).T, 6)
                sims[(sims < low) | (sims >= high) | (asks[:, None] == own[None, :])] = -9.0
                key = tuple(q_ids)
                names = np.broadcast_to(own, sims.shape)
                if key in best:
                    names, sims = np.hstack([best[key][0], names]), np.hstack([best[key][1], sims])
                top = np.lexsort((names, -sims), axis=1)[:, :k]
                best[key] = np.take_along_axis(names, top, 1), np.take_along_axis(sims, top, 1)
        for key, (names, sims) in best.items():
            kept = sims > -9.0
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(key, np.int64), kept.sum(1))), pa.array(names[kept]), pa.array(sims[kept])], ["query_id", "vec_id", "similarity"])

    found = held.crossJoin(asked).mapInArrow(nearest, "query_id bigint, vec_id bigint, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], key: str) -> DataFrame:
    """Reciprocal rank fusion of rankings(key, rank), ranks from 1: the sum of 1 / (60 + rank)."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [r.select(key, "rank") for r in rankings])
    return every.groupBy(key).agg(F.round(F.sum(1 / (F.lit(FUSION) + F.col("rank"))), 9).alias("score"))
