"""Problem 4: source files that do not parse, by packrat grammars per language."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.llm.grammars import EXTENSIONS, language


def language_of(path: Column) -> Column:
    """The language of a path's extension; null where it is none of the five."""
    names = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return names[F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))]


def verdict(text: str, name: str, where: bool = True) -> tuple[bool, int | None, str | None]:
    """Whether a text fails to parse, and where and why. Nesting beyond the parser's stack counts as a failure."""
    lang = language(name)
    try:
        if lang.check(text):
            return False, None, None
        if not where:
            return True, None, None
        line, cause = lang.failure(text)
        return True, line, cause
    except RecursionError:
        return True, None, "nesting"


def parse_files(files: DataFrame) -> DataFrame:
    """Adds has_error, error_line and error_cause to files(repository_id, node_id, text).

    error_line is that of the furthest token which any rule could reach; error_cause is
    merge_conflict, truncated (the end of the text was reached), token (no token of the language),
    syntax, or nesting. Files of other languages and null texts are left out; empty files are valid.
    Repeated rows count once per (repository_id, node_id), the latest by ingested_at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [verdict(t, n) for t, n in zip(batch["text"], batch["lang"])]
            yield pd.DataFrame({
                "repository_id": batch["repository_id"], "node_id": batch["node_id"], "lang": batch["lang"], "ingested_at": batch["ingested_at"],
                "has_error": [f[0] for f in found], "error_line": pd.array([f[1] for f in found], dtype="Int32"), "error_cause": [f[2] for f in found],
            })

    ready = files.select("repository_id", "node_id", "ingested_at", language_of(F.col("node_id")).alias("lang"), "text").filter("lang is not null and text is not null")
    schema = "repository_id string, node_id string, lang string, ingested_at timestamp, has_error boolean, error_line int, error_cause string"
    parsed = ready.mapInPandas(run, schema)
    latest = F.max_by(F.struct("lang", "has_error", "error_line", "error_cause"), F.struct("ingested_at", F.xxhash64("has_error", "error_line"))).alias("x")
    return parsed.groupBy("repository_id", "node_id").agg(latest).select("repository_id", "node_id", "x.*")


def parse_rates(parsed: DataFrame) -> DataFrame:
    """Files, failures and failure causes per repository and language, with subtotals (null: all)."""
    causes = [F.count_if(F.col("error_cause") == c).alias(c) for c in ("merge_conflict", "truncated", "token", "syntax", "nesting")]
    total = parsed.groupBy("repository_id", "lang").agg(F.count(F.lit(1)).alias("files"), F.count_if("has_error").alias("failing"), *causes)
    sums = [F.sum(c).alias(c) for c in total.columns[2:]]
    rolled = total.cube("repository_id", "lang").agg(*sums)
    return rolled.withColumnRenamed("lang", "language").withColumn("rate", F.round(F.col("failing") / F.col("files"), 6))
