"""Readers of text formats: coverage reports, diffs, commit logs, transcripts, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def walk(spark: SparkSession, root: str, glob: str = "*", prune: str = r"/(\.git|node_modules|__pycache__)/") -> DataFrame:
    """path, length, modificationTime, content of the files below a folder, without pruned folders."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).filter(~F.col("path").rlike(prune))


def lcov(lines: DataFrame) -> DataFrame:
    """file, line, hits of lines(report, pos, value): DA records belong to the SF record above them."""
    w = Window.partitionBy("report").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("file", F.last(F.when(F.col("value").startswith("SF:"), F.substring("value", 4, 10**6)), ignorenulls=True).over(w))
    da = F.regexp_extract("value", r"^DA:(\d+),(\d+)", 1), F.regexp_extract("value", r"^DA:(\d+),(\d+)", 2)
    return x.filter(F.col("value").rlike(r"^DA:\d+,\d+") & F.col("file").isNotNull()).groupBy("file", da[0].cast("int").alias("line")).agg(F.sum(da[1].cast("long")).alias("hits"))


def unified_diff(lines: DataFrame) -> DataFrame:
    """file, line: new lines that a diff adds, of lines(diff, pos, value)."""
    w = Window.partitionBy("diff").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("value").rlike(r"^@@ "), F.regexp_extract("value", r"\+(\d+)", 1).cast("int"))
    x = lines.withColumn("file", F.last(F.when(F.col("value").startswith("+++ b/"), F.substring("value", 7, 10**6)), ignorenulls=True).over(w))
    x = x.withColumn("start", F.last(start, ignorenulls=True).over(w)).withColumn("hunk", F.sum(F.when(start.isNotNull(), 1).otherwise(0)).over(w)).filter("hunk > 0")
    body = x.filter(~F.col("value").rlike(r"^(@@ |diff |index |--- |\+\+\+ |\\)") & ~F.col("value").startswith("-"))
    n = F.row_number().over(Window.partitionBy("diff", "hunk").orderBy("pos"))
    return body.withColumn("line", F.col("start") + n - 1).filter(F.col("value").startswith("+")).select("diff", "file", "line")


def commit_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(commits, file_changes) of `git log --numstat --format=%x00%H%x01%an%x01%ae%x01%ct%x01%s`.

    Renames written as a/{b => c}/d count for the new path; binary files have 0 lines.
    """
    raw = spark.read.option("lineSep", "\x00").text(path).filter(F.length(F.trim("value")) > 0)
    head = F.split(F.split("value", "\n")[0], "\x01")
    commits = raw.select(head[0].alias("sha"), head[1].alias("author_name"), head[2].alias("author_email"), F.timestamp_seconds(head[3].cast("long")).alias("ts"), head[4].alias("subject"))
    body = raw.select(head[0].alias("sha"), F.explode(F.slice(F.split("value", "\n"), 2, 2**30)).alias("row")).filter(F.col("row").rlike(r"^(\d+|-)\t(\d+|-)\t"))
    parts = F.split("row", "\t")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(parts[2], r"\{[^{}]* => ([^{}]*)\}", "$1"), r"^.* => ", ""), "//", "/")
    number = lambda c: F.coalesce(F.when(c == "-", 0).otherwise(c.try_cast("int")), F.lit(0))
    return commits, body.select("sha", name.alias("path"), number(parts[0]).alias("added"), number(parts[1]).alias("deleted"))


#: How the five languages name what they import; the endings that JavaScript and TypeScript have besides.
_MODULE = r"""(?m)^\s*(?:(?:import|export)\b[^'"`;=()]*?\bfrom\s*|import\s*)['"]([^'"]+)['"]|\b(?:require|import)\(\s*['"]([^'"]+)['"]\s*\)"""
_GO = r"""(?m)^\s*(?:import\s*\(?\s*)?(?!return\b)(?:[\w.]+\s+)?["`]([\w./~-]+)["`]\s*;?\s*\)?\s*(?://.*)?$()"""
IMPORTS = {"py": r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)()", "go": _GO} | dict.fromkeys(["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"], _MODULE)


def imports(files: DataFrame) -> DataFrame:
    """repository_id, node_id, module: names that a file's text imports, by its extension."""
    ext = F.regexp_extract("node_id", r"\.(\w+)$", 1)
    first = F.lit(None).cast("array<string>")
    for name, pattern in IMPORTS.items():
        found = F.filter(F.concat(F.regexp_extract_all("text", F.lit(pattern), 1), F.regexp_extract_all("text", F.lit(pattern), 2)), lambda x: F.length(x) > 0)
        first = F.when(ext == name, found).otherwise(first)
    return files.select("repository_id", "node_id", F.explode(F.array_distinct(first)).alias("module"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """session, role, tool, tool_use_id, ts of JSON-lines transcripts; malformed lines are dropped."""
    schema = "session string, ts timestamp, role string, tool string, tool_use_id string, payload string, _corrupt_record string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).filter("_corrupt_record is null").drop("_corrupt_record")
