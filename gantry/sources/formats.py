"""Readers of coverage reports, blame, manifests and pages, and the paths they name.

Each takes a frame of texts (a key and `text`), so the bytes can come from any source; a text that is
not of the format gives no rows. Reports of any size are split in the JVM, one report a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.operators.skew import lookup


def _attributes(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""\b{name}\s*=\s*["']([^"']*)["']""", 1)


def cobertura(reports: DataFrame, key: str = "report") -> DataFrame:
    """key, file, line, hits of Cobertura XML: <line number hits> within <class filename>; lines of methods and classes count once, with their most hits."""
    classes = reports.select(key, F.explode(F.split("text", r"<class\b")).alias("part")).withColumn("file", _attributes(F.col("part"), "filename")).filter("file <> ''")
    tags = classes.select(key, "file", F.explode(F.regexp_extract_all("part", F.lit(r"<line\b[^>]*>"), F.lit(0))).alias("tag"))
    rows = tags.select(key, "file", _attributes(F.col("tag"), "number").try_cast("int").alias("line"), _attributes(F.col("tag"), "hits").try_cast("long").alias("hits"))
    return rows.filter("line is not null and hits is not null").groupBy(key, "file", "line").agg(F.max("hits").alias("hits"))


def clover(reports: DataFrame, key: str = "report") -> DataFrame:
    """key, file, line, hits of Clover XML: <line num count type="stmt"> within <file path or name>."""
    files = reports.select(key, F.explode(F.split("text", r"<file\b")).alias("part"))
    path = F.coalesce(F.nullif(_attributes(F.col("part"), "path"), F.lit("")), _attributes(F.col("part"), "name"))
    tags = files.filter(F.col("part").contains("<line")).withColumn("file", path).filter("file <> ''").select(key, "file", F.explode(F.regexp_extract_all("part", F.lit(r"<line\b[^>]*>"), F.lit(0))).alias("tag"))
    rows = tags.filter(_attributes(F.col("tag"), "type") != "method").select(key, "file", _attributes(F.col("tag"), "num").try_cast("int").alias("line"), _attributes(F.col("tag"), "count").try_cast("long").alias("hits"))
    return rows.filter("line is not null and hits is not null").groupBy(key, "file", "line").agg(F.max("hits").alias("hits"))


def coverage_json(reports: DataFrame, key: str = "report") -> DataFrame:
    """key, file, line, hits of {"files": {path: {"executed_lines": [...], "missing_lines": [...]}}}."""
    shape = "struct<files: map<string, struct<executed_lines: array<int>, missing_lines: array<int>>>>"
    files = reports.select(key, F.explode(F.from_json("text", shape)["files"]).alias("file", "f"))
    hit = F.transform(F.coalesce("f.executed_lines", F.array().cast("array<int>")), lambda n: F.struct(n.alias("line"), F.lit(1).cast("long").alias("hits")))
    miss = F.transform(F.coalesce("f.missing_lines", F.array().cast("array<int>")), lambda n: F.struct(n.alias("line"), F.lit(0).cast("long").alias("hits")))
    return files.select(key, "file", F.explode(F.concat(hit, miss)).alias("x")).select(key, "file", "x.*").groupBy(key, "file", "line").agg(F.max("hits").alias("hits"))


def coverage_kind(text: str | Column) -> Column:
    """lcov, cobertura, clover, json, or null: what a report begins like."""
    head = F.substring(text, 1, 4096)
    return (
        F.when(head.rlike(r"(?m)^(TN|SF):"), "lcov").when(head.rlike(r"<coverage[^>]*\bclover="), "clover").when(head.rlike(r"<coverage\b[^>]*(line-rate|branch-rate)="), "cobertura")
        .when(head.rlike(r"<coverage\b[^>]*generated="), "clover").when(head.rlike(r"^\s*\{"), "json")
    )


def resolve_paths(reported: DataFrame, known: DataFrame) -> DataFrame:
    """file, node, outcome of reported(file) against known(node): the known path that ends like it, by whole folders.

    The longest common ending decides: matched if one known path has it, ambiguous if several do (node
    is null), unmatched if no known path ends with the file's name. Both sides meet on endings, so no
    pair of paths is compared.
    """
    def endings(c: str) -> Column:
        parts = F.split(F.regexp_replace(c, r"\\", "/"), "/")
        n = F.size(parts)
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, n - i + 1, i), "/").alias("ending")))

    asked = reported.select("file").filter("file is not null and file <> ''").distinct()
    ends = known.select("node").filter("node is not null").distinct().select("node", F.explode(endings("node")).alias("e")).select("node", "e.ending")
    by_ending = ends.groupBy("ending").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    met = lookup(asked.select("file", F.explode(endings("file")).alias("e")).select("file", "e.*"), by_ending, ["ending"], "inner")
    best = met.groupBy("file").agg(F.max_by(F.struct("n", "node"), "depth").alias("b"))
    out = asked.join(best, "file", "left")
    return out.select("file", F.when(F.col("b.n") == 1, F.col("b.node")).alias("node"), F.when(F.col("b").isNull(), "unmatched").when(F.col("b.n") == 1, "matched").otherwise("ambiguous").alias("outcome"))


def blame(texts: DataFrame, key: str = "file") -> DataFrame:
    """key, line, sha, author, ts of `git blame --line-porcelain`: one row a line of the file."""
    blocks = texts.select(key, F.explode(F.split("text", r"(?m)(?=^[0-9a-f]{40} \d+ \d+)")).alias("b"))
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    return blocks.filter(F.col("b").rlike(head)).select(
        key, F.regexp_extract("b", head, 2).cast("int").alias("line"), F.regexp_extract("b", head, 1).alias("sha"),
        F.regexp_extract("b", r"(?m)^author (.*)$", 1).alias("author"), F.timestamp_seconds(F.regexp_extract("b", r"(?m)^author-time (\d+)$", 1).try_cast("long")).alias("ts"),
    )


def blame_ownership(lines: DataFrame, key: str = "file") -> DataFrame:
    """key, owner, lines, share: the author of most of a file's lines, the least name of equal ones."""
    by = lines.groupBy(key, "author").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy(key).agg(F.min_by("author", F.struct(-F.col("n"), F.col("author"))).alias("owner"), F.max("n").alias("lines"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


def function_ages(lines: DataFrame, functions: DataFrame, as_of: Column, key: str = "file") -> DataFrame:
    """key, name, median_age, recent: the median age in days of a function's lines, and its commits of the last 30 days.

    functions(key, name, start, end). A function's lines are exploded, so the join is on (file, line).
    """
    spans = functions.select(key, "name", F.explode(F.sequence("start", "end")).alias("line"))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("ts")) / 86400
    x = spans.join(lines, [key, "line"]).withColumn("age", age)
    return x.groupBy(key, "name").agg(F.expr("percentile(age, 0.5)").alias("median_age"), F.count_distinct(F.when(F.col("age") <= 30, F.col("sha"))).alias("recent"))


def age_volatility(ages: DataFrame) -> DataFrame:
    """Adds severity to functions whose lines are a year old in the middle and that two commits of 30 days changed; the others are left out."""
    old, busy = F.col("median_age") >= 730, F.col("recent") >= 5
    severity = F.when(old & busy, "critical").when(old | busy, "high").otherwise("medium")
    return ages.filter("median_age >= 365 and recent >= 2").withColumn("severity", severity)


#: Where each manifest keeps its packages; (name of the file, ecosystem, pattern of a name and a version).
_MANIFESTS = [
    ("requirements.txt", "pypi", r"(?m)^\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*((?:[=<>!~]=?[^;#\s]+)?)\s*(?:[;#].*)?$"),
    ("go.mod", "go", r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/[\w./-]+)\s+(v[\w.+-]+)"),
    ("Cargo.toml", "cargo", r"""(?m)^\s*([A-Za-z0-9_-]+)\s*=\s*(?:"|\{[^}\n]*version\s*=\s*")([\^~=<>*\d][^"]*)\""""),
    ("pom.xml", "maven", r"(?s)<dependency>.*?<artifactId>\s*([^<\s]+)\s*</artifactId>(?:\s*<version>\s*([^<\s]+)\s*</version>)?"),
    ("packages.config", "nuget", r"""<package\s+id="([^"]+)"\s+version="([^"]+)\""""),
    ("MODULE.bazel", "bazel", r"""bazel_dep\(\s*name\s*=\s*"([^"]+)"\s*,\s*version\s*=\s*"([^"]*)\""""),
]


def manifests(files: DataFrame) -> DataFrame:
    """path, ecosystem, name, version, is_dev of files(path, text): packages that a manifest declares; null where no version is.

    package.json is read as JSON (devDependencies are dev), the others by their patterns. A broken
    manifest gives what can be read of it.
    """
    base = F.substring_index("path", "/", -1)
    shape = "struct<dependencies: map<string,string>, devDependencies: map<string,string>, peerDependencies: map<string,string>>"
    j = F.from_json("text", shape)
    entries = lambda c, dev: F.transform(F.coalesce(F.map_entries(j[c]), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(dev).alias("is_dev")))
    npm = files.filter(base == "package.json").select("path", F.lit("npm").alias("ecosystem"), F.explode(F.concat(entries("dependencies", False), entries("peerDependencies", False), entries("devDependencies", True))).alias("p")).select("path", "ecosystem", "p.*")
    out = npm
    for name, ecosystem, pattern in _MANIFESTS:
        pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("version"))
        part = files.filter(base == name).select("path", F.lit(ecosystem).alias("ecosystem"), F.explode(pairs).alias("p"))
        out = out.unionByName(part.select("path", "ecosystem", "p.name", F.nullif(F.trim("p.version"), F.lit("")).alias("version"), F.lit(False).alias("is_dev")))
    return out.distinct()


def html_links(pages: DataFrame, key: str = "path") -> DataFrame:
    """key, tag, target: scripts and stylesheets that a page loads, without those of other hosts or data URLs."""
    patterns = {"script": r"""(?is)<script\b[^>]*?\bsrc\s*=\s*["']([^"']+)["']""", "link": r"""(?is)<link\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""}
    read = lambda tag, p: F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), lambda t: F.struct(F.lit(tag).alias("tag"), F.split(t, r"[?#]")[0].alias("target")))
    found = F.flatten(F.array(*[read(tag, p) for tag, p in patterns.items()]))
    x = pages.select(key, F.explode(found).alias("x")).select(key, "x.*")
    return x.filter(~F.col("target").rlike(r"^(?:[a-z]+:)?//|^(?:data|mailto|javascript):") & (F.col("target") != "")).distinct()


def endpoints(files: DataFrame) -> DataFrame:
    """path, role, method, route: HTTP routes that a file serves (decorators and router calls) or calls; parameters of a route become {}."""
    serve = r"""(?:@\w+|\b(?:app|router|server))\.(get|post|put|patch|delete)\(\s*["'`](/[^"'`]*)["'`]"""
    call = r"""\b(?:requests|httpx|axios|client|http)\.(get|post|put|patch|delete)\(\s*f?["'`](?:https?://[^/"'`]+)?(/[^"'`?]*)"""
    parts = []
    for role, pattern in (("provider", serve), ("consumer", call)):
        pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("method"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("route"))
        parts.append(files.select("path", F.lit(role).alias("role"), F.explode(pairs).alias("p")).select("path", "role", F.upper("p.method").alias("method"), F.regexp_replace("p.route", r"\$?\{[^}]*\}|:\w+|<[^>]*>", "{}").alias("route")))
    return parts[0].unionByName(parts[1]).withColumn("route", F.regexp_replace("route", r"(?<=.)/$", "")).distinct()


def contract_links(found: DataFrame) -> DataFrame:
    """consumer, provider, method, route, match of found(scope, role, method, route): calls and the routes of other scopes that serve them.

    match is exact, or none where no other scope serves the route (provider is then null).
    """
    serve = found.filter("role = 'provider'").select(F.col("scope").alias("provider"), "method", "route").distinct()
    call = found.filter("role = 'consumer'").select(F.col("scope").alias("consumer"), "method", "route").distinct()
    met = call.join(serve, ["method", "route"]).filter("consumer <> provider")
    lost = call.join(met.select("consumer", "method", "route").distinct(), ["consumer", "method", "route"], "left_anti")
    cols = ["consumer", "provider", "method", "route"]
    return met.select(*cols, F.lit("exact").alias("match")).unionByName(lost.withColumn("provider", F.lit(None).cast("string")).select(*cols, F.lit("none").alias("match")))
