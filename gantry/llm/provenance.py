"""Problem 2: generated, minified or vendored source files.

One pass over each text gives its marks (what its opening and closing comments say, how dense its
lines are, how much of it is literals) and its winnowed fingerprints; a file most of whose
fingerprints recur in several other repositories is a vendored copy whatever it says.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gantry.llm.grammars import clean
from gantry.llm.parsing import language_of
from gantry.operators.skew import lookup
from gantry.session import Scratch

#: Winnowing: tokens in a hashed gram, grams in a window (one fingerprint is kept of each window).
GRAM, WINDOW = 32, 24
#: A copy: at least this many fingerprints, this share of them in this many repositories.
LEAST_PRINTS, COPY_SHARE, COPY_REPOSITORIES = 3, 0.6, 3
#: Minified: mean length of non-blank lines above, or share of white space below.
LONG_LINES, DENSE, LEAST_DENSE_CHARS = 200, 0.08, 80
#: Data: share of the words that are numbers, or of the characters that are in strings, with at least so many literals.
NUMBER_SHARE, STRING_SHARE, LEAST_LITERALS = 0.4, 0.6, 12

#: Folders and names that tools give to generated files and package managers to copies.
_GENERATED_PATH = r"(^|/)(__generated__|generated|generated-sources|generated-src|autogen|gen)/|(^|/)zz_generated[_.]|(_pb2(_grpc)?|_parsetab|_lextab|[._]pb|[._]gen|[._]generated|\.g|\.min|[.-]bundle|\.designer)\.[A-Za-z]+$"
_VENDORED_PATH = r"(^|/)(_?vendor|third[_-]party|thirdparty|extern|externals?|node_modules|bower_components|deps|site-packages)/[^/]+/|(^|/)(lib|libs)/[A-Za-z][\w.]*(-[A-Za-z][\w.]*)*-v?\d+\.\d+[^/]*/"

_MADE = r"(?:made|wrote|written|emitted|rendered|produced|generated|created|built|compiled|printed|output)"
_SAYS_GENERATED = re.compile(
    r"(?i)code generated by\b|@generated\b|<auto-?generated|auto-?generated (?:by|from|file|code)|automatically (?:created|generated|produced|written|built)|machine[- ](?:written|generated|made)"
    r"|\b" + _MADE + r" this (?:file|source|unit|module|code|class|script|on \d)|this (?:file|source|unit|module|code) (?:was|is|has been) (?:auto\w* )?(?:generated|emitted|rendered|produced)\b(?! once)"
    r"|output of `[^`]*`|regenerate instead|generated (?:file|code)[;,:.] *do not|edits (?:are overwritten|will not survive|get lost)|(?:manual|local) changes? will be (?:lost|overwritten)|change the input instead"
    r"|(?:fichier|code) (?:produit|généré)|ne pas modifier|automatisch (?:erzeugt|generiert)|änderungen gehen verloren|(?:archivo|código|fichero) generado|generado autom|no (?:editar|modificar) a mano|gerado automaticamente|não edite"
)
_SAYS_VENDORED = re.compile(
    r"(?im)copied verbatim from|vendored from|^\W*upstream:\s*\S|^\W*[\w.-]+ v?\d[\w.]* -- \w+(?: \w+)?,? .*\bon \d{4}-\d|local changes: none|^\W*this file is part of [\w.-]+ \(v?\d|see its own (?:copying|license)"
    r"|^/\*! *[\w.-]+ v?\d+\.\d|^\W*@package [\w.-]+ *\n(?:\W*@\w+ [^\n]*\n)*?\W*@author the [\w.-]+ (?:maintainers|authors|contributors|team)|^\W*([\w.-]+) v\d+[\d.]*\s*\n\W*\(c\) [\d, -]+ \1 (?:contributors|authors|maintainers)"
)
_HOLDER = re.compile(r"(?i)copyright (?:\(c\)|©)? *[\d, -]+ (?:by )?(?:the )?([\w.-]+) (?:authors|contributors|maintainers|team|developers)\b")
_COMMENT = r"(?:\#[^\n]*|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)"
_HEAD = re.compile(r"\s*(?:(?:" + _COMMENT + r"|'''(?:[^']|'(?!''))*'''|\"\"\"(?:[^\"]|\"(?!\"\"))*\"\"\"|['\"]use strict['\"];?)\s*)*")
_LINES = {"python": re.compile(r"\#[^\n]*"), "": re.compile(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/")}
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_WORD = re.compile(r"\w+")
_NUMBER = re.compile(r"\b(?:0x)?\d[\w.]*\b")

MARKS = "struct<generated boolean, vendored boolean, minified boolean, data boolean, holder string, prints array<bigint>>"


def _foot(text: str) -> str:
    """The comments that close a text."""
    lines = text.rstrip().split("\n")
    kept, inside = [], False
    for line in reversed(lines):
        x = line.strip()
        if x.endswith("*/") and not x.startswith("/*"):
            inside = True
        if not (inside or not x or x.startswith(("#", "//", "/*"))):
            break
        kept.append(line)
        if x.startswith("/*"):
            inside = False
    return "\n".join(reversed(kept))


_POWERS = np.power(np.uint64(0x9E3779B97F4A7C15), np.arange(GRAM - 1, -1, -1, dtype=np.uint64))


def fingerprints(tokens: list[str]) -> np.ndarray:
    """Winnowed hashes of the token grams; a text of fewer tokens than a gram has none."""
    if len(tokens) < GRAM:
        return np.empty(0, dtype=np.int64)
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.get(t) or seen.setdefault(t, zlib.crc32(t.encode("utf-8", "replace")) * 2654435761 + 1) for t in tokens), dtype=np.uint64, count=len(tokens))
    grams = np.zeros(len(ids) - GRAM + 1, dtype=np.uint64)
    for i, p in enumerate(_POWERS):
        grams += ids[i : i + len(grams)] * p
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    if len(grams) <= WINDOW:
        return np.array([grams.min()], dtype=np.uint64).view(np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(grams, WINDOW).min(axis=1)).view(np.int64)


def marks(text: str, lang: str) -> tuple:
    """(generated, vendored, minified, data, copyright holder, fingerprints) of one text."""
    text = clean(text)
    said = _HEAD.match(text)[0] + "\n" + _foot(text)
    said = re.sub(r"(?m)^[ \t]*(?:\#+|//+!?|\*+(?!/))[ \t]?", "", said)
    raw = _HEAD.match(text)[0]
    body = _LINES["python" if lang == "python" else ""].sub(" ", text)
    filled = [x for x in text.split("\n") if x.strip()]
    size = len(text)
    spaces = size - sum(len(x) for x in text.split())
    minified = bool(filled) and (size / len(filled) > LONG_LINES or size >= LEAST_DENSE_CHARS and spaces / size < DENSE)
    strings = _STRING.findall(body)
    plain = _STRING.sub(" ", body)
    words, numbers = len(_WORD.findall(plain)), len(_NUMBER.findall(plain))
    solid = len("".join(body.split()))
    data = numbers >= LEAST_LITERALS and numbers / max(words, 1) > NUMBER_SHARE or len(strings) >= LEAST_LITERALS and sum(len("".join(x.split())) for x in strings) / max(solid, 1) > STRING_SHARE
    data = data or bool(strings) and solid > 2000 and max(map(len, strings)) / solid > STRING_SHARE
    holder = _HOLDER.search(said)
    return (
        bool(_SAYS_GENERATED.search(said)), bool(_SAYS_VENDORED.search(said) or raw.startswith("/*!") and _SAYS_VENDORED.search(raw)), minified, data,
        holder[1].lower() if holder else None, fingerprints(_TOKEN.findall(body)).tolist(),
    )


def path_marks(path: Column) -> tuple[Column, Column]:
    """Whether a path is that of a generated file, and of a vendored copy."""
    return path.rlike(_GENERATED_PATH), path.rlike(_VENDORED_PATH)


def mark_files(files: DataFrame, packages: DataFrame) -> DataFrame:
    """One row per file: repository_id, node_id, lang and the verdicts generated, minified, vendored, data.

    files(repository_id, node_id, ingested_at, text); packages(name): third parties whose copyright
    makes a file a copy. Null and empty texts are judged by their path alone. Repeated rows count
    once, the latest by ingested_at.
    """
    key = ["repository_id", "node_id"]

    def run(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        found = [marks(t or "", n or "") for t, n in zip(texts, langs)]
        return pd.DataFrame(found, columns=["generated", "vendored", "minified", "data", "holder", "prints"])

    one = files.groupBy(*key).agg(F.max_by("text", F.struct("ingested_at", F.xxhash64("text"))).alias("text"))
    one = one.withColumn("lang", language_of(F.col("node_id"))).withColumn("m", F.pandas_udf(run, MARKS)("text", "lang"))
    by_path, copied = path_marks(F.col("node_id"))
    marked = Scratch(files.sparkSession, "marks").write(one.select(*key, "lang", "m.*", by_path.alias("path_generated"), copied.alias("path_vendored"), F.xxhash64(*key).alias("file")))
    prints = marked.select("file", F.xxhash64("repository_id").alias("repo"), F.explode("prints").alias("print"))
    shared = prints.groupBy("print", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("print").agg(F.count(F.lit(1)).alias("repos"))
    shared = shared.filter(F.col("repos") >= COPY_REPOSITORIES).select("print")
    copies = lookup(prints.select("file", "print"), shared, ["print"], "left_semi").groupBy("file").agg(F.count(F.lit(1)).alias("hits"))
    copies = copies.select("file", "hits")
    third = packages.select(F.lower("name").alias("holder")).filter("holder is not null").distinct().withColumn("third", F.lit(True))
    total = F.size("prints")
    recurs = (total >= LEAST_PRINTS) & (F.coalesce("hits", F.lit(0)) >= F.lit(COPY_SHARE) * total)
    joined = marked.join(copies, "file", "left").join(third, "holder", "left")
    return joined.select(
        *key, "lang", (F.col("generated") | F.col("path_generated")).alias("generated"), "minified",
        (F.col("vendored") | F.col("path_vendored") | recurs | F.coalesce("third", F.lit(False))).alias("vendored"), "data",
    )


def provenance_report(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Files and kept (hand-written) files per language and is_test (null where no node says)."""
    tests = nodes.groupBy("repository_id", "node_id").agg(F.bool_or("is_test").alias("is_test"))
    kept = ~(F.col("generated") | F.col("minified") | F.col("vendored") | F.col("data"))
    counts = [F.count_if(c).alias(c) for c in ("generated", "minified", "vendored", "data")]
    return marked.join(tests, ["repository_id", "node_id"], "left").groupBy(F.col("lang").alias("language"), "is_test").agg(F.count(F.lit(1)).alias("files"), *counts, F.count_if(kept).alias("hand_written"))
