"""Column predicates and classifiers over commits, paths and measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What makes a commit subject a fix, and what rules it out.
FIX = [r"\bfix\b", r"\bbug\b", r"\bpatch\b", r"\bresolves?\b", r"closes?\s+#\d+", r"fixes?\s+#\d+"]
NO_FIX = [r"^Merge ", r"\btypo\b", r"\bbump\b", r"\bdeps?\b", r"\bchore\b", r"\blint\b", r"\bformat\b", r"\bstyle\b", r"\bdocs?\b"]
#: Keywords of the four categories that file histories count; the first that matches names a commit.
CATEGORIES = {
    "feature": r"\b(add|implement|introduce|create|new|feat)\b",
    "refactor": r"\b(refactor|restructure|cleanup|clean.up|rename|reorganize|extract|simplify|move)\b",
    "fix": r"\b(fix|bug|patch|hotfix|revert|regression|broken|crash|error)\b",
    "dependency": r"\b(upgrade|bump|update.dep|migrate.to|switch.to|dependency|dependencies)\b",
}
#: Conventional prefixes, and the keywords that are tried in this order without one.
PREFIXES = {
    "feat": "feature", "feature": "feature", "fix": "fix", "bugfix": "fix", "hotfix": "fix", "perf": "refactor", "refactor": "refactor", "style": "refactor", "docs": "docs", "doc": "docs",
    "test": "test", "tests": "test", "build": "deps", "deps": "deps", "ci": "chore", "chore": "chore", "revert": "fix",
}
KEYWORDS = [
    ("docs", r"\b(docs?|documentation|readme|changelog|comment)\b"), ("test", r"\b(test|tests|testing|spec|coverage|fixture)\b"),
    ("deps", r"\b(bump|upgrade|downgrade|depend|dependency|dependencies|lockfile|requirements|vendor|pin)\b"), ("fix", r"\b(fix|fixes|fixed|bug|patch|hotfix|regression|crash|revert)\b"),
    ("refactor", r"\b(refactor|restructure|cleanup|clean.up|rename|reorganize|extract|simplify|move|tidy|dedupe|perf|optimi[sz]e)\b"), ("feature", r"\b(add|adds|added|implement|introduce|create|new|feat|feature|support|enable)\b"),
    ("chore", r"\b(chore|lint|format|style|ci|build|release|merge|config|tooling)\b"),
]
#: Prefixes that are skipped, words that rescue a skipped commit, bots, least length.
SKIPPED = ["Bump ", "chore:", "ci:", "style:", "build:", "release:"]
DECISIONS = ["migrate", "migration", "switch to", "replace", "refactor", "adopt", "introduce", "deprecate", "remove", "upgrade", "rewrite", "extract", "convert", "transition"]
BOTS, LEAST_MESSAGE = ["dependabot", "renovate", "github-actions"], 12
#: The highest rank of a decision's source.
CONFIDENCE_BASE, CONFIDENCE_SPAN, MOST_BONUS, BONUS, FUZZY, UNVERIFIED = 0.4, 0.5, 0.12, 0.04, 0.85, 0.6


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def is_fix(subject: Column) -> Column:
    """Whether a commit subject is a bug fix; a null subject isn't."""
    return F.coalesce(_any(subject, FIX) & ~_any(subject, NO_FIX), F.lit(False))


def commit_category(subject: Column) -> Column:
    """feature, refactor, fix or dependency, by the first pattern that matches; null if none does."""
    return F.coalesce(*[F.when(subject.rlike("(?i)" + p), name) for name, p in CATEGORIES.items()])


def evolution_category(subject: Column) -> Column:
    """One category per commit: that of a conventional prefix, else of the first keyword pattern, else other."""
    prefix = F.lower(F.regexp_extract(subject, r"(?i)^\s*([a-z]+)(?:\([^)]*\))?!?:", 1))
    named = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])[prefix]
    return F.coalesce(named, *[F.when(subject.rlike("(?i)" + p), name) for name, p in KEYWORDS], F.lit("other"))


def is_significant(message: Column, author: Column) -> Column:
    """Whether a commit carries intent: long enough, no merge, no bot, and no routine prefix unless it names a decision."""
    text = F.trim(message)
    routine = reduce(lambda a, b: a | b, [text.startswith(p) for p in SKIPPED])
    decides = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w)) for w in DECISIONS])
    bot = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(author, F.lit(""))), F.lit(b)) for b in BOTS])
    return F.coalesce((F.length(text) >= LEAST_MESSAGE) & ~text.startswith("Merge ") & ~bot & (~routine | decides), F.lit(False))


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(tests?|__tests__|specs?|testing)/|(^|/)test_[^/]*$|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$|Tests?\.java$")


def risk_velocity(c30: Column, c90: Column) -> Column:
    """increasing, decreasing or stable: the rate of 30 days against that of the 60 before."""
    before = c90 - c30
    ratio = (c30 / 30.0) / (before / 60.0)
    return F.when(c90 == 0, "stable").when(before == 0, F.when(c30 > 0, "increasing").otherwise("stable")).when(ratio > 1.5, "increasing").when(ratio < 0.5, "decreasing").otherwise("stable")


def risk_type(magnet: Column, defects: Column, churn_pct: Column, bus_factor: Column, commits: Column, dependents: Column, small_team: Column, hot: Column, bug_prone: int = 3) -> Column:
    """bug-prone, churn-heavy, bus-factor-risk, high-coupling or stable; the first that holds."""
    lonely = (bus_factor == 1) & (commits > 20) & (~F.coalesce(small_team, F.lit(False)) | F.coalesce(hot, F.lit(False)))
    return F.when(F.coalesce(magnet, F.lit(False)) | (defects >= bug_prone), "bug-prone").when(churn_pct >= 0.7, "churn-heavy").when(lonely, "bus-factor-risk").when(dependents >= 5, "high-coupling").otherwise("stable")


def stem(word: Column) -> Column:
    """A word without its plural ending; -ies and -ss stay."""
    n = F.length(word)
    return F.when(word.rlike("(ies|ss)$"), word).when((n > 4) & word.rlike("(ches|shes|sses|xes|zes|ses)$"), F.substring(word, F.lit(1), n - 2)).when((n > 3) & word.endswith("s"), F.substring(word, F.lit(1), n - 1)).otherwise(word)


def decision_confidence(rank: Column, most_rank: int, sources: Column, verification: Column) -> Column:
    """Confidence of a decision from its best source's rank, the number of sources and how its quote was verified."""
    bonus = F.least(F.lit(MOST_BONUS), BONUS * F.greatest(F.lit(0), sources - 1))
    decay = F.when(verification == "fuzzy", FUZZY).when(verification == "unverified", UNVERIFIED).otherwise(1.0)
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.0), (CONFIDENCE_BASE + CONFIDENCE_SPAN * rank / most_rank + bonus) * decay)), 3)


def significant_digits(x: Column, digits: int) -> Column:
    """A number rounded to so many significant digits; 0, null and NaN stay."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | x.isNull() | F.isnan(x), x).otherwise(F.round(x * scale) / scale)


def content_ref(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def is_minified(text: Column) -> Column:
    """Mean line above 200 characters, or one above 2,000."""
    lines = F.split(text, "\n")
    longest = F.array_max(F.transform(lines, F.length))
    return F.coalesce((F.length(text) / F.size(lines) > 200) | (longest > 2000), F.lit(False))
