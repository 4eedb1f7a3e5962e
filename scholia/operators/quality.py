"""Rule-based quality of paper metadata: five field scores, issues, an overall score and a level.

Everything is built-in expressions; a paper is scored in one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns (matched without regard to case), bounds, weights and levels.
TITLE_INVALID = ["^Journal Pre-proof$", "^Untitled$", "^https?://", r"^\s*$", "^N/A$|^Unknown$|^Placeholder$"]
TITLE_SUSPICIOUS = [(r"^\.pdf$", "warning"), (r"\b(draft|version|v\d+|final|revised)\b", "info"), ("^.{1,10}$", "warning"), ("^.{300,}$", "warning")]
AUTHOR_INVALID = ["^Unknown$|^N/A$|^Anonymous$", r"^\s*$", r"^Author \d+$"]
ABSTRACT_PLACEHOLDERS = ["^N/A$", "^尚未提供摘要$", "^Abstract not available$", "^No abstract$"]
WEIGHTS = {"title": 0.25, "authors": 0.20, "year": 0.15, "abstract": 0.25, "keywords": 0.15}
LEVELS = [(90, "excellent"), (75, "good"), (60, "acceptable"), (40, "poor")]


class Rules:
    """Collects deductions of one field: a condition, points, and the issue it raises."""

    def __init__(self, field: str):
        self.field, self.rules = field, []

    def add(self, when: Column, points: int | Column, severity: str, kind: str) -> None:
        self.rules.append((F.coalesce(when, F.lit(False)), points, severity, kind))

    def score(self, zero: Column | None = None) -> Column:
        total = F.lit(100.0)
        for when, points, _, _ in self.rules:
            total = total - F.when(when, F.lit(points) if isinstance(points, int) else points).otherwise(0)
        total = F.greatest(total, F.lit(0.0))
        return total if zero is None else F.when(zero, 0.0).otherwise(total)

    def issues(self, zero: Column | None = None, missing: Column | None = None) -> Column:
        ok = F.lit(True) if zero is None else ~zero
        made = [F.when(when & ok, F.struct(F.lit(self.field).alias("field"), F.lit(sev).alias("severity"), F.lit(kind).alias("issue_type"))) for when, _, sev, kind in self.rules]
        if missing is not None:
            made.insert(0, F.when(zero, F.struct(F.lit(self.field).alias("field"), F.lit("critical").alias("severity"), missing.alias("issue_type"))))
        return F.filter(F.array(*made), lambda x: x.isNotNull())


def _like(c: Column, pattern: str) -> Column:
    """Search without regard to case; ``$`` also matches before a last newline, in Java as in Python."""
    return c.rlike("(?i)" + pattern)


def _matches(pattern: str):
    return lambda x: _like(x, pattern)


def assess(papers: DataFrame, current_year: int) -> DataFrame:
    """QLT1-QLT7: ``id``, a score of each field, ``overall``, ``level`` and ``issues`` for papers
    ``id, title, authors, year, abstract, keywords``. No paper is left out."""
    title, abstract = F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))
    authors, keywords, year = F.coalesce("authors", F.array().cast("array<string>")), F.coalesce("keywords", F.array().cast("array<string>")), F.col("year")
    t = Rules("title")
    for p in TITLE_INVALID:
        t.add(_like(title, p), 25, "critical", "invalid_pattern")
    for p, severity in TITLE_SUSPICIOUS:
        t.add(_like(title, p), 5 if severity == "warning" else 2, severity, "suspicious")
    n = F.length(title)
    t.add(n < 10, 10, "critical", "too_short")
    t.add((n >= 10) & (n < 20), 3, "info", "suboptimal_length")
    t.add(n > 300, 5, "warning", "too_long")
    a, none = Rules("authors"), F.size(authors) == 0
    hits = F.lit(0)
    for p in AUTHOR_INVALID:
        hits = hits + F.size(F.filter(authors, _matches(p)))
    a.add(hits > 0, 15 * hits, "critical", "invalid_pattern")
    a.add(F.size(authors) > 50, 5, "warning", "suspicious_count")
    y, no_year = Rules("year"), year.isNull()
    y.add((year < 1900) | (year > 2030), 20, "critical", "out_of_range")
    y.add(year < 1950, 2, "info", "suspicious")
    y.add(year > current_year + 2, 5, "warning", "suspicious")
    b = Rules("abstract")
    empty, placeholder = ~abstract.rlike(r"\S"), F.lit(False)
    for p in ABSTRACT_PLACEHOLDERS:
        placeholder = placeholder | _like(abstract, p)
    m = F.length(abstract)
    b.add(m < 50, 25, "critical", "too_short")
    b.add((m >= 50) & (m < 100), 5, "info", "suboptimal_length")
    b.add(m > 5000, 5, "warning", "too_long")
    b.add(F.size(F.filter(F.split(abstract, r"\s+"), lambda x: x != "")) < 20, 10, "warning", "insufficient_content")
    k, c = Rules("keywords"), F.size(keywords)
    k.add(c < 1, 15, "warning", "insufficient_count")
    k.add((c >= 1) & (c < 3), 5, "info", "suboptimal_count")
    k.add(c > 20, 10, "warning", "excessive_count")
    k.add(F.size(F.array_distinct(keywords)) != c, 10, "warning", "duplicates")
    k.add(F.exists(keywords, lambda x: ~x.rlike(r"\S")), 5, "warning", "empty_keyword")
    scores = {"title": t.score(), "authors": a.score(none), "year": y.score(no_year), "abstract": b.score(empty | placeholder), "keywords": k.score()}
    issues = F.concat(
        t.issues(), a.issues(none, F.lit("missing")), y.issues(no_year, F.lit("missing")),
        b.issues(empty | placeholder, F.when(empty, "missing").otherwise("placeholder")), k.issues())
    out = papers.select("id", *[v.alias(f"{name}_score") for name, v in scores.items()], issues.alias("issues"))
    overall = sum((F.col(f"{name}_score") * w for name, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("overall", overall)
    level = F.lit("critical")
    for least, name in reversed(LEVELS):
        level = F.when(F.col("overall") >= least, name).otherwise(level)
    return out.withColumn("level", level)


def summary(assessed: DataFrame) -> DataFrame:
    """AGG12: papers, mean score and share of each level."""
    total = assessed.agg(F.count("*").alias("total"))
    by = assessed.groupBy("level").agg(F.count("*").alias("papers"), F.avg("overall").alias("mean_score"))
    return by.crossJoin(F.broadcast(total)).select("level", "papers", "mean_score", (F.col("papers") * 100.0 / F.col("total")).alias("percent"))


def top_issues(assessed: DataFrame, k: int = 10) -> DataFrame:
    """AGG12/FLT9: the most frequent kinds of issue."""
    i = assessed.select(F.explode("issues").alias("i")).select("i.*")
    return i.groupBy(F.concat_ws("_", "field", "issue_type").alias("issue"), "severity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue", "severity").limit(k)


def with_severity(assessed: DataFrame, severity: str) -> DataFrame:
    """FLT9: the number of issues of a severity for each paper that has some."""
    return assessed.select("id", F.size(F.filter("issues", lambda x: x["severity"] == severity)).alias("n")).where("n > 0")
