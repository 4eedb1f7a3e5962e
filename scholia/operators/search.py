"""Full-text search: postings and BM25, with AND, OR, NOT, prefixes and column filters.

A term is a run of letters and digits, lower-cased. Queries: words are all required; ``OR`` joins
alternatives; ``NOT word`` or ``-`` excluded by NOT only; ``word*`` is a prefix; ``field:word``
searches one field; a bare hyphen inside a word is a syntax error. Only postings of the query's
terms are read past the tokeniser; scores are sums of partial aggregates.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def postings(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``doc, field, term, tf, length``: one row for each document, field and term."""
    parts = [docs.select(F.col(id_col).alias("doc"), F.lit(f).alias("field"), terms(F.col(f)).alias("t")) for f in fields]
    rows = reduce(DataFrame.unionByName, parts).withColumn("length", F.size("t"))
    return rows.select("doc", "field", "length", F.explode("t").alias("term")).groupBy("doc", "field", "term", "length").agg(F.count("*").alias("tf"))


def parse_query(query: str) -> list[list[tuple[str | None, str, bool, bool]]]:
    """Alternatives of (field, term, prefix, negated) conditions."""
    out: list[list] = [[]]
    negate = False
    for raw in query.split():
        if raw == "OR":
            out.append([])
        elif raw == "NOT":
            negate = True
        elif raw != "AND":
            m = re.fullmatch(r"(?:(\w+):)?(\w+)(\*?)", raw)
            if not m:
                raise ValueError(f"syntax error near {raw!r}")
            out[-1].append((m[1], m[2].lower(), bool(m[3]), negate))
            negate = False
    if negate or not all(any(not c[3] for c in alt) for alt in out):
        raise ValueError("each alternative needs a word that is not excluded")
    return out


def search(docs: DataFrame, query: str, id_col: str, fields: list[str], limit: int | None = 10, where: Column | None = None) -> DataFrame:
    """TXT1/TXT2: ``id_col, score``, best first, ties to the smaller id."""
    docs = docs if where is None else docs.where(where)
    alternatives = parse_query(query)
    conditions = list(dict.fromkeys(c for alt in alternatives for c in alt))

    def hit(c) -> Column:
        word = F.col("term").startswith(c[1]) if c[2] else F.col("term") == c[1]
        return word & (F.col("field") == c[0]) if c[0] else word

    any_hit = reduce(lambda a, b: a | b, map(hit, conditions))
    sizes = reduce(lambda a, b: a + b, [F.size(terms(F.col(f))) for f in fields])
    stats = docs.select(sizes.alias("n")).agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    lengths = docs.select(F.col(id_col).alias("doc"), sizes.alias("dl"))
    hits = postings(docs, id_col, fields).where(any_hit).groupBy("doc").agg(
        *[F.sum(F.when(hit(c), F.col("tf")).otherwise(0)).alias(f"c{i}") for i, c in enumerate(conditions)])
    ok = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [(F.col(f"c{conditions.index(c)}") > 0) != F.lit(c[3]) for c in alt]) for alt in alternatives])
    wanted = [i for i, c in enumerate(conditions) if not c[3]]
    df = hits.agg(*[F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in wanted])
    rows = hits.where(ok).join(lengths, "doc").crossJoin(F.broadcast(df)).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in wanted:
        tf, d = F.col(f"c{i}"), F.col(f"d{i}")
        idf = F.ln(1 + (F.col("docs") - d + 0.5) / (d + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("mean")))).otherwise(0.0)
    out = rows.select(F.col("doc").alias(id_col), score.alias("score")).orderBy(F.desc("score"), id_col)
    return out if limit is None else out.limit(limit)


def embedding_text(cards: DataFrame) -> DataFrame:
    """TXT4: the labelled lines that are embedded, the content cut at 1500 characters."""
    line = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: "), c))
    return cards.select("card_id", F.concat_ws("\n", line("Title", F.col("title")), line("Core", F.col("core_concept")), line("Tags", F.array_join("tags", ", ")), line("Content", F.substring("content", 1, 1500))).alias("embedding_text"))


def embedding_estimate(texts: DataFrame, column: str, seconds_each: float = 8.6) -> DataFrame:
    """TXT5: tokens (1.3 a character) and seconds that embedding would take."""
    return texts.agg(F.count("*").alias("texts"), (F.sum(F.length(column)) * 1.3).alias("tokens"), (F.count("*") * seconds_each).alias("seconds"))
