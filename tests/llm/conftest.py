"""Small tables with nulls, empty and repeated texts, ties, copies and clashing column names."""

from __future__ import annotations

import random

import pytest


def sentence(rng, n):
    return " ".join(rng.choice(["ana", "berto", "cil", "dor", "eme", "fug", "gani", "hul", "ipse", "jota"]) + rng.choice(["", "s", "x", "é"]) for _ in range(n))


def make_documents(seed=5, n=60):
    """(doc_id, text, lang, source) rows."""
    rng = random.Random(seed)
    shared = [sentence(rng, 14) for _ in range(4)]
    rows = []
    for i in range(n):
        lines = [sentence(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 6))]
        for s in shared:
            if rng.random() < 0.3:
                lines.insert(rng.randrange(len(lines) + 1), s.upper() + "  " if rng.random() < 0.3 else s)
        rows.append([i * 3 + 1, "\n".join(lines), rng.choice(["en", "fr"]), rng.choice(["a", "b", "ü", None])])
    for i in range(0, 12, 2):  # exact and near copies
        rows[i + 1][1] = rows[i][1]
        words = rows[i][1].split(" ")
        words[len(words) // 2] = "changed"
        rows[i + 20][1] = " ".join(words)
    rows += [[500, None, None, None], [501, "", "en", "a"], [502, "   \n\t", "en", "a"], [503, "one two", "en", "b"], [504, "One  TWO", "en", "b"], [505, "x" * 30_000, "fr", "a"], [506, "word " * 4000, "fr", "b"]]
    rng.shuffle(rows)
    return [tuple(r) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("id", "node", "n", "k", "size", "shard", "keys", "spans", "kept", "source_size", "h", "token", "own", "k0"):
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
