"""Operator 4: quality rules with risk-controlled cutoffs.

Every rule is a number of a text that is high for junk. For each stratum labelled documents are
split in two by a hash of their text. One half orders the cutoffs: a path of ever wider joint
rejections, the rule with the most junk for the good documents lost first. The other half walks that path from
its start, as long as the exact (Clopper-Pearson) upper bound on the share of good documents that
the cutoffs reject together stays within ``alpha``. Walking in a fixed order needs no correction
along the path, and rules need none among themselves, as their joint rejection is what is bounded. Over strata
the error probability ``delta`` is split evenly, and a stratum whose path is certified to its end
hands its share to the others (Holm's procedure for ordered tests). So with probability 1 - delta no
stratum loses more than ``alpha`` of its good documents. Among the certified steps the one with the
best balance of junk and good documents rejected is taken; ``certificates`` reports the bounds.

Labelled copies of a text count once (as good, if any label says so). Counts per stratum, rule and
grid step, and per stratum and step of the path, are all that is collected.

Edge cases: a null text is empty: no words, so the base rule fails it; a null stratum is a stratum;
a stratum without enough labels for a bound gets no cutoffs, so only the base rule applies;
repeated rows are judged each; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import MAX_BROADCAST_IDS, WS, Scratch, restrict, ship

#: The symbols counted.
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Largest number of strata whose cutoffs are sent to all executors.
MAX_STRATA = 10_000
GRID = 1000


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The five measures of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    repeated = 0
    if n >= 4:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
        pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
        _, at, times = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        window = times[at] > 1
        word = np.zeros(n, bool)
        for k in range(3):
            word[k : k + len(window)] |= window
        repeated = int(word.sum())
    lines = [x for x in text.split("\n") if x.strip(WS)] if "\n" in text else ()
    return n, len(text) - sum(map(text.count, WS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def measured(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` as they are, then the measures and a 64-bit hash of the text. No shuffle."""
    ship(docs.sparkSession)
    keep = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keep = keep.withColumn("h", F.xxhash64("text"))
    kinds = [docs.schema[c].dataType.simpleString() for c in columns]

    def run(batches):
        for b in batches:
            got = np.array([measure(t) for t in b.column("text").to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column(f"k{i}") for i in range(len(columns))] + [b.column("h")] + [pa.array(got[:, i]) for i in range(len(MEASURES))], [f"k{i}" for i in range(len(columns))] + ["h", *MEASURES])

    return keep.mapInArrow(run, ", ".join([f"k{i} {k}" for i, k in enumerate(kinds)] + ["h long"] + [f"{m} long" for m in MEASURES]))


def base_failed():
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def rule_columns() -> dict:
    """Name to a whole number from 0 to GRID, high for junk."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    step = lambda x: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(GRID)).cast("int")
    return {
        "symbols": step(F.col("n_symbols") * 500 / n),
        "dup_lines": step(F.col("n_dup_lines") * 5000 / n),
        "repeats": step(F.col("n_repeat_words") * 1000 / n),
        "long_words": step(F.col("word_chars") * 25 / n),
    }


RULES = ["symbols", "dup_lines", "repeats", "long_words"]


def upper_bound(k: int, n: int, error: float) -> float:
    """The exact upper bound: the share p at which at most k of n would come with probability ``error``."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(logs)] if 0 < p < 1 else [0.0 if p == 0 else -math.inf]
        top = max(terms)
        if top + math.log(sum(math.exp(t - top) for t in terms)) > math.log(error):
            low = p
        else:
            high = p
    return high


def choose(good: np.ndarray, bad: np.ndarray, alpha: float, error: float, price: float) -> int | None:
    """The cutoff (reject at or above) for counts by grid step, or None; price: junk documents a good one is worth."""
    n, best, best_gain = int(good.sum()), None, 0.0
    if n == 0:
        return None
    lost, won, bounds = 0, 0, {}
    for cut in range(GRID, 0, -1):
        lost, won = lost + int(good[cut]), won + int(bad[cut])
        if lost not in bounds:
            bounds[lost] = lost / n <= alpha and upper_bound(lost, n, error) <= alpha
        if not bounds[lost]:
            break
        gain = won - price * lost
        if gain > best_gain:
            best, best_gain = cut, gain
    return best


def path_of(table: np.ndarray, price: float) -> list[tuple[int, int]]:
    """Ever wider joint rejections as ``(rule, cutoff)`` steps, from counts rules x (good, bad) x grid.

    The rule whose next stretch of cutoffs rejects most junk for the good documents lost goes on,
    as long as a stretch is worth its price.
    """
    at, path = [GRID + 1] * len(table), []
    while True:
        best = None
        for r, (good, bad) in enumerate(table):
            lost, won = np.cumsum(good[: at[r]][::-1]), np.cumsum(bad[: at[r]][::-1])  # from the cutoff reached downwards
            gain = (won - price * lost)[:-1]
            if len(gain) and gain.max() > 0:
                i = int(gain.argmax())
                if best is None or won[i] / (lost[i] + 1) > best[0]:
                    best = (won[i] / (lost[i] + 1), r, at[r] - 1 - i)
        if best is None:
            return path
        _, r, end = best
        path += [(r, cut) for cut in range(at[r] - 1, end - 1, -1) if table[r, :, cut].any()]
        at[r] = end


def fit(rows: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05, price: float = 20.0, id_col: str = "doc_id", label_col: str = "quality") -> tuple[list[tuple], list[tuple]]:
    """``(stratum, rule, cutoff)``, and ``(stratum, good documents held out, lost, bound)`` for each stratum,
    from rows ``k0`` (id), ``k1`` (stratum), measures and ``h``, and labels."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k0")).agg(F.max(label_col).alias("good"))
    held = Scratch(rows.sparkSession, "quality").cut(rows.where(~base_failed()).join(marks, "k0").groupBy("k1", "h", *MEASURES).agg(F.max("good").alias("good")), "held")
    first_half = F.col("h").bitwiseAND(F.lit(1)) == 0
    good, bad = F.count_if(F.col("good") > 0).alias("good"), F.count_if(F.col("good") <= 0).alias("bad")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), c.alias("step")) for i, c in enumerate(rule_columns().values())])).alias("s")
    tables: dict = {}
    for k1, rule, at, g, b in held.where(first_half).select("k1", "good", steps).groupBy("k1", "s.rule", "s.step").agg(good, bad).collect():  # strata x rules x grid rows at most
        t = tables.setdefault(k1, np.zeros((len(RULES), 2, GRID + 1), np.int64))
        t[rule, 0, at], t[rule, 1, at] = g, b
    paths = {k1: path_of(t, price)[:GRID] for k1, t in tables.items()}
    if not paths:
        return [], []
    if len(paths) > MAX_STRATA:
        raise ValueError(f"{len(paths)} strata; at most {MAX_STRATA}")
    # The place in the path from which on a step of a rule is rejected.
    places = []
    for k1, path in paths.items():
        own = np.full((len(RULES), GRID + 1), GRID + 1, np.int32)
        for i, (r, cut) in enumerate(path):
            own[r, cut:] = np.minimum(own[r, cut:], i)
        places.append((k1, own.tolist()))
    table = rows.sparkSession.createDataFrame(places, f"s {rows.schema['k1'].dataType.simpleString()}, at array<array<int>>")
    place = F.least(*[F.get(F.get("at", F.lit(r)), c) for r, c in enumerate(rule_columns().values())])
    joined = held.where(~first_half).join(F.broadcast(table) if len(places) <= 200 else table, F.col("k1").eqNullSafe(F.col("s")))
    walks = {k1: np.zeros((2, GRID + 2), np.int64) for k1 in paths}
    for k1, at, g, b in joined.groupBy("k1", place.alias("place")).agg(good, bad).collect():  # strata x grid rows at most
        walks[k1][:, at] = g, b
    error, left = {k1: delta / len(paths) for k1 in paths}, set(paths)
    while True:  # strata certified to the end of their path pass their share on
        done = {k1 for k1 in left if (n := int(walks[k1][0].sum())) and upper_bound(int(walks[k1][0, : len(paths[k1])].sum()), n, error[k1]) <= alpha}
        left -= done
        if not done or not left:
            break
        share = sum(error[k1] for k1 in done) / len(left)
        error |= {k1: error[k1] + share for k1 in left}
    cutoffs, report = [], []
    for k1, path in paths.items():
        walk = np.zeros((2, GRID + 1), np.int64)
        walk[:, GRID - len(path) + 1 :] = walks[k1][:, : len(path)][:, ::-1]  # the path's start at the strictest place
        walk[:, 0] = walks[k1].sum(1) - walk.sum(1)
        at = choose(walk[0], walk[1], alpha, error[k1], price)
        own: dict[int, int] = {}
        for r, cut in path[: GRID - at + 1] if at is not None else []:
            own[r] = min(own.get(r, GRID + 1), cut)
        cutoffs += [(k1, r, cut) for r, cut in sorted(own.items())]
        n, lost = int(walk[0].sum()), int(walk[0, at:].sum()) if at is not None else 0
        report.append((k1, n, lost, upper_bound(lost, n, error[k1]) if n else 1.0))
    return cutoffs, report


def verdict(rows: DataFrame, cutoffs: list[tuple]) -> DataFrame:
    """Adds ``base_failed`` and ``kept``. Cutoffs are a literal map (at most MAX_STRATA strata)."""
    by: dict = {}
    for k1, r, cut in cutoffs:
        by.setdefault(k1, {})[r] = cut
    if len(by) > MAX_STRATA:
        raise ValueError(f"{len(by)} strata; at most {MAX_STRATA}")
    spark = rows.sparkSession
    kind = rows.schema["k1"].dataType.simpleString()
    table = spark.createDataFrame([(k1, [c.get(r, GRID + 1) for r in range(len(RULES))]) for k1, c in by.items()], f"s {kind}, cuts array<int>")
    out = rows.join(F.broadcast(table), F.col("k1").eqNullSafe(F.col("s")), "left")
    over = [F.coalesce(c >= F.col("cuts")[i], F.lit(False)) for i, c in enumerate(rule_columns().values())]
    rejected = over[0]
    for c in over[1:]:
        rejected |= c
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)


def staged(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    return Scratch(docs.sparkSession, "quality").cut(measured(docs, columns, text_col), "measures")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk) -> DataFrame:
    """``id_col``, the measures, ``base_failed`` and ``kept`` for each document.

    One map pass over the texts, whose measures are staged, and a shuffle of the labelled documents' measures.
    """
    rows = staged(docs, [id_col, stratum_col], text_col)
    out = verdict(rows, fit(rows, labels, **risk)[0])
    return out.select(F.col("k0").alias(id_col), *MEASURES, "base_failed", "kept")


def of_labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """Staged measures of the labelled documents, or of all, if there are too many labels to broadcast their ids."""
    ids = labels.select("doc_id").where("doc_id IS NOT NULL")
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return staged(restrict(docs, id_col, ids) if few else docs, [id_col, stratum_col], text_col)


def certificates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk) -> DataFrame:
    """``stratum, n_good, n_lost, bound``: for each stratum with labels the held-out good documents, those that the
    cutoffs reject, and the upper bound on the share of good documents lost."""
    report = fit(of_labelled(docs, labels, id_col, text_col, stratum_col), labels, **risk)[1]
    return docs.sparkSession.createDataFrame(report, f"stratum {docs.schema[stratum_col].dataType.simpleString()}, n_good long, n_lost long, bound double")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **risk) -> DataFrame:
    """The rows of ``docs``, all columns, that pass."""
    ship(docs.sparkSession)
    names = docs.columns
    cutoffs, _ = fit(of_labelled(docs, labels, id_col, text_col, stratum_col), labels, **risk)
    out = verdict(measured(docs, [id_col, stratum_col, *names], text_col), cutoffs).where("kept")
    return out.select(*[F.col(f"k{i + 2}").alias(n) for i, n in enumerate(names)])
