"""Operator 3: personal data by candidate spans, boosted trees and calibrated thresholds.

Generators propose overlapping spans of high recall: the four base patterns, numbers that fail the
base checks, card numbers and telephone numbers with other separators or without a country code,
addresses that spell out "at" and "dot", IPv6 addresses, and long runs of letters and digits as
keys and passwords have them (kind ``secret``). Two views of a span are kept apart. Weak labels
come from the base checks and from the word on its left that announces such data. The features are
its format (digits, letters, groups, separators, checksum), the signs on both sides, the word on its
right, and the base spans in its neighbourhood. So the trees learn what announced data look like,
and find the same where no word announces it. Spans that are not base ones are added if their score
reaches their generator's threshold, the lowest of all scores at which the held-out half of all
candidates is right often enough (an exact lower bound), and if no base span holds them. A
generator without enough proof adds nothing: with no error it takes 29 held-out candidates.

Only built-in functions run on the executors. Positions come from the gaps that a pattern leaves:
``split`` and ``regexp_extract_all`` see the same matches, and a match starts after the gaps and
matches before it. Patterns are written so that Java neither recurses nor backtracks over long
runs; each finds what the plain pattern finds. No shuffle but for the bounded sample of candidates
(``SAMPLE``, the smallest by hash of the other half) on which the trees are fitted, and counts by
generator and score, of which the trees allow a fixed number.

Edge cases: a null or empty text has no spans; texts of any length are read whole (time grows with
the square of the number of spans of one text only); repeated rows are searched each; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm import boosting
from scholia.llm.common import Scratch

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = 4
#: Bound of the sample of candidates held by the driver.
SAMPLE, PRECISION, ERROR = 20_000, 0.9, 0.05

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![0-9])(?![\x20-][0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELT = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++"
LOCAL = r"(?<![0-9+.(-])(?<!\+[0-9]\x20)(?<!\+[0-9][0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
GROUPED = r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,2}[0-9]{4}){3}(?![0-9])"
IP6 = r"(?<![A-Za-z0-9:])[A-Fa-f0-9]{1,4}(?::{1,2}[A-Fa-f0-9]{1,4}){3,7}(?![A-Za-z0-9:])"
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*[A-Za-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}+"
DIGITS, RUN = "[0-9]{3}|[0-9][ -][0-9]", "[A-Za-z0-9+/_-]{20}"
#: Generators: kind, pattern, what a text must hold for the pattern to be tried (a string, or a pattern).
GENERATORS = [
    (0, EMAIL, "@", None), (1, IP, ".", None), (2, CARD, None, DIGITS), (3, PHONE, "+", None), (0, SPELT, "at", None), (3, LOCAL, None, DIGITS),
    (2, GROUPED, None, DIGITS), (1, IP6, ":", None), (4, SECRET, None, RUN),
]
#: Words that announce personal data.
CUES = r"(?i)(?:tel|phone|call|fax|mobile|mobil|mail|contact|card|visa|konto|carte|tarjeta|host|addr|token|secret|passw|pwd|key|auth|bearer)[a-z._]{0,6}[\x20:=]{1,3}[\"']?$"
FEATURES = ["generator", "n", "digits", "letters", "groups", "marks", "luhn", "before", "after", "longest", "upper", "word", "bases", "gap"]


def placed(text: Column, pattern: str, needs: str | None, like: str | None) -> Column:
    """Array of ``(start, end, value)`` of a pattern's matches, in code points."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    empty = "cast(array() as array<struct<start:int,end:int,m:string>>)"
    out = F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), F.expr(empty).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + F.length(x["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("start"), (a["at"] + x["g"] + F.length(x["m"])).alias("end"), x["m"].alias("m")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    some = F.instr(text, needs) > 0 if needs else text.rlike(like)
    return F.when(some, out).otherwise(F.expr(empty))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.reverse(digits_of(m))
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.length(d) - 1, F.lit(0))), lambda i: F.try_add(F.ascii(F.substr(d, i + 1, F.lit(1))) - 48, F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def base_check(generator: int, m: Column) -> Column:
    if generator == 0:
        return F.lit(True)
    if generator == 1:
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) < 4) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if generator == 2:
        return luhn(m)
    if generator == 3:
        return F.length(digits_of(m)).between(9, 15)
    return F.lit(False)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, h, spans``: all candidates of each text with features, weak label and base mark."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    for g, (_, pattern, needs, like) in enumerate(GENERATORS):
        rows = rows.withColumn(f"g{g}", placed(F.col("text"), pattern, needs, like))

    def span(g: int):
        def make(x: Column) -> Column:
            m, near = x["m"], F.substring(F.col("text"), F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))
            right = F.substring(F.col("text"), x["end"] + 1, F.lit(24))
            n = lambda c: F.length(F.regexp_replace(m, c, ""))
            kind = lambda c: F.when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike("[=#/_]"), 3).when(c.rlike("[\"'(<\\[]"), 4).otherwise(0)
            values = {
                "start": x["start"], "end": x["end"], "kind": F.lit(GENERATORS[g][0]), "base": F.coalesce(base_check(g, m), F.lit(False)), "cue": near.rlike(CUES),
                "generator": F.lit(g), "n": F.length(m), "digits": n("[^0-9]"), "letters": n("[^A-Za-z]"), "groups": F.size(F.split(m, "[^A-Za-z0-9]+")), "marks": n("[A-Za-z0-9]"),
                "luhn": luhn(m).cast("int"), "before": kind(F.substring(F.col("text"), x["start"], F.when(x["start"] > 0, F.lit(1)).otherwise(0))), "after": kind(F.substring(F.col("text"), x["end"] + 1, F.lit(1))),
                "longest": F.array_max(F.transform(F.split(m, "[^A-Za-z0-9]+"), lambda p: F.length(p))), "upper": n("[^A-Z]"),
                "word": F.pmod(F.xxhash64(F.lower(F.regexp_extract(right, "^[^A-Za-z\\n]{0,3}([A-Za-z]{1,12})", 1))), F.lit(16)).cast("int"),
            }
            return F.struct(*[v.alias(k) for k, v in values.items()])
        return make

    spans = F.concat(*[F.transform(F.col(f"g{g}"), span(g)) for g in range(len(GENERATORS))])
    found = rows.select("id", "text", spans.alias("spans")).withColumn("base", F.filter("spans", lambda s: s["base"]))
    # Distance to the nearest other base span, at most 1000, and how many there are.
    away = "array_min(transform(base, b -> if(b.start = s.start AND b.end = s.end, 1000, least(1000, if(b.start >= s.end, b.start - s.end, if(s.start >= b.end, s.start - b.end, 0))))))"
    near = F.expr(f"transform(spans, s -> named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, s.{n}' for n in SPAN)}, 'bases', least(size(base), 16), 'gap', coalesce({away}, 1000)))")
    return found.select("id", "text", near.alias("spans")).withColumn("h", F.xxhash64("id", F.size("spans")))


SPAN = ["start", "end", "kind", "base", "cue", *FEATURES[:-2]]


def proven(right: int, n: int, least: float = PRECISION, error: float = ERROR) -> bool:
    """Whether the exact lower bound of a share of which ``right`` of ``n`` came out is at least ``least``."""
    if right <= least * n:
        return False
    log = math.lgamma(n + 1) - math.lgamma(right + 1) - math.lgamma(n - right + 1) + right * math.log(least) + (n - right) * math.log1p(-least)
    term = total = 1.0
    for i in range(right, n):  # falling terms of the upper tail
        term *= (n - i) / (i + 1) * least / (1 - least)
        total += term
        if term < 1e-17 * total:
            break
    return log + math.log(total) <= math.log(error)


def level(model: tuple) -> Column:
    """The score of a span ``s`` in millionths, rounded down."""
    return F.floor(F.expr(boosting.sql(model, [f"s.{f}" for f in FEATURES])) * 1_000_000).cast("long")


def fit(found: DataFrame) -> tuple[tuple, dict[int, int]]:
    """The trees, and the threshold (as a ``level``) of each generator that has one."""
    flat = found.where(F.size("spans") > 0).select("h", F.posexplode("spans").alias("i", "s"))
    flat = flat.select(F.xxhash64("h", "i").alias("r"), "s")
    half = F.col("r").bitwiseAND(F.lit(1)) == 0
    rows = flat.where(half).select("r", "s.base", "s.cue", *[f"s.{f}" for f in FEATURES]).orderBy("r", *FEATURES).limit(SAMPLE).collect()
    x = np.array([[float(r[f] or 0) for f in FEATURES] for r in rows]).reshape(-1, len(FEATURES))
    model = boosting.boost(x, np.array([float(r.base or r.cue) for r in rows]))
    held = flat.where(~half & ~F.col("s.base")).select(F.col("s.generator").alias("g"), level(model).alias("level"), F.col("s.cue").cast("long").alias("right"))
    counts: dict[int, list] = {}
    for r in held.groupBy("g", "level").agg(F.sum("right").alias("right"), F.count("*").alias("n")).collect():
        counts.setdefault(r.g, []).append((r.level, r.right, r.n))
    cuts = {}
    for g, own in counts.items():
        right = n = 0
        for cut, more_right, more in sorted(own, reverse=True):
            right, n = right + more_right, n + more
            if proven(right, n):
                cuts[g] = cut
    return model, cuts


def chosen(found: DataFrame, model: tuple, cuts: dict[int, int]) -> DataFrame:
    """``found`` with ``base`` and ``every``: the base spans, and those with the added ones, in order (kind, start, end, base)."""
    base = F.filter("spans", lambda s: s["base"])
    if cuts:
        score = boosting.sql(model, [f"s.{f}" for f in FEATURES])
        reach = " ".join(f"WHEN {g} THEN {cut}L" for g, cut in sorted(cuts.items()))
        more = F.expr(f"filter(spans, s -> NOT s.base AND coalesce(floor(({score}) * 1000000) >= CASE s.generator {reach} END, false) AND NOT exists(base, b -> b.start <= s.start AND s.end <= b.end))")
    else:
        more = F.expr("filter(spans, s -> false)")
    found = found.withColumn("base", base).withColumn("more", more)
    ordered = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))))
    return found.withColumn("every", ordered(F.concat("base", "more"))).withColumn("base", ordered("base")).drop("more")


def trained(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, tuple, dict[int, int]]:
    """The staged candidates, the trees and the thresholds."""
    found = Scratch(docs.sparkSession, "pii").cut(candidates(docs, id_col, text_col).drop("text"), "candidates")
    return found, *fit(found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans, entities`` (array of kind, start, end, base)."""
    found = chosen(*trained(docs, id_col, text_col))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        F.col("id").alias(id_col),
        *[F.size(F.expr(f"filter(base, s -> s.kind = {k})")).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE_KINDS])],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("every").alias("spans"),
        (F.size("every") - F.size("base")).cast("long").alias("n_added"), F.size("every").cast("long").alias("n_spans"),
        F.transform("every", lambda s: F.struct(names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))).alias("entities"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text``: each text with its spans replaced by ``[kind]``; overlapping spans are masked together, named by the first.

    Spans are cut from the row they were found in, so rows that share an id do not mix.
    """
    _, model, cuts = trained(docs, id_col, text_col)
    rows = chosen(candidates(docs, id_col, text_col), model, cuts)
    names = F.array(*map(F.lit, KINDS))
    step = F.aggregate(
        F.col("every"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
        .otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), names[s["kind"]], F.lit("]")).alias("out"))),
        lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1)),
    )
    return rows.select(F.col("id").alias(id_col), step.alias("text"))
