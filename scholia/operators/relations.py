"""Relations between note cards: type, confidence, shared concepts and the network they form.

All rules are built-in expressions over pairs; pairs come from the nearest neighbours of each card.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that mark a relation (substrings of the lower-cased content).
FORWARD = ["-->", "導向", "leads to"]
BACKWARD = ["<--", "基於", "based on"]
CONTRAST = ["但", "然而", "相反", "對比", "however", "but", "contrast", "differ"]
SUPERCLASS = ["包含", "抽象", "泛指", "include", "general", "abstract", "superclass"]
SUBCLASS = ["具體", "特例", "實例", "specific", "instance", "example", "subclass"]
DIRECTIONAL = ["因此", "所以", "導致", "therefore", "thus", "result"]
#: Similarity of domains, symmetric; equal domains 1, all others 0.3.
DOMAINS = {
    ("CogSci", "AI"): 0.8, ("CogSci", "Linguistics"): 0.8, ("CogSci", "Neuroscience"): 0.9, ("CogSci", "Psychology"): 0.95,
    ("AI", "Linguistics"): 0.6, ("AI", "Neuroscience"): 0.7, ("AI", "ComputerScience"): 0.9,
    ("Linguistics", "Psychology"): 0.7, ("Linguistics", "Anthropology"): 0.8, ("Linguistics", "ComputerScience"): 0.5,
    ("Neuroscience", "Psychology"): 0.9, ("Neuroscience", "Biology"): 0.85,
    ("Psychology", "Sociology"): 0.7, ("ComputerScience", "Mathematics"): 0.8,
}
DOMAIN_DEFAULT = 0.3


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def unordered_pairs(found: DataFrame) -> DataFrame:
    """SET2: each pair of ``query, id, similarity`` once. ``card1`` is the lower id if the pair is among its
    neighbours, else the higher one (whichever is met first in id order)."""
    w = Window.partitionBy(F.least("query", "id"), F.greatest("query", "id")).orderBy("query")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("query").alias("card1"), F.col("id").alias("card2"), "similarity")


def relation_type(content1: Column, content2: Column, id2: Column, similarity: Column) -> Column:
    """REL2: explicit links with a direction, then contrast, super- and subclass words, then similarity."""
    a, b = F.lower(F.coalesce(content1, F.lit(""))), F.lower(F.coalesce(content2, F.lit("")))
    linked = F.coalesce(content1, F.lit("")).contains(F.concat(F.lit("[["), id2, F.lit("]]")))
    return (
        F.when(linked & has_any(a, FORWARD), "leads_to").when(linked & has_any(a, BACKWARD), "based_on")
        .when(has_any(a, CONTRAST) | has_any(b, CONTRAST), "contrasts_with").when(has_any(a, SUPERCLASS), "superclass_of").when(has_any(a, SUBCLASS), "subclass_of")
        .when((similarity >= 0.5) & (similarity < 0.7) & has_any(a, DIRECTIONAL), "leads_to").otherwise("related_to")
    )


def domain_similarity(d1: Column, d2: Column) -> Column:
    """REL10: the largest similarity over the domains of two comma-separated lists; 0.3 if one is empty."""
    table = F.create_map(*[F.lit(x) for (p, q), v in DOMAINS.items() for x in (f"{p}|{q}", v)], *[F.lit(x) for (p, q), v in DOMAINS.items() for x in (f"{q}|{p}", v)])
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    pair = lambda x: F.transform(split(d2), lambda y: F.when(x == y, 1.0).otherwise(F.coalesce(F.element_at(table, F.concat(x, F.lit("|"), y)), F.lit(DOMAIN_DEFAULT))))
    return F.coalesce(F.array_max(F.flatten(F.transform(split(d1), pair))), F.lit(DOMAIN_DEFAULT))


def section(content: Column, name: str) -> Column:
    """The text under a second-level heading, up to the next one; empty if there is none."""
    return F.regexp_extract(content, rf"(?s)##\s*{name}\s*\n(.*?)(?=\n##|\z)", 1)


def link_strength(content: Column, target: Column) -> Column:
    """REL4: how firmly a card's text links to a target, by the section and the words around the link."""
    text = F.coalesce(content, F.lit(""))
    link = F.concat(F.lit("[["), target, F.lit("]]"))
    notes = F.regexp_extract(section(text, "個人筆記"), r"(?s)\*\*\[AI Agent\]\*\*:\s*(.+?)(?=\*\*\[Human\]\*\*:|##|\z)", 1)
    around = lambda c, n: F.substring(c, F.greatest(F.instr(c, link) - n, F.lit(1)), F.least(F.instr(c, link) - 1, F.lit(n)) + F.length(link) + n)
    near, net = F.lower(around(notes, 50)), section(text, "連結網絡")
    mark = around(net, 30)
    #: Words that grade a link.
    strong, direct = ["基於", "來自", "延伸", "發展", "建立在", "based on", "derived from", "extends"], ["導向", "指向", "通往", "leads to", "points to"]
    critical, related = ["對比", "挑戰", "質疑", "contrasts", "challenges", "questions"], ["相關", "連結", "關聯", "related", "connected", "linked"]
    in_notes = F.when(notes.contains(link), F.when(has_any(near, strong), 1.0).when(has_any(near, direct), 0.8).when(has_any(near, critical), 0.7).when(has_any(near, related), 0.6).otherwise(0.5)).otherwise(0.0)
    in_net = F.when(net.contains(link), F.when(has_any(mark, ["基於 ->", "來自 ->"]), 0.8).when(has_any(mark, ["導向 ->", "延伸 ->"]), 0.75).when(has_any(mark, ["相關 <->", "對比 <->"]), 0.7).otherwise(0.6)).otherwise(0.0)
    in_source = F.when(section(text, "來源脈絡").contains(link), 0.4).otherwise(0.0)
    best = F.greatest(in_notes, in_net, in_source)
    return F.when(~text.contains(link), 0.0).when(best == 0.0, 0.3).otherwise(best)


def words(text: Column) -> Column:
    """Words of three or more ASCII letters, lower-cased, whole words only."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b[a-z]{3,}\b"), F.lit(0))


def han_keywords(text: Column, top_n: int) -> Column:
    """REL9: the first 2 * top_n runs of two to four Han characters."""
    return F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\x{4e00}-\x{9fa5}]{2,4}"), F.lit(0)), 1, 2 * top_n)


def weighted_concepts(cards: DataFrame) -> DataFrame:
    """REL7: ``card_id, concept, weight``: tags 1.0, core 0.9, description 0.8 (ten words), title 0.7, notes 0.6
    (fifteen words); the largest weight counts."""
    have = lambda c: F.col(c) if c in cards.columns else F.lit(None).cast("string")
    parts = [(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != ""), 1.0)]
    for name, weight, top, most in (("core_concept", 0.9, 5, None), ("description", 0.8, 8, 10), ("title", 0.7, 5, None), ("ai_notes", 0.6, 10, 15)):
        w = words(have(name))
        parts.append((F.concat(han_keywords(have(name), top), w if most is None else F.slice(w, 1, most)), weight))
    rows = F.concat(*[F.transform(c, _weigh(weight)) for c, weight in parts])
    return cards.select("card_id", F.explode(rows).alias("r")).groupBy("card_id", "r.concept").agg(F.max("r.weight").alias("weight"))


def _weigh(weight: float):
    return lambda x: F.struct(x.alias("concept"), F.lit(weight).alias("weight"))


def concept_overlap(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """REL8: ``overlap`` of the pairs: the shared concepts' smaller weights over the mean total weight, at most 1."""
    total = concepts.groupBy("card_id").agg(F.sum("weight").alias("total"))
    a = concepts.select(F.col("card_id").alias("card1"), "concept", F.col("weight").alias("w1"))
    b = concepts.select(F.col("card_id").alias("card2"), "concept", F.col("weight").alias("w2"))
    met = pairs.select("card1", "card2").join(a, "card1").join(b, ["card2", "concept"]).groupBy("card1", "card2").agg(F.sum(F.least("w1", "w2")).alias("met"), F.count("*").alias("shared"))
    t = lambda i: total.select(F.col("card_id").alias(f"card{i}"), F.col("total").alias(f"t{i}"))
    out = pairs.join(met, ["card1", "card2"], "left").join(t(1), "card1", "left").join(t(2), "card2", "left")
    mean = (F.coalesce("t1", F.lit(1.0)) + F.coalesce("t2", F.lit(1.0))) / 2
    return out.withColumn("overlap", F.least(F.coalesce(F.col("met") / mean, F.lit(0.0)), F.lit(1.0))).withColumn("shared", F.coalesce("shared", F.lit(0))).drop("met", "t1", "t2")


def relate(cards: DataFrame, found: DataFrame, least: float = 0.4) -> DataFrame:
    """REL1: relations of cards ``card_id, zettel_id, content, domain, tags, ...`` over neighbours
    ``query, id, similarity``: type, unrounded confidence and number of shared concepts."""
    pairs = unordered_pairs(found).where(F.col("similarity") >= least)
    scored = concept_overlap(pairs, weighted_concepts(cards))
    c = lambda i: cards.select(F.col("card_id").alias(f"card{i}"), F.col("zettel_id").alias(f"z{i}"), F.col("content").alias(f"x{i}"), F.col("domain").alias(f"d{i}"))
    rows = scored.join(c(1), "card1").join(c(2), "card2")
    sim = F.col("similarity")
    strength = link_strength(F.col("x1"), F.col("z2"))
    confidence = 0.4 * sim + 0.3 * strength + 0.2 * F.col("overlap") + 0.1 * domain_similarity(F.col("d1"), F.col("d2"))
    return rows.select("card1", "card2", "similarity", relation_type(F.col("x1"), F.col("x2"), F.col("z2"), sim).alias("relation_type"), confidence.alias("confidence"), "shared", strength.alias("link_strength"))


def network_nodes(relations: DataFrame, least: float = 0.3) -> DataFrame:
    """REL11: degree of each card over relations of enough confidence; leads_to points forward, based_on back, others both ways."""
    e = relations.where(F.col("confidence") >= least)
    out = e.select(F.col("card1").alias("node"), (F.col("relation_type") != "based_on").cast("int").alias("o"), (F.col("relation_type") != "leads_to").cast("int").alias("i"))
    into = e.select(F.col("card2").alias("node"), (F.col("relation_type") != "leads_to").cast("int").alias("o"), (F.col("relation_type") != "based_on").cast("int").alias("i"))
    return out.unionByName(into).groupBy("node").agg(F.count("*").alias("degree"), F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def suggested_links(relations: DataFrame, least: float = 0.4, most: int = 50, per_type: int = 20) -> DataFrame:
    """TOP4: the ``most`` best relations, of them at most ``per_type`` of each type."""
    top = relations.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "card1", "card2").limit(most)
    w = Window.partitionBy("relation_type").orderBy(F.desc("confidence"), "card1", "card2")
    return top.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_type)
