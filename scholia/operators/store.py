"""The relational store: lookups, joins and changes as pure functions from tables to tables.

A change returns the new table; the caller persists it. Keys are matched by joins, never by
collecting rows, and every "first" has a stated order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.operators.graph import cut

# --- lookups -----------------------------------------------------------------------------------


def page(rows: DataFrame, limit: int, offset: int = 0, key: str = "id") -> DataFrame:
    """TOP1/SRC2: a page of rows, newest (largest key) first."""
    return rows.orderBy(F.desc(key)).offset(offset).limit(limit)


def clean_doi(doi: Column) -> Column:
    """A DOI without its resolver address."""
    return F.regexp_replace(F.trim(doi), r"(?i)^https?://(dx\.)?doi\.org/", "")


def by_doi(papers: DataFrame, doi: str) -> DataFrame:
    """FLT2: papers whose DOI is, or else contains, the given one; the exact match, then the smallest id."""
    want = clean_doi(F.lit(doi))
    own = clean_doi(F.col("doi"))
    return papers.where(own.contains(want)).orderBy((own != want).cast("int"), "id").limit(1)


def plain_key(key: Column) -> Column:
    """A citation key without separators, in lower case."""
    return F.regexp_replace(F.lower(key), r"[-_\s]", "")


def by_cite_keys(papers: DataFrame, wanted: DataFrame, key: str = "wanted") -> DataFrame:
    """FLT3: for each wanted key the paper of the best tier (1 same but for case, 2 same but for separators), smallest id first."""
    w = wanted.select(F.col(key).alias("_key"), F.lower(key).alias("_k1"), plain_key(F.col(key)).alias("_k2"))
    own = papers.where(F.col("cite_key") != "").select("*", F.lower("cite_key").alias("_c1"), plain_key(F.col("cite_key")).alias("_c2"))
    hits = own.join(w, own["_c2"] == w["_k2"]).withColumn("tier", F.when(F.col("_c1") == F.col("_k1"), 1).otherwise(2))
    first = Window.partitionBy("_key").orderBy("tier", "id")
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(F.col("_key").alias(key), "id", "cite_key", "tier")


def without_cite_key(papers: DataFrame) -> DataFrame:
    """FLT4."""
    return papers.where(F.col("cite_key").isNull() | (F.col("cite_key") == "")).orderBy("id")


def new_files(files: DataFrame, papers: DataFrame) -> DataFrame:
    """FLT6: files whose path is unknown and whose title (lower case, trimmed) is unknown."""
    paths = papers.select(F.col("file_path").alias("_p")).distinct()
    titles = papers.select(F.lower(F.trim("title")).alias("_t")).distinct()
    return files.join(paths, F.col("file_path") == F.col("_p"), "left_anti").join(titles, F.lower(F.trim("title")) == F.col("_t"), "left_anti")


# --- joins -------------------------------------------------------------------------------------


def linked_cards(papers: DataFrame, links: DataFrame, cards: DataFrame, least: float = 0.0) -> DataFrame:
    """JON1/JON2/JON3: cards of papers over the bridge with at least a similarity."""
    near = links.where(F.col("similarity") >= least)
    mine = cards.select("card_id", "zettel_id", F.col("title").alias("card_title"))
    return near.join(papers.select(F.col("id").alias("paper_id"), F.col("title").alias("paper_title")), "paper_id").join(mine, "card_id")


def card_stats(papers: DataFrame, cards: DataFrame, links: DataFrame, strict_reference: bool = False) -> DataFrame:
    """JON4/AGG3: cards and linked cards of each paper that has any, and a completeness score.

    Cards are counted once each; ``strict_reference`` counts a card once for each link instead.
    Both sides are aggregated before they are joined, so nothing fans out.
    """
    own = cards.where(F.col("paper_id").isNotNull()).groupBy("paper_id").agg(F.count("*").alias("cards"))
    linked = links.groupBy("paper_id").agg(F.countDistinct("card_id").alias("linked"), F.count("*").alias("rows"))
    out = papers.select(F.col("id").alias("paper_id")).join(own, "paper_id", "left").join(linked, "paper_id", "left").fillna(0, ["cards", "linked", "rows"])
    cards_seen = F.col("cards") * F.greatest(F.col("rows"), F.lit(1)) if strict_reference else F.col("cards")
    return out.where("cards > 0 OR linked > 0").select("paper_id", cards_seen.alias("card_count"), F.col("linked").alias("linked_count")).withColumn(
        "completeness", F.least(F.lit(100).cast("long"), 5 * F.col("card_count") + 5 * F.col("linked_count"))
    )


def without_cards(papers: DataFrame, cards: DataFrame, links: DataFrame) -> DataFrame:
    """JON5: papers with neither cards nor links."""
    some = cards.where(F.col("paper_id").isNotNull()).select("paper_id").union(links.select("paper_id")).distinct()
    return papers.join(some, papers["id"] == some["paper_id"], "left_anti")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# --- changes -----------------------------------------------------------------------------------


def upsert_papers(old: DataFrame, new: DataFrame) -> DataFrame:
    """SNK1: new papers replace the fields of the paper they match by doi, else cite key, else path; others get ids.

    A null field of the new row keeps the old value. ``action`` tells what became of each row.
    Of new rows that match one paper the last by path counts; rows without a path match by doi or cite key only.
    """
    fields = [c for c in old.columns if c != "id"]
    n = cut(new.select(*fields).withColumn("_row", F.monotonically_increasing_id()))  # row ids stay as they are
    matches = None
    for tier, key in enumerate(("doi", "cite_key", "file_path")):
        have = old.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(F.col(key).alias("_k")).agg(F.min("id").alias("id"))
        hit = n.join(have, n[key] == have["_k"]).select("_row", "id", F.lit(tier).alias("tier"))
        matches = hit if matches is None else matches.unionByName(hit)
    best = matches.groupBy("_row").agg(F.min_by("id", "tier").alias("_id"))
    told = n.join(best, "_row", "left")
    changes = latest(told.where("_id IS NOT NULL"), ["_id"], [F.desc("file_path"), "_row"])
    updated = old.alias("o").join(changes.alias("c"), F.col("o.id") == F.col("c._id"), "left").select(
        "o.id", *[F.coalesce(f"c.{f}", f"o.{f}").alias(f) for f in fields], F.when(F.col("c._id").isNull(), "kept").otherwise("updated").alias("action"))
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    told = told.where("_id IS NULL")  # new rows of one path are one paper; without a path each is its own
    fresh = latest(told.where("file_path IS NOT NULL"), ["file_path"], [F.desc("title")]).unionByName(told.where("file_path IS NULL")).drop("_id", "_row")
    # Ids by range partitions: a count for each, so no single task numbers all rows.
    numbered = number(fresh, "file_path").crossJoin(F.broadcast(top))  # one row
    added = numbered.select((F.col("_top") + F.col("_nth")).alias("id"), *fields, F.lit("inserted").alias("action"))
    return updated.unionByName(added)


def number(rows: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """Adds ``_nth`` from 1, gapless, in the order of (hash bucket, key): buckets are counted first."""
    b = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    sizes = b.groupBy("_b").count()
    before = Window.partitionBy().orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s"))
    own = Window.partitionBy("_b").orderBy(key)
    return b.join(F.broadcast(start), "_b").withColumn("_nth", F.col("_s") + F.row_number().over(own)).drop("_b", "_s")


def update_fields(old: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """SNK2/SNK9: fields of ``changes`` that are not null replace the old ones."""
    fields = [c for c in changes.columns if c != key]
    c = changes.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_n_{f}") for f in fields])
    out = old.join(c, F.col(key) == F.col("_k"), "left")
    return out.select(*[F.coalesce(f"_n_{x}", x).alias(x) if x in fields else F.col(x) for x in old.columns])


def delete_where(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """SNK3/SNK8/SNK23: rows whose key is not in ``gone``; used for a table and everything that refers to it."""
    g = gone.select(F.col(gone.columns[0]).alias("_k")).distinct()
    return rows.join(g, F.col(key) == F.col("_k"), "left_anti")


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK4/SNK6: old rows and the new ones of unknown key, with a status for all new rows."""
    known = old.select(F.col(key).alias("_k")).distinct()
    fresh = latest(new, [key], [F.col(c) for c in new.columns if c != key][:1] or [F.col(key)])
    added = fresh.join(known, F.col(key) == F.col("_k"), "left_anti").withColumn("status", F.lit("inserted"))
    return old.withColumn("status", F.lit("old")).unionByName(added)


def insert_or_replace(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """SNK5/SNK12/PIP9: new rows replace old ones of their key."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    rest = [F.col(c) for c in old.columns if c not in key]
    return latest(both, key, [F.desc("_seq"), *rest]).drop("_seq")


def back_fill_keys(papers: DataFrame, entries: DataFrame) -> DataFrame:
    """SNK14: cite keys of papers without one from entries of the same normalised title (smallest key)."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    e = entries.groupBy(norm(F.col("title")).alias("_t")).agg(F.min("cite_key").alias("_c"))
    out = papers.join(e, norm(F.col("title")) == F.col("_t"), "left")
    missing = F.col("cite_key").isNull() | (F.col("cite_key") == "")
    return out.select(*[F.when(missing, F.coalesce("_c", "cite_key")).otherwise(F.col("cite_key")).alias(c) if c == "cite_key" else F.col(c) for c in papers.columns])


def evolve(rows: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """SNK13: adds missing columns (name to type and default)."""
    for name, (kind, default) in columns.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(default).cast(kind))
    return rows


# --- concepts ----------------------------------------------------------------------------------


def concept_rows(cards: DataFrame) -> DataFrame:
    """AGG7: ``card_id, paper_id, domain, card_type, concept``: the first sentence of the core (over five
    characters, cut at 100) and all tags of over two."""
    core = F.substring(F.trim(F.split("core_concept", r"\.")[0]), 1, 100)
    keep = ["card_id", "paper_id", "domain", "card_type"]
    a = cards.select(*keep, core.alias("concept")).where(F.length("concept") > 5)
    b = cards.select(*keep, F.explode("tags").alias("concept")).where(F.length("concept") > 2)
    return a.unionByName(b)


def concept_table(concepts: DataFrame) -> DataFrame:
    """SNK11/AGG9: frequency, papers and majority domain (ties: the smaller name) of each concept."""
    by = concepts.groupBy("concept", "domain").agg(F.count("*").alias("n"))
    best = Window.partitionBy("concept").orderBy(F.desc("n"), "domain")
    top = by.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("concept", F.col("domain").alias("main_domain"))
    return concepts.groupBy("concept").agg(F.count("*").alias("frequency"), F.countDistinct("paper_id").alias("papers")).join(top, "concept")


def concept_hierarchy(concepts: DataFrame) -> DataFrame:
    """AGG8: distinct sorted concepts by domain and card type."""
    return concepts.groupBy("domain", "card_type").agg(F.sort_array(F.collect_set("concept")).alias("concepts"))
