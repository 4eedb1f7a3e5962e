"""What leaves the library: cards, indexes and notes as Markdown, sidecars and reports as JSON; searches over both
kinds of records; and small reports. Texts are columns, the caller writes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.operators import vectors


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def card_markdown(cards: DataFrame) -> DataFrame:
    """SNK19: ``card_id, file, markdown`` of ``cards(card_id, zettel_id, title, core_concept, content, card_type, domain, tags)``;
    null fields are empty."""
    tags = F.concat(F.lit("["), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", "), F.lit("]"))
    lines = [F.lit("---"), F.concat(F.lit("id: "), _plain("zettel_id")), F.concat(F.lit("title: "), _plain("title")), F.concat(F.lit("type: "), _plain("card_type")),
             F.concat(F.lit("domain: "), _plain("domain")), F.concat(F.lit("tags: "), tags), F.lit("---"), F.lit(""), F.concat(F.lit("# "), _plain("title")), F.lit(""),
             F.concat(F.lit("> "), _plain("core_concept")), F.lit(""), _plain("content")]
    return cards.select("card_id", F.concat(_plain("zettel_id"), F.lit(".md")).alias("file"), F.concat_ws("\n", *lines).alias("markdown"))


def index_lines(cards: DataFrame, by: str = "folder") -> DataFrame:
    """SNK19: ``by, seq, line``: for each folder a line a card in the order of ids, numbered from 1."""
    w = Window.partitionBy(by).orderBy("card_id")
    line = F.concat(F.lit("- [["), _plain("zettel_id"), F.lit("]] "), _plain("title"))
    return cards.select(by, F.row_number().over(w).cast("long").alias("seq"), line.alias("line"))


def cards_by_tag(cards: DataFrame) -> DataFrame:
    """AGG23: ``tag, seq, card_id``: a row for each tag of each card, numbered inside the tag by card; repeated tags once."""
    rows = cards.select("card_id", F.explode(F.array_distinct("tags")).alias("tag")).where("tag IS NOT NULL")
    return rows.select("tag", F.row_number().over(Window.partitionBy("tag").orderBy("card_id")).cast("long").alias("seq"), "card_id")


def reading_order(cards: DataFrame, links: DataFrame) -> DataFrame:
    """AGG22: ``id, n``: ids with the number of foundation links that point at them, fewest first; ``links(target)``."""
    into = links.where("target IS NOT NULL").groupBy("target").agg(F.count("*").alias("n"))
    return cards.select("id").join(into, F.col("id") == F.col("target"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).orderBy("n", "id")


def paper_notes(papers: DataFrame) -> DataFrame:
    """SNK19: ``id, markdown``: a note for each of ``papers(id, title, year, doi, cite_key)``; empty fields have no line."""
    field = lambda name: F.when(_plain(name) != "", F.concat(F.lit(f"{name}: "), _plain(name)))
    return papers.select("id", F.concat_ws("\n", F.lit("---"), field("title"), field("year"), field("doi"), field("cite_key"), F.lit("---"), F.lit(""), F.concat(F.lit("# "), _plain("title"))).alias("markdown"))


def sidecars(judged: DataFrame, name: str, content: Column) -> DataFrame:
    """SNK21: ``card_id, sidecar``: the JSON beside each judged card ``card_id, verdict, coverage, span, start, end``, with the name and
    the SHA-1 of the source (column ``name``, bytes ``content``; a source without a name has null for both)."""
    named = F.col(name).isNotNull()
    print_ = F.struct(F.col(name).alias("pdf_name"), F.when(named, F.sha1(content)).alias("sha1"))
    offset = F.when(F.col("start").isNotNull(), F.array("start", "end"))
    record = F.struct("card_id", "verdict", F.round("coverage", 4).alias("coverage"), F.col("span").alias("matched_span"), offset.alias("char_offset"), print_.alias("source_fingerprint"))
    return judged.select("card_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("sidecar"))


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """SNK16/PIP11: ``key, json``: each row as one JSON object, nulls included."""
    return rows.select(key, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


# --- searches ----------------------------------------------------------------------------------


def search_all(collections: dict[str, DataFrame], query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """VEC3/SET4: ``kind, id, similarity, place``: the k most similar of each collection ``(id, v)`` in one ranking; ties by kind and id."""
    found = [vectors.search_one(rows.where(F.exists("v", lambda c: c != 0)), query, k).withColumn("kind", F.lit(kind)) for kind, rows in sorted(collections.items())]
    both = reduce(DataFrame.unionByName, found).withColumn("similarity", vectors.similarity(F.col("similarity"), metric))
    w = Window.partitionBy().orderBy(F.desc("similarity"), "kind", "id")  # at most k rows a collection
    return both.select("kind", "id", "similarity", F.row_number().over(w).alias("place"))


def related_cards(cards: DataFrame, query: list[float], cite_key: str, limit: int = 5) -> DataFrame:
    """VEC5: of the 2 * limit cards ``(id, zettel_id, v)`` most similar the first ``limit`` that are not the paper's own, by the start of their ids."""
    near = vectors.search_one(cards.where(F.exists("v", lambda c: c != 0)), query, 2 * limit)
    rows = near.join(cards.select("id", "zettel_id"), "id").where(~F.startswith("zettel_id", F.lit(cite_key)))
    return rows.orderBy(F.desc("similarity"), "id").limit(limit).select("id", "zettel_id", "similarity")


def collection_item(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """SRC17: the rows of a collection whose ids are wanted."""
    return rows.join(wanted.select("id").distinct(), "id", "left_semi")


def collection_stats(collections: dict[str, DataFrame]) -> DataFrame:
    """SRC17/PIP4: ``collection, items`` of each collection."""
    return reduce(DataFrame.unionByName, [rows.agg(F.count("*").alias("items")).select(F.lit(kind).alias("collection"), "items") for kind, rows in sorted(collections.items())])


def shared_concepts(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """REL6: ``card1, card2, shared``: the sorted common concepts of pairs of ``cards(card_id, tags, core_concept, title)``: tags,
    and words of three letters or more of core and title."""
    letters = lambda name: F.filter(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) >= 3)
    own = cards.select("card_id", F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), letters("core_concept"), letters("title"))).alias("concepts"))
    side = lambda i: own.select(F.col("card_id").alias(f"card{i}"), F.col("concepts").alias(f"c{i}"))
    return pairs.select("card1", "card2").join(side(1), "card1").join(side(2), "card2").select("card1", "card2", F.sort_array(F.array_intersect("c1", "c2")).alias("shared"))


# --- reports -----------------------------------------------------------------------------------


def daily_trend(costed: DataFrame, end: str) -> DataFrame:
    """AGG16: ``day, requests, tokens, cost`` of each of the seven days up to ``end`` (days without requests hold zeros)."""
    spark = costed.sparkSession
    days = spark.range(7).select(F.date_sub(F.to_date(F.lit(end)), F.col("id").cast("int")).alias("day"))
    sums = costed.groupBy("day").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return days.join(sums, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("requests", "tokens", "cost")])


def performance(requests: DataFrame) -> DataFrame:
    """AGG17: requests, share of successes and mean response time of each model."""
    return requests.groupBy("model").agg(F.count("*").alias("requests"), (F.count_if("success") / F.count("*")).alias("success_rate"), F.avg("response_time").alias("avg_response_time"))


def file_statistics(files: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """PIP14: ``kind, files, bytes`` of ``files(path, length)`` by patterns of their paths; a file may be of several kinds."""
    each = [files.where(F.col("path").rlike(p)).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).select(F.lit(k).alias("kind"), "files", "bytes") for k, p in sorted(kinds.items())]
    return reduce(DataFrame.unionByName, each)


def removable(files: DataFrame, now: str, patterns: list[str], protected: list[str], days: int = 7, most_bytes: int | None = None) -> DataFrame:
    """SNK22: the ``files(path, length, modificationTime)`` that match a pattern and no protected one, are ``days`` old or older and not larger than ``most_bytes``."""
    some = lambda ps: reduce(Column.__or__, [F.col("path").rlike(p) for p in ps], F.lit(False))
    old = F.col("modificationTime") <= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days))
    small = F.lit(True) if most_bytes is None else F.col("length") <= most_bytes
    return files.where(some(patterns) & ~some(protected) & old & small)


def first_resource(rows: DataFrame, layers: list[str]) -> DataFrame:
    """PIP15: adds ``resource`` and ``layer``: the first layer that is not empty, in order."""
    picks = [F.when(_plain(c) != "", F.struct(F.col(c).cast("string").alias("resource"), F.lit(c).alias("layer"))) for c in layers]
    return rows.withColumn("_x", F.coalesce(*picks)).select("*", "_x.resource", "_x.layer").drop("_x")
