"""Domain tables made from the test tables, as DataFrames and as the SQL that oracles start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, year = F.col("o_orderkey").cast("string"), F.year("o_orderdate").cast("string")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Paper "), key, F.lit(" on "), F.col("o_orderpriority")).alias("title"),
        F.year("o_orderdate").cast("long").alias("year"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("10.1000/"), key)).alias("doi"),
        F.when(F.col("o_orderkey") % 5 == 1, F.lit("")).when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("Author"), F.col("o_custkey").cast("string"), F.lit("-"), year)).alias("cite_key"),
        F.concat(F.lit("/papers/"), key, F.lit(".md")).alias("file_path"),
    )


def paper_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author")).distinct()


def paper_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With repeats: a paper may name a keyword twice."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("paper_id"), F.col("p_brand").alias("keyword"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    k = F.col("doc_id")
    return d.select(
        k.alias("card_id"), F.concat(F.col("source"), F.lit("-"), k.cast("string")).alias("zettel_id"),
        F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"),
        F.substring(F.split("text", r"\.")[0], 1, 100).alias("core_concept"),
        F.element_at(F.array(*map(F.lit, CARD_TYPES)), (k % 4 + 1).cast("int")).alias("card_type"),
        F.element_at(F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv]), F.col("lang")).alias("domain"),
        F.col("source").alias("folder"), F.when(k % 7 != 0, k % 50).alias("paper_id"), F.array("lang", "source").alias("tags"),
    )


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between papers and cards with a similarity."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        (k % 200).alias("paper_id"), k.alias("card_id"), (k * 37 % 100 / F.lit(100.0)).alias("similarity")
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each model request."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.to_date("ts").alias("day"), F.col("event_type").alias("model"), F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("provider"),
        (F.col("event_type") != "error").alias("success"), F.col("value").alias("response_time"), F.get_json_object("props", "$.k").cast("long").alias("tokens"),
    )


#: The card types, and the domain that stands for each language of the test documents.
CARD_TYPES = ["concept", "method", "finding", "question"]
DOMAINS = {"en": "CogSci", "fr": "Linguistics", "de": "AI", "es": "Psychology"}

PAPERS = """papers AS (SELECT o_orderkey AS id, 'Paper ' || o_orderkey || ' on ' || o_orderpriority AS title, year(o_orderdate) AS year,
 CASE WHEN o_orderkey % 3 <> 0 THEN '10.1000/' || o_orderkey END AS doi,
 CASE WHEN o_orderkey % 5 = 1 THEN '' WHEN o_orderkey % 5 <> 0 THEN 'Author' || o_custkey || '-' || year(o_orderdate) END AS cite_key,
 '/papers/' || o_orderkey || '.md' AS file_path FROM orders)"""
AUTHORS = "paper_authors AS (SELECT DISTINCT l_orderkey AS paper_id, l_suppkey AS author FROM lineitem)"
KEYWORDS = "paper_keywords AS (SELECT l_orderkey AS paper_id, p_brand AS keyword FROM lineitem JOIN part ON l_partkey = p_partkey)"
CARDS = """cards AS (SELECT doc_id AS card_id, source || '-' || doc_id AS zettel_id, substr(text, 1, 60) AS title, text AS content,
 substr(string_split(text, '.')[1], 1, 100) AS core_concept, ['concept', 'method', 'finding', 'question'][doc_id % 4 + 1] AS card_type,
 CASE lang WHEN 'en' THEN 'CogSci' WHEN 'fr' THEN 'Linguistics' WHEN 'de' THEN 'AI' WHEN 'es' THEN 'Psychology' END AS domain,
 source AS folder, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 50 END AS paper_id, [lang, source] AS tags FROM documents JOIN labels USING (doc_id))"""
BRIDGE = "bridge AS (SELECT doc_id % 200 AS paper_id, doc_id AS card_id, (doc_id * 37 % 100) / 100.0::DOUBLE AS similarity FROM labels)"
USAGE = """usage AS (SELECT event_id, CAST(ts AS DATE) AS day, event_type AS model, 'p' || (user_id % 4) AS provider, event_type <> 'error' AS success,
 value AS response_time, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events)"""
