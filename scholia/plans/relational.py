"""Queries of the store and of co-occurrence, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import cooccurrence as co
from scholia.operators import store
from scholia.plans import adapters as ad


def src1_scan(s, d):
    return ad.papers(s, d).select("id", "title", "year").orderBy("id")


def top1_newest_page(s, d):
    return store.page(ad.papers(s, d), 10, 20).select("id", "title")


def flt1_paper_by_id(s, d):
    return ad.papers(s, d).where("id = 7")


def flt2_paper_by_doi(s, d):
    return store.by_doi(ad.papers(s, d), "https://doi.org/10.1000/7").select("id", "doi")


def flt3_cite_key_cascade(s, d):
    p = ad.papers(s, d)
    wanted = p.where("id % 10 = 2 AND cite_key <> ''").select(F.lower("cite_key").alias("wanted")).union(p.where("id % 10 = 3 AND cite_key <> ''").select(F.regexp_replace("cite_key", "-", "_"))).distinct()
    return store.by_cite_keys(p, wanted)


def flt4_missing_cite_key(s, d):
    return store.without_cite_key(ad.papers(s, d)).select("id", "cite_key")


def flt6_new_files(s, d):
    p = ad.papers(s, d)
    files = p.select("file_path", "title").where("id % 4 < 2").union(p.select(F.concat(F.lit("/new"), "file_path"), F.concat("title", F.when(F.col("id") % 2 == 0, F.lit(" ")).otherwise(F.lit(" revised")))).where("id % 4 = 0 OR id % 4 = 3"))
    return store.new_files(files, p)


def jon1_cards_of_papers(s, d):
    return store.linked_cards(ad.papers(s, d), ad.bridge(s, d), ad.cards(s, d), 0.4)


def agg3_card_stats(s, d):
    return store.card_stats(ad.papers(s, d), ad.cards(s, d), ad.bridge(s, d))


def agg3_card_stats_strict(s, d):
    return store.card_stats(ad.papers(s, d), ad.cards(s, d), ad.bridge(s, d), True).select("paper_id", "card_count")


def jon5_papers_without_cards(s, d):
    return store.without_cards(ad.papers(s, d), ad.cards(s, d), ad.bridge(s, d)).select("id", "title")


def jon6_cards_of_recent_papers(s, d):
    recent = ad.papers(s, d).where("year >= 1997").select("id")
    return ad.cards(s, d).join(recent, F.col("paper_id") == F.col("id"), "left_semi").select("card_id", "paper_id")


def agg1_store_statistics(s, d):
    p, c, b = ad.papers(s, d), ad.cards(s, d), ad.bridge(s, d)
    return p.agg(F.count("*").alias("papers"), F.count("doi").alias("with_doi")).crossJoin(c.agg(F.count("*").alias("cards"), F.countDistinct("folder").alias("folders"), F.countDistinct("domain").alias("domains"))).crossJoin(b.agg(F.count("*").alias("links")))


def agg2_paper_summary(s, d):
    c = ad.cards(s, d).where("paper_id IS NOT NULL")
    n = {t: F.count_if(F.col("card_type") == t) for t in ("concept", "method", "finding")}
    base = F.least(F.lit(100), 5 * F.count("*"))
    for x in n.values():
        base = base + F.when(x > 0, 10).otherwise(0)
    tags = c.select("paper_id", F.explode("tags").alias("t")).groupBy("paper_id").agg(F.array_join(F.sort_array(F.collect_set("t")), ",").alias("tags"))
    return c.groupBy("paper_id").agg(F.count("*").alias("cards"), *[x.alias(t) for t, x in n.items()], F.least(F.lit(100), base).cast("long").alias("completeness")).join(tags, "paper_id")


def agg4_co_authors(s, d):
    return co.co_authors(ad.paper_authors(s, d)).select("a", "b", "shared", F.array_join("groups", ",").alias("papers"))


def agg5_keyword_co_occurrence(s, d):
    return co.co_occurrence(ad.paper_keywords(s, d)).select("a", "b", "shared", F.round("strength", 6).alias("strength"))


def agg6_concept_co_occurrence(s, d):
    c = store.concept_rows(ad.cards(s, d)).withColumn("folder", F.col("card_id") % 97)
    return co.co_occurrence(c, 1, False, "folder", "concept").select("a", "b", "shared", F.round("strength", 6).alias("strength"))


def agg7_concepts(s, d):
    return store.concept_rows(ad.cards(s, d)).groupBy("concept").agg(F.count("*").alias("n"))


def agg8_concept_hierarchy(s, d):
    return store.concept_hierarchy(store.concept_rows(ad.cards(s, d))).select("domain", "card_type", F.array_join("concepts", "|").alias("concepts"))


def snk11_concept_table(s, d):
    return store.concept_table(store.concept_rows(ad.cards(s, d)))


def snk1_upsert(s, d):
    p = ad.papers(s, d)
    old = p.where("id % 2 = 0")
    new = p.where("id % 3 = 0").select("id", F.concat("title", F.lit(" v2")).alias("title"), F.lit(None).cast("long").alias("year"), "doi", F.lit(None).cast("string").alias("cite_key"), "file_path")
    return store.upsert_papers(old, new).groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum("year").alias("years"), F.count_if(F.col("title").endswith(" v2")).alias("v2"))


def snk2_partial_update(s, d):
    p = ad.papers(s, d)
    changes = p.where("id % 4 = 0").select("id", F.concat(F.lit("New "), "title").alias("title"), F.when(F.col("id") % 8 == 0, F.col("year") + 1).alias("year"))
    return store.update_fields(p, changes).select("id", "title", "year")


def snk3_delete_cascade(s, d):
    gone = ad.papers(s, d).where("id % 5 = 0").select("id")
    return store.delete_where(ad.bridge(s, d), gone, "paper_id")


def snk4_insert_missing(s, d):
    old = ad.table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("v"))
    new = ad.table(s, d, "documents").select(F.col("source").alias("name"), (F.col("doc_id") % 3).alias("v")).union(old.where("v < 5").select("name", F.lit(99).cast("long")))
    return store.insert_missing(old, new, "name")


def snk5_insert_or_replace(s, d):
    b = ad.bridge(s, d)
    new = b.where("card_id % 2 = 0").select("paper_id", "card_id", F.lit(1.0).alias("similarity"))
    return store.insert_or_replace(b, new, ["paper_id", "card_id"])


def snk7_import_outcomes(s, d):
    c = ad.cards(s, d).select("card_id", "zettel_id", "title")
    status = F.when(F.col("title").isNull() | (F.length("title") < 30), "parse_error").when(F.col("_k").isNotNull(), "duplicate").otherwise("inserted")
    known = c.where("card_id % 3 = 0").select(F.col("zettel_id").alias("_k"))
    return c.join(known, F.col("zettel_id") == F.col("_k"), "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def snk14_back_fill(s, d):
    p = ad.papers(s, d)
    entries = p.where("id % 2 = 1").select(F.upper("title").alias("title"), F.concat(F.lit("key"), F.col("id").cast("string")).alias("cite_key"))
    return store.back_fill_keys(p, entries).select("id", "cite_key")


def ent2_similar_titles(s, d):
    p = ad.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"))
    return co.similar_titles(p, 0.65).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"), "level", "common")


def jon11_author_year(s, d):
    p, a = ad.papers(s, d), ad.paper_authors(s, d)
    rows = p.join(a, F.col("id") == F.col("paper_id")).select("id", "year", F.col("author").alias("name"))
    left = rows.where("id % 50 = 1").select(F.col("id").alias("l"), "year", "name")
    return co.best_by_overlap(left, rows.where("id % 50 <> 1").select(F.col("id").alias("r"), "year", "name")).select("l", "r", F.round("overlap", 6).alias("overlap"))


def jon13_card_to_paper(s, d):
    p = ad.papers(s, d).where("cite_key <> ''").select(F.lower("cite_key").alias("k"), "id")
    p = p.groupBy("k").agg(F.max("id").alias("paper_id"))
    keys = ad.table(s, d, "customer").select("c_custkey", F.concat(F.lit("author"), F.col("c_custkey").cast("string"), F.lit("-"), (1992 + F.col("c_custkey") % 7).cast("string"), F.lit("-001")).alias("card"))
    k = keys.withColumn("k", F.regexp_extract("card", r"^(.*)-\d{3}$", 1))
    return k.join(p, "k", "left").select("card", "paper_id", F.when(F.col("paper_id").isNull(), "failed").otherwise("linked").alias("status"))


def set5_sync_merge(s, d):
    p = ad.papers(s, d).select("id", "title", "cite_key")
    bib = p.where("id % 2 = 0").select("id", F.upper("title").alias("b_title"), F.when(F.col("id") % 4 == 0, "").otherwise(F.lit("bibkey")).alias("b_key"))
    return p.join(bib, "id", "left").select("id", F.coalesce(F.nullif("b_title", F.lit("")), "title").alias("title"), F.coalesce(F.nullif("b_key", F.lit("")), "cite_key").alias("cite_key"))


def agg22_reading_order(s, d):
    e = ad.bridge(s, d).groupBy("paper_id").agg(F.count("*").alias("n"))
    return ad.papers(s, d).where("id < 400").join(e, F.col("id") == F.col("paper_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).orderBy("n", "id").limit(50)


def agg22_reading_order_all(s, d):
    e = ad.bridge(s, d).groupBy("paper_id").agg(F.count("*").alias("n"))
    return ad.papers(s, d).join(e, F.col("id") == F.col("paper_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).orderBy("n", "id")


def agg21_group_concat(s, d):
    return ad.cards(s, d).groupBy("folder").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("card_id")), ",").alias("ids"))


P, A, K, C, B = ad.PAPERS, ad.AUTHORS, ad.KEYWORDS, ad.CARDS, ad.BRIDGE
CONCEPTS = """concepts AS (SELECT card_id, paper_id, domain, card_type, substr(trim(string_split(core_concept, '.')[1]), 1, 100) AS concept FROM cards
 WHERE length(substr(trim(string_split(core_concept, '.')[1]), 1, 100)) > 5
 UNION ALL SELECT card_id, paper_id, domain, card_type, t FROM (SELECT *, unnest(tags) AS t FROM cards) WHERE length(t) > 2)"""

ORACLE = {
    "src1_scan": f"WITH {P} SELECT id, title, year FROM papers",
    "top1_newest_page": f"WITH {P} SELECT id, title FROM papers ORDER BY id DESC LIMIT 10 OFFSET 20",
    "flt1_paper_by_id": f"WITH {P} SELECT * FROM papers WHERE id = 7",
    "flt2_paper_by_doi": f"WITH {P} SELECT id, doi FROM papers WHERE contains(doi, '10.1000/7') ORDER BY (doi <> '10.1000/7')::int, id LIMIT 1",
    "flt3_cite_key_cascade": f"""WITH {P}, w AS (SELECT DISTINCT lower(cite_key) AS wanted FROM papers WHERE id % 10 = 2 AND cite_key <> '' UNION SELECT DISTINCT replace(cite_key, '-', '_') FROM papers WHERE id % 10 = 3 AND cite_key <> ''),
 h AS (SELECT wanted, id, cite_key, CASE WHEN lower(cite_key) = lower(wanted) THEN 1 ELSE 2 END AS tier FROM w JOIN papers ON cite_key <> '' AND regexp_replace(lower(cite_key), '[-_\\s]', '', 'g') = regexp_replace(lower(wanted), '[-_\\s]', '', 'g'))
 SELECT wanted, id, cite_key, tier FROM h QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY tier, id) = 1""",
    "flt4_missing_cite_key": f"WITH {P} SELECT id, cite_key FROM papers WHERE cite_key IS NULL OR cite_key = ''",
    "flt6_new_files": f"""WITH {P}, f AS (SELECT file_path, title FROM papers WHERE id % 4 < 2 UNION ALL SELECT '/new' || file_path, title || CASE WHEN id % 2 = 0 THEN ' ' ELSE ' revised' END FROM papers WHERE id % 4 IN (0, 3))
 SELECT * FROM f WHERE file_path NOT IN (SELECT file_path FROM papers) AND lower(trim(title)) NOT IN (SELECT lower(trim(title)) FROM papers)""",
    "jon1_cards_of_papers": f"WITH {P}, {C}, {B} SELECT b.paper_id, b.card_id, b.similarity, p.title AS paper_title, c.zettel_id, c.title AS card_title FROM bridge b JOIN papers p ON p.id = b.paper_id JOIN cards c ON c.card_id = b.card_id WHERE similarity >= 0.4",
    "agg3_card_stats": f"""WITH {P}, {C}, {B}, x AS (SELECT p.id AS paper_id, count(DISTINCT c.card_id) AS card_count, count(DISTINCT b.card_id) AS linked_count FROM papers p LEFT JOIN cards c ON c.paper_id = p.id LEFT JOIN bridge b ON b.paper_id = p.id GROUP BY p.id)
 SELECT *, least(100, 5 * card_count + 5 * linked_count) AS completeness FROM x WHERE card_count > 0 OR linked_count > 0""",
    "agg3_card_stats_strict": f"""WITH {P}, {C}, {B}, x AS (SELECT p.id AS paper_id, count(c.card_id) AS card_count, count(DISTINCT b.card_id) AS linked FROM papers p LEFT JOIN cards c ON c.paper_id = p.id LEFT JOIN bridge b ON b.paper_id = p.id GROUP BY p.id)
 SELECT paper_id, card_count FROM x WHERE card_count > 0 OR linked > 0""",
    "jon5_papers_without_cards": f"WITH {P}, {C}, {B} SELECT p.id, p.title FROM papers p WHERE NOT EXISTS (SELECT 1 FROM cards c WHERE c.paper_id = p.id) AND NOT EXISTS (SELECT 1 FROM bridge b WHERE b.paper_id = p.id)",
    "jon6_cards_of_recent_papers": f"WITH {P}, {C} SELECT card_id, paper_id FROM cards WHERE paper_id IN (SELECT id FROM papers WHERE year >= 1997)",
    "agg1_store_statistics": f"WITH {P}, {C}, {B} SELECT (SELECT count(*) FROM papers) AS papers, (SELECT count(doi) FROM papers) AS with_doi, (SELECT count(*) FROM cards) AS cards, (SELECT count(DISTINCT folder) FROM cards) AS folders, (SELECT count(DISTINCT domain) FROM cards) AS domains, (SELECT count(*) FROM bridge) AS links",
    "agg2_paper_summary": f"""WITH {C}, x AS (SELECT paper_id, count(*) AS cards, count(*) FILTER (card_type = 'concept') AS concept, count(*) FILTER (card_type = 'method') AS method, count(*) FILTER (card_type = 'finding') AS finding FROM cards WHERE paper_id IS NOT NULL GROUP BY paper_id),
 t AS (SELECT paper_id, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM (SELECT paper_id, unnest(tags) AS t FROM cards WHERE paper_id IS NOT NULL) GROUP BY paper_id)
 SELECT x.*, least(100, least(100, 5 * cards) + CASE WHEN concept > 0 THEN 10 ELSE 0 END + CASE WHEN method > 0 THEN 10 ELSE 0 END + CASE WHEN finding > 0 THEN 10 ELSE 0 END) AS completeness, t.tags FROM x JOIN t USING (paper_id)""",
    "agg4_co_authors": f"WITH {A} SELECT x.author AS a, y.author AS b, count(*) AS shared, string_agg(x.paper_id::VARCHAR, ',' ORDER BY x.paper_id) AS papers FROM paper_authors x JOIN paper_authors y ON x.paper_id = y.paper_id AND x.author < y.author GROUP BY 1, 2 HAVING count(*) >= 2",
    "agg5_keyword_co_occurrence": f"""WITH {K}, f AS (SELECT keyword, count(*) AS f FROM paper_keywords GROUP BY 1), d AS (SELECT DISTINCT * FROM paper_keywords), p AS (SELECT x.keyword AS a, y.keyword AS b, count(*) AS shared FROM d x JOIN d y ON x.paper_id = y.paper_id AND x.keyword < y.keyword GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT a, b, shared, round(shared / greatest(u.f, v.f), 6) AS strength FROM p JOIN f u ON u.keyword = a JOIN f v ON v.keyword = b""",
    "agg6_concept_co_occurrence": f"""WITH {C}, {CONCEPTS}, d AS (SELECT DISTINCT card_id % 97 AS g, concept FROM concepts), f AS (SELECT concept, count(*) AS f FROM d GROUP BY 1), p AS (SELECT x.concept AS a, y.concept AS b, count(*) AS shared FROM d x JOIN d y ON x.g = y.g AND x.concept < y.concept GROUP BY 1, 2)
 SELECT a, b, shared, round(shared / greatest(u.f, v.f), 6) AS strength FROM p JOIN f u ON u.concept = a JOIN f v ON v.concept = b""",
    "agg7_concepts": f"WITH {C}, {CONCEPTS} SELECT concept, count(*) AS n FROM concepts GROUP BY 1",
    "agg8_concept_hierarchy": f"WITH {C}, {CONCEPTS} SELECT domain, card_type, string_agg(DISTINCT concept, '|' ORDER BY concept) AS concepts FROM concepts GROUP BY 1, 2",
    "snk11_concept_table": f"""WITH {C}, {CONCEPTS}, m AS (SELECT concept, domain, count(*) AS n FROM concepts GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY concept ORDER BY count(*) DESC, domain) = 1)
 SELECT c.concept, count(*) AS frequency, count(DISTINCT paper_id) AS papers, any_value(m.domain) AS main_domain FROM concepts c JOIN m ON m.concept = c.concept GROUP BY 1""",
    "snk1_upsert": f"""WITH {P}, o AS (SELECT * FROM papers WHERE id % 2 = 0), n AS (SELECT * FROM papers WHERE id % 3 = 0), u AS (SELECT o.*, n.id IS NOT NULL AS hit FROM o LEFT JOIN n ON n.id = o.id)
 SELECT CASE WHEN hit THEN 'updated' ELSE 'kept' END AS action, count(*) AS n, count(DISTINCT id) AS ids, sum(year)::BIGINT AS years, count(*) FILTER (hit) AS v2 FROM u GROUP BY 1
 UNION ALL SELECT 'inserted', count(*), count(*), NULL, count(*) FROM n WHERE id % 2 <> 0""",
    "snk2_partial_update": f"WITH {P} SELECT id, CASE WHEN id % 4 = 0 THEN 'New ' || title ELSE title END AS title, CASE WHEN id % 8 = 0 THEN year + 1 ELSE year END AS year FROM papers",
    "snk3_delete_cascade": f"WITH {P}, {B} SELECT * FROM bridge WHERE paper_id NOT IN (SELECT id FROM papers WHERE id % 5 = 0)",
    "snk4_insert_missing": """SELECT n_name AS name, n_nationkey::BIGINT AS v, 'old' AS status FROM nation UNION ALL SELECT source, min(doc_id % 3), 'inserted' FROM documents WHERE source NOT IN (SELECT n_name FROM nation) GROUP BY source""",
    "snk5_insert_or_replace": f"WITH {B} SELECT paper_id, card_id, CASE WHEN card_id % 2 = 0 THEN 1.0 ELSE max(similarity) END AS similarity FROM bridge GROUP BY paper_id, card_id",
    "snk7_import_outcomes": f"WITH {C} SELECT CASE WHEN title IS NULL OR length(title) < 30 THEN 'parse_error' WHEN card_id % 3 = 0 THEN 'duplicate' ELSE 'inserted' END AS status, count(*) AS n FROM cards GROUP BY 1",
    "snk14_back_fill": f"WITH {P} SELECT id, CASE WHEN (cite_key IS NULL OR cite_key = '') AND id % 2 = 1 THEN 'key' || id ELSE cite_key END AS cite_key FROM papers",
    "ent2_similar_titles": """WITH t AS (SELECT DISTINCT p_partkey AS id, unnest(string_split_regex(lower(concat_ws(' ', p_name, p_brand, p_type)), '\\s+')) AS token FROM part), n AS (SELECT id, count(*) AS n FROM t GROUP BY 1),
 p AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS k, string_agg(x.token, ' ' ORDER BY x.token) AS common FROM t x JOIN t y ON x.token = y.token AND x.id < y.id GROUP BY 1, 2),
 s AS (SELECT id_a, id_b, k / (u.n + v.n - k) AS s, common FROM p JOIN n u ON u.id = id_a JOIN n v ON v.id = id_b)
 SELECT id_a, id_b, round(s, 6) AS similarity, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.7 THEN 'medium' ELSE 'low' END AS level, common FROM s WHERE s >= 0.65""",
    "jon11_author_year": f"""WITH {P}, {A}, r AS (SELECT id, year, author FROM papers JOIN paper_authors ON id = paper_id), n AS (SELECT id, count(*) AS n FROM r GROUP BY 1),
 m AS (SELECT x.id AS l, y.id AS r, count(*) AS k FROM r x JOIN r y ON x.year = y.year AND x.author = y.author WHERE x.id % 50 = 1 AND y.id % 50 <> 1 GROUP BY 1, 2)
 SELECT l, r, round(k / (u.n + v.n - k), 6) AS overlap FROM m JOIN n u ON u.id = l JOIN n v ON v.id = r QUALIFY row_number() OVER (PARTITION BY l ORDER BY k / (u.n + v.n - k) DESC, r) = 1""",
    "jon13_card_to_paper": f"""WITH {P}, k AS (SELECT lower(cite_key) AS k, max(id) AS paper_id FROM papers WHERE cite_key <> '' GROUP BY 1), c AS (SELECT 'author' || c_custkey || '-' || (1992 + c_custkey % 7) AS k FROM customer)
 SELECT c.k || '-001' AS card, paper_id, CASE WHEN paper_id IS NULL THEN 'failed' ELSE 'linked' END AS status FROM c LEFT JOIN k ON k.k = c.k""",
    "set5_sync_merge": f"WITH {P} SELECT id, CASE WHEN id % 2 = 0 THEN upper(title) ELSE title END AS title, CASE WHEN id % 2 = 0 AND id % 4 <> 0 THEN 'bibkey' ELSE cite_key END AS cite_key FROM papers",
    "agg22_reading_order": f"WITH {P}, {B} SELECT id, (SELECT count(*) FROM bridge WHERE paper_id = id) AS n FROM papers WHERE id < 400 ORDER BY n, id LIMIT 50",
    "agg21_group_concat": f"WITH {C} SELECT folder, count(*) AS n, string_agg(card_id::VARCHAR, ',' ORDER BY card_id) AS ids FROM cards GROUP BY 1",
}
#: The SQL of agg22 holds a part of the table; the whole one has none.
QUERIES = {k: v for k, v in globals().items() if k in ORACLE or k == "agg22_reading_order_all"}
