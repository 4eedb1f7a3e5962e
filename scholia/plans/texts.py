"""Queries of search, relations, parsing, grounding and resolution, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import grounding, parse, relations, resolve, search, vectors
from scholia.plans import adapters as ad


def _r(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def txt1_paper_search(s, d):
    return _r(search.search(ad.table(s, d, "documents"), "the tion", "doc_id", ["text"], 20), "score")


def txt2_card_search(s, d):
    return _r(search.search(ad.cards(s, d), "the NOT tion", "card_id", ["title", "content"], 20, F.col("domain") == "CogSci"), "score")


def txt4_embedding_text(s, d):
    return search.embedding_text(ad.cards(s, d)).select("card_id", F.length("embedding_text").cast("long").alias("n"), F.md5("embedding_text").alias("digest"))


def txt5_estimate(s, d):
    return _r(search.embedding_estimate(ad.table(s, d, "documents"), "text"), "tokens", "seconds")


def _found(s, d):
    c = ad.cards(s, d).select("card_id")
    v = ad.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).join(c, F.col("id") == F.col("card_id"), "left_semi")
    return vectors.nearest(v, v, 10).select("query", "id", "similarity")


def set2_unordered_pairs(s, d):
    return _r(relations.unordered_pairs(_found(s, d)), "similarity")


def rel1_relations(s, d):
    return _r(relations.relate(ad.cards(s, d), _found(s, d), 0.2), "similarity", "confidence")


def rel2_types(s, d):
    return relations.relate(ad.cards(s, d), _found(s, d), 0.1).select("card1", "card2", "relation_type")


def rel7_weighted_concepts(s, d):
    return relations.weighted_concepts(ad.cards(s, d).select("card_id", "tags", "core_concept", "title"))


def rel10_domain_similarity(s, d):
    c = ad.cards(s, d).select("domain").distinct()
    return c.select(F.col("domain").alias("a")).crossJoin(c.select(F.col("domain").alias("b"))).select("a", "b", relations.domain_similarity(F.col("a"), F.col("b")).alias("similarity"))


def rel11_network(s, d):
    return relations.network_nodes(relations.relate(ad.cards(s, d), _found(s, d), 0.1), 0.1)


def top4_suggested_links(s, d):
    return _r(relations.suggested_links(relations.relate(ad.cards(s, d), _found(s, d), 0.1), 0.1), "confidence").select("card1", "card2", "relation_type", "confidence", "place")


def _linked(s, d):
    """Card texts with a link section."""
    k = F.col("doc_id")
    year = (1990 + k % 30).cast("string")
    body = F.concat(F.lit("# x\n\n## 連結網絡\n\n**導向** → [[Doe-"), year, F.lit("-"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("]], [[van-Rooij-"), year, F.lit("a-001]]\n**對比** ↔ [[CogSci-20251028-"), F.lpad((k % 100).cast("string"), 3, "0"), F.lit("]]\n\n## 來源\ntext [[Doe2009002]] and [[Wu202010]]"))
    return ad.table(s, d, "documents").select(k.alias("card_id"), body.alias("content"))


def prs2_card_links(s, d):
    return parse.card_links(_linked(s, d))


def prs9_fix_links(s, d):
    return _linked(s, d).select("card_id", F.md5(parse.fix_links(F.col("content"))).alias("digest"))


def prs10_dois(s, d):
    k = F.col("doc_id").cast("string")
    t = F.concat(F.lit("see https://doi.org/10.1000/abc."), k, F.lit("). Also doi:10.5555/x"), k, F.lit(", 10.12/no and 10.1000/abc."), k, F.lit("."))
    return ad.table(s, d, "documents").select("doc_id", F.array_join(parse.dois(t), " ").alias("dois"))


def src10_source_type(s, d):
    p = ad.table(s, d, "pages")
    u = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://arxiv.org/abs/"), F.col("page_id"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/tmp/"), F.col("page_id"), F.lit(".PDF"))).when(F.col("page_id") % 4 == 2, F.lit("plain")).otherwise(F.col("url"))
    return p.select("page_id", parse.source_type(u).alias("source_type"))


def src8_web_pages(s, d):
    return parse.web_pages(ad.table(s, d, "pages"), (4000, 300)).select("page_id", "source_type", F.col("char_count").cast("long").alias("char_count"), "truncated", F.md5("full_text").alias("digest"))


def src11_resolve_source(s, d):
    k = F.col("doc_id")
    rows = ad.table(s, d, "documents").select(k.alias("id"), F.when(k % 5 == 0, F.col("text")).alias("from_kb"), F.when(k % 3 == 0, F.concat(F.lit("pdf "), "text")).otherwise("").alias("pdf_text"), F.when(k % 2 == 0, "page").alias("url_text"), F.lit("raw").alias("content"))
    return parse.resolve_source(rows, 200).select("id", F.md5("text").alias("digest"), "origin", "truncated")


def src12_file_names(s, d):
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Smith_Jones_1999_On_Notes_"), k)).when(k % 4 == 1, F.concat(F.lit("Doe et al. (2004) Cards "), k)).when(k % 4 == 2, F.concat(F.lit("Cards "), k, F.lit(" - Roe (2011)"))).otherwise(F.concat(F.lit("scan-2015_"), k))
    return parse.file_names(ad.table(s, d, "orders").select(name.alias("name")))


def src5_crossref(s, d):
    k = F.col("o_orderkey")
    rec = F.concat(F.lit('{"DOI":"10.1/'), k, F.lit('","title":["T '), k, F.lit('"],"author":[{"given":"A","family":"B"},{"family":"C"}],'), F.when(k % 2 == 0, '"published-print":{"date-parts":[[2001,5]]},').otherwise(""), F.lit('"published-online":{"date-parts":[[2002]]},"abstract":"<jats:p>'), F.when(k % 3 == 0, "short").otherwise("a longer abstract"), F.lit('</jats:p>"}'))
    return parse.crossref(ad.table(s, d, "orders").select(k.alias("id"), rec.alias("json"))).withColumn("authors", F.array_join("authors", "; "))


def pip8_people(s, d):
    k = F.col("doc_id")
    t = F.when(k % 3 == 0, '["A B", "C"]').when(k % 3 == 1, "Doe, Jane and Roe, Max").otherwise("X, Y ,Z")
    return ad.table(s, d, "documents").select("doc_id", F.array_join(parse.people(t), "|").alias("people"))


def gnd2_benchmark_in_documents(s, d):
    docs = ad.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    bench = ad.table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    pairs = grounding.candidates(bench, docs).join(bench.select(F.col("id").alias("claim"), F.col("text").alias("core")), "claim").join(docs.select(F.col("id").alias("source"), F.col("text").alias("source_text")), "source", "left")
    return _r(grounding.ground_pairs(pairs, "core", "source_text", ("claim", "source")), "coverage").drop("span")


def gnd5_renumber(s, d):
    k = F.col("doc_id")
    disp = F.when(k % 5 == 0, "erase").when(k % 7 == 0, "quarantine").otherwise("keep")
    rows = ad.table(s, d, "documents").select(F.col("source").alias("cite_key"), k.alias("seq"), k.cast("string").alias("id"), disp.alias("disposition"), F.array((k + 20).cast("string"), F.lit("ghost")).alias("links"))
    return grounding.renumber(rows).withColumn("links", F.array_join("links", ","))


def ent3_duplicates(s, d):
    p = ad.papers(s, d).join(ad.paper_authors(s, d).groupBy(F.col("paper_id").alias("id")).agg(F.collect_set("author").alias("authors")), "id")
    return _r(resolve.duplicates(p), "score")


def ent5_match_chain(s, d):
    p = ad.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.array("p_brand").alias("authors"), (F.col("p_size") + 1970).alias("year"))
    left = p.where("id % 20 = 0").select(F.col("id").alias("l"), F.when(F.col("id") % 40 == 0, F.col("title")).otherwise(F.concat(F.lit("a "), "title")).alias("title"), "authors", "year")
    return _r(resolve.match_chain(left, p.withColumnRenamed("id", "r")), "score")


def ent10_cite_key(s, d):
    k = F.col("o_orderkey")
    rows = ad.table(s, d, "orders").select(k.alias("id"), F.when(k % 7 == 0, F.concat(F.lit("m"), k)).alias("manual"), F.when(k % 5 == 0, F.concat(F.lit("b"), k)).otherwise("").alias("bibtex"), F.when(k % 3 == 0, F.concat(F.lit("d"), k)).alias("doi"), F.concat(F.lit("t"), k).alias("timestamp"))
    return resolve.resolve_key(rows)


def ent11_url_slug(s, d):
    return ad.table(s, d, "pages").select("page_id", resolve.slug(F.col("url")).alias("slug"))


def prs1_card_fields(s, d):
    k = F.col("doc_id")
    body = F.concat(F.lit("---\ntitle: \"T "), k.cast("string"), F.lit("\"\ntype: method\ntags: [a, b]\n---\n# Head\n> **核心**: \"core "), k.cast("string"), F.lit("\"\n\n## 說明\nwhy\n\n## 個人筆記\n**[AI Agent]**: ai\n**[Human]**: me\n"))
    return parse.card_fields(ad.table(s, d, "documents").select(k.alias("card_id"), body.alias("content"))).withColumn("tags", F.array_join("tags", ","))


def prs5_paper_structure(s, d):
    k = F.col("doc_id")
    text = F.concat(F.lit("x\nA title of paper "), k.cast("string"), F.lit("\nAbstract: about things.\n\nKeywords: a, b; c\nIntroduction\ntext\nMethods\nmore\nReferences\n[1]"))
    r = parse.paper_structure(ad.table(s, d, "documents").select("doc_id", text.alias("t")), "doc_id", "t")
    return r.withColumn("keywords", F.array_join("keywords", "|")).withColumn("sections", F.array_join("sections", "|"))


def src7_markdown_table(s, d):
    k = F.col("n_nationkey").cast("string")
    return ad.table(s, d, "nation").select("n_nationkey", parse.markdown_table(F.array(F.array(F.lit("id"), F.lit(" na\nme ")), F.array(F.lit(None).cast("string"), F.lit("")), F.array(k, F.col("n_name")))).alias("table"))


def agg10_bibliography_statistics(s, d):
    k = F.col("o_orderkey")
    rows = ad.table(s, d, "orders").select(F.col("o_orderstatus").alias("entry_type"), F.when(k % 3 == 0, k.cast("string")).alias("doi"), F.when(k % 2 == 0, "").otherwise("x").alias("abstract"), F.when(k % 5 != 0, 2000).alias("year"), F.when(k % 7 == 0, F.array(F.lit("k"))).otherwise(F.array().cast("array<string>")).alias("keywords"))
    return _r(parse.bibliography_statistics(rows), "doi_percent", "abstract_percent", "year_percent", "keywords_percent")


TOK = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
FOUND = """c0 AS (SELECT doc_id FROM documents JOIN labels USING (doc_id)), v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM c0)),
 nn AS (SELECT q.id AS query, x.id AS id, list_cosine_similarity(q.v, x.v) AS similarity, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, x.v) DESC, x.id) AS k FROM v q JOIN v x ON q.id <> x.id QUALIFY k <= 10),
 pairs AS (SELECT query AS card1, id AS card2, similarity FROM nn QUALIFY row_number() OVER (PARTITION BY least(query, id), greatest(query, id) ORDER BY query) = 1)"""


def _any(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


TYPES = f"""CASE WHEN {_any('a.l', relations.CONTRAST)} OR {_any('b.l', relations.CONTRAST)} THEN 'contrasts_with' WHEN {_any('a.l', relations.SUPERCLASS)} THEN 'superclass_of' WHEN {_any('a.l', relations.SUBCLASS)} THEN 'subclass_of'
 WHEN similarity >= 0.5 AND similarity < 0.7 AND {_any('a.l', relations.DIRECTIONAL)} THEN 'leads_to' ELSE 'related_to' END"""
WORDS = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}'))"
CONCEPTS = f"""wc AS (SELECT card_id, concept, max(weight) AS weight FROM (SELECT card_id, lower(trim(unnest(tags))) AS concept, 1.0 AS weight FROM cards UNION ALL SELECT card_id, unnest({WORDS.format('core_concept')}), 0.9 FROM cards UNION ALL SELECT card_id, unnest({WORDS.format('title')}), 0.7 FROM cards) WHERE concept <> '' GROUP BY 1, 2)"""
DOM = "CASE WHEN {0} = {1} THEN 1.0 " + " ".join(f"WHEN ({{0}} = '{p}' AND {{1}} = '{q}') OR ({{0}} = '{q}' AND {{1}} = '{p}') THEN {v}" for (p, q), v in relations.DOMAINS.items()) + " ELSE 0.3 END"
RELATED = f"""l AS (SELECT *, lower(content) AS l FROM cards), {CONCEPTS}, tot AS (SELECT card_id, sum(weight) AS t FROM wc GROUP BY 1),
 ov AS (SELECT card1, card2, sum(least(x.weight, y.weight)) AS met, count(*) AS shared FROM pairs JOIN wc x ON x.card_id = card1 JOIN wc y ON y.card_id = card2 AND y.concept = x.concept GROUP BY 1, 2),
 rel AS (SELECT p.card1, p.card2, similarity, {TYPES} AS relation_type, 0.4 * similarity + 0.2 * least(coalesce(met / ((coalesce(t1.t, 1) + coalesce(t2.t, 1)) / 2), 0), 1) + 0.1 * {DOM.format('a.domain', 'b.domain')} AS confidence, coalesce(shared, 0) AS shared, 0.0 AS link_strength
 FROM pairs p JOIN l a ON a.card_id = p.card1 JOIN l b ON b.card_id = p.card2 LEFT JOIN ov USING (card1, card2) LEFT JOIN tot t1 ON t1.card_id = p.card1 LEFT JOIN tot t2 ON t2.card_id = p.card2)"""


LINKED = """linked AS (SELECT doc_id AS card_id, '# x' || chr(10) || chr(10) || '## 連結網絡' || chr(10) || chr(10) || '**導向** → [[Doe-' || (1990 + doc_id % 30) || '-' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || ']], [[van-Rooij-' || (1990 + doc_id % 30) || 'a-001]]' || chr(10) || '**對比** ↔ [[CogSci-20251028-' || lpad((doc_id % 100)::VARCHAR, 3, '0') || ']]' || chr(10) || chr(10) || '## 來源' || chr(10) || 'text {0} and {1}' AS content FROM documents)"""
ORACLE = {
    "txt1_paper_search": f"""WITH t AS (SELECT doc_id AS id, {TOK.format('text')} AS toks FROM documents), c AS (SELECT id, len(toks) AS dl, len(list_filter(toks, lambda x: x = 'the')) AS c0, len(list_filter(toks, lambda x: x = 'tion')) AS c1 FROM t),
 s AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (c0 > 0) AS d0, count(*) FILTER (c1 > 0) AS d1 FROM c)
 SELECT id AS doc_id, round(ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * c0 * 2.2 / (c0 + 1.2 * (0.25 + 0.75 * dl / mean)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * c1 * 2.2 / (c1 + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM c, s WHERE c0 > 0 AND c1 > 0 ORDER BY score DESC, id LIMIT 20""",
    "txt2_card_search": f"""WITH {ad.CARDS}, t AS (SELECT card_id AS id, list_concat({TOK.format('title')}, {TOK.format('content')}) AS toks FROM cards WHERE domain = 'CogSci'), c AS (SELECT id, len(toks) AS dl, len(list_filter(toks, lambda x: x = 'the')) AS c0, list_contains(toks, 'tion') AS bad FROM t),
 s AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (c0 > 0) AS d0 FROM c)
 SELECT id AS card_id, round(ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * c0 * 2.2 / (c0 + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM c, s WHERE c0 > 0 AND NOT bad ORDER BY score DESC, id LIMIT 20""",
    "txt4_embedding_text": f"WITH {ad.CARDS}, e AS (SELECT card_id, concat_ws(chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN core_concept <> '' THEN 'Core: ' || core_concept END, 'Tags: ' || array_to_string(tags, ', '), CASE WHEN content <> '' THEN 'Content: ' || substr(content, 1, 1500) END) AS t FROM cards) SELECT card_id, length(t) AS n, md5(t) AS digest FROM e",
    "txt5_estimate": "SELECT count(*) AS texts, round(sum(length(text)) * 1.3::DOUBLE, 6) AS tokens, round(count(*) * 8.6::DOUBLE, 6) AS seconds FROM documents",
    "set2_unordered_pairs": f"WITH {FOUND} SELECT card1, card2, round(similarity, 6) AS similarity FROM pairs",
    "rel1_relations": f"WITH {ad.CARDS}, {FOUND}, {RELATED} SELECT card1, card2, round(similarity, 6) AS similarity, relation_type, round(confidence, 6) AS confidence, shared, link_strength FROM rel WHERE similarity >= 0.2",
    "rel2_types": f"WITH {ad.CARDS}, {FOUND}, {RELATED} SELECT card1, card2, relation_type FROM rel WHERE similarity >= 0.1",
    "rel7_weighted_concepts": f"WITH {ad.CARDS}, {CONCEPTS} SELECT card_id, concept, weight::DOUBLE AS weight FROM wc",
    "rel10_domain_similarity": f"WITH {ad.CARDS}, c AS (SELECT DISTINCT domain FROM cards) SELECT a.domain AS a, b.domain AS b, ({DOM.format('a.domain', 'b.domain')})::DOUBLE AS similarity FROM c a, c b",
    "rel11_network": f"""WITH {ad.CARDS}, {FOUND}, {RELATED}, e AS (SELECT * FROM rel WHERE similarity >= 0.1 AND confidence >= 0.1), x AS (SELECT card1 AS node, (relation_type <> 'based_on')::INT AS o, (relation_type <> 'leads_to')::INT AS i FROM e UNION ALL SELECT card2, (relation_type <> 'leads_to')::INT, (relation_type <> 'based_on')::INT FROM e)
 SELECT node, count(*) AS degree, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM x GROUP BY 1""",
    "top4_suggested_links": f"WITH {ad.CARDS}, {FOUND}, {RELATED}, t AS (SELECT * FROM rel WHERE similarity >= 0.1 AND confidence >= 0.1 ORDER BY confidence DESC, card1, card2 LIMIT 50) SELECT card1, card2, relation_type, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY relation_type ORDER BY confidence DESC, card1, card2) AS place FROM t QUALIFY place <= 20",
    "prs2_card_links": """SELECT doc_id AS card_id, '導向' AS relation, 0 AS position, 'Doe-' || (1990 + doc_id % 30) || '-' || lpad((doc_id % 1000)::VARCHAR, 3, '0') AS target FROM documents UNION ALL SELECT doc_id, '導向', 1, 'van-Rooij-' || (1990 + doc_id % 30) || 'a-001' FROM documents UNION ALL SELECT doc_id, '對比', 0, 'CogSci-20251028-' || lpad((doc_id % 100)::VARCHAR, 3, '0') FROM documents""",
    "prs9_fix_links": f"WITH {LINKED.format('[[Doe-2009-002]]', '[[Wu-2020-010]]')} SELECT card_id, md5(content) AS digest FROM linked",
    "prs10_dois": "SELECT doc_id, array_to_string(list_sort(['10.1000/abc.' || doc_id, '10.5555/x' || doc_id]), ' ') AS dois FROM documents",
    "src10_source_type": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'academic' WHEN 1 THEN 'pdf' WHEN 2 THEN 'text' ELSE 'web' END AS source_type FROM pages",
    "src11_resolve_source": """WITH x AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN text WHEN doc_id % 3 = 0 THEN 'pdf ' || text WHEN doc_id % 2 = 0 THEN 'page' ELSE 'raw' END AS t, CASE WHEN doc_id % 5 = 0 THEN 'kb' WHEN doc_id % 3 = 0 THEN 'pdf' WHEN doc_id % 2 = 0 THEN 'url' ELSE 'raw' END AS origin FROM documents)
 SELECT id, md5(substr(t, 1, 200)) AS digest, origin, length(t) > 200 AS truncated FROM x""",
    "src12_file_names": """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Smith_Jones_1999_On_Notes_' || o_orderkey WHEN 1 THEN 'Doe et al. (2004) Cards ' || o_orderkey WHEN 2 THEN 'Cards ' || o_orderkey || ' - Roe (2011)' ELSE 'scan-2015_' || o_orderkey END AS name,
 CASE o_orderkey % 4 WHEN 0 THEN 'Smith' WHEN 1 THEN 'Doe' WHEN 2 THEN 'Roe' END AS author, CASE o_orderkey % 4 WHEN 0 THEN 1999 WHEN 1 THEN 2004 WHEN 2 THEN 2011 END AS year,
 CASE o_orderkey % 4 WHEN 0 THEN 'On Notes ' || o_orderkey WHEN 1 THEN 'Cards ' || o_orderkey WHEN 2 THEN 'Cards ' || o_orderkey ELSE 'scan 2015 ' || o_orderkey END AS title FROM orders""",
    "src5_crossref": "SELECT o_orderkey AS id, '10.1/' || o_orderkey AS doi, 'T ' || o_orderkey AS title, 'A B; C' AS authors, CASE WHEN o_orderkey % 2 = 0 THEN 2001 ELSE 2002 END AS year, CASE WHEN o_orderkey % 3 <> 0 THEN 'a longer abstract' END AS abstract FROM orders",
    "pip8_people": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'A B|C' WHEN 1 THEN 'Doe, Jane|Roe, Max' ELSE 'X|Y|Z' END AS people FROM documents",
    "gnd5_renumber": """WITH x AS (SELECT source AS cite_key, doc_id AS seq, CASE WHEN doc_id % 5 = 0 THEN 'erase' WHEN doc_id % 7 = 0 THEN 'quarantine' ELSE 'keep' END AS disposition FROM documents),
 n AS (SELECT *, cite_key || CASE WHEN disposition = 'quarantine' THEN '-cjk-' ELSE '-' END || CASE WHEN row_number() OVER w < 100 THEN lpad((row_number() OVER w)::VARCHAR, 3, '0') ELSE left((row_number() OVER w)::VARCHAR, 3) END AS new_id FROM x WHERE disposition <> 'erase' WINDOW w AS (PARTITION BY cite_key, disposition ORDER BY seq))
 SELECT a.cite_key, a.seq, a.new_id, a.disposition, coalesce(b.new_id, '') AS links FROM n a LEFT JOIN n b ON b.seq = a.seq + 20 AND b.disposition = 'keep' AND b.cite_key = a.cite_key""",
    "ent10_cite_key": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'm' WHEN o_orderkey % 5 = 0 THEN 'b' WHEN o_orderkey % 3 = 0 THEN 'd' ELSE 't' END || o_orderkey AS cite_key, CASE WHEN o_orderkey % 7 = 0 THEN 'manual' WHEN o_orderkey % 5 = 0 THEN 'bibtex' WHEN o_orderkey % 3 = 0 THEN 'doi' ELSE 'timestamp' END AS source,
 CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 1.0 WHEN o_orderkey % 3 = 0 THEN 0.9 ELSE 0.1 END::DOUBLE AS confidence FROM orders""",
    "prs1_card_fields": "SELECT doc_id AS card_id, doc_id::VARCHAR AS zettel_id, 'T ' || doc_id AS title, 'method' AS card_type, 'core ' || doc_id AS core_concept, 'why' AS description, '' AS domain, 'a,b' AS tags, NULL::VARCHAR AS source_info, 'ai' AS ai_notes, 'me' AS human_notes FROM documents",
    "prs5_paper_structure": "SELECT doc_id, 'A title of paper ' || doc_id AS title, 'about things.' AS abstract, 'a|b|c' AS keywords, 'Introduction|Methods|References' AS sections, true AS references_found FROM documents",
    "src7_markdown_table": "SELECT n_nationkey, '| id | na me |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |' AS \"table\" FROM nation",
    "agg10_bibliography_statistics": """WITH b AS (SELECT o_orderstatus AS entry_type, count(*) AS total, count(*) FILTER (o_orderkey % 3 = 0) AS with_doi, count(*) FILTER (o_orderkey % 2 <> 0) AS with_abstract, count(*) FILTER (o_orderkey % 5 <> 0) AS with_year, count(*) FILTER (o_orderkey % 7 = 0) AS with_keywords FROM orders GROUP BY 1)
 SELECT *, round(with_doi * 100.0 / total, 6)::DOUBLE AS doi_percent, round(with_abstract * 100.0 / total, 6)::DOUBLE AS abstract_percent, round(with_year * 100.0 / total, 6)::DOUBLE AS year_percent, round(with_keywords * 100.0 / total, 6)::DOUBLE AS keywords_percent FROM b""",
    "ent11_url_slug": r"SELECT page_id, substr(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$|/+$', '', 'g'), '([^/]*)$', 1), '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 40) AS slug FROM pages",
}
QUERIES = {k: v for k, v in globals().items() if k in ORACLE or k in ("src8_web_pages", "gnd2_benchmark_in_documents", "ent3_duplicates", "ent5_match_chain")}
