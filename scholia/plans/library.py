"""Queries of links, imports, exports and networks with confidences, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import keys
from scholia.operators import export, graph, linking, network, store, usage
from scholia.plans import adapters as ad


def _bib(s, d):
    """Papers with citation keys of letters: a row for each part."""
    k = F.col("p_partkey")
    year = (1990 + k % 30).cast("long")
    key = F.concat(F.initcap(F.split("p_name", " ")[0]), F.lit("-"), year.cast("string"))
    return ad.table(s, d, "part").select(
        k.alias("id"), F.concat(F.initcap("p_name"), F.lit(" "), F.initcap("p_type"), F.lit(" study "), k.cast("string")).alias("title"), year.alias("year"), F.when(k % 4 != 0, key).alias("cite_key"))


def _noted(s, d):
    """Cards whose source lines name keys, other authors with keywords, or nothing."""
    k = F.col("c_custkey")
    seg = F.initcap("c_mktsegment")
    year = (1985 + k % 37).cast("string")
    info = F.when(k % 4 == 0, F.concat(F.lit('"Red'), year, F.lit('_Notes"'))).when(k % 4 == 1, F.concat(F.lit('"Nobody-'), year, F.lit("_"), seg, F.lit('_Widget_Promo"'))).when(k % 4 == 2, F.concat(F.lit('"Blue_'), year, F.lit('b_Ring_Economy"')))
    return ad.table(s, d, "customer").select(k.alias("card_id"), F.concat(F.lit("zettel_Small"), year, F.lit("a_2025")).alias("zettel_id"), info.alias("source_info"), "c_nationkey")


def _net(s, d):
    """A sparse network of customers: an edge for each urgent order."""
    n = ad.table(s, d, "customer").agg(F.count("*").alias("n"))
    o = ad.table(s, d, "orders").where("o_orderpriority = '1-URGENT'").crossJoin(F.broadcast(n))  # one row
    b = (F.col("o_orderkey") * 7) % F.col("n")
    e = o.select(F.least("o_custkey", b).alias("a"), F.greatest("o_custkey", b).alias("b"), F.round(F.col("o_totalprice") / 1000000, 4).alias("confidence"))
    return graph.cut(e.where("a != b").groupBy("a", "b").agg(F.max("confidence").alias("confidence")))


def _names(s, d):
    return ad.table(s, d, "customer").select(F.col("c_custkey").alias("node"), F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_name"), F.lit(" of the network")).alias("title"))


def _vec(s, d):
    return ad.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def flt5_cards_of_papers(s, d):
    return linking.cards_of_paper(ad.cards(s, d), ad.papers(s, d).where("year = 1995")).select("paper_id", "card_id")


def flt7_entries_by_doi(s, d):
    p = ad.papers(s, d)
    wanted = p.select(F.concat(F.when(F.col("id") % 2 == 0, "https://DOI.org/").otherwise(""), F.upper("doi")).alias("doi"))
    return linking.entries_by_doi(p.select("cite_key", "doi"), wanted)


def flt8_entries_by_key(s, d):
    p = _bib(s, d)
    wanted = p.select(F.when(F.col("id") % 3 == 0, F.lower("cite_key")).when(F.col("id") % 3 == 1, F.concat("cite_key", F.lit("?"))).otherwise(F.col("cite_key")).alias("key"))
    return linking.entries_by_key(p, wanted)


def jon2_papers_of_cards(s, d):
    return store.linked_cards(ad.papers(s, d), ad.bridge(s, d), ad.cards(s, d), 0.8).select("card_id", "paper_id", "paper_title", "similarity")


def jon8_exact_titles(s, d):
    last = linking.last_by_key(ad.table(s, d, "part"), F.lower("p_name"), "p_partkey")
    return ad.table(s, d, "part").join(last.select(F.col("_k"), F.col("p_partkey").alias("last")), F.lower("p_name") == F.col("_k")).select("p_partkey", "last")


def jon14_link_coverage(s, d):
    return linking.link_coverage(ad.cards(s, d), "domain")


def snk15_back_fill_by_title(s, d):
    e = _bib(s, d).select(F.concat(F.lit("new"), F.col("id").cast("string")).alias("cite_key"), F.upper("title").alias("title"), F.when(F.col("id") % 5 == 0, F.col("year") + 1).otherwise(F.col("year")).alias("year"))
    return linking.back_fill_by_title(_bib(s, d), e)[1]


def ent7_link_by_title(s, d):
    p = _bib(s, d)
    cards = ad.table(s, d, "supplier").join(p, F.col("s_suppkey") * 3 % 91 == F.col("id")).select(F.col("s_suppkey").alias("card_id"), F.concat(F.lit('"'), F.replace("title", F.lit("study"), F.lit("studies")), F.lit('" ('), F.col("year").cast("string"), F.lit(")")).alias("source_info"))
    return linking.link_by_title(cards, p).select("card_id", "paper_id", "status", F.round("score", 6).alias("score"))


def ent8_link_cards(s, d):
    return linking.link_cards(_noted(s, d), _bib(s, d)).select("card_id", "paper_id", "method", "status", F.round("score", 6).alias("score"))


def ent6_files_to_entries(s, d):
    e = _bib(s, d).select(F.col("id").alias("r"), F.coalesce("cite_key", F.lit("")).alias("cite_key"), "title", F.array("cite_key").alias("authors"), "year")
    k = F.col("s_suppkey")
    files = ad.table(s, d, "supplier").select(k.alias("l"), F.concat(F.lit("red-"), (1990 + k % 40).cast("string")).alias("name"), F.lit("Xyz").alias("title"), F.array(F.lit("Small-1999")).alias("authors"), (1990 + k % 40).cast("long").alias("year"))
    return linking.files_to_entries(files, e).select("l", "r", "method", F.round("score", 6).alias("score"))


def ent9_files_by_key(s, d):
    e = _bib(s, d).where("cite_key IS NOT NULL").select(F.col("id").alias("r"), "cite_key")
    f = ad.table(s, d, "nation").select(F.col("n_nationkey").alias("l"), F.concat(F.lit("Redd-"), (1990 + F.col("n_nationkey")).cast("string")).alias("key"))
    return linking.files_by_key(f, e).select("l", "r", F.round("score", 6).alias("score"))


def _incoming(s, d):
    c = ad.cards(s, d).select("card_id", "zettel_id", "title", "content")
    link = F.concat(F.lit("## 連結網絡\n\n**基於** → [["), F.regexp_replace(F.concat(F.initcap("c_mktsegment"), F.lit("-2020")), "[^A-Za-z0-9-]", ""), F.lit("-"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit("]]\n"))
    new = ad.table(s, d, "customer").select(
        F.col("c_custkey").cast("long").alias("card_id"), F.when(F.col("c_custkey") % 9 != 0, F.concat(F.col("c_mktsegment"), F.lit("-"), (F.col("c_custkey") % 300).cast("string"))).alias("zettel_id"),
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_name")).alias("title"), link.alias("content"))
    return c, new


def snk6_card_links(s, d):
    return linking.index_cards(*_incoming(s, d))[1].select("card_id", "relation", F.col("position").cast("long").alias("position"), "target")


def snk7_index_outcomes(s, d):
    return linking.index_cards(*_incoming(s, d))[2]


def snk8_delete_by_key(s, d):
    cards = ad.cards(s, d)
    links = ad.bridge(s, d)
    return linking.delete_cards(cards, links, linking.with_key_prefix(cards, "web"))[2]


def snk10_rebuild_links(s, d):
    _, new = _incoming(s, d)
    z = new.where("zettel_id IS NOT NULL AND title IS NOT NULL").groupBy("zettel_id").agg(F.min("content").alias("content"))
    old = linking.rebuild_links(z, s.createDataFrame([], "card_id string, relation string, position int, target string"))[0]
    return linking.rebuild_links(z, old.where(F.col("target").endswith("5")).union(old.select("card_id", F.lit("導向"), "position", "target").where(F.col("target").endswith("7"))))[1]


def pip1_import_folders(s, d):
    c = ad.cards(s, d).select(F.col("folder"), "card_id")
    idx = c.select("folder").distinct().withColumn("cite_key", F.when(F.length("folder") % 2 == 0, F.lower(F.lit("Red-1991"))).otherwise("only-2001"))
    told, new, links = linking.import_folders(idx, c, _bib(s, d).select("id", "cite_key"), s.createDataFrame([("only-2001", "Only", 2001)], "cite_key string, title string, year long"))
    return told.join(links.groupBy("paper_id").agg(F.count("*").alias("links")), "paper_id", "left").crossJoin(F.broadcast(new.agg(F.count("*").alias("created")))).select("folder", "paper_id", "status", "links", "created")


def _both(s, d):
    p = _bib(s, d)
    old = p.select(F.col("id").alias("r"), "title", "year", "cite_key")
    e = p.select(F.col("id").alias("l"), F.when(F.col("id") % 6 != 0, F.upper("title")).otherwise("").alias("title"), F.when(F.col("id") % 5 != 0, F.col("year")).alias("year"), F.col("cite_key"))
    return e, old, p.where("id % 3 <> 0").select(F.col("id").alias("l"), F.col("id").alias("r"))


def set5_skip(s, d):
    return linking.sync(*_both(s, d), "skip")


def set5_replace(s, d):
    return linking.sync(*_both(s, d), "replace")


def pip2_sync_merge(s, d):
    return linking.sync(*_both(s, d), "merge")


def grf1_neighbours(s, d):
    return network.neighbours(_net(s, d), 7)


def grf5_traced_paths(s, d):
    e = _net(s, d)
    dist = graph.cut(graph.distances(e, s.createDataFrame([(0,), (1,)], "node long")))
    x = network.with_confidence(network.trace(dist, dist.select("source", "node")), e)
    return x.select("source", "node", F.array_join("path", ">").alias("path"), F.round("confidence", 6).alias("confidence"))


def grf6_paths_by_confidence(s, d):
    e = _net(s, d)
    target = int(e.where("a = 1").agg(F.max("b")).collect()[0][0])
    return network.paths_by_confidence(e, 1, target, 5).select(F.array_join("path", ">").alias("path"), F.round("confidence", 6).alias("confidence"))


def top7_influential_paths(s, d):
    return network.influential_paths(_net(s, d)).select("source", "node", F.array_join("path", ">").alias("path"), F.round("confidence", 6).alias("confidence"))


def grf12_analysis(s, d):
    """The key concepts of the whole analysis."""
    return network.analyse(_net(s, d), _names(s, d))["key_concepts"]


def pip6_four_centralities(s, d):
    return network.all_centralities(_net(s, d).select("a", "b"))


def top5_key_concepts(s, d):
    e = _net(s, d)
    x = graph.degrees(e).select("node", "degree", F.col("degree").cast("double").alias("rank"), (F.col("node") % 13).alias("betweenness"))
    return network.key_concepts(x)


def _groups(s, d):
    return ad.table(s, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("long").alias("community"))


def top6_community_notes(s, d):
    return network.community_notes(_groups(s, d), _names(s, d))


def pip7_visual_nodes(s, d):
    nodes = graph.degrees(_net(s, d)).select("node", "degree").join(_names(s, d), "node")
    return network.visual_nodes(nodes, _groups(s, d).where("community < 20"), nodes.where("degree > 3").select("node", (F.col("degree") / 10).alias("rank")))


def snk17_mermaid(s, d):
    return network.mermaid(_net(s, d), _names(s, d), 50, 0.4995)


def snk18_drawn_edges(s, d):
    return network.induced(_net(s, d), 100)[1]


def snk18_graphviz(s, d):
    return network.graphviz(_net(s, d), _names(s, d), 100)


def snk19_cards(s, d):
    return export.card_markdown(ad.cards(s, d)).select("card_id", "file", F.md5("markdown").alias("digest"))


def snk19_index(s, d):
    return export.index_lines(ad.cards(s, d))


def snk19_paper_notes(s, d):
    return export.paper_notes(ad.papers(s, d))


def snk21_sidecars(s, d):
    """The JSON fields of the sidecars of cards that are judged by their length."""
    c = ad.cards(s, d).select("card_id", "content", F.when(F.col("card_id") % 3 != 0, F.col("folder")).alias("pdf"), F.when(F.col("card_id") % 2 == 0, "EXACT").otherwise("NOT_FOUND").alias("verdict"), (F.col("card_id") / 7 % 1).alias("coverage"), F.substring("content", 1, 9).alias("span"), F.when(F.col("card_id") % 2 == 0, 0).alias("start"), F.when(F.col("card_id") % 2 == 0, 9).alias("end"))
    j = lambda p: F.get_json_object("sidecar", p)
    return export.sidecars(c, "pdf", F.col("content")).select("card_id", j("$.verdict").alias("verdict"), j("$.coverage").cast("double").alias("coverage"), j("$.char_offset[1]").cast("long").alias("upto"), j("$.source_fingerprint.pdf_name").alias("pdf"), j("$.source_fingerprint.sha1").alias("sha1"))


def agg23_cards_by_tag(s, d):
    return export.cards_by_tag(ad.cards(s, d))


def agg22_card_reading_order(s, d):
    o = ad.table(s, d, "orders")
    return export.reading_order(ad.table(s, d, "customer").select(F.col("c_custkey").alias("id")), o.select(F.col("o_custkey").alias("target")))


def set4_search_all(s, d):
    v = _vec(s, d)
    q = list(v.where("id = 3").collect()[0].v)
    return export.search_all({"card": v.where("id % 2 = 0"), "paper": v.where("id % 2 = 1")}, q, 10).select("kind", "id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


def vec5_related_cards(s, d):
    v = _vec(s, d)
    q = list(v.where("id = 3").collect()[0].v)
    rows = v.withColumn("zettel_id", F.concat(F.element_at(F.array(F.lit("Red"), F.lit("Blue"), F.lit("Green")), (F.col("id") % 3 + 1).cast("int")), F.lit("-"), F.col("id").cast("string")))
    return export.related_cards(rows, q, "Red", 5).select("id", "zettel_id", F.round("similarity", 6).alias("similarity"))


def src17_collection(s, d):
    return export.collection_stats({"cards": ad.cards(s, d), "papers": ad.papers(s, d)})


def rel6_shared_concepts(s, d):
    c = ad.cards(s, d).select("card_id", "tags", "core_concept", "title")
    n = c.agg(F.max("card_id").alias("n"))
    pairs = c.crossJoin(F.broadcast(n)).select(F.col("card_id").alias("card1"), (F.col("card_id") * 7 % F.col("n")).alias("card2"))  # one row
    return export.shared_concepts(pairs.where("card1 < card2"), c.withColumn("core_concept", F.regexp_replace("core_concept", "[^A-Za-z ]", " ")).withColumn("title", F.regexp_replace("title", "[^A-Za-z ]", " "))).select("card1", "card2", F.array_join("shared", " ").alias("shared"))


def agg16_daily_trend(s, d):
    u = ad.usage(s, d)
    end = str(u.agg(F.max("day")).collect()[0][0])
    prices = s.createDataFrame([("view", False, 1.0, 1.0, None), ("purchase", False, None, None, 0.25)], "model string, free boolean, input double, output double, flat double")
    return export.daily_trend(usage.with_cost(u, prices), end).select(F.col("day").cast("string").alias("day"), "requests", F.col("tokens").cast("long").alias("tokens"), F.round("cost", 4).alias("cost"))


def agg17_performance(s, d):
    x = export.performance(ad.usage(s, d))
    return x.select("model", "requests", F.round("success_rate", 6).alias("success_rate"), F.round("avg_response_time", 6).alias("avg_response_time"))


def agg17_cost_status(s, d):
    by = ad.usage(s, d).groupBy("day").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("used"))
    return by.select(F.col("day").cast("string").alias("day"), "used", usage.status(F.col("used"), F.lit(20000), 0.5).alias("status"))


def _files(s, d):
    e = ad.table(s, d, "events")
    name = F.concat(F.lit("/out/"), F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, ".pdf").when(F.col("event_id") % 3 == 1, ".md").otherwise(".tmp"))
    return e.select(name.alias("path"), (F.col("value") * 100).cast("long").alias("length"), F.col("ts").alias("modificationTime"))


def pip14_file_statistics(s, d):
    return export.file_statistics(_files(s, d), {"cards": r"\.md$", "papers": r"\.pdf$", "views": "/view/"})


def snk22_removable_files(s, d):
    return export.removable(_files(s, d), "2024-01-20", [r"\.tmp$", r"\.md$"], ["/purchase/"], 7, 5000).select("path")


def pip15_first_resource(s, d):
    k = F.col("s_suppkey")
    rows = ad.table(s, d, "supplier").select(k.alias("id"), F.when(k % 3 == 0, F.col("s_name")).alias("explicit"), F.when(k % 2 == 0, F.lit("here")).otherwise("").alias("cwd"), F.lit("built in").alias("built_in"))
    return export.first_resource(rows, ["explicit", "cwd", "built_in"]).select("id", "resource", "layer")


def pip12_entry_pages(s, d):
    p = ad.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 5, F.col("p_size").cast("string")).alias("sp"), F.when(F.col("p_size") % 2 == 0, (F.col("p_size") + 9).cast("string")).otherwise("").alias("ep"))
    return p.select("id", keys.page_range(F.col("sp"), F.col("ep")).alias("pages"))


def pip10_card_ids(s, d):
    p = _bib(s, d)
    return p.where("cite_key IS NOT NULL").select("id", keys.card_id(F.col("cite_key"), (F.col("id") % 1000).cast("int")).alias("card"))


def f2_cite_keys(s, d):
    c = ad.table(s, d, "customer")
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(", Ann"))).otherwise(F.concat(F.lit("Ann "), "c_mktsegment"))
    return c.select("c_custkey", keys.cite_key(name, (F.col("c_custkey") % 30 + 1990)).alias("cite_key"))


def f8_fingerprints(s, d):
    return ad.table(s, d, "documents").select("doc_id", keys.fingerprint(F.col("text")).alias("sha1"))


BIB = """bib AS (SELECT p_partkey AS id, list_aggregate(list_transform(string_split(p_name || ' ' || p_type, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', ' ') || ' study ' || p_partkey AS title, (1990 + p_partkey % 30)::BIGINT AS year,
 CASE WHEN p_partkey % 4 <> 0 THEN upper(p_name[1:1]) || lower(split_part(p_name, ' ', 1)[2:]) || '-' || (1990 + p_partkey % 30) END AS cite_key FROM part)"""
NOTED = """noted AS (SELECT c_custkey AS card_id, 'zettel_Small' || (1985 + c_custkey % 37) || 'a_2025' AS zettel_id, 1985 + c_custkey % 37 AS y, c_custkey % 4 AS t, lower(c_mktsegment) AS seg FROM customer)"""
NET = """e AS MATERIALIZED (SELECT a, b, max(confidence) AS confidence FROM (SELECT least(o_custkey, o_orderkey * 7 % n) AS a, greatest(o_custkey, o_orderkey * 7 % n) AS b, round(o_totalprice / 1000000, 4) AS confidence FROM orders, (SELECT count(*) AS n FROM customer) WHERE o_orderpriority = '1-URGENT') WHERE a <> b GROUP BY 1, 2),
 s AS MATERIALIZED (SELECT a, b, confidence FROM e UNION ALL SELECT b, a, confidence FROM e), g AS MATERIALIZED (SELECT a AS node, count(*) AS degree FROM s GROUP BY 1)"""
NAMES = "names AS (SELECT c_custkey AS node, c_mktsegment || ' ' || c_name || ' of the network' AS title FROM customer)"
SHORT = "replace(CASE WHEN length(title) > {n} THEN substr(title, 1, {n}) || '...' ELSE title END, '\"', '''')"


def _traced(sources: str) -> str:
    """Distances, the smallest parents and the paths they make, with the mean of the edges."""
    return f""", r(source, node, dist) AS (SELECT node, node, 0::BIGINT FROM g WHERE {sources} UNION SELECT r.source, s.b, r.dist + 1 FROM r JOIN s ON s.a = r.node WHERE r.dist < 16),
 m AS MATERIALIZED (SELECT source, node, min(dist) AS distance FROM r GROUP BY 1, 2),
 par AS MATERIALIZED (SELECT m.source, m.node, m.distance, min(p.node) AS parent FROM m JOIN s ON s.a = m.node JOIN m p ON p.source = m.source AND p.node = s.b AND p.distance = m.distance - 1 GROUP BY 1, 2, 3),
 w(source, node, path, total, distance) AS (SELECT source, node, [node], 0::DOUBLE, distance FROM m WHERE distance = 0 UNION ALL SELECT par.source, par.node, list_append(w.path, par.node), w.total + s.confidence, par.distance FROM w JOIN par ON par.source = w.source AND par.parent = w.node JOIN s ON s.a = w.node AND s.b = par.node),
 t AS (SELECT source, node, array_to_string(path, '>') AS path, CASE WHEN distance = 0 THEN 1.0 ELSE total / distance END::DOUBLE AS confidence, distance FROM w)"""


V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), sim AS (SELECT x.id, list_cosine_similarity(q.v, x.v) AS s FROM v q, v x WHERE q.id = 3)"
SYNC = f"""{BIB}, x AS (SELECT id, CASE WHEN id % 6 <> 0 THEN upper(title) ELSE '' END AS title, CASE WHEN id % 5 <> 0 THEN year END AS year, year AS own, cite_key FROM bib)"""
INCOMING = """old AS (SELECT source || '-' || doc_id AS z FROM documents JOIN labels USING (doc_id)),
 inc AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment || '-' || (c_custkey % 300) END AS z, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS title, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) || '-2020-' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS target FROM customer),
 fresh AS (SELECT * FROM inc WHERE z IS NOT NULL AND title IS NOT NULL AND z NOT IN (SELECT z FROM old) QUALIFY row_number() OVER (PARTITION BY z ORDER BY title) = 1)"""

ORACLE = {
    "flt5_cards_of_papers": f"WITH {ad.PAPERS}, {ad.CARDS} SELECT paper_id, card_id FROM cards WHERE paper_id IN (SELECT id FROM papers WHERE year = 1995)",
    "flt7_entries_by_doi": f"WITH {ad.PAPERS} SELECT CASE WHEN id % 2 = 0 THEN 'https://DOI.org/' ELSE '' END || upper(doi) AS doi, cite_key FROM papers WHERE doi IS NOT NULL",
    "flt8_entries_by_key": f"""WITH {BIB}, w AS (SELECT DISTINCT CASE id % 3 WHEN 0 THEN lower(cite_key) WHEN 1 THEN cite_key || '?' ELSE cite_key END AS key FROM bib WHERE cite_key IS NOT NULL)
 SELECT key, id, cite_key, CASE WHEN key = cite_key THEN 1 WHEN lower(key) = lower(cite_key) THEN 2 ELSE 3 END AS tier FROM w JOIN bib ON lower(cite_key) = lower(replace(key, '?', '')) QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier, id) = 1""",
    "jon2_papers_of_cards": f"WITH {ad.PAPERS}, {ad.BRIDGE}, {ad.CARDS} SELECT b.card_id, b.paper_id, p.title AS paper_title, similarity FROM bridge b JOIN papers p ON p.id = b.paper_id JOIN cards c ON c.card_id = b.card_id WHERE similarity >= 0.8",
    "jon8_exact_titles": "SELECT p_partkey, max(p_partkey) OVER (PARTITION BY lower(p_name)) AS last FROM part",
    "jon14_link_coverage": f"WITH {ad.CARDS} SELECT domain, count(*) AS cards, sum(CASE WHEN paper_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS linked, sum(CASE WHEN paper_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS unlinked FROM cards GROUP BY 1",
    "snk15_back_fill_by_title": f"""WITH {BIB}, e AS (SELECT 'new' || id AS cite_key, lower(title) AS t, CASE WHEN id % 5 = 0 THEN year + 1 ELSE year END AS y FROM bib),
 h AS (SELECT e.cite_key, count(bib.id) AS n, min(bib.id) AS id, min(bib.cite_key) AS own FROM e LEFT JOIN bib ON contains(lower(bib.title), substr(e.t, 1, 50)) AND bib.year = e.y GROUP BY 1)
 SELECT cite_key, CASE WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' WHEN coalesce(own, '') <> '' THEN 'has_key' ELSE 'updated' END AS status, CASE WHEN n = 1 THEN id END AS paper_id FROM h""",
    "ent8_link_cards": f"""WITH {BIB}, {NOTED}, k AS (SELECT lower(cite_key) AS k, id FROM bib WHERE cite_key IS NOT NULL UNION ALL SELECT replace(lower(cite_key), '-', ''), id FROM bib WHERE cite_key IS NOT NULL), kk AS (SELECT k, max(id) AS id FROM k GROUP BY 1),
 cand AS (SELECT card_id, pos, CASE t WHEN 0 THEN 'red' ELSE CASE t WHEN 1 THEN 'nobody' ELSE 'blue' END END || sep || y || CASE WHEN t = 2 AND pos % 2 = 1 THEN 'b' ELSE '' END AS k FROM noted, (VALUES (0, '-'), (1, '-'), (2, ''), (3, ''), (4, '_'), (5, '_')) p(pos, sep) WHERE t <> 3
  UNION ALL SELECT card_id, 9, 'small' || y || 'a' FROM noted),
 keyed AS (SELECT card_id, id FROM cand JOIN kk USING (k) QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY pos) = 1),
 left_ AS (SELECT * FROM noted WHERE t <> 3 AND card_id NOT IN (SELECT card_id FROM keyed)),
 q AS (SELECT DISTINCT t, y, CASE WHEN t = 1 THEN seg END AS seg, CASE t WHEN 0 THEN 'red' WHEN 1 THEN 'nobody' ELSE 'blue' END AS author, CASE t WHEN 0 THEN ['notes'] WHEN 1 THEN [seg, 'widget', 'promo'] ELSE ['ring', 'economy'] END AS words FROM left_),
 sc AS (SELECT t, y, seg, bib.id, 3 * (contains(lower(title), author) OR contains(lower(coalesce(cite_key, '')), author))::INT + least(4, len(list_filter(words, lambda w: contains(lower(title), w)))) + 3 * (year = y)::INT AS s FROM q, bib),
 best AS (SELECT * FROM sc WHERE s >= 2 QUALIFY row_number() OVER (PARTITION BY t, y, seg ORDER BY s DESC, id) = 1)
 SELECT n.card_id, coalesce(keyed.id, best.id) AS paper_id, CASE WHEN keyed.id IS NOT NULL THEN 'cite_key' WHEN best.id IS NOT NULL THEN 'author_year' END AS method,
  CASE WHEN coalesce(keyed.id, best.id) IS NOT NULL THEN 'linked' WHEN n.t = 3 THEN 'skipped' ELSE 'unmatched' END AS status, round(CASE WHEN keyed.id IS NOT NULL THEN 1.0 ELSE coalesce(best.s, 0) / 10 END::DOUBLE, 6) AS score
 FROM noted n LEFT JOIN keyed USING (card_id) LEFT JOIN best ON n.t = best.t AND n.y = best.y AND (n.t <> 1 OR n.seg = best.seg) AND n.t <> 3""",
    "snk6_card_links": f"WITH {INCOMING} SELECT z AS card_id, '基於' AS relation, 0::BIGINT AS position, target FROM fresh",
    "snk7_index_outcomes": f"WITH {INCOMING} SELECT CASE WHEN inc.z IS NULL OR inc.title IS NULL THEN 'parse_error' WHEN fresh.k IS NOT NULL THEN 'inserted' ELSE 'duplicate' END AS status, count(*) AS n FROM inc LEFT JOIN fresh USING (k) GROUP BY 1",
    "snk8_delete_by_key": f"WITH {ad.CARDS}, {ad.BRIDGE}, x AS (SELECT card_id FROM cards WHERE starts_with(zettel_id, 'web-')) SELECT 'cards' AS deleted, count(*) AS n FROM x UNION ALL SELECT 'links', count(*) FROM bridge WHERE card_id IN (SELECT card_id FROM x)",
    "set5_skip": f"WITH {SYNC} SELECT id AS l, title, year, cite_key, 'new' AS action, title <> '' AS valid FROM x WHERE id % 3 = 0",
    "set5_replace": f"WITH {SYNC} SELECT id AS l, title, year, cite_key, CASE WHEN id % 3 = 0 THEN 'new' ELSE 'replace' END AS action, title <> '' AS valid FROM x",
    "pip2_sync_merge": f"WITH {SYNC} SELECT id AS l, title, CASE WHEN id % 3 = 0 THEN year ELSE own END AS year, cite_key, CASE WHEN id % 3 = 0 THEN 'new' ELSE 'merge' END AS action, title <> '' AS valid FROM x",
    "pip1_import_folders": f"""WITH {BIB}, {ad.CARDS}, f AS (SELECT folder, count(*) AS n, length(folder) % 2 = 0 AS even FROM cards GROUP BY 1), p AS (SELECT min(id) AS id FROM bib WHERE lower(cite_key) = 'red-1991')
 SELECT folder, CASE WHEN even THEN p.id END AS paper_id, CASE WHEN NOT even THEN 'created' WHEN p.id IS NOT NULL THEN 'found' ELSE 'missing' END AS status, CASE WHEN even AND p.id IS NOT NULL THEN (SELECT sum(n) FROM f WHERE even)::BIGINT END AS links, (SELECT count(*) FROM (SELECT DISTINCT even FROM f WHERE NOT even)) AS created FROM f, p""",
    "grf1_neighbours": f"WITH {NET} SELECT b AS node, confidence FROM s WHERE a = 7",
    "grf5_traced_paths": f"WITH RECURSIVE {NET}{_traced('node IN (0, 1)')} SELECT source, node, path, round(confidence, 6) AS confidence FROM t",
    "grf6_paths_by_confidence": f"WITH RECURSIVE {NET}, p(path, z, total) AS (SELECT [1::BIGINT], 1::BIGINT, 0::DOUBLE UNION ALL SELECT list_append(path, s.b), s.b, total + confidence FROM p JOIN s ON s.a = p.z WHERE len(path) <= 5 AND p.z <> (SELECT max(b) FROM e WHERE a = 1) AND NOT list_contains(path, s.b)) SELECT array_to_string(path, '>') AS path, round(total / (len(path) - 1), 6) AS confidence FROM p WHERE z = (SELECT max(b) FROM e WHERE a = 1)",
    "top7_influential_paths": f"WITH RECURSIVE {NET}, h AS (SELECT node FROM g ORDER BY degree DESC, node LIMIT 10){_traced('node IN (SELECT node FROM h)')} SELECT source, node, path, round(confidence, 6) AS confidence FROM t WHERE node IN (SELECT node FROM h) AND source < node AND distance >= 2 ORDER BY t.confidence DESC, source, node LIMIT 20",
    "top5_key_concepts": f"""WITH {NET}, x AS (SELECT node, degree, node % 13 AS bw FROM g ORDER BY degree DESC, node LIMIT 20), y AS (SELECT *, row_number() OVER (ORDER BY degree DESC, node) AS place, row_number() OVER (ORDER BY bw DESC, degree DESC, node) AS br FROM x)
 SELECT place, node, degree::DOUBLE AS rank, CASE WHEN place <= 5 THEN place END AS hub, CASE WHEN br <= 5 THEN br END AS bridge FROM y""",
    "top6_community_notes": f"WITH {NAMES}, c AS (SELECT c_nationkey::BIGINT AS community, count(*) AS size FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT community, size, row_number() OVER (PARTITION BY community ORDER BY title, node) AS place, node, title FROM c JOIN customer ON c_nationkey = community JOIN names ON node = c_custkey",
    "pip7_visual_nodes": f"WITH {NET}, {NAMES} SELECT node AS id, substr(title, 1, 40) AS label, degree, CASE WHEN c_nationkey < 20 THEN c_nationkey ELSE 0 END::BIGINT AS community, CASE WHEN degree > 3 THEN degree / 10 ELSE 0 END::DOUBLE AS centrality FROM g JOIN names USING (node) JOIN customer ON c_custkey = node",
    "snk17_mermaid": f"""WITH {NET}, {NAMES}, t AS (SELECT * FROM e ORDER BY confidence DESC, a, b LIMIT 50), l AS (SELECT -1 AS p, 0 AS x, 0 AS y, 'graph TD' AS line UNION ALL SELECT 0, node, 0, '    N' || node || '["' || {SHORT.format(n=40)} || '"]' FROM names WHERE node IN (SELECT a FROM t UNION SELECT b FROM t)
 UNION ALL SELECT 1, a, b, '    N' || a || CASE WHEN confidence >= 0.4995 THEN ' --> ' ELSE ' -.-> ' END || 'N' || b FROM t) SELECT row_number() OVER (ORDER BY p, x, y) - 1 AS seq, line FROM l""",
    "snk18_drawn_edges": f"WITH {NET}, h AS (SELECT node FROM g ORDER BY degree DESC, node LIMIT 100) SELECT a, b, confidence FROM e WHERE a IN (SELECT node FROM h) AND b IN (SELECT node FROM h)",
    "snk18_graphviz": f"""WITH {NET}, {NAMES}, h AS (SELECT node FROM g ORDER BY degree DESC, node LIMIT 100), l AS (SELECT 0 AS p, 0 AS x, 0 AS y, 'graph network {{' AS line UNION ALL SELECT 3, 0, 0, '}}' UNION ALL SELECT 1, node, 0, '  n' || node || ' [label="' || {SHORT.format(n=30)} || '"];' FROM names WHERE node IN (SELECT node FROM h)
 UNION ALL SELECT 2, a, b, '  n' || a || ' -- n' || b || ';' FROM e WHERE a IN (SELECT node FROM h) AND b IN (SELECT node FROM h)) SELECT row_number() OVER (ORDER BY p, x, y) - 1 AS seq, line FROM l""",
    "snk19_cards": f"""WITH {ad.CARDS} SELECT card_id, zettel_id || '.md' AS file, md5('---' || chr(10) || 'id: ' || zettel_id || chr(10) || 'title: ' || coalesce(title, '') || chr(10) || 'type: ' || card_type || chr(10) || 'domain: ' || coalesce(domain, '') || chr(10) || 'tags: [' || array_to_string(tags, ', ') || ']' || chr(10) || '---' || chr(10) || chr(10) || '# ' || coalesce(title, '') || chr(10) || chr(10) || '> ' || coalesce(core_concept, '') || chr(10) || chr(10) || coalesce(content, '')) AS digest FROM cards""",
    "snk19_index": f"WITH {ad.CARDS} SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY card_id) AS seq, '- [[' || zettel_id || ']] ' || coalesce(title, '') AS line FROM cards",
    "snk19_paper_notes": f"WITH {ad.PAPERS} SELECT id, concat_ws(chr(10), '---', 'title: ' || title, 'year: ' || year, 'doi: ' || doi, CASE WHEN cite_key <> '' THEN 'cite_key: ' || cite_key END, '---', '', '# ' || title) AS markdown FROM papers",
    "snk21_sidecars": f"WITH {ad.CARDS} SELECT card_id, CASE WHEN card_id % 2 = 0 THEN 'EXACT' ELSE 'NOT_FOUND' END AS verdict, round(card_id / 7 % 1, 4) AS coverage, CASE WHEN card_id % 2 = 0 THEN 9::BIGINT END AS upto, CASE WHEN card_id % 3 <> 0 THEN folder END AS pdf, CASE WHEN card_id % 3 <> 0 THEN sha1(content) END AS sha1 FROM cards",
    "agg23_cards_by_tag": f"WITH {ad.CARDS}, t AS (SELECT DISTINCT card_id, unnest(tags) AS tag FROM cards) SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY card_id) AS seq, card_id FROM t WHERE tag IS NOT NULL",
    "agg22_card_reading_order": "SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "set4_search_all": f"WITH {V}, k AS (SELECT CASE WHEN id % 2 = 0 THEN 'card' ELSE 'paper' END AS kind, id, s FROM sim QUALIFY row_number() OVER (PARTITION BY kind ORDER BY s DESC, id) <= 10) SELECT kind, id, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, kind, id) AS place FROM k",
    "vec5_related_cards": f"WITH {V}, k AS (SELECT id, s FROM sim ORDER BY s DESC, id LIMIT 10) SELECT id, CASE id % 3 WHEN 1 THEN 'Blue-' ELSE 'Green-' END || id AS zettel_id, round(s, 6) AS similarity FROM k WHERE id % 3 <> 0 ORDER BY s DESC, id LIMIT 5",
    "src17_collection": "SELECT 'cards' AS collection, count(*) AS items FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'papers', count(*) FROM orders",
    "rel6_shared_concepts": f"""WITH {ad.CARDS}, n AS (SELECT max(card_id) AS n FROM cards), c AS (SELECT card_id, list_distinct(list_concat(tags, list_filter(string_split_regex(lower(regexp_replace(core_concept, '[^A-Za-z ]', ' ', 'g') || ' ' || regexp_replace(title, '[^A-Za-z ]', ' ', 'g')), ' +'), lambda w: length(w) >= 3))) AS l FROM cards)
 SELECT x.card_id AS card1, y.card_id AS card2, coalesce(array_to_string(list_sort(list_intersect(x.l, y.l)), ' '), '') AS shared FROM c x JOIN n ON true JOIN c y ON y.card_id = x.card_id * 7 % n.n WHERE x.card_id < y.card_id""",
    "agg16_daily_trend": f"""WITH {ad.USAGE}, l AS (SELECT max(day) AS l FROM usage), days AS (SELECT CAST(l - unnest(range(7))::INT AS DATE) AS day FROM l)
 SELECT days.day::VARCHAR AS day, count(event_id) AS requests, coalesce(sum(tokens), 0)::BIGINT AS tokens, round(coalesce(sum(CASE model WHEN 'view' THEN 2.0 * tokens / 2000 WHEN 'purchase' THEN 0.25 ELSE 0 END::DOUBLE), 0), 4) AS cost FROM days LEFT JOIN usage ON usage.day = days.day GROUP BY 1""",
    "agg17_performance": f"WITH {ad.USAGE} SELECT model, count(*) AS requests, round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(avg(response_time), 6) AS avg_response_time FROM usage GROUP BY 1",
    "agg17_cost_status": f"WITH {ad.USAGE}, b AS (SELECT day, coalesce(sum(tokens), 0)::BIGINT AS used FROM usage GROUP BY 1) SELECT day::VARCHAR AS day, used, CASE WHEN used >= 20000 THEN 'exceeded' WHEN used >= 10000 THEN 'warning' ELSE 'ok' END AS status FROM b",
    "pip14_file_statistics": """WITH f AS (SELECT event_type AS t, event_id % 3 AS k, CAST(trunc(value * 100) AS BIGINT) AS n FROM events)
 SELECT 'cards' AS kind, count(*) AS files, coalesce(sum(n), 0)::BIGINT AS bytes FROM f WHERE k = 1 UNION ALL SELECT 'papers', count(*), coalesce(sum(n), 0)::BIGINT FROM f WHERE k = 0 UNION ALL SELECT 'views', count(*), coalesce(sum(n), 0)::BIGINT FROM f WHERE t = 'view'""",
    "snk22_removable_files": "SELECT '/out/' || event_type || '/' || event_id || CASE event_id % 3 WHEN 1 THEN '.md' ELSE '.tmp' END AS path FROM events WHERE event_id % 3 <> 0 AND event_type <> 'purchase' AND ts <= TIMESTAMP '2024-01-13' AND trunc(value * 100) <= 5000",
    "pip15_first_resource": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 2 = 0 THEN 'here' ELSE 'built in' END AS resource, CASE WHEN s_suppkey % 3 = 0 THEN 'explicit' WHEN s_suppkey % 2 = 0 THEN 'cwd' ELSE 'built_in' END AS layer FROM supplier",
    "pip12_entry_pages": "SELECT p_partkey AS id, nullif(concat_ws('-', CASE WHEN p_size > 5 THEN p_size::VARCHAR END, CASE WHEN p_size % 2 = 0 THEN (p_size + 9)::VARCHAR END), '') AS pages FROM part",
    "pip10_card_ids": f"WITH {BIB} SELECT id, cite_key || '-' || lpad((id % 1000)::VARCHAR, 3, '0') AS card FROM bib WHERE cite_key IS NOT NULL",
    "f2_cite_keys": "SELECT c_custkey, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) || '-' || (c_custkey % 30 + 1990) AS cite_key FROM customer",
    "f8_fingerprints": "SELECT doc_id, sha1(text) AS sha1 FROM documents",
}
#: Without SQL: title ratios, Louvain, betweenness. Tests compare them with plain Python.
FREE = ("ent6_files_to_entries", "ent7_link_by_title", "ent9_files_by_key", "grf12_analysis", "pip6_four_centralities", "snk10_rebuild_links")
QUERIES = {k: v for k, v in globals().items() if k in ORACLE or k in FREE}
