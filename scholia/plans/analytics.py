"""Queries of quality, usage, vector search and graphs, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scholia.operators import graph, quality, usage, vectors
from scholia.plans import adapters as ad

YEAR = 2026


def _meta(s, d):
    """Papers with metadata of mixed quality, from documents."""
    k = F.col("doc_id")
    first = F.split("text", r"\n")[0]
    title = F.when(k % 23 == 0, "Untitled").when(k % 29 == 0, "http://example.org/x").when(k % 31 == 0, F.lit(None)).when(k % 11 == 0, F.concat(F.substring(first, 1, 30), F.lit(" final draft"))).when(k % 13 == 0, F.substring(first, 1, 8)).when(k % 17 == 0, F.substring(first, 1, 15)).otherwise(F.substring(first, 1, 80))
    authors = F.when(k % 19 == 0, F.lit(None)).when(k % 7 == 0, F.array(F.lit("Unknown"), F.lit("Author 12"))).otherwise(F.array(F.lit("Doe, Jane"), F.col("source")))
    keywords = F.when(k % 9 == 0, F.array().cast("array<string>")).when(k % 10 == 0, F.array("lang", "lang", F.lit(" "))).when(k % 4 == 0, F.array("lang")).otherwise(F.array("lang", "source", F.lit("corpus")))
    year = F.when(k % 37 == 0, F.lit(None)).otherwise(1890 + k % 145)
    abstract = F.when(k % 41 == 0, "").when(k % 43 == 0, "Abstract not available").when(k % 6 == 0, F.substring("text", 1, 70)).when(k % 8 == 0, F.substring("text", 1, 40)).otherwise(F.col("text"))
    return ad.table(s, d, "documents").select(k.alias("id"), title.alias("title"), authors.alias("authors"), year.cast("int").alias("year"), abstract.alias("abstract"), keywords.alias("keywords"))


def qlt_scores(s, d):
    return quality.assess(_meta(s, d), YEAR).select("id", *[f"{f}_score" for f in quality.WEIGHTS], F.round("overall", 6).alias("overall"), "level", F.size("issues").cast("long").alias("n_issues"))


def agg12_quality_summary(s, d):
    return quality.summary(quality.assess(_meta(s, d), YEAR)).select("level", "papers", F.round("mean_score", 6).alias("mean_score"), F.round("percent", 6).alias("percent"))


def flt9_critical_issues(s, d):
    return quality.with_severity(quality.assess(_meta(s, d), YEAR), "critical")


def agg12_top_issues(s, d):
    return quality.top_issues(quality.assess(_meta(s, d), YEAR))


def agg14_usage_rollup(s, d):
    return usage.rollup(ad.usage(s, d)).withColumn("avg_response_time", F.round("avg_response_time", 6)).withColumn("day", F.col("day").cast("string"))


def _prices(s):
    return s.createDataFrame([("click", True, None, None, None), ("view", False, 0.5, 1.5, None), ("purchase", False, None, None, 0.25)], "model string, free boolean, input double, output double, flat double")


def agg18_cost(s, d):
    c = usage.with_cost(ad.usage(s, d), F.broadcast(_prices(s)))
    return c.groupBy("model").agg(F.count("*").alias("requests"), F.round(F.sum("cost"), 4).alias("cost"))


def agg15_daily_report(s, d):
    r = usage.daily_report(ad.usage(s, d))
    return r.select(F.col("day").cast("string").alias("day"), "model", "requests", F.round("success_percent", 6).alias("success_percent"), F.round("share_percent", 6).alias("share_percent"))


def agg15_first_errors(s, d):
    return usage.first_errors(ad.usage(s, d)).withColumn("day", F.col("day").cast("string"))


def _last_day(s, d):
    return str(ad.usage(s, d).agg(F.max("day").alias("m")).collect()[0].m)


def agg16_weekly_report(s, d):
    c = usage.with_cost(ad.usage(s, d), F.broadcast(_prices(s)))
    r = usage.weekly_report(c, _last_day(s, d))
    return r.select("model", "requests", "tokens", *[F.round(x, 4).alias(x) for x in ("cost", "requests_per_day", "cost_percent", "cost_per_request")])


def agg17_quota(s, d):
    by = usage.rollup(ad.usage(s, d)).groupBy("model").agg(F.sum("requests").alias("used"))
    limit = F.when(F.col("model") == "click", 1000).when(F.col("model") == "view", 2200).when(F.col("model") == "purchase", 100_000)
    return by.select("model", "used", usage.status(F.col("used"), limit, 0.8).alias("status"))


def top11_model_choice(s, d):
    by = usage.rollup(ad.usage(s, d)).groupBy("model").agg(F.sum("requests").alias("used"))
    cat = by.select("model", (F.col("model") != "error").alias("available"), (F.col("used") % 2 == 0).alias("quota_ok"))
    tasks = ad.table(s, d, "region").select(F.col("r_name").alias("task"), F.array(F.lit("error"), F.lit("view")).alias("preferred"), F.array(F.lit("click"), F.lit("purchase"), F.lit("login"), F.lit("logout")).alias("fallback"), F.when(F.col("r_regionkey") == 1, F.array(F.lit("view"), F.lit("click"))).alias("avoid"))
    return usage.choose_model(tasks, cat)


def _vectors(s, d):
    return ad.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def vec1_search_one(s, d):
    q = list(_vectors(s, d).where("id = 3").collect()[0].v)
    return vectors.search_one(_vectors(s, d), q, 10, F.col("label") != 0).select("id", F.round("similarity", 6).alias("similarity"))


def vec2_similar_to_items(s, d):
    v = _vectors(s, d)
    return vectors.nearest(v, v.where("id % 20 = 0"), 10).select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


def vec4_auto_links(s, d):
    v = _vectors(s, d)
    found = vectors.nearest(v, v.where("id % 5 = 0"), 15)
    return vectors.auto_links(found, 0.3, 5).select("query", "id", F.round("similarity", 6).alias("similarity"), "link")


def vec5_l2sq_metric(s, d):
    v = _vectors(s, d)
    found = vectors.nearest(v, v.where("id % 50 = 0"), 5)
    return found.select("query", "id", F.round(vectors.similarity(F.col("similarity"), "l2sq"), 6).alias("similarity"))


def vec5_l2sq_metric_all(s, d):
    v = _vectors(s, d)
    found = vectors.nearest(v, v, 5)
    return found.select("query", "id", F.round(vectors.similarity(F.col("similarity"), "l2sq"), 6).alias("similarity"))


def agg20_retrieval_metrics(s, d):
    v = _vectors(s, d)
    q = v.where("id % 20 = 0")
    truth = q.select(F.col("id").alias("query"), "label").join(v.select("id", "label"), "label").where("query <> id").select("query", "id")
    m = vectors.retrieval_metrics(vectors.nearest(v, q, 10), truth, 10)
    return m.select("query", *[F.round(x, 6).alias(x) for x in ("recall", "precision", "rr")])


def edges(s, d):
    """The symmetrised graph of the five nearest neighbours of each vector."""
    v = _vectors(s, d)
    n = vectors.nearest(v, v, 5)
    return graph.cut(n.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b")).distinct())


def grf8_degrees(s, d):
    return graph.degrees(edges(s, d)).select("node", "degree", F.round("centrality", 6).alias("centrality"))


def top2_hubs(s, d):
    return graph.degrees(edges(s, d)).select("node", "degree").orderBy(F.desc("degree"), "node").limit(10)


def agg13_network_statistics(s, d):
    return graph.statistics(edges(s, d))


def grf2_components(s, d):
    return graph.connected_components(edges(s, d).where("(a + b) % 3 = 0"))


def grf2_components_all(s, d):
    return graph.connected_components(edges(s, d))


def grf11_page_rank(s, d):
    return graph.page_rank(edges(s, d), rounds=12, tolerance=None).select("node", F.round("rank", 8).alias("rank"))


def grf5_distances(s, d):
    e = edges(s, d)
    return graph.distances(e, s.createDataFrame([(0,)], "node long")).select("node", F.col("distance").cast("long").alias("distance"))


def grf10_closeness(s, d):
    e = edges(s, d)
    src = e.select(F.col("a").alias("node")).where("node % 25 = 0").distinct()
    return graph.closeness_from(e, src).select("node", F.round("closeness", 8).alias("closeness"))


def grf10_closeness_all(s, d):
    e = edges(s, d)
    return graph.closeness_from(e).select("node", F.round("closeness", 8).alias("closeness"))


def grf6_simple_paths(s, d):
    e = edges(s, d)
    target = e.where("a = 1").agg(F.max("b").alias("b")).collect()[0].b
    return graph.simple_paths(e, 1, int(target), 4).select(F.array_join("path", ">").alias("path"))


def grf4_communities(s, d):
    e = edges(s, d).where("(a + b) % 3 = 0")
    x = graph.describe_communities(e, graph.connected_components(e).withColumnRenamed("component", "community"))
    return x.select("community", "size", "hub", F.array_join("first_members", ",").alias("first_members"), F.round("density", 6).alias("density"))


def grf4_communities_all(s, d):
    e = edges(s, d)
    x = graph.describe_communities(e, graph.connected_components(e).withColumnRenamed("component", "community"))
    return x.select("community", "size", "hub", F.array_join("first_members", ",").alias("first_members"), F.round("density", 6).alias("density"))


def grf3_louvain(s, d):
    return graph.louvain(edges(s, d))


def grf9_betweenness(s, d):
    return graph.betweenness(edges(s, d))


def grf7_influential_paths(s, d):
    """Distances of at least two between the ten largest hubs, the twenty shortest."""
    e = edges(s, d)
    hubs = graph.cut(graph.degrees(e).orderBy(F.desc("degree"), "node").limit(10).select("node"))
    dist = graph.distances(e, hubs).join(F.broadcast(hubs), "node")
    return dist.where("source < node AND distance >= 2").select("source", "node", F.col("distance").cast("long").alias("distance")).orderBy("distance", "source", "node").limit(20)


def pip6_all_centralities(s, d):
    e = edges(s, d)
    rank = graph.page_rank(e, rounds=12, tolerance=None)
    x = graph.degrees(e).join(rank, "node")
    return x.select("node", F.round("centrality", 6).alias("centrality"), F.round("rank", 8).alias("rank"), F.row_number().over(Window.partitionBy(F.col("node") % 10).orderBy(F.desc("degree"), "node")).cast("long").alias("place"))


META = """meta AS (SELECT doc_id AS id, string_split(text, chr(10))[1] AS f, lang, source, text,
 CASE WHEN doc_id % 23 = 0 THEN 'Untitled' WHEN doc_id % 29 = 0 THEN 'http://example.org/x' WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN substr(string_split(text, chr(10))[1], 1, 30) || ' final draft'
  WHEN doc_id % 13 = 0 THEN substr(string_split(text, chr(10))[1], 1, 8) WHEN doc_id % 17 = 0 THEN substr(string_split(text, chr(10))[1], 1, 15) ELSE substr(string_split(text, chr(10))[1], 1, 80) END AS title0,
 CASE WHEN doc_id % 19 = 0 THEN 0 WHEN doc_id % 7 = 0 THEN 70 ELSE 100 END AS authors_score0,
 CASE WHEN doc_id % 37 = 0 THEN NULL ELSE 1890 + doc_id % 145 END AS year,
 CASE WHEN doc_id % 41 = 0 THEN '' WHEN doc_id % 43 = 0 THEN 'Abstract not available' WHEN doc_id % 6 = 0 THEN substr(text, 1, 70) WHEN doc_id % 8 = 0 THEN substr(text, 1, 40) ELSE text END AS abstract,
 CASE WHEN doc_id % 9 = 0 THEN 0 WHEN doc_id % 10 = 0 THEN 3 WHEN doc_id % 4 = 0 THEN 1 ELSE 3 END AS nk, doc_id % 10 = 0 AND doc_id % 9 <> 0 AS dup FROM documents),
ded AS (SELECT *, coalesce(title0, '') AS title, length(coalesce(title0, '')) AS n, length(abstract) AS m, len(list_filter(string_split_regex(abstract, '\\s+'), lambda x: x <> '')) AS w FROM meta),
pts AS (SELECT *,
 [CASE WHEN regexp_matches(title, '(?i)^Untitled$') THEN 25 END, CASE WHEN regexp_matches(title, '(?i)^https?://') THEN 25 END, CASE WHEN regexp_matches(title, '^\\s*$') THEN 25 END,
  CASE WHEN regexp_matches(title, '(?i)\\b(draft|version|v\\d+|final|revised)\\b') THEN 2 END, CASE WHEN regexp_matches(title, '^.{1,10}$') THEN 5 END,
  CASE WHEN n < 10 THEN 10 END, CASE WHEN n >= 10 AND n < 20 THEN 3 END] AS t,
 CASE WHEN authors_score0 = 100 THEN 0 ELSE 1 END AS ai, year IS NULL AS noy,
 [CASE WHEN year < 1900 OR year > 2030 THEN 20 END, CASE WHEN year < 1950 THEN 2 END, CASE WHEN year > 2028 THEN 5 END] AS y,
 abstract = '' OR abstract = 'Abstract not available' AS noab,
 [CASE WHEN m < 50 THEN 25 END, CASE WHEN m >= 50 AND m < 100 THEN 5 END, CASE WHEN m > 5000 THEN 5 END, CASE WHEN w < 20 THEN 10 END] AS b,
 [CASE WHEN nk < 1 THEN 15 END, CASE WHEN nk >= 1 AND nk < 3 THEN 5 END, CASE WHEN dup THEN 10 END, CASE WHEN dup THEN 5 END] AS k FROM ded),
scored AS (SELECT id, greatest(0, 100.0 - coalesce(list_sum(t), 0))::DOUBLE AS title_score, authors_score0::DOUBLE AS authors_score, CASE WHEN noy THEN 0 ELSE 100.0 - coalesce(list_sum(y), 0) END::DOUBLE AS year_score,
 CASE WHEN noab THEN 0 ELSE 100.0 - coalesce(list_sum(b), 0) END::DOUBLE AS abstract_score, 100.0::DOUBLE - coalesce(list_sum(k), 0) AS keywords_score,
 len(list_filter(t, lambda x: x IS NOT NULL)) + ai + CASE WHEN noy THEN 1 ELSE len(list_filter(y, lambda x: x IS NOT NULL)) END + CASE WHEN noab THEN 1 ELSE len(list_filter(b, lambda x: x IS NOT NULL)) END + len(list_filter(k, lambda x: x IS NOT NULL)) AS n_issues,
 len(list_filter([t[1], t[2], t[3], t[6]], lambda x: x IS NOT NULL)) + ai + CASE WHEN noy OR y[1] IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN noab OR b[1] IS NOT NULL THEN 1 ELSE 0 END AS n_critical FROM pts),
final AS (SELECT *, title_score * 0.25 + authors_score * 0.2 + year_score * 0.15 + abstract_score * 0.25 + keywords_score * 0.15 AS o FROM scored),
leveled AS (SELECT *, CASE WHEN o >= 90 THEN 'excellent' WHEN o >= 75 THEN 'good' WHEN o >= 60 THEN 'acceptable' WHEN o >= 40 THEN 'poor' ELSE 'critical' END AS level FROM final)"""
PRICED = f"""{ad.USAGE}, priced AS (SELECT *, CASE model WHEN 'view' THEN 2.0 * tokens / 2000 WHEN 'purchase' THEN 0.25 ELSE 0 END::DOUBLE AS cost FROM usage)"""
V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def _knn(k: int, where: str) -> str:
    return f"{V}, nn AS (SELECT q.id AS query, x.id AS id, list_cosine_similarity(q.v, x.v) AS s, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, x.v) DESC, x.id) AS rank FROM v q JOIN v x ON q.id <> x.id WHERE {where} QUALIFY rank <= {k})"


EDGES = _knn(5, "true") + ", e AS MATERIALIZED (SELECT DISTINCT least(query, id) AS a, greatest(query, id) AS b FROM nn), s AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), d AS MATERIALIZED (SELECT a AS node, count(*) AS degree FROM s GROUP BY 1)"
THIRD = EDGES.replace("FROM nn)", "FROM nn WHERE (query + id) % 3 = 0)")
COMP = ", r(node, other) AS (SELECT node, node FROM d UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.other), c AS MATERIALIZED (SELECT node, min(other) AS component FROM r GROUP BY 1)"


def _bfs(sources: str) -> str:
    return f", r(source, node, dist) AS (SELECT node, node, 0::BIGINT FROM d WHERE {sources} UNION SELECT r.source, s.b, r.dist + 1 FROM r JOIN s ON s.a = r.node WHERE r.dist < 12), m AS (SELECT source, node, min(dist) AS distance FROM r GROUP BY 1, 2)"


ORACLE = {
    "qlt_scores": f"WITH {META} SELECT id, title_score, authors_score, year_score, abstract_score, keywords_score, round(o, 6) AS overall, level, n_issues FROM leveled",
    "agg12_quality_summary": f"WITH {META} SELECT level, count(*) AS papers, round(avg(o), 6) AS mean_score, round(count(*) * 100.0 / (SELECT count(*) FROM leveled), 6) AS percent FROM leveled GROUP BY 1",
    "flt9_critical_issues": f"WITH {META} SELECT id, n_critical AS n FROM leveled WHERE n_critical > 0",
    "agg14_usage_rollup": f"WITH {ad.USAGE} SELECT day::VARCHAR AS day, provider, model, count(*) AS requests, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, coalesce(sum(tokens), 0)::BIGINT AS tokens, round(avg(response_time), 6) AS avg_response_time FROM usage GROUP BY ALL",
    "agg18_cost": f"WITH {PRICED} SELECT model, count(*) AS requests, round(sum(cost), 4) AS cost FROM priced GROUP BY 1",
    "agg15_daily_report": f"WITH {ad.USAGE}, b AS (SELECT day, model, count(*) AS requests, count(*) FILTER (success) AS ok FROM usage GROUP BY 1, 2) SELECT day::VARCHAR AS day, model, requests, round(ok * 100.0 / requests, 6) AS success_percent, round(requests * 100.0 / sum(requests) OVER (PARTITION BY day), 6) AS share_percent FROM b",
    "agg15_first_errors": f"WITH {ad.USAGE} SELECT day::VARCHAR AS day, row_number() OVER (PARTITION BY day ORDER BY event_id) AS nth, event_id, model FROM usage WHERE NOT success QUALIFY nth <= 5",
    "agg16_weekly_report": f"""WITH {PRICED}, b AS (SELECT model, count(*) AS requests, sum(tokens)::BIGINT AS tokens, sum(cost) AS cost FROM priced WHERE day > (SELECT max(day) FROM usage) - 7 GROUP BY 1)
 SELECT model, requests, tokens, round(cost, 4) AS cost, round(requests / 7, 4) AS requests_per_day, round(CASE WHEN sum(cost) OVER () > 0 THEN cost * 100 / sum(cost) OVER () ELSE 0 END, 4) AS cost_percent, round(cost / requests, 4) AS cost_per_request FROM b""",
    "agg17_quota": f"""WITH {ad.USAGE}, b AS (SELECT model, count(*) AS used, CASE model WHEN 'click' THEN 1000 WHEN 'view' THEN 2200 WHEN 'purchase' THEN 100000 END AS lim FROM usage GROUP BY 1)
 SELECT model, used, CASE WHEN lim IS NULL THEN 'ok' WHEN used >= lim THEN 'exceeded' WHEN used >= lim * 0.8 THEN 'warning' ELSE 'ok' END AS status FROM b""",
    "top11_model_choice": f"""WITH {ad.USAGE}, b AS (SELECT model, model <> 'error' AND count(*) % 2 = 0 AS ok FROM usage GROUP BY 1), p(model, pos) AS (VALUES ('error', 0), ('view', 1), ('click', 2), ('purchase', 3), ('login', 4), ('logout', 5))
 SELECT r_name AS task, arg_min(p.model, pos) AS model FROM region, p JOIN b ON b.model = p.model WHERE ok AND NOT (r_regionkey = 1 AND p.model IN ('view', 'click')) GROUP BY 1""",
    "vec1_search_one": f"WITH {V} SELECT x.id, round(list_cosine_similarity(q.v, x.v), 6) AS similarity FROM v q, v x WHERE q.id = 3 AND x.label <> 0 ORDER BY list_cosine_similarity(q.v, x.v) DESC, x.id LIMIT 10",
    "vec2_similar_to_items": f"WITH {_knn(10, 'q.id % 20 = 0')} SELECT query, id, round(s, 6) AS similarity, rank FROM nn",
    "vec4_auto_links": f"WITH {_knn(15, 'q.id % 5 = 0')} SELECT query, id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS link FROM nn WHERE s >= 0.3 QUALIFY link <= 5",
    "vec5_l2sq_metric": f"WITH {_knn(5, 'q.id % 50 = 0')} SELECT query, id, round(2 * s - 1, 6) AS similarity FROM nn",
    "agg20_retrieval_metrics": f"""WITH {_knn(10, 'q.id % 20 = 0')}, t AS (SELECT q.id AS query, count(*) AS n FROM v q JOIN v x ON q.label = x.label AND q.id <> x.id WHERE q.id % 20 = 0 GROUP BY 1),
 h AS (SELECT nn.query, count(*) AS k, min(rank) AS first FROM nn JOIN v q ON q.id = nn.query JOIN v x ON x.id = nn.id AND x.label = q.label GROUP BY 1)
 SELECT t.query, round(coalesce(k, 0) / n, 6) AS recall, round(coalesce(k, 0) / 10, 6) AS precision, round(coalesce(1.0 / first, 0)::DOUBLE, 6) AS rr FROM t LEFT JOIN h USING (query)""",
    "grf8_degrees": f"WITH {EDGES} SELECT node, degree, round(degree / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d",
    "top2_hubs": f"WITH {EDGES} SELECT node, degree FROM d ORDER BY degree DESC, node LIMIT 10",
    "agg13_network_statistics": f"WITH {EDGES} SELECT count(*) AS nodes, (sum(degree) / 2)::BIGINT AS edges, round(avg(degree), 2) AS mean_degree, max(degree) AS max_degree, min(degree) AS min_degree, round((sum(degree) / (count(*) * (count(*) - 1)))::DOUBLE, 4) AS density FROM d",
    "grf2_components": f"WITH RECURSIVE {THIRD}{COMP} SELECT node, component FROM c",
    "grf11_page_rank": f"""WITH RECURSIVE {EDGES}, n AS (SELECT count(*) AS n FROM d), p(i, node, rank) AS (SELECT 0, node, 1.0::DOUBLE / n FROM d, n
 UNION ALL SELECT p.i + 1, s.b, 0.15::DOUBLE / any_value(n.n) + 0.85::DOUBLE * sum(p.rank / d.degree) FROM p JOIN s ON s.a = p.node JOIN d ON d.node = p.node, n WHERE p.i < 12 GROUP BY p.i, s.b)
 SELECT node, round(rank, 8) AS rank FROM p WHERE i = 12""",
    "grf5_distances": f"WITH RECURSIVE {EDGES}{_bfs('node = 0')} SELECT node, distance FROM m",
    "grf10_closeness": f"WITH RECURSIVE {EDGES}{_bfs('node IN (SELECT a FROM e WHERE a % 25 = 0)')} SELECT source AS node, round(coalesce(count(*) FILTER (distance > 0) / nullif(sum(distance), 0), 0)::DOUBLE, 8) AS closeness FROM m GROUP BY 1",
    "grf6_simple_paths": f"WITH RECURSIVE {EDGES}, t AS (SELECT max(b) AS t FROM e WHERE a = 1), p(path, z) AS (SELECT [1::BIGINT], 1::BIGINT UNION ALL SELECT list_append(path, s.b), s.b FROM p JOIN s ON s.a = p.z, t WHERE len(path) <= 4 AND p.z <> t.t AND NOT list_contains(path, s.b)) SELECT array_to_string(path, '>') AS path FROM p, t WHERE z = t.t",
    "grf4_communities": f"""WITH RECURSIVE {THIRD}{COMP}, i AS (SELECT c.component, count(*) / 2 AS internal FROM s JOIN c ON c.node = s.a GROUP BY 1)
 SELECT c.component AS community, count(*) AS size, arg_max(c.node, d.degree * 1000000 - c.node) AS hub, array_to_string(list_sort(list(c.node))[1:5], ',') AS first_members, round(2 * any_value(internal) / (count(*) * (count(*) - 1)), 6) AS density FROM c JOIN d ON d.node = c.node JOIN i ON i.component = c.component GROUP BY 1 HAVING count(*) > 1""",
    "grf7_influential_paths": f"WITH RECURSIVE {EDGES}, h AS (SELECT node FROM d ORDER BY degree DESC, node LIMIT 10){_bfs('node IN (SELECT node FROM h)')} SELECT source, node, distance FROM m WHERE node IN (SELECT node FROM h) AND source < node AND distance >= 2 ORDER BY distance, source, node LIMIT 20",
}
#: On whole tables, where the SQL of the query without _all holds a part; without SQL themselves.
WHOLE = ("vec5_l2sq_metric_all", "grf2_components_all", "grf4_communities_all", "grf10_closeness_all")
QUERIES = {k: v for k, v in globals().items() if k in ORACLE or k in WHOLE or k in ("agg12_top_issues", "grf3_louvain", "grf9_betweenness", "pip6_all_centralities")}
