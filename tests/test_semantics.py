"""Operators that SQL cannot express, against golden cases and plain Python versions."""

from __future__ import annotations

import json
import random
from difflib import SequenceMatcher

import pytest

from pyspark.sql import functions as F

from scholia.operators import cooccurrence, graph, grounding, parse, relations, resolve, search
from scholia.streaming import usage_stream

# --- grounding: golden cases ---

SOURCE = "Mental simu-\nlation  helps readers compre- \n hend text. It “re-uses” perceptual systems, as many studies show in detail."


@pytest.mark.parametrize("core, source, verdict, disposition", [
    ("Mental simulation helps readers comprehend text.", SOURCE, "EXACT", "keep"),
    ('It "re-uses" perceptual systems', SOURCE, "EXACT", "keep"),
    ("It \"reuses\" perceptualsystems", SOURCE, "EXACT_NOSPACE", "keep"),
    ("It “re-uses” perceptual system, as many study show in detail.", SOURCE, "DRIFTED_MINOR", "keep"),
    ("Quantum fields have no mass gap at all here", SOURCE, "NOT_FOUND", "erase"),
    ("心智模擬有助於理解", SOURCE, "CJK_UNVERIFIABLE", "quarantine"),
    ("心智模擬", "", "CJK_UNVERIFIABLE", "quarantine"),
    ("Text that trails off...", SOURCE, "NO_DESC", "erase"),
    ("placeholder", SOURCE, "NO_DESC", "erase"), ("", SOURCE, "NO_DESC", "erase"), (None, SOURCE, "NO_DESC", "erase"),
    ("anything", None, "NOT_FOUND", "erase"),
    ("ＡＢＣ １", "x ABC 1 y", "EXACT", "keep"),
])
def test_ground(core, source, verdict, disposition):
    got = grounding.ground(core, source)
    assert (got[0], got[5]) == (verdict, disposition)
    if disposition == "keep":
        assert source[got[3] : got[4]] == got[2]


def test_documents_of_drifted_short_and_lost_claims(spark, tmp_path):
    from scholia.plans import texts

    told = "Readers of long notes often keep one changed word near the start of each card they have written down"
    docs = [(1, f"Before. {told}. After."), (2, "It says deep well-known cards matter here."), (3, "nothing like it at all")]
    claims = [(1, told.replace("long", "lengthy")), (2, "deep well-known cards matter"), (3, "no source has ever held this claim of ours"), (4, "nothing"), (5, told)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(claims, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.claim, r.source): r.verdict for r in texts.gnd2_benchmark_in_documents(spark, str(tmp_path)).collect()}
    assert got[1, 1] == "DRIFTED_MINOR" and got[2, 2] == got[4, 3] == got[5, 1] == "EXACT" and got[3, None] == "NOT_FOUND"


def test_normalise_and_spacing():
    assert grounding.normalise("  a \n b-\n c’ ﬁ ")[0] == "a bc' fi"
    assert grounding.same_up_to_spacing("re-use it", "reuse  it") and not grounding.same_up_to_spacing("a", "b")


def test_normalise_places_and_gate(spark):
    raw = " “A\u00a0 b” co-\n  op ﬁx - y\t"
    text, at = grounding.normalise(raw)
    assert text == '"A b" coop fix - y' and len(at) == len(text) and all(raw[i] in " \u00a0" if c == " " else True for c, i in zip(text, at))
    long = "word " * 60 + "a claim that stands here"
    rows = [("a", "a claim that stands here", long), ("b", "a claim that stands here", "too short"), ("c", "nowhere to be found, this other one", long), ("d", "x y", None)]
    got = {r.id: (r.verdict, r.disposition) for r in grounding.gate(spark.createDataFrame(rows, "id string, core string, source string")).collect()}
    assert got == {"a": ("EXACT", "keep"), "b": ("UNCHECKED", "keep"), "c": ("NOT_FOUND", "erase"), "d": ("UNCHECKED", "keep")}


def test_upsert_without_paths(spark):
    from scholia.operators import store

    schema = "id long, title string, doi string, cite_key string, file_path string"
    old = spark.createDataFrame([(1, "One", "10.1/a", None, "p1"), (2, "Two", None, "k2", "p2")], schema)
    new = spark.createDataFrame([(0, "One b", "10.1/a", None, None), (0, "New", None, None, None), (0, "Newer", "10.1/z", None, None), (0, "Two b", None, "k2", "p9")], schema)
    got = sorted((r.id, r.title, r.action) for r in store.upsert_papers(old, new).collect())
    assert got[:2] == [(1, "One b", "updated"), (2, "Two b", "updated")]
    assert sorted(x[1:] for x in got[2:]) == [("New", "inserted"), ("Newer", "inserted")] and [x[0] for x in got[2:]] == [3, 4]


def test_nearest_leaves_out_vectors_without_direction(spark):
    from scholia.operators import vectors

    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [])], "id long, v array<double>")
    assert [(r["query"], r.id) for r in vectors.nearest(df, df, 3).orderBy("query", "id").collect()] == [(1, 2), (2, 1)]


# --- parsing ---


def test_generated_cards():
    text = "noise\n===CARD: Doe-2020-001===\n標題: A title\n類型: method\n核心: the core\n標籤: x, y\n\n說明:\nline 1\nline 2\n\n**連結語系**：\n基於 -> Doe-2020-002, Roe1999-001\n相關 <-> [[Doe-2020-003|shown]], [[file.pdf]]\n\n個人筆目:\nmine\n===CARD: none===\nno title here\n"
    cards = parse.generated_cards(text)
    assert len(cards) == 1
    c = cards[0]
    assert (c["title"], c["card_type"], c["core_summary"], c["tags"]) == ("A title", "method", "the core", ["x", "y"])
    assert c["detailed_explanation"] == "line 1\nline 2" and c["personal_notes"] == "mine"
    assert c["foundation_links"] == ["Doe-2020-002", "Roe1999-001"] and c["related_links"] == ["Doe-2020-003"]


def test_slides():
    assert [s["title"] for s in parse.slides("===標題頁===\na\n===B===\nb")] == ["標題頁", "B"]
    assert parse.slides("**投影片 1：One**\nx\n**投影片 2: Two**\ny")[0] == {"title": "One", "content": "x", "type": "title"}
    assert [s["type"] for s in parse.slides("# A\nx\n## B\ny")] == ["title", "content"]
    assert parse.slides("nothing") == []


def test_bibliographies(spark):
    ris = "TY  - JOUR\nTI  - First\nAU  - Doe,  Jane\nAU  - Roe, Max\nPY  - 2024/01/15\nAB  - long\ntext\nKW  - a\nDO  - https://doi.org/10.1/x\nSP  - 3\nEP  - 9\nER  -\nTY  - BOOK\nAU  - X\nER  - \n"
    bib = '@article{doe2020,\n title = {A {Nested} \\emph{title}},\n author = {Doe, Jane and M{\\"u}ller, Max},\n year = "2020", keywords = {x; Y, x},\n}\n@comment{z, }\n@book{b1, title={T2}}'
    df = spark.createDataFrame([(ris.encode("latin-1"),)], "content binary")
    r = parse.bibliography(df, "ris").collect()
    assert len(r) == 1 and (r[0].title, r[0].authors, r[0].year, r[0].abstract, r[0].doi, r[0].pages) == ("First", ["Doe, Jane", "Roe, Max"], 2024, "long text", "10.1/x", "3-9")
    b = parse.bibliography(spark.createDataFrame([(bib.encode(),)], "content binary"), "bibtex").collect()
    assert [x.id for x in b] == ["doe2020", "b1"] and b[0].title == "A Nested title" and b[0].authors == ["Doe, Jane", "Müller, Max"] and b[0].keywords == ["x", "Y"] and b[0].year == 2020


def test_parsed_rows_and_small_parsers(spark):
    df = spark.createDataFrame([(1, "# A\nx"), (2, None)], "id long, text string")
    rows = parse.parsed(df, "slides", "id", "text").collect()
    assert [(r.id, r.position, json.loads(r.record)["title"]) for r in rows] == [(1, 1, "A")]
    assert parse.strip_references("body " * 20 + "\n 6. References \n[1]") == (("body " * 20).rstrip(), True)
    assert parse.strip_references("References\n" + "body " * 20) == ("References\n" + "body " * 20, False)
    assert parse.rewrite_links("[[a]] [[b]] [[a|x]] [[p.pdf]]", {"a": "n"}) == "[[n]] b [[a|x]] [[p.pdf]]"
    t = spark.createDataFrame([("## x\n**[AI Agent]**: keep\n**[Human]**: mine\nmore\n## y\nz",)], "c string").select(parse.ai_part(F.col("c")).alias("a"), parse.human_part(F.col("c")).alias("h")).collect()[0]
    assert "mine" not in t.a and "## y" in t.a and t.h == "mine\nmore"
    x = spark.createDataFrame([("CogSci20251028001",), ("AI_20251029_005",), ("odd",)], "c string").select(parse.normal_card_id(F.col("c")).alias("c"), parse.card_domain(parse.normal_card_id(F.col("c"))).alias("d")).collect()
    assert [tuple(r) for r in x] == [("CogSci-20251028-001", "CogSci"), ("AI-20251029-005", "AI"), ("odd", "Unknown")]


# --- resolution ---


def test_ratio_bounds_lose_nothing():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(12))) for _ in range(2))
        full = SequenceMatcher(None, a, b).ratio()
        for least in (0.5, 0.75):
            got = resolve.ratio(a, b, least)
            assert got == full or (got == 0.0 and full < least)


def test_duplicates_blocking_loses_no_pair(spark):
    rng = random.Random(2)
    papers = [(i, " ".join(rng.choice(["deep", "note", "card", "study", "of", "mind"]) for _ in range(4)), rng.sample(["a", "b", "c", "d"], rng.randint(1, 3)), rng.choice([None, 2000, 2003])) for i in range(60)]
    df = spark.createDataFrame(papers, "id long, title string, authors array<string>, year int")
    want = set()
    for i, ta, aa, ya in papers:
        for j, tb, ab, yb in papers:
            if i < j:
                near = max(0.0, 1 - (abs(ya - yb) if ya and yb else 10) / 10)
                if 0.6 * SequenceMatcher(None, ta, tb).ratio() + 0.3 * len(set(aa) & set(ab)) / len(set(aa) | set(ab)) + 0.1 * near >= 0.85:
                    want.add((i, j))
    assert {(r.id_a, r.id_b) for r in resolve.duplicates(df).collect()} == want and want


@pytest.mark.parametrize("threshold", [0.6, 0.8, 1.0])
def test_best_titles_lose_no_pair(spark, monkeypatch, threshold):
    monkeypatch.setattr(resolve, "TILE", 20, raising=False)
    rng = random.Random(5)
    title = lambda: "".join(rng.choice("abc 漢字學") for _ in range(rng.randrange(25)))
    near = lambda t: "".join(c if rng.random() < 0.85 else rng.choice("ab字") for c in t)
    right = [(1, "Photosynthesis"), (2, "深度學習的方法"), (3, None)] + [(i, title()) for i in range(4, 90)]
    left = [(1, "photosynthesys"), (2, "深度學習之方法"), (3, "")] + [(i, near(right[i % 90 - 1][1] or "x")) for i in range(4, 90)]
    want = {}
    for l, a in left:
        of = [(-SequenceMatcher(None, a.strip().lower(), b.strip().lower()).ratio(), r) for r, b in right if (b or "").strip() and a.strip()]
        if of and -min(of)[0] >= threshold:
            want[l] = (min(of)[1], -min(of)[0])
    got = resolve.best_titles(spark.createDataFrame(left, "l long, title string"), spark.createDataFrame(right, "r long, title string"), threshold)
    assert {r.l: (r.r, r.ratio) for r in got.collect()} == want and (threshold == 1.0 or {1, 2} <= set(want))


def test_match_chain_tiers(spark):
    kind = "{} long, title string, authors array<string>, year int"
    right = [(1, "Deep notes", ["Roe, Max"], 2001), (2, "Photosynthesis", ["Doe, Jane"], 2002), (3, "Cards", ["Jane Doe", "B. Li"], 2003), (4, "Other cards", ["Doe, J."], 2003)]
    left = [(1, "deep NOTES ", [], None), (2, "photosynthesys", ["X"], 1990), (3, "Quite another title", ["J. Doe"], 2003), (4, "Yet another one", ["J. Doe"], 2005), (5, "No such thing", [], 2003), (6, "Nor that here", None, None)]
    got = resolve.match_chain(spark.createDataFrame(left, kind.format("l")), spark.createDataFrame(right, kind.format("r")))
    got = {r.l: (r.r, r.match_type, round(r.score, 3)) for r in got.collect()}
    assert got == {1: (1, "exact", 1.0), 2: (2, "fuzzy", 0.929), 3: (4, "author_year", 1.0), 4: (None, "new", 0.0), 5: (None, "new", 0.0), 6: (None, "new", 0.0)}


def test_cite_keys():
    assert resolve.normal_cite_key("Günther-2025a") == "Guenther-2025a" and resolve.normal_cite_key("Créquit 2018!") == "Crequit2018" and resolve.normal_cite_key(None) == ""


# --- graphs ---


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(3)
    return graph.cut(spark.createDataFrame([(rng.randrange(25), rng.randrange(25)) for _ in range(45)], "a long, b long"))


def neighbours(edges):
    near: dict = {}
    for r in edges.collect():
        if r.a != r.b:
            near.setdefault(r.a, set()).add(r.b)
            near.setdefault(r.b, set()).add(r.a)
    return near


def paths_between(near, s, t):
    level, found = [[s]], []
    while level and not found:
        found = [p for p in level if p[-1] == t]
        level = [[*p, y] for p in level for y in near[p[-1]] if y not in p]
    return found


def test_betweenness(edges):
    near = neighbours(edges)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        for t in near:
            if s != t and (ps := paths_between(near, s, t)):
                for p in ps:
                    for x in p[1:-1]:
                        want[x] += 1 / len(ps)
    n = len(near)
    got = {r.node: r.betweenness for r in graph.betweenness(edges).collect()}
    assert all(abs(got[x] - v / ((n - 1) * (n - 2))) < 1e-9 for x, v in want.items())


def test_louvain_and_paths(spark):
    clique = lambda xs: [(a, b) for a in xs for b in xs if a < b]
    e = spark.createDataFrame([*clique(range(5)), *clique(range(10, 15)), (4, 10)], "a long, b long")
    got = {r.node: r.community for r in graph.louvain(e).collect()}
    assert len(got) == 10
    d = graph.distances(e, spark.createDataFrame([(0,)], "node long"))
    assert graph.shortest_path(d, 0, 14) == [0, 4, 10, 14] and graph.shortest_path(d, 0, 99) == []
    rank = graph.page_rank(e, rounds=60)
    assert abs(rank.agg(F.sum("rank")).collect()[0][0] - 1) < 1e-6


# --- search, relations, streaming ---


def test_closeness_by_bits(spark, monkeypatch):
    """closeness by searches of a bit each is that of the tables, for all nodes or some."""
    rng = random.Random(12)
    pairs = [(rng.randrange(150) * 3, rng.randrange(150) * 3) for _ in range(190)] + [(1000, 1001), (7, 7)]
    e = spark.createDataFrame(pairs, "a long, b long")
    table = lambda df: {r.node: r.closeness for r in df.collect()}
    nodes = graph.symmetric(e).select(F.col("a").alias("node")).distinct()
    want = table(graph.closeness(graph.distances(e, nodes)))
    assert table(graph.closeness_from(e)) == want and len(want) > 64
    some = spark.createDataFrame([(n,) for n in [*sorted(want)[::2], -5]], "node long")
    part = {n: want.get(n, 0.0) for n in [*sorted(want)[::2], -5]}
    assert table(graph.closeness_from(e, some)) == part
    monkeypatch.setattr(graph, "MAX_LINKS", 1)
    assert table(graph.closeness_from(e, some)) == part
    assert graph.closeness_from(e.limit(0)).count() == 0


def test_betweenness_of_more_than_20_000_nodes(spark):
    """hubs of large graphs, and no nodes at all."""
    assert graph.betweenness(spark.createDataFrame([], "a long, b long")).count() == 0
    many = 20_100
    star = spark.range(1, many).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = graph.betweenness(star, spark.createDataFrame([(5,), (0,)], "node long"))
    assert got.count() == many and abs(got.where("node = 0").collect()[0].betweenness - many / 2 / (many - 1)) < 1e-9


def test_distances_on_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(33)], "a long, b long")
    got = graph.distances(e, spark.createDataFrame([(0,)], "node long"))
    assert {r.node: r.distance for r in got.collect()} == {i: i for i in range(34)}
    assert graph.closeness(got).collect()[0].closeness == 33 / sum(range(34))
    assert graph.distances(e, spark.createDataFrame([(0,)], "node long"), 2).count() == 3


def test_whole_tables(spark, monkeypatch):
    """The registered queries lose nothing outside the id ranges and residues of the SQL."""
    from scholia.plans import analytics, relational, texts

    pairs = [(1, 2), (2, 3), (3, 5), (5, 8), (11, 12), (12, 14)]  # sums of all residues
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want, least, sizes = {}, {}, {}
    for x in near:
        dist, order = {x: 0}, [x]
        for y in order:
            for z in near[y] - set(dist):
                dist[z] = dist[y] + 1
                order.append(z)
        want[x], least[x] = round((len(dist) - 1) / sum(dist.values()), 8), min(dist)
        sizes[min(dist)] = len(dist)
    monkeypatch.setattr(analytics, "edges", lambda s, d: s.createDataFrame(pairs, "a long, b long"))
    q = analytics.QUERIES
    assert {r.node: r.component for r in q["grf2_components_all"](spark, "").collect()} == least
    assert {r.community: r["size"] for r in q["grf4_communities_all"](spark, "").collect()} == sizes
    assert {r.node: r.closeness for r in q["grf10_closeness_all"](spark, "").collect()} == want
    v = [(i, [float(i), 1.0], 0) for i in range(1, 12)]
    monkeypatch.setattr(analytics, "_vectors", lambda s, d: s.createDataFrame([(i, x, c) for i, x, c in v], "id long, v array<float>, label int"))
    assert {r.query for r in q["vec5_l2sq_metric_all"](spark, "").collect()} == set(range(1, 12))

    papers = spark.createDataFrame([(i, f"On deep notes and cards {i}", 2000) for i in range(3000, 3500)], "id long, title string, year int")
    for m in (relational, texts):
        monkeypatch.setattr(m.ad, "papers", lambda s, d: papers)
    monkeypatch.setattr(relational.ad, "bridge", lambda s, d: s.createDataFrame([(3000, 1)], "paper_id long, card_id long"))
    assert [r.id for r in relational.QUERIES["agg22_reading_order_all"](spark, "").collect()] == [*range(3001, 3500), 3000]
    monkeypatch.setattr(texts.ad, "paper_authors", lambda s, d: s.createDataFrame([(3000, "a"), (3001, "a")], "paper_id long, author string"))
    assert [(r.id_a, r.id_b) for r in texts.ent3_duplicates(spark, "").collect()] == [(3000, 3001)]
    monkeypatch.setattr(texts.ad, "table", lambda s, d, n: s.createDataFrame([(i, f"{w} things", "tin", "b", 1) for i, w in ((600, "one"), (620, "seventeen"))], "p_partkey long, p_name string, p_type string, p_brand string, p_size int"))
    assert {(r.l, r.r, r.match_type) for r in texts.ent5_match_chain(spark, "").collect()} == {(600, 600, "exact"), (620, 620, "fuzzy")}


def test_query_syntax(spark):
    df = spark.createDataFrame([(1, "deep learning models", "x"), (2, "deep notes", "learning"), (3, "shallow learner", "y")], "id long, a string, b string")
    ids = lambda q: [r.id for r in search.search(df, q, "id", ["a", "b"]).collect()]
    assert sorted(ids("deep learning")) == [1, 2] and sorted(ids("learn*")) == [1, 2, 3] and ids("b:learning") == [2]
    assert sorted(ids("notes OR shallow")) == [2, 3] and ids("deep NOT notes") == [1]
    for bad in ("deep-learning", "NOT deep", "deep NOT"):
        with pytest.raises(ValueError):
            search.parse_query(bad)


def test_link_strength_and_types(spark):
    notes = "## 個人筆記\n**[AI Agent]**: this extends [[b]] well\n**[Human]**: x\n"
    rows = [(notes, 1.0), ("## 連結網絡\n基於 -> [[b]]\n", 0.8), ("## 連結網絡\n[[b]]\n", 0.6), ("## 來源脈絡\nsee [[b]]\n", 0.4), ("plain [[b]]", 0.3), ("none", 0.0), (None, 0.0)]
    df = spark.createDataFrame(rows, "c string, want double")
    assert all(r.got == r.want for r in df.select("want", relations.link_strength(F.col("c"), F.lit("b")).alias("got")).collect())
    cases = [("[[b]] leads to", "", 0.9, "leads_to"), ("[[b]] based on", "", 0.9, "based_on"), ("x", "However", 0.9, "contrasts_with"), ("Abstract", "", 0.9, "superclass_of"), ("an instance", "", 0.9, "subclass_of"), ("thus", "", 0.6, "leads_to"), ("thus", "", 0.8, "related_to")]
    df = spark.createDataFrame(cases, "x string, y string, s double, want string")
    assert all(r.got == r.want for r in df.select("want", relations.relation_type(F.col("x"), F.col("y"), F.lit("b"), F.col("s")).alias("got")).collect())


def test_streaming_rollup_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    last = events.agg(F.max("ts").alias("t")).collect()[0].t
    events.unionByName(spark.createDataFrame([(last, "end", 0)], events.schema).withColumn("ts", F.col("ts") + F.expr("INTERVAL 9 DAYS"))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = usage_stream.daily_counts(stream).writeStream.outputMode("append").format("memory").queryName("rollup").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = events.groupBy(F.to_date("ts").alias("day"), "model").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    assert sorted(map(tuple, spark.table("rollup").collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("most", [10**6, 0])
def test_co_occurrence_moves_no_pairs(spark, monkeypatch, most):
    """members count their partners in one place; strings order the pair."""
    monkeypatch.setattr(cooccurrence, "MAX_MEMBERSHIPS", most)
    rng = random.Random(21)
    rows = [(rng.randrange(12), rng.choice("é z A b cc d e f g".split())) for _ in range(90)] + [(3, None), (None, "z"), (None, "b"), (40, "alone")]
    groups = {}
    for g, m in rows:
        if m is not None:
            groups.setdefault(m, set()).add(g)
    want = {}
    for a in groups:
        for b in groups:
            if a.encode() < b.encode() and len(k := (groups[a] & groups[b]) - {None}) >= 2:
                want[a, b] = (len(k), len(k) / max(len(groups[a]), len(groups[b])))
    df = spark.createDataFrame(rows, "folder long, concept string")
    got = cooccurrence.co_occurrence(df, 2, False, "folder", "concept")
    assert {(r.a, r.b): (r.shared, r.strength) for r in got.collect()} == want and want
    assert cooccurrence.co_occurrence(df.limit(0), 2, False, "folder", "concept").count() == 0


def test_duplicates_by_bounds_of_each_pair(spark):
    """padded titles, one common author, authors with gaps, and all bounds against all pairs."""
    rng = random.Random(31)
    words = ["on", "deep", "notes", "cards", "12", "13"]
    rows = [(i, rng.choice(["", " " * 40]) + " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 4]))) + rng.choice(["", "\t "]), rng.sample(["a", "b", "c", "d", "e", None], rng.randint(1, 5)), rng.choice([1990, 1991, 1999, None])) for i in range(110)]
    for t in (0.85, 0.92, 0.72):
        want = {}
        for i, ti, ai, yi in rows:
            for j, tj, aj, yj in rows:
                common = len((set(ai) & set(aj)) - {None})
                if i < j and common:
                    jac = common / (len(set(ai)) + len(set(aj)) - common)
                    near = max(0.0, 1 - (10 if None in (yi, yj) else abs(yi - yj)) / 10)
                    x = 0.6 * resolve.ratio(ti.strip().lower(), tj.strip().lower()) + 0.3 * jac + 0.1 * near
                    if x >= t:
                        want[i, j] = round(x, 9)
        got = resolve.duplicates(spark.createDataFrame(rows, "id long, title string, authors array<string>, year int"), t).collect()
        assert len(got) == len(want) and {(r.id_a, r.id_b): round(r.score, 9) for r in got} == want


def test_best_titles_compare_equal_titles_once(spark):
    """F8: copies on both sides, of the smallest r each, also by year."""
    left = [(i, ["deep notes", " Deep Notes ", "shallow cards", ""][i % 4], 2000 + i % 3) for i in range(400)]
    right = [(1000 + i, ["deep note", "DEEP NOTE", "shallow card", "other things"][i % 4], 2000 + i % 2) for i in range(400)]
    df = spark.createDataFrame(left, "l long, title string, year long"), spark.createDataFrame(right, "r long, title string, year long")
    got = {r.l: r.r for r in resolve.best_titles(df[0].drop("year"), df[1].drop("year"), 0.8).collect()}
    assert got == {l: 1000 if "eep" in t else 1002 for l, t, _ in left if t}
    got = {r.l: r.r for r in resolve.best_titles(*df, 0.8, by="year").collect()}
    first = {}
    for r, t, y in right:
        first.setdefault((t.lower(), y), r)
    assert got == {l: r for l, t, y in left if t and (r := first.get(("deep note" if "eep" in t else "shallow card", y)))}


@pytest.mark.parametrize("threshold", [0.65, 0.4, 1.0])
def test_similar_titles_are_all_pairs_above_the_threshold(spark, threshold):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["a", "B", "c", "deep", "深度", "e", "f", "g"]) for _ in range(rng.randint(1, 6)))) for i in range(120)] + [(900, None), (901, " ")]
    sets = {i: set(t.lower().split()) for i, t in rows if t and t.split()}
    want = {(i, j): len(x & y) / len(x | y) for i, x in sets.items() for j, y in sets.items() if i < j and len(x & y) / len(x | y) >= threshold}
    got = cooccurrence.similar_titles(spark.createDataFrame(rows, "id long, title string"), threshold).collect()
    assert len(got) == len(want) and {(r.id_a, r.id_b): r.similarity for r in got} == want
    assert all(r.common == " ".join(sorted(sets[r.id_a] & sets[r.id_b])) for r in got)
