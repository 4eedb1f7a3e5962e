"""Links, imports, networks and readers against plain Python and small cases."""

from __future__ import annotations

import itertools
import json
import random
from collections import deque
from difflib import SequenceMatcher

import numpy as np
import pytest

from pyspark.sql import functions as F

from scholia.functions import keys
from scholia.operators import export, graph, linking, network, paths
from scholia.sources import files


def test_contained(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("ab深 ") for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(60, None)]
    needles = ["a", "深a", "abab", "", "b" * 9, "ab a深 b a", None] + [t[3:14] for _, t in texts[:20]]
    got = linking.contained(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(texts, "t long, text string"))
    want = {(n, i) for n in needles if n for i, t in texts if t and n in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert linking.contained(spark.createDataFrame([], "needle string"), spark.createDataFrame(texts, "t long, text string")).count() == 0


def test_back_fill(spark):
    papers = spark.createDataFrame([(1, "On the Origin of Birds", 1999, None), (2, "A Study of Rings", None, ""), (3, "A study of rings, again", 2001, "old"), (4, None, 2000, None), (5, "Kept", 2000, "own")], "id long, title string, year long, cite_key string")
    entries = spark.createDataFrame([("a", "origin of birds", 1999), ("b", "Origin of Birds", 1998), ("c", "a study of rings", 2001), ("d", "A Study of Rings", 1990), ("e", "nothing", 2000), ("f", None, 2000), ("g", "kept", 2000)], "cite_key string, title string, year long")
    out, told = linking.back_fill_by_title(papers, entries)
    assert {tuple(r) for r in told.collect()} == {("a", "updated", 1), ("b", "not_found", None), ("c", "ambiguous", None), ("d", "updated", 2), ("e", "not_found", None), ("f", "not_found", None), ("g", "has_key", 5)}
    assert {r.id: r.cite_key for r in out.collect()} == {1: "a", 2: "d", 3: "old", 4: None, 5: "own"}


def test_link_by_title(spark):
    rng = random.Random(5)
    words = ["ring", "widget", "深度學習", "steel", "of"]
    papers = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))), rng.choice([1999, 2000, None])) for i in range(40)] + [(90, "", 1999), (91, None, None)]
    infos = [f'"{" ".join(rng.choice(words) for _ in range(3))}"' + rng.choice(["", " (1999)", " (2000)"]) for _ in range(40)] + [None, "no quotes", '""']
    got = linking.link_by_title(spark.createDataFrame(list(enumerate(infos)), "card_id long, source_info string"), spark.createDataFrame(papers, "id long, title string, year long"))
    rows = {r.card_id: r for r in got.collect()}
    for i, info in enumerate(infos):
        if not info or not info.startswith('"') or info == '""':
            assert rows[i].status == "skipped"
            continue
        title, year = info.split('"')[1], info[-5:-1] if info.endswith(")") else None
        score = [(SequenceMatcher(None, title.lower().strip(), t.lower()).ratio() + (0.1 if year and y == int(year) else 0), -p) for p, t, y in papers if t]
        best, p = max(score)
        assert rows[i].status == ("linked" if best >= 0.7 else "unmatched")
        if best >= 0.7:
            assert abs(rows[i].score - best) < 1e-9
            assert rows[i].paper_id in {-q for s, q in score if abs(s - best) < 1e-9}


def test_link_cards_chain(spark):
    papers = spark.createDataFrame([(1, "Reference Grammar of Sound", 2016, "Ahrens-2016"), (2, "Mental Simulation", 2009, None), (3, "Unrelated work", 2016, "Yi-2009a")], "id long, title string, year long, cite_key string")
    cards = spark.createDataFrame([
        (1, "x", '"Ahrens2016_Reference_Grammar"'), (2, "zettel_Yi2009a_2025", None), (3, "x", '"Nobody-2009_Mental_Simulation"'), (4, "x", '"Mental simulations" (2009)'),
        (5, "x", None), (6, "x", '"Quantum chromodynamics"'), (7, "x", '"Zzz1950_Qq"'), (8, "x", '"Nobody2016_Aa"')], "card_id long, zettel_id string, source_info string")
    got = {r.card_id: (r.paper_id, r.method, r.status) for r in linking.link_cards(cards, papers).collect()}
    assert got == {1: (1, "cite_key", "linked"), 2: (3, "cite_key", "linked"), 3: (2, "author_year", "linked"), 4: (2, "fuzzy_match", "linked"), 5: (None, None, "skipped"),
                   6: (None, None, "unmatched"), 7: (None, None, "unmatched"), 8: (1, "author_year", "linked")}


def test_files(spark):
    entries = spark.createDataFrame([(1, "Müller-2001", "Sound change", ["Müller, Ann"], 2001), (2, "Yi-2009", "Rings", ["Ed Yi"], 2009), (3, "yi-2009", "Rings again", ["Bo Chu"], 2010)], "r long, cite_key string, title string, authors array<string>, year long")
    f = spark.createDataFrame([(1, "YI-2009", "x", [], None), (2, "scan", "sound changes", [], None), (3, "scan", "zzzz", ["Chu"], 2010), (4, "scan", "qqqq", ["Nobody"], 2010), (5, "scan", None, None, None)], "l long, name string, title string, authors array<string>, year long")
    assert {(r.l, r.r, r.method) for r in linking.files_to_entries(f, entries).collect()} == {(1, 3, "cite_key"), (2, 1, "title"), (3, 3, "author_year")}
    by = linking.files_by_key(spark.createDataFrame([(1, "Mueller-2001"), (2, "Yi-2008"), (3, "Qqqqqq-1000"), (4, None)], "l long, key string"), entries.select("r", "cite_key"))
    assert {(r.l, r.r): round(r.score, 3) for r in by.collect()} == {(1, 1): 1.0, (2, 2): round(SequenceMatcher(None, "yi-2008", "yi-2009").ratio(), 3)}
    third = linking.entries_by_key(entries.select(F.col("r").alias("id"), "cite_key"), spark.createDataFrame([("muller-2001",), ("mueller-2001",), ("Yi-2009",), ("YI-2009",), (None,)], "key string"))
    assert {tuple(r)[:2] + (r.tier,) for r in third.collect()} == {("mueller-2001", 1, 3), ("Yi-2009", 2, 1), ("YI-2009", 2, 2)}


def test_network(spark):
    rng = random.Random(1)
    edges = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(45)})
    conf = {e: rng.choice([None, 0.1, 0.25, 0.9]) for e in edges}
    table = spark.createDataFrame([(a, b, conf[a, b]) for a, b in edges], "a long, b long, confidence double")
    near = {n: sorted({b for a, b in edges if a == n} | {a for a, b in edges if b == n}) for e in edges for n in e}

    def shortest(s):
        dist, parent, todo = {s: 0}, {s: None}, deque([s])
        while todo:
            x = todo.popleft()
            for y in near[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    todo.append(y)
        for y in dist:
            parent[y] = min((x for x in near[y] if dist.get(x, 99) == dist[y] - 1), default=None)
        return dist, parent

    sure = lambda p: sum(0.5 if (c := conf[tuple(sorted(e))]) is None else c for e in itertools.pairwise(p)) / (len(p) - 1)
    hubs = sorted(near, key=lambda n: (-len(near[n]), n))[:10]
    want = []
    for s in hubs:
        dist, parent = shortest(s)
        for t in hubs:
            if s < t and dist.get(t, 0) >= 2:
                p = [t]
                while p[0] != s:
                    p.insert(0, parent[p[0]])
                want.append((round(-sure(p), 9), s, t, p))
    got = [(round(-r.confidence, 9), r.source, r.node, r.path) for r in network.influential_paths(table).collect()]
    assert got == sorted(want)[:20]
    done = network.analyse(table, spark.createDataFrame([(n, f"title {n}") for n in near], "node long, title string"))
    scores = {r.node: r for r in done["centralities"].collect()}
    assert set(scores) == set(near)
    for n in near:
        dist, _ = shortest(n)
        assert abs(scores[n].closeness - (len(dist) - 1) / sum(dist.values())) < 1e-9 and scores[n].degree == len(near[n])
    assert abs(sum(r["rank"] for r in scores.values()) - 1) < 1e-4
    top = done["key_concepts"].collect()
    assert [r.node for r in sorted(top, key=lambda r: r.place)] == sorted(scores, key=lambda n: (-scores[n]["rank"], n))[:20]
    assert {r.bridge for r in top} == {1, 2, 3, 4, 5, None} and done["nodes"].count() == len(near)
    assert done["paths"].count() == len(want[:20]) and graph.degrees(table).count() == len(near)


def test_rebuilt_links(spark):
    text = "## 連結網絡\n\n**基於** → [[Red-2020-001]], [[Red-2020-002]]\n\n**對比** ⚡ [[Blue-2021-003]]\n"
    cards = spark.createDataFrame([("c-1", text), ("c-2", ""), ("c-3", None)], "zettel_id string, content string")
    new, change = linking.rebuild_links(cards, spark.createDataFrame([("c-1", "基於", 0, "Red-2020-001"), ("c-9", "基於", 0, "Red-2020-009")], "card_id string, relation string, position int, target string"))
    assert {(r.card_id, r.relation, r.position, r.target) for r in new.collect()} == {("c-1", "基於", 0, "Red-2020-001"), ("c-1", "基於", 1, "Red-2020-002"), ("c-1", "對比", 0, "Blue-2021-003")}
    assert {tuple(r) for r in change.collect()} == {("kept", 1), ("added", 2), ("removed", 1)}


def test_sources(spark, tmp_path):
    folder = tmp_path / "zettel_Red 1991"
    folder.mkdir()
    (folder / "zettel_index.md").write_text('---\ntitle: Red-1991\npaper_title: "Rings: a study"\nauthors: Ann, Bo\nyear: 1991\ncard_count: 12\n---\n# x\n', encoding="utf-8")
    (folder / "plain.md").write_text("no head", encoding="utf-8")
    (tmp_path / "usage_2025-11-04.json").write_text(json.dumps({"date": "2025-11-04", "models": {"m1": {"provider": "p", "model": "m", "requests": 5, "successful": 3, "failed": 2, "tokens": 7, "cost": 0.5, "avg_response_time": 1.5, "task_types": {}}}}))
    (tmp_path / "usage_bad.json").write_text("{broken")
    rows = {r.name: r for r in linking.index_fields(files.texts(spark, str(tmp_path))).collect()}
    r = rows["zettel_index.md"]
    assert (r.folder, r.cite_key, r.paper_title, r.authors, r.year, r.card_count) == ("zettel_Red 1991", "Red-1991", "Rings: a study", "Ann, Bo", 1991, 12)
    assert rows["plain.md"].cite_key is None and rows["plain.md"].year is None
    assert {(x.path.rsplit("/", 1)[1], x.length) for x in files.listing(spark, str(tmp_path), "plain*").collect()} == {("plain.md", 7)}
    got = files.daily_usage(spark, str(tmp_path)).collect()
    assert [(str(x.day), x.model, x.requests, x.cost) for x in got] == [("2025-11-04", "m", 5, 0.5)]


def test_columns(spark):
    row = spark.createDataFrame([("Ann de la Mé-na", 2001, "12", "", "Yi-2009a_x.pdf")], "a string, y int, s string, e string, f string").select(
        keys.cite_key(F.col("a"), F.col("y"), F.lit("b")).alias("k"), keys.page_range(F.col("s"), F.col("e")).alias("p"), keys.page_range(F.col("e"), F.lit(None)).alias("q"), keys.key_in_name(F.col("f")).alias("n")).collect()[0]
    assert (row.k, row.p, row.q) == ("Ména-2001b", "12", None)
    assert row.n == "Yi-2009a"
    judged = spark.createDataFrame([(1, "EXACT", 1.0, "s", 0, 1, None), (2, "NOT_FOUND", 0.12345, None, None, None, "a.pdf")], "card_id long, verdict string, coverage double, span string, start int, end int, pdf string")
    one, two = (json.loads(r.sidecar) for r in export.sidecars(judged, "pdf", F.lit(b"x")).orderBy("card_id").collect())
    assert one["char_offset"] == [0, 1] and one["source_fingerprint"] == {"pdf_name": None, "sha1": None}
    assert two["char_offset"] is None and two["coverage"] == 0.1235 and len(two["source_fingerprint"]["sha1"]) == 40


@pytest.mark.parametrize("most", [50_000, 0])
def test_contained_never_broadcasts_texts(spark, monkeypatch, most):
    """the grams of texts, whose size is guessed too small, are no side of a broadcast."""
    monkeypatch.setattr(linking, "MAX_NEEDLES", most)
    texts = [(i, f"deep blue notes {i % 7} " + "on long cards " * (i % 3)) for i in range(60)] + [(100, "de"), (101, ""), (102, None)]
    needles = ["de", "blue notes 3", "cards on long", "lue", "absent words", "", None, "de"]
    df = spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame(texts, "t long, text string")
    got = linking.contained(*df)
    assert sorted(map(tuple, got.collect())) == sorted((n, t) for n in {x for x in needles if x} for t, x in texts if x and n in x)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("rightHint=(strategy=broadcast)" in plan) == bool(most) and "leftHint" not in plan
    if not most:
        assert "(strategy=merge)" in plan


def test_closeness_and_betweenness_at_once(spark, monkeypatch):
    """hanging trees, twins and other components change neither, however many searches run at once."""
    rng = random.Random(4)
    pairs = [(rng.randrange(60) * 3, rng.randrange(60) * 3) for _ in range(85)] + [(400, 401), (7, 7), *((500 + i, 501 + i) for i in range(7)), *((600 + i, 610 + j) for i in range(3) for j in range(4))]
    for x in range(1000, 1060):
        hubs = [rng.randrange(8) * 3 for _ in range(rng.randrange(1, 3))]
        pairs += [(x, h) for h in hubs] + [(2000 + 2 * x + i, x) for i in range(rng.randrange(3))] + [(2000 + 2 * x, 9000 + x)] * (x % 5 == 0)
    e = spark.createDataFrame(pairs, "a long, b long")
    close = {r.node: r.closeness for r in graph.closeness_from(e).collect()}
    between = {r.node: r.betweenness for r in graph.betweenness(e).collect()}
    for state in (paths.STATE, 700, 1):
        monkeypatch.setattr(paths, "STATE", state)
        got = {r.node: r for r in paths.centralities(e).collect()}
        assert {x: r.closeness for x, r in got.items()} == close
        assert got.keys() == between.keys() and all(abs(r.betweenness - between[x]) < 1e-12 for x, r in got.items())
    assert paths.centralities(e.limit(0)).count() == 0
    with pytest.raises(ValueError):
        paths.centralities(e, 10)


def test_twins_need_the_same_neighbours(monkeypatch):
    """sums of random numbers that agree by chance make no twins."""
    start, col = np.array([0, 2, 4, 6, 8, 10]), np.array([3, 4, 3, 4, 1, 3, 0, 1, 0, 1])
    assert paths.twins(start, col).tolist() == [0, 0, 2, 3, 3]
    monkeypatch.setattr(np.random, "default_rng", lambda seed: type("Same", (), {"integers": staticmethod(lambda low, high, size, dtype: np.ones(size, dtype))}))
    assert paths.twins(start, col)[:3].tolist() == [0, 0, 2]


def test_all_centralities_of_many_twins(spark, monkeypatch):
    """20,000 nodes with the same three neighbours are searched from once."""
    monkeypatch.setattr(graph, "page_rank", lambda e: graph.degrees(e).select("node", F.col("centrality").alias("rank")))  # its many rounds are tested elsewhere
    many = 20_000
    e = spark.range(3, 3 + many).select(F.explode(F.array(*(F.lit(h).cast("long") for h in range(3)))).alias("a"), F.col("id").alias("b"))
    got = {r.node: r for r in network.all_centralities(e).collect()}
    n = many + 3
    assert len(got) == n
    for node, degree, far, through in ((0, many, many + 4, many * (many - 1) / 3), (n - 1, 3, 3 + 2 * (many - 1), 6 / many)):
        assert got[node].degree == degree and got[node].closeness == (n - 1) / far
        assert abs(got[node].betweenness / (through / ((n - 1) * (n - 2))) - 1) < 1e-9
