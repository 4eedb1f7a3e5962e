"""The operators against plain Python versions, on tables with all the odd cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from pyspark.sql import functions as F

from scholia.llm import boosting, bpe, line_dedup, mixing, ngram_join, pii, quality_rules, sharding, suffix_dedup, twice, url_filter, vector_search
from scholia.llm.common import Scratch, components, restrict

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- 1 ---


def test_suffix_array_and_common_prefixes(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LANES", 32)
    rng = random.Random(1)
    for n, depth, letters in [(1, 8, b"ab"), (70, 50, b"ab"), (900, 50, b"abc "), (900, 11, b"a")]:
        raw = bytes(rng.choice(letters) for _ in range(n))
        buf = np.frombuffer(raw, np.uint8)
        sa = suffix_dedup.suffix_array(buf, depth)
        assert sorted(sa.tolist()) == list(range(n))
        starts = [raw[i : i + depth].ljust(depth, b"\0") for i in sa]
        assert starts == sorted(starts)
        lcp = suffix_dedup.common_prefixes(buf, sa, depth)
        for k in range(1, n):
            a, b = raw[sa[k - 1] :], raw[sa[k] :]
            same = next((h for h in range(min(len(a), len(b), depth)) if a[h] != b[h]), min(len(a), len(b), depth))
            assert lcp[k] == same


def test_suffix_ranks_and_runs_against_plain_python(monkeypatch):
    """ranks alone tell equal windows apart, and runs are cut without a row for each byte."""
    rng = random.Random(4)
    for n, depth, letters in [(60, 50, b"a"), (900, 50, b"ab"), (900, 11, b"abc\0")]:
        raw = bytes(rng.choice(letters) for _ in range(n)) * 2
        sa, rank = suffix_dedup.ranked(np.frombuffer(raw, np.uint8), depth)
        lcp = suffix_dedup.common_prefixes(np.frombuffer(raw, np.uint8), sa, depth)
        inside = [k for k in range(1, 2 * n) if max(sa[k - 1], sa[k]) + depth <= 2 * n]
        assert all((rank[sa[k - 1]] == rank[sa[k]]) == (lcp[k] == depth) for k in inside)
    monkeypatch.setattr(suffix_dedup, "RUN", 32)
    monkeypatch.setattr(suffix_dedup, "PIECE", 37)
    texts = [bytes(rng.choice(b"ab c") for _ in range(k)) for k in (0, 49, 50, 51, 7, 300, 50, 0, 1000, 3)]
    want = []
    for i, t in enumerate(texts):
        least = suffix_dedup._least_hashes(np.frombuffer(t, np.uint8), 50).tolist() if len(t) >= 50 else []
        for k, v in enumerate(least):
            if k and v == least[k - 1] and k % 32:
                want[-1][2] += 1
            else:
                want.append([i, k, 1, v])
    doc, start, windows, value, data = suffix_dedup.runs(texts, 50)
    assert [list(r) for r in zip(doc.tolist(), start.tolist(), windows.tolist(), value.tolist())] == want and data == b"".join(texts)
    assert [len(x) for x in suffix_dedup.runs([b"", b"x"], 50)[:4]] == [0] * 4


def test_suffix_blocks_agree_with_one_block(monkeypatch):
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(60)]
    low = np.array([rng.randrange(50) for _ in texts])
    high = low + 10
    whole = sorted(zip(*[c.tolist() for c in suffix_dedup.shard_losses(texts, low, high, 8)]))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    assert sorted(zip(*[c.tolist() for c in suffix_dedup.shard_losses(texts, low, high, 8)])) == whole


@pytest.mark.parametrize("hot", [10_000, 0])
def test_suffix_dedup(spark, docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", hot)
    want = brute.removed_bytes([(i, t) for i, t, _, _ in rows])
    got = by_id(suffix_dedup.dedup(docs, bloom_bytes=1 << 16))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    assert suffix_dedup.dedup(empty, bloom_bytes=1 << 12).count() == 0


def test_suffix_dedup_null_and_equal_ids(spark):
    t = "q" + "abcdefghij" * 9
    df = spark.createDataFrame([(None, t), (4, t), (4, t), (9, "zz" + t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.dedup(df, bloom_bytes=1 << 12).collect())
    assert got == [(0, 0), (4, 0), (4, 0), (9, len(t))]


def test_suffix_dedup_tells_equal_ids_apart(spark):
    rng = random.Random(6)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    df = spark.createDataFrame([(1, a), (7, a[:120] + b), (7, c), (7, a), (9, c)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(df, bloom_bytes=1 << 12).collect())
    assert got == [(1, 300, 0), (7, 300, 0), (7, 300, 300), (7, 420, 120), (9, 300, 300)]


# --- 2 ---


def spark_xxhash(*values):
    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v.to_bytes(8 if isinstance(v, int) and not isinstance(v, np.int32) else 4, "little", signed=True) if not isinstance(v, np.int32) else int(v).to_bytes(4, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def test_sharding(docs, rows, empty):
    got = by_id(sharding.assign(docs, [1.0] * 7, buckets=4))
    texts = {i: t or "" for i, t, _, _ in rows}
    unit = lambda i, s: ((spark_xxhash(i, np.int32(s), "shard") >> 11) + 0.5) / 2**53
    slots: dict = {}
    for i, r in got.items():
        scores = [-np.log(unit(i, s)) for s in range(8)]
        assert r.shard == int(np.argmin(scores[:7])) and r.grown_shard == int(np.argmin(scores))
        assert r.size == len(texts[i].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[i].encode()) and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    again = by_id(sharding.assign(docs, [1.0] * 8))
    assert all(again[i].shard == r.grown_shard for i, r in got.items())
    assert sharding.assign(empty, [1.0, 2.0]).count() == 0


def test_sharding_weights_and_nulls(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = {r.shard: r["count"] for r in sharding.assign(df, [1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert 2 not in n and 0.7 < n[1] / 4000 < 0.8
    odd = spark.createDataFrame([(None, None), (None, "a"), (7, "a"), (7, "a")], "doc_id long, text string")
    r = sharding.assign(odd, [1.0] * 3).collect()
    assert len(r) == 4 and len({x.shard for x in r if x.doc_id is None}) == 1


# --- 3 ---

PERSONAL = [
    "mail a.b+c@d-e.example.com, or x@y", "a@b.c_d@e.f.g", "ip 10.0.0.256 and 255.1.2.3.4.5.6.7 08.0.0.1", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 00",
    "é+1 (988) 555-2485 x +12345 +49 30.1234-5678 9", "4111111111111111", "1" * 3000, "+" * 50 + "1 2", "a" * 3000, "tel: 555-123-4567 call (555) 123-4567", "write jane [at] example [dot] org",
    "1-2-3-4-5-6-7-8-9-0-1-2 3", "@@@ a@ @b.c .@a.b", None, "",
]


def test_pii_base_spans(spark, docs, rows, empty):
    df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    got = by_id(pii.find(df))
    for i, t in enumerate(PERSONAL):
        base = brute.base_spans(t)
        r = got[i]
        assert r.base_sha256 == brute.base_digest(t), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(1 for b in base if b[1] == k) for k in range(4)]
        assert set(f"{k}:{a}:{e}" for a, _, e, k in base) <= set(r.spans.split(","))
    assert pii.find(empty).count() == 0
    assert pii.find(docs).count() == len(rows)


def test_pii_adds_spans_with_enough_proof(spark):
    rows = [(i, f"filler {i} tel: 555-{100 + i % 900}-{1000 + i} end") for i in range(400)] + [(1000 + i, f"mail a{i}@b.example x") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(pii.find(df))
    assert sum("phone" in got[i].spans for i in range(400)) > 350 and got[3].n_phone == 0
    assert by_id(pii.redact(df))[1003].text == "mail [email] x"


def test_pii_proof_of_rare_generators_comes_from_all_candidates(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE", 200)
    rows = [(i, f"write a{i}@b.example x") for i in range(3000)] + [(3000 + i, f"filler {i} tel: 555-{100 + i}-{1000 + i} end") for i in range(120)]
    got = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all("phone" in got[3000 + i].spans for i in range(120))


def test_pii_redacts_each_row_by_its_own_spans(spark):
    rows = [(1, "nothing here, contact me at jane.roe@corp.example please"), (1, "a@b.example is first"), (None, "ip 10.0.0.1 and c@d.example.org"), (2, None)]
    got = sorted((r.doc_id or 0, r.text) for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "ip [ip] and [email]"), (1, "[email] is first"), (1, "nothing here, contact me at [email] please"), (2, "")]


def test_pii_adds_what_looks_like_announced_data(spark):
    """Keys behind a cue teach the format; the same format is found without one, prose and plain long words are not."""
    hexes = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'some words token = "{hexes(i)}" end') for i in range(300)] + [(1000 + i, f'some words and "{hexes(1000 + i)}" end') for i in range(6)]
    rows += [(2000 + i, f"donaudampfschifffahrtsgesellschaft word{i} of-many-hyphens-and-parts") for i in range(200)]
    got = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string")))
    text = dict(rows)
    for i in [*range(300), *range(1000, 1006)]:
        at = text[i].index('"') + 1
        assert f"secret:{at}:{at + 40}" in got[i].spans.split(",") and got[i].n_added == 1  # digits inside may pass as a card
    assert not any(got[2000 + i].spans for i in range(200))


def test_pii_adds_spans_on_the_test_tables(spark):
    found = pii.find(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).agg(F.sum("n_added").alias("n"), F.sum((F.col("spans").contains("secret")).cast("int")).alias("s")).collect()[0]
    assert found.n > 100 and found.s > 100


def test_pii_tries_every_score(spark, monkeypatch):
    """The first good cutoff comes after 64 others."""
    stumps = [boosting.Node(0.0, pii.FEATURES.index("n"), 10.5 + i, boosting.Node(0.0), boosting.Node(1.0)) for i in range(120)]
    monkeypatch.setattr(boosting, "boost", lambda x, y: (0.0, stumps))
    rows = [(200 * i + j, f"{'mail: ' if i >= 100 else 'text '}{'a' * i} [at] b.org x") for i in range(1, 110) for j in range(40 if i >= 100 else 5)]
    got = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(("email" in got[i].spans) for i, _ in rows if i >= 20_000) and not any(got[i].spans for i, _ in rows if i < 80 * 200)


def test_pii_proof_is_the_exact_bound():
    assert pii.proven(29, 29) and not pii.proven(28, 28) and not pii.proven(44, 45) and pii.proven(45, 46)
    assert not pii.proven(0, 0) and pii.proven(9_010_000, 10_000_000) and not pii.proven(9_000_500, 10_000_000)


# --- 4 ---


def test_quality_measures(docs, rows, empty, spark):
    labels = spark.createDataFrame([(i, 1 if k % 3 else 0, 0) for k, (i, *_) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.judge(docs, labels))
    for i, t, _, _ in rows:
        r, w = got[i], brute.quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == w, i
        assert r.base_failed == (w[0] < 50 or 100 * w[4] > 50 * w[0]) and (not r.kept or not r.base_failed)
    assert quality_rules.judge(empty, labels).count() == 0
    assert quality_rules.judge(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_quality_cutoffs_keep_their_promise(spark):
    good, bad = np.zeros(1001, int), np.zeros(1001, int)
    good[:50], good[400], bad[500:900] = 40, 3, 2
    cut = quality_rules.choose(good, bad, 0.01, 0.001, 20.0)
    assert 401 <= cut <= 500 and quality_rules.choose(good[:0].sum() + np.zeros(1001, int), bad, 0.01, 0.001, 20.0) is None
    assert abs(quality_rules.upper_bound(0, 100, 0.05) - (1 - 0.05 ** 0.01)) < 1e-9
    assert quality_rules.upper_bound(5, 5, 0.1) == 1.0
    rng = random.Random(3)
    text = lambda junk: " ".join(f"w{rng.randrange(5000)}" + ("#$%" if junk else "") for _ in range(80))
    rows = [(i, text(i % 4 == 0), "en" if i % 2 else None) for i in range(4000)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels))
    assert all(got[i].kept == (i % 4 != 0) for i in range(4000))


def test_quality_risk_on_fresh_documents(spark):
    """Cutoffs from labelled documents lose at most alpha of the good ones among others of the same kind."""
    rng = random.Random(11)

    def text(good):
        junk = rng.random() < (0.06 if good else 0.7)
        return " ".join(f"w{rng.randrange(5000)}" + ("#$" if junk and rng.random() < 0.5 else "") for _ in range(70))

    made = [(i, rng.random() < 0.8, ["en", "fr", None][i % 3]) for i in range(9000)]
    rows = [(i, text(good), lang) for i, good, lang in made]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(good), 0) for i, good, _ in made if i < 6000], "doc_id long, quality int, toxic int")
    for alpha in (0.04, 0.12):
        kept = {r.doc_id: r.kept for r in quality_rules.judge(df, labels, alpha=alpha, price=1.0).collect()}
        report = {r.stratum: r for r in quality_rules.certificates(df, labels, alpha=alpha, price=1.0).collect()}
        assert all(r.bound <= alpha and r.n_good > 600 for r in report.values()) or alpha < 0.06
        for lang in ("en", "fr", None):
            fresh = [i for i, good, own in made if i >= 6000 and good and own == lang]
            lost = sum(not kept[i] for i in fresh) / len(fresh)
            assert lost <= alpha + 0.02
        junk = [i for i, good, _ in made if i >= 6000 and not good]
        assert (sum(not kept[i] for i in junk) / len(junk) > 0.6) == (alpha > 0.06)
    stays = {r.doc_id for r in quality_rules.keep_good(df, labels, alpha=0.12, price=1.0).collect()}
    assert stays == {i for i, k in kept.items() if k}


# --- 5 ---


def test_line_dedup(spark, docs, rows, empty):
    want = brute.lines_kept([(i, t) for i, t, _, _ in rows])
    got = by_id(line_dedup.dedup_report(docs))
    for (i, *_), (n, dropped, text) in zip(rows, want):
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (n, dropped, hashlib.sha256(text.encode()).hexdigest())
    assert sum(d for _, d, _ in want) > 10
    kept = by_id(line_dedup.dedup_documents(docs))
    assert all(kept[i].text == text for (i, *_), (_, _, text) in zip(rows, want)) and line_dedup.dedup_documents(docs).columns == docs.columns
    assert line_dedup.dedup_report(empty).count() == 0


def test_line_dedup_without_broadcast(docs, monkeypatch):
    want = by_id(line_dedup.dedup_report(docs))
    monkeypatch.setattr(line_dedup, "MAX_FILTER_BYTES", 0)
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST_DROPS", 0)
    assert by_id(line_dedup.dedup_report(docs)) == want


def test_lines_probe_the_filter_of_their_shard(spark, docs, monkeypatch):
    """Filters that are not broadcast let all frequent lines pass, hardly any other, and each posting once; null ids stay null."""
    scratch = Scratch(spark, "t")
    posts = scratch.cut(line_dedup.postings(docs).withColumn("doc", F.when(F.col("doc") % 7 != 0, F.col("doc") + (1 << 60))), "p")
    frequent = scratch.cut(line_dedup.frequent_keys(Scratch(spark, "t"), posts, 5), "f")
    got = line_dedup.probe_by_shard(posts, scratch.cut(line_dedup.filters(frequent, 3), "t"), 3, rows=7)
    assert got.schema == posts.schema
    must = [tuple(r) for r in posts.join(frequent.select("k1", "k2"), ["k1", "k2"], "left_semi").collect()]
    rows = [tuple(r) for r in got.collect()]
    assert must and set(must) <= set(rows)
    assert len(must) <= len(rows) <= len(must) + 3 and any(r[2] is None for r in rows)
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 2)
    lost = [sorted(map(str, line_dedup.drops(Scratch(spark, "t"), posts, 5, most).collect())) for most in (None, 0)]
    assert lost[0] == lost[1] and lost[0]


def test_cuckoo_filter_is_reversible():
    rng = np.random.default_rng(1)
    k = rng.integers(-(2**63), 2**63, size=(3000, 2))
    f = line_dedup.Cuckoo.of(k[:2000, 0], k[:2000, 1])
    assert f.holds(k[:2000, 0], k[:2000, 1]).all() and f.holds(k[2000:, 0], k[2000:, 1]).sum() < 10
    g = line_dedup.Cuckoo.from_bytes(f.to_bytes())
    g.delete(k[:1000, 0], k[:1000, 1])
    assert g.holds(k[1000:2000, 0], k[1000:2000, 1]).all() and g.holds(k[:1000, 0], k[:1000, 1]).sum() < 10
    small = line_dedup.Cuckoo(2)
    with pytest.raises(line_dedup.Full):
        small.insert(k[:50, 0], k[:50, 1])


def test_line_index_insert_then_delete(spark, docs, rows):
    scratch = Scratch(spark, "t")
    half = F.col("doc_id") % 2 == 0
    a = scratch.cut(line_dedup.postings(docs.where(half)), "a")
    both = scratch.cut(line_dedup.insert(a, docs.where(~half)), "both")
    back = line_dedup.delete(both, docs.where(~half).select("doc_id"))
    assert sorted(back.collect()) == sorted(a.collect())
    f1, f2 = (line_dedup.frequent_keys(Scratch(spark, "t"), x, 5) for x in (a, both))
    old = scratch.cut(line_dedup.filters(f1, 3), "f1")
    new = {r.shard: line_dedup.Cuckoo.from_bytes(r["filter"]) for r in line_dedup.update_filters(old, 3, f1, f2).collect()}
    for r in f2.collect():
        assert new[(r.k2 >> 20) % 3].holds(np.array([r.k1]), np.array([r.k2]))[0]


def test_line_counts_follow_inserts_and_deletes(spark, docs, rows):
    """Counts kept by changes alone equal those counted anew, and come back after a delete of what was inserted."""
    scratch, third = Scratch(spark, "t"), F.col("doc_id") % 3 == 0
    line = rows[0][1].split("\n")[0] + " a line of more than forty characters, in any case"
    odd = spark.createDataFrame([(None, line), (None, line), (2000, line), (1, line + "\nnew " + line)], "doc_id long, text string")
    posts = scratch.cut(line_dedup.postings(docs.where(~third)), "p0")
    counts = first = scratch.cut(line_dedup.reference_counts(posts), "c0")
    batches = [docs.where(third).select("doc_id", "text"), odd]
    for i, batch in enumerate(batches):
        added = line_dedup.postings(batch)
        posts = scratch.cut(line_dedup.insert(posts, batch), f"pi{i}")
        counts = scratch.cut(line_dedup.updated_counts(counts, posts, added=added), f"ci{i}")
        assert sorted(map(str, counts.collect())) == sorted(map(str, line_dedup.reference_counts(posts).collect()))
    largest = counts.where("max_doc IS NOT NULL").select("max_doc").distinct().limit(9)
    more = scratch.cut(line_dedup.updated_counts(counts, line_dedup.delete(posts, largest), removed=line_dedup.held_by(posts, largest)), "large")
    assert sorted(map(str, more.collect())) == sorted(map(str, line_dedup.reference_counts(line_dedup.delete(posts, largest)).collect()))
    for i, ids in enumerate((spark.createDataFrame([(None,), (2000,)], "x long"), batches[0].select("doc_id"))):
        removed, posts = line_dedup.held_by(posts, ids), scratch.cut(line_dedup.delete(posts, ids), f"pd{i}")
        counts = scratch.cut(line_dedup.updated_counts(counts, posts, removed=removed), f"cd{i}")
        assert sorted(map(str, counts.collect())) == sorted(map(str, line_dedup.reference_counts(posts).collect()))
    own = spark.createDataFrame([(1,)], "x long")
    assert line_dedup.held_by(posts, own).count() > 0 and counts.count() >= first.count()


# --- 6 ---

URLS = [
    "http://A.Example.net/en/x?q#f", "https://example.net/en", "https://x.net", "https://x.net/", "http://example.com/de/1", "http://sub.example.com/DE/", "http://w.org/fr/a", "ftp://org/fr/", "nothing", None, "",
    "http://notexample.net.evil.com/", "http://b.net:80/", "://net/y", "http://" + "a." * 2000 + "net/" + "p/" * 2000,
]


def test_url_filter(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("rule", F.lit(1))
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("allow", "com", ""), ("block", "w.org", "/fr/a")]
    for limit in (100, 2):
        got = by_id(url_filter.judge(df, rules, max_rules=limit), "page_id")
        for i, url in enumerate(URLS):
            host, path = url_filter.split_url(url)
            fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fit, default=None)
            r = got[i]
            assert (r.host, r.path) == (host, path)
            assert (r.rule, r.verdict) == ((best[3], best[4]) if best else (None, "allow")), url
    assert url_filter.judge(df.limit(0), []).count() == 0


# --- 7 ---


@pytest.mark.parametrize("tile", [1024, 2])
def test_near_duplicates(docs, rows, empty, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    if tile == 2:
        monkeypatch.setattr(ngram_join, "STARS", 1)
    want = brute.near_components([(i, t) for i, t, _, _ in rows])
    got = by_id(ngram_join.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert sum(1 for i, (_, c) in want.items() if c != i) > 10
    if tile == 1024:
        kept = ngram_join.keep_one(docs)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i) and kept.columns == docs.columns
        assert ngram_join.near_duplicates(empty).count() == 0


def test_near_duplicates_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, t), (8, t), (8, t), (3, t + " more"), (9, "other words that are here")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in ngram_join.near_duplicates(df).collect())
    assert got == [(0, None), (3, 3), (8, 3), (8, 3), (9, 9)]
    assert sorted(r.doc_id or 0 for r in ngram_join.keep_one(spark.createDataFrame([(8, t), (8, t + " x"), (9, "a b")], "doc_id long, text string")).collect()) == [8, 9]


def test_bitmap_bound_never_hides_a_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = rng.integers(0, 2**63, size=1500).astype(np.uint64)
        n = int(rng.integers(5, 1000))
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[int(n * 0.12) : n], pool[n : int(n * 1.1)]]))
        maps = [ngram_join.bitmap(a), ngram_join.bitmap(b)]
        k = len(np.intersect1d(a, b))
        pairs = ngram_join.tile_pairs(np.array([1, 2]), np.array([1, 2]), np.array([len(a), len(b)]), maps, np.array([True, False]), 75)[0]
        if 100 * k >= 75 * (len(a) + len(b) - k):
            assert len(pairs) == 1


def test_near_duplicates_tell_equal_ids_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "vw")
    for other in (5, 6):
        df = spark.createDataFrame([(3, a), (5, a), (other, b), (9, b[:-4])], "doc_id long, text string")
        assert sorted((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(df).collect()) == sorted([(3, 3), (5, 3), (other, other), (9, other)])
        assert sorted((r.doc_id, r.text) for r in ngram_join.keep_one(df).collect()) == [(3, a), (other, b)]
    df = spark.createDataFrame([(8, a), (8, b), (8, b), (9, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in ngram_join.keep_one(df).collect()) == [(8, a), (8, b)]


def test_shingles_do_not_depend_on_the_batch(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Ana", "bé", "c" * 40, "x" * 300, "d\te", "漢字"]) for _ in range(rng.randrange(30))).encode() for _ in range(50)] + [None, b"", b" \n", b"y" * 3000]
    for segment in (1 << 20, 64):
        monkeypatch.setattr(ngram_join, "SEGMENT", segment)
        whole = ngram_join.Shingler(5, 1)
        for t, s in zip(texts, whole.sets(texts)):
            assert s.tolist() == whole.sets([t])[0].tolist()
            assert len(s) == len(brute.shingles((t or b"").decode()))


def test_filter_of_shared_values(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(1 << 63, size=6000, dtype=np.uint64) * np.uint64(2)
    rows = [v[i * 50 : i * 50 + 60] for i in range(100)] + [v[:1]] * 40  # ten shared with the next row, one held often
    chunks = [twice.Chunk(64, 700), twice.Chunk(64, 10**6)]
    blobs = [b for i, r in enumerate(rows) if (b := chunks[i % 2].add(r)) is not None] + [c.flush() for c in chunks]
    table = spark.createDataFrame([tuple(x) for b in blobs for x in zip(*(c.to_pylist() for c in b.columns))], twice.SCHEMA)
    f = twice.build(table, 64, 1 << 16, 64)
    met = np.bincount(np.concatenate([np.searchsorted(np.sort(v), r) for r in rows]), minlength=len(v))[np.searchsorted(np.sort(v), v)]
    assert f.may_share(v[met > 1]).all() and f.may_share(v[met == 1]).mean() < 0.05
    assert f.level(v[:1])[0] > 1 and (f.level(v[1:]) <= 1).all()


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)]
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.node: r.root for r in components(Scratch(spark, "t"), spark.createDataFrame(pairs, "a long, b long"), "x").collect()}
    assert all(find(i) == r for i, r in got.items()) and len(got) == len({x for a, b in pairs if a != b for x in (a, b)})


def test_restrict_without_broadcast(spark):
    ids = spark.range(5).select("id")
    for most in (100, 2):
        assert restrict(spark.range(10), "id", ids, "left_anti", most).count() == 5


# --- 8 ---


def test_mixing(docs, rows, empty):
    size = {i: len(brute.words(t)) for i, t, _, _ in rows}
    sources: dict = {}
    for i, _, _, s in rows:
        sources.setdefault(s, []).append(i)
    names = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    words = [sum(size[i] for i in sources[s]) for s in names]
    target = mixing.targets(words, [(5, 2, 1)[k % 3] for k in range(len(names))])
    assert abs(sum(target) - sum(words)) < 1e-6 and all(t <= 3 * w + 1e-9 for t, w in zip(target, words))
    got = by_id(mixing.plan(docs))
    for s, w, t in zip(names, words, target):
        own = [got[i] for i in sources[s]]
        assert all(r.source_size == w and abs(r.target - t) < 1e-6 and 0 <= r.taken <= 3 * r.size and r.size == size[r.doc_id] for r in own)
        assert abs(sum(r.taken for r in own) - t) <= 1
    assert by_id(mixing.plan(docs.repartition(3))) == got
    out = mixing.mix(docs)
    assert out.columns == docs.columns and sum(len(brute.words(r.text)) for r in out.collect()) == sum(r.taken for r in got.values())
    assert mixing.plan(empty).count() == 0


def python_mix(rows, shards, seed=7, blocks=256, copies=3):
    """id to the words taken and the shards, by a plain version of the tree on lists."""
    key = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    k = {i: key(spark_xxhash(t)) for i, t, _, _ in rows}
    block = {i: key(spark_xxhash(i, k[i], "block")) % blocks for i, *_ in rows}
    size = {i: len(brute.words(t)) for i, t, _, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    held = {s: {} for s in names}
    for i, _, _, s in rows:
        held[s].setdefault(block[i], []).append(i)
    words = [sum(size[i] for own in held[s].values() for i in own) for s in names]
    want = mixing.targets(words, [(5, 2, 1)[j % 3] for j in range(len(names))], copies)
    turns = {s: sorted(held[s], key=lambda b: (key(spark_xxhash(s, np.int32(b), np.int32(seed))), b)) for s in names}
    lists, last = {}, {}
    for s, t, w in zip(names, want, words):
        whole = min(copies, int(t // w)) if w else 0
        lists[s], rest = [b for _ in range(whole) for b in turns[s]], max(0, round(t) - whole * w)
        for b in turns[s]:
            if rest > 0:
                n = sum(size[i] for i in held[s][b])
                lists[s].append(b)
                last[s] = (b, rest) if rest < n else None
                rest -= n

    def split(quotas, n, rng):
        if n == 1:
            return [quotas]
        first = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * (n // 2) // n, method="marginals")
        return split(first, n // 2, rng) + split(quotas - first, n - n // 2, rng)

    out = {i: [0, []] for i, *_ in rows}
    leaves = split(np.array([len(lists[s]) for s in names]), shards, np.random.default_rng(seed))
    for j, s in enumerate(names):
        at = 0
        for shard, quota in enumerate(leaves):
            for place in range(at, at + int(quota[j])):
                b = lists[s][place]
                cut = last[s][1] if last.get(s) and place == len(lists[s]) - 1 else None
                for i in sorted(held[s][b], key=lambda i: (key(spark_xxhash(i, k[i], np.int32(seed))), i)):
                    n = size[i] if cut is None else min(cut, size[i])
                    cut = None if cut is None else cut - n
                    if n:
                        out[i][0] += n
                        out[i][1].append(shard)
            at += int(quota[j])
    return out


@pytest.mark.parametrize("shards", [16, 3])
def test_mixing_is_what_the_tree_draws(docs, rows, shards):
    got = by_id(mixing.plan(docs, shards=shards))
    want = python_mix(rows, shards)
    assert {i: [r.taken, r.shard_list] for i, r in got.items()} == want
    assert all(len(r.places) == len(r.shard_list) for r in got.values())


def test_mixing_deals_copies_and_tells_equal_ids_apart(spark):
    rows = [(i // 2, f"w{i} " * (3 + i % 5), "ab"[i % 2]) for i in range(300)] + [(7, "x y z", "a")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_scholia_id", F.lit(1)).withColumn("shard", F.lit(2))
    got, out = mixing.plan(df, shards=4), mixing.mix(df, shards=4)
    taken = sorted((r.doc_id, r.taken) for r in got.collect() if r.taken)
    by: dict = {}
    for i, t, s in out.select("doc_id", "text", "source").collect():
        by[i, s, (t or "").split(" ")[0]] = by.get((i, s, (t or "").split(" ")[0]), 0) + len(brute.words(t))
    assert sum(n for _, n in taken) == sum(by.values()) and out.columns == df.columns
    for (i, s, _), n in by.items():
        assert n in [x for j, x in taken if j == i] or i == 7
    place = {}
    for r in got.collect():
        for s, p in zip(r.shard_list, r.places):
            place.setdefault((r.doc_id, r.size), set()).add(s)
    for part in out.select("doc_id", "text").rdd.glom().collect():
        assert len(part) == 0 or len(set.union(*[place[r.doc_id, n] for r in part for n in {x for j, x in place if j == r.doc_id}])) <= 4


def test_mixing_targets_and_tree():
    assert mixing.targets([10, 1000], [5, 1]) == [30.0, 980.0]
    assert mixing.targets([0, 5], [5, 1]) == [0.0, 5.0]
    quotas = np.array([7, 0, 100, 33])
    dealt = mixing.deal(quotas, 6, np.random.default_rng(1))
    assert (dealt.sum(0) == quotas).all() and dealt.sum(1).max() - dealt.sum(1).min() <= 3
    assert (dealt == mixing.deal(quotas, 6, np.random.default_rng(1))).all()


# --- 9 ---


def test_vector_search(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 16)).astype(np.float32) + 3 * rng.normal(size=(20, 16)).astype(np.float32)[rng.integers(20, size=6000)]
    x[100:160] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [float("inf")] + [1.0] * 15), (9005, [1.0] * 3), (None, [1.0] * 16), (9006, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    got: dict = {}
    for r in vector_search.search(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append(r)
    hit = 0
    d64 = x.astype(np.float64)
    for q in range(0, 6000, 100):
        own = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        d = np.sqrt(((d64 - d64[q]) ** 2).sum(1))
        assert all(abs(d[r.vec_id] - r.score) < 1e-9 for r in own) and [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        d[q] = np.inf
        hit += len({r.vec_id for r in own} & set(np.lexsort((np.arange(6000), d))[:10].tolist()))
    assert hit >= 0.9 * 600
    assert [r.vec_id for r in sorted(got[100], key=lambda r: r["rank"])] == [7, *range(101, 110)]


def test_vector_search_few_rows(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    r = vector_search.search(df, F.col("id") % 100 == 0).collect()
    assert [(x.query_id, x["rank"], x.vec_id) for x in r] == [(100, 1, 1)] and abs(r[0].score - 2**0.5) < 1e-12
    assert vector_search.search(df.limit(0), F.col("id") % 100 == 0).count() == 0


@pytest.mark.parametrize("reach", [0.5, 0.0])
def test_vector_search_reads_more_lists_as_they_grow(spark, monkeypatch, reach):
    """Vectors without structure on 400 lists."""
    monkeypatch.setattr(vector_search, "LIST_ROWS", 10)
    x = np.random.default_rng(6).normal(size=(4000, 32))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in vector_search.search(df, F.col("id") % 40 == 0, reach=reach).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    d = ((x[::40, None].astype(np.float64) - x[None]) ** 2).sum(2)
    d[np.arange(100), np.arange(0, 4000, 40)] = np.inf
    assert sum(len(got[40 * i] & set(own[:10].tolist())) for i, own in enumerate(np.argsort(d, 1))) >= 0.98 * 1000


# --- 10 ---


@pytest.fixture(scope="module")
def reference():
    v = bpe.vocabulary(RANKS, public_tokenizers.PATTERN)
    return v, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_bpe_documents(spark, docs, rows, reference, empty):
    _, enc = reference
    extra = [(900, "it's 12,5 €  \n\n x\x1c\x85　y 漢字 𝔘 <|endoftext|>"), (901, "́a​" * 50), (902, " " * 5000)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = by_id(bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN))
    for i, t in [(r[0], r[1]) for r in rows] + extra:
        ids = enc.encode_ordinary(t or "")
        r = got[i]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = by_id(bpe.decode_tokens(bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN))
    assert all(back[i].text == (t or "") for i, t in extra)
    assert bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_random_texts(reference):
    v, enc = reference
    rng = random.Random(8)
    letters = [chr(c) for c in range(1, 0x260)] + [" "] * 200 + ["漢", "😀", " ", "'s", "'ll"] * 5
    for _ in range(400):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert v.encode(t) == enc.encode_ordinary(t)
        known = v.learn([v.pieces(t)])
        assert [int(x) for p in v.pieces(t) for x in known[p].split()] == enc.encode_ordinary(t)


def test_bpe_prefix_table(reference):
    v, _ = reference
    rng = random.Random(4)
    for _ in range(60):
        data = bytes(rng.choice(b"thean ing.") for _ in range(rng.randrange(1, 60)))
        table = bpe.PieceTable(v, data[:7])
        table.append(data[7:])
        assert table.ids() == v.merged(data) and table.ids(5) == v.merged(data[:5])
        at = rng.randrange(len(data) + 1)
        table.replace(at, min(len(data), at + 3), b"ation")
        assert table.data == data[:at] + b"ation" + data[at + 3 :] and table.ids() == v.merged(table.data)
