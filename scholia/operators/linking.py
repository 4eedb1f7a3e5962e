"""Links between cards, papers, files and bibliography entries, and what an import makes of them.

Substring conditions ("the title contains this") are answered by equi-joins on short grams: of each
needle the gram that fewest texts hold is looked up, and the candidates are verified. Texts are never
broadcast (grams of needles are, up to a checked size) and no pair is formed that does not share that gram.
"""

from __future__ import annotations

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scholia.operators.cooccurrence import best_by_overlap, last_name
from scholia.operators.graph import cut
from scholia.operators.parse import card_links, strip
from scholia.operators.resolve import best_titles, normal_cite_key
from scholia.operators.store import clean_doi, latest

#: Characters of the grams that substrings are looked up by; shorter needles use their own length.
GRAM = 8
#: Needles up to which their grams are sent to every executor, so that texts are not moved.
MAX_NEEDLES = 50_000


@F.pandas_udf(StringType())
def unicode_key(keys: pd.Series) -> pd.Series:
    """A citation key without accents and signs, in lower case."""
    return keys.map(lambda k: None if k is None else normal_cite_key(k).lower())


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """``needle, t``: all pairs of distinct ``needles(needle)`` and ``texts(t, text)`` whose text contains the needle.

    Case is told apart, so callers lower both sides. Null and empty needles are in no text.
    """
    n = cut(needles.select("needle").where("needle <> ''").distinct())
    sizes = [r.k for r in n.select(F.least(F.length("needle"), F.lit(GRAM)).alias("k")).distinct().collect()]  # at most GRAM
    if not sizes:
        return n.select("needle").crossJoin(texts.select("t").limit(0))
    cuts = lambda c, k: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substr(c, i, F.lit(k)))
    texts = cut(texts.select("t", "text"))
    each = [texts.where(F.length("text") >= k).select("t", "text", F.explode(F.array_distinct(cuts(F.col("text"), k))).alias("gram")) for k in sizes]
    grams = each[0]
    for more in each[1:]:
        grams = grams.unionByName(more)
    k = F.least(F.length("needle"), F.lit(GRAM))
    own = n.select("needle", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("needle") - k + 1), lambda i: F.substr(F.col("needle"), i, k)))).alias("gram"))
    # Sizes of exploded grams are guessed far too small, so it is said which side may be broadcast: never the texts'.
    few = n.count() <= MAX_NEEDLES and (own.agg(F.sum(F.octet_length("gram") + 64)).collect()[0][0] or 0) <= 32 << 20
    small = F.broadcast if few else lambda df: df.hint("merge")
    held = grams.select("gram").join(small(own.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no text holds rules its needle out: it counts as 0 and meets nothing.
    rare = cut(own.join(held, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")))
    return grams.join(small(rare), "gram").where(F.contains("text", "needle")).select("needle", "t")


# --- lookups -----------------------------------------------------------------------------------


def entries_by_doi(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """FLT7: for each ``wanted(doi)`` the entry ``cite_key, doi`` of the same DOI but for case and resolver address (smallest key)."""
    plain = lambda c: F.lower(clean_doi(F.col(c)))
    e = entries.where("doi <> ''").groupBy(plain("doi").alias("_d")).agg(F.min("cite_key").alias("cite_key"))
    w = wanted.where("doi <> ''").select("doi").distinct()
    return w.join(e, plain("doi") == F.col("_d")).select("doi", "cite_key")


def entries_by_key(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """FLT8, and the third tier of FLT3: for each ``wanted(key)`` the ``entries(id, cite_key)`` of the best tier: same,
    same but for case, same without accents and signs. Ties go to the smallest id."""
    e = entries.where("cite_key <> ''").select("id", "cite_key", unicode_key("cite_key").alias("_u"))
    w = wanted.where("key <> ''").select("key", unicode_key("key").alias("_u")).distinct()
    tier = F.when(F.col("key") == F.col("cite_key"), 1).when(F.lower("key") == F.lower("cite_key"), 2).otherwise(3)
    return latest(w.join(e, "_u").withColumn("tier", tier), ["key"], [F.col("tier"), F.col("id")]).select("key", "id", "cite_key", "tier")


def last_by_key(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """JON8: one row for each ``_k``: of repeated keys the last by ``order`` stays, as in a dictionary filled in order."""
    return latest(rows.withColumn("_k", key).where("_k <> ''"), ["_k"], [F.desc(order)])


def cards_of_paper(cards: DataFrame, papers: DataFrame) -> DataFrame:
    """FLT5: cards of the given ``papers(id)``, in the order of paper and card."""
    return cards.join(papers.select("id"), F.col("paper_id") == F.col("id"), "left_semi").orderBy("paper_id", "card_id")


def links_of_card(links: DataFrame, source: str) -> DataFrame:
    """FLT5: links of one card, by relation and target."""
    return links.where(F.col("card_id") == source).orderBy("relation", "target")


def link_coverage(cards: DataFrame, by: str) -> DataFrame:
    """JON14: for each group the cards with and without a paper."""
    return cards.groupBy(by).agg(F.count("*").alias("cards"), F.count("paper_id").alias("linked"), F.count_if(F.col("paper_id").isNull()).alias("unlinked"))


# --- matching ----------------------------------------------------------------------------------


def back_fill_by_title(papers: DataFrame, entries: DataFrame, characters: int = 50) -> tuple[DataFrame, DataFrame]:
    """SNK15: the changed papers, and ``cite_key, status, paper_id`` of each of ``entries(cite_key, title, year)``.

    An entry meets the papers whose title contains its first characters (case aside, no wildcards) and whose year
    is the same or null. One such paper without a key takes the entry's (``updated``; of several entries the
    largest key), one with a key stays (``has_key``); none is ``not_found``, several are ``ambiguous``. An entry
    without a title is not found. A dry run uses the second table only.
    """
    e = cut(entries.select("cite_key", F.col("year").alias("_y"), F.lower(F.substring("title", 1, characters)).alias("needle")))
    p = papers.select(F.col("id").alias("t"), F.lower("title").alias("text"), F.col("year").alias("_py"), F.col("cite_key").alias("_own"))
    hits = contained(e, p).join(e, "needle").join(p.drop("text"), "t").where("_py IS NULL OR _py = _y")
    found = hits.groupBy("cite_key").agg(F.countDistinct("t").alias("n"), F.min("t").alias("paper_id"), F.min("_own").alias("_own"))
    has = F.coalesce(F.col("_own"), F.lit("")) != ""
    status = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").when(has, "has_key").otherwise("updated")
    told = cut(e.select("cite_key").distinct().join(found, "cite_key", "left").select("cite_key", status.alias("status"), F.when(F.col("n") == 1, F.col("paper_id")).alias("paper_id")))
    new = told.where("status = 'updated'").groupBy(F.col("paper_id").alias("_id")).agg(F.max("cite_key").alias("_new"))
    out = papers.join(new, F.col("id") == F.col("_id"), "left")
    return out.select(*[F.coalesce("_new", "cite_key").alias(c) if c == "cite_key" else F.col(c) for c in papers.columns]), told


def _best_with_year(left: DataFrame, right: DataFrame, threshold: float, bonus: float = 0.1) -> DataFrame:
    """``l, r, score``: for ``left(l, title, year)`` the ``right(r, title, year)`` of the largest title ratio, plus the
    bonus where the years are equal; ties to the smaller r."""
    whole = best_titles(left.select("l", "title"), right.select("r", "title"), threshold)
    same = best_titles(left.where("year IS NOT NULL"), right.where("year IS NOT NULL"), max(threshold - bonus, 0.01), by="year")
    both = whole.select("l", "r", F.col("ratio").alias("score")).unionByName(same.select("l", "r", (F.col("ratio") + bonus).alias("score")))
    return latest(both.where(F.col("score") >= threshold - 1e-12), ["l"], [F.desc("score"), F.col("r")])


def quoted_title(info: Column) -> Column:
    """The title in quotes at the start of the source line of a card, or an empty text."""
    return F.regexp_extract(F.coalesce(info, F.lit("")), r'^"([^"]+)"', 1)


def link_by_title(cards: DataFrame, papers: DataFrame, threshold: float = 0.7) -> DataFrame:
    """ENT7: ``card_id, paper_id, status, score`` of unlinked ``cards(card_id, source_info)``.

    The quoted title is compared with all titles of ``papers(id, title, year)``; a year in brackets behind it that
    is the paper's adds 0.1. ``linked`` from the threshold on, else ``unmatched``; without a quoted title ``skipped``.
    """
    year = F.regexp_extract("source_info", r'^"[^"]+"\s*\((\d{4})\)', 1)
    left = cut(cards.select(F.col("card_id").alias("l"), quoted_title(F.col("source_info")).alias("title"), F.nullif(year, F.lit("")).cast("long").alias("year")))
    right = papers.where("title <> ''").select(F.col("id").alias("r"), "title", F.col("year").cast("long").alias("year"))
    found = _best_with_year(left.where("title <> ''"), right, threshold)
    status = F.when(F.col("title") == "", "skipped").when(F.col("r").isNull(), "unmatched").otherwise("linked")
    return left.join(found, "l", "left").select(F.col("l").alias("card_id"), F.col("r").alias("paper_id"), status.alias("status"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _key_candidates(cards: DataFrame) -> DataFrame:
    """``card_id, pos, k``: citation keys that the source line and the card's id suggest, in order."""
    start = r'^"([A-Za-z]+)[-_]?(\d{4})([a-z]?)'
    part = lambda i: F.lower(F.regexp_extract(F.coalesce("source_info", F.lit("")), start, i))
    tails = F.array_distinct(F.array(F.lit(""), part(3)))
    quoted = F.flatten(F.transform(F.array(F.lit("-"), F.lit(""), F.lit("_")), lambda sep: F.transform(tails, lambda t: F.concat(part(1), sep, part(2), t))))
    own = F.lower(F.regexp_extract(F.coalesce("zettel_id", F.lit("")), r"zettel_([A-Za-z]+[-_]?\d{4}[a-z]?)", 1))
    every = F.concat(F.when(part(1) != "", quoted).otherwise(F.array().cast("array<string>")), F.array(own, F.regexp_replace(own, "[-_]", "")))
    return cards.select("card_id", F.posexplode(F.array_distinct(every)).alias("pos", "k")).where("k <> ''")


def _by_words(cards: DataFrame, papers: DataFrame) -> DataFrame:
    """``card_id, paper_id, score``: .3 for the author in title or key, .1 a keyword in the title (.4 at most), .3 for
    the year; the best from .2 on, ties to the smaller id.

    Only papers with a word in common, and the first paper of the year, can be best.
    """
    form = r'^"([A-Za-z]+)[-_]?(\d{4})_?([^"]+)"'
    part = lambda i: F.regexp_extract(F.coalesce("source_info", F.lit("")), form, i)
    words = F.filter(F.transform(F.regexp_extract_all(part(3), F.lit(r"[A-Z][a-z]+|[a-z]+"), F.lit(0)), lambda w: F.lower(w)), lambda w: F.length(w) > 2)
    own = cut(cards.select("card_id", F.lower(part(1)).alias("author"), part(2).alias("y"), F.array_sort(words).alias("words")).where("author <> ''").withColumn("y", F.col("y").cast("long")))
    key = F.sha2(F.concat_ws(" ", F.col("author"), F.col("y").cast("string"), F.col("words")), 256)  # of letters and digits only; cards of one key score alike
    own = own.withColumn("q", key)
    c = cut(own.select("q", "author", "y", "words").dropDuplicates(["q"]))
    p = cut(papers.where("title <> ''").select(F.col("id").alias("t"), F.lower("title").alias("title"), F.lower(F.coalesce("cite_key", F.lit(""))).alias("key"), F.col("year").cast("long").alias("year")))
    titles, keys = p.select("t", F.col("title").alias("text")), p.select("t", F.col("key").alias("text"))
    authors, each = c.select("q", F.col("author").alias("needle")), c.select("q", F.explode("words").alias("needle"))
    named = contained(authors, titles).unionByName(contained(authors, keys)).distinct()
    hits = authors.join(named, "needle").select("q", "t", F.lit(1).alias("a"), F.lit(0).alias("w"))
    hits = hits.unionByName(each.join(contained(each, titles), "needle").select("q", "t", F.lit(0).alias("a"), F.lit(1).alias("w")))
    hits = hits.groupBy("q", "t").agg(F.max("a").alias("a"), F.sum("w").alias("w"))
    first = p.where("year IS NOT NULL").groupBy("year").agg(F.min("t").alias("t"))
    lone = c.join(first, F.col("y") == F.col("year")).select("q", "t", F.lit(0).alias("a"), F.lit(0).cast("long").alias("w"))
    scored = hits.unionByName(lone).join(c.select("q", "y"), "q").join(p.select("t", "year"), "t")
    # Tenths as whole numbers, so that equal sums tie.
    score = 3 * F.col("a") + F.least(F.col("w"), F.lit(4)) + F.when(F.col("year") == F.col("y"), 3).otherwise(0)
    best = latest(scored.withColumn("s", score).where("s >= 2"), ["q"], [F.desc("s"), F.col("t")])
    return own.select("card_id", "q").join(best, "q").select("card_id", F.col("t").alias("paper_id"), (F.col("s") / 10).alias("score"))


def link_cards(cards: DataFrame, papers: DataFrame, threshold: float = 0.7) -> DataFrame:
    """ENT8: ``card_id, paper_id, method, status, score`` of unlinked ``cards(card_id, zettel_id, source_info)``.

    In turn: a citation key that the source line or the card id holds (``cite_key``; of papers that share a key, also
    without its separators, the largest id), author, year and keywords (``author_year``), the quoted title
    (``fuzzy_match``). Cards without a source line that no key links are ``skipped``, others ``unmatched``.
    """
    p = papers.where("cite_key <> ''").select("id", F.lower("cite_key").alias("c"))
    known = p.select("id", F.explode(F.array_distinct(F.array("c", F.regexp_replace("c", "[-_]", "")))).alias("k")).groupBy("k").agg(F.max("id").alias("paper_id"))
    keyed = cut(latest(_key_candidates(cards).join(known, "k"), ["card_id"], [F.col("pos")]).select("card_id", "paper_id"))
    rest = cards.join(keyed, "card_id", "left_anti")
    worded = cut(_by_words(rest, papers))
    titled = link_by_title(rest.join(worded, "card_id", "left_anti"), papers, threshold).where("status = 'linked'")
    found = keyed.select("card_id", "paper_id", F.lit("cite_key").alias("method"), F.lit(1.0).alias("score"))
    found = found.unionByName(worded.select("card_id", "paper_id", F.lit("author_year").alias("method"), "score"))
    found = found.unionByName(titled.select("card_id", "paper_id", F.lit("fuzzy_match").alias("method"), "score"))
    status = F.when(F.col("paper_id").isNotNull(), "linked").when(F.coalesce("source_info", F.lit("")) == "", "skipped").otherwise("unmatched")
    return cards.select("card_id", "source_info").join(found, "card_id", "left").select("card_id", "paper_id", "method", status.alias("status"), F.coalesce("score", F.lit(0.0)).alias("score"))


def files_to_entries(files: DataFrame, entries: DataFrame, threshold: float = 0.7) -> DataFrame:
    """ENT6: ``l, r, method, score`` of the ``files(l, name, title, authors, year)`` that match one of
    ``entries(r, cite_key, title, authors, year)``: the file's name is the key (of repeated keys the largest r), else the
    best title from the threshold on, else the same year with the best overlap of last names. Others are left out."""
    keys = last_by_key(entries, F.lower("cite_key"), "r").select("_k", "r")
    keyed = cut(files.join(keys, F.lower("name") == F.col("_k")).select("l", "r", F.lit("cite_key").alias("method"), F.lit(1.0).alias("score")))
    rest = files.join(keyed, "l", "left_anti")
    titled = cut(best_titles(rest.select("l", "title"), entries.select("r", "title"), threshold).select("l", "r", F.lit("title").alias("method"), F.col("ratio").alias("score")))
    rest = rest.join(titled, "l", "left_anti")
    names = lambda d, i: d.select(i, "year", F.explode("authors").alias("a")).where("year IS NOT NULL AND trim(a) <> ''").select(i, "year", last_name(F.col("a")).alias("name"))
    dated = best_by_overlap(names(rest, "l"), names(entries, "r")).select("l", "r", F.lit("author_year").alias("method"), F.col("overlap").alias("score"))
    return keyed.unionByName(titled).unionByName(dated)


def files_by_key(files: DataFrame, entries: DataFrame, threshold: float = 0.8) -> DataFrame:
    """ENT9: ``l, r, score``: for each of ``files(l, key)`` the ``entries(r, cite_key)`` whose key is most similar, as it
    stands or without accents and signs, from the threshold on; ties to the smaller r."""
    found = None
    for form in (F.lower, unicode_key):
        got = best_titles(files.select("l", form("key").alias("title")), entries.select("r", form("cite_key").alias("title")), threshold)
        found = got if found is None else found.unionByName(got)
    return latest(found, ["l"], [F.desc("ratio"), F.col("r")]).select("l", "r", F.col("ratio").alias("score"))


# --- imports -----------------------------------------------------------------------------------


def index_fields(indexes: DataFrame, text: str = "value") -> DataFrame:
    """SRC14: the columns of ``indexes`` and the fields of its card indexes' front matter; the title field holds the key.
    Texts without front matter give null fields."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    field = lambda name: F.nullif(F.regexp_replace(strip(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1)), r"""^["']|["']$""", ""), F.lit(""))
    return indexes.select(
        "*", field("title").alias("cite_key"), field("paper_title").alias("paper_title"), field("authors").alias("authors"),
        field("year").try_cast("long").alias("year"), field("card_count").try_cast("long").alias("card_count"))


def index_cards(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SNK6/SNK7: the card table after an import, ``card_id, relation, position, target`` of the cards put in, and ``status, n``.

    ``new`` has the columns of ``old`` (``zettel_id, title, content`` among them). A card without id or title is a
    ``parse_error``; one whose id the table or an earlier row (smaller title, then content) holds is a ``duplicate``.
    """
    bad = F.coalesce(F.trim("zettel_id"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("title"), F.lit("")).eqNullSafe("")
    rows = cut(new.select(*old.columns).withColumn("_row", F.monotonically_increasing_id()))
    known = old.select(F.col("zettel_id").alias("_z")).distinct()
    fresh = latest(rows.where(~bad), ["zettel_id"], [F.col("title"), F.col("content"), F.col("_row")])
    put = cut(fresh.join(known, F.col("zettel_id") == F.col("_z"), "left_anti"))
    told = rows.withColumn("_bad", bad).join(put.select("_row", F.lit(True).alias("_in")), "_row", "left")
    counts = told.groupBy(F.when(F.col("_bad"), "parse_error").when(F.col("_in"), "inserted").otherwise("duplicate").alias("status")).agg(F.count("*").alias("n"))
    links = card_links(put, "zettel_id", "content").withColumnRenamed("zettel_id", "card_id")
    return old.unionByName(put.drop("_row")), links, counts


def rebuild_links(cards: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK10: the links that the texts of ``cards(zettel_id, content)`` hold, and ``change, n`` against the present table (the dry run)."""
    key = ["card_id", "relation", "position", "target"]
    new = cut(card_links(cards, "zettel_id", "content").withColumnRenamed("zettel_id", "card_id").select(*key))
    both = new.select(*key, F.lit(1).alias("w")).unionByName(links.select(*key, F.lit(2).alias("w"))).distinct().groupBy(*key).agg(F.sum("w").alias("w"))
    return new, both.groupBy(F.element_at(F.array(F.lit("added"), F.lit("removed"), F.lit("kept")), F.col("w").cast("int")).alias("change")).agg(F.count("*").alias("n"))


def delete_cards(cards: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SNK8: cards and links without those of the cards ``gone(card_id)``, and ``deleted, n`` for both tables."""
    g = cut(gone.select("card_id").distinct())
    counts = cards.join(g, "card_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit("cards").alias("deleted"), "n")
    counts = counts.unionByName(links.join(g, "card_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit("links").alias("deleted"), "n"))
    return cards.join(g, "card_id", "left_anti"), links.join(g, "card_id", "left_anti"), counts


def with_key_prefix(cards: DataFrame, cite_key: str) -> DataFrame:
    """SNK8: ``card_id`` of the cards whose id begins with a citation key and a hyphen."""
    return cards.where(F.startswith("zettel_id", F.lit(f"{cite_key}-"))).select("card_id")


def import_folders(indexes: DataFrame, cards: DataFrame, papers: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PIP1: ``folder, paper_id, status`` of each index, the papers to create, and the links of the cards.

    ``indexes(folder, cite_key)`` meet ``papers(id, cite_key)`` and else ``entries(cite_key, title, year)`` by FLT8; a paper that only the
    bibliography has is ``created`` from it (without id yet), others are ``found`` or ``missing``. Cards
    ``(folder, card_id)`` of papers found link to them with similarity 1.
    """
    wanted = indexes.select(F.col("cite_key").alias("key"))
    have = entries_by_key(papers, wanted).select("key", F.col("id").alias("paper_id"))
    named = entries.where("cite_key <> ''").groupBy("cite_key").agg(F.min_by(F.struct("title", "year"), F.struct("title", "year")).alias("x"))
    known = entries_by_key(named.select(F.col("cite_key").alias("id"), "cite_key"), wanted).select("key", F.col("cite_key").alias("entry"))
    rows = indexes.join(have, F.col("cite_key") == F.col("key"), "left").drop("key").join(known, F.col("cite_key") == F.col("key"), "left")
    status = F.when(F.col("paper_id").isNotNull(), "found").when(F.col("entry").isNotNull(), "created").otherwise("missing")
    told = cut(rows.select("folder", "paper_id", "entry", status.alias("status")))
    new = told.where("status = 'created'").select(F.col("entry").alias("cite_key")).distinct().join(named, "cite_key").select("cite_key", "x.title", "x.year")
    links = cards.join(told.where("status = 'found'").select("folder", "paper_id"), "folder").select("paper_id", "card_id", F.lit(1.0).alias("similarity"))
    return told.select("folder", "paper_id", "status"), new, links


def sync(entries: DataFrame, papers: DataFrame, matches: DataFrame, strategy: str = "skip") -> DataFrame:
    """SET5/PIP2: ``l, title, year, cite_key, action, valid``: the entries to import, ``entries(l, ...)``, ``papers(r, ...)``, ``matches(l, r)``.

    New entries always; matched ones not (``skip``), as they are (``replace``) or with gaps filled from the paper
    (``merge``). An entry without a title is not valid.
    """
    if strategy not in ("skip", "replace", "merge"):
        raise ValueError(f"unknown strategy {strategy}")
    m = matches.where("r IS NOT NULL").select("l", "r")
    fields = [c for c in entries.columns if c != "l"]
    empty = lambda c: F.nullif(F.col(c), F.lit("")) if dict(entries.dtypes)[c] == "string" else F.col(c)
    out = entries.join(m, "l", "left_anti").withColumn("action", F.lit("new"))
    if strategy != "skip":
        old = papers.select("r", *[F.col(c).alias(f"_p_{c}") for c in fields if c in papers.columns])
        dup = entries.join(m, "l").join(old, "r", "left")
        own = ("title", "cite_key", "doi")  # stay the entry's
        fill = lambda c: F.coalesce(empty(c), F.col(f"_p_{c}")) if strategy == "merge" and c in papers.columns and c not in own else F.col(c)
        out = out.unionByName(dup.select("l", *[fill(c).alias(c) for c in fields], F.lit(strategy).alias("action")))
    return out.withColumn("valid", F.coalesce(F.trim("title"), F.lit("")) != "")

