"""Text to records: cards, links, slides, bibliographies, identifiers, paper structure.

Whatever regular expressions express is built-in functions; record-delimited formats are parsed in
Arrow batches, one text to many records.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def strip(c: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# --- built-in functions ------------------------------------------------------------------------


def dois(text: Column) -> Column:
    """PRS10: distinct DOIs of a text, without resolver addresses and trailing punctuation, sorted."""
    found = F.regexp_extract_all(text, F.lit(r"""(?i)\b10\.\d{4,}/[^\s\])>"';,]+"""), F.lit(0))
    clean = F.transform(found, lambda d: F.regexp_replace(d, r"""[\s.,;:)\]>"']+$""", ""))
    return F.sort_array(F.array_distinct(F.filter(clean, lambda d: d.rlike(r"^10\.\d{4,}/."))))


#: The six relation words of the link section.
RELATION_WORDS = ["基於", "導向", "相關", "對比", "上位", "下位"]


def card_links(cards: DataFrame, id_col: str = "card_id", text_col: str = "content") -> DataFrame:
    """PRS2/SNK10: ``id_col, relation, position, target`` of the link section; arrows → ↔ ⚡, and both id formats."""
    network = F.regexp_extract(text_col, r"(?s)##\s*連結網絡\s*\n(.+?)(?=\n##|\z)", 1)
    item = rf"(?s)\*\*({'|'.join(RELATION_WORDS)})\*\*\s*[→↔⚡]\s*(.+?)(?=\n\s*\n|\n\*\*|\n##|\z)"
    rows = cards.select(id_col, F.arrays_zip(F.regexp_extract_all(network, F.lit(item), F.lit(1)).alias("relation"), F.regexp_extract_all(network, F.lit(item), F.lit(2)).alias("targets")).alias("x"))
    ids = lambda p: F.regexp_extract_all("targets", F.lit(rf"\[\[([A-Za-z][A-Za-z0-9-]*-{p}-\d{{3}})\]\]"), F.lit(1))
    each = rows.select(id_col, F.explode("x").alias("x")).select(id_col, "x.relation", "x.targets")
    short, dated = ids(r"(?:\d{3,4}[a-z]?|cjk)"), ids(r"\d{8}")
    return each.select(id_col, "relation", F.posexplode(F.when(F.size(short) > 0, short).otherwise(dated)).alias("position", "target"))


def normal_card_id(c: Column) -> Column:
    """``CogSci20251028001`` or ``AI_20251029_005`` as ``Domain-date-number``."""
    return F.regexp_replace(F.trim(F.replace(c, F.lit("_"), F.lit("-"))), r"^([A-Za-z]+)-?(\d{8})-?(\d{3})$", "$1-$2-$3")


def card_domain(c: Column) -> Column:
    return F.when(c.rlike("^[A-Za-z]+-"), F.regexp_extract(c, "^([A-Za-z]+)-", 1)).otherwise("Unknown")


def fix_links(text: Column) -> Column:
    """PRS9: ``[[Name2009002]]`` as ``[[Name-2009-002]]``, numbers padded to three digits."""
    three = F.regexp_replace(text, r"\[\[([A-Za-z]+)(\d{4})(\d{3})\]\]", r"[[$1-$2-$3]]")
    return F.regexp_replace(three, r"\[\[([A-Za-z]+)(\d{4})(\d{2})\]\]", r"[[$1-$2-0$3]]")


def ai_part(text: Column) -> Column:
    """PRS7: a card without its human notes."""
    text = F.coalesce(text, F.lit(""))
    return F.rtrim(F.regexp_replace(text, r"(?s)\*\*\[Human\]\*\*:.*?(?=\n##|\z)", ""))


def human_part(text: Column) -> Column:
    return strip(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\*\*\[Human\]\*\*:\s*(.*?)(?=\n##|\z)", 1))


def year_of(text: Column) -> Column:
    """The first year 1900-2099 that stands as a word."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def tagless(html: Column) -> Column:
    """Text of a page: no scripts, styles and tags; white space is one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " "), r"\s+", " "))


#: Parts of addresses of academic sites.
ACADEMIC = ["arxiv.org", "doi.org", "pubmed.ncbi.nlm.nih.gov", "nature.com", "science.org", "springer.com", "wiley.com", "tandfonline.com", "sagepub.com", "journals.plos.org", "frontiersin.org", "psycnet.apa.org", "biorxiv.org", "medrxiv.org", "osf.io"]


def source_type(source: Column) -> Column:
    """SRC10: academic page, web page, PDF or text."""
    s = F.lower(source)
    academic = s.rlike("|".join(re.escape(x) for x in ACADEMIC))
    return F.when(s.rlike("^https?://"), F.when(academic, "academic").otherwise("web")).when(s.endswith(".pdf"), "pdf").otherwise("text")


def web_pages(pages: DataFrame, limits: tuple[int, int] = (40_000, 30_000)) -> DataFrame:
    """SRC8/SRC9: text of pages, cut to the limit of their type, with the count of characters and whether it was cut."""
    t = pages.select("page_id", "url", source_type(F.col("url")).alias("source_type"), tagless(F.col("html")).alias("text"))
    most = F.when(F.col("source_type") == "academic", limits[0]).otherwise(limits[1])
    return t.select("page_id", "source_type", F.substring("text", F.lit(1), most).alias("full_text"), F.least(F.length("text"), most).alias("char_count"), (F.length("text") > most).alias("truncated"))


def resolve_source(rows: DataFrame, most: int) -> DataFrame:
    """SRC11: the first of ``from_kb, pdf_text, url_text, content`` that has text, cut to ``most`` characters."""
    full = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("from_kb", "pdf_text", "url_text", "content")])
    kind = F.coalesce(*[F.when(F.col(c) != "", F.lit(n)) for c, n in (("from_kb", "kb"), ("pdf_text", "pdf"), ("url_text", "url"), ("content", "raw"))])
    return rows.select("id", F.substring(full, 1, most).alias("text"), kind.alias("origin"), F.coalesce(F.length(full) > most, F.lit(False)).alias("truncated"))


def file_names(names: DataFrame, col: str = "name") -> DataFrame:
    """SRC12: first author, year and title of file names in three forms; else the name is the title."""
    n, plain = F.col(col), lambda c: F.regexp_replace(c, "[_-]", " ")
    p1, p2, p3 = r"^([A-Z][a-z]+(?:[_-][A-Z][a-z]+)*)[_-](\d{4})[_-](.+)$", r"(?i)^(.+?)\s+et\s+al\.?\s*\((\d{4})\)\s*(.+)$", r"^(.+?)\s*[-–—]\s*(.+?)\s*\((\d{4})\)$"
    g = lambda p, i: F.trim(F.regexp_extract(n, p, i))
    return names.select(
        n, F.when(n.rlike(p1), F.split(g(p1, 1), "[_-]")[0]).when(n.rlike(p2), g(p2, 1)).when(n.rlike(p3), g(p3, 2)).alias("author"),
        F.when(n.rlike(p1), g(p1, 2)).when(n.rlike(p2), g(p2, 2)).when(n.rlike(p3), g(p3, 3)).otherwise(F.nullif(F.regexp_extract(n, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))).cast("int").alias("year"),
        F.when(n.rlike(p1), plain(g(p1, 3))).when(n.rlike(p2), g(p2, 3)).when(n.rlike(p3), g(p3, 1)).otherwise(plain(n)).alias("title"))


def crossref(rows: DataFrame, col: str = "json") -> DataFrame:
    """SRC5: DOI, title, authors, year (print, else online) and abstract (no tags, over ten characters) of a record."""
    schema = "struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,abstract:string>"
    r = rows.select("id", F.from_json(col, schema).alias("r"))
    date = lambda c: F.get(F.get(F.col("r")[c]["date-parts"], F.lit(0)), F.lit(0))
    plain = F.trim(F.regexp_replace("r.abstract", "<[^>]+>", ""))
    return r.select("id", F.col("r.DOI").alias("doi"), F.get("r.title", F.lit(0)).alias("title"), F.transform("r.author", lambda a: F.concat_ws(" ", a["given"], a["family"])).alias("authors"),
                    F.coalesce(date("published-print"), date("published-online")).alias("year"), F.when(F.length(plain) > 10, plain).alias("abstract"))


def people(c: Column) -> Column:
    """PIP8: a list of names from a JSON list, else from text joined by "and" or commas."""
    json_list = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
    parts = F.when(c.rlike(r"\sand\s"), F.split(c, r"\s+and\s+")).otherwise(F.split(c, ","))
    return F.filter(F.transform(F.coalesce(json_list, parts), lambda x: F.trim(x)), lambda x: x != "")


#: Fixed value: headings that open a reference list.
REFERENCES = r"(?im)^\s*(?:\d+\.?\s+|[IVXLC]+\.?\s+)?(?:References(?:\s+and\s+Notes)?|Reference\s+List|Bibliography|Literature\s+Cited|Works\s+Cited|參考文獻|參考書目|引用文獻)\s*$"



def card_fields(cards: DataFrame, id_col: str = "card_id", text_col: str = "content") -> DataFrame:
    """PRS1/PRS8: fields of a card's Markdown. The core is a quoted ``> **核心**: "..."`` or the front matter's
    ``description`` (both dialects of our writers); a missing id, type or domain falls back to the file's id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    front = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---", 1)
    field = lambda name: F.nullif(F.regexp_replace(F.trim(F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.*)$", 1)), "^[\"']|[\"']$", ""), F.lit(""))
    body = lambda name: F.nullif(strip(F.regexp_extract(text, rf"(?s)##\s*{name}\s*\n(.*?)(?=\n##|\z)", 1)), F.lit(""))
    card_id = F.coalesce(field("id"), F.col(id_col).cast("string"))
    tags = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(field("tags"), F.lit("")), r"[\[\]\"']", ""), ","), lambda t: F.trim(t)), lambda t: t != "")
    core = F.nullif(F.regexp_extract(text, r">\s*\*\*核心\*\*:\s*\"?([^\"\n]+)\"?", 1), F.lit(""))
    return cards.select(
        F.col(id_col), card_id.alias("zettel_id"), F.coalesce(field("title"), F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(.+)$", 1)), F.lit(""))).alias("title"), F.coalesce(field("type"), F.lit("concept")).alias("card_type"),
        F.coalesce(core, field("description")).alias("core_concept"), body("說明").alias("description"), F.regexp_extract(card_id, "^([A-Za-z]+)", 1).alias("domain"), tags.alias("tags"), field("source").alias("source_info"),
        F.nullif(strip(F.regexp_extract(text, r"(?s)\*\*\[AI Agent\]\*\*:\s*(.*?)(?=\*\*\[Human\]\*\*:|\n##|\z)", 1)), F.lit("")).alias("ai_notes"), F.nullif(human_part(text), F.lit("")).alias("human_notes"))


def paper_structure(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """PRS5: title (the first of ten lines with over ten characters), abstract (at most 2000 characters), keywords
    (at most ten), common section headings in order (at most twenty) and whether references occur."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 10), lambda x: F.trim(x))
    abstract = strip(F.regexp_extract(text, r"(?is)(?:Abstract|摘要)\s*[:\n]+(.*?)(?=\n\n|\nIntroduction|\n1\.|\n[一二三四五])", 1))
    keywords = F.regexp_extract(text, r"(?i)(?:Keywords?|關鍵詞)\s*[:-]+(.*?)(?=\n)", 1)
    heads = F.regexp_extract_all(text, F.lit(r"(?i)\n(Introduction|Background|Related Work|Methods|Methodology|Results|Discussion|Conclusion|References)\s*(?=\n)"), F.lit(1))
    return rows.select(
        F.col(id_col), F.get(F.filter(lines, lambda x: F.length(x) > 10), F.lit(0)).alias("title"), F.nullif(F.substring(abstract, 1, 2000), F.lit("")).alias("abstract"),
        F.slice(F.filter(F.transform(F.split(keywords, r"[,;，；]+"), lambda k: F.trim(k)), lambda k: k != ""), 1, 10).alias("keywords"), F.slice(heads, 1, 20).alias("sections"),
        text.rlike("References|REFERENCES|Bibliography|參考文獻|Reference List").alias("references_found"))


def markdown_table(grid: Column) -> Column:
    """SRC7: a grid (array of rows of cells) as a Markdown table; null cells are empty, empty rows left out."""
    clean = F.filter(F.transform(grid, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))), lambda r: F.exists(r, lambda c: c != ""))
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get(clean, F.lit(0)))))
    return F.when(F.size(clean) > 0, F.concat_ws("\n", row(F.get(clean, F.lit(0))), rule, F.array_join(F.transform(F.slice(clean, 2, F.greatest(F.size(clean) - 1, F.lit(0))), row), "\n")))


def bibliography_statistics(records: DataFrame) -> DataFrame:
    """AGG10: records, and how many (and what share) have each field."""
    have = {c: F.count_if(F.col(c).isNotNull() & (F.col(c) != "")) for c in ("doi", "abstract")} | {"year": F.count("year"), "keywords": F.count_if(F.size("keywords") > 0)}
    return records.groupBy("entry_type").agg(F.count("*").alias("total"), *[x.alias(f"with_{c}") for c, x in have.items()], *[(x * 100.0 / F.count("*")).alias(f"{c}_percent") for c, x in have.items()])


def match_statistics(matches: DataFrame) -> DataFrame:
    """AGG11/AGG19: of rows ``match_type, score``: counts, shares and mean score by type."""
    total = matches.agg(F.count("*").alias("all"))
    return matches.groupBy("match_type").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")).crossJoin(F.broadcast(total)).select("match_type", "n", "mean_score", (F.col("n") * 100.0 / F.col("all")).alias("percent"))


# --- record formats ----------------------------------------------------------------------------


def ris_records(text: str) -> list[dict]:
    """SRC4: the records of an RIS text that have a title."""
    many, out, now, tag = {"AU", "A1", "A2", "KW"}, [], None, None
    for line in filter(None, map(str.rstrip, text.splitlines())):
        m = re.match(r"([A-Z][A-Z0-9])\s+-\s*(.*)$", line)
        if not m:
            if now is not None and tag in now and tag not in many:
                now[tag] += " " + line.strip()
            continue
        tag, value = m[1], m[2].strip()
        if tag == "TY":
            now = {"TY": value}
        elif tag == "ER":
            if now and (now.get("TI") or now.get("T1")):
                out.append(now)
            now = None
        elif now is not None and tag in many:
            now.setdefault(tag, []).append(re.sub(r"\s+", " ", value))
        elif now is not None:
            now[tag] = value
    first = lambda r, *tags: next((r[t] for t in tags if r.get(t)), None)
    year = lambda s: int(m[0]) if (m := re.search(r"\b(?:19|20)\d{2}\b", s or "")) else None
    return [{
        "entry_type": r["TY"] or "GEN", "title": first(r, "TI", "T1"), "id": first(r, "ID", "AN"), "doi": re.sub(r"^https?://(dx\.)?doi\.org/", "", first(r, "DO", "DOI") or "") or None,
        "authors": first(r, "AU", "A1") or [], "year": year(first(r, "PY", "Y1")), "abstract": first(r, "AB", "N2"), "keywords": r.get("KW", []), "journal": first(r, "JO", "JF", "T2"),
        "pages": "-".join(filter(None, (r.get("SP"), r.get("EP")))) or None,
    } for r in out]


#: Characters written as LaTeX.
LATEX = {r"\"a": "ä", r"\"o": "ö", r"\"u": "ü", r"\'e": "é", r"\'a": "á", r"\'i": "í", r"\~n": "ñ", r"\^e": "ê", "---": "—", "--": "–"}


def plain_latex(text: str) -> str:
    text = re.sub(r"\\[a-zA-Z]+\{([^}]*)\}", r"\1", text).replace("{", "").replace("}", "")
    for code, char in LATEX.items():
        text = text.replace(code, char)
    return " ".join(text.split())


def bibtex_records(text: str) -> list[dict]:
    """SRC3: the entries of a BibTeX text; values in braces (nested) or quotes; an entry that can't be read is skipped."""
    out = []
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s{}]+)\s*,", text):
        kind, fields, i = m[1].lower(), {}, m.end()
        if kind in ("comment", "string", "preamble"):
            continue
        while f := re.compile(r"\s*([\w-]+)\s*=\s*").match(text, i):
            i, depth, start = f.end(), 0, f.end()
            quote = text[i : i + 1] == '"'
            while i < len(text):
                c = text[i]
                depth += (c == "{") - (c == "}")
                if depth < 0 or (depth == 0 and (c == "," if not quote else i > start and c == '"')):
                    break
                i += 1
            raw = text[start:i].strip()
            i += quote
            fields[f[1].lower()] = raw[1:-1] if raw[:1] == "{" and raw[-1:] == "}" else raw.strip('"')
            i = (re.compile(r"\s*,?").match(text, i)).end()
        seen: dict[str, str] = {}
        for k in re.split(r"[,;]\s*", fields.get("keywords", "")):
            if k := plain_latex(k):
                seen.setdefault(k.lower(), k)
        year = re.search(r"\b(?:19|20)\d{2}\b", fields.get("year", ""))
        out.append({
            "entry_type": kind, "title": plain_latex(fields.get("title", "")), "id": m[2], "doi": fields.get("doi"), "authors": [a for x in re.split(r"(?i)\s+and\s+", fields.get("author", "")) if (a := plain_latex(x))],
            "year": int(year[0]) if year else None, "abstract": fields.get("abstract"), "keywords": list(seen.values()), "journal": fields.get("journal") or fields.get("booktitle"), "pages": fields.get("pages"),
        })
    return out


RECORD = "entry_type string, title string, id string, doi string, authors array<string>, year int, abstract string, keywords array<string>, journal string, pages string"


def decode(data: bytes) -> str:
    """UTF-8 (with or without mark), else Latin-1."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def bibliography(files: DataFrame, kind: str, content: str = "content") -> DataFrame:
    """SRC3/SRC4: records of whole files (``content`` binary or string), with a row's number in its file."""
    parse = {"ris": ris_records, "bibtex": bibtex_records}[kind]

    def run(batches):
        for b in batches:
            rows = [r for data in b.column("content").to_pylist() for r in parse(decode(data or b""))]
            arrays = [pa.array([r[n] for r in rows], t) for n, t in RECORD_TYPES]
            yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in RECORD_TYPES])

    return files.select(F.col(content).cast("binary").alias("content")).mapInArrow(run, RECORD)


_S, _L = pa.string(), pa.list_(pa.string())
RECORD_TYPES = [("entry_type", _S), ("title", _S), ("id", _S), ("doi", _S), ("authors", _L), ("year", pa.int32()), ("abstract", _S), ("keywords", _L), ("journal", _S), ("pages", _S)]

#: Section and link words of generated cards, in the order in which they are tried.
SECTIONS = [("links", ("連結", "links")), ("source_context", ("來源", "source context")), ("personal_notes", ("個人", "personal notes")), ("open_questions", ("待解", "open questions")), ("detailed_explanation", ("說明", "explanation"))]
LINKS = [("foundation_links", ("基於", "foundation")), ("derived_links", ("導向", "derived")), ("related_links", ("相關", "related")), ("contrast_links", ("對比", "contrast"))]
HEADS = {"標題:": "title", "title:": "title", "類型:": "card_type", "type:": "card_type", "核心:": "core_summary", "core:": "core_summary", "標籤:": "tags", "tags:": "tags"}

CARD_MARK = re.compile(r"===\s*CARD:\s*(?P<id>.+?)\s*===")
FIELD = re.compile(rf"\s*(?P<head>{'|'.join(map(re.escape, HEADS))})(?P<value>.*)", re.I)
HEADING = re.compile(r"[\s#*\-　]*(?P<words>[^\s#*\-　].*?)?[\s*]*[:：]+\s*")
WIKI = re.compile(r"\[\[(?!-)\s*(?P<id>[^\]|]+?)\s*(?:\|[^\]]*)?\]\]")
LISTED = re.compile(r"(?:^|[,:：→←↔⚡⬆⬇<>])\s*(?P<id>[A-Za-z][\w-]*\d)\s*(?=,|[→←↔⚡⬆⬇<>]|$)")


def lines_of(body: str):
    """``(kind, name, value)`` of each line of a card: a ``field``, the ``heading`` of a section, or a ``line``."""
    for line in body.split("\n"):
        if m := FIELD.fullmatch(line):
            yield "field", HEADS[m["head"].lower()], m["value"].strip()
            continue
        m = HEADING.fullmatch(line)
        words = (m["words"] or "").lower() if m else ""
        named = [name for name, marks in SECTIONS if any(x in words for x in marks)] if 0 < len(words) <= 20 else []
        yield ("heading", named[0], "") if named else ("line", "", line)


def link_kind(line: str) -> str | None:
    low = line.lower()
    return next((kind for kind, marks in LINKS if any(x in low for x in marks)), None)


def link_targets(line: str) -> list[str]:
    """Ids in double brackets, without files; else the listed ids behind the line's first separator."""
    if "[[" in line:
        return [m["id"] for m in WIKI.finditer(line) if len(m["id"]) > 2 and not m["id"].endswith(".pdf")]
    return [m["id"] for m in LISTED.finditer(line.strip()) if m.start() > 0]


def generated_cards(text: str) -> list[dict]:
    """PRS3: the cards of a generated text, blocks that open with ``===CARD: id===``; those without a title are left out."""
    marks = list(CARD_MARK.finditer(text))
    cards = []
    for mark, end in zip(marks, [m.start() for m in marks[1:]] + [len(text)]):
        fields, sections, section = {"title": "", "card_type": "concept", "core_summary": ""}, {}, None
        for kind, name, value in lines_of(text[mark.end() : end]):
            if kind == "field":
                fields[name] = value
            elif kind == "heading":
                section = name
                sections[name] = sections.get(name, []) if name == "links" else []  # link sections add up, others start anew
            elif section:
                sections[section].append(value)
        if not fields["title"]:
            continue
        tags = fields.pop("tags", None)
        links = [(link_kind(x), x) for x in sections.pop("links", ())]
        cards.append(
            {"id": mark["id"], **fields, "tags": [t.strip() for t in tags.split(",")] if tags is not None else []}
            | {kind: [t for own, x in links if own == kind for t in link_targets(x)] for kind, _ in LINKS}
            | {name: "\n".join(sections.get(name, ())).strip() for name, _ in SECTIONS[1:]}
        )
    return cards


#: Marks of slides in the order in which they are tried, and whether a title tells the title page (else the first place does).
SLIDE_MARKS = [
    (re.compile(r"===(?P<title>[^=]+)==="), True),
    (re.compile(r"^[^\S\n]*\*\*投影片\s*\d+[：:]\s*(?P<title>.+?)\*\*[^\S\n]*$", re.M), False),
    (re.compile(r"^[^\S\n]*#{1,3}[^\S\n]+(?P<title>.+)$", re.M), False),
]


def slides(text: str) -> list[dict]:
    """PRS4: slides marked by ``===title===``, else by bold numbered headings, else by ``#`` headings."""
    for pattern, by_title in SLIDE_MARKS:
        marks = list(pattern.finditer(text))
        ends = [m.start() for m in marks[1:]] + [len(text)]
        cover = [("標題頁" in m["title"] or "Title" in m["title"]) if by_title else m is marks[0] and len(marks) > 1 for m in marks]
        if marks:
            return [{"title": m["title"].strip(), "content": text[m.end() : e].strip(), "type": "title" if c else "content"} for m, e, c in zip(marks, ends, cover)]
    return []


def parsed(rows: DataFrame, kind: str, id_col: str, text_col: str) -> DataFrame:
    """PRS3/PRS4: ``id_col, position, record`` (JSON) of each card or slide of a text."""
    parse = {"cards": generated_cards, "slides": slides}[kind]

    def run(batches):
        for b in batches:
            got = [(i, n, json.dumps(r, ensure_ascii=False)) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()) for n, r in enumerate(parse(t or ""), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], b.column("id").type), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())], [id_col, "position", "record"])

    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, position int, record string")


def strip_references(text: str) -> tuple[str, bool]:
    """PRS6: a text up to its last reference heading after a fifth of its length, and whether there was one."""
    at = [m.start() for m in re.finditer(REFERENCES, text or "") if m.start() >= 0.2 * len(text)]
    return (text[: at[-1]].rstrip(), True) if at else (text or "", False)


def rewrite_links(text: str, ids: dict[str, str]) -> str:
    """PRS11: links to known ids renamed, to unknown ones plain; those with a display text or to PDFs stay."""
    def new(m):
        t = m[1]
        return m[0] if "|" in t or t.endswith(".pdf") else f"[[{ids[t]}]]" if t in ids else t
    return re.sub(r"\[\[([^\]]+)\]\]", new, text or "")
