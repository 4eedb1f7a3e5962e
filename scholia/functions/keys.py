"""Columns made of columns: citation keys, page ranges, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.operators.cooccurrence import last_name


def cite_key(first_author: Column, year: Column, suffix: Column | None = None) -> Column:
    """``Name-2016`` (and a suffix): the last name of the first author without signs, capitalised; null without a name or year."""
    name = F.initcap(F.regexp_replace(last_name(first_author), r"(?U)[^\w]", ""))
    parts = [name, F.lit("-"), year.cast("string")] + ([F.coalesce(suffix, F.lit(""))] if suffix is not None else [])
    return F.when((name != "") & year.isNotNull(), F.concat(*parts))


def key_in_name(name: Column) -> Column:
    """the citation key ``Name-2016a`` that a file name begins with, or an empty text."""
    return F.regexp_extract(name, r"^([A-Za-z]+[-_]?\d{4}[a-z]?)(?![A-Za-z0-9])", 1)


def card_id(key: Column, number: Column) -> Column:
    """PIP10: ``key-007``."""
    return F.format_string("%s-%03d", key, number)


def page_range(start: Column, end: Column) -> Column:
    """PIP12: ``12-34``, ``12`` without an end, null without both."""
    return F.nullif(F.concat_ws("-", F.nullif(start, F.lit("")), F.nullif(end, F.lit(""))), F.lit(""))


def fingerprint(content: Column) -> Column:
    """F8: SHA-1 of bytes, or of the UTF-8 bytes of a text, as lowercase hex."""
    return F.sha1(content)
