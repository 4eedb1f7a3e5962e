"""Operator 6: allow and block lists of hosts and paths as a trie, the longest entry winning.

The trie has the labels of a host from the last to the first, then the segments of a path; the
rest of a path after its last slash is kept at the node and fits any segment that starts with it.
An entry fits its host and all subdomains, and every path that starts with its path. The longest
entry (characters of host and path) wins, then the longer host, then block.

Tries are broadcast in parts of at most ``max_rules`` entries, so that what an executor holds is
bounded; with more entries the parts are applied one after another and the better match is kept.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no entry and gets
the default verdict; urls of any length work, in time linear in their labels and segments;
repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import ship

#: ASCII upper to lower case.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MAX_RULES = 500_000
PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    m = PARTS.search(url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


class Trie:
    """Nodes are dicts: labels and segments to nodes, END to the entries ending there."""

    END, PATH = 0, 1

    def __init__(self, rules):
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"no such verdict: {verdict}")
            host = host.translate(LOWER)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATH, {})
            *segments, rest = path.split("/")
            for s in segments:
                node = node.setdefault((s,), {})
            rank = (len(host) + len(path), len(host), verdict == "block")
            best = node.setdefault(self.END, {})
            best[rest] = max(best.get(rest, ((0, 0, False), "", "")), (rank, host + path, verdict))

    def match(self, host: str, path: str):
        """The best ``(rank, rule, verdict)``, or None."""
        best, node = None, self.root
        segments = None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            at = node.get(self.PATH)
            if at is None:
                continue
            segments = segments or path.split("/")
            for s in segments:
                for rest, entry in at.get(self.END, {}).items():
                    if s.startswith(rest) and (best is None or entry > best):
                        best = entry
                at = at.get((s,))
                if at is None:
                    break
        return best


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """``id_col, host, path, rule, verdict``; rules are ``(verdict, host, path)``. No shuffle."""
    spark = pages.sparkSession
    ship(spark)
    kind = pages.schema[id_col].dataType.simpleString()
    parts = [rules[i : i + max_rules] for i in range(0, len(rules), max_rules)] or [[]]
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), *(F.lit(None).cast(t).alias(n) for n, t in (("size", "long"), ("hosts", "long"), ("rule", "string"), ("verdict", "string"))))
    for part in parts:
        trie = spark.sparkContext.broadcast(Trie(part))

        def run(batches, trie=trie):
            t = trie.value
            for b in batches:
                rows = []
                for url, size, hosts, rule, verdict in zip(*(b.column(c).to_pylist() for c in ("url", "size", "hosts", "rule", "verdict"))):
                    was = ((size, hosts, verdict == "block"), rule, verdict) if rule is not None else None
                    got = t.match(*split_url(url))
                    got = max(was, got) if was and got else was or got
                    rows.append((got[0][0], got[0][1], got[1], got[2]) if got else (None, None, None, None))
                size, hosts, rule, verdict = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(size, pa.int64()), pa.array(hosts, pa.int64()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["id", "url", "size", "hosts", "rule", "verdict"])

        out = out.mapInArrow(run, f"id {kind}, url string, size long, hosts long, rule string, verdict string")
    found = F.instr("url", "://") > 0
    rest = F.expr("substr(url, instr(url, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return out.select(
        F.col("id").alias(id_col), F.when(found, host).otherwise("").alias("host"), F.when(found, path).otherwise("").alias("path"),
        "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
