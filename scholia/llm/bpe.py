"""Operator 10: byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece exactly one token can end its encoding. The table of these last
tokens is filled from left to right: a token that matches the end of the prefix is the last one
if the pair it makes with the last token before it survives on its own, that is, if merging the
pair's bytes gives just this pair. The encoding is read off backwards. Appending bytes only adds
table entries; an edit keeps all pieces that it leaves unchanged.

Edge cases: a null text is empty; an empty text has no ids, and the digests are those of the
empty string; any text length works, each piece in time linear in its bytes; texts repeated in
several rows are encoded in each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import release, ship

#: Pieces of at most so many bytes are encoded together and remembered. Beyond so many of them,
#: only those of the current batch are kept. Tests of pairs are kept in bounded tables as well.
SHORT_BYTES, CACHED_PIECES, CACHED_PAIRS, PAIR_SLOTS, BATCH = 48, 120_000, 100_000, 1 << 20, 1 << 20

#: The standard library's engine is faster, but knows no \\p classes: for texts below U+0250 the
#: letters, numbers and white space are listed. Used only for the pattern that it spells out.
NOT_LATIN = re.compile("[^\x00-\u024f]")
LATIN_CLASSES = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ɏ", r"\p{N}": "0-9²³¹¼-¾", r"\s": "\t-\r \x85\xa0"}


def latin_pattern(pattern: str):
    """The pattern with its classes listed for characters below U+0250, or None if it has others."""
    out = pattern.replace(r"\S", "[^" + LATIN_CLASSES[r"\s"] + "]")
    for k, v in LATIN_CLASSES.items():
        out = "".join(x if i % 2 else x.replace(k, f"[{v}]") for i, x in enumerate(re.split(r"(\[[^\]]*\])", out))) if k != r"\s" else out
        out = "".join(x.replace(k, v) if i % 2 else x.replace(k, f"[{v}]") for i, x in enumerate(re.split(r"(\[[^\]]*\])", out)))
    return None if re.search(r"\\[a-zA-Z]", out) else re.compile(out)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}


class Vocabulary:
    """Ranks with the pair test, the prefix tables and a bounded memory of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.pattern, self.latin = regex.compile(pattern), latin_pattern(pattern)
        self._build_trie()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._slot_key = np.full(PAIR_SLOTS, -1, np.int64)
        self._slot_ok = np.zeros(PAIR_SLOTS, bool)
        self.memory: dict[str, str] = {}
        self.names = {t: str(t) for t in self.tokens}
        self.named = {str(t): data for t, data in self.tokens.items()}

    def _build_trie(self) -> None:
        """Edges (node * 256 + byte to node) as a dict for single pieces, and as an open hash table for many."""
        self.edges: dict[int, int] = {}
        self.at: dict[int, int] = {}  # node to token
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                node = self.edges.setdefault(node * 256 + byte, len(self.edges) + 1)
            self.at[node] = rank
        self.token_at = np.full(len(self.edges) + 1, -1, np.int32)
        self.token_at[list(self.at)] = list(self.at.values())
        bits = max(4, (3 * len(self.edges)).bit_length())
        self.edge_shift, self.edge_mask = np.uint64(64 - bits), (1 << bits) - 1
        self.edge_key, self.edge_to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, to = np.array(list(self.edges), np.int64), np.array(list(self.edges.values()), np.int32)
        slot = self._edge_slot(keys)
        while len(keys):
            free = self.edge_key[slot] < 0
            keys_f, slot_f, to_f = keys[free], slot[free], to[free]
            slot_u, first = np.unique(slot_f, return_index=True)
            self.edge_key[slot_u], self.edge_to[slot_u] = keys_f[first], to_f[first]
            left = self.edge_key[slot] != keys
            keys, slot, to = keys[left], (slot[left] + 1) & self.edge_mask, to[left]
        self.start = max(self.tokens, default=0) + 1
        self.length = np.zeros(self.start + 1, np.int32)
        for t, data in self.tokens.items():
            self.length[t] = len(data)

    def _edge_slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.edge_shift).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes after one byte each, or -1."""
        key = node.astype(np.int64) * 256 + byte
        slot = self._edge_slot(key)
        found = self.edge_key[slot]
        miss = np.flatnonzero((found != key) & (found >= 0))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & self.edge_mask
            found[miss] = self.edge_key[slot[miss]]
            miss = miss[(found[miss] != key[miss]) & (found[miss] >= 0)]
        return np.where(found == key, self.edge_to[slot], -1)


    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; only used on the bytes of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side (left -1: at the start)."""
        got = self._pairs.get((left, right))
        if got is None:
            t = self.tokens
            got = self.merged(t[right]) == [right] if left < 0 else self.merged(t[left] + t[right]) == [left, right]
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            self._pairs[left, right] = got
        return got

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Fill ``last[i]``, the last token of ``data[:i]``, for i from start+1 on.

        From each prefix's end j all tokens that follow there are walked in a trie; whichever
        forms a lasting pair with ``last[j]`` is the last token of the prefix that it ends.
        """
        n, pairs, fits, edges, tokens = len(data), self._pairs, self.fits, self.edges, self.at
        del last[start + 1 :]
        last += [-1] * (n - start)
        for j in range(max(0, start + 1 - self.longest), n):
            left, node = last[j], 0
            if left < 0 < j:
                raise ValueError("the ranks do not cover all bytes")
            for i in range(j, n):
                node = edges.get(node * 256 + data[i])
                if node is None:
                    break
                if i >= start and last[i + 1] < 0:
                    t = tokens.get(node)
                    if t is not None:
                        ok = pairs.get((left, t))
                        if fits(left, t) if ok is None else ok:
                            last[i + 1] = t
        if n > start and last[n] < 0:
            raise ValueError("the ranks do not cover all bytes")

    def read_off(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= len(self.tokens[last[i]])
        out.reverse()
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last = [-1]
        self.extend(data, last, 0)
        return self.read_off(last)

    def fits_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs, by slots that each hold the last pair tested that hashes there."""
        key = left.astype(np.int64) * (self.start + 1) + right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PAIR_SLOTS
        out = self._slot_ok[slot]
        miss = np.flatnonzero(self._slot_key[slot] != key)
        if len(miss):
            new, at = np.unique(key[miss], return_index=True)
            at = miss[at]
            pairs = [(-1 if a == self.start else a, b) for a, b in zip(left[at].tolist(), right[at].tolist())]
            ok = np.array([self.fits(*p) for p in pairs], bool)
            out[miss] = ok[np.searchsorted(new, key[miss])]
            self._slot_key[slot[at]], self._slot_ok[slot[at]] = new, ok
        return out

    def encode_many(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of short pieces, their tables of last tokens filled side by side."""
        n = np.array([len(p) for p in pieces], np.int32)
        width = int(n.max(initial=0))
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        last = np.full((len(pieces), width + 1), -1, np.int32)
        last[:, 0] = self.start
        for j in range(width):
            rows = np.flatnonzero(n > j)
            if (last[rows, j] < 0).any():
                raise ValueError("the ranks do not cover all bytes")
            node = np.zeros(len(rows), np.int32)
            for i in range(j, width):
                node = self.step(node, data[rows, i])
                on = node >= 0
                if i >= j + 1:
                    on &= n[rows] > i
                rows, node = rows[on], node[on]
                token = self.token_at[node]
                test = np.flatnonzero((token >= 0) & (last[rows, i + 1] < 0))
                if len(test):
                    ok = test[self.fits_many(last[rows[test], j], token[test])]
                    last[rows[ok], i + 1] = token[ok]
                if not len(rows):
                    break
        at, rows, back = n.copy(), np.arange(len(pieces)), []
        while len(rows):
            t = last[rows, at[rows]]
            if (t < 0).any():
                raise ValueError("the ranks do not cover all bytes")
            back.append((rows, t))
            at[rows] -= self.length[t]
            rows = rows[at[rows] > 0]
        rows = np.concatenate([r for r, _ in back]) if back else np.zeros(0, np.int64)
        step = np.concatenate([np.full(len(r), -k) for k, (r, _) in enumerate(back)]) if back else rows
        ids = (np.concatenate([t for _, t in back]) if back else rows)[np.lexsort((step, rows))].tolist()
        ends = np.cumsum(np.bincount(rows, minlength=len(pieces))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, texts: list[list[str]]) -> dict[str, str]:
        """A dict with the ids, joined by spaces, of all pieces of some texts (and of others)."""
        pieces, memory = set().union(*texts), self.memory
        new = [p for p in pieces if p not in memory]
        raw = [p.encode() for p in new]
        short = [i for i, p in enumerate(raw) if 0 < len(p) <= SHORT_BYTES and p not in self.ranks]
        made = dict(zip(short, self.encode_many([raw[i] for i in short]))) if short else {}
        names = self.names
        for i, p in enumerate(new):
            memory[p] = " ".join([names[t] for t in made.get(i) or self.encode_piece(raw[i])])
        if len(memory) > CACHED_PIECES:
            self.memory = {p: x for p in pieces if len(p) <= SHORT_BYTES and (x := memory[p])}
        return memory

    def forget(self) -> None:
        """Empty the memory of pieces and pairs; the tables of the vocabulary stay."""
        self.memory, self._pairs = {}, {}

    def pieces(self, text: str) -> list[str]:
        if self.latin and not NOT_LATIN.search(text):
            return self.latin.findall(text)
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        return [t for p in self.pieces(text) for t in self.encode_piece(p.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PieceTable:
    """The prefix table of one piece: exact appends, and edits that redo only what follows them."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        self.vocabulary.extend(self.data, self.last, start)

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Put ``data`` for the bytes from start to end; the table is kept up to start."""
        self.data = self.data[:start] + data + self.data[end:]
        self.vocabulary.extend(self.data, self.last, start)

    def ids(self, upto: int | None = None) -> list[int]:
        """The encoding of the whole piece, or of its first ``upto`` bytes."""
        return self.vocabulary.read_off(self.last if upto is None else self.last[: upto + 1])


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(load_ranks(path), pattern)


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``id_col, ids array<int>`` (if ``with_ids``), ``n_tokens, ids_sha256, decoded_sha256``.

    A map over Arrow batches: no shuffle, one pass over the texts. Workers keep the vocabulary
    between tasks, and its bounded caches during one.
    """
    ship(docs.sparkSession, BATCH)
    fields = [(id_col, docs.schema[id_col].dataType.simpleString())] + [("ids", "array<int>")] * with_ids + [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]

    def run(batches):
        v = vocabulary(path, pattern)
        for b in batches:
            ids, counts, digests, decoded = [], [], [], []
            texts = [v.pieces(text) for text in _texts(b)]
            known = v.learn(texts)
            for own in texts:
                joined = " ".join(map(known.__getitem__, own))
                names = joined.split()
                counts.append(len(names))
                digests.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(v.named.__getitem__, names))).hexdigest())
                if with_ids:
                    ids.append(np.fromstring(joined, np.int32, sep=" "))
            cols = [b.column("id")] + [pa.array(ids, pa.list_(pa.int32()))] * with_ids + [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [n for n, _ in fields])
        v.forget()
        release()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields))


def decode_tokens(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text``: the texts of arrays of ids (null: empty)."""
    ship(rows.sparkSession)

    def run(batches):
        v = vocabulary(path, pattern)
        for b in batches:
            out = [v.decode(x or ()).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], [id_col, "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")
