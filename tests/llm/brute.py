"""Plain Python versions of the operators, used by the tests of this folder."""

from __future__ import annotations

import hashlib
import re

WS = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def luhn(m):
    d = [int(c) for c in re.sub("[^0-9]", "", m)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(d)) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(m)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    out = []
    for k, (kind, (pattern, ok)) in enumerate(BASE.items()):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if ok(m.group())]
    return sorted(out)


def base_digest(text):
    return hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in base_spans(text)).encode()).hexdigest()


def removed_bytes(docs, n=50):
    """doc_id to (n_bytes, n_removed, n_spans, sha256 of what is left), for (doc_id, text) rows with different ids."""
    first = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w not in first or i < first[w]:
                first[w] = i
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        spans = len([1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1])])
        out[i] = len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()
    return out


def shingles(text, n=5):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = words(low)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def near_components(docs):
    """doc_id to (number of shingles, smallest linked doc_id), for (doc_id, text) rows."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(a), find(i)) for i, a in sets}


def lines_kept(docs, min_docs=5, min_chars=40):
    """A (n_lines, n_dropped, text) for each (doc_id, text) row."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(WS).translate(low)
    held = {}
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != i)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def quality(text):
    w, t = words(text), text or ""
    seen, hit = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(i + k for i in at for k in range(3))
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)
