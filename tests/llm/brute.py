"""Plain versions of the operators, row by row."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORDS.findall(text or "")


def fingerprint(text, k=3):
    w = words((text or "").translate(LOWER))
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(fps, budget=2):
    """fps: doc_id to fingerprint."""
    ids = list(fps)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    v = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[k]) <= budget):
            a, b = find(i), find(ids[j])
            if a != b:
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def line_dedup(docs, least=10, min_points=1):
    """docs: list of (doc_id, text). List of (doc_id, n_lines, n_dropped, kept)."""
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    split = [(i, (t or "").split("\n")) for i, t in docs]
    n = Counter(k for _, x in split for k in {key(y) for y in x} if len(k) >= min_points)
    out = []
    for i, x in split:
        kept = [y for y in x if n[key(y)] < least]
        out.append((i, len(x), len(x) - len(kept), "\n".join(kept)))
    return out


def substring_dedup(docs, window=35):
    w = [(i, words(t)) for i, t in docs]
    n = Counter(tuple(x[k : k + window]) for _, x in w for k in range(len(x) - window + 1))
    out = []
    for i, x in w:
        gone = set()
        for k in range(len(x) - window + 1):
            if n[tuple(x[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        out.append((i, len(x), len(gone), " ".join(y for k, y in enumerate(x) if k not in gone)))
    return out


def pii(text):
    t, out = text or "", []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = [int(c) for c in m[0] if c.isdigit()]
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and sum((2 * x - 9 if x > 4 else 2 * x) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def base_rules(text):
    w, t = words(text), text or ""
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def similar_roots(texts, k=5, least=0.8):
    """texts: doc_id to text. Smallest doc_id reachable over exact Jaccard similarities of ``least`` or more."""
    sets = {}
    for i, t in texts.items():
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for i, x in sets.items():
        for j, y in sets.items():
            both = len(x & y)
            if i < j and root[i] != root[j] and both >= least * (len(x) + len(y) - both):
                a, b = sorted((root[i], root[j]))
                root = {n: a if r == b else r for n, r in root.items()}
    return root


class KneserNey:
    """Two class models over n-grams (tuples of bytes with their context), backing off to one shared model."""

    def __init__(self, toxic, ordinary, discount, shrink):
        """toxic, ordinary: n-gram to count, all of one order."""
        self.classes, self.discount, self.shrink = (toxic, ordinary), discount, shrink
        order = len(next(iter({**toxic, **ordinary})))
        self.levels = {order: {g: toxic.get(g, 0) + ordinary.get(g, 0) for g in {**toxic, **ordinary}}}
        for k in range(order - 1, 0, -1):
            self.levels[k] = dict(Counter(g[1:] for g in self.levels[k + 1]))

    def _parts(self, counts, context):
        own = [c for g, c in counts.items() if g[:-1] == context]
        return sum(own), sum(own) - sum(max(c - self.discount, 0) for c in own)

    def shared(self, g):
        counts = self.levels[len(g)]
        if len(g) == 1:
            return (counts.get(g, 0) + 0.5) / (sum(counts.values()) + 128)
        total, left = self._parts(counts, g[:-1])
        return self.shared(g[1:]) if not total else (max(counts.get(g, 0) - self.discount, 0) + left * self.shared(g[1:])) / total

    def log_p(self, g, ordinary):
        """The class's log-likelihood of the last byte after the others."""
        counts = self.classes[ordinary]
        total, left = self._parts(counts, g[:-1])
        return float(np.log((max(counts.get(g, 0) - self.discount, 0) + (left + self.shrink) * self.shared(g)) / (total + self.shrink)))
