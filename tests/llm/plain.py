"""Plain, single-process versions that the tests hold the operators against."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def crc_mod(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def simhash(text, shingle=3):
    w = words(text)
    parts = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, bits=2):
    """prints: id -> fingerprint; id -> smallest id reachable."""
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= bits and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in prints}


class Katz:
    """Pair model from lists of tokens (each ending in an end token)."""

    def __init__(self, texts):
        self.c1 = Counter(w for t in texts for w in t)
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.c2 = Counter(p for t in texts for p in zip([None, *t], t))
        self.ch = Counter()
        self.after = defaultdict(list)
        for (h, w), c in self.c2.items():
            self.ch[h] += c
            self.after[h].append(w)
        self.d1, self.d2 = self.discounts(self.c1), self.discounts(self.c2)
        self.left = 1 - sum(self.d(self.d1, c) * c for c in self.c1.values()) / self.n if self.n else 1.0

    @staticmethod
    def discounts(counts):
        n = [0, *[sum(c == r for c in counts.values()) for r in range(1, 7)]]
        tail = 6 * n[6] / n[1] if n[1] else 1
        out = {}
        for r in range(1, 6):
            good = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0
            out[r] = good if 0 < good < 1 else (r - 0.5) / r
        return out

    @staticmethod
    def d(table, c):
        return table.get(c, 1.0)

    def word(self, w):
        c = self.c1[w]
        return self.d(self.d1, c) * c / self.n if c else self.left

    def pair(self, h, w):
        if not self.ch[h]:
            return self.word(w)
        seen = self.after[h]
        some = any(self.c2[h, x] <= 5 for x in seen)
        total = self.ch[h] + (not some)
        if self.c2[h, w]:
            return self.d(self.d2, self.c2[h, w]) * self.c2[h, w] / total
        rest = 1 - sum(self.d(self.d2, self.c2[h, x]) * self.c2[h, x] for x in seen) / total
        return rest / (1 - sum(map(self.word, seen))) * self.word(w)

    def score(self, tokens):
        return sum(math.log10(self.pair(h, w)) for h, w in zip([None, *tokens], tokens))

    def base(self, tokens):
        return sum(math.log10((self.c1[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in tokens)


def nearest(rows, value, k=20, every=20):
    """rows: (id, vector); per query id its k best (id, score) over all rows but that very one, ties to the smaller id
    (query rows of one id and one vector have one list)."""
    ids = np.array([i for i, _ in rows])
    m = np.array([value(np.asarray(v, float)) for _, v in rows])
    out = {}
    for at, (i, v) in enumerate(zip(ids, m)):
        if i % every == 0:
            s = m @ v
            out[int(i)] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if j != at][:k]
    return out
