"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(FOLD))


def remainder(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def _discounts(counts: Counter) -> list[float]:
    n = Counter(counts.values())
    common = 6 * n[6] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, 6):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


class Katz:
    def __init__(self, texts: list[str | None]):
        self.c: Counter = Counter()
        self.pairs: Counter = Counter()
        for text in texts:
            w = [*words(text), "\n"]
            self.c.update(w)
            self.pairs.update(zip(["\t", *w[:-1]], w, strict=True))
        self.n = sum(self.c.values())
        d1, d2 = _discounts(self.c), _discounts(self.pairs)
        cut = lambda c, d: d[c - 1] * c if c <= 5 else c
        p = {w: cut(c, d1) / self.n for w, c in self.c.items()}
        self.unseen = max(1 - sum(p.values()), 1 / (self.n + 1))
        scale = (1 - self.unseen) / sum(p.values())
        self.p = {w: x * scale for w, x in p.items()}
        of, kept, mass = Counter(), Counter(), Counter()
        for (v, w), c in self.pairs.items():
            of[v] += c
            kept[v] += cut(c, d2)
            mass[v] += self.p[w]
        self.alpha, self.q = {}, {}
        for v in of:
            left = max(1 - kept[v] / of[v], 1 / (of[v] + 1))
            self.alpha[v] = left / max(1 - mass[v], self.unseen)
        for (v, w), c in self.pairs.items():
            left = max(1 - kept[v] / of[v], 1 / (of[v] + 1))
            self.q[v, w] = cut(c, d2) * (1 - left) / kept[v]

    def prob(self, v: str, w: str) -> float:
        return self.q.get((v, w)) or self.alpha.get(v, 1.0) * self.p.get(w, self.unseen)

    def score(self, text: str | None) -> tuple[int, int, float, float]:
        w = [*words(text), "\n"]
        base = sum(math.log10((self.c[x] + 1) / (self.n + len(self.c) + 1)) for x in w)
        return len(w), sum(self.c[x] > 0 for x in w), base, sum(math.log10(self.prob(*x)) for x in zip(["\t", *w[:-1]], w, strict=True))
