"""Plain versions of what the corpus operators compute, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0d]+", text.translate(LOWER) if lower else text)


def near(rows, k=3, percent=85):
    """{id: (shingles, smallest id reachable)} for (id, text) with distinct ids."""
    sets = {}
    for i, text in rows:
        w = words(text, True)
        sets[i] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def repeated(rows, length=100):
    """{id: (bytes, removed, spans, digest of the rest)} for (id, text) with distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p:p + length]
            if w in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def _discounts(n1, n2, n3, n4):
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3))]


def language_model(rows):
    """{id: (held out, tokens, known, training tokens, base, score)}, and the probability that a context gives to all words."""
    end = ""

    def tokens(t):
        return words(t, True) + [end]

    def out_of(i):
        return zlib.crc32(str(i).encode()) % 7 == 2

    one, two = Counter(), Counter()
    for i, t in rows:
        if not out_of(i):
            w = tokens(t)
            one.update(w)
            two.update(zip([end] + w[:-1], w))
    total, kinds = sum(one.values()), len(one)
    of = Counter(two.values())
    d = _discounts(*(of[k] for k in (1, 2, 3, 4)))

    def take(c, d):
        return d[min(c, 3) - 1] if c else 0.0

    context, taken, behind = Counter(), defaultdict(float), Counter()
    for (v, w), c in two.items():
        context[v] += c
        taken[v] += take(c, d)
        behind[w] += 1
    of = Counter(behind.values())
    low = _discounts(*(of[k] for k in (1, 2, 3, 4)))
    spread = sum(take(c, low) for c in behind.values()) / len(two)

    def lower(w):
        return max(behind.get(w, 0) - take(behind.get(w, 0), low), 0) / len(two) + spread / (kinds + 1)

    def p(v, w):
        if v not in context:
            return lower(w)
        c = two.get((v, w), 0)
        return max(c - take(c, d), 0) / context[v] + taken[v] / context[v] * lower(w)

    out = {}
    for i, t in rows:
        w = tokens(t)
        out[i] = (out_of(i), len(w), sum(x in one for x in w), total, sum(math.log10((one.get(x, 0) + 1) / (total + kinds + 1)) for x in w),
                  sum(math.log10(p(v, x)) for v, x in zip([end] + w[:-1], w)))
    some = next(iter(context))
    return out, sum(p(some, x) for x in one) + p(some, "never seen")
