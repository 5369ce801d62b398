"""Plain versions of the manifest, the prefix trie and the top-k search."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(*values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """(root, one path of (left, right) per leaf)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, path in enumerate(paths):
            first = at[i] - at[i] % 16
            path.append(("".join(level[first:at[i]]), "".join(level[at[i] + 1:first + 16])))
            at[i] //= 16
        level = [sha("".join(level[k:k + 16])) for k in range(0, len(level), 16)]
    return level[0], paths


def folded(h: str, path) -> str:
    for left, right in path:
        h = sha(left + h + right)
    return h


def manifest(rows) -> list[tuple]:
    """(doc_id, leaf, subroot, root, path) for rows (doc_id, text, lang, source, n_chars)."""
    by = defaultdict(list)
    for i, text, lang, source, n in rows:
        by[source].append((i is not None, i or 0, leaf(i, source, lang, n, text), i))
    trees = []
    for s in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        held = sorted(by[s], key=lambda r: r[:3])
        trees.append((held, *tree([r[2] for r in held])))
    if not trees:
        return []
    root, crown = tree([t[1] for t in trees])
    return [(r[3], r[2], sub, root, path + above) for (held, sub, paths), above in zip(trees, crown) for r, path in zip(held, paths)]


def rebuilt(rows) -> dict:
    """{conv_id: [(role, text)]} for rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def trie(sequences: dict) -> list[tuple]:
    """Nodes of {conv_id: steps}, a step's last entry being its text."""
    members = defaultdict(list)
    for c in sorted(sequences):
        for d in range(len(sequences[c]) + 1):
            members[tuple(sequences[c][:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += kids[node] == 0
            saved[node[:d]] += (len(cs) - 1) * len(node[-1][-1]) if node else 0
    return [(cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), kids[node], leaves[node], saved[node],
             sha(",".join(str(c) for c in cs if len(sequences[c]) == len(node)))) for node, cs in members.items()]


def top_k(rows, k: int, scale: int = 256) -> list[tuple]:
    """(query_id, rank, vec_id, score) for rows (vec_id, vector); queries are ids divisible by 50."""
    held = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(held):
        if q is not None and q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0, i) for other, (i, w) in enumerate(held) if other != at)
            out += [(q, r + 1, f[3], -f[0]) for r, f in enumerate(found[:k])]
    return out
