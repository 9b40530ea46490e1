"""Brute-force forms of two stages."""

import re
from collections import defaultdict

WS = "\x20\x09\x0a\x0b\x0c\x0d"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_brute(rows):
    seen = defaultdict(set)
    key = lambda x: x.strip(WS).translate(AZ)
    for i, t in rows:
        for x in t.split("\n"):
            seen[key(x)].add(i)
    gone = lambda i, k: len(k) >= 40 and len(seen[k]) >= 5 and i != max(seen[k])
    return {i: "\n".join(x for x in t.split("\n") if not gone(i, key(x))) for i, t in rows}


def near_brute(rows):
    """The least id of each group; texts without words are groups of their own."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", t.translate(AZ))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 0.8 * len(sets[a]) <= len(sets[b]) <= 1.25 * len(sets[a]):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    up[root(a)] = root(b)
    out = {}
    for k, (i, _) in enumerate(rows):
        out[root(k)] = min(i, out.get(root(k), i))
    return list(out.values())
