"""Plain versions of the operators, for comparison."""

import re
import string
from itertools import combinations


def fold(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_groups(rows, n=4, percent=80):
    """rows of (doc_id, text) to {row number: smallest doc_id of its component}"""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[top(a)] = top(b)
    out = {}
    for k, (i, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if top(j) == top(k) and rows[j][0] is not None]
        out[k] = min(own) if own and sets[k] else i
    return out


def tiling(p, t, least):
    """Greedy string tiling as first published: the longest unmarked common runs, again and again."""
    mp, mt, out = [False] * len(p), [False] * len(t), []
    while True:
        best, found = least, []
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        done = False
        for i, j in found:
            if not any(mp[i : i + best]) and not any(mt[j : j + best]):
                mp[i : i + best] = mt[j : j + best] = [True] * best
                out.append((i, j, best))
                done = True
        if not done:
            return out


def best_fit(items, capacity):
    pieces = [(min(capacity, n - k * capacity), d, k, s, c) for d, s, c, n in items for k in range(max(1, -(-n // capacity)))]
    pieces.sort(key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[2], p[3] is None, p[3] or "", p[4] or 0))
    bins, out = [], []
    for size, d, k, s, c in pieces:
        fits = [(left, b) for b, (left, sources, clusters) in enumerate(bins) if left >= size and s not in sources and c not in clusters]
        if not fits:
            bins.append([capacity, set(), set()])
            fits = [(capacity, len(bins) - 1)]
        b = min(fits)[1]
        out.append((d, k, k * capacity, size, b, capacity - bins[b][0]))
        bins[b][0] -= size
        if s is not None:
            bins[b][1].add(s)
        if c is not None:
            bins[b][2].add(c)
    return out
