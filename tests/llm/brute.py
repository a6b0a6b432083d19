"""Plain models of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = words(text)
    k = min(size, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def near_duplicates(texts: dict[int, str | None], threshold: float = 0.8) -> dict[int, tuple[int, int]]:
    """doc_id to (smallest id of its component, number of links)."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent, links = {i: i for i in texts}, defaultdict(int)

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and shared >= threshold * (len(sets[a]) + len(sets[b]) - shared):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def kept_words(docs: list[tuple[int, str | None]], size: int = 13) -> dict[int, tuple[int, int, str]]:
    """doc_id to (words, removed words, what is left)."""
    first: dict[tuple, int] = {}
    split = {i: (t or "").encode().split() for i, t in docs}
    for i, w in split.items():
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def hits(texts: dict, items: list[tuple], size: int = 10) -> dict:
    """doc_id to (words, hit words, item ids found)."""
    windows: dict[tuple, set[str]] = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in texts.items():
        w, hit, found = words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if of := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= of
        out[doc] = (len(w), len(hit), found)
    return out


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """By definition: the best segment first, then the same on its left and right."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                best = (a, b, total)
    if best is None:
        return []
    a, b, _ = best
    right = [(x + b + 1, y + b + 1, s) for x, y, s in maximal_segments(scores[b + 1 :])]
    return [*maximal_segments(scores[:a]), best, *right]
