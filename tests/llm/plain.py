"""Plain, brute-force versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(raw: bytes | str) -> str:
    return hashlib.sha256(raw.encode() if isinstance(raw, str) else raw).hexdigest()


def repeated_windows(docs: list[tuple[int, list | bytes]], length: int) -> dict[int, list[bool]]:
    """Which symbols of each document lie in a window that also starts earlier."""
    first: dict = {}
    covered = {}
    for doc, symbols in sorted(docs, key=lambda d: d[0]):
        marks = [False] * len(symbols)
        for i in range(len(symbols) - length + 1):
            window = symbols[i : i + length] if isinstance(symbols, bytes) else tuple(symbols[i : i + length])
            if first.setdefault(window, (doc, i)) != (doc, i):
                marks[i : i + length] = [True] * length
        covered[doc] = marks
    return covered


def spans(marks: list[bool]) -> int:
    return sum(b and not a for a, b in zip([False, *marks], marks))


def components(nodes, links) -> dict:
    """The smallest node that each node reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text: str | None) -> Counter:
    words = WORD.findall(text or "")
    if 0 < len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_classes(docs: dict[int, str], threshold: float = 0.8) -> tuple[dict[int, int], dict]:
    """Classes of all pairs' weighted Jaccard similarities, and the similarities themselves."""
    bags = {d: shingles(t) for d, t in docs.items()}
    df = Counter(s for bag in bags.values() for s in bag)
    n = len(docs)
    weighed = {d: {s: c * (1 + np.log((1 + n) / (1 + df[s]))) for s, c in bag.items()} for d, bag in bags.items()}
    by_text = defaultdict(list)
    for d, t in docs.items():
        by_text[t or ""].append(d)
    similar = {}
    for a, b in combinations(sorted(docs), 2):
        x, y = weighed[a], weighed[b]
        shared = x.keys() & y.keys()
        if shared:
            low = sum(min(x[s], y[s]) for s in shared)
            similar[a, b] = low / (sum(x.values()) + sum(y.values()) - low)
    links = [p for p, s in similar.items() if s >= threshold] + [(ids[0], i) for ids in by_text.values() for i in ids[1:]]
    return components(docs, links), similar


def targets(sizes: dict, weights=(5, 2, 1), most: int = 3) -> dict:
    """Targets of sources (None last): shares by weight, none above ``most`` times its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            return full
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = [s for s in rest if share[s] > most * sizes[s]]
        if not above:
            return full | share
        full |= {s: most * sizes[s] for s in above}


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
