"""Fuzzy search for short license notices: exact seeds by the pigeonhole principle, then
bounded-error matching of the `regex` library."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from neargrain.llm.common import buffer_of, pieces, words_of

#: Exact phrases that the contract names, and their labels. Fixed values.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Short notices that the search finds with errors, and their labels; a tenth of a notice's
#: characters (rounded down) may be wrong.
NOTICES = (
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("gnu library general public license", "lgpl"),
    ("redistributions of source code must retain the above copyright notice", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("boost software license version 1 0", "bsl-1"),
    ("eclipse public license version 2 0", "epl-2"),
    ("common development and distribution license", "cddl"),
    ("european union public licence", "eupl"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("cc0 1 0 universal public domain dedication", "cc0"),
    ("academic free license version", "afl"),
    ("the artistic license 2 0", "artistic-2"),
    ("sil open font license", "ofl"),
    ("open database license", "odbl"),
    ("server side public license", "sspl"),
    ("business source license", "busl"),
    ("microsoft public license", "ms-pl"),
    ("python software foundation license", "psf"),
    ("do what the fuck you want to public license", "wtfpl"),
    ("all rights reserved", "all-rights-reserved"),
)
ERROR_SHARE = 10

_FOLD = bytearray(range(256))
_FOLD[0x41:0x5B] = range(0x61, 0x7B)
_OUTSIDE = [b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)]
#: Lower-cases A-Z and turns everything that is no part of a word into a space.
FOLD = bytes(0x20 if b in set(_OUTSIDE) else b for b in _FOLD)
_NOT_WORD = np.array([FOLD[b] == 0x20 for b in range(256)])

_SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start_word:bigint,end_word:bigint,errors:int>>"


def allowed(notice: str) -> int:
    return len(notice) // ERROR_SHARE


def seeds(notice: str) -> list[tuple[int, str]]:
    """(offset, text) of allowed + 1 disjoint pieces: with at most so many errors one is intact."""
    k = allowed(notice) + 1
    edges = [len(notice) * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(edges, edges[1:])]


def patterns(notice: str) -> list[tuple[int, regex.Pattern]]:
    """(errors, pattern): the notice with the errors that are allowed; and without its last words,
    where those are so short that leaving them out is allowed, too, with the errors that are
    left. (The library doesn't try to delete a space that it can match.)"""
    out, gone = [], 0
    while gone <= allowed(notice):
        rest = notice[: len(notice) - gone]
        out.append((gone, regex.compile(f"(?b)(?<= )(?:{regex.escape(rest)}){{e<={allowed(notice) - gone}}}(?= )")))
        gone = len(notice) - rest.rfind(" ")
    return out


def words_before(text: str, places: list[int]) -> list[int]:
    """How many spaces are before each of some rising places of a text, in one pass."""
    out, n, last = [], 0, 0
    for place in places:
        n, last = n + text.count(" ", last, place), place
        out.append(n)
    return out


class Scanner:
    """Finds phrases and notices in one folded text."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.phrases = [(f" {p} ", label) for p, label in phrases]
        self.notices = list(notices)
        self.patterns = [patterns(n) for n, _ in self.notices]
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[str, int, int]]] = {}
        for p, _ in self.phrases:
            found.setdefault(p, []).append(("phrase", 0, 0))
        for i, (n, _) in enumerate(self.notices):
            for at, piece in seeds(n):
                found.setdefault(piece, []).append(("seed", i, at))
        for piece, what in found.items():
            self.automaton.add_word(piece, (len(piece), what))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, int]], float]:
        """Of a folded text, words joined by one space and a space at both ends: the base places
        (word, label), the fuzzy spans (first word, past the last word, label, errors), and the
        score: the largest share of a notice's characters without errors, 1 for a base place."""
        base, windows = set(), {}
        for end, (length, what) in self.automaton.iter(text):
            start = end + 1 - length
            for kind, i, at in what:
                if kind == "phrase":
                    base.add(start)
                else:
                    n = len(self.notices[i][0])
                    k = allowed(self.notices[i][0])
                    windows.setdefault(i, []).append((start - at - k - 1, start - at + n + k + 1))
        starts = sorted(base)
        places = [(n, label) for n, s in zip(words_before(text, starts), starts) for p, label in self.phrases if text.startswith(p, s)]
        matches, score = set(), 1.0 if places else 0.0
        for i, found in windows.items():
            notice, label = self.notices[i]
            for start, end, errors, words in self.occurrences(text, i, found):
                matches.add((start, words, label, errors))
                score = max(score, 1 - errors / len(notice))
        rising = sorted(matches)
        spans = [(n - 1, n - 1 + words, label, errors) for n, (_, words, label, errors) in zip(words_before(text, [m[0] for m in rising]), rising)]
        return places, spans, score

    def occurrences(self, text: str, i: int, windows: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(start, end, errors, words) of a notice, none over another, the better ones first chosen.

        Each window is about a notice long and searched by itself, so the work grows with the
        number of windows. A match that a better one overlaps makes way: what the chosen ones
        leave of its window is searched again."""
        n, k = len(self.notices[i][0]), allowed(self.notices[i][0])
        merged: list[list[int]] = []
        for a, b in sorted(set(windows)):  # those of one place differ by the errors between the seeds
            if merged and a <= merged[-1][0] + k:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        heap: list[tuple[int, int, int, int, int, int]] = []

        def search(a: int, b: int) -> None:
            if b - a < n - k:
                return
            best = min(((gone + sum(m.fuzzy_counts), m.start(), m) for gone, pattern in self.patterns[i] if (m := pattern.search(text, a, b))), default=None, key=lambda x: x[:2])
            if best:
                errors, _, m = best
                whole = m.group()
                heapq.heappush(heap, (errors, m.end() - len(whole.lstrip(" ")), m.end(), len(whole.split()), a, b))

        for a, b in merged:
            search(max(a, 0), min(b, len(text)))
        starts, chosen = [], {}
        while heap:
            errors, start, end, words, a, b = heapq.heappop(heap)
            at = bisect.bisect_left(starts, end)
            if at and chosen[starts[at - 1]][1] > start:
                free = a
                for s in starts[max(0, bisect.bisect_right(starts, a) - 1) : bisect.bisect_left(starts, b)]:
                    search(free, min(b, s))
                    free = max(free, chosen[s][1])
                search(free, b)
                continue
            starts.insert(at, start)
            chosen[start] = (start, end, errors, words)
        return list(chosen.values())


def _scan(batches: Iterator[pa.RecordBatch], phrases, notices) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(phrases, notices)
    for whole in batches:
        for batch in pieces(whole, "text"):
            data, offsets = buffer_of(batch.column("text"))
            _, _, rows = words_of(data, offsets, _NOT_WORD)
            counts = np.diff(rows)
            # Words joined by one space, each text between spaces; texts are told apart by a line feed.
            folded = data.tobytes().translate(FOLD)
            out = []
            for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), counts.tolist()):
                text = " " + " ".join(folded[a:b].decode("utf-8").split(" ")) + " " if n else ""
                while "  " in text:
                    text = text.replace("  ", " ")
                places, spans, score = scanner.scan(text) if n else ([], [], 0.0)
                base = sorted({label for _, label in places})
                every = sorted({*base, *(s[2] for s in spans)})
                at = [w for w, _ in places]
                out.append((n, len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(every), score, [{"label": s[2], "start_word": s[0], "end_word": s[1], "errors": s[3]} for s in spans]))
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("errors", pa.int32())]))]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", *names])


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per input row with the places of license phrases and the spans of fuzzy notices.

    A-Z is lower-cased; words are runs of a-z, 0-9 and bytes over 0x7F; whole texts are scanned,
    without a shuffle. ``n_base``, ``first_word`` and ``last_word`` are about the exact phrases
    alone (places count for each phrase). ``labels`` adds those of notices found with up to a
    tenth of their characters inserted, deleted or replaced, at word borders: one automaton finds
    every seed, of which an admissible match has one intact, and the `regex` library verifies
    the edits around it. Every seed has a window of its own of about a notice's length, so very
    long texts, and texts full of notices, take time in proportion to their length. ``score`` is the best share of a notice without errors (1 for a phrase,
    0 for none). Null and empty texts give no words, no places, empty labels and score 0;
    repeated rows and null ids pass through; other columns are ignored.
    """
    rows = docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text")
    return rows.mapInArrow(lambda batches: _scan(batches, phrases, notices), _SCHEMA)
