"""Suffix-array deduplication by a prefix-aware distributed merge sort of sampled suffixes."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neargrain.llm.common import BYTE_VALUES, MULTIPLIER, mix, pieces
from neargrain.llm.repeats import ITEMS, ROWS, SPOT, STRETCH, Deal, buckets, by_document, deal_of, dealt, documents, for_documents, hot_slots, is_hot, repeated_spots, rows_of, same_document, stretches, union

LENGTH, K = 100, 40
#: Bytes of the anchor's hash in front of a suffix; hashes make the splitters of the sort even.
HEAD = 8
#: Entries of a merged stretch of buckets that are settled together.
TOGETHER = 100_000


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


def neighbours(keys: list[bytes]) -> list[int]:
    """Length of the common prefix of each of some short strings with the one before it."""
    lengths = np.array([len(x) for x in keys], np.int64)
    wide = int(lengths.max(initial=0)) + 1
    out = [0] * min(len(keys), 1)
    for base in range(0, len(keys) - 1, TOGETHER):
        part = keys[base : base + TOGETHER + 1]
        table = np.frombuffer(b"".join([x.ljust(wide, b"\0") for x in part]), np.uint8).reshape(len(part), wide)
        differ = table[1:] != table[:-1]
        differ[:, -1] = True
        ends = lengths[base : base + len(part)]
        out += np.minimum(differ.argmax(1), np.minimum(ends[1:], ends[:-1])).tolist()
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merges sorted runs, each with the common prefixes of neighbours, by a loser tree.

    Yields (run, index, prefix shared with the item yielded before). Every candidate carries the
    prefix that it shares with the last winner: of two candidates the one that shares more comes
    first, and bytes are compared only where both share as much, from there on.
    """
    size = 1 << max(len(runs) - 1, 0).bit_length()
    at = [0] * size
    now: list[bytes] = [r[0][0] if r[0] else b"" for r in runs] + [b""] * (size - len(runs))
    shared = [0 if r[0] else -1 for r in runs] + [-1] * (size - len(runs))  # -1: exhausted
    tree = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        if shared[a] < 0:
            return a, b
        x, y = now[a], now[b]
        n = common(x, y, shared[a])
        if x[n : n + 1] <= y[n : n + 1]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    winners = list(range(size))
    while len(winners) > 1:
        level = []
        base = len(winners) // 2
        for i in range(base):
            win, tree[base + i] = play(winners[2 * i], winners[2 * i + 1])
            level.append(win)
        winners = level
    win = winners[0]
    while shared[win] >= 0:
        i = at[win]
        yield win, i, shared[win]
        strings, prefixes = runs[win]
        at[win] = i = i + 1
        if i < len(strings):
            now[win], shared[win] = strings[i], prefixes[i]
        else:
            shared[win] = -1
        node = (win + size) >> 1
        while node:
            other = tree[node]
            if shared[other] > shared[win]:
                tree[node], win = win, other
            elif shared[other] == shared[win]:
                win, tree[node] = play(win, other)
            node >>= 1


#: What entries have besides bytes.
ARRAYS = ("ids", "own", "p", "low", "high")


class Suffixes:
    """Entries in suffix order: the suffix from an anchor on (with the hash before it), the bytes
    to its left, document (id and key), place, and the offsets of its windows."""

    def __init__(self, keys: list[bytes], shared: list[int], lefts: list[bytes], ids: np.ndarray, own: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.keys, self.shared, self.lefts, self.ids, self.own, self.p, self.low, self.high = keys, shared, lefts, ids, own, p, low, high

    def settle(self, length: int, k: int) -> np.ndarray:
        """covered[entry, offset]: does an equal window start earlier? Windows at an offset are
        equal where neighbours share the suffix as far as the window goes, and the bytes to the
        left are equal (found by 64-bit hashes, and then compared)."""
        w = length - k + 1
        covered = np.zeros((len(self.keys), w), bool)
        shared = np.maximum(np.array(self.shared, np.int64) - HEAD, 0)
        # Only entries that share an anchor with a neighbour can have equal windows. Neighbours that
        # share one are kept together; what comes after a gap shares none.
        some = shared >= k
        some[:1] = False
        at = np.flatnonzero(some | np.append(some[1:], False))
        n = len(at)
        if n < 2:
            return covered
        shared = shared[at]
        ids, own, p, low, high = (getattr(self, name)[at] for name in ARRAYS)
        wide = max(w - 1, 1)
        left = np.frombuffer(b"".join([self.lefts[i][::-1].ljust(wide, b"\0") for i in at.tolist()]), np.uint8).reshape(n, wide)
        order = np.lexsort((p, own, ids))
        step = np.ones(n, np.int64)
        step[1:] = np.any([x[order][1:] != x[order][:-1] for x in (ids, own, p)], axis=0)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        hashes = np.zeros(n, np.uint64)
        for o in range(w):
            if o:
                hashes = hashes * np.uint64(MULTIPLIER) + BYTE_VALUES[left[:, o - 1]]
            joined = shared >= length - o
            joined[0] = False
            if not joined.any():
                continue
            group = np.cumsum(~joined)
            near = joined | np.append(joined[1:], False)
            idx = np.flatnonzero(near & (low <= o) & (o <= high))
            if len(idx) < 2:
                continue
            key = mix(hashes[idx] + group[idx].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            later, same, one = self._later(key, rank[idx])
            a, b = idx[same], idx[one]
            if not ((group[a] == group[b]) & (left[a, :o] == left[b, :o]).all(1)).all():
                # Two hashes met: by the bytes themselves.
                whole = np.hstack((group[idx].astype("<i8").view(np.uint8).reshape(-1, 8), left[idx, :o]))
                later, _, _ = self._later(np.unique(whole, axis=0, return_inverse=True)[1].ravel(), rank[idx])
            covered[at[idx[later]], o] = True
        return covered

    @staticmethod
    def _later(key: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of equal keys: all but those of the least rank; and pairs that tie each of them to one."""
        by = np.argsort(key)
        key, rank = key[by], rank[by]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(first, len(key)))
        later = rank > np.repeat(np.minimum.reduceat(rank, first), sizes)
        one = np.repeat(by[first], sizes)
        same = by != one
        return by[later], by[same], one[same]

    def open(self, covered: np.ndarray) -> "Suffixes":
        """The entries with windows that aren't covered, with no more bytes than those need."""
        if not covered.any():
            return self
        offset = np.arange(covered.shape[1])
        left = ~covered & (self.low[:, None] <= offset) & (offset <= self.high[:, None])
        at = np.flatnonzero(left.any(1))
        low, high = left[at].argmax(1), covered.shape[1] - 1 - left[at, ::-1].argmax(1)
        entries = []
        for i, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
            key, far = self.keys[i], self.lefts[i]
            entries.append((key[: len(key) - (a - int(self.low[i]))], far[len(far) - b :], int(self.ids[i]), int(self.own[i]), int(self.p[i]), a, b))
        return Suffixes.of(entries)

    def split(self, hot: np.ndarray, length: int, k: int) -> "Suffixes":
        """Entries of hot anchors become one entry for each window, with the hash of the whole
        window in front."""
        if not self.keys or not hot.any():
            return self
        grams = np.frombuffer(b"".join([x[HEAD : HEAD + k] for x in self.keys]), np.uint8).reshape(-1, k)
        many = is_hot(BYTE_VALUES[grams], hot)
        if not many.any():
            return self
        entries = []
        for each, key, left, id_, own, p, low, high in zip(many.tolist(), self.keys, self.lefts, *(getattr(self, name).tolist() for name in ARRAYS)):
            if not each:
                entries.append((key, left, id_, own, p, low, high))
                continue
            for o in range(low, high + 1):
                right, far = key[HEAD : HEAD + length - o], left[len(left) - o :]
                entries.append((xxhash.xxh64_digest(far + right) + right, far, id_, own, p, o, o))
        return Suffixes.of(entries)

    @staticmethod
    def of(entries: list[tuple]) -> "Suffixes":
        """Sorts (key, left, document's id and key, place, lowest and highest offset)."""
        entries.sort()
        keys, lefts, *arrays = map(list, zip(*entries)) if entries else ([] for _ in range(7))
        return Suffixes(keys, neighbours(keys), lefts, *(np.array(x, np.int64) for x in arrays))

    def pack(self, a: int, b: int) -> bytes:
        """A run, front-coded: of each suffix only what it doesn't share with the one before."""
        prefix = [0, *self.shared[a + 1 : b]]
        rests = [k[s:] for k, s in zip(self.keys[a:b], prefix)]
        arrays = [np.array(prefix, "<u2"), np.array([len(x) for x in rests], "<u2"), np.array([len(x) for x in self.lefts[a:b]], "<u2"), self.ids[a:b].astype("<i8"), self.own[a:b].astype("<i8"), self.p[a:b].astype("<u4"), self.low[a:b].astype("<u2"), self.high[a:b].astype("<u2")]
        return struct.pack("<I", b - a) + zstandard.compress(b"".join([*(x.tobytes() for x in arrays), *rests, *self.lefts[a:b]]), 3)

    @staticmethod
    def unpack(body: bytes) -> "Suffixes":
        (n,) = struct.unpack_from("<I", body)
        raw = zstandard.decompress(body[4:])
        at, arrays = 0, []
        for kind in ("<u2", "<u2", "<u2", "<i8", "<i8", "<u4", "<u2", "<u2"):
            arrays.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        prefix, rest, left, *places = arrays
        keys, now = [], b""
        for s, r in zip(prefix.tolist(), rest.tolist()):
            now = now[:s] + raw[at : at + r]
            keys.append(now)
            at += r
        lefts = []
        for r in left.tolist():
            lefts.append(raw[at : at + r])
            at += r
        return Suffixes(keys, prefix.tolist(), lefts, *(x.astype(np.int64) for x in places))


def _merged(runs: list[Suffixes]) -> Suffixes:
    order = list(merge_runs([(r.keys, r.shared) for r in runs]))
    base = np.cumsum([0, *(len(r.keys) for r in runs)])
    at = np.array([base[r] + i for r, i, _ in order], np.int64)
    return Suffixes([runs[r].keys[i] for r, i, _ in order], [s for _, _, s in order], [runs[r].lefts[i] for r, i, _ in order], *(np.concatenate([getattr(r, name) for r in runs])[at] for name in ARRAYS))


def _sorted_runs(batches: Iterator[pa.RecordBatch], length: int, k: int, deal: Deal, hot: Broadcast) -> Iterator[pa.RecordBatch]:
    """Sorts the sampled suffixes of each chunk, settles what repeats within it, and deals the
    suffixes that still have windows to settle to buckets, as front-coded runs."""
    for whole in batches:
        for batch in pieces(whole, "text"):
            rows, entries = batch.column("items").to_pylist(), []
            for i, parts in enumerate(rows):
                if not parts:
                    continue
                text, id_, own = batch.column("text")[i].as_py().encode(), batch.column("id")[i].as_py(), batch.column("key")[i].as_py()
                for at, b, s in np.frombuffer(parts, SPOT).tolist():
                    right = text[at : at - b + s + length]
                    if len(right) == s + length - b:  # else another document has this key
                        entries.append((xxhash.xxh64_digest(text[at : at + k]) + right, text[at - b : at], id_, own, at, b - s, b))
            if not entries:
                continue
            run = Suffixes.of(entries)
            covered = run.settle(length, k)
            if covered.any():
                entry, found = stretches(covered, run.p, length)
                yield for_documents(run.own[entry], found, deal, run.ids[entry])
            run = run.open(covered).split(hot.value, length, k)
            bucket = np.array([deal.of_bytes(key) for key in run.keys], np.int64)
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
            ends = np.append(edges[1:], len(bucket))
            yield rows_of(deal.seats[bucket[edges]].tolist(), False, [run.pack(a, b) for a, b in zip(edges.tolist(), ends.tolist())])


def _merge(batches: Iterator[pa.RecordBatch], length: int, k: int, deal: Deal) -> Iterator[pa.RecordBatch]:
    """Merges the runs of a partition's buckets, bucket by bucket, and settles what repeats."""

    def settled(merged: list[Suffixes]) -> Iterator[pa.RecordBatch]:
        # Buckets share no suffix: the first entry of each shares nothing with the one before.
        all_ = Suffixes([x for r in merged for x in r.keys], [x for r in merged for x in [0, *r.shared[1:]]], [x for r in merged for x in r.lefts], *(np.concatenate([getattr(r, n) for r in merged]) for n in ARRAYS))
        covered = all_.settle(length, k)
        if covered.any():
            entry, found = stretches(covered, all_.p, length)
            yield for_documents(all_.own[entry], found, deal, all_.ids[entry]).select(["bucket", "body"])

    waiting: list[Suffixes] = []
    for own, bodies in buckets(batches):
        if own is not None:
            yield own
            continue
        waiting.append(_merged([Suffixes.unpack(b) for b in bodies]))
        if sum(len(x.keys) for x in waiting) >= TOGETHER:
            yield from settled(waiting)
            waiting = []
    if waiting:
        yield from settled(waiting)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            out = []
            for doc, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items"))):
                raw = text.encode()
                gone = union(parts, len(raw))
                edges = [0, *(x for ab in gone for x in ab), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if gone else raw
                out.append((doc, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, [x for ab in gone for x in ab]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def remove_repeated_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, k: int = K) -> DataFrame:
    """Removes every byte that lies in a ``length``-byte string which also starts earlier (in a
    document with a smaller id, or earlier in the same one), judged on the input: doc_id, n_bytes,
    n_removed, n_spans, kept_sha256, kept (the bytes) and spans (starts and ends, flat).

    A first exchange of hashes finds sampled anchors that occur more than once. Of these alone,
    chunks sort the suffixes that start there and settle what repeats within a chunk. What is
    left goes as sorted, front-coded runs to buckets of the anchors' hashes, where a loser tree
    merges the runs without comparing known prefixes again. Neighbours in suffix order then tell,
    for every offset of a window to its anchor, which windows are equal and where they start first.

    Anchors with very many different surroundings are found first, by a count in a table of one
    size; their windows are dealt by the whole window, so no task gets all of such an anchor.
    A chunk sends an anchor, and a window, once, however often it has it, so copies don't gather
    in one task. A task takes its buckets one after the other from a sort that can spill.

    Null texts are empty; texts under ``length`` bytes stay whole. A document is an id with a text:
    rows of one id with different texts are documents of their own, in an order by a hash of
    the text, and so are rows without an id, which come after all others. A repeated row (same id
    and text) is the same document and gets equal results. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = documents(docs, text, doc_id)
    symbols = lambda data, offsets: (BYTE_VALUES[data], offsets)
    hot = hot_slots(rows, symbols, k, length)
    spots = repeated_spots(rows, symbols, k, length)
    deal = deal_of(docs.sparkSession)
    runs = rows.join(spots, "key", "left").mapInArrow(lambda b: _sorted_runs(b, length, k, deal, hot), ROWS)
    found = dealt(runs).mapInArrow(lambda b: _merge(b, length, k, deal), ITEMS)
    parts = by_document(found, STRETCH)
    return rows.join(parts, same_document(rows, parts), "left").select("doc_id", "text", "items").mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, spans array<bigint>")
