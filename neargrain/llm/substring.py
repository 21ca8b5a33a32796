"""Substring deduplication over words with suffix automata of reference shards."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neargrain.llm.common import pieces, word_hashes, words_of
from neargrain.llm.repeats import ITEMS, ROWS, SPOT, STRETCH, Deal, buckets, by_document, deal_of, dealt, documents, for_documents, hot_slots, is_hot, repeated_spots, rows_of, same_document, union

LENGTH, K = 20, 10
#: Words of passages that one automaton holds; a group of passages with one anchor stays together.
SHARD_WORDS = 40_000


class Automaton:
    """Suffix automaton of several passages. Each state has the first place, in order of
    insertion, at which its strings end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [None]

    def _clone(self, q: int, size: int) -> int:
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.size.append(size)
        self.first.append(self.first[q])
        self.link[q] = len(self.size) - 1
        return len(self.size) - 1

    def _redirect(self, p: int, word, q: int, clone: int) -> None:
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]

    def extend(self, last: int, word, place) -> int:
        q = self.next[last].get(word)
        if q is not None:
            if self.size[q] == self.size[last] + 1:
                return q
            clone = self._clone(q, self.size[last] + 1)
            self._redirect(last, word, q, clone)
            return clone
        new = len(self.size)
        self.next.append({})
        self.link.append(0)
        self.size.append(self.size[last] + 1)
        self.first.append(place)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            if self.size[q] == self.size[p] + 1:
                self.link[new] = q
            else:
                clone = self._clone(q, self.size[p] + 1)
                self._redirect(p, word, q, clone)
                self.link[new] = clone
        return new

    def insert(self, words: list, doc: int, start: int) -> None:
        last = 0
        for i, word in enumerate(words):
            last = self.extend(last, word, (doc, start + i))

    def matches(self, words: list, length: int) -> Iterator[tuple[int, tuple]]:
        """Matching statistics: (i, first place) where the ``length`` words that end at i are in
        the automaton."""
        state, matched = 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.size[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            if matched >= length:
                while self.size[self.link[state]] >= length:
                    state = self.link[state]
                    matched = self.size[state]
                yield i, self.first[state]


def settle_shard(passages: list[tuple], length: int) -> tuple[list, list[tuple[int, int]]]:
    """Passages are (document, first word's place, words), a document its id and key. In order, each enters the automaton and
    is streamed against it: the documents and stretches of words that are covered."""
    automaton, docs, found = Automaton(), [], []
    for doc, start, words in sorted(passages, key=lambda x: x[:2]):
        automaton.insert(words, doc, start)
        for i, first in automaton.matches(words, length):
            if first < (doc, start + i):  # not this very place
                a, b = start + i - length + 1, start + i + 1
                if docs and docs[-1] == doc and found[-1][0] <= a <= found[-1][1]:
                    found[-1] = (found[-1][0], max(b, found[-1][1]))
                else:
                    docs.append(doc)
                    found.append((a, b))
    return docs, found


def _covered(docs: list[tuple[int, int]], found: list[tuple[int, int]], deal: Deal) -> pa.RecordBatch:
    ids, keys = np.array(docs, np.int64).T
    return for_documents(keys, np.array(found, STRETCH), deal, ids)


def _collapse(entries: list[tuple], length: int) -> tuple[list[tuple], list, list[tuple[int, int]]]:
    """Of equal passages around equal anchors the first stays; the others are covered as a whole.
    Entries are (hash, before, span, passage, document, anchor's place)."""
    entries.sort()
    kept, docs, found = [], [], []
    for e in entries:
        if kept and kept[-1][:4] == e[:4]:
            if kept[-1][4:] != e[4:]:
                docs.append(e[4])
                found.append((e[5] - e[1], e[5] - e[1] + e[2] + length))
        else:
            kept.append(e)
    return kept, docs, found


def _split(entries: list[tuple], hot: np.ndarray, length: int, k: int) -> list[tuple]:
    """Passages around hot anchors become one entry for each window, with the hash of the whole
    window in place of the anchor's."""
    if not entries:
        return entries
    split = [passage.split() for _, _, _, passage, _, _ in entries]
    grams = b" ".join(w for words, e in zip(split, entries) for w in words[e[1] : e[1] + k])
    values, _ = _word_symbols(np.frombuffer(grams, np.uint8), np.array([0, len(grams)]))
    out = []
    for many, words, e in zip(is_hot(values.reshape(-1, k), hot).tolist(), split, entries):
        if not many:
            out.append(e)
            continue
        _, before, span, _, doc, p = e
        for i in range(span + 1):
            window = b" ".join(words[i : i + length])
            out.append((xxhash.xxh64_digest(window), before - i, 0, window, doc, p))
    return out


def _passages(batches: Iterator[pa.RecordBatch], length: int, k: int, deal: Deal, hot: Broadcast) -> Iterator[pa.RecordBatch]:
    """Cuts out the passages around repeated anchors and deals them to buckets; of passages that
    a chunk has several times, the first."""
    for whole in batches:
        for batch in pieces(whole, "text"):
            entries = []
            for id_, key, text, parts in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "text", "items"))):
                if not parts:
                    continue
                words, doc = text.encode().split(), (id_, key)
                for p, before, span in np.frombuffer(parts, SPOT).tolist():
                    passage = words[p - before : p - before + span + length]
                    if len(passage) == span + length:  # else another document has this key
                        entries.append((xxhash.xxh64_digest(b" ".join(words[p : p + k])), before, span, b" ".join(passage), doc, p))
            if not entries:
                continue
            kept, docs, found = _collapse(entries, length)
            kept, more_docs, more = _collapse(_split(kept, hot.value, length, k), length)
            docs, found = docs + more_docs, found + more
            if docs:
                yield _covered(docs, found, deal)
            sent: dict[int, list] = {}
            for e in kept:
                sent.setdefault(int(deal.seats[deal.of_bytes(e[0])]), []).append(e)
            yield rows_of(list(sent), False, [zstandard.compress(pickle.dumps(x, 5), 3) for x in sent.values()])


def _match(batches: Iterator[pa.RecordBatch], length: int, deal: Deal) -> Iterator[pa.RecordBatch]:
    """Of a partition of buckets: collapses equal passages, leaves out those of which no window
    is in another passage with that anchor, and streams the others against automata."""
    shard: list[tuple] = []
    for own, bodies in buckets(batches):
        if own is not None:
            yield own
            continue
        kept, docs, found = _collapse([e for body in bodies for e in pickle.loads(zstandard.decompress(body))], length)
        a = 0
        for b in range(1, len(kept) + 1):
            if b < len(kept) and kept[b][0] == kept[a][0]:
                continue
            if b - a > 1:
                shard += _sharing(kept[a:b], length)
                if sum(len(x[2]) for x in shard) >= SHARD_WORDS:
                    more_docs, more = settle_shard(shard, length)
                    docs, found, shard = docs + more_docs, found + more, []
            a = b
        if docs:
            yield _covered(docs, found, deal).select(["bucket", "body"])
    docs, found = settle_shard(shard, length)
    if docs:
        yield _covered(docs, found, deal).select(["bucket", "body"])


def _sharing(group: list[tuple], length: int) -> list[tuple]:
    """The passages of a group of which a window, at its offset to the anchor, is in another."""
    seen: dict[tuple[int, int], int] = {}
    split, keys = [], []
    for _, before, span, passage, doc, p in group:
        words = passage.split()
        own = [(before - i, hash(tuple(words[i : i + length]))) for i in range(span + 1)]
        for key in own:
            seen[key] = seen.get(key, 0) + 1
        split.append((doc, p - before, words))
        keys.append(own)
    return [x for x, own in zip(split, keys) if any(seen[key] > 1 for key in own)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            out = []
            for doc, text, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items"))):
                words = text.encode().split()
                gone = union(parts, len(words))
                edges = [0, *(x for ab in gone for x in ab), len(words)]
                kept = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]] if gone else words
                joined = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode(), [x for ab in gone for x in ab]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])


def _word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = words_of(data, offsets)
    return word_hashes(data, starts, ends), rows


def remove_repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, k: int = K) -> DataFrame:
    """Removes every word that lies in ``length`` consecutive words which also start earlier (in
    a document with a smaller id, or earlier in the same one), judged on the input: doc_id,
    n_words, n_removed, kept_sha256, kept (words joined by one space) and spans (flat).

    Words are runs of anything but space and 0x09 to 0x0D, unchanged. A first exchange of hashes
    finds sampled anchors that occur more than once. The passages around them are dealt to
    reference shards by their anchors, instead of streaming every document past every shard;
    suffix automata of the shards' passages give matching statistics, and spans of at least
    ``length`` words with an earlier place are removed.

    Anchors with very many different surroundings are found first, by a count in a table of one
    size; their windows are dealt by the whole window, so no task gets all of such an anchor.
    Of equal passages a chunk sends one, so copies don't gather in one task. A task takes its
    buckets one after the other from a sort that can spill, so it holds one bucket.

    Null texts have no words. A document is an id with a text: rows of one id with different texts
    are documents of their own, in an order by a hash of the text, and so are rows without an id,
    which come after all others. A repeated row (same id and text) is the same document and
    gets equal results. Other columns are ignored; an empty table gives an empty result.
    """
    rows = documents(docs, text, doc_id)
    hot = hot_slots(rows, _word_symbols, k, length)
    spots = repeated_spots(rows, _word_symbols, k, length)
    deal = deal_of(docs.sparkSession)
    passages = rows.join(spots, "key", "left").mapInArrow(lambda b: _passages(b, length, k, deal, hot), ROWS)
    found = dealt(passages).mapInArrow(lambda b: _match(b, length, deal), ITEMS)
    parts = by_document(found, STRETCH)
    return rows.join(parts, same_document(rows, parts), "left").select("doc_id", "text", "items").mapInArrow(_cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string, spans array<bigint>")
