"""Where a corpus may repeat itself: sampled anchors of windows, and the exchange that finds
those which occur more than once. Used by the suffix and the substring operators.

A window is ``length`` consecutive symbols of one document. Its anchor is the k-gram in it with
the smallest hash, the leftmost of equal ones. Equal windows have their anchors at the same
place, so two occurrences of a window have equal anchors; and windows whose anchor occurs once
in the corpus occur once. About 2 / (length - k + 2) of all positions are anchors.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neargrain.llm.common import MULTIPLIER, buffer_of, mix, pieces, powers, rolling, rolling_at, slot_counts, slot_of

#: Hashes are dealt to 2**bits buckets, which shuffle partitions share out: at least so many bits,
#: and four buckets for each partition.
LEAST_BITS, MOST_BITS = 9, 20
#: Window starts that are looked at together: few enough for a core's cache.
BLOCK = 1 << 16
#: Anchors are hot in slots with more surroundings (equal ones of a chunk count once) than both:
#: what a task holds with ease, about 10 MB, and so many times the mean of all slots. Each window
#: of a hot anchor is sent by itself, so cold ones had better not be split.
HOT_LEAST, HOT_TIMES = 1 << 16, 8
#: Stands for a null id in the order of documents: after all others.
NO_ID = (1 << 63) - 1

#: An anchor in a document: its place, windows before it (first start), and window starts less one.
SPOT = np.dtype([("p", "<u4"), ("before", "<u1"), ("span", "<u1")])


def documents(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, id, key, text): rows as documents. A document is an id with a text; ``key`` is a
    hash of both. Documents are ordered by ``id``, those of one id (or of none) by ``key``."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("doc_id", "text").alias("key"), "text")


@dataclass(frozen=True)
class Deal:
    """How hashes are dealt to buckets, and buckets to shuffle partitions: ``seats`` has a number for
    each of 2**bits buckets, such that each partition gets an equal share of them. Hashing the
    buckets' own numbers would give some partitions three times as many as others."""

    bits: int
    seats: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def of_bytes(self, digest: bytes) -> int:
        return int.from_bytes(digest[:4]) >> (32 - self.bits)


def deal_of(spark: SparkSession) -> Deal:
    """The deal for the session's number of shuffle partitions. The driver gets some rows for each
    bucket, 2**MOST_BITS at most."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * n - 1).bit_length()))
    wanted = np.arange(1 << bits) * n >> bits  # the partition of each bucket
    numbers = spark.range(2 * (1 << bits) + 64 * n).select(F.col("id").cast("int").alias("seat"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("part")).toArrow()
    seat, part = (numbers.column(c).to_numpy() for c in ("seat", "part"))
    seat = seat[np.argsort(part, kind="stable")]
    first, have = np.cumsum(np.bincount(part, minlength=n)) - np.bincount(part, minlength=n), np.bincount(part, minlength=n)
    among = np.arange(1 << bits) - np.searchsorted(wanted, wanted)
    # Should a partition have too few numbers, its buckets share them.
    return Deal(bits, seat[np.minimum(first[wanted] + among % np.maximum(have[wanted], 1), len(seat) - 1)].astype(np.int32))


def anchors(values: np.ndarray, offsets: np.ndarray, k: int, length: int) -> tuple[np.ndarray, ...]:
    """(row, p, before, span, hash) of all anchors of windows that lie in one row. The windows of
    an anchor at p start at p - before to p - before + span."""
    found: list[tuple[np.ndarray, ...]] = []
    ends = np.repeat(offsets[1:], np.diff(offsets))
    w = length - k + 1
    for base in range(0, max(len(values) - length + 1, 0), BLOCK):
        block = values[base : base + BLOCK + length - 1]
        grams = rolling(block, k)
        # The upper bits of the hash, and the place for ties.
        low = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
        reach = 1
        while 2 * reach <= w:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < w:
            low = np.minimum(low[: len(low) - (w - reach)], low[w - reach :])
        at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        start = np.arange(len(at), dtype=np.int64)
        valid = start + base + length <= ends[base : base + len(at)]
        same = valid[1:] & valid[:-1] & (at[1:] == at[:-1])
        first = np.flatnonzero(valid & np.concatenate(([True], ~same)))
        last = np.flatnonzero(valid & np.concatenate((~same, [True])))
        p = at[first]
        # Anchors have the least of many hashes: spread anew, or a few buckets would get most of them.
        found.append((p + base, p - first, last - first, mix(grams[p])))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    p, before, span, hashes = (np.concatenate(x) for x in zip(*found))
    row = np.searchsorted(offsets, p, side="right") - 1
    return row, p - offsets[row], before, span, hashes


def spots(p: np.ndarray, before: np.ndarray, span: np.ndarray) -> np.ndarray:
    out = np.empty(len(p), SPOT)
    out["p"], out["before"], out["span"] = p, before, span
    return out


#: What chunks send: to a bucket, something to settle (own is false) or, to the bucket of some
#: documents, items of theirs (own is true).
ROWS = "bucket int, own boolean, body binary"
ITEMS = "bucket int, body binary"


def rows_of(bucket: list[int], own: bool, body: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([own] * len(bucket), pa.bool_()), pa.array(body, pa.binary())], names=["bucket", "own", "body"])


def for_documents(keys: np.ndarray, items: np.ndarray, deal: Deal, ids: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each bucket of documents (keys and, where they matter, ids) with their items, packed."""
    ids = np.zeros(len(keys), np.int64) if ids is None else ids
    bucket = deal.of(keys.astype(np.uint64) * np.uint64(MULTIPLIER))
    order = np.lexsort((ids, keys, bucket))
    keys, ids, items, bucket = keys[order], ids[order], items[order], bucket[order]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))) if len(keys) else np.zeros(0, bool)
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(keys) else np.zeros(0, np.int64)
    body = []
    for a, b in zip(edges, np.append(edges[1:], len(keys))):
        first = a + np.flatnonzero(new[a:b])
        counts = np.diff(np.append(first, b))
        body.append(struct.pack("<I", len(first)) + zstandard.compress(keys[first].astype("<i8").tobytes() + ids[first].astype("<i8").tobytes() + counts.astype("<u4").tobytes() + items[a:b].tobytes(), 1))
    return rows_of(deal.seats[bucket[edges]].tolist(), True, body)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows by bucket: a task gets its buckets one after the other, from a sort that can spill."""
    return rows.repartition(F.col("bucket")).sortWithinPartitions("bucket")


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, list[bytes]]]:
    """Of dealt rows: documents' items, which are only passed on, and the bodies of each bucket.
    Holds one bucket."""
    now, bodies = None, []
    for batch in batches:
        if "own" in batch.schema.names:
            own = batch.column("own")
            if own.true_count:
                yield batch.filter(own).select(["bucket", "body"]), []
            batch = batch.filter(pc.invert(own))
        for bucket, body in zip(batch.column("bucket").to_pylist(), batch.column("body").to_pylist()):
            if bucket != now and bodies:
                yield None, bodies
                bodies = []
            now = bucket
            bodies.append(body)
    if bodies:
        yield None, bodies


def _by_document(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """One row for each document of a partition of buckets, with all its items."""
    for _, bodies in buckets(batches):
        keys, ids, items = [], [], []
        for body in bodies:
            (n,) = struct.unpack_from("<I", body)
            raw = zstandard.decompress(body[4:])
            counts = np.frombuffer(raw, "<u4", n, 16 * n)
            keys.append(np.repeat(np.frombuffer(raw, "<i8", n), counts))
            ids.append(np.repeat(np.frombuffer(raw, "<i8", n, 8 * n), counts))
            items.append(np.frombuffer(raw, kind, -1, 20 * n))
        key, id_, item = np.concatenate(keys), np.concatenate(ids), np.concatenate(items)
        order = np.lexsort((id_, key))
        key, id_, item = key[order], id_[order], item[order]
        edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (id_[1:] != id_[:-1]))))
        yield pa.RecordBatch.from_arrays([pa.array(key[edges], pa.int64()), pa.array(id_[edges], pa.int64()), pa.array([item[a:b].tobytes() for a, b in zip(edges, np.append(edges[1:], len(key)))], pa.binary())], names=["key", "of", "items"])


Batches = Iterator[pa.RecordBatch]


def by_document(found: DataFrame, kind: np.dtype, then: Callable[[Batches], Batches] = iter, schema: str = "key bigint, of bigint, items binary") -> DataFrame:
    """(key, of, items) of rows with the columns of ITEMS; ``of`` is the id, 0 where none was given.
    ``then`` makes rows of ``schema`` of them, in the same Python worker."""
    return dealt(found).mapInArrow(lambda b: then(_by_document(b, kind)), schema)


def same_document(rows: DataFrame, parts: DataFrame) -> Column:
    """The condition of a join of documents with their items: by key, so that it can use the
    rows' partitioning by key, and of rows with one key by id."""
    return (rows["key"] == parts["key"]) & (rows["id"].bitwiseXOR(parts["of"]) == 0)


def _planes(values: np.ndarray) -> bytes:
    """Rising 64-bit values as gaps, byte by byte: the upper bytes compress."""
    return np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _pack(hashes: np.ndarray, keys: np.ndarray, items: np.ndarray, known: np.ndarray) -> bytes:
    raw = b"".join((_planes(hashes), keys.astype("<i8").tobytes(), items["p"].tobytes(), items["before"].tobytes(), items["span"].tobytes(), known.tobytes()))
    return struct.pack("<I", len(hashes)) + zstandard.compress(raw, 1)


def _unpack(body: bytes) -> tuple[np.ndarray, ...]:
    (n,) = struct.unpack_from("<I", body)
    raw, at, out = zstandard.decompress(body[4:]), 8 * n, []
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel()
    for kind in ("<i8", "<u4", "<u1", "<u1", "<u1"):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    keys, p, before, span, known = out
    return np.cumsum(gaps, dtype=np.uint64), keys, spots(p, before, span), known


Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _sampled(batches: Iterator[pa.RecordBatch], symbols: Symbols, k: int, length: int, deal: Deal) -> Iterator[pa.RecordBatch]:
    """Of each chunk of texts: the distinct anchors, one occurrence of each, dealt to buckets; and
    every occurrence of those that the chunk already has twice, for their documents. So a chunk
    sends an anchor once, however many of its documents have it."""
    for whole in batches:
        for batch in pieces(whole, "text"):
            data, offsets = buffer_of(batch.column("text"))
            values, rows = symbols(data, offsets)
            row, p, before, span, hashes = anchors(values, rows, k, length)
            if not len(p):
                continue
            keys, items = batch.column("key").to_numpy()[row], spots(p, before, span)
            order = np.argsort(hashes, kind="stable")
            hashes, keys, items = hashes[order], keys[order], items[order]
            new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
            again = ~new
            twice = again | np.concatenate((again[1:], [False]))
            if twice.any():
                yield for_documents(keys[twice], items[twice], deal)
            # 48 bits tell anchors apart well enough: equal ones only mean that texts are looked at.
            hashes, keys, items, known = hashes[new] >> np.uint64(16) << np.uint64(16), keys[new], items[new], twice[new]
            bucket = deal.of(hashes)
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.append(edges[1:], len(bucket))
            yield rows_of(deal.seats[bucket[edges]].tolist(), False, [_pack(hashes[a:b], keys[a:b], items[a:b], known[a:b]) for a, b in zip(edges, ends)])


def _repeated(batches: Iterator[pa.RecordBatch], deal: Deal) -> Iterator[pa.RecordBatch]:
    """Of a partition of buckets: for the documents, the anchors that several chunks have."""
    for own, bodies in buckets(batches):
        if own is not None:
            yield own
            continue
        hashes, keys, items, known = (np.concatenate(x) for x in zip(*map(_unpack, bodies)))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        again = np.concatenate(([False], hashes[1:] == hashes[:-1]))
        twice = (again | np.concatenate((again[1:], [False]))) & (known[order] == 0)
        if twice.any():
            yield for_documents(keys[order[twice]], items[order[twice]], deal).select(["bucket", "body"])


def repeated_spots(texts: DataFrame, symbols: Symbols, k: int, length: int) -> DataFrame:
    """(key, items): the anchors, as packed SPOTs, of each document of ``texts`` (key, text) that
    occur more than once in all documents. Two documents that share a key get each other's places,
    too, which is harmless: what is there is compared, and it is text of theirs."""
    if length - k >= 256:
        raise ValueError("a window may have 255 anchors at most")
    deal = deal_of(texts.sparkSession)
    sent = texts.mapInArrow(lambda b: _sampled(b, symbols, k, length, deal), ROWS)
    back = dealt(sent).mapInArrow(lambda b: _repeated(b, deal), ITEMS)
    return by_document(back, SPOT).drop("of")


def hot_slots(texts: DataFrame, symbols: Symbols, k: int, length: int) -> Broadcast:
    """The slots of anchors that have very many different surroundings, as bits: a table of one
    size. Windows of such anchors are dealt by their whole content, so that no task gets them all;
    which slots are hot alters where windows meet, never which ones are equal."""

    def slots(texts: pa.Array) -> np.ndarray:
        values, rows = symbols(*buffer_of(texts))
        row, p, before, span, hashes = anchors(values, rows, k, length)
        if not len(p):
            return np.zeros(0, np.int64)
        first = rows[row] + p - before
        ends = rolling_at(values, length, np.concatenate((first, first + span))).reshape(2, -1)
        around = mix(hashes + ends[0] * np.uint64(MULTIPLIER)) + ends[1]
        return slot_of(hashes[np.unique(around, return_index=True)[1]])

    _, counts = slot_counts(texts.select("text"), slots)
    return texts.sparkSession.sparkContext.broadcast(np.packbits(counts > max(HOT_LEAST, HOT_TIMES * counts.mean())))


def is_hot(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which of the anchors, given as rows of k symbols, are in a hot slot."""
    slot = slot_of(mix(mix((grams * powers(MULTIPLIER, grams.shape[1])).sum(1, dtype=np.uint64))))
    return (hot[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


#: A covered stretch of a document: first symbol and past the last.
STRETCH = np.dtype([("a", "<u4"), ("b", "<u4")])


def stretches(covered: np.ndarray, p: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, STRETCHes) of a table covered[entry, offset]: the window that starts ``offset``
    symbols before the entry's anchor at p is covered."""
    edge = np.zeros((len(covered), 1), bool)
    padded = np.hstack((edge, covered.astype(bool), edge))
    entry, a = np.nonzero(padded[:, 1:] & ~padded[:, :-1])
    _, b = np.nonzero(~padded[:, 1:] & padded[:, :-1])
    out = np.empty(len(entry), STRETCH)
    out["a"], out["b"] = p[entry] - (b - 1), p[entry] - a + length
    return entry, out


def union(parts: bytes | None, n: int) -> list[tuple[int, int]]:
    """The maximal stretches, in order, of packed ones within n symbols."""
    if not parts:
        return []
    all_ = np.frombuffer(parts, STRETCH)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, np.minimum(all_["a"], n), 1)
    np.add.at(delta, np.minimum(all_["b"], n), -1)
    inside = np.concatenate(([False], np.cumsum(delta)[:-1] > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))
