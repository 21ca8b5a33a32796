"""Harmonic packing of token sequences."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from neargrain.llm.common import pieces

CAPACITY = 1024
#: A piece that would waste more than one id in so many of its document's is cut.
TRIM = 50
#: The id after each document.
END = 0

_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None):
    """text -> uint32 ids of the ``tokenizers`` vocabulary. With ``ranks``, the same vocabulary as
    ranks, `tiktoken` finds the same ids several times as fast; a text with a special token's
    string, which only ``tokenizers`` treats as one, goes to ``tokenizers``."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)

    def slow(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks is None:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def fast(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return slow(text)
        return own.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    return fast


def cut(n: int, capacity: int, trim: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces. Whole capacities come first. What is left, of class
    j, stays whole if its share of a bin, capacity // j, is longer by one in ``trim`` of the
    document's ids at most (or by two ids); otherwise the next smaller share, capacity //
    (j + 1), is cut off it, which fills its place exactly, and so on."""
    at, spare = 0, max(n // trim, 2)
    for _ in range(n // capacity):
        yield at, capacity
        at += capacity
    while at < n:
        j = capacity // (n - at)
        size = n - at if capacity // j - (n - at) <= spare else capacity // (j + 1)
        yield at, size
        at += size


class Packer:
    """A worker's bins. A piece of length l is of class j = capacity // l, that is, l lies in
    (capacity / (j + 1), capacity / j]; a bin of class j takes j pieces and is then closed."""

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity, self.bins, self.rows = first, capacity, {}, []

    def emit(self, members: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in members:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        j = self.capacity // len(ids)
        bin_ = self.bins.setdefault(j, [])
        bin_.append((doc, start, ids, total))
        if len(bin_) == j:
            self.emit(self.bins.pop(j))

    def finish(self) -> None:
        """What is left in open bins, less than one bin of each class, is laid end to end, cut at
        the capacity, and at the end at powers of two, which need no padding."""
        left = [m for j in sorted(self.bins) for m in self.bins[j]]
        self.bins = {}
        total, at = sum(len(m[2]) for m in left), 0
        room = min(self.capacity, 1 << (total.bit_length() - 1)) if total else 0
        members: list[tuple] = []
        for doc, start, ids, all_ in left:
            while len(ids):
                part = ids[:room]
                members.append((doc, start, part, all_))
                start, ids, room, at = start + len(part), ids[len(part) :], room - len(part), at + len(part)
                if not room:
                    self.emit(members)
                    members, rest = [], total - at
                    room = min(self.capacity, 1 << (rest.bit_length() - 1)) if rest else 0


def _pack(batches: Iterator[pa.RecordBatch], vocabulary: str, ranks: str | None, capacity: int, trim: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary, ranks)
    packer = Packer(TaskContext.get().partitionId() << 33, capacity)

    def drain() -> pa.RecordBatch:
        columns = zip(*packer.rows)
        packer.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    for whole in batches:
        for batch in pieces(whole, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(END)).astype("<u4", copy=False)
                for start, length in cut(len(ids), capacity, trim):
                    packer.add(doc, start, ids[start : start + length], len(ids))
            if packer.rows:
                yield drain()
    packer.finish()
    if packer.rows:
        yield drain()


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, trim: int = TRIM) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` ids: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset.

    Every partition packs what it reads, with bins of its own, without a shuffle. Pieces are dealt by
    length into reciprocal-capacity classes: a piece of class j is longer than capacity / (j + 1)
    and not longer than capacity / j, and a bin of class j takes j pieces. A document that is
    longer than the capacity, or that would leave too much of its place empty, is cut (see
    ``cut``), so a bin's padding is about one in 2 * ``trim`` of its ids. What stays in a worker's open
    bins fills sequences without padding. A worker's memory is one bin for each class and one document.

    A null or empty text is the single id 0. Repeated rows are packed each. A null id stays null.
    An empty table gives an empty result; other columns are ignored. ``sequence_id`` is unique
    over workers, not gapless.
    """
    import public_tokenizers

    own = vocabulary is None
    vocabulary = public_tokenizers.path("byte_bpe_50k.json") if own else vocabulary
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken") if own else ranks
    rows = docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text")
    return rows.mapInArrow(lambda batches: _pack(batches, vocabulary, ranks, capacity, trim), _SCHEMA)
