"""Ranked lexical search with a two-level quantised index.

The first level has a byte for each posting: its impact, rounded up. Sums of bytes bound a score
from both sides cheaply. The second level has the term's count in the document and the document's
length, from which scores are exact integers.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neargrain.llm.common import buffer_of, pieces, shared_folder, word_hashes, words_of

K = 50
#: Bytes of text, and documents, of one block of the index.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 1 << 15
#: Terms of the items that are searched at once, on average; what is sent to all tasks grows with it.
TERMS_AT_ONCE = 1 << 18
#: An impact is below this; a byte q stands for impacts up to q * IMPACT // 255.
IMPACT = 1_000_000
#: Stands for a null id: after all others.
NO_ID = (1 << 63) - 1

#: Bytes that no term has: all of ASCII but 0-9, A-Z and a-z.
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_SPACES = "block bigint, docs bigint, with_terms bigint, tokens bigint, terms binary, places binary, counts binary, lengths binary, ids binary"


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 32-bit numbers, one after the other."""
    return struct.pack(f"<B{len(arrays)}I", len(arrays), *map(len, arrays)) + zstandard.compress(b"".join(a.astype("<u4").tobytes() for a in arrays), 1)


def _unpacked(body: bytes) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{body[0]}I", body, 1)
    raw, at, out = zstandard.decompress(body[1 + 4 * body[0] :]), 0, []
    for n in sizes:
        out.append(np.frombuffer(raw, "<u4", n, at).astype(np.int64))
        at += 4 * n
    return out


def _inverted(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """A row for each block of documents: its terms in order of their bytes, the places (documents'
    numbers in the block) of each, and how often it is there; lengths and ids of the documents."""
    block = first
    for whole in batches:
        for piece in pieces(whole, "text", BLOCK_BYTES):
            for start in range(0, piece.num_rows, BLOCK_DOCS):
                batch = piece.slice(start, BLOCK_DOCS)
                data, offsets = buffer_of(batch.column("text"))
                data = LOWER[data]
                starts, ends, rows = words_of(data, offsets, NO_TERM)
                hashes = word_hashes(data, starts, ends)
                lengths = np.diff(rows)
                row = np.repeat(np.arange(batch.num_rows), lengths)
                order = np.argsort(hashes, kind="stable")  # so rows rise within a term
                hashes, row = hashes[order], row[order]
                new_term = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, bool)
                new = np.flatnonzero(new_term | np.concatenate(([True], row[1:] != row[:-1]))) if len(hashes) else np.zeros(0, np.int64)
                counts, places = np.diff(np.append(new, len(hashes))), row[new]
                of_term = np.flatnonzero(new_term[new])  # where each term's postings start
                raw = data.tobytes()
                at = order[new[of_term]]
                terms = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
                by_bytes = sorted(range(len(terms)), key=terms.__getitem__)
                sizes = np.diff(np.append(of_term, len(new)))
                moved = np.array(by_bytes, np.int64)
                take = _ranges(of_term[moved], sizes[moved]) if len(terms) else np.zeros(0, np.int64)
                ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
                body = [b"\n".join(terms[i] for i in by_bytes), _packed(sizes[moved], places[take]), _packed(counts[take]), _packed(lengths), ids.tobytes()]
                numbers = [block, batch.num_rows, int((lengths > 0).sum()), len(hashes)]
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in numbers), *(pa.array([zstandard.compress(body[0], 1) if i == 0 else x], pa.binary()) for i, x in enumerate(body))], names=[c.split()[0] for c in _SPACES.split(", ")])
                block += 1


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + sizes[0] - 1, then the same of the next, and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)


def _norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents: 100 - 50 + 50 * length * n div total, exact also beyond 64 bits on the way."""
    if 50 * int(lengths.max(initial=0)) * n < 1 << 63:
        return 50 + (50 * lengths * n) // max(total, 1)
    return np.array([50 + 50 * x * n // total for x in lengths.tolist()], np.int64)


def _impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


@dataclass(frozen=True)
class Index:
    """The blocks of an index, with ``n`` documents that have terms and ``total`` terms in them."""

    blocks: DataFrame
    n: int
    total: int

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Index:
        blocks = spark.read.parquet(folder)
        sums = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("with_terms", "tokens")]).first()
        return Index(blocks, sums["with_terms"], sums["tokens"])


def build_index(docs: DataFrame, folder: str | None = None, text: str = "text", doc_id: str = "doc_id") -> Index:
    """Indexes every row of ``docs`` (null texts have no term) and leaves the index in ``folder``, by
    default one that goes with the application. Each task inverts blocks of the documents it reads,
    without a shuffle; impacts need the corpus's totals, so a second pass, over postings
    alone, adds them."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    exact = shared_folder(spark, "postings")
    rows.mapInArrow(lambda batches: _inverted(batches, TaskContext.get().partitionId() << 33), _SPACES).write.parquet(exact)
    plain = Index.open(spark, exact)
    n, total = plain.n, plain.total

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                batch = whole.slice(i, 1)
                body = {c: batch.column(c)[0].as_py() for c in ("places", "counts", "lengths")}
                (counts,), (lengths,) = _unpacked(body["counts"]), _unpacked(body["lengths"])
                g = _impacts(counts, _norms(lengths, n, total)[_unpacked(body["places"])[1]])
                level = -(-g * 255 // IMPACT)  # rounded up: 255 at most
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([zstandard.compress(level.astype(np.uint8).tobytes(), 1)], pa.binary())], names=[*batch.schema.names, "impacts"])

    folder = folder or shared_folder(spark, "index")
    plain.blocks.select(*[c.split()[0] for c in _SPACES.split(", ")]).mapInArrow(rounded, f"{_SPACES}, impacts binary").write.mode("overwrite").parquet(folder)
    return Index(spark.read.parquet(folder), n, total)


#: The terms of a text, once each.
_TERMS = rf"array_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0))"


class _Items:
    """Some items and the weights of their terms, as they are sent to all tasks."""

    def __init__(self, terms: list[list[bytes]]):
        self.words = sorted({w for words in terms for w in words})
        number = {w: i for i, w in enumerate(self.words)}
        self.terms = [np.array(sorted(number[w] for w in words), np.int64) for words in terms]
        self.weights = np.zeros(len(self.words), np.int64)
        self.least = np.zeros(len(terms), np.int64)

    def weigh(self, frequencies: dict[int, int], n: int) -> None:
        for i in range(len(self.words)):
            self.weights[i] = math.floor(1000 * math.log((2 * n + 2) / (2 * frequencies.get(i, 0) + 1)))

    def here(self, block: bytes) -> dict[int, int]:
        """Of the terms, those that a block has, with their places among the block's terms."""
        there = zstandard.decompress(block)
        own = {w: i for i, w in enumerate(there.split(b"\n"))} if there else {}
        return {i: own[w] for i, w in enumerate(self.words) if w in own}


def _block_sums(batch: dict, items: _Items) -> Iterator[tuple[int, np.ndarray, list[tuple[int, slice, np.ndarray]], np.ndarray]]:
    """(item, sum of weighted bytes, the terms here as (weight, postings, places), sum of weights) for
    each document of a block and each item that has a term there."""
    here = items.here(batch["terms"])
    if not here:
        return
    sizes, places = _unpacked(batch["places"])
    edge = np.concatenate(([0], np.cumsum(sizes)))
    level = np.frombuffer(zstandard.decompress(batch["impacts"]), np.uint8).astype(np.int64)
    postings = {i: (int(items.weights[i]), slice(int(edge[t]), int(edge[t + 1]))) for i, t in here.items() if items.weights[i] > 0}
    scaled = {i: (w, s, places[s], w * level[s]) for i, (w, s) in postings.items()}
    for number, terms in enumerate(items.terms):
        found = [scaled[t] for t in terms.tolist() if t in scaled]
        if not found:
            continue
        sums, weights = np.zeros(batch["docs"], np.int64), np.zeros(batch["docs"], np.int64)
        for w, _, at, add in found:
            sums[at] += add
            weights[at] += w
        yield number, sums, [(w, s, at) for w, s, at, _ in found], weights


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _search_some(index: Index, items: _Items, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best of every item, among them all of the k best."""
    spark = index.blocks.sparkSession
    n, total = index.n, index.total
    sent = spark.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for row in _rows(batches):
            here = sent.value.here(row["terms"])
            if here:
                sizes = _unpacked(row["places"])[0]
                for i, t in here.items():
                    held[i] = held.get(i, 0) + int(sizes[t])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["term", "df"])

    sums = index.blocks.select("terms", "places").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    items.weigh({r["term"]: r["df"] for r in sums.collect()}, n)
    weighed = spark.sparkContext.broadcast(items)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each item the k largest lower bounds in a partition."""
        best: dict[int, np.ndarray] = {}
        for row in _rows(batches):
            for number, sums, _, weights in _block_sums(row, weighed.value):
                low = (sums - weights) * IMPACT // 255
                low = low[low > 0]
                if number in best:
                    low = np.concatenate((best[number], low[low > best[number][0]] if len(best[number]) == k else low))
                best[number] = np.sort(low)[-k:]
        if best:
            of = np.repeat(np.array(list(best), np.int64), [len(x) for x in best.values()])
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(np.concatenate(list(best.values())), pa.int64())], names=["item", "low"])

    lows = index.blocks.select("docs", "terms", "places", "impacts").mapInArrow(bounds, "item bigint, low bigint")
    kth = lows.withColumn("rn", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))).filter(F.col("rn") == k)
    for r in kth.collect():  # a row an item
        items.least[r["item"]] = r["low"]
    bounded = spark.sparkContext.broadcast(items)

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for row in _rows(batches):
            own = bounded.value
            exact: dict[str, np.ndarray] = {}
            for number, sums, found, _ in _block_sums(row, own):
                high = sums * IMPACT // 255
                asked = np.flatnonzero(high >= max(int(own.least[number]), 1))
                if not len(asked):
                    continue
                if not exact:
                    exact = {"counts": _unpacked(row["counts"])[0], "m": _norms(_unpacked(row["lengths"])[0], n, total), "ids": np.frombuffer(row["ids"], "<i8")}
                seat = np.full(row["docs"], -1)
                seat[asked] = np.arange(len(asked))
                scores = np.zeros(len(asked), np.int64)
                for w, postings, at in found:
                    hit = np.flatnonzero(seat[at] >= 0)
                    scores[seat[at[hit]]] += w * _impacts(exact["counts"][postings][hit], exact["m"][at[hit]])
                ids = exact["ids"][asked]
                if number in best:
                    ids, scores = np.concatenate((best[number][0], ids)), np.concatenate((best[number][1], scores))
                order = np.lexsort((ids, -scores))[:k]
                best[number] = ids[order], scores[order]
        if best:
            of = np.repeat(np.array(list(best), np.int64), [len(x) for x, _ in best.values()])
            ids, scores = (np.concatenate(x) for x in zip(*best.values()))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return index.blocks.select("docs", "terms", "places", "impacts", "counts", "lengths", "ids").mapInArrow(rescore, "item bigint, doc_id bigint, score bigint")


def search(index: Index, items: DataFrame, k: int = K, text: str = "text", item_id: str = "item_id", terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the k documents of the highest scores above 0,
    equal scores by ascending id (null ids last).

    Items are searched in groups of about ``terms_at_once`` terms, so that what all tasks are sent is
    bounded (a longer item is a group of its own). For each group the blocks are read three times:
    for the document frequencies of its terms; for lower bounds of scores, of which the k-th of all
    is a bound that the k best reach; and for exact scores of every document whose upper bound
    reaches it. A task returns k rows an item at most, which can't lose one of the k best.

    Texts that are null or without terms find nothing. Equal rows are one item; rows of one id with
    different texts are items of their own. Documents that are repeated are ranked each. Ties at
    rank k go to the smaller ids. Other columns are ignored.
    """
    spark = items.sparkSession
    rows = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text")).filter("text is not null").distinct()
    rows = rows.select("item_id", F.expr(_TERMS).alias("terms"), F.xxhash64("item_id", "text").alias("hash")).filter("size(terms) > 0")
    n_groups = -(-(rows.agg(F.sum(F.size("terms"))).first()[0] or 0) // terms_at_once)
    found = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for group in range(n_groups):
        own = rows.filter(F.pmod("hash", F.lit(n_groups)) == group).collect()
        if not own:
            continue
        best = _search_some(index, _Items([[w.encode() for w in r["terms"]] for r in own]), k)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], "item bigint, item_id bigint")
        found = found.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score"))
    return found
