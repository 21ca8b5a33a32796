"""The k best cosines of queries whose vectors share many words with most others: dense ones, and long texts.

Joined by word, such a pair would give a row for each word it shares. Here blocks of queries meet chunks of all
vectors, each pair of them in one task, which multiplies them and sends a query's k best alone. Vectors are
packed: (doc_id, words, ws), a row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neargrain.operators.split import row_numbers
from neargrain.sources import cut, few_at_once

#: Queries of a block, and words of all of them; vectors of a chunk, and words of all of them.
BLOCK, BLOCK_WORDS, PART, WORDS = 4096, 1 << 21, 1 << 16, 1 << 18
#: Vectors that a task compares with its block at most, where there are so many.
STREAM = 1 << 20
#: Chunks are long rows, of which few are to be held at once.
ROW_GROUPS = {"parquet.block.size": str(1 << 24), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: Products that are added at once, and cells of the table of queries and vectors that they are added in.
AT_ONCE, CELLS = 1 << 17, 1 << 21
#: Words that more than this part of a block's queries have are multiplied as a matrix, so many at most.
HOT, MOST_HOT = 0.03, 1024
#: Vocabularies of numbers below this are looked up in a table. Pairs whose products are added anew at once.
TABLE, PAIRS = 1 << 25, 1 << 12
#: Numbers by which vectors that share most words may be told, so that they meet in the same blocks and chunks.
NEAR = 1024


def packed(rows: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """(doc_id, square, words, ws) of (doc_id, word, w); ``numbers`` (word, row) keeps its words alone, as numbers.
    The squared norm is that of all words."""
    known = rows.select("doc_id", F.col("word").alias("row"), "w") if numbers is None else rows.join(numbers, "word", "left").select("doc_id", "row", "w")
    pair = F.struct(F.col("row").cast("bigint").alias("word"), F.col("w").cast("double").alias("w"))
    pair = pair if numbers is None else F.when(F.col("row").isNotNull(), pair)  # other words add to the norm alone
    # Sent as rows, to be summed and listed at once where they arrive.
    lists = known.repartition("doc_id").groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).cast("double").alias("square"), F.collect_list(pair).alias("x"))
    return lists.filter(F.size("x") > 0).select("doc_id", "square", F.col("x.word").alias("words"), F.col("x.w").alias("ws"))


def packed_vectors(rows: DataFrame, doc_id: str, vector: str) -> DataFrame:
    """The same of vectors, whose places are words. Null components are left out; an id that several vectors have is
    one row with all their components. Null and empty vectors are left out."""
    known = rows.select(F.col(doc_id).alias("doc_id"), F.transform(F.col(vector).cast("array<double>"), lambda w, i: F.struct(i.cast("bigint").alias("word"), w.alias("w"))).alias("x")).filter(F.size("x") > 0)
    joined = known.groupBy("doc_id").agg(F.filter(F.flatten(F.collect_list("x")), lambda x: x["w"].isNotNull()).alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
    return joined.select("doc_id", square.alias("square"), F.col("x.word").alias("words"), F.col("x.w").alias("ws"))


def word_numbers(queries: DataFrame) -> DataFrame:
    """(word, row): the words of queries, which alone add to a product, numbered."""
    return row_numbers(queries.select(F.col("word").alias("doc_id"))).withColumnRenamed("doc_id", "word")


@dataclass
class _Vectors:
    """The packed vectors of a chunk."""

    ids: np.ndarray
    squares: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    ws: np.ndarray
    key_sizes: np.ndarray | None = None
    keys: np.ndarray | None = None

    @classmethod
    def of(cls, batch: pa.RecordBatch, at: int, prefix: str) -> _Vectors:
        """Of the columns that begin with ``prefix``, in row ``at``."""
        return cls(**{name[len(prefix) :]: batch.column(name)[at].values.to_numpy(zero_copy_only=False) for name in batch.schema.names if name.startswith(prefix)})

    @cached_property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), self.sizes)

    @cached_property
    def shift(self) -> np.ndarray:
        """The powers of two that norms are near to; weights are divided by them, which rounds nothing."""
        with np.errstate(all="ignore"):
            able = np.isfinite(self.squares) & (self.squares > 0)
            return np.where(able, np.frexp(np.sqrt(np.where(able, self.squares, 1.0)))[1], 0)

    @cached_property
    def scaled(self) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.ldexp(self.ws, -self.shift[self.rows])

    @cached_property
    def norms(self) -> np.ndarray:
        """Of the scaled weights; 1 for a zero norm."""
        with np.errstate(all="ignore"):
            return np.where(self.squares > 0, np.ldexp(np.sqrt(self.squares), -self.shift), 1.0)

    @cached_property
    def positive(self) -> bool:
        """Whether no product with such vectors can cancel another."""
        return bool((self.ws >= 0).all())

    @cached_property
    def plain(self) -> bool:
        """Whether products may be added in single precision to tell which pairs can be among the best."""
        usual = (self.squares == 0) | (self.squares > 1e-280) & (self.squares < 1e280)
        return bool(usual.all() and (np.abs(self.scaled) < 1e15).all())


class _Cell:
    """A block of queries, and the best of the vectors that it has met.

    Products of the block's frequent words are those of matrices in single precision, others are added one by one in double
    precision. By their sum, and a bound on its error, most pairs can't be among a query's k best; those that can be are
    multiplied anew in double precision.
    """

    def __init__(self, own: _Vectors, k: int, digits: int, gate: bool, zeros: bool) -> None:
        self.own, self.k, self.digits, self.gate, self.zeros = own, k, digits, gate, zeros
        n = len(own.ids)
        self.vocabulary, at = np.unique(own.words, return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.rows, self.weights = own.rows[order].astype(np.int32), own.scaled[order]
        self.sizes = np.bincount(at, minlength=len(self.vocabulary))
        self.starts = np.cumsum(self.sizes) - self.sizes
        often = np.argsort(-self.sizes, kind="stable")[:MOST_HOT]
        hot = often[self.sizes[often] > HOT * n] if own.plain else often[:0]
        self.column = np.full(len(self.vocabulary), -1)
        self.column[hot] = np.arange(len(hot))
        self.matrix = self.filled(own.rows, self.column[at], own.scaled, n)
        self.single = np.ascontiguousarray(self.matrix.T, np.float32) if own.plain else None
        #: Of a cosine: the sum's error by single precision (some units for each product), and a last place's half.
        self.error, self.half = (len(hot) + 16) * 2.0**-23, 0.51 * 10.0**-digits
        top = int(self.vocabulary[-1]) + 1 if len(self.vocabulary) and 0 <= self.vocabulary[0] and self.vocabulary[-1] < TABLE else 0
        self.table = np.full(top + 1, -1, np.int32) if top else None
        if top:
            self.table[self.vocabulary] = np.arange(len(self.vocabulary))
        if own.keys is not None:
            row = np.repeat(np.arange(n), own.key_sizes)
            order = np.argsort(own.keys, kind="stable")
            self.keys, self.key_starts, self.key_counts = np.unique(own.keys[order], return_index=True, return_counts=True)
            self.key_rows = row[order]
        self.positive, self.plain = own.positive, own.plain
        self.own = _Vectors(own.ids, own.squares, own.sizes, own.words[:0], own.ws[:0], keys=own.keys)  # what is left to be asked for
        self.of, self.found, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(n, -np.inf)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def filled(row: np.ndarray, column: np.ndarray, w: np.ndarray, n: int, width: int | None = None) -> np.ndarray:
        """A matrix of the weights that have a column."""
        width, kept = int(column.max(initial=-1)) + 1 if width is None else width, column >= 0
        return np.bincount(row[kept] * width + column[kept], w[kept], n * width).astype(float, copy=False).reshape(n, width)

    def places(self, words: np.ndarray) -> np.ndarray:
        """Of words in the vocabulary; -1 for others."""
        if self.table is not None and words.min(initial=0) >= 0:
            return self.table[np.minimum(words, len(self.table) - 1)]
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        place = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == words, place, -1)

    def meet(self, other: _Vectors) -> None:
        place, n, nq = self.places(other.words), len(other.ids), len(self.own.ids)
        known = place >= 0
        row, place, w = other.rows[known], place[known], other.scaled[known]
        fast = self.plain and other.plain
        # A matrix has zeros where a word isn't; times what isn't finite they would count.
        column = self.column[place] if fast else np.full(len(place), -1)
        edges, most = np.searchsorted(row, np.arange(n + 1)), max(1, CELLS // nq)
        for a in range(0, n, most):
            b = min(n, a + most)
            own = slice(edges[a], edges[b])
            able = self.sharing(other, a, b) if other.keys is not None and self.own.keys is not None else None
            cold = column[own] < 0
            sums = self.sums(row[own][cold] - a, place[own][cold], w[own][cold], b - a)
            matrix = self.filled(row[own] - a, column[own], w[own], b - a, self.matrix.shape[1]) if fast else None
            self.rank(other, slice(a, b), sums, matrix, able)

    def sharing(self, other: _Vectors, a: int, b: int) -> np.ndarray:
        """(vectors, queries): which share a key."""
        ends = np.concatenate(([0], np.cumsum(other.key_sizes)))
        out = np.zeros((b - a, len(self.own.ids)), bool)
        row, key = np.repeat(np.arange(b - a), other.key_sizes[a:b]), other.keys[ends[a] : ends[b]]
        place = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        known = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
        for at, p in zip(row[known].tolist(), place[known].tolist()):
            out[at, self.key_rows[self.key_starts[p] : self.key_starts[p] + self.key_counts[p]]] = True
        return out

    def sums(self, row: np.ndarray, place: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """(n, queries): products added one by one."""
        nq, out, a = len(self.own.ids), np.empty((n, len(self.own.ids))), 0
        made = np.concatenate(([0], np.cumsum(np.bincount(row, self.sizes[place], n))))
        edges = np.searchsorted(row, np.arange(n + 1))
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(made, made[a] + AT_ONCE, "right")) - 1))
            own = slice(edges[a], edges[b])
            counts = self.sizes[place[own]]
            at = np.repeat(self.starts[place[own]] - np.cumsum(counts) + counts, counts)
            at += np.arange(len(at))
            cell, products = np.repeat((row[own] - a) * nq, counts), np.repeat(w[own], counts)
            cell += np.take(self.rows, at, mode="clip")
            products *= np.take(self.weights, at, mode="clip")
            out[a:b] = np.bincount(cell, products, (b - a) * nq).reshape(b - a, nq)
            a = b
        return out

    def rank(self, other: _Vectors, part: slice, sums: np.ndarray, matrix: np.ndarray | None, among: np.ndarray | None) -> None:
        """Keeps the scores of vectors that may be among the best; ``among`` tells which pairs count."""
        n, (k, own) = len(sums), (self.k, self.own)
        if matrix is not None:
            # Cosines times the norms of the queries' scaled weights; so are those that they are compared with.
            by = 1 / other.norms[part, None]
            left, used = (matrix * by).astype(np.float32), np.flatnonzero(matrix.any(axis=0))
            near = left @ self.single if 2 * len(used) > left.shape[1] else left[:, used] @ self.single[used]
            near += np.multiply(sums, by, dtype=np.float32, casting="same_kind")
            norms, slack = own.norms, (self.error + self.half) * own.norms
        else:
            near, slack = self.scores(sums, own.squares[None, :], other.squares[part, None], own.shift[None, :] + other.shift[part, None]), np.zeros(len(own.ids))
            near = np.where(np.isnan(near), np.inf, near)  # as in SQL, above all
            norms = 1.0
        # With a gate, scores below 0 are 0.
        least = (np.where(self.least <= 0, -np.inf, self.least) if self.gate else self.least) * norms
        able = near >= (least - slack).astype(near.dtype)[None, :]
        if not self.zeros and (least <= slack).any() and (matrix is None or self.positive and other.positive):
            able &= near != 0
        if among is not None:
            able &= among
        if n > 2 * k and np.count_nonzero(able) > 4 * k * near.shape[1]:
            near[~able] = -np.inf
            kth = np.partition(near, n - k, axis=0)[n - k]
            kth = np.where(kth <= slack, -np.inf, kth) if self.gate or not self.zeros else kth
            able &= near >= (kth - 2 * slack).astype(near.dtype)[None, :]
        at, q = np.divmod(np.flatnonzero(able), len(own.ids))
        if not len(q):
            return
        dot = sums[at, q]
        if matrix is not None and matrix.shape[1]:
            for a in range(0, len(q), PAIRS):
                dot[a : a + PAIRS] += np.einsum("ij,ij->i", matrix[at[a : a + PAIRS]], self.matrix[q[a : a + PAIRS]])
        at = at + part.start
        score = self.scores(dot, own.squares[q], other.squares[at], own.shift[q] + other.shift[at])
        kept = np.where(np.isnan(score), np.inf, score) >= self.least[q]
        if not self.zeros:
            kept &= score != 0
        self.waiting.append((q[kept], other.ids[at[kept]], score[kept]))
        if sum(len(x[0]) for x in self.waiting) > 2 * len(own.ids):
            self.merge()

    def scores(self, dot: np.ndarray, a: np.ndarray, b: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            dot, root = np.ldexp(dot, shift), np.sqrt(a * b)
            score = np.where(root == 0, 0.0, dot / root)
            if self.gate:
                score = np.where(dot <= 0, 0.0, score)
            return np.rint(score * 10.0**self.digits) / 10.0**self.digits

    def merge(self) -> None:
        """Joins the scores that wait to the best so far."""
        q, found, score = (np.concatenate(x) for x in zip((self.of, self.found, self.score), *self.waiting))
        self.waiting = []
        best = np.where(np.isnan(score), np.inf, score)
        by = np.lexsort((found, -best, q))
        q, found, score, best = q[by], found[by], score[by], best[by]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.own.ids)))[q]
        self.least[q[place == self.k - 1]] = best[place == self.k - 1]
        kept = place < self.k
        self.of, self.found, self.score = q[kept], found[kept], score[kept]

    def out(self) -> pa.RecordBatch:
        self.merge()
        return pa.RecordBatch.from_arrays([pa.array(self.own.ids[self.of]), pa.array(self.found), pa.array(self.score)], names=["q", "doc_id", "score"])


def chunked(rows: DataFrame, docs: int, words: int, prefix: str) -> DataFrame:
    """A row for each chunk of packed vectors that lie in one partition: at most ``docs``, and ``words`` of all of them."""
    lists = [c for c in ("words", "ws", "keys") if c in rows.columns]

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        columns = {"ids": whole.column("doc_id"), "squares": whole.column("square"), "sizes": whole.column("words").value_lengths()}
        columns |= {"key_sizes": whole.column("keys").value_lengths()} if "keys" in lists else {}
        columns |= {c: whole.column(c).flatten() for c in lists}
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()], names=[prefix + c for c in columns])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, m = [], 0, 0
        for batch in batches:
            ends, a = np.cumsum(np.concatenate(([0], batch.column("words").value_lengths().to_numpy(zero_copy_only=False)))), 0
            while a < batch.num_rows:
                b = min(batch.num_rows, a + docs - n, int(np.searchsorted(ends, ends[a] + words - m, "right")) - 1)
                if b <= a and held:  # full
                    yield joined(held)
                    held, n, m = [], 0, 0
                    continue
                b = max(b, a + 1)
                held.append(batch.slice(a, b - a))
                n, m, a = n + b - a, m + int(ends[b] - ends[a]), b
        if held:
            yield joined(held)

    types = {"ids": "array<bigint>", "squares": "array<double>", "sizes": "array<int>"} | ({"key_sizes": "array<int>"} if "keys" in lists else {}) | {c: dict(rows.dtypes)[c] for c in lists}
    return rows.mapInArrow(pack, ", ".join(f"{prefix}{c} {t}" for c, t in types.items()))


def best(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6, gate: bool = False, zeros: bool = False, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(q, doc_id, score): of all packed ``vectors`` the k largest cosines with each of the packed ``queries``, ties by id.
    ``gate``: products of 0 or less score 0. ``zeros``: scores of 0 count too, as every two vectors share their first place.
    If both have a column ``keys`` of numbers, only pairs that share one count. If both have a number ``near`` below ``NEAR``,
    those of a number are put into the same blocks and chunks: others share few words with them, which takes less time.

    Vectors are written once, in chunks where they lie, and blocks of queries once; each block then reads all chunks, in
    some tasks. So what is written grows with the input alone, while what is read and multiplied grows with its square.
    What a task holds is a block, a chunk and the k best of each of the block's queries.
    """
    spark = queries.sparkSession
    with few_at_once(spark):
        alike = "near" in queries.columns and "near" in vectors.columns
        queries, vectors = cut(queries), cut(chunked(vectors.sortWithinPartitions("near") if alike else vectors, part, WORDS, "v_"), "chunks", **ROW_GROUPS)
    n_q, q_words = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    n_v, chunks = vectors.agg(F.coalesce(F.sum(F.size("v_ids")), F.lit(0)), F.count("*")).first()
    blocks = max(1, ceil(n_q / block), ceil(q_words / BLOCK_WORDS))
    own = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    if alike:  # blocks are parts of the queries in this number's order
        groups, base = [], 0
        for number, n in sorted(map(tuple, queries.groupBy("near").count().collect())):
            groups.append((number, base, n))
            base += n
        queries = queries.join(F.broadcast(spark.createDataFrame(groups, "near int, base bigint, n bigint")), "near")
        place = F.col("base") + F.col("n") * F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        own = F.least(F.floor(place * blocks / max(1, n_q)), F.lit(blocks - 1)).cast("int")
    asked = cut(chunked(queries.repartitionById(blocks, own), n_q or 1, q_words or 1, "q_").withColumn("block", F.spark_partition_id()))
    streams = max(1, min(chunks, max(ceil(3 * spark.sparkContext.defaultParallelism / blocks), ceil(n_v / STREAM))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, _Cell] = {}
        pa.default_memory_pool().release_unused()  # of earlier tasks
        for batch in batches:
            for at in range(batch.num_rows):
                i = batch.column("block")[at].as_py()
                if i not in cells:
                    cells[i] = _Cell(_Vectors.of(batch, at, "q_"), k, digits, gate, zeros)
                cells[i].meet(_Vectors.of(batch, at, "v_"))
        for cell in cells.values():
            yield cell.out()

    every = vectors.coalesce(streams).crossJoin(asked.repartitionById(blocks, F.col("block")).hint("shuffle_replicate_nl"))
    # A task's block is one, and comes with its first chunk.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    every = every.select("block", *vectors.columns, *(F.when(first, F.col(c)).alias(c) for c in asked.columns if c != "block"))
    with few_at_once(spark):
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "2")  # chunks
        found = cut(every.mapInArrow(search, "q bigint, doc_id bigint, score double"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).drop("rn")
