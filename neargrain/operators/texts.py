"""Texts as packed vectors (see ``blocks``), without a row for each word that a document has.

A task cuts the texts that it has read into words in place, and numbers the words of some MB of text. Only these small
vocabularies are sent to be counted and numbered alike everywhere, and back to the lists of words, which are sent once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neargrain.sources import cut, few_at_once

#: Bytes of text that share a vocabulary.
BYTES = 1 << 24

_LISTS = "part bigint, doc_id bigint, near int, words array<int>, counts array<int>, word string, code int, n bigint"


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())


def _listed(part: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part's documents and of its vocabulary."""
    texts = pa.Table.from_batches(held).combine_chunks()
    words = pc.split_pattern_regex(texts.column("text"), "[^a-z0-9]+").combine_chunks()
    row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    filled = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    code, number = coded.indices.to_numpy(zero_copy_only=False), np.cumsum(filled) - 1
    kept = filled[code] if len(filled) else np.zeros(0, bool)
    key, counts = np.unique(row[kept] << 32 | number[code[kept]], return_counts=True)
    row, code = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
    sizes = np.bincount(row, minlength=len(words))
    some = sizes > 0
    (ids, near), ends = (texts.column(c).combine_chunks().filter(pa.array(some)) for c in ("doc_id", "near")), _ends(sizes[some])
    vocabulary = coded.dictionary.filter(pa.array(filled))
    none = lambda n, kind: pa.nulls(n, kind)
    lists, names = pa.list_(pa.int32()), [c.split()[0] for c in _LISTS.split(", ")]
    for n, columns in (
        (len(ids), (ids, near, pa.ListArray.from_arrays(ends, pa.array(code)), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())), none(len(ids), pa.string()), none(len(ids), pa.int32()), none(len(ids), pa.int64()))),
        (n := len(vocabulary), (none(n, pa.int64()), none(n, pa.int32()), none(n, lists), none(n, lists), vocabulary, pa.array(np.arange(n), pa.int32()), pa.array(np.bincount(code, minlength=n), pa.int64()))),
    ):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), *columns], names=names)


def lists(texts: DataFrame, size: int | None = None) -> DataFrame:
    """Of texts (doc_id, text, near), whose ids differ, two kinds of rows: (part, doc_id, near, words, counts) with the numbers that
    words have in a part, and (part, word, code, n), the vocabularies, with the part's documents that have the word."""
    size = BYTES if size is None else size

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            n += batch.nbytes
            if n >= size:
                yield from _listed(part, held)
                part, held, n = part + 1, [], 0
        if held:
            yield from _listed(part, held)

    lower = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.lower("text"), F.lit("")).alias("text"), "near")
    with few_at_once(texts.sparkSession):
        return cut(lower.mapInArrow(parts, _LISTS), "lists")


def vectors(listed: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, near, asked, square, words, ws) of ``lists``: packed by tf-idf, ln(tf + 1) * ln(N / df), and whether ``asked`` (doc_id)
    has the document. Of these the second factor is squared in ``ws``, others are without it: products are the same,
    and a vector's weights are few different numbers, which take little room. Squared norms are those of the weights.
    """
    docs = listed.filter("word is null").select("part", "doc_id", "near", "words", "counts")
    total = docs.count()
    per = Window.partitionBy("word")
    terms = listed.filter("word is not null").select("part", "word", "code", "n").repartition("word").withColumn("at", F.monotonically_increasing_id())
    terms = cut(terms.select("part", "code", F.min("at").over(per).alias("at"), F.sum("n").over(per).alias("df")), "terms")  # numbered once
    place, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    places, most = terms.agg(F.coalesce(F.max(place), F.lit(0)) + 1, F.coalesce(F.max(within), F.lit(0)) + 1).first()
    kind = "int" if places * most < 1 << 31 else "bigint"
    none, no_list = lambda kind: F.lit(None).cast(kind), F.array().cast("array<int>")
    known = docs.select("part", "doc_id").join(asked.select("doc_id").distinct().withColumn("is", F.lit(1)), "doc_id", "left")
    # One number to sort by, which Spark does without comparing rows.
    key = lambda kind: (F.col("part") * 4 + kind).alias("key")
    rows = known.select(key(0), F.col("doc_id").alias("a"), F.coalesce("is", F.lit(0)).alias("b"), none("bigint").alias("df"), no_list.alias("words"), no_list.alias("counts"))
    rows = rows.unionAll(terms.select(key(1), within * places + place, "code", "df", no_list, no_list))
    rows = rows.unionAll(docs.select(key(2), "doc_id", "near", none("bigint"), "words", "counts"))
    word_type = pa.int32() if kind == "int" else pa.int64()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, ready = None, [[], []], False
        for batch in batches:
            key = batch.column("key").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else [0]
            for a, b in zip(edges, edges[1:]):
                own, kind = batch.slice(a, b - a), int(key[a] % 4)
                if key[a] // 4 != part:
                    part, held, ready = key[a] // 4, [[], []], False
                if kind < 2:
                    held[kind].append([own.column(c).to_numpy(zero_copy_only=False) for c in (("a", "b") if kind == 0 else ("a", "b", "df"))])
                    continue
                if not ready:
                    (ids, flags), (numbers, codes, df) = ([np.concatenate(x) for x in zip(*rows)] for rows in held)
                    by = np.argsort(ids)
                    ids, flags, by = ids[by], flags[by].astype(bool), np.argsort(codes)
                    numbers, idf = numbers[by], np.log(float(total) / df[by])
                    ready = True
                sizes = own.column("words").value_lengths().to_numpy(zero_copy_only=False)
                code, tf = (own.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("words", "counts"))
                row, w, rarity = np.repeat(np.arange(b - a), sizes), np.log(tf + 1.0), idf[code]
                is_asked = flags[np.searchsorted(ids, own.column("a").to_numpy())]
                square = np.bincount(row, (w * rarity) ** 2, b - a)
                ws = np.where(is_asked[row], w * rarity * rarity, w)
                ends = _ends(sizes)
                columns = [own.column("a"), own.column("b"), pa.array(is_asked), pa.array(square), pa.ListArray.from_arrays(ends, pa.array(numbers[code], word_type)), pa.ListArray.from_arrays(ends, pa.array(ws))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "near", "asked", "square", "words", "ws"])

    sent = rows.repartition(F.shiftright("key", 2)).sortWithinPartitions("key").mapInArrow(weigh, f"doc_id bigint, near int, asked boolean, square double, words array<{kind}>, ws array<double>")
    with few_at_once(listed.sparkSession):
        return cut(sent, "vectors")
