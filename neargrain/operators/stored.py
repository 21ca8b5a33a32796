"""An inverted index that is stored: lists of document numbers by word and block, in buckets of words.

Searches of later batches of queries read the lists where they lie: only the queries are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neargrain.functions import cosine
from neargrain.operators.split import row_numbers
from neargrain.operators.weights import squares
from neargrain.sources import cut
from neargrain.sources.state import StaleState, drop_manifest, read_manifest, write_manifest

#: Documents of a block, and buckets of words.
BLOCK_DOCS, BUCKETS = 1 << 16, 64
#: Training documents, in multiples of k, that a query's rarest words reach before blocks are passed over.
SEED = 4
#: Entries of lists that are decoded together.
ENTRIES = 1 << 20


@dataclass(frozen=True)
class StoredIndex:
    """``lists`` (word, block, n, most, gaps, weights, squares): of the documents of a block that have a word,
    their numbers as differences, the first to the block's first, in order; their weights and squared norms; and the
    largest part that a weight has of its document's norm. ``docs`` (row, doc_id, square): numbers of documents
    in the order of ids. ``words`` (word, n, most): the same of all blocks together."""

    lists: DataFrame
    docs: DataFrame
    words: DataFrame
    block_docs: int


def write_index(weighted: DataFrame, folder: str, buckets: int = BUCKETS, block_docs: int = BLOCK_DOCS) -> StoredIndex:
    """Stores the index of (doc_id, word, w) in ``folder``; a list has ``block_docs`` entries at most,
    however frequent its word is. The folder's manifest is written last."""
    spark = weighted.sparkSession
    drop_manifest(spark, folder)
    numbered = row_numbers(weighted).join(squares(weighted).select("doc_id", "square"), "doc_id")
    numbered.write.mode("overwrite").parquet(f"{folder}/docs")
    docs = spark.read.parquet(f"{folder}/docs")
    rows = weighted.join(docs, "doc_id").withColumns({"block": F.floor(F.col("row") / block_docs), "place": (F.col("row") % block_docs).cast("int")})
    part = F.coalesce(F.try_divide(F.col("w").cast("double"), F.sqrt(F.col("square").cast("double"))), F.lit(0.0))
    lists = rows.groupBy("word", "block").agg(F.count("*").alias("n"), F.max(part).alias("most"), F.array_sort(F.collect_list(F.struct("place", "w", "square"))).alias("list"))
    places = F.col("list.place")
    gaps = F.zip_with(places, F.concat(F.array(F.lit(0)), F.slice(places, 1, F.size(places) - 1)), lambda a, b: a - b)
    shaped = lists.select("word", "block", "n", "most", gaps.alias("gaps"), F.col("list.w").alias("weights"), F.col("list.square").cast("array<double>").alias("squares"))
    name = f"neargrain_{uuid.uuid4().hex}"
    # One task for each bucket, so that a bucket is one file.
    shaped.repartition(buckets, "word").write.bucketBy(buckets, "word").sortBy("word", "block").option("path", f"{folder}/lists").mode("overwrite").saveAsTable(name)
    spark.table(name).groupBy("word").agg(F.sum("n").alias("n"), F.max("most").alias("most")).write.mode("overwrite").parquet(f"{folder}/words")
    write_manifest(spark, folder, {"buckets": buckets, "block_docs": block_docs, "schema": [[f.name, f.dataType.simpleString()] for f in spark.table(name).schema]})
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> StoredIndex:
    """An index that was stored, also by another session: the table's buckets are declared anew."""
    found = read_manifest(spark, folder)
    if found is None:
        raise StaleState(f"the index in {folder} isn't complete")
    name = f"neargrain_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{c}` {kind}" for c, kind in found["schema"])
    place = f"{folder}/lists".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (word) SORTED BY (word, block) INTO {int(found['buckets'])} BUCKETS LOCATION '{place}'")
    return StoredIndex(spark.table(name), spark.read.parquet(f"{folder}/docs"), spark.read.parquet(f"{folder}/words"), found["block_docs"])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose lists have about so many entries together."""
    if not batch.num_rows:
        return
    sizes = batch.column("gaps").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // ENTRIES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def _numbers(batch: pa.RecordBatch, block_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, document number, weight) of the lists of a batch, one after the other."""
    gaps, weights = batch.column("gaps"), batch.column("weights")
    sizes = gaps.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    entry = np.repeat(np.arange(len(sizes)), sizes)
    run = np.cumsum(gaps.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    before = np.concatenate(([0], run))[np.cumsum(sizes) - sizes]
    return entry, run - before[entry] + batch.column("block").to_numpy()[entry] * block_docs, weights.flatten().to_numpy(zero_copy_only=False)


def decoded(index: StoredIndex) -> DataFrame:
    """(doc_id, word, w): the rows that the index was made of."""
    kind, w = index.lists.schema["word"].dataType.simpleString(), index.lists.schema["weights"].dataType.elementType.simpleString()
    block_docs = index.block_docs

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                entry, row, weight = _numbers(batch, block_docs)
                yield pa.RecordBatch.from_arrays([pa.array(row), batch.column("word").take(pa.array(entry)), pa.array(weight)], names=["row", "word", "w"])

    rows = index.lists.select("word", "block", "gaps", "weights").mapInArrow(expand, f"row bigint, word {kind}, w {w}")
    return rows.join(index.docs.select("row", "doc_id"), "row").select("doc_id", "word", "w")


def _scored(found: DataFrame, block_docs: int, kind: str) -> DataFrame:
    """(q, row, score) of queries' words joined with lists. Squared norms go along, so entries are shuffled once, to their
    query, where its rows then lie together."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                entry, row, weight = _numbers(batch, block_docs)
                of = lambda c: batch.column(c).to_numpy()[entry]
                columns = [of("q"), of("q_square"), row, batch.column("squares").flatten(), weight * of("qw")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "q_square", "row", "square", "dot"])

    terms = found.select("q", F.col("q_square").cast("double").alias("q_square"), "qw", "block", "gaps", "weights", "squares")
    rows = terms.mapInArrow(add, f"q bigint, q_square double, row bigint, square double, dot {kind}")
    sums = rows.repartition("q").groupBy("q", "q_square", "row", "square").agg(F.sum("dot").alias("dot"))
    return sums.select("q", "row", cosine("dot", "q_square", "square").alias("score"))


def search(index: StoredIndex, queries: DataFrame, k: int, digits: int = 9, seed: int = SEED) -> DataFrame:
    """(q, rnk, doc_id, score): the k documents of the largest cosines above 0 with each of
    ``queries`` (doc_id, word, w), ties by id; weights must not be negative.

    The lists of a query's rarest words, which have ``seed`` * k documents at least, give a bound that
    the k best reach; where these are all its words, there is none. A block whose documents can't reach it, by the largest parts that its
    lists have, is passed over with all its lists. Lists are joined by word in the buckets in which
    they are stored.
    """
    margin = 2.0 * 10**-digits
    q = queries.select(F.col("doc_id").alias("q"), "word", F.col("w").alias("qw"))
    kind = "double" if dict(queries.dtypes)["w"] in ("double", "float") or index.lists.schema["weights"].dataType.elementType.simpleString() in ("double", "float") else "bigint"
    q = cut(q.withColumn("qw", F.col("qw").cast(kind)))  # a batch
    norms = cut(q.groupBy("q").agg(F.sum(F.col("qw") * F.col("qw")).alias("q_square")))
    before = Window.partitionBy("q").orderBy("n", "word").rowsBetween(Window.unboundedPreceding, -1)
    terms = q.join(index.words.select("word", "n"), "word").join(norms, "q")
    terms = cut(terms.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))

    # A query whose lists are all among its rarest needs no bound: it reads them all.
    last = Window.partitionBy("q")
    large = cut(terms.withColumn("most_before", F.max("before").over(last)).filter(F.col("most_before") >= seed * k).drop("most_before"))
    seeds = _scored(large.filter(F.col("before") < seed * k).join(index.lists, "word"), index.block_docs, kind)
    order = Window.partitionBy("q").orderBy(F.desc("score"))
    kth = cut(seeds.filter("score > 0").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") == k).select("q", (F.col("score") - margin).alias("least")))
    adds = F.coalesce(F.try_divide(F.col("qw").cast("double") * F.col("most"), F.sqrt(F.col("q_square").cast("double"))), F.lit(0.0))
    able = terms.join(index.lists.select("word", "block", "most"), "word").groupBy("q", "block").agg(F.sum(adds).alias("bound"))
    able = cut(able.join(kth, "q", "left").filter(F.col("bound") >= F.coalesce("least", F.lit(0.0))).select("q", "block"))
    found = terms.join(index.lists, "word").join(able, ["q", "block"], "left_semi")
    # Documents are numbered in the order of their ids.
    best = Window.partitionBy("q").orderBy(F.desc("score"), "row")
    ranked = _scored(found, index.block_docs, kind).withColumn("score", F.round("score", digits)).filter("score > 0")
    ranked = ranked.withColumn("rnk", F.row_number().over(best)).filter(F.col("rnk") <= k)
    return ranked.join(index.docs.select("row", "doc_id"), "row").select("q", "rnk", "doc_id", "score")
