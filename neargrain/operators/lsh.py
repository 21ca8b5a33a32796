"""Approximate nearest neighbours of sparse vectors by signed random projections.

A vector's key in a table is the signs of its products with random vectors of +1 and -1, which are
hashes of words. Queries also look where the signs that are nearest to changing differ. What is found
is ranked by exact cosines. Projections are plain sums over words, in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neargrain.functions import cosine
from neargrain.operators import blocks, pairs
from neargrain.operators.weights import squares
from neargrain.sources import cut

#: Tables, signs of a key, and signs of a query of which one or two are changed for further keys.
TABLES, SIGNS, NEAREST = 16, 8, 5


def projections(vectors: DataFrame, tables: int = TABLES, signs: int = SIGNS, seed: int = 0) -> DataFrame:
    """(doc_id, sums): the products of each vector (doc_id, word, w) with tables * signs random ones."""
    n = tables * signs
    words = -(-n // 64)
    rows = vectors.select("doc_id", F.col("w").cast("double").alias("w"), *[F.xxhash64("word", F.lit(seed * 1000 + i)).alias(f"h{i}") for i in range(words)])
    plus = lambda b: F.shiftright(f"h{b // 64}", b % 64).bitwiseAND(F.lit(1)) == 1
    sums = [F.sum(F.when(plus(b), F.col("w")).otherwise(-F.col("w"))).alias(f"s{b}") for b in range(n)]
    return rows.groupBy("doc_id").agg(*sums).select("doc_id", F.array(*[f"s{b}" for b in range(n)]).alias("sums"))


def _table_sums(projected: DataFrame, tables: int, signs: int) -> DataFrame:
    """(doc_id, table, own): a row for each table, with its sums and the place of each."""
    own = lambda t: F.transform(F.slice("sums", t * signs + 1, signs), lambda s, i: F.struct(F.abs(s).alias("margin"), i.alias("bit"), (s >= 0).alias("up")))
    return projected.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.struct(t.alias("table"), own(t).alias("own")))).alias("x")).select("doc_id", "x.table", "x.own")


def keys(projected: DataFrame, tables: int = TABLES, signs: int = SIGNS) -> DataFrame:
    """(doc_id, table, key) of projections."""
    rows = _table_sums(projected, tables, signs)
    return rows.select("doc_id", "table", _bits("own").alias("key"))


def _bits(own: str):
    """The number whose bits are the signs."""
    return F.aggregate(own, F.lit(0).cast("bigint"), lambda k, s: k + F.when(s["up"], F.pow(F.lit(2.0), s["bit"]).cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def probes(projected: DataFrame, tables: int = TABLES, signs: int = SIGNS, nearest: int = NEAREST) -> DataFrame:
    """(doc_id, table, key): the keys of projections, and those with one or two of the ``nearest``
    signs changed."""
    rows = _table_sums(projected, tables, signs).withColumn("key", _bits("own"))
    flip = F.transform(F.slice(F.array_sort("own"), 1, nearest), lambda s: F.when(s["up"], -1).otherwise(1) * F.pow(F.lit(2.0), s["bit"]).cast("bigint"))
    changes = rows.withColumn("flip", flip)
    twos = F.flatten(F.transform("flip", lambda x, i: F.transform(F.filter("flip", lambda y, j: j > i), lambda y: x + y)))
    every = F.concat(F.array(F.lit(0).cast("bigint")), F.col("flip"), twos)
    return changes.select("doc_id", "table", F.explode(every).alias("change"), "key").select("doc_id", "table", (F.col("key") + F.col("change")).alias("key"))


def candidates(queries: DataFrame, vectors: DataFrame, tables: int = TABLES, signs: int = SIGNS, nearest: int = NEAREST, seed: int = 0) -> DataFrame:
    """(q, doc_id) of queries and the other vectors that share a key of a table. Keys that very many
    have are split into cells, like hot words."""
    word = F.struct("table", "key").alias("word")
    asked = cut(probes(projections(queries, tables, signs, seed), tables, signs, nearest).select(F.col("doc_id").alias("q"), word))
    held = cut(keys(projections(vectors, tables, signs, seed), tables, signs).select("doc_id", word))
    found = pairs.joined(asked, held, pairs.grid(asked, held))
    return found.filter("q <> doc_id").select("q", "doc_id").distinct()


def exact(found: DataFrame, queries: DataFrame, vectors: DataFrame, digits: int = 6) -> DataFrame:
    """(q, doc_id, score): the cosines of pairs, from all their words."""
    by_q = squares(queries).select(F.col("doc_id").alias("q"), F.col("square").alias("q_square"))
    by_t = squares(vectors).select("doc_id", "square")
    q = queries.select(F.col("doc_id").alias("q"), "word", F.col("w").alias("qw"))
    sums = pairs.dots(found.join(q, "q").join(vectors.select("doc_id", "word", F.col("w").alias("tw")), ["doc_id", "word"]))
    return sums.join(by_q, "q").join(by_t, "doc_id").select("q", "doc_id", F.round(cosine("dot", "q_square", "square"), digits).alias("score"))


def _keyed(vectors: DataFrame, known: DataFrame, signs: int) -> DataFrame:
    """Packed vectors with their keys (doc_id, table, key) of all tables as numbers."""
    number = F.col("table").cast("bigint") * (1 << signs) + F.col("key")
    return blocks.packed(vectors).join(known.groupBy("doc_id").agg(F.collect_list(number).alias("keys")), "doc_id")


def neighbours(queries: DataFrame, vectors: DataFrame, k: int = 10, digits: int = 6, tables: int = TABLES, signs: int = SIGNS, nearest: int = NEAREST, seed: int = 0) -> DataFrame:
    """(q, rnk, doc_id, score): of what shares a key the k largest cosines other than 0, ties by id. Vectors
    without a word have no neighbours.

    Keys go along with whole vectors to where blocks of queries meet parts of all vectors: short keys are shared
    by most pairs, which as rows, let alone as a row for each word, would be far more than all vectors.
    """
    asked = probes(projections(queries, tables, signs, seed), tables, signs, nearest)
    held = keys(projections(vectors, tables, signs, seed), tables, signs)
    found = blocks.best(_keyed(queries, asked, signs), _keyed(vectors, held, signs), k + 1, digits).filter("q <> doc_id")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= k).select("q", "rnk", "doc_id", "score")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (wanted, found, recall): of the rows (q, doc_id) of ``truth`` those that were found."""
    hit = truth.select("q", "doc_id").join(found.select("q", "doc_id").withColumn("hit", F.lit(1)), ["q", "doc_id"], "left")
    sums = hit.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return sums.withColumn("recall", F.coalesce(F.try_divide("found", "wanted"), F.lit(1.0)))
