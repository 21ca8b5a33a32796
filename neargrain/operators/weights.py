"""Term weights and norms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neargrain.functions import tf_idf
from neargrain.operators.counts import word_counts


def raw_weights(postings: DataFrame) -> DataFrame:
    """Counts as weights; whole numbers keep dot products exact."""
    return postings.select("doc_id", "word", F.col("tf").alias("w"))


def weights(postings: DataFrame, narrow: bool = False) -> DataFrame:
    """(doc_id, word, w): ln(tf + 1) * ln(N / df), N the documents that have words."""
    n = postings.agg(F.count_distinct("doc_id").alias("n"))
    frequencies = word_counts(postings, binary=True).select(F.col("key").alias("word"), F.col("cnt").alias("df"))
    joined = postings.join(frequencies, "word").join(F.broadcast(n), F.lit(True))
    return joined.select("doc_id", "word", tf_idf("tf", "df", F.col("n"), narrow).alias("w"))


def squares(weighted: DataFrame) -> DataFrame:
    """(doc_id, square, size): squared norm and number of words."""
    return weighted.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("square"), F.count("*").alias("size"))


def norms(weighted: DataFrame, log: bool = False) -> DataFrame:
    """(doc_id, norm): the L2 norm, or its logarithm (null for a zero norm)."""
    root = F.sqrt(F.col("square").cast("double"))
    return squares(weighted).select("doc_id", (F.log(F.nullif(root, F.lit(0.0))) if log else root).alias("norm"))
