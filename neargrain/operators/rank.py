"""Ranks of labels from the neighbours, and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neargrain.functions import ratio
from neargrain.sources import cut

WEIGHTS = (3.4, 0.6, 0.8, 0.2)
ALPHA = 0.76


def label_features(entries: DataFrame, psums: DataFrame, counts: DataFrame, per_occurrence: bool = False, logs: bool = False) -> DataFrame:
    """(q, label, x1..x4): the largest score, the sum of the parents' children, the sum of scores,
    and the number of entries per occurrence of the label in the corpus.

    Scores are rounded already; their sum is rounded so that it doesn't depend on their order.
    ``per_occurrence`` counts the parents' children once for each entry; ``logs`` takes natural
    logarithms (null where a feature is 0)."""
    grouped = entries.groupBy("q", "label").agg(F.max("score").alias("x1"), F.round(F.sum("score"), 9).alias("x3"), F.count("*").alias("n"))
    # Written, so that its size is known, and the many rows of queries aren't shuffled by label for a small table.
    by_label = cut(counts.select(F.col("key").alias("label"), "cnt").join(psums, "label", "full_outer"), "labels")
    joined = grouped.join(by_label, "label", "left")
    x2 = F.coalesce("psum", F.lit(0)) * (F.col("n") if per_occurrence else F.lit(1))
    columns = {"x1": F.col("x1"), "x2": x2.cast("double"), "x3": F.col("x3"), "x4": ratio(F.col("n"), F.coalesce("cnt", F.lit(0)))}
    return joined.select("q", "label", *[(F.log(F.nullif(c, F.lit(0.0))) if logs else c).alias(x) for x, c in columns.items()])


def ranks(features: DataFrame, w: tuple[float, float, float, float] = WEIGHTS) -> DataFrame:
    """(q, label, x1..x4, rank): the weighted sum of the features."""
    total = sum((F.lit(float(wi)) * F.col(f"x{i}") for i, wi in enumerate(w[1:], 2)), F.lit(float(w[0])) * F.col("x1"))
    return features.withColumn("rank", F.round(total, 9))


def predict(ranked: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(q, label): labels whose rank is more than ``alpha`` of the query's highest."""
    top = F.max("rank").over(Window.partitionBy("q"))
    return ranked.withColumn("part", F.try_divide("rank", top)).filter(F.col("part") > alpha).select("q", "label")


def predict_or_common(ranked: DataFrame, queries: DataFrame, counts: DataFrame, alpha: float = ALPHA, n: int = 2) -> DataFrame:
    """The same as ``with_fallback`` of ``predict``, for queries that ``ranked`` has no others than; it is made once,
    and its rows stay where a query's rows lie together."""
    common = counts.orderBy(F.desc("cnt"), "key").limit(n).agg(F.collect_list("key").alias("common"))  # n labels
    grouped = ranked.groupBy("q").agg(F.max("rank").alias("top"), F.collect_list(F.struct("label", "rank")).alias("labels"))
    said = F.transform(F.filter("labels", lambda x: F.try_divide(x["rank"], F.col("top")) > alpha), lambda x: x["label"])
    every = queries.select(F.col("doc_id").alias("q")).distinct().join(grouped.select("q", said.alias("labels")), "q", "left")
    return every.join(F.broadcast(common), F.lit(True)).select("q", F.explode(F.coalesce("labels", "common")).alias("label"))


def with_fallback(predicted: DataFrame, ranked: DataFrame, queries: DataFrame, counts: DataFrame, n: int = 2) -> DataFrame:
    """Predictions, and for queries without any rank the n most common labels (ties by label)."""
    common = counts.orderBy(F.desc("cnt"), "key").limit(n).agg(F.collect_list("key").alias("labels"))  # n labels
    without = queries.select(F.col("doc_id").alias("q")).distinct().join(ranked.select("q").distinct(), "q", "left_anti")
    return predicted.unionByName(without.join(F.broadcast(common), F.lit(True)).select("q", F.explode("labels").alias("label")))
