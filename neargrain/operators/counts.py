"""Counts of labels and words, pruning by counts, and reports on counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_counts(doc_labels: DataFrame) -> DataFrame:
    """(key, cnt); a label that a document has twice counts twice."""
    return doc_labels.groupBy(F.col("label").alias("key")).agg(F.count("*").alias("cnt"))


def word_counts(postings: DataFrame, binary: bool = False) -> DataFrame:
    """(key, cnt): how often words occur, or in how many documents."""
    return postings.groupBy(F.col("word").alias("key")).agg((F.count("*") if binary else F.sum("tf")).cast("bigint").alias("cnt"))


def label_totals(doc_labels: DataFrame) -> DataFrame:
    """(total_count, d): occurrences and distinct labels."""
    # Partial counts first: distinct labels are counted on one row per label.
    return label_counts(doc_labels).agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("total_count"), F.count("*").alias("d"))


def word_totals(postings: DataFrame) -> DataFrame:
    """(total_count, d): pairs of document and word, and distinct words; the total is of pairs
    for both kinds of word counts."""
    return word_counts(postings, binary=True).agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("total_count"), F.count("*").alias("d"))


def document_total(postings: DataFrame) -> DataFrame:
    """(total_count): documents that have words; a ceiling on document frequencies is a share of it."""
    return postings.agg(F.count_distinct("doc_id").alias("total_count"))


def prune(counts: DataFrame, totals: DataFrame, no_below: int = 0, no_above: float = 1.0, max_n: int | None = None) -> DataFrame:
    """The (key, cnt) with no_below <= cnt <= no_above * total_count; of these the ``max_n`` most
    common, ties by key. The ceiling is that of the totals before pruning (one row)."""
    kept = counts.join(F.broadcast(totals.select("total_count")), (F.col("cnt") >= no_below) & (F.col("cnt") <= F.lit(float(no_above)) * F.col("total_count"))).select("key", "cnt")
    return kept if max_n is None else kept.orderBy(F.desc("cnt"), "key").limit(max_n)


def prune_corpus(postings: DataFrame, doc_labels: DataFrame, labels: DataFrame | None = None, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables without the labels and words that aren't kept, and without documents that
    have no label or no word left; None keeps all. Both sides stay aligned by doc_id."""
    if labels is not None:
        doc_labels = doc_labels.join(labels.select(F.col("key").alias("label")), "label", "left_semi").select("doc_id", "pos", "label")
    if words is not None:
        postings = postings.join(words.select(F.col("key").alias("word")), "word", "left_semi").select("doc_id", "word", "tf")
    return postings.join(doc_labels.select("doc_id").distinct(), "doc_id", "left_semi"), doc_labels.join(postings.select("doc_id").distinct(), "doc_id", "left_semi")


def top_terms(counts: DataFrame, totals: DataFrame, n: int = 100) -> DataFrame:
    """(key, cnt, share) of the most common keys."""
    top = counts.orderBy(F.desc("cnt"), "key").limit(n)
    return top.join(F.broadcast(totals), F.lit(True)).select("key", "cnt", (F.col("cnt") / F.col("total_count")).alias("share"))


def cdf_ranks(counts: DataFrame, percents: tuple[int, ...] = (50, 80, 90, 95)) -> DataFrame:
    """(percent, rank): the first 0-based rank, keys sorted by falling count, at which the running
    share of all counts is above a percentage.

    Keys of equal count make equal steps, so the running sum goes over distinct counts (about
    the square root of the total, at most), never over the vocabulary.
    """
    steps = counts.groupBy("cnt").agg(F.count("*").alias("m"))
    order = Window.orderBy(F.desc("cnt"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    run = steps.select("cnt", "m", F.coalesce(F.sum(F.col("cnt") * F.col("m")).over(before), F.lit(0)).alias("b"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("r"))
    total = steps.agg(F.sum(F.col("cnt") * F.col("m")).alias("total"))
    wanted = run.join(F.broadcast(total), F.lit(True)).withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    # The least j >= 1 with 100 * (b + j * cnt) > percent * total, if a step of this count has it.
    j = F.greatest(F.expr("floor((percent * total - 100 * b) / (100 * cnt))").cast("bigint") + 1, F.lit(1))
    crossed = wanted.withColumn("j", j).filter("j <= m and 100 * (b + j * cnt) > percent * total")
    return crossed.groupBy("percent").agg(F.min(F.col("r") + F.col("j") - 1).cast("bigint").alias("rank"))
