"""Sets of documents as bitmaps: a row of 4 KB for each key and 32,768 consecutive numbers.

Documents are numbered without gaps (``split.row_numbers``). Sets are made, united and counted
by Spark's bitmap aggregates. They pay where keys have many documents of each bucket; a key with one
document in a bucket still takes the whole 4 KB there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_sets(rows: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """(key, bucket, bits) of rows (doc_id, key), in which a document may be repeated."""
    row = rows.select("doc_id", key).join(numbers, "doc_id")
    return row.groupBy(key, F.bitmap_bucket_number("row").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits"))


def union(*sets: DataFrame, by: str | None = None) -> DataFrame:
    """Sets united: those of each key, or of all keys."""
    every = sets[0]
    for more in sets[1:]:
        every = every.unionByName(more)
    return every.groupBy(*([by] if by else []), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def sizes(sets: DataFrame, *by: str, name: str = "n") -> DataFrame:
    """The number of documents in the set of each key, or in all."""
    return sets.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name))


def confusion(predicted: DataFrame, truth: DataFrame, numbers: DataFrame) -> DataFrame:
    """(label, tp, fp, fn) over sets of (q, label): what both have is what their sizes have more than
    their union's."""
    named = lambda rows: document_sets(rows.select(F.col("q").alias("doc_id"), "label"), numbers, "label")
    p, t = named(predicted), named(truth)
    both = sizes(union(p, t, by="label"), "label", name="either")
    n = lambda c: F.coalesce(c, F.lit(0))
    counts = both.join(sizes(p, "label", name="said"), "label", "left").join(sizes(t, "label", name="so"), "label", "left")
    tp = n("said") + n("so") - F.col("either")
    return counts.select("label", tp.alias("tp"), (n("said") - tp).alias("fp"), (n("so") - tp).alias("fn"))
