"""Confusion counts for each category, and macro averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neargrain.functions import ratio


def confusion(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(label, tp, fp, fn) over sets of (q, label)."""
    p = predicted.select("q", "label").distinct().withColumn("said", F.lit(1))
    t = truth.select("q", "label").distinct().withColumn("so", F.lit(1))
    both = p.join(t, ["q", "label"], "full_outer")
    count = lambda condition: F.count_if(condition).alias
    said, so = F.col("said").isNotNull(), F.col("so").isNotNull()
    return both.groupBy("label").agg(count(said & so)("tp"), count(said & ~so)("fp"), count(~said & so)("fn"))


def category_rates(cells: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, p, r): precision and recall, 0 where nothing was predicted or true."""
    return cells.withColumns({"p": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "r": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def macro(cells: DataFrame) -> DataFrame:
    """One row (map, mar, maf): means of precision and recall over categories that are predicted
    or true, and their harmonic mean; all 0 without categories."""
    means = category_rates(cells).agg(F.coalesce(F.avg("p"), F.lit(0.0)).alias("map"), F.coalesce(F.avg("r"), F.lit(0.0)).alias("mar"))
    return means.withColumn("maf", ratio(2 * F.col("map") * F.col("mar"), F.col("map") + F.col("mar")))
