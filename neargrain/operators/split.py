"""Training and validation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neargrain.functions import share
from neargrain.sources import cut


def _picks(doc_labels: DataFrame, k: Column, mode: str, seed: int) -> DataFrame:
    """(doc_id, label) that are picked: of a label's rows the last k by document
    (``tail``), or k by a hash of document and label (``random``).

    A label may hold a large part of all rows: rows are counted per slice of the order first, and
    only the slice of a label in which the k-th row lies is ranked.
    """
    if mode not in ("tail", "random"):
        raise ValueError(f"no such mode: {mode}")
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "label", F.lit(seed))), 1, 15), 16, 10).cast("bigint")  # 60 bits
    rows = doc_labels.withColumn("at", F.col("doc_id") if mode == "tail" else drawn)
    bounds = rows.approxQuantile("at", [i / 64 for i in range(1, 64)], 0.002) if mode == "tail" else [i / 64 * 2.0**60 for i in range(64)]
    rows = rows.withColumn("slice", F.size(F.filter(F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]), lambda b: b <= F.col("at"))))
    counts = rows.groupBy("label", "slice").agg(F.count("*").alias("n"))
    above = Window.partitionBy("label").orderBy(F.desc("slice"))  # 64 rows a label at most
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("label")))
    counts = counts.withColumn("left", k - F.col("before")).filter("left > 0").select("label", "slice", "n", "left")
    found = rows.join(cut(counts, "slices"), ["label", "slice"])  # written, so that its size is known: few rows beside the others
    ranked = found.filter("left < n").withColumn("rn", F.row_number().over(Window.partitionBy("label", "slice").orderBy(F.desc("at"), F.desc("doc_id"), F.desc("pos")))).filter("rn <= left")
    return found.filter("left >= n").select("doc_id", "label").unionByName(ranked.select("doc_id", "label"))


def picks(doc_labels: DataFrame, prop: float = 0.1, mode: str = "tail", seed: int = 0) -> DataFrame:
    """(doc_id, label): prop * count (truncated) of each label's rows; their union is the validation set."""
    return _picks(doc_labels, share(F.col("all"), prop), mode, seed)


def split_prop(doc_labels: DataFrame, prop: float = 0.1, mode: str = "tail", seed: int = 0) -> DataFrame:
    """(doc_id): validation documents, prop * count (truncated) of each label's."""
    return picks(doc_labels, prop, mode, seed).select("doc_id").distinct()


def split_even(doc_labels: DataFrame, k: int = 1, mode: str = "tail", seed: int = 0) -> DataFrame:
    """(doc_id): validation documents, k of each label's."""
    return _picks(doc_labels, F.lit(k).cast("bigint"), mode, seed).select("doc_id").distinct()


def row_numbers(docs: DataFrame) -> DataFrame:
    """(doc_id, row): 0-based numbers in order of doc_id, from a distributed sort and one count
    for each partition."""
    # Written, so that a lost executor can't number the rows anew between the two uses.
    numbered = cut(docs.select("doc_id").distinct().orderBy("doc_id").select("doc_id", F.monotonically_increasing_id().alias("at")))
    place = F.shiftright("at", 33)
    total, offsets = 0, []
    for part, n in sorted((r[0], r[1]) for r in numbered.groupBy(place.alias("part")).count().collect()):
        offsets.append((part, total))
        total += n
    base = docs.sparkSession.createDataFrame(offsets, "part bigint, base bigint")
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("part", place.cast("bigint")).join(F.broadcast(base), "part").select("doc_id", (F.col("base") + within).alias("row"))


def split_kfold(docs: DataFrame, k: int, fold: int) -> DataFrame:
    """(doc_id): validation documents of a fold: rows from fold * N div k, N div k of them; the last
    fold goes to the end. Where k doesn't divide N, a row may be in no fold."""
    rows = row_numbers(docs)
    n = rows.count()
    start = fold * n // k
    stop = n if fold == k - 1 else start + n // k
    return rows.filter((F.col("row") >= start) & (F.col("row") < stop)).select("doc_id")


def separate(rows: DataFrame, validation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training rows, validation rows)."""
    chosen = validation.select("doc_id").distinct()
    return rows.join(chosen, "doc_id", "left_anti"), rows.join(chosen, "doc_id", "left_semi")
