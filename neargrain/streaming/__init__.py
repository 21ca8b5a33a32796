"""Text lines that arrive over time, added to stored postings and counts.

Each run takes the files that came since the last one, in batches, and ends. A batch has a folder of
its own, whose manifest is written last: an attempt that fails is made anew in the same folder, and
readers see whole batches alone. So every line counts once, also after a restart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neargrain.operators import counts
from neargrain.operators.split import row_numbers
from neargrain.sources import cut, parse_multilabel
from neargrain.sources.state import drop_manifest, read_manifest, write_manifest

#: Documents of a batch have ids from its number times this on.
BATCH = 1 << 40
TABLES = ("postings", "doc_labels", "word_counts", "label_counts")


def _add(lines: DataFrame, folder: str, strict: bool) -> None:
    """Writes the tables of a batch of lines (doc_id, value)."""
    spark = lines.sparkSession
    drop_manifest(spark, folder)
    postings, labels = (cut(x) for x in parse_multilabel(lines, strict))
    words = postings.groupBy(F.col("word").alias("key")).agg(F.sum("tf").alias("cnt"), F.count("*").alias("docs"))
    tables = dict(zip(TABLES, (postings, labels, words, counts.label_counts(labels))))
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    write_manifest(spark, folder, {"documents": postings.select("doc_id").distinct().count()})


def absorb(spark: SparkSession, source: str, folder: str, files_at_once: int | None = None, strict: bool = False) -> None:
    """Adds the lines of the files that are new in ``source`` to the store in ``folder``, and returns
    when all are in. Where it left off is in the folder too."""
    stream = spark.readStream
    if files_at_once:
        stream = stream.option("maxFilesPerTrigger", files_at_once)

    def step(batch: DataFrame, number: int) -> None:
        # Written before lines are numbered, so that a lost executor can't number them anew.
        held = cut(batch.select("value").withColumn("doc_id", F.monotonically_increasing_id()))
        lines = held.join(row_numbers(held), "doc_id").select((F.col("row") + F.lit(number * BATCH)).alias("doc_id"), "value")
        _add(lines, f"{folder}/batch-{number}", strict)

    query = stream.text(source).writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def batches(spark: SparkSession, folder: str) -> list[str]:
    """The folders of whole batches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(place)] if fs.exists(place) else []
    own = sorted((int(p.getName()[6:]), p.toString()) for p in found if re.fullmatch(r"batch-\d+", p.getName()))
    return [path for _, path in own if read_manifest(spark, path) is not None]


def stored(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of TABLES over all whole batches. Counts are one row a key: batches' counts are added."""
    found = [f"{path}/{table}" for path in batches(spark, folder)]
    if not found:
        raise ValueError(f"no whole batch in {folder}")
    rows = spark.read.parquet(*found)
    if not table.endswith("_counts"):
        return rows
    return rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in rows.columns if c != "key"])
