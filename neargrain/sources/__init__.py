"""Multi-label sparse text, hierarchies, and tables between steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: See ``few_at_once``.
FEW = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 23), "spark.sql.parquet.columnarReaderBatchSize": "64"}


def numbered_lines(spark: SparkSession, path: str, offset: int = 0, lines: int | None = None) -> DataFrame:
    """(doc_id, value): the lines of text files, numbered from 0 in order of file and line; of these
    ``lines`` from ``offset`` on (an offset of 1 skips a header).

    A split of a file is read in order by one task: lines are counted per split, and the numbers of a
    split start at the count of all before it, which are sums over the splits of its file and over
    files. Nothing of it comes to the driver or is broadcast by force.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    before = lambda n, order: F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = read.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    files = splits.groupBy("file").agg(F.sum("n").alias("n"))  # a row a file
    files = files.select("file", before("n", Window.orderBy("file")).alias("files_before"))
    inside = splits.select("file", "start", "first", before("n", Window.partitionBy("file").orderBy("start")).alias("splits_before"))
    base = inside.join(files, "file").select("file", "start", (F.col("files_before") + F.col("splits_before") - F.col("first")).alias("base"))
    rows = read.join(base, ["file", "start"]).select((F.col("at") + F.col("base")).alias("doc_id"), "value").filter(F.col("doc_id") >= offset)
    return rows if lines is None else rows.filter(F.col("doc_id") < offset + lines)


def subset(rows: DataFrame, order: str | Column, offset: int, lines: int) -> DataFrame:
    """``lines`` rows from ``offset`` on, in an order."""
    return rows.orderBy(order).offset(offset).limit(lines)


def _integer(token: Column, strict: bool) -> Column:
    return F.trim(token).cast("bigint") if strict else F.trim(token).try_cast("bigint")


def _parts(lines: DataFrame) -> tuple[Column, Column]:
    """(label tokens, feature tokens) of `label, label, ... label word:tf word:tf ...`."""
    pieces = F.split("value", ",")
    last = F.filter(F.split(F.trim(F.element_at(pieces, -1)), r"\s+"), lambda t: t != "")
    labels = F.concat(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.slice(last, 1, 1))
    return labels, F.slice(last, F.lit(2), F.greatest(F.size(last) - 1, F.lit(0)))


def parse_labels(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, pos, label) of lines (doc_id, value); repeated labels stay, blank lines have none.
    Tokens that are no whole numbers raise; with ``strict`` off they are left out."""
    filled = lines.filter(F.trim("value") != "")
    labels, _ = _parts(filled)
    rows = filled.select("doc_id", F.posexplode(labels).alias("pos", "token")).select("doc_id", "pos", _integer(F.col("token"), strict).cast("int").alias("label"))
    return rows if strict else rows.filter("label is not null")


def parse_multilabel(lines: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(postings, doc_labels) of lines; of a word that a line has twice the last count stays."""
    filled = lines.filter(F.trim("value") != "")
    _, features = _parts(filled)
    tokens = filled.select("doc_id", F.posexplode(features).alias("at", "token")).withColumn("kv", F.split("token", ":"))
    word, tf = (_integer(F.get("kv", F.lit(i)), strict) for i in (0, 1))
    rows = tokens.select("doc_id", word.alias("word"), F.struct("at", tf.alias("tf")).alias("last"))
    if not strict:
        rows = rows.filter("word is not null and last.tf is not null")
    postings = rows.groupBy("doc_id", "word").agg(F.max("last").alias("last")).select("doc_id", "word", "last.tf")
    return postings, parse_labels(lines, strict)


def format_multilabel(postings: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """(doc_id, value): documents that have labels, as text lines; words in ascending order."""
    labels = doc_labels.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("labels"))
    words = postings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word", "tf"))).alias("words"))
    kv = F.transform(F.coalesce("words", F.array().cast("array<struct<word:bigint,tf:bigint>>")), lambda x: F.concat(x["word"].cast("string"), F.lit(":"), x["tf"].cast("string")))
    head = F.array_join(F.transform("labels", lambda x: x["label"].cast("string")), ", ")
    return labels.join(words, "doc_id", "left").select("doc_id", F.array_join(F.concat(F.array(head), kv), " ").alias("value"))


def parse_edges(lines: DataFrame) -> DataFrame:
    """(parent, child) of lines `parent child`, without repetition."""
    pair = F.split(F.trim("value"), r"\s+")
    return lines.filter(F.trim("value") != "").select(F.get(pair, F.lit(0)).cast("int").alias("parent"), F.get(pair, F.lit(1)).cast("int").alias("child")).distinct()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, removed when the application ends.

    Where the session names no such folder, a temporary one is set if one machine runs all
    tasks; on a cluster, where executors wouldn't see each other's files, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="neargrain-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/neargrain-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut(rows: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """Writes a table between two steps into a shared folder and reads it back: it is made once
    however often later steps use it, and survives lost executors. ``options`` are the writer's."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def few_at_once(spark: SparkSession) -> Iterator[None]:
    """For jobs over long rows: what is started meanwhile reads a few of them at once, and sends Python some MB."""
    before = {key: spark.conf.get(key) for key in FEW}
    try:
        for key, value in FEW.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes the tables between two steps."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def write_split(lines: DataFrame, validation: DataFrame, folder: str) -> None:
    """Writes the lines of validation documents to ``folder``/v and the others to ``folder``/t."""
    chosen = validation.select("doc_id").distinct()
    lines.join(chosen, "doc_id", "left_semi").select("value").write.mode("overwrite").text(f"{folder}/v")
    lines.join(chosen, "doc_id", "left_anti").select("value").write.mode("overwrite").text(f"{folder}/t")
