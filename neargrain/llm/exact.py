"""Exact deduplication by a content sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neargrain.llm.common import by_position, materialise

_RUNS = "doc_id bigint, text_sha256 string, run_keep bigint, run_size bigint, edge boolean"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full comparison of neighbours in a sorted partition: rows of a run of equal texts share
    the run's largest id and its size. The first and the last run are marked: a run may go on
    in the next partition. Holds the ids of one run, never its texts."""
    text, sha, ids, first = None, None, [], True

    def run(edge: bool) -> pa.RecordBatch:
        known = [i for i in ids if i is not None]
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([sha] * n, pa.string()), pa.array([max(known, default=None)] * n, pa.int64()), pa.array([n] * n, pa.int64()), pa.array([edge] * n, pa.bool_())],
            names=["doc_id", "text_sha256", "run_keep", "run_size", "edge"],
        )

    out: list[pa.RecordBatch] = []
    for batch in batches:
        for doc, now, digest in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist(), batch.column("text_sha256").to_pylist()):
            if ids and now != text:
                out.append(run(first))
                ids, first = [], False
            text, sha = now, digest
            ids.append(doc)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
            out = []
    if ids:
        yield run(True)


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", normalised: Column | None = None) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256, one row per input row.

    Sampled splitters range-partition the rows by content: the first bytes, the digest of the
    whole text, the row's id. The id is part of the key, so that a group of copies of any size spreads
    over partitions, and splitters stay short however long the texts are. Spark's external sort
    puts equal texts side by side, neighbours are compared in full, and of equal texts the
    largest ``doc_id`` stays. Runs at the edge of a partition (two for each at most) are joined
    up by their digest in a second, small step.

    ``normalised`` is the column that is compared (default: the text unchanged). A null text
    counts as empty. Rows with a null id are grouped like others and never kept before one with
    an id; repeated rows (same id and text) count each, and each of them is kept. An empty table
    gives an empty result; other columns are ignored.
    """
    body = F.coalesce(F.col(text) if normalised is None else normalised, F.lit(""))
    keyed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), body.alias("body"))
    keyed = keyed.withColumn("text_sha256", F.sha2("body", 256))
    content = [F.substring(F.encode("body", "UTF-8"), 1, 48), F.col("text_sha256")]
    ranged = keyed.repartitionByRange(*content, F.col("doc_id")).sortWithinPartitions(*content, "body", "doc_id")
    runs = materialise(ranged.mapInArrow(_neighbours, _RUNS), "exact")
    # A text that crosses a border of partitions is at an edge in all of them. Two texts for each
    # partition at most get here, so the broadcast has a row for each border.
    ends = runs.filter("edge").groupBy("text_sha256").agg(F.max("run_keep").alias("all_keep"), F.count("*").alias("all_size"))
    joined = runs.join(F.broadcast(ends), "text_sha256", "left")
    keep, size = F.coalesce("all_keep", "run_keep"), F.coalesce("all_size", "run_size")
    return joined.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with all columns. Of rows that can't be told apart, id and text alike,
    one stays; so of equal texts without any id one stays, too. Columns may have any names."""
    return by_position(docs, (text, doc_id), _without_copies)


def _without_copies(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    key = lambda id_, sha: F.concat_ws(":", sha, id_.cast("string"))  # noqa: E731  a null id adds nothing
    kept = exact_duplicates(docs, text, doc_id).filter("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("__kept"))
    keyed = docs.withColumn("__kept", key(F.col(doc_id), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    return keyed.join(kept, "__kept", "left_semi").dropDuplicates(["__kept"]).drop("__kept")
