"""A training corpus from the documents: filter, deduplicate, mix, pack.

Every stage takes whole texts, also such of many MB (a Python worker holds one at a time), gives an
empty table for an empty one, and passes on columns of any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from neargrain.llm import exact, minhash, mixing, packing, quality
from neargrain.llm.common import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones of ``docs``.
    Rows without an id are judged like others; null and empty texts are judged by all-zero
    statistics; repeated rows share a verdict. Other columns, whatever their names, pass through."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id; a null text is an
    empty one. Of rows that can't be told apart, id and text alike, one stays, also without an id."""
    return exact.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id. Rows without an
    id stay; of an id with two texts each text is a document; texts without words are only
    near-duplicates of the same text."""
    return minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: whole documents, as often as the mixture takes them. A null
    source is one of the sources; rows without an id are mixed like others; texts without words
    weigh nothing, so they are in no mixture."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document; every row of ``docs`` is packed."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("mix", mix),
    ("pack", pack),
]

#: SQL can't express the trees, the sampling or the tokenizer; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
