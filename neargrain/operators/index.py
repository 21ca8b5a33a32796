"""Inverted and hierarchy indices, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hierarchy(edges: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """The edges whose child is a label in use."""
    used = doc_labels.select(F.col("label").alias("child")).distinct()
    return edges.distinct().join(used, "child", "left_semi").select("parent", "child")


def parents(edges: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """(label, parent): every label in use; the parent is null for one that has none."""
    own = hierarchy(edges, doc_labels).withColumnRenamed("child", "label")
    return doc_labels.select("label").distinct().join(own, "label", "left")


def children(edges: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """(parent, n_children) of labels in use."""
    return hierarchy(edges, doc_labels).groupBy("parent").agg(F.count("*").alias("n_children"))


def parent_sums(edges: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """(label, psum): the children of all parents of a label; 0 without parents."""
    sizes = children(edges, doc_labels)
    return parents(edges, doc_labels).join(sizes, "parent", "left").groupBy("label").agg(F.coalesce(F.sum("n_children"), F.lit(0)).cast("bigint").alias("psum"))


def inverted_index(postings: DataFrame) -> DataFrame:
    """(word, n_docs, first_doc, last_doc); the postings themselves are the lists."""
    return postings.groupBy("word").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def label_documents(doc_labels: DataFrame) -> DataFrame:
    """(label, n_docs, first_doc, last_doc)."""
    return doc_labels.groupBy("label").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
