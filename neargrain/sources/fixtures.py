"""The driver's tables as corpora: postings (doc_id, word, tf), doc_labels (doc_id, pos, label)
and edges (parent, child)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neargrain.operators.blocks import NEAR, packed_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def basket_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, parts as words, quantities as counts. A document's rows lie together, so they aren't
    shuffled again for what is done by document."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("word"), "l_quantity")
    return lines.repartition("doc_id").groupBy("doc_id", "word").agg(F.sum("l_quantity").cast("bigint").alias("tf"))


def basket_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation and the market segment of the customer."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("c_custkey"))
    who = orders.join(table(spark, sf_dir, "customer"), "c_custkey")
    return who.select("doc_id", F.posexplode(F.array(F.col("c_nationkey").cast("int"), (F.ascii("c_mktsegment") + 1000).cast("int"))).alias("pos", "label"))


def basket_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("child")).distinct()


def text_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are sent whole, to the document's place, and cut into words there."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    tokens = texts.select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word"))
    return tokens.filter("word <> ''").groupBy("doc_id", "word").agg(F.count("*").alias("tf"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, near) where they are read; texts of one id, if there are such, are sent to be joined by a space.
    ``near``: a number for the language, whose texts share most words."""
    near = F.pmod(F.coalesce(F.crc32("lang"), F.lit(0)), F.lit(NEAR)).cast("int").alias("near")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", near).filter("doc_id is not null")
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"), F.min("near").alias("near"))


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array((F.ascii("lang") * 100).cast("int"), number + 10000)).alias("pos", "label"))


def no_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "parent int, child int")


def dense_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("word", "w")).select("doc_id", F.col("word").cast("bigint").alias("word"), F.col("w").cast("double").alias("w"))


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def dense_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("pos"), "label")
