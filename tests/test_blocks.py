"""Cosines of vectors that share most of their words, block by block."""

from __future__ import annotations

import math
import random

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from neargrain import catalogue
from neargrain.operators import blocks, knn, pairs, texts, weights
from neargrain.sources import fixtures


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("block", "part", "at_once"), [(4096, 1 << 16, 1 << 21), (7, 11, 50)])
def test_blocks_of_any_size_equal_plain_cosines(spark, monkeypatch, block, part, at_once):
    monkeypatch.setattr(blocks, "AT_ONCE", at_once)
    r = random.Random(1)
    own = {i: [r.choice((-1.0, 0.0, 0.5, 2.0)) for _ in range(5)] for i in range(90)}
    vectors = blocks.packed_vectors(spark.createDataFrame(list(own.items()), "vec_id bigint, embedding array<float>"), "vec_id", "embedding")
    found = blocks.best(vectors.filter("doc_id % 4 = 0"), vectors, 6, gate=True, zeros=True, block=block, part=part)
    expected = []
    for q in range(0, 90, 4):
        scored = []
        for d, y in own.items():
            dot, root = sum(a * b for a, b in zip(own[q], y)), math.sqrt(sum(a * a for a in own[q]) * sum(b * b for b in y))
            scored.append((-round(dot / root, 6) if dot > 0 else 0.0, d))
        expected += [(q, d, -s) for s, d in sorted(scored)[:6]]
    assert rows_of(found) == sorted(expected)


def test_odd_vectors(spark, tmp_path, data):
    """Null components and vectors, lengths that differ, what isn't finite, and an id that two vectors have."""
    rows = [(i, [1.0, float(i % 5), -0.5 * (i % 3)], i % 2) for i in range(40)]
    rows += [(40, None, 0), (41, [], 1), (42, [None, 2.0, 1.0], 0), (43, [1.0], 1), (44, [0.0, 0.0, 0.0], 0), (45, [3.0, float("inf"), 1.0], 1), (38, [0.5, 1.0, 1.0], 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    vectors = fixtures.dense_vectors(spark, str(tmp_path))
    found = {(q, d): s for q, d, s in blocks.best(vectors, vectors, 50, gate=True, zeros=True).collect()}
    long = [(r["doc_id"], i, w) for r in vectors.collect() for i, w in zip(r["words"], r["ws"])]
    joined = knn.scores(*[spark.createDataFrame(long, "doc_id bigint, word bigint, w double").groupBy("doc_id", "word").agg(F.sum("w").alias("w"))] * 2, gate=True, digits=6)
    for q, d, s in joined.filter("38 not in (q, doc_id)").collect():
        assert found[q, d] == s or math.isnan(s) and math.isnan(found[q, d])
    assert {40, 41}.isdisjoint(q for q, _ in found)
    assert len({q for q, _ in found}) == 44


def test_texts_by_blocks_equal_the_join_on_words(spark, monkeypatch):
    postings, labels = fixtures.text_postings(spark, "/root/testdata/sf0.001").cache(), fixtures.text_labels(spark, "/root/testdata/sf0.001").cache()
    weighed = weights.weights(postings).cache()
    split_ = lambda rows, n: rows.filter(F.col("doc_id") % 4 == 0 if n else F.col("doc_id") % 4 != 0)
    sides = split_(weighed, 1), split_(weighed, 0), split_(labels, 0)
    full = rows_of(knn.top_k(*sides, 10, digits=6))
    monkeypatch.setattr(pairs, "joined", None)  # no pair is a row for each word that it shares
    assert rows_of(knn.top_k(*sides, 10, digits=6, search="blocks")) == full
    monkeypatch.setattr(blocks, "HOT", 2.0)
    assert rows_of(knn.top_k(*sides, 10, digits=6, search="blocks")) == full
    for options in ({"norm": "log_l2"}, {"overlap": 0.3}):
        with pytest.raises(ValueError):
            knn.top_k(*sides, 10, search="blocks", **options)


@pytest.mark.parametrize("name", ["dense_cosine_topk", "cosine_text_topk"])
def test_queries_join_nothing_by_word(spark, data, monkeypatch, name):
    monkeypatch.setattr(pairs, "joined", None)
    assert_same(catalogue.QUERIES[name](spark, data), catalogue.ORACLES[name], data)


def test_vectors_are_packed_where_their_rows_arrive(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (1, "c", 2.0), (2, "c", 5.0), (3, "b", 0.5)], "doc_id bigint, word string, w double")
    numbers = spark.createDataFrame([("a", 0), ("b", 1)], "word string, row bigint")
    plan = blocks.packed(rows, numbers)
    found = {r["doc_id"]: (r["square"], sorted(zip(r["words"], r["ws"]))) for r in plan.collect()}
    assert found == {1: (9.0, [(0, 2.0), (1, 1.0)]), 3: (0.25, [(1, 0.5)])}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sent = blocks.packed(rows, numbers.hint("broadcast"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sent.count("Exchange hashpartitioning(doc_id") == 1


def _shuffled(spark) -> int:
    """Bytes that all stages so far have written to be shuffled."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_what_is_shuffled_does_not_grow_with_the_number_of_blocks(spark):
    r = random.Random(2)
    vectors = blocks.packed_vectors(spark.createDataFrame([(i, [r.random() for _ in range(60)]) for i in range(600)], "vec_id bigint, embedding array<double>"), "vec_id", "embedding").cache()
    took, found = [], []
    for block in (600, 20):
        before = _shuffled(spark)
        found.append(rows_of(blocks.best(vectors, vectors, 2, block=block)))
        took.append(_shuffled(spark) - before)
    assert found[0] == found[1]
    assert took[1] < 2 * took[0]


def test_near_ties_and_far_magnitudes(spark):
    """What single precision can't tell apart, or can't hold."""
    r = random.Random(3)
    base = [r.random() for _ in range(30)]
    own = {i: [x * (1 + 1e-7 * r.random()) * scale for x in base] for i, scale in enumerate([1.0, 1e-30, 1e30, 1e-150, 3.0] * 12)}
    own |= {60: [0.0] * 29 + [1e-200], 61: [1e200] * 30, 62: [-x for x in base]}
    vectors = blocks.packed_vectors(spark.createDataFrame(list(own.items()), "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    found = blocks.best(vectors, vectors, 5, digits=14)
    size = {d: sum(x * x for x in y) for d, y in own.items()}
    found = {(q, d): s for q, d, s in found.collect()}
    for q in (0, 1, 2, 4, 62):
        scored = []
        for d, y in own.items():
            root = math.sqrt(size[q] * size[d])
            scored.append(round(sum(a * b for a, b in zip(own[q], y)) / root, 14) if root else 0.0)
        assert all(abs(a - b) < 1e-13 for a, b in zip(sorted((s for (p, _), s in found.items() if p == q), reverse=True), sorted((s for s in scored if s), reverse=True)[:5], strict=True))


def test_texts_with_odd_rows(spark, tmp_path, data):
    """Ids that several rows have, texts that are null, empty or without words, and capitals; no row for each word."""
    odd = [(1, "Alpha beta", "en", "s1"), (1, "beta, GAMMA-beta", "en", "s1"), (2, None, "en", "s1"), (3, "", "de", "s2"), (4, "!?", "de", "s2"), (5, "Straße ÄÖ alpha", "de", "s2")]
    rows = odd + [(i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta", "Epsilon", "zeta1", f"own{i}"], k=i % 9 + 1)), ("en", "de", "fr")[i % 3], f"s{i % 4}") for i in range(6, 90)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(2).write.parquet(str(tmp_path / "parts"))
    spark.read.parquet(str(tmp_path / "parts")).coalesce(1).write.parquet(str(tmp_path / "documents"))
    next((tmp_path / "documents").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    for size in (1, 1 << 24):
        texts_ = texts.lists(fixtures.texts(spark, str(tmp_path)), size)
        counted = texts_.filter("word is null").select("part", "doc_id", "words", "counts").join(texts_.filter("word is not null").select("part", "code", "n", F.col("word").alias("own")), "part").filter(F.array_contains("words", F.col("code")))
        found = counted.select("doc_id", F.col("own").alias("word"), F.expr("counts[array_position(words, code) - 1]").cast("bigint").alias("tf"))
        assert rows_of(found) == rows_of(fixtures.text_postings(spark, str(tmp_path)))
    assert_same(catalogue.QUERIES["cosine_text_topk"](spark, str(tmp_path)), catalogue.ORACLES["cosine_text_topk"], str(tmp_path))


def test_texts_are_not_made_rows_of_words(spark, data, monkeypatch):
    monkeypatch.setattr(fixtures, "text_postings", None)
    assert_same(catalogue.QUERIES["cosine_text_topk"](spark, data), catalogue.ORACLES["cosine_text_topk"], data)
