"""Lines that arrive over time, and neighbours by random projections."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from neargrain import catalogue, streaming
from neargrain.operators import lsh
from neargrain.sources import state


def put(folder, name, *lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def table(spark, folder, name, *columns):
    return sorted(tuple(r) for r in streaming.stored(spark, str(folder), name).select(*columns).collect())


def test_lines_count_once_over_restarts(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    put(source, "a", "1, 2 10:1 11:2", "", "1 10:3 10:4")
    put(source, "b", "3 12:1 x:1")
    streaming.absorb(spark, str(source), str(folder), files_at_once=1)
    assert len(streaming.batches(spark, str(folder))) == 2
    streaming.absorb(spark, str(source), str(folder))  # nothing new
    put(source, "c", "2 11:5 12:1", "7")
    streaming.absorb(spark, str(source), str(folder))
    assert table(spark, folder, "word_counts", "key", "cnt", "docs") == [(10, 5, 2), (11, 7, 2), (12, 2, 2)]
    assert table(spark, folder, "label_counts", "key", "cnt") == [(1, 2), (2, 2), (3, 1), (7, 1)]
    assert len({r[0] for r in table(spark, folder, "doc_labels", "doc_id")}) == 5
    assert table(spark, folder, "postings", "word", "tf") == [(10, 1), (10, 4), (11, 2), (11, 5), (12, 1), (12, 1)]


def test_a_batch_that_failed_is_made_anew(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    put(source, "a", "1 10:1")
    streaming.absorb(spark, str(source), str(folder))
    put(source, "b", "1 10:1", "1 z:1")
    with pytest.raises(Exception):
        streaming.absorb(spark, str(source), str(folder), strict=True)
    # What the failed attempt may have left doesn't count.
    spark.createDataFrame([(10, 99, 9)], "key bigint, cnt bigint, docs bigint").write.mode("overwrite").parquet(str(folder / "batch-1" / "word_counts"))
    assert table(spark, folder, "word_counts", "key", "cnt") == [(10, 1)]
    streaming.absorb(spark, str(source), str(folder))
    assert table(spark, folder, "word_counts", "key", "cnt") == [(10, 2)]
    state.drop_manifest(spark, str(folder / "batch-1"))
    assert table(spark, folder, "word_counts", "key", "cnt") == [(10, 1)]


def test_an_empty_store(spark, tmp_path):
    with pytest.raises(ValueError):
        streaming.stored(spark, str(tmp_path / "none"), "postings")


def vectors(spark, seed, n):
    """Sparse vectors around 20 centres, with copies and one that shares no word."""
    r = random.Random(seed)
    centres = [{r.randrange(400): r.gauss(0, 1) for _ in range(12)} for _ in range(20)]
    out = [{w: x + r.gauss(0, 0.3) for w, x in r.choice(centres).items()} for _ in range(n)]
    out += out[:20] + [{9999: 1.0}]
    return out, spark.createDataFrame([(i, w, x) for i, v in enumerate(out) for w, x in v.items()], "doc_id bigint, word bigint, w double")


def test_projections_find_near_vectors(spark):
    plain, rows = vectors(spark, 3, 400)
    asked = rows.filter("doc_id % 20 = 0")
    near = {"tables": 12, "signs": 12, "nearest": 4}  # long keys: these vectors' neighbours are close
    found = lsh.neighbours(asked, rows, 5, **near).collect()
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    cosine = lambda a, b: sum(x * b.get(w, 0.0) for w, x in a.items()) / norm(a) / norm(b)
    for r in found:
        assert r["score"] == pytest.approx(cosine(plain[r["q"]], plain[r["doc_id"]]), abs=1e-6) and r["q"] != r["doc_id"]
    wanted = hit = 0
    for q in range(0, len(plain), 20):
        best = sorted((j for j in range(len(plain)) if j != q), key=lambda j: (-round(cosine(plain[q], plain[j]), 6), j))[:5]
        wanted, hit = wanted + 5, hit + len({r["doc_id"] for r in found if r["q"] == q} & set(best))
    assert hit / wanted >= 0.9
    # Few of all pairs are looked at.
    assert lsh.candidates(asked, rows, **near).count() < 0.3 * asked.select("doc_id").distinct().count() * len(plain)


def test_probes_change_the_least_certain_signs(spark):
    p = spark.createDataFrame([(1, [5.0, -0.1, 3.0, 0.2])], "doc_id bigint, sums array<double>")
    assert [r["key"] for r in lsh.keys(p, 1, 4).collect()] == [0b1101]
    assert sorted(r["key"] for r in lsh.probes(p, 1, 4, 2).collect()) == sorted([0b1101, 0b1111, 0b0101, 0b0111])
    assert [(r["table"], r["key"]) for r in lsh.keys(p, 2, 2).orderBy("table").collect()] == [(0, 0b01), (1, 0b11)]


def test_projections_of_nothing(spark):
    _, rows = vectors(spark, 4, 30)
    assert lsh.neighbours(rows.filter("false"), rows).count() == 0
    assert lsh.recall(rows.filter("false").select(F.col("doc_id").alias("q"), "doc_id"), rows.filter("false").select(F.col("doc_id").alias("q"), "doc_id")).first()["recall"] == 1.0


def test_recall_of_the_registered_query(spark, data):
    found = catalogue.QUERIES["lsh_neighbours"](spark, data).collect()
    assert found and {r["recall"] for r in found} == {found[0]["recall"]} and found[0]["recall"] >= 0.9


def test_pairs_that_share_a_key_are_no_rows(spark, monkeypatch):
    """The neighbours are those among the candidates; the query makes no row for a pair, nor for its words."""
    r = random.Random(3)
    vectors = spark.createDataFrame([(i, j, r.gauss(0, 1)) for i in range(80) for j in range(6)], "doc_id bigint, word bigint, w double").cache()
    asked = vectors.filter("doc_id % 10 = 0")
    scored = lsh.exact(lsh.candidates(asked, vectors, tables=2, signs=6, nearest=1), asked, vectors)
    expected = scored.withColumn("rnk", F.expr("row_number() over (partition by q order by score desc, doc_id)")).filter("rnk <= 4")
    expected = sorted(map(tuple, expected.select("q", "rnk", "doc_id", "score").collect()))
    monkeypatch.setattr(lsh.pairs, "joined", None)
    assert sorted(map(tuple, lsh.neighbours(asked, vectors, 4, tables=2, signs=6, nearest=1).collect())) == expected
    assert catalogue.QUERIES["lsh_neighbours"](spark, "/root/testdata/sf0.001").first()["recall"] >= 0.9
