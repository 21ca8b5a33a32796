"""Six documents with expectations worked out by hand, and degenerate inputs."""

from __future__ import annotations

import math

import pytest

from neargrain import sources
from neargrain.__main__ import main
from neargrain.operators import counts, evaluate, index, knn, rank, split, weights
from neargrain.plans import Run, Settings

LINES = ["1,2 10:1 11:1", "1 10:2", "2, 3 11:1 12:2", "3 12:1", "1 10:1 13:1", "2 11:3"]


@pytest.fixture(scope="module")
def corpus(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "doc_id bigint, value string")
    postings, labels = sources.parse_multilabel(lines)
    return postings.cache(), labels.cache()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(100, 1), (100, 2), (101, 3), (101, 9), (102, 1)], "parent int, child int")


@pytest.fixture(scope="module")
def query(spark):
    return spark.createDataFrame([(99, 10, 1), (99, 11, 1)], "doc_id bigint, word bigint, w bigint")


def table(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_parsing(corpus):
    postings, labels = corpus
    assert table(labels, "doc_id", "pos", "label")[:3] == [(0, 0, 1), (0, 1, 2), (1, 0, 1)]
    assert table(postings.filter("doc_id = 2"), "word", "tf") == [(11, 1), (12, 2)]


def test_parsing_oddities(spark):
    lines = spark.createDataFrame([(0, "61, 7 4:1 9:2"), (1, "7,7 5:1 5:9"), (2, "4"), (3, "  "), (4, None), (5, "1 x:2 3:4")], "doc_id bigint, value string")
    postings, labels = sources.parse_multilabel(lines, strict=False)
    assert table(postings, "doc_id", "word", "tf") == [(0, 4, 1), (0, 9, 2), (1, 5, 9), (5, 3, 4)]
    assert table(labels, "doc_id", "label") == [(0, 7), (0, 61), (1, 7), (1, 7), (2, 4), (5, 1)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sources.parse_multilabel(lines)[0].collect()


def test_counts(corpus):
    postings, labels = corpus
    assert table(counts.label_counts(labels), "key", "cnt") == [(1, 3), (2, 3), (3, 2)]
    assert table(counts.label_totals(labels), "total_count", "d") == [(8, 3)]
    assert table(counts.word_counts(postings), "key", "cnt") == [(10, 4), (11, 5), (12, 3), (13, 1)]
    assert table(counts.word_counts(postings, True), "key", "cnt") == [(10, 3), (11, 3), (12, 2), (13, 1)]
    assert table(counts.word_totals(postings), "total_count", "d") == [(9, 4)]


def test_pruning(corpus):
    postings, labels = corpus
    tf, df, totals = counts.word_counts(postings), counts.word_counts(postings, True), counts.word_totals(postings)
    assert table(counts.prune(tf, totals, 2), "key") == [(10,), (11,), (12,)]
    assert table(counts.prune(tf, totals, 0, 0.4), "key") == [(12,), (13,)]
    assert table(counts.prune(df, totals, 0, 0.4), "key") == [(10,), (11,), (12,), (13,)]
    assert table(counts.prune(tf, totals, 0, 1.0, 2), "key") == [(10,), (11,)]
    kept, kept_labels = counts.prune_corpus(postings, labels, None, counts.prune(tf, totals, 5))
    assert table(kept, "doc_id", "word") == [(0, 11), (2, 11), (5, 11)]
    assert {r[0] for r in table(kept_labels, "doc_id")} == {0, 2, 5}


def test_hierarchy(corpus, edges):
    _, labels = corpus
    assert table(index.children(edges, labels), "parent", "n_children") == [(100, 2), (101, 1), (102, 1)]
    assert table(index.parent_sums(edges, labels), "label", "psum") == [(1, 3), (2, 2), (3, 1)]
    none = edges.filter("false")
    assert table(index.parent_sums(none, labels), "label", "psum") == [(1, 0), (2, 0), (3, 0)]


def test_weights_and_norms(corpus):
    postings, _ = corpus
    found = {r[:2]: r[2] for r in table(weights.weights(postings), "doc_id", "word", "w")}
    assert found[0, 10] == pytest.approx(0.480453, abs=1e-6)
    assert found[2, 12] == pytest.approx(1.206949, abs=1e-6)
    assert found[4, 13] == pytest.approx(1.241953, abs=1e-6)
    logs = dict(table(weights.norms(weights.raw_weights(postings), log=True), "doc_id", "norm"))
    assert logs[1] == pytest.approx(math.log(2)) and logs[3] == 0


@pytest.mark.parametrize("k, expected", [(3, [(0, 1), (0, 2), (1, 1)]), (4, [(0, 1), (0, 2), (1, 1), (5, 2)])])
def test_top_k(corpus, query, k, expected):
    postings, labels = corpus
    found = knn.top_k(query, weights.raw_weights(postings), labels, k).orderBy("rnk").collect()
    assert [(r["doc_id"], r["label"]) for r in found] == expected
    assert [r["rnk"] for r in found] == list(range(1, k + 1))


def ranked(corpus, edges, query, k, per_occurrence=False):
    postings, labels = corpus
    entries = knn.top_k(query, weights.raw_weights(postings), labels, k)
    return rank.ranks(rank.label_features(entries, index.parent_sums(edges, labels), counts.label_counts(labels), per_occurrence))


@pytest.mark.parametrize("k, per_occurrence, expected, labels", [
    (4, False, {1: 6.699019, 2: 6.099019}, {1, 2}),
    (4, True, {1: 8.499019, 2: 7.299019}, {1}),
    (8, False, {1: 7.165685, 2: 6.418668, 3: 2.128157}, None),
])
def test_ranks_and_predictions(corpus, edges, query, k, per_occurrence, expected, labels):
    found = ranked(corpus, edges, query, k, per_occurrence)
    assert dict(table(found, "label", "rank")) == pytest.approx(expected, abs=1e-6)
    if labels:
        assert {r[0] for r in table(rank.predict(found, 0.9), "label")} == labels


def test_fallback(spark, corpus, edges):
    _, labels = corpus
    queries = spark.createDataFrame([(99, 77, 1)], "doc_id bigint, word bigint, w bigint")
    none = spark.createDataFrame([], "q bigint, label int, rank double")
    found = rank.with_fallback(none.select("q", "label"), none, queries, counts.label_counts(labels))
    assert table(found, "q", "label") == [(99, 1), (99, 2)]


def test_splits(spark, corpus):
    _, labels = corpus
    assert table(split.split_prop(labels, 0.5), "doc_id") == [(3,), (4,), (5,)]
    assert table(split.split_even(labels, 1), "doc_id") == [(3,), (4,), (5,)]
    rows = spark.range(6).withColumnRenamed("id", "doc_id")
    assert [[r[0] for r in table(split.split_kfold(rows, 4, i), "doc_id")] for i in range(4)] == [[0], [1], [3], [4, 5]]
    picked = split.split_even(labels, 1, "random", 3)
    assert 1 <= picked.count() <= 3 and table(picked, "doc_id") == table(split.split_even(labels, 1, "random", 3), "doc_id")


def test_evaluation(spark):
    predicted = spark.createDataFrame([(0, 1), (0, 2), (0, 2)], "q bigint, label int")
    truth = spark.createDataFrame([(0, 1)], "q bigint, label int")
    cells = evaluate.confusion(predicted, truth)
    assert table(cells, "label", "tp", "fp", "fn") == [(1, 1, 0, 0), (2, 0, 1, 0)]
    assert table(evaluate.macro(cells), "map", "mar", "maf") == [(0.5, 0.5, 0.5)]
    assert table(evaluate.macro(cells.filter("false")), "map", "mar", "maf") == [(0.0, 0.0, 0.0)]


def test_run_on_an_empty_corpus(spark, edges):
    postings = spark.createDataFrame([], "doc_id bigint, word bigint, tf bigint")
    labels = spark.createDataFrame([], "doc_id bigint, pos int, label int")
    assert table(Run((postings, labels), edges, Settings()).score, "map", "mar", "maf") == [(0.0, 0.0, 0.0)]


def test_zero_norm_and_log_norm(spark, corpus, query):
    postings, labels = corpus
    train = weights.raw_weights(postings)
    zero = query.selectExpr("doc_id", "word", "0L as w")
    assert {r[0] for r in table(knn.scores(zero, train), "score")} == {0.0}
    words = {}
    for q, rows in ((True, query), (False, train)):
        for r in rows.select("doc_id", "word", "w").collect():
            words.setdefault((q, r["doc_id"]), {})[r["word"]] = r["w"]
    norm = {d: math.log(math.sqrt(sum(w * w for w in x.values()))) for d, x in words.items()}
    expected, shared = {}, {}
    for (is_q, q), x in words.items():
        for (other, d), y in words.items():
            both = x.keys() & y.keys()
            if is_q and not other and both:
                bottom = norm[True, q] * norm[False, d]
                expected[q, d] = round(sum(x[w] * y[w] for w in both) / bottom, 9) if bottom else 0.0
                shared[q, d] = len(both) > int(0.5 * min(len(x), len(y)))
    found = {(r["q"], r["doc_id"]): r["score"] for r in knn.scores(query, train, norm="log_l2").collect()}
    assert found == pytest.approx(expected)
    cosines = {(r["q"], r["doc_id"]): r["score"] for r in knn.scores(query, train).collect()}
    gated = {(r["q"], r["doc_id"]): r["score"] for r in knn.scores(query, train, overlap=0.5).collect()}
    assert gated == {pair: s if shared[pair] else 0.0 for pair, s in cosines.items()}


def test_random_selection(spark):
    """k rows of each label by a hash: exactly k documents of a label that has as many, all of a
    smaller one, the same ones again, others for another seed."""
    labels = spark.createDataFrame([(d, 0, d % 2) for d in range(200)] + [(900, 0, 5), (901, 0, 5)], "doc_id bigint, pos int, label int")
    one, again, other = ({r[0] for r in split.split_even(labels, 30, "random", seed).collect()} for seed in (1, 1, 2))
    assert one == again != other
    assert [sum(d % 2 == i for d in one if d < 900) for i in (0, 1)] == [30, 30] and {900, 901} <= one
    part = {r[0] for r in split.split_prop(labels, 0.1, "random", 3).collect()}
    assert [sum(d % 2 == i for d in part if d < 900) for i in (0, 1)] == [10, 10] and not part & {900, 901}


def test_steps_start_from_saved_tables(spark, tmp_path):
    lines = "".join(f"{d % 3 + 1}, {d % 2 + 4} {d % 5}:1 {d % 7 + 10}:2 {d % 3 + 20}:3\n" for d in range(60))
    (tmp_path / "lines.txt").write_text("header\n" + lines)
    (tmp_path / "edges.txt").write_text("9 1\n9 2\n9 3\n8 4\n8 5\n")
    given = [str(tmp_path / "lines.txt"), str(tmp_path / "edges.txt"), str(tmp_path / "state"), "-k", "5"]
    main([*given, "--to", "split"])
    assert not (tmp_path / "state/search").exists()
    main([*given, "--from", "search"])
    corpus = sources.parse_multilabel(sources.numbered_lines(spark, given[0], 1))
    expected = Run(corpus, sources.parse_edges(spark.read.text(given[1])), Settings(k=5)).score.collect()
    assert spark.read.parquet(str(tmp_path / "state/evaluate/score")).collect() == expected


def test_lines_of_many_splits(spark, tmp_path):
    for name, n in (("a", 3), ("b", 4000), ("c", 1)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = sources.numbered_lines(spark, str(tmp_path)).orderBy("doc_id").collect()
        part = sources.numbered_lines(spark, str(tmp_path), 2, 3).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in rows] == list(enumerate([*(f"a{i}" for i in range(3)), *(f"b{i}" for i in range(4000)), "c0"]))
    assert [r["value"] for r in part] == ["a2", "b0", "b1"]


def test_no_local_folder_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf = Conf
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sources.shared_folder(Session, "x")


def test_common_words_are_left_out(spark, edges):
    postings = spark.createDataFrame([(d, w, 1) for d in range(20) for w in (1, 2 + d % 4)], "doc_id bigint, word bigint, tf bigint")
    labels = spark.createDataFrame([(d, 0, d % 2) for d in range(20)], "doc_id bigint, pos int, label int")
    run = Run((postings, labels), edges, Settings(frequent_words=None, common_words=0.5))
    assert {r["word"] for r in run.postings.collect()} == {2, 3, 4, 5}


def test_files(spark, tmp_path, corpus):
    (tmp_path / "in.txt").write_text("header\n1 10:1\n\n2 11:2\n")
    lines = sources.numbered_lines(spark, str(tmp_path / "in.txt"), 1)
    assert table(lines, "doc_id", "value") == [(1, "1 10:1"), (2, ""), (3, "2 11:2")]
    postings, labels = sources.parse_multilabel(lines)
    assert table(postings, "doc_id", "word", "tf") == [(1, 10, 1), (3, 11, 2)]
    sources.save({"postings": postings, "labels": labels}, str(tmp_path / "kept"))
    back = sources.load(spark, str(tmp_path / "kept"), ["postings", "labels"])
    assert table(back["postings"], "doc_id", "word", "tf") == table(postings, "doc_id", "word", "tf")
    sources.write_split(lines, spark.createDataFrame([(3,)], "doc_id bigint"), str(tmp_path / "split"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "split/v")).collect()] == ["2 11:2"]
    edges = spark.createDataFrame([("1 2",), ("1  2",), (" 3\t4 ",), ("",)], "value string")
    assert table(sources.parse_edges(edges), "parent", "child") == [(1, 2), (3, 4)]
