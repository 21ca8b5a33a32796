"""Searches that join less than every pair: same rows, fewer joined; stored indices, sets, saved steps."""

from __future__ import annotations

import random
from dataclasses import replace
from statistics import median

import pytest
from pyspark.sql import functions as F

from neargrain import catalogue
from neargrain.operators import counts, evaluate, knn, pairs, rank, sets, split, stored, weights
from neargrain.plans import Run, Settings
from neargrain.sources import fixtures, state


def corpus(spark, seed: int, n: int = 300, vocabulary: int = 200, longest: int = 25):
    """Postings with Zipf-like words, repeated documents and some that share nothing."""
    r = random.Random(seed)
    docs = [{min(vocabulary, int(r.paretovariate(0.6))): r.randrange(1, 5) for _ in range(r.randrange(1, longest))} for _ in range(n)]
    docs += docs[: n // 10] + [{1000 + i: 1} for i in range(5)]
    rows = [(i, w, tf) for i, words in enumerate(docs) for w, tf in words.items()]
    return spark.createDataFrame(rows, "doc_id bigint, word bigint, tf bigint"), spark.createDataFrame([(i, p, (i + p) % 7) for i in range(len(docs)) for p in range(1 + i % 2)], "doc_id bigint, pos int, label int")


def parts(rows):
    """(queries, training rows): every fourth document asks."""
    return rows.filter("doc_id % 4 = 0"), rows.filter("doc_id % 4 <> 0")


def sides(rows):
    q, t = parts(rows)
    return q.select(F.col("doc_id").alias("q"), "word", F.col("w").alias("qw")), t.select("doc_id", "word", F.col("w").alias("tw"))


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("seed", "raw", "k", "candidates"), [(1, True, 2, "all"), (2, False, 40, "shared"), (3, False, 5, "all")])
def test_bounds_find_the_same_entries(spark, seed, raw, k, candidates):
    postings, labels = corpus(spark, seed)
    weighed = (weights.raw_weights(postings) if raw else weights.weights(postings)).cache()
    (q, t), (_, tl) = parts(weighed), parts(labels)
    full = knn.top_k(q, t, tl, k, candidates, digits=6)
    assert rows_of(knn.top_k(q, t, tl, k, candidates, digits=6, search="bounds")) == rows_of(full)


@pytest.mark.parametrize(("overlap", "norm", "gate"), [(0.0, "l2", False), (0.3, "log_l2", True), (0.9, "l2", True)])
def test_prefixes_find_the_same_entries(spark, overlap, norm, gate):
    postings, labels = corpus(spark, 4)
    (q, t), (_, tl) = parts(weights.raw_weights(postings).cache()), parts(labels)
    full = knn.top_k(q, t, tl, 20, overlap=overlap, norm=norm, gate=gate, digits=6)
    assert rows_of(knn.top_k(q, t, tl, 20, overlap=overlap, norm=norm, gate=gate, digits=6, search="overlap")) == rows_of(full)


def test_searches_join_fewer_rows(spark):
    rows = pairs.Bounded(*sides(weights.weights(corpus(spark, 13, 2000, 3000, 60)[0]).cache()), 5, 2e-6).rows
    assert rows["joined"] < rows["all"] / 3
    for postings, most in ((fixtures.text_postings, 0.75), (fixtures.basket_postings, 0.95)):
        rows = pairs.Overlapping(*sides(weights.raw_weights(postings(spark, "/root/testdata/sf0.001"))), 0.3).rows
        assert rows["joined"] < most * rows["all"]


def test_hot_words_are_split_evenly(spark):
    n = 1600
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.explode(F.array(F.when(F.col("id") % 10 != 0, F.lit(-1)), F.col("id") % 71, F.col("id") % 301 + 5000)).alias("word")).filter("word is not null").withColumn("w", F.lit(1))
    q, t = sides(rows.distinct())
    cells = pairs.grid(q, t, 6_000)
    assert [r["word"] for r in cells.collect()] == [-1]
    found = pairs.joined(q, t, cells).cache()
    assert rows_of(pairs.dots(found)) == rows_of(pairs.dots(q.join(t, "word")))
    assert found.count() == q.join(t, "word").count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        split_, plain = sizes(pairs.joined(q, t, cells)), sizes(q.join(t.hint("merge"), "word"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(split_) == 8 and max(split_) <= 4 * median(split_)
    assert max(plain) > 4 * median(plain)


def test_few_words_are_split_however_many_pairs_there_are(spark):
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("word"), F.lit(1).alias("w"))
    q, t = sides(rows)
    assert pairs.grid(q, t, 1).count() == 21 <= pairs.MOST_SPLIT
    assert rows_of(pairs.all_pairs(q, t, 1)) == rows_of(pairs.all_pairs(q, t, None))


def test_searches_refuse_what_they_cant_bound(spark):
    postings, labels = corpus(spark, 5, 20)
    weighed = weights.raw_weights(postings)
    for options in ({"search": "bounds", "norm": "log_l2"}, {"search": "bounds", "overlap": 0.1}, {"search": "overlap"}, {"search": "none"}):
        with pytest.raises(ValueError):
            knn.top_k(weighed, weighed, labels, 3, **options)
    with pytest.raises(ValueError, match="negative"):
        knn.top_k(weighed.withColumn("w", -F.col("w")), weighed, labels, 3, search="bounds")
    with pytest.raises(ValueError, match="candidates"):
        knn.top_k(weighed, weighed, labels, 3, "shared", search="overlap", overlap=0.1)


def test_searches_of_nothing(spark):
    postings, labels = corpus(spark, 6, 20)
    weighed, none = weights.raw_weights(postings), weights.raw_weights(postings).filter("false")
    for q, t in ((none, weighed), (weighed, none), (none, none)):
        for options in ({"search": "bounds"}, {"search": "overlap", "overlap": 0.3}):
            assert knn.scores(q, t, **options).count() == 0


# ---------------------------------------------------------------- what is sent of a pair


def test_pairs_are_sent_as_lists(spark, monkeypatch):
    postings, _ = corpus(spark, 11)
    for weighed in (weights.raw_weights(postings).cache(), weights.weights(postings).cache()):
        q, t = sides(weighed)
        plain = rows_of(q.join(t, "word").select("q", "qw", "doc_id", "tw"))
        monkeypatch.setattr(pairs, "LIST", 1 << 16)
        assert rows_of(pairs.listed(q, t).select("q", "qw", "doc_id", "tw")) == plain
        monkeypatch.setattr(pairs, "LIST", 7)
        assert pairs.grid(q, t).isEmpty() and pairs.grid(q, t, longest=7).filter("a = 1 and b > 1").count() > 0
        assert rows_of(pairs.listed(q, t).select("q", "qw", "doc_id", "tw")) == plain
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = knn.scores(*parts(weighed))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.index("Generate inline") < plan.index("Exchange hashpartitioning(q")


def test_numbers_in_lists_keep_their_values(spark):
    ends = [0, 127, -128, 128, 32767, -32768, 32768, 2**31 - 1, -(2**31), 2**31, 2**63 - 1, -(2**63), None]
    for i in (3, 6, 9, len(ends)):
        df = spark.createDataFrame([(n, str(n)) for n in ends[:i]], "a bigint, x string")
        assert pairs.narrowed(df).filter("x <> coalesce(cast(a as string), 'None')").count() == 0
    kinds = [dict(pairs.narrowed(spark.createDataFrame([(n,)], "a bigint")).dtypes)["a"] for n in (127, 128, 32768, 2**31)]
    assert kinds == ["tinyint", "smallint", "int", "bigint"]


@pytest.mark.parametrize("kinds", [0, 1 << 15])
def test_labels_told_by_numbers_are_the_same(spark, monkeypatch, kinds):
    postings, labels = corpus(spark, 12, 60)
    q, t = parts(weights.raw_weights(postings).cache())
    monkeypatch.setattr(knn, "KINDS", kinds)
    best = {}
    for s in knn.scores(q, t).collect():
        best.setdefault(s["q"], []).append((-s["score"], s["doc_id"]))
    own = {}
    for d, pos, label in sorted(rows_of(labels.select("doc_id", "pos", "label"))):
        own.setdefault(d, []).append(label)
    expected = [(q_, d, label, -s) for q_, found in best.items() for s, d, label in [(s, d, label) for s, d in sorted(found) for label in own.get(d, [])][:5]]
    assert rows_of(knn.top_k(q, t, labels, 5, "shared").select("q", "doc_id", "label", "score")) == sorted(expected)


def test_predictions_in_one_pass(spark):
    ranked = spark.createDataFrame([(1, 5, 2.0), (1, 6, 1.9), (1, 7, 0.1), (2, 5, 0.0), (3, 8, -1.0)], "q bigint, label int, rank double")
    queries = spark.createDataFrame([(q, w) for q in (1, 2, 3, 4) for w in (1, 2)], "doc_id bigint, word bigint")
    counts_ = spark.createDataFrame([(5, 3), (6, 9), (7, 3)], "key int, cnt bigint")
    assert rows_of(rank.predict_or_common(ranked, queries, counts_)) == rows_of(rank.with_fallback(rank.predict(ranked), ranked, queries, counts_))
    assert (4, 6) in rows_of(rank.predict_or_common(ranked, queries, counts_))


# ---------------------------------------------------------------- a stored index


@pytest.mark.parametrize("block_docs", [1 << 16, 32])
def test_a_stored_index_gives_back_its_rows_and_the_same_best(spark, tmp_path, block_docs):
    postings, _ = corpus(spark, 7)
    for weighed, digits in ((weights.raw_weights(postings).cache(), 9), (weights.weights(postings).cache(), 6))[:: 1 if block_docs > 32 else -2]:
        q, t = parts(weighed)
        index = stored.write_index(t, str(tmp_path / f"{digits}"), 6, block_docs)
        assert rows_of(stored.decoded(index).select("doc_id", "word", "w")) == rows_of(t.select("doc_id", "word", "w"))
        best = knn.scores(q, t, digits=digits).filter("score > 0").withColumn("rn", F.expr("row_number() over (partition by q order by score desc, doc_id)"))
        for k in (10,):
            found = stored.search(stored.open_index(spark, str(tmp_path / f"{digits}")), q, k, digits)
            assert rows_of(found.select("q", "rnk", "doc_id", "score")) == rows_of(best.filter(F.col("rn") <= k).select("q", "rn", "doc_id", "score"))


def test_words_may_be_strings(spark, tmp_path):
    t = spark.createDataFrame([(5, "a", 1.5), (5, "b", 0.5), (9, "a", 2.0)], "doc_id bigint, word string, w double")
    index = stored.write_index(t, str(tmp_path / "i"), 2)
    assert rows_of(stored.decoded(index)) == rows_of(t)
    assert index.lists.filter("word = 'a'").select("gaps").first()["gaps"] == [0, 1]


@pytest.mark.parametrize("buckets", [4, 11])
def test_searches_shuffle_queries_alone(spark, tmp_path, buckets):
    postings, _ = corpus(spark, 8)
    q, t = sides(weights.raw_weights(postings))
    index = stored.write_index(t.withColumnRenamed("tw", "w"), str(tmp_path / "i"), buckets)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = q.join(index.lists, "word")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1 and f"SelectedBucketsCount: {buckets} out of {buckets}" in plan


def test_an_unfinished_index_is_refused(spark, tmp_path):
    t = spark.createDataFrame([(5, 1, 1)], "doc_id bigint, word bigint, w bigint")
    stored.write_index(t, str(tmp_path / "i"), 2)
    state.drop_manifest(spark, str(tmp_path / "i"))
    with pytest.raises(state.StaleState):
        stored.open_index(spark, str(tmp_path / "i"))


# ---------------------------------------------------------------- sets of documents


def test_sets_by_bitmaps(spark):
    r = random.Random(9)
    rows = [(r.randrange(0, 10**9) if i % 3 else i, f"k{r.randrange(5)}") for i in range(500)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "doc_id bigint, key string")
    numbers = split.row_numbers(df)
    own = sets.document_sets(df, numbers, "key")
    expected = {}
    for d, k in rows:
        expected.setdefault(k, set()).add(d)
    assert dict(rows_of(sets.sizes(own, "key"))) == {k: len(v) for k, v in expected.items()}
    some, other = own.filter("key in ('k0', 'k1')"), own.filter("key = 'k2'")
    assert sets.sizes(sets.union(some, other)).first()["n"] == len(expected["k0"] | expected["k1"] | expected["k2"])
    assert sets.sizes(sets.union(own.filter("false"))).first()["n"] == 0


def test_confusion_by_bitmaps(spark):
    p = spark.createDataFrame([(1, 5), (2, 5), (2, 5), (40_000, 5), (3, 6)], "q bigint, label int")
    t = spark.createDataFrame([(2, 5), (40_000, 5), (7, 5), (9, 8)], "q bigint, label int")
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 9, 40_000)], "doc_id bigint")
    found = sets.confusion(p, t, split.row_numbers(docs)).select("label", "tp", "fp", "fn")
    assert rows_of(found) == rows_of(evaluate.confusion(p, t).select("label", "tp", "fp", "fn")) == [(5, 2, 1, 1), (6, 0, 1, 0), (8, 0, 0, 1)]


# ---------------------------------------------------------------- saved steps


def small_run(spark, settings, seed=11, origin=""):
    postings, labels = corpus(spark, seed, 60)
    return Run((postings, labels), spark.createDataFrame([(1, 2), (1, 3)], "parent int, child int"), settings, origin)


def test_saved_steps_must_fit(spark, tmp_path):
    plain, folder = replace(Settings(words_below=None, frequent_words=None), k=5), str(tmp_path)
    small_run(spark, plain).steps(folder, last="rank")
    done = small_run(spark, plain)
    done.steps(folder, "evaluate")
    assert done.score.count() == 1
    for settings, first in ((replace(plain, k=20), "rank"), (replace(plain, prop=0.2), "search"), (replace(plain, w=(1.0, 1.0, 1.0, 1.0)), "evaluate")):
        with pytest.raises(state.StaleState, match="other settings"):
            small_run(spark, settings).steps(folder, first)
    with pytest.raises(state.StaleState, match="other inputs"):
        small_run(spark, plain, 12).steps(folder, "rank")
    with pytest.raises(state.StaleState, match="other inputs"):
        small_run(spark, plain, origin="header 1").steps(folder, "rank")
    # A later setting doesn't touch earlier steps.
    small_run(spark, replace(plain, alpha=0.5)).steps(folder, "evaluate")


def test_half_written_and_mixed_steps_are_refused(spark, tmp_path):
    plain, folder = replace(Settings(words_below=None, frequent_words=None), k=5), str(tmp_path)
    small_run(spark, plain).steps(folder)
    small_run(spark, plain).steps(folder, "split", "split")  # later steps now follow an older split
    with pytest.raises(state.StaleState, match="another run"):
        small_run(spark, plain).steps(folder, "rank")
    broken = small_run(spark, plain)
    broken.__dict__["entries"] = spark.range(3).select(F.assert_true(F.col("id") < 2).alias("x"))
    with pytest.raises(Exception):
        broken.steps(folder, "search", "search")
    with pytest.raises(state.StaleState, match="isn't complete"):
        small_run(spark, plain).steps(folder, "rank")
    small_run(spark, plain).steps(folder, "search")
    assert small_run(spark, plain).steps(folder, "evaluate") is None


def test_fingerprints_follow_files_and_rows(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, `b c` string")
    assert state.fingerprint(a) == state.fingerprint(a.repartition(3)) != state.fingerprint(a.filter("a = 1"))
    a.write.parquet(str(tmp_path / "t"))
    one = state.fingerprint(spark.read.parquet(str(tmp_path / "t")))
    assert one == state.fingerprint(spark.read.parquet(str(tmp_path / "t")))
    a.write.mode("append").parquet(str(tmp_path / "t"))
    assert one != state.fingerprint(spark.read.parquet(str(tmp_path / "t")))


def test_picks_are_the_split(spark, data):
    labels = fixtures.basket_labels(spark, data)
    assert rows_of(split.picks(labels, 0.1).select("doc_id").distinct()) == rows_of(split.split_prop(labels, 0.1))
    assert counts.label_counts(labels).count() == len(catalogue.QUERIES["label_sets"](spark, data).collect())


# ---------------------------------------------------------------- what is shuffled


def exchanges(spark, df):
    """Shuffles by hash in a plan without broadcasts but those asked for."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_pairs_are_shuffled_once(spark):
    postings, labels = corpus(spark, 14)
    (q, t), (_, tl) = parts(weights.raw_weights(postings)), parts(labels)
    found = exchanges(spark, lambda: knn.top_k(q, t, tl, 5).groupBy("q", "label").count())
    # Besides both sides of the join on words: pairs to queries, and the queries' own ids.
    on = lambda keys: sum(f"hashpartitioning({keys}" in x.replace("#", ",").replace("L,", ",") for x in found)
    assert on("word") == 2 and on("q") == 2
    assert not any("doc_id" in x and "hashpartitioning(q" in x for x in found)


@pytest.mark.parametrize(("k", "candidates"), [(3, "all"), (60, "all"), (60, "shared")])
def test_entries_equal_plain_ones(spark, k, candidates):
    postings, labels = corpus(spark, 15, 120)
    (q, t), (_, tl) = parts(weights.raw_weights(postings).cache()), parts(labels.cache())
    docs, asked = {}, {}
    for rows, into in ((t, docs), (q, asked)):
        for d, w, x in rows.collect():
            into.setdefault(d, {})[w] = x
    own = {}
    for d, p, label in sorted(tl.collect()):
        own.setdefault(d, []).append(label)
    expected = []
    for a, x in asked.items():
        rows = []
        for b, y in docs.items():
            dot = sum(x[w] * y[w] for w in x.keys() & y.keys())
            if x.keys() & y.keys() or candidates == "all":
                rows.append((-round(dot / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5, 6), b))
        entries = [(b, label, -s) for s, b in sorted(rows) for label in own[b]]
        expected += [(a, i + 1, b, label, s) for i, (b, label, s) in enumerate(entries[:k])]
    assert rows_of(knn.top_k(q, t, tl, k, candidates, digits=6)) == sorted(expected)


def test_queries_that_reach_few_documents_make_every_pair(spark, monkeypatch):
    """Searches leave out nothing for them, and cost several joins of their pairs."""
    postings, labels = corpus(spark, 16, 60)
    (q, t), (_, tl) = parts(weights.raw_weights(postings).cache()), parts(labels)
    full = rows_of(knn.top_k(q, t, tl, 100, digits=6))
    monkeypatch.setattr(pairs, "Bounded", None)
    assert rows_of(knn.top_k(q, t, tl, 1000, digits=6, search="bounds")) == rows_of(knn.top_k(q, t, tl, 1000, digits=6))
    assert full


def test_stored_searches_shuffle_entries_once(spark, tmp_path):
    postings, _ = corpus(spark, 17, 80)
    q, t = parts(weights.raw_weights(postings))
    index = stored.write_index(t, str(tmp_path / "i"), 4)
    found = exchanges(spark, lambda: stored.search(index, q, 5))
    assert not any("doc_id" in x or "hashpartitioning(q" in x and "row" in x for x in found)
    assert sum("hashpartitioning(q" in x and "block" not in x for x in found) == 1
