"""Archives, near-duplicates, vectors, the classifier, mixing and the pipeline."""

from __future__ import annotations

import io
import random
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import plain
import pytest
import zstandard
from oracle import assert_same
from pyspark.sql import functions as F

from neargrain.llm import embedding, graph, minhash, mixing, quality, queries, warc
from neargrain.llm.common import materialise

# ---------------------------------------------------------------- archives


def test_archives_equal_sql(spark, data):
    assert_same(queries.op1_warc(spark, data), queries.ORACLES["op1_warc"], data)


def pages_of(spark):
    big = "<p>" + "é" * 300_000
    rows = [(3, "http://a/\r\nX: y", "h" * 100), (1, None, "h" * 100), (2, "u", "h" * 99), (4, "u", "h" * 99), (5, "u", None), (6, "", ""), (7, "u", big), (8, "u", big), (1, None, "h" * 100), (None, "u", "h" * 100), (None, None, None)]
    return spark.createDataFrame([(*r, "d", "x") for r in rows], "page_id bigint, url string, html string, digest string, archive string").repartition(3)


def test_archives_of_odd_pages(spark):
    pages = pages_of(spark)
    rows = warc.round_trip(pages).collect()
    found = sorted(((r["page_id"] or 0), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    first = {"h" * 100: 1, "<p>" + "é" * 300_000: 7}
    expected = []
    for r in pages.collect():
        html = r["html"] or ""
        refers = first.get(html) if html in first and r["page_id"] != first[html] else None
        expected.append((r["page_id"] or 0, len(html.encode()), plain.sha(html), "response" if refers is None else "revisit", refers))
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert {r["url"] for r in rows if r["page_id"] == 3} == {"http://a/%0D%0AX: y"}
    assert warc.round_trip(pages.filter("false")).count() == 0


def test_form_of_an_archive(spark, tmp_path, data):
    """A skippable frame with the dictionary, then one frame per record, each readable alone."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/out", archive_bytes=20_000).collect()
    files = sorted(Path(tmp_path, "out").glob("*.warc.zst"))
    assert len(files) == len(manifest) > 1 and sum(r["records"] for r in manifest) == pages.count()
    raw = files[0].read_bytes()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size])
    decoder = zstandard.ZstdDecompressor(dict_data=warc._kind(dictionary))
    at, n = 8 + size, 0
    while at < len(raw):
        frame = decoder.decompressobj()
        record = frame.decompress(raw[at:])
        assert frame.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        at, n = len(raw) - len(frame.unused_data), n + 1
    assert n == next(r["records"] for r in manifest if r["archive"] == files[0].name)
    assert len(list(warc.open_archive(io.BytesIO(raw)))) == n


def test_archives_are_read_by_as_many_tasks(spark, tmp_path, data):
    folder = f"file://{tmp_path}/out"
    manifest = warc.write_archives(spark.read.parquet(f"{data}/pages.parquet"), folder, archive_bytes=20_000)
    read = warc.read_archives(manifest, folder)
    spread = read.select("archive", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(spread) == manifest.count() == len({r["task"] for r in spread}) > 3


def test_damaged_archives_are_told():
    head, record = warc.archive_head(b"d" * 2000), warc.record(1, "u", b"payload", None)
    packed = zstandard.ZstdCompressor(dict_data=warc._kind(b"d" * 2000)).compress(record)
    assert warc.parse(next(warc.open_archive(io.BytesIO(head + packed))))["page_id"] == 1
    with pytest.raises(ValueError, match="ends within"):
        list(warc.open_archive(io.BytesIO(head + packed[:-4])))
    with pytest.raises(ValueError, match="differ"):
        warc.parse(record.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"))


# ---------------------------------------------------------------- near-duplicate texts


def variants(seed: int) -> dict[int, str]:
    """Texts with copies of rising distance from them, around the threshold and away from it."""
    r = np.random.default_rng(seed)
    out, n = {}, 0
    for g in range(25):
        words = [f"g{g}x{i}" for i in r.integers(0, 5000, int(r.choice([3, 12, 60, 200])))]
        for _ in range(int(r.integers(1, 9))):
            new = list(words)
            for at in r.integers(0, len(words), int(r.integers(0, max(2, len(words) // 25)))):
                new[at] = f"e{r.integers(0, 10**6)}"
            out[n := n + 1] = " ".join(new)
    return out


def check_classes(found: dict[int, int], docs: dict[int, str]):
    """Classes are those of all links; pairs within 1e-9 of the threshold may fall either way."""
    classes, similar = plain.near_classes(docs)
    assert not any(abs(s - 0.8) < 1e-9 for s in similar.values())
    assert found == classes
    assert len(set(found.values())) < len(docs)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_near_classes(spark, seed):
    docs = variants(seed)
    table = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4)
    check_classes({r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(table).collect()}, docs)


def test_near_classes_of_the_table(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    check_classes({r["doc_id"]: r["class_id"] for r in queries.op4_minhash_dedup(spark, data).collect()}, docs)


def test_near_classes_of_odd_rows(spark, odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r["class_id"] for r in rows}
    assert by_id[1] == by_id[2] == 1 and by_id[4] == by_id[5] == 4 and by_id[6] == by_id[7] == 6 and by_id[10] == by_id[11] == 10
    assert {by_id[100 + i] for i in range(25)} == {100} and all(by_id[200 + i] == 200 + i for i in range(30))
    assert by_id[3] == 3 and by_id[None] is None and all(r["kept"] for r in rows if r["doc_id"] is None)
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {i for i, c in by_id.items() if i == c}
    assert minhash.near_duplicates(none).count() == minhash.drop_near_duplicates(none).count() == 0


def test_verified_with_exact_frequencies(spark, monkeypatch):
    """Slots as full as those of a large input: only exact frequencies tell a template from copies."""
    template = " ".join(f"t{i}" for i in range(94))
    docs = {i: f"{template} " + " ".join(f"o{i}x{j}" for j in range(10)) for i in range(20)}
    docs |= {20 + i: " ".join(f"a{i}x{j}" for j in range(60)) for i in range(18)}
    docs |= {40: docs[3] + " end", 41: docs[20] + " end"}
    monkeypatch.setattr(minhash, "document_frequencies", lambda rows: (rows.count(), np.full(1 << minhash.SLOT_BITS, 10**6)))
    table = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4)
    found = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(table).collect()}
    assert found == {**{i: i for i in docs}, 40: 3, 41: 20}
    check_classes(found, docs)


def test_full_slots_weigh_shingles_nearer_than_raw_counts():
    """Heavy-tailed frequencies in ever fuller slots: the part of chance is taken off."""
    rng = np.random.default_rng(5)
    frequency = np.minimum(rng.zipf(1.8, 1 << 20), 5000)
    exact = 1 + np.log((1 + 10_000) / (1 + frequency))
    for slots in (1 << 20, 1 << 14, 1 << 10):
        slot = rng.integers(0, slots, len(frequency))
        counts = np.bincount(slot, frequency, slots).astype(np.int64)
        raw = 1 + np.log((1 + 10_000) / (1 + np.minimum(counts, 10_000)))
        error = {name: np.abs(np.log(w[slot] / exact)).mean() for name, w in (("own", np.exp(minhash.log_idf(10_000, counts))), ("raw", raw))}
        assert error["own"] < error["raw"], slots


def test_near_classes_of_an_id_with_two_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    docs = [(1, a), (2, a + " end"), (2, b), (2, b), (3, b + " end"), (4, c), (4, c + " end"), (None, c)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    found = sorted(tuple(r) for r in minhash.near_duplicates(table).filter("doc_id is not null").collect())
    classes = Counter((i, copy, group) for i, copy, group, _ in found)
    assert classes == {(1, 1, 1): 1, (2, 2, 1): 1, (2, 2, 2): 2, (3, 3, 2): 1, (4, 4, 4): 2}
    assert Counter((i, kept) for i, _, _, kept in found) == {(1, True): 1, (2, True): 2, (2, False): 1, (3, False): 1, (4, True): 1, (4, False): 1}
    kept = Counter(map(tuple, minhash.drop_near_duplicates(table).collect()))
    last = next(t for i, t in kept if i == 4)
    assert kept == {(1, a): 1, (2, b): 2, (4, last): 1, (None, c): 1}


def shuffled_bytes(spark) -> int:
    """Bytes that all stages so far have sent."""
    jvm, sc = spark._jvm, spark.sparkContext
    empty = sc._gateway.new_array(jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, empty, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_only_texts_that_are_compared_are_sent(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"  # joins as large tables have them
    kept = spark.conf.get(name)
    letters = random.Random(3)
    docs = {i: " ".join("".join(letters.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=60)) for _ in range(160)) for i in range(800)}
    docs |= {1000 + i: docs[i] + " end" for i in range(20)}
    table = materialise(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4))
    before = shuffled_bytes(spark)
    spark.conf.set(name, "-1")
    try:
        found = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(table).collect()}
    finally:
        spark.conf.set(name, kept)
    assert found == {i: i - 1000 if i >= 1000 else i for i in docs}
    # Of 8 MB of texts 0.4 MB are compared; shingles of all take about 8 bytes each.
    assert shuffled_bytes(spark) - before < 0.5 * sum(map(len, docs.values()))


@pytest.mark.parametrize("bits", [16, 24])
def test_rows_of_wanted_ids_are_possible(spark, monkeypatch, bits):
    monkeypatch.setattr(minhash, "FILTER_BITS", bits)
    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    wanted = {3 * i for i in range(1000)}
    left = {r["doc_id"] for r in minhash._possible(rows, rows.filter("doc_id % 3 = 0 and doc_id < 3000")).select("doc_id").collect()}
    assert wanted <= left and len(left) < len(wanted) + 2.5 * 100_000 * len(wanted) / (1 << bits)
    assert minhash._possible(rows, rows.filter("false")).count() == 0


def test_near_classes_equal_sql(spark, data):
    assert_same(queries.op4_minhash_dedup(spark, data), queries.ORACLES["op4_minhash_dedup"], data)


def test_a_band_of_unlike_texts(spark, monkeypatch):
    """Thousands of texts of one band, in many blocks, nearly all in classes of their own."""
    docs = {i: " ".join(f"a{i}x{j}" for j in range(12)) for i in range(1500)}
    docs |= {2000 + i: " ".join([*(f"b{i}x{j}" for j in range(30)), f"c{i % 3}"]) for i in range(300)}
    docs |= {3000 + i: docs[2000 + i] + " end" for i in range(300)}
    one_band = lambda samples: np.repeat(np.arange(minhash.BANDS, dtype=np.uint64)[None], len(samples), 0)
    monkeypatch.setattr(minhash, "bands_of", one_band)
    monkeypatch.setattr(minhash, "BLOCK", 400)
    table = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(6)
    found = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(table).collect()}
    assert found == {i: i - 1000 if i >= 3000 else i for i in docs}


def test_rows_that_blocks_send(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 100)
    rows = [(1, i, 10, i < 10) for i in range(1000)] + [(2, i, 10, i > 0) for i in range(500)] + [(3, i, 10, False) for i in range(700)]
    sent = minhash._blocks(spark.createDataFrame(rows, "band bigint, node bigint, size bigint, apart boolean")).collect()
    counts = Counter(r["band"] for r in sent)
    assert counts == {1: 1000 * 1 + 10 * 10, 2: 500 * 5 + 499 * 5}
    for band, m in ((1, 10), (2, 499)):
        met = defaultdict(lambda: ([], []))
        for r in sent:
            if r["band"] == band:
                met[r["i"], r["j"]][not r["asks"]].append(r["node"])
        pairs = {(a, b) for asks, answers in met.values() for a in asks for b in answers}
        assert len(pairs) == m * sum(1 for r in rows if r[0] == band)


def test_samples_agree_as_often_as_texts_are_similar():
    import pyarrow as pa

    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words), " ".join([*words[:3600], *(f"v{i}" for i in range(400))])
    idf = minhash.log_idf(2, np.ones(1 << minhash.SLOT_BITS, np.int64))
    agree = []
    for i in range(30):
        x, _ = minhash.signatures(pa.array([a.replace("w", f"w{i}."), b.replace("w", f"w{i}.")]), idf)
        agree.append((x[0] == x[1]).mean())
    true = minhash.similarities(pa.array([a]), pa.array([b]), idf)[0]
    assert abs(np.mean(agree) - true) < 0.03


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    found = dict(graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    linked = [p for p in links if p[0] != p[1]]
    assert found == plain.components({n for p in linked for n in p}, linked)


# ---------------------------------------------------------------- near-duplicate vectors


def plain_links(vectors: dict[int, list | None]):
    unit = {}
    for i, v in vectors.items():
        if v and None not in v:
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                x = x / np.abs(x).max()
                unit[i] = x / np.linalg.norm(x)
    ids = sorted(unit)
    return [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]


def check_vectors(rows, vectors):
    links = plain_links(vectors)
    counts, classes = Counter(i for p in links for i in p), plain.components(vectors, links)
    found = {r["vec_id"]: r for r in rows}
    assert {i: r["n_links"] for i, r in found.items()} == {i: counts[i] for i in vectors}
    assert {i: r["component_id"] for i, r in found.items()} == classes
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_roots_of_long_chains():
    r = np.random.default_rng(4)
    node = r.permutation(50_000)
    at = r.permutation(50_000)
    assert (embedding._roots(node, at[:-1], at[1:]) == 0).all()
    for _ in range(20):
        node, a, b = r.permutation(60), r.integers(0, 60, 40), r.integers(0, 60, 40)
        expected = plain.components(node.tolist(), zip(node[a].tolist(), node[b].tolist()))
        assert embedding._roots(node, a, b).tolist() == [expected[x] for x in node.tolist()]
    assert len(embedding._roots(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_vectors_of_the_table(spark, data):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    check_vectors(queries.op5_embedding_dedup(spark, data).collect(), vectors)


def test_odd_vectors(spark):
    rows = {0: [1.0, 0.0], 1: [2.0, 0.0], 2: None, 3: [], 4: [0.0, 0.0], 5: [1.0, None], 6: [float("nan"), 1.0], 7: [float("inf"), 1.0], 8: [1e308, 1e307], 9: [1e-308, 0.0], 10: [1.0, 0.0, 0.0], 11: [0.0, 1.0], 12: [1.0, 0.0, 0.0]}
    table = spark.createDataFrame([(i, v, "s", 1) for i, v in rows.items()], "vec_id bigint, embedding array<double>, digest string, node int")
    check_vectors(embedding.near_duplicate_vectors(table).collect(), rows)
    assert embedding.near_duplicate_vectors(table.filter("false")).count() == 0
    extra = table.unionByName(spark.createDataFrame([(None, [1.0, 0.0], "s", 1), (0, [1.0, 0.0], "s", 1)], table.schema))
    found = [(r["vec_id"], r["n_links"]) for r in embedding.near_duplicate_vectors(extra).collect()]
    assert (None, 0) in found and found.count((0, 4)) == 2 and len(found) == 15


def test_vectors_equal_sql(spark, data):
    assert_same(queries.op5_embedding_dedup(spark, data), queries.ORACLES["op5_embedding_dedup"], data)


def test_an_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0])]
    found = embedding.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == {(1, 1, 1): 1, (1, 2, 1): 1, (2, 1, 1): 1, (3, 2, 1): 2, (4, 0, 4): 1}
    assert len({(r["audited_links"], r["audited_found"]) for r in found}) == 1


def test_recall_on_dense_vectors(spark):
    """Thousands of vectors around few centres, many of them near the threshold."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 32))
    x = centres[r.integers(0, 6, 3000)] + r.normal(size=(3000, 32)) * r.choice([0.15, 0.25, 0.4], 3000)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    rows = embedding.near_duplicate_vectors(table).collect()
    true = (x @ x.T >= 0.95).sum(1) - 1
    found = np.zeros(3000, int)
    for row in rows:
        found[row["vec_id"]] = row["n_links"]
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    assert rows[0]["audited_links"] > 500 and rows[0]["audited_found"] >= 0.98 * rows[0]["audited_links"]


def test_parts_of_a_large_shard(spark, monkeypatch):
    """Dealt into parts, shards find the links, counts and classes that they find whole."""
    r = np.random.default_rng(9)
    centres = r.normal(size=(3, 16))
    x = centres[r.integers(0, 3, 900)] + 0.3 * r.normal(size=(900, 16))
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    vectors |= {900 + i: vectors[i] for i in range(40)}
    table = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(embedding, "PART", 100)
    check_vectors(embedding.near_duplicate_vectors(table).collect(), vectors)


def test_large_shards_are_divided(spark, monkeypatch):
    """Few centres and many vectors: shards get centres of their own, and what is still large parts."""
    r = np.random.default_rng(17)
    x = r.normal(size=(60, 24))[r.integers(0, 60, 4000)] + 0.18 * r.normal(size=(4000, 24))
    x[:600] = x[0] + 0.01 * r.normal(size=(600, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [1.0, 0.0]), (5001, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    whole = {r["vec_id"]: r["n_links"] for r in embedding.near_duplicate_vectors(table).collect()}
    for name, value in {"MOST_CENTRES": 4, "PER_CENTRE": 100, "PART": 400, "SAMPLE": 1500}.items():
        monkeypatch.setattr(embedding, name, value)
    rows = embedding.near_duplicate_vectors(table).collect()
    found = {r["vec_id"]: r["n_links"] for r in rows}
    true = (x @ x.T >= 0.95).sum(1) - 1
    assert len(rows) == 4002 and found[5000] == found[5001] == whole[5000] == 1
    counts = np.array([found[i] for i in range(4000)])
    assert (counts <= true).all() and counts.sum() >= 0.98 * true.sum()
    assert {r["component_id"] for r in rows if r["vec_id"] < 600} == {0}


def test_pruning_keeps_diverse_neighbours():
    x = np.array([[1.0, 0.0], [0.999, 0.045], [0.998, 0.06], [0.0, 1.0]])
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1)[:, :3]
    pruned = embedding.robust_prune(d, order, 3, 1.2)
    assert pruned[0, 0] == 1 and 2 not in pruned[0]


# ---------------------------------------------------------------- classifier


def test_held_out_accuracy(spark):
    """Learnt from the larger table's labels that may be seen, judged on those that may not."""
    data = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op6_quality(spark, data).collect()}
    truth = [(rows[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{data}/labels.parquet").collect()]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [(r["predicted"], q) for r, q in truth if r["held_out"]]
    assert sum(p == q for p, q in held) >= 0.9 * len(held) and len(held) > 50


def test_scores_see_nothing_but_the_text(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    seen = docs.selectExpr("doc_id", "text", "'x' as source", "'y' as lang")
    hidden = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) as quality")
    a = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert a == {r["doc_id"]: r["score"] for r in quality.classify(seen, hidden).collect()}


def test_trees_walk_like_a_plain_descent():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 6)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit(x, y, trees=40, depth=3)

    def plain_score(v):
        total = model.prior
        for f, t, leaf in zip(model.feature, model.threshold, model.value):
            i = 0
            while i < len(f):
                i = 2 * i + (2 if v[f[i]] > t[i] else 1)
            total += leaf[i - len(f)]
        return 1 / (1 + np.exp(-total))

    score = model.score(x)
    assert np.allclose(score, [plain_score(v) for v in x]) and ((score > 0.5) == y).mean() > 0.97


def test_quality_of_odd_rows(spark, odd, none, labels):
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert quality.classify(none, labels).count() == 0
    no_labels = labels.filter("false")
    assert {r["predicted"] for r in quality.classify(odd, no_labels).collect()} == {1}
    accepted = quality.accepted(odd, no_labels)
    assert accepted.columns == odd.columns and accepted.count() == odd.count()


# ---------------------------------------------------------------- mixing


def check_mix(rows, docs):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(plain.WORD.findall(text or ""))
    goals, taken = plain.targets(dict(sizes)), defaultdict(int)
    by_id = defaultdict(list)
    for i, text, source in docs:
        by_id[i].append((len(plain.WORD.findall(text or "")), source))
    for r in rows:
        source = next(s for n, s in by_id[r["doc_id"]] if n == r["size"] and sizes[s] == r["source_size"] and abs(goals[s] - r["target"]) < 1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["epochs"] * r["size"] + r["rest"]
        taken[source] += r["taken"]
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= 1, (s, taken[s], goal)


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_mix_of_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = mixing.mix(docs).collect()
    check_mix(rows, rows_of(docs))
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_of_odd_rows(spark, odd, none):
    rows = odd.filter("doc_id is null or doc_id <> 11").dropDuplicates(["doc_id", "text"])
    check_mix(mixing.mix(rows).collect(), rows_of(rows))
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def copies_of(parts) -> dict:
    """How often each document is in a mixture of whole documents."""
    out = Counter()
    for r in parts.collect():
        out[r["doc_id"]] += r["epochs"] + (r["rest"] > 0 and 2 * r["rest"] >= r["size"])
    return +out


def test_mixed_documents_hold_what_is_taken(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = mixing.mixed_documents(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == copies_of(mixing.mix(docs))
    assert set(rows) <= set(docs.collect())


def test_rows_without_an_id_are_mixed(spark):
    docs = spark.createDataFrame([(None if i % 3 else i // 6, f"text {i} of five words", "a") for i in range(90)], "doc_id bigint, text string, source string")
    assert sorted(r["text"] for r in mixing.mixed_documents(docs).collect()) == sorted(r["text"] for r in docs.collect())


def test_mixture_is_laid_out_by_shards(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    shard = {r["doc_id"]: r["shard"] for r in mixing.mix(docs, shards=8).filter("epochs + rest > 0 and taken <= size").collect()}
    laid = mixing.mixed_documents(docs, shards=8).rdd.mapPartitions(lambda rows: [[r["doc_id"] for r in rows]]).collect()
    for ids in laid:
        order = [shard[i] for i in ids if i in shard]
        assert order == sorted(order)
        assert len(ids) < 20 or ids != sorted(ids)


def test_shards_hold_the_target_mixture(spark):
    """Every shard of eight has each source near its share, also of sources that are cut down."""
    docs = spark.range(6000).selectExpr("id as doc_id", "'one two three four five' as text", "concat('s', id % 3) as source")
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    words = defaultdict(Counter)
    for r in mixing.mix(docs, shards=8).collect():
        for c in range(r["epochs"] + (r["rest"] > 0)):
            words[(r["shard"] + c) % 8][sources[r["doc_id"]]] += r["size"] if c < r["epochs"] else r["rest"]
    assert sum(sum(own.values()) for own in words.values()) == 30_000
    for own in words.values():
        for source, share in (("s0", 5 / 8), ("s1", 2 / 8), ("s2", 1 / 8)):
            assert abs(own[source] / sum(own.values()) - share) < 0.07, (source, words)


@pytest.mark.parametrize("sizes, weights, expected", [([100, 100, 100], [5, 2, 1], [187.5, 75, 37.5]), ([10, 100, 100], [5, 2, 1], [30, 120, 60]), ([0, 50], [5, 2], [0, 50]), ([0, 0], [1, 1], [0, 0])])
def test_targets(sizes, weights, expected):
    assert mixing.fill(sizes, weights, float(sum(sizes)), 3.0) == pytest.approx(expected)


def test_quotas_of_the_splitting_tree():
    quotas = np.array([512, 17, 0, 300])
    starts = mixing.split_quotas(quotas, 64, 7)
    assert (starts[0] == 0).all() and (starts[-1] == quotas).all() and (np.diff(starts, axis=0) >= 0).all()
    per_shard = np.diff(starts, axis=0).sum(1)
    assert per_shard.max() - per_shard.min() <= 1


# ---------------------------------------------------------------- pipeline


def test_pipeline_stage_by_stage(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality"](spark, docs, data)
    assert good.columns == docs.columns
    good_ids = {r["doc_id"] for r in good.collect()}
    assert good_ids == {r["doc_id"] for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
    copies = defaultdict(list)
    for i in good_ids:
        copies[text[i]].append(i)
    single = steps["exact"](spark, good, data)
    single_ids = {r["doc_id"] for r in single.collect()}
    assert single.columns == docs.columns and single_ids == {max(g) for g in copies.values()}
    near = steps["near"](spark, single, data)
    classes, _ = plain.near_classes({i: text[i] for i in single_ids})
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == set(classes.values())
    mixed = steps["mix"](spark, near, data)
    taken = copies_of(mixing.mix(near))
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect()) == taken
    packed = corpus_pipeline.run(spark, data)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(taken)
    starts = Counter(r["doc_id"] for r in packed.filter("start = 0").select("doc_id").collect())
    assert starts == Counter(r["doc_id"] for r in mixed.select("doc_id").collect())


def test_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path, labels):
    """Rows of which most count as good: each stage keeps what its docstring says."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    steps = dict(corpus_pipeline.STAGES)
    pairs = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    rows = pairs(odd)
    good = pairs(steps["quality"](spark, odd, str(tmp_path)))
    assert good <= rows and good == pairs(quality.accepted(odd, labels))
    single = steps["exact"](spark, odd, str(tmp_path))
    texts = {t or "" for _, t in rows}
    assert single.columns == odd.columns and sorted(t or "" for _, t in pairs(single)) == sorted(texts)
    near = steps["near"](spark, single, str(tmp_path))
    left = pairs(near)
    assert near.columns == odd.columns and left <= pairs(single) and set(pairs(single)) - set(left) <= {(6, texts_by_id(rows)[6]), (7, texts_by_id(rows)[7])}
    mixed = steps["mix"](spark, near, str(tmp_path))
    assert mixed.columns == odd.columns and set(pairs(mixed)) <= set(left) and (None, "no id") in set(left)
    packed = steps["pack"](spark, mixed, str(tmp_path)).collect()
    assert sum(r["start"] == 0 for r in packed) == sum(pairs(mixed).values())
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def texts_by_id(rows):
    return dict(rows.keys())


def test_stages_keep_columns_of_any_name_and_very_long_texts(spark, tmp_path):
    names = ["__kept", "__text", "__own", "__key", "__id", "__digest", "__times", "__first", "__copy", "__shard", "__place", "__score", "score", "c0", "c5", "key", "shard", "node"]
    r = random.Random(17)
    prose = lambda n: " ".join(f"w{r.randrange(40_000)}" for _ in range(n))
    copy, words = prose(80), prose(450_000).split()  # 3 MB
    texts = {i: prose(80) for i in range(30)} | {50: " ".join(words), 51: " ".join(words[:-3]), 52: copy, 53: copy}
    rows = [(i, t, None if i % 9 == 0 else f"s{i % 3}", *(f"{n} {i}" for n in names)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id bigint", "text string", "source string", *(f"`{n}` string" for n in names)])).repartition(4)
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    expected = {row[0]: row for row in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, str(tmp_path)))
        found = docs.collect()
        assert docs.columns == ["doc_id", "text", "source", *names], name
        assert found and all(tuple(row) == expected[row["doc_id"]] for row in found), name
    ids = {row["doc_id"] for row in found}
    assert 52 not in ids and 51 not in ids and {50, 53} & ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {row["doc_id"] for row in packed.collect()} == ids
