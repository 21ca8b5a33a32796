"""Sharding, ranked search and token alignment against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from neargrain.llm import alignment, queries, ranking, sharding

TEXTS = ["", " ", "a", "under the MIT license", "Ünïcödé – текст 文本", "<|endoftext|> and <s> </s> <unk>", "tab\tand\nline  two", "▁ odd   spaces", "x" * 3000, "\x00\x01 control", "fi ﬁ ① ½"]


# ---------------------------------------------------------------- sharding


def plain_shards(rows, shards=8, slack=100):
    """Counter of (id, size, shard) and, for rows that differ, their slots."""
    body = [((hashlib.md5((t or "").encode()).hexdigest(), i is not None, i or 0), i, len((t or "").encode()) + 1) for i, t in rows]
    body.sort(key=lambda r: r[0])
    total, before, low, high, out = sum(r[2] for r in body), 0, {}, {}, []
    for (g, *_), _, size in body:
        low.setdefault(g, before)
        before += size
        high[g] = before
    edges, before = [], 0
    for (g, *_), _, size in body:
        for t in range(1, shards):
            if shards * before < t * total <= shards * (before + size):
                near = shards * low[g] if slack * (t * total - shards * low[g]) <= total else shards * high[g] if slack * (shards * high[g] - t * total) <= total else shards * (before + size)
                edges.append(near)
        before += size
    before, slots = 0, Counter()
    for _, i, size in body:
        shard = sum(e <= shards * before for e in edges)
        out.append((i, size, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return sorted(out, key=str)


def shards_of(rows):
    return sorted(((r[0], r["size"], r["shard"], r["slot"]) for r in rows.select("row.doc_id", "size", "shard", "slot").collect()), key=str)


def test_shards_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = sharding.shard(odd)
    assert shards_of(found) == plain_shards(rows)
    assert shards_of(sharding.shard(odd, shards=3)) == plain_shards(rows, 3)
    assert shards_of(sharding.shard(odd, shards=1)) == plain_shards(rows, 1)
    assert shards_of(sharding.shard(odd, shards=500)) == plain_shards(rows, 500)
    assert sorted(map(str, found.select("row.*").collect())) == sorted(map(str, odd.collect()))
    assert sharding.shard(none).count() == 0


def test_names_that_sharding_uses_pass_through(spark):
    rows = [(i, f"text {i % 9}" * (i % 7), f"k{i}", i, -i, i * 2, 1, "g", 0, 0.5) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, at long, size long, range long, shard int, slot string, row int, cuts double")
    found = sharding.shard(docs)
    assert sorted(map(tuple, found.select("row.*").collect())) == sorted(rows)
    assert shards_of(found) == plain_shards([r[:2] for r in rows])


def test_a_hot_group_is_divided_and_small_ones_stay_whole(spark):
    rows = [(i, "copy " * 20) for i in range(4000)] + [(10_000 + i, f"{i % 2000} " * (1 + i % 40)) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = sharding.shard(docs)
    assert shards_of(found) == plain_shards(rows)
    held = {r[0]: r[1] for r in found.groupBy("shard").agg(F.sum("size")).collect()}
    mean = sum(held.values()) / 8
    assert len(held) == 8 and all(abs(x - mean) <= 2 * mean / sharding.SLACK + 1000 for x in held.values())
    cut = found.groupBy("row.text").agg(F.count_distinct("shard").alias("n"), F.sum("size").alias("size")).filter("n > 1").collect()
    assert any(r["text"].startswith("copy") for r in cut) and all(r["size"] > mean / sharding.SLACK for r in cut)


def test_ranges_are_even_and_overfull_ones_are_subdivided(spark):
    key = F.struct(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("group"), F.lit(7).cast("bigint").alias("id"), F.col("id").alias("at"))
    keyed = spark.range(0, 60_000, 1, 8).select(key.alias("key"), F.col("id").alias("at"), F.lit(100).cast("bigint").alias("size"))
    n = [r["n"] for r in sharding._in_ranges(keyed, 6_000_000, 16, 1 << 40).groupBy("range").agg(F.count("*").alias("n")).collect()]
    assert len(n) == 16 and max(n) < 1.5 * 60_000 / 16
    n = [r["n"] for r in sharding._in_ranges(keyed, 6_000_000, 16, 50_000).groupBy("range").agg(F.count("*").alias("n")).collect()]
    assert len(n) > 100 and max(n) * 100 <= 2 * 50_000


def test_written_shards_can_be_read(odd, tmp_path):
    sharding.write_shards(sharding.shard(odd), str(tmp_path / "out"))
    back = odd.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and {r[0] for r in back.select("shard").distinct().collect()} <= set(range(8))


def test_no_python_in_the_plan_of_sharding(spark, data):
    plan = queries.op11_sharding(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD|ExistingRDD", plan)


def test_crc_is_unsigned(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op11_sharding(spark, data).collect():
        assert r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode())


# ---------------------------------------------------------------- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_ranks(docs, items, k=50):
    bags = [(i, Counter(TERM.findall(t.translate(LOWER)))) for i, t in docs if t is not None]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set((i, t) for i, t in items if t is not None):
        scores = []
        for i, b, length in bags:
            m = 50 + 50 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(TERM.findall(text.translate(LOWER))) & b.keys())
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def ranks_of(found):
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_ranks_of_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, "W1 w2 w3 w3"), (2, rows[5][1]), (3, None), (4, ""), (5, "под текст 文本 LICENSE"), (5, "mit"), (5, "mit"), (None, "one"), (7, "nothing-here zzz"), (8, "id no")]
    asked = spark.createDataFrame([(i, t, "k", 2) for i, t in items], "item_id long, text string, term string, rank int")
    index = ranking.build_index(odd)
    for k, at_once in ((50, 1 << 18), (3, 4), (1, 1 << 18)):
        assert ranks_of(ranking.search(index, asked, k, terms_at_once=at_once)) == plain_ranks(rows, items, k)
    assert ranking.search(ranking.build_index(none), asked).count() == 0
    assert ranking.search(index, asked.limit(0)).count() == 0


def test_ranks_with_ties_and_copies_over_many_blocks(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(r.randrange(1, 60)))) for i in range(900)]
    rows += [(2000 + i, "W1, w2; common passage") for i in range(700)] + [(3000, "w7 " * 5000)]
    items = [(i, " ".join(f"w{r.randrange(1, 60)}" for _ in range(8))) for i in range(25)] + [(99, "common passage")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    ranking.build_index(docs, str(tmp_path / "index"))
    index = ranking.Index.open(spark, str(tmp_path / "index"))
    assert ranks_of(ranking.search(index, spark.createDataFrame(items, "item_id long, text string"))) == plain_ranks(rows, items)


def test_bytes_bound_impacts():
    counts, lengths = np.arange(1, 4000), np.arange(1, 4000)[::-1]
    g = ranking._impacts(counts, ranking._norms(lengths, 3999, 4_000_000))
    q = -(-g * 255 // ranking.IMPACT)
    assert q.max() <= 255 and (q * ranking.IMPACT // 255 >= g).all() and ((q - 1) * ranking.IMPACT // 255 <= g).all()


def test_norms_beyond_64_bits():
    assert ranking._norms(np.array([10**8]), 10**11, 10**12).tolist() == [50 + 50 * 10**8 * 10**11 // 10**12]


# ---------------------------------------------------------------- alignment


def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    of_a = lambda text: [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    of_b = lambda text: [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return of_a, of_b


def plain_alignments(rows):
    of_a, of_b = sides()
    found, links = [], []
    for i, text in rows:
        tokens = [of_a(text), of_b(text)] if text else [[], []]
        if any(b"".join(w for _, w in side) != (" " + (text or "")).encode() for side in tokens):
            tokens = [[], []]
        placed = []
        for side in tokens:
            at, own = 0, []
            for t, w in side:
                own.append((t, at, at + len(w)))
                at += len(w)
            placed.append(own)
        a, b = placed
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(t) for t, x, y in side if low <= x and y <= end) for side in placed))
            low = end
        pairs = Counter((t, u) for t, x, y in a for u, v, w in b if x < w and v < y)
        links.append(pairs)
        found.append((i, len(a), len(b), len(ends), pairs.total(), ";".join(groups)))
    counts = Counter(p for pairs in links for p in pairs)
    best = defaultdict(int)
    for (t, _), n in counts.items():
        best[t] = max(best[t], n)
    return sorted(((*f, sum(k for p, k in pairs.items() if counts[p] == best[p[0]]), sum(k * counts[p] for p, k in pairs.items())) for f, pairs in zip(found, links)), key=str)


def alignments_of(found):
    return sorted(map(tuple, found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").collect()), key=str)


def test_alignments_of_odd_rows(spark, odd, none):
    short = odd.filter("text is null or length(text) < 7000")
    more = spark.createDataFrame([(900 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    docs = short.select("doc_id", "text", "score", "key").unionByName(more, True)
    expected = plain_alignments([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert alignments_of(alignment.alignment_report(docs, as_text=True)) == expected
    assert alignments_of(alignment.alignment_report(docs, as_text=True, sent_pairs=5)) == expected
    assert alignments_of(alignment.alignment_report(docs, as_text=True, sent_pairs=0)) == expected
    slow = alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert alignments_of(alignment.alignment_report(docs, slow, as_text=True)) == expected
    assert alignment.alignment_report(none).count() == 0


def test_alignment_query_has_digests(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found = {r["doc_id"]: r for r in queries.op13_alignment(spark, data).collect()}
    for i, n_a, n_b, n_groups, n_links, groups, n_best, count_sum in plain_alignments(rows):
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert tuple(found[i]) == (i, n_a, n_b, n_groups, n_links, n_best, count_sum, digest)


def test_overlaps_by_bisection():
    r = np.random.default_rng(3)
    for _ in range(200):
        size = int(r.integers(1, 40))
        a, b = (np.unique(np.append(r.integers(1, size + 1, r.integers(0, 20)), size)) for _ in range(2))
        first, n, group = alignment.overlaps(a, b)
        found = {(i, j) for i, (x, k) in enumerate(zip(first, n)) for j in range(x, x + k)}
        starts = [np.concatenate(([0], x[:-1])) for x in (a, b)]
        assert found == {(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]}
        common = np.intersect1d(a, b)
        assert group.tolist() == np.searchsorted(common, b, "left").tolist()


@pytest.mark.parametrize("name", ["op11_sharding", "op12_ranking"])
def test_query_equals_its_sql(spark, data, name):
    assert_same(queries.QUERIES[name](spark, data), queries.ORACLES[name], data)
