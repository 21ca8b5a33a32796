"""Packing, passages, bytes, exact copies and licenses against brute force."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same
from tokenizers import Tokenizer

from neargrain.llm import exact, licenses, packing, queries, repeats, substring, suffix
from neargrain.llm.common import BYTE_VALUES

ASCII_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def read(spark, data, name="documents"):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/{name}.parquet").select("doc_id", "text").collect()]


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- packing


def check_packing(rows, docs, capacity=1024):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for doc, text in docs:
        ids.setdefault((doc, text), np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    expected = sorted((d is None, d or 0, len(ids[d, t])) for d, t in docs)
    pieces = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert pieces == expected
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    once = defaultdict(list)
    for d, t in docs:
        once[d].append(ids[d, t])
    for doc, own in by_doc.items():
        assert sum(r["length"] for r in own) == sum(len(x) for x in once[doc])
        if len(once[doc]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r["start"]):
                assert r["start"] == at
                at += r["length"]
                assert zlib.crc32(once[doc][0][r["start"] : at].tobytes()) == r["ids_crc32"]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, sum(r["length"] for r in rows))


def test_packing_of_the_table(spark, data):
    assert check_packing(queries.op2_packing(spark, data).collect(), read(spark, data)) < 0.02


def test_packing_of_odd_rows(spark, odd, none):
    check_packing(packing.pack(odd).collect(), texts_of(odd))
    assert packing.pack(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(), st.sampled_from("\t\n\r\x0b\x0c\x1c\x85\xa0 　 '’sLlVve0123٣½ａ̀<|endoftext|>")), max_size=60))
def test_both_encoders_give_the_same_ids(text):
    slow = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), None)
    fast = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    text = text.encode("utf-8", "ignore").decode()
    assert slow(text).tolist() == fast(text).tolist()


@pytest.mark.parametrize("n", [*range(1, 1100, 7), 1023, 1024, 1025, 5000])
def test_cut_covers_all(n):
    found = list(packing.cut(n, 1024, 50))
    assert [a for a, _ in found] == [sum(x for _, x in found[:i]) for i in range(len(found))] and sum(x for _, x in found) == n
    assert all(1024 // (1024 // x) - x <= max(n // 50, 2) for _, x in found)


def test_all_classes_occur_and_documents_are_cut_little():
    r = np.random.default_rng(3)
    sizes = r.integers(1, 3000, 4000).tolist()
    pieces = [x for n in sizes for _, x in packing.cut(n, 1024, 50)]
    assert {1024 // x for x in pieces} >= set(range(1, 33))
    assert len(pieces) < 3.3 * len(sizes)
    packer = packing.Packer(0, 1024)
    for n in sizes:
        for _, x in packing.cut(n, 1024, 50):
            packer.add(0, 0, np.zeros(x, np.uint32), n)
    packer.finish()
    filled = Counter()
    for row in packer.rows:
        filled[row[5]] += row[2]
    assert sum(1024 - x for x in filled.values() if x & (x - 1)) < 0.02 * sum(sizes)


def test_bins_of_a_class_take_a_fixed_count():
    packer = packing.Packer(0, 1024)
    for i in range(25):
        packer.add(i, 0, np.zeros(100, np.uint32), 100)
    counts = defaultdict(int)
    for r in packer.rows:
        counts[r[5]] += 1
    assert list(counts.values()) == [10, 10]


# ---------------------------------------------------------------- repeated passages and bytes


def in_order(spark, docs):
    """Documents as (place in the order, id, text): by id, null last; those of one id by the hash
    that the operators state."""
    table = spark.createDataFrame(docs, "doc_id bigint, text string").distinct()
    keyed = [(r["id"], r["key"], r["doc_id"], r["text"]) for r in repeats.documents(table, "text", "doc_id").distinct().collect()]
    return [(i, d, t) for i, (_, _, d, t) in enumerate(sorted(keyed, key=lambda x: x[:2]))]


def check_removal(rows, docs, spark, symbols, length, expected):
    ordered = in_order(spark, docs)
    marks = plain.repeated_windows([(i, symbols(t)) for i, _, t in ordered], length)
    by_row = {(d, t): expected(symbols(t), marks[i]) for i, d, t in ordered}
    assert Counter(rows) == Counter((d, *by_row[d, t or ""]) for d, t in docs)


def check_passages(spark, df, docs, length=20):
    rows = [tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]

    def expected(words, gone):
        kept = [w for w, g in zip(words, gone) if not g]
        return len(words), len(words) - len(kept), plain.sha(" ".join(kept))

    check_removal(rows, docs, spark, plain.WORD.findall, length, expected)
    return sum(r[2] for r in rows)


def check_bytes(spark, df, docs, length=100):
    rows = [tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]

    def expected(raw, gone):
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        return len(raw), len(raw) - len(kept), plain.spans(gone), plain.sha(kept)

    check_removal(rows, docs, spark, str.encode, length, expected)
    return sum(r[2] for r in rows)


def patchwork(seed: int, n: int, joiner: str = " ") -> list[tuple[int, str]]:
    """Texts of passages that repeat whole, in part, overlapping, and within a text."""
    r = random.Random(seed)
    parts = [plain.WORD.findall(" ".join(f"v{r.randrange(400)}" for _ in range(r.choice([15, 19, 20, 21, 45, 130])))) for _ in range(12)]
    out = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(5)):
            part = r.choice(parts)
            a = r.choice([0, 0, 3, 11])
            words += part[a : a + r.choice([10, 20, 30, 200])] + [f"own{i}"] * r.randrange(3)
        if r.random() < 0.2:
            words += ["same"] * r.choice([10, 20, 21, 60])
        out.append((r.randrange(10**12) if i % 2 else -i, joiner.join(words)))
    return list(dict(out).items())


def test_passages_of_the_table(spark, data):
    assert check_passages(spark, queries.op3_substring_dedup(spark, data), read(spark, data)) > 0


def test_bytes_of_the_table(spark, data):
    assert check_bytes(spark, queries.op9_suffix_dedup(spark, data), read(spark, data)) > 0


@pytest.mark.parametrize("name", ["op3_substring_dedup", "op9_suffix_dedup"])
def test_removal_equals_sql(spark, data, name):
    assert_same(queries.QUERIES[name](spark, data), queries.ORACLES[name], data)


@pytest.mark.parametrize("seed", range(4))
def test_patchworks(spark, seed):
    docs = patchwork(seed, 80, " " if seed % 2 else "\n")
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(1 + 3 * seed)
    check_passages(spark, substring.remove_repeated_passages(table), docs)
    check_bytes(spark, suffix.remove_repeated_bytes(table), docs)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(3000)}" for _ in range(n))


def common_line(n: int) -> list[tuple[int, str]]:
    """Texts with one line in common, between others; every third text is much like the one before."""
    line = prose(99, 14)
    return [(i, f"{prose(1000 + i - (i % 3 == 2), 30)} {line} {prose(3000 + i, 30)}") for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_bytes_with_hot_anchors(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_LEAST", seed)
    docs = common_line(60) if seed == 2 else patchwork(seed, 60)
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    check_bytes(spark, suffix.remove_repeated_bytes(table), docs)


@pytest.mark.parametrize("seed", range(3))
def test_passages_with_hot_anchors(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_LEAST", seed)
    docs = common_line(60) if seed == 2 else patchwork(seed, 60)
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    check_passages(spark, substring.remove_repeated_passages(table), docs)


def test_hot_slots_are_those_of_common_lines(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_LEAST", 20)
    symbols = lambda data, offsets: (BYTE_VALUES[data], offsets)
    table = spark.createDataFrame(common_line(60), "doc_id bigint, text string").repartition(3)
    hot = repeats.hot_slots(table, symbols, suffix.K, suffix.LENGTH).value
    line = BYTE_VALUES[np.frombuffer(prose(99, 14).encode(), np.uint8)]
    grams = np.lib.stride_tricks.sliding_window_view(line, suffix.K)
    assert 0 < repeats.is_hot(grams, hot).sum() == np.unpackbits(hot).sum()
    other = spark.createDataFrame([(i, prose(i, 70)) for i in range(60)], "doc_id bigint, text string")
    assert not repeats.hot_slots(other, symbols, suffix.K, suffix.LENGTH).value.any()


def test_repeats_in_odd_rows(spark, odd, none):
    check_passages(spark, substring.remove_repeated_passages(odd), texts_of(odd))
    check_bytes(spark, suffix.remove_repeated_bytes(odd), texts_of(odd))
    assert substring.remove_repeated_passages(none).count() == suffix.remove_repeated_bytes(none).count() == 0


def test_rows_that_share_an_id(spark):
    """Two texts under one id, several without an id, and copies of either: what repeats in one
    is never cut out of its namesake."""
    alone = [prose(i, 80) for i in range(40, 46)]
    docs = [(7, alone[0]), (7, alone[1]), (9, alone[1]), (9, alone[1]), (None, alone[2]), (None, alone[3]), (None, alone[3]), (20, alone[2]), (None, alone[4]), (None, f"x {alone[4]} y"), (7, f"{alone[0]} z"), (2**63 - 1, alone[5]), (None, f"{alone[5]} end")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert check_passages(spark, substring.remove_repeated_passages(table), docs) > 0
    assert check_bytes(spark, suffix.remove_repeated_bytes(table), docs) > 0


@pytest.mark.parametrize("n", [1, 8, 51, 211, 1000])
def test_partitions_get_equal_shares_of_buckets(spark, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        deal = repeats.deal_of(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(deal.seats) == 1 << deal.bits >= 4 * n and len(set(deal.seats.tolist())) == len(deal.seats)
    part = spark.createDataFrame([(int(x),) for x in deal.seats], "seat int").selectExpr(f"pmod(hash(seat), {n}) part").groupBy("part").count().collect()
    assert len(part) == n and max(r["count"] for r in part) - min(r["count"] for r in part) <= 1


def test_equal_hashes_are_compared(monkeypatch):
    """With one hash for all bytes to the left, windows still need equal bytes."""
    monkeypatch.setattr(suffix, "mix", lambda x: x * np.uint64(0))
    r = random.Random(5)
    right = bytes(r.randrange(97, 100) for _ in range(40))
    texts = [bytes(r.choice(b"ab") for _ in range(6)) + right for _ in range(30)]
    entries = [(b"\0" * suffix.HEAD + t[6:], t[:6], i, i, 6, 0, 6) for i, t in enumerate(texts)]
    covered = suffix.Suffixes.of(entries)
    marks = covered.settle(40, 34)
    for e, (i, row) in enumerate(zip(covered.ids, marks)):
        assert row.tolist() == [any(t[6 - o : 46 - o] == texts[i][6 - o : 46 - o] for t in texts[:i]) for o in range(7)]


def test_kept_texts_and_spans(spark):
    table = spark.createDataFrame([(1, plain_words := " ".join(f"a{i}" for i in range(30))), (2, f"x {plain_words} y")], "doc_id bigint, text string")
    row = substring.remove_repeated_passages(table).filter("doc_id = 2").first()
    assert (row["kept"], row["spans"]) == ("x y", [1, 31])
    row = suffix.remove_repeated_bytes(table).filter("doc_id = 2").first()
    assert (bytes(row["kept"]), row["spans"]) == (b"x  y", [2, 2 + len(plain_words)])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=8), max_size=9))
def test_loser_tree_merges_runs(runs):
    runs = [sorted(r) for r in runs]
    coded = [(r, [0, *(suffix.common(a, b, 0) for a, b in zip(r, r[1:]))][: len(r)]) for r in runs]
    found = [(runs[r][i], s) for r, i, s in suffix.merge_runs(coded)]
    assert [x for x, _ in found] == sorted(x for r in runs for x in r)
    assert all(s == suffix.common(a, b, 0) for (a, _), (b, s) in zip(found, found[1:]))


def test_automaton_knows_all_substrings():
    r = random.Random(1)
    passages = [(d, 0, [r.randrange(3) for _ in range(40)]) for d in range(6)]
    docs, found = substring.settle_shard(passages, 5)
    marks = plain.repeated_windows([(d, w) for d, _, w in passages], 5)
    covered = {d: [False] * 40 for d, _, _ in passages}
    for d, (a, b) in zip(docs, found):
        covered[d][a:b] = [True] * (b - a)
    assert covered == marks


# ---------------------------------------------------------------- exact copies


def test_exact_copies_equal_sql(spark, data):
    assert_same(queries.op8_exact_dedup(spark, data), queries.ORACLES["op8_exact_dedup"], data)


def test_exact_copies_of_odd_rows(spark, odd, none):
    groups = defaultdict(list)
    for d, t in texts_of(odd):
        groups[t or ""].append(d)
    expected = [(d, max((i for i in g if i is not None), default=None), len(g), plain.sha(t)) for t, g in groups.items() for d in g]
    rows = exact.exact_duplicates(odd).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == Counter(expected)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in rows if r["keep_id"] is not None)
    assert exact.exact_duplicates(none).count() == exact.drop_exact_copies(none).count() == 0
    kept = exact.drop_exact_copies(odd)
    assert kept.columns == odd.columns and sorted(t or "" for _, t in texts_of(kept)) == sorted(groups)


def test_exact_copies_over_many_partitions(spark):
    table = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id % 700)) as text")
    rows = exact.exact_duplicates(table.repartition(40)).filter("text_sha256 = sha2('hot', 256)").collect()
    assert len(rows) == 1334 and {(r["keep_id"], r["group_size"]) for r in rows} == {(3999, 1334)} and sum(r["kept"] for r in rows) == 1


def test_an_id_with_two_texts(spark):
    table = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id bigint, text string")
    assert sorted(texts_of(exact.drop_exact_copies(table))) == [(1, "b"), (2, "a")]


# ---------------------------------------------------------------- licenses


def base_places(text: str | None):
    words = ASCII_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return words, found


def check_licenses(rows, docs):
    expected = {}
    for d, t in docs:
        words, found = base_places(t)
        at = [i for i, _ in found]
        expected.setdefault(d, []).append((len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in expected[r["doc_id"]]
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(filter(None, r["base_labels"].split(","))) <= set(labels) and 0 <= r["score"] <= 1


def test_licenses_of_the_table(spark, data):
    rows, docs = queries.op10_license_scan(spark, data).collect(), read(spark, data)
    assert len(rows) == len(docs) and any(r["n_base"] for r in rows)
    check_licenses(rows, docs)


def test_licenses_of_odd_rows(spark, odd, none):
    check_licenses(licenses.scan_licenses(odd).collect(), texts_of(odd))
    assert licenses.scan_licenses(none).count() == 0


@pytest.mark.parametrize("text, labels, base", [
    ("Licensed  under the M.I.T. license", "mit", 0),
    ("licensed under the MIT-License, version one", "mit", 1),
    ("UNDER THE MIT LICENSE under the mit license", "mit", 2),
    ("licensd under the mitt licence", "mit", 0),
    ("gnu general publik license", "gpl", 0),
    ("gnu lesser general public license", "lgpl", 0),
    ("all rightsreserved", "all-rights-reserved", 0),
    ("Apache License, Version 2.0", "apache-2", 1),
    ("CC-BY-NC", "cc-by-nc", 1),
    ("xcc by nc", "", 0),
    ("éunder the mit license", "", 0),
])
def test_notices(spark, text, labels, base):
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (set(row["labels"].split(",")) >= set(labels.split(",")) if labels else row["labels"] == "") and row["n_base"] == base
    for s in row["spans"]:
        assert s["end_word"] > s["start_word"]


def test_seeds_lose_no_match():
    """Notices with random edits, amid other words: found whenever brute force finds them."""
    r = random.Random(5)
    scanner = licenses.Scanner()
    alphabet = "abcdefghilmnoprstu "
    for n, (notice, label) in enumerate(licenses.NOTICES * 12):
        chars = list(notice)
        for _ in range(r.randrange(licenses.allowed(notice) + 1)):
            at = r.randrange(len(chars))
            chars[at : at + r.choice([0, 1, 1])] = r.choice(["", r.choice(alphabet), r.choice(alphabet)])
        damaged = " ".join("".join(chars).split())
        if plain.edit_distance(damaged, notice) > licenses.allowed(notice):
            continue
        text = f" {' '.join([*plain_filler(r), damaged, *plain_filler(r)])} "
        _, spans, score = scanner.scan(text)
        assert any(s[2] == label for s in spans), (notice, damaged)
        assert score >= 1 - licenses.allowed(notice) / len(notice)
        for a, b, found, errors in spans:
            words = " ".join(text.split()[a:b])
            assert any(found == x and plain.edit_distance(words, y) <= licenses.allowed(y) for y, x in licenses.NOTICES), (words, found, errors)


def test_neighbouring_notices():
    """Every one of several notices in a row is found, however its errors compare with the others'."""
    scanner = licenses.Scanner()
    assert [s[3] for s in scanner.scan(" licensed under the mit licence xx licensed under the mit license yy ")[1]] == [1, 0]
    r = random.Random(8)
    for notice, label in licenses.NOTICES:
        words, planted = [], []
        for _ in range(6):
            chars = list(notice)
            for at in r.sample([i for i, c in enumerate(chars) if c != " "], r.randrange(licenses.allowed(notice) + 1)):
                chars[at] = "9"
            planted.append((len(words), len(words) + len(notice.split()), "".join(chars)))
            words += ["".join(chars), *["qqqqqq"] * 9]
            words = " ".join(words).split()
        spans = [s for s in scanner.scan(f" {' '.join(words)} ")[1] if s[2] == label]
        for a, b, damaged in planted:
            errors = plain.edit_distance(damaged, notice)
            assert any((s[0], s[1]) == (a, b) and s[3] <= errors for s in spans), (notice, damaged, spans)


def test_long_texts_full_of_notices():
    """Half a megabyte of notices with an error each, and one of seeds alone, in seconds."""
    scanner = licenses.Scanner()
    start = time.perf_counter()
    _, spans, score = scanner.scan(" " + "licensed under the mit licence xx " * 15_000)
    assert sum(s[2:] == ("mit", 1) for s in spans) == 15_000 and 0.9 < score < 1
    assert not scanner.scan(" " + "general license reserved rights " * 15_000)[1]
    assert time.perf_counter() - start < 120


def test_a_better_match_makes_another_one_way():
    """Of overlapping matches the better one stays, and the rest of the other's window is searched."""
    scanner = licenses.Scanner(phrases=(), notices=(("licensed under the mit license", "mit"),))
    assert [s[3] for s in scanner.scan(" licensed under the mitx licensed under the mit license ")[1]] == [0]
    assert [s[3] for s in scanner.scan(" licensed under the mit licen licensed under the mit license ")[1]] == [2, 0]


def plain_filler(r: random.Random) -> list[str]:
    return [r.choice(["the", "public", "license", "of", "use", "rights", "q7"]) for _ in range(r.randrange(12))]
