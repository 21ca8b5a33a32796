"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neargrain.llm.common import MULTIPLIER, SLOT_BITS, buffer_of, by_position, materialise, mix, pieces, rolling, slot_counts, slot_of, word_hashes, words_of
from neargrain.llm.graph import components
from neargrain.llm.repeats import ITEMS, Deal, buckets, by_document, deal_of, dealt, for_documents

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8**ROWS)**BANDS = 4e-5.
BANDS, ROWS = 14, 3
#: Texts of a band, and about so many bytes of them, that are compared with as many others at once.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Of BANDS * ROWS samples so many must agree before texts are fetched; a pair at the threshold
#: agrees in fewer with probability 2e-5.
LEAST_AGREEING = 23

#: Texts are asked for by 2**FILTER_BITS bits of their ids' hashes, a table of one size (2 MB).
FILTER_BITS = 24

_RNG = np.random.default_rng(90125)
_SALTS = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Variates of the sampling, drawn by 16 bits of a hash each: Gamma(2, 1), its logarithm, uniform.
_GAMMA = _RNG.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LOG_GAMMA = np.log(_RNG.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_UNIFORM = _RNG.random(1 << 16).astype(np.float32)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of texts, sorted by row and hash. A text of
    fewer than five words is one shingle; one without words has none."""
    data, offsets = buffer_of(texts)
    starts, ends, rows = words_of(data, offsets)
    hashes = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(texts)), np.diff(rows))
    whole = rolling(hashes, SHINGLE)
    inside = row[: len(whole)] == row[SHINGLE - 1 :] if len(whole) else np.zeros(0, bool)
    short = [i for i in np.flatnonzero((np.diff(rows) > 0) & (np.diff(rows) < SHINGLE)).tolist()]
    few = np.array([hash(tuple(hashes[rows[i] : rows[i + 1]].tolist())) & (2**64 - 1) for i in short], np.uint64)
    key, at = np.concatenate((whole[inside], few)), np.concatenate((row[: len(whole)][inside], np.array(short, np.int64)))
    order = np.lexsort((key, at))
    key, at = key[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] != at[:-1])))) if len(key) else np.zeros(0, np.int64)
    return at[first], key[first], np.diff(np.append(first, len(key)))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """(documents, in how many of them each slot has a shingle), over all rows."""

    def slots(texts: pa.Array) -> np.ndarray:
        row, key, _ = shingles(texts)
        return np.unique(row << SLOT_BITS | slot_of(key)) & ((1 << SLOT_BITS) - 1)

    return slot_counts(docs.select(F.col(text).alias("text")), slots)


def log_idf(n: int, counts: np.ndarray) -> np.ndarray:
    """Logarithm of the smoothed inverse document frequency 1 + ln((1 + n) / (1 + count)) of slots.
    What a slot has by chance, from other shingles, is taken off: the median of all slots. So a
    rare shingle weighs about as much in a large input, where all slots are full, as in a small one."""
    own = np.clip(counts - np.median(counts), 1, max(n, 1))  # a shingle that is asked for is in a text
    return np.log(1 + np.log((1 + n) / (1 + own))).astype(np.float32)


def signatures(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, BANDS * ROWS) samples, and which rows have any shingle."""
    row, key, count = shingles(texts)
    out = np.zeros((len(texts), BANDS * ROWS), np.uint64)
    if not len(row):
        return out, np.zeros(len(texts), bool)
    weight = np.log(count).astype(np.float32) + idf[slot_of(key)]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    sizes, own = np.diff(np.append(first, len(row))), row[first]
    low = np.uint64(0xFFFF)
    for i, salt in enumerate(_SALTS):
        x = key * salt
        x ^= x >> np.uint64(32)
        x *= salt
        r, c, u = _GAMMA[x >> np.uint64(48)], _LOG_GAMMA[(x >> np.uint64(32)) & low], _UNIFORM[(x >> np.uint64(16)) & low]
        t = np.floor(weight / r + u)
        a = c - r * (t - u) - r
        least = np.repeat(np.minimum.reduceat(a, first), sizes)
        at = np.flatnonzero(a == least)  # sorted by hash, so ties fall alike in every text
        at = at[np.searchsorted(at, first)]
        out[own, i] = mix(key[at] + t[at].astype(np.int64).view(np.uint64) * np.uint64(MULTIPLIER))
    has = np.zeros(len(texts), bool)
    has[own] = True
    return out, has


def bands_of(samples: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys."""
    grouped = samples.reshape(len(samples), BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407)
    for i in range(ROWS):
        total = mix(total * np.uint64(MULTIPLIER) + grouped[:, :, i])
    return total


def _jaccard(sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Weighted Jaccard similarity of n pairs, given as (pair, hash, weight) of both sides; 1 for
    two without shingles."""
    sums = [np.bincount(row, w, n) for row, _, w in sides]
    row, key, w = (np.concatenate(x) for x in zip(*sides))
    order = np.lexsort((key, row))
    row, key, w = row[order], key[order], w[order]
    both = np.flatnonzero((row[1:] == row[:-1]) & (key[1:] == key[:-1]))
    shared = np.bincount(row[both], np.minimum(w[both], w[both + 1]), n)
    either = sums[0] + sums[1] - shared
    return np.where(either > 0, shared / np.where(either > 0, either, 1), 1.0)


def similarities(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Similarity of texts pair by pair with the weights of a table of slots."""
    sides = []
    for texts in (a, b):
        row, key, count = shingles(texts)
        sides.append((row, key, count * np.exp(idf[slot_of(key)].astype(np.float64))))
    return _jaccard(sides, len(a))


# ---------------------------------------------------------------- exact document frequencies

#: A shingle of a text: its hash, how often the text has it, and how many rows have it.
TERM = np.dtype([("key", "<u8"), ("tf", "<u4"), ("df", "<u4")])
#: Terms that are sent back to their texts together.
TOGETHER = 1 << 20
#: Bytes of text whose shingles are found together: few enough for a core's cache.
FITTING = 1 << 18
#: Shingles of rows that are counted together before they are sent (8 bytes each, in one buffer).
AT_ONCE = 1 << 21


def _packed(key: np.ndarray, count: np.ndarray, node: np.ndarray) -> bytes:
    """Shingles sorted by hash with a count each and, of texts that ask, their nodes. Gaps go byte
    by byte: the lower ones are random, the upper ones compress."""
    gaps = np.ascontiguousarray(np.diff(key, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)
    rest = gaps[5:].tobytes() + count.astype("<u4").tobytes() + node.astype("<i8").tobytes()
    return struct.pack("<IB", len(key), len(node) > 0) + gaps[:5].tobytes() + zstandard.compress(rest, 1)


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, asks = struct.unpack_from("<IB", body)
    rest = zstandard.decompress(body[5 + 5 * n :])
    gaps = np.frombuffer(body[5 : 5 + 5 * n] + rest[: 3 * n], np.uint8).reshape(8, n)
    keys = np.cumsum(np.ascontiguousarray(gaps.T).view("<u8").ravel(), dtype=np.uint64)
    return keys, np.frombuffer(rest, "<u4", n, 3 * n), np.frombuffer(rest, "<i8", n if asks else 0, 7 * n)


def _dealt(key: np.ndarray, count: np.ndarray, node: np.ndarray, deal: Deal) -> pa.RecordBatch:
    """Shingles sorted by hash, packed for the buckets of the hashes."""
    bucket = deal.of(key)
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    body = [_packed(key[a:b], count[a:b], node[a:b]) for a, b in zip(edges, np.append(edges[1:], len(key)))]
    return pa.RecordBatch.from_arrays([pa.array(deal.seats[bucket[edges]], pa.int32()), pa.array(body, pa.binary())], names=["bucket", "body"])


def _asking(batches: Iterator[pa.RecordBatch], deal: Deal) -> Iterator[pa.RecordBatch]:
    """Of each chunk of texts: the shingles of each text with its node."""
    for whole in batches:
        for batch in pieces(whole, "text"):
            row, key, count = shingles(batch.column("text"))
            if len(key):
                order = np.argsort(key, kind="stable")
                yield _dealt(key[order], count[order], batch.column("node").to_numpy()[row[order]], deal)


def _held(batches: Iterator[pa.RecordBatch], deal: Deal) -> Iterator[pa.RecordBatch]:
    """Of every AT_ONCE shingles of rows: the distinct ones, and how many rows have each."""
    buffer, n = np.empty(AT_ONCE, np.uint64), 0

    def sent() -> pa.RecordBatch:
        buffer[:n].sort()
        first = np.flatnonzero(np.concatenate(([True], buffer[1:n] != buffer[: n - 1])))
        return _dealt(buffer[first], np.diff(np.append(first, n)), np.zeros(0, np.int64), deal)

    for whole in batches:
        for batch in pieces(whole, "text", FITTING):
            keys = shingles(batch.column("text"))[1]
            while len(keys):
                part, keys = keys[: AT_ONCE - n], keys[AT_ONCE - n :]
                buffer[n : n + len(part)] = part
                n += len(part)
                if n == AT_ONCE:
                    yield sent()
                    n = 0
    if n:
        yield sent()


def _counted(batches: Iterator[pa.RecordBatch], deal: Deal) -> Iterator[pa.RecordBatch]:
    """Of a partition of buckets: to the texts that ask, their shingles with frequencies."""
    nodes, terms = [], []
    for _, bodies in buckets(batches):
        parts = [_unpacked(body) for body in bodies]
        asked = [x for x in parts if len(x[2])]
        if asked:
            key, tf, node = (np.concatenate(x) for x in zip(*asked))
            every, rows = (np.concatenate(x) for x in zip(*((k, c) for k, c, own in parts if not len(own))))
            order = np.argsort(every, kind="stable")
            every, rows = every[order], rows[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            out = np.empty(len(key), TERM)
            out["key"], out["tf"] = key, tf
            out["df"] = np.add.reduceat(rows, first)[np.searchsorted(every[first], key)]
            nodes.append(node)
            terms.append(out)
        if sum(map(len, nodes)) >= TOGETHER:
            yield for_documents(np.concatenate(nodes), np.concatenate(terms), deal).select(["bucket", "body"])
            nodes, terms = [], []
    if nodes:
        yield for_documents(np.concatenate(nodes), np.concatenate(terms), deal).select(["bucket", "body"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = []
        for items in batch.column("items").to_pylist():
            terms = np.sort(np.frombuffer(items, TERM), order="key")
            bags.append(zstandard.compress(b"".join(np.ascontiguousarray(terms[c]).tobytes() for c in TERM.names), 1))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(bags, pa.binary())], names=["node", "bag"])


def bags_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, bag): the shingles of texts ``asked`` (node, text), each text one of ``rows`` (text),
    with exact frequencies over all rows. A chunk sends a shingle once, however many of its rows
    have it; nothing is gathered or broadcast."""
    deal = deal_of(rows.sparkSession)
    every = rows.select("text").mapInArrow(lambda b: _held(b, deal), ITEMS)
    asking = asked.select("node", "text").mapInArrow(lambda b: _asking(b, deal), ITEMS)
    found = dealt(every.unionByName(asking)).mapInArrow(lambda b: _counted(b, deal), ITEMS)
    return by_document(found, TERM, _bags, "node bigint, bag binary")


def weighed(bag: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, weights) of a bag, among n rows."""
    raw = zstandard.decompress(bag)
    size = len(raw) // TERM.itemsize
    tf, df = np.frombuffer(raw, "<u4", size, 8 * size), np.frombuffer(raw, "<u4", size, 12 * size)
    return np.frombuffer(raw, "<u8", size), tf * (1 + np.log((1 + n) / (1 + df.astype(np.float64))))


def _verified(pairs: DataFrame, bags: DataFrame, n: int, threshold: float) -> DataFrame:
    """Of pairs (a, b) of nodes those whose texts are as similar as asked."""

    def side(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, weights = zip(*(weighed(x, n) for x in bodies.to_pylist()))
        return np.repeat(np.arange(len(keys)), [len(x) for x in keys]), np.concatenate(keys), np.concatenate(weights)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for half in pieces(whole, "a_bag", 1 << 20):
                for batch in pieces(half, "b_bag", 1 << 20):
                    s = _jaccard([side(batch.column("a_bag")), side(batch.column("b_bag"))], batch.num_rows)
                    yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    with_b = pairs.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("b_bag")), "b")
    rows = with_b.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("a_bag")), "a").select("a", "b", "a_bag", "b_bag")
    return rows.mapInArrow(check, "a bigint, b bigint, similarity double").filter(F.col("similarity") >= threshold)


_LINKS = "a bigint, b bigint"


def _joining_links(rows: pd.DataFrame, n_rows: int, threshold: float) -> pd.DataFrame:
    """Verified links that join classes, between a block of the texts of a band that are in another
    class than its leader (``asks``) and a block of all texts of the band.

    Texts are compared by their samples; likely pairs are verified here, those that agree most
    first, and pairs that links found before have joined are passed over. So two blocks of n texts
    give n - 1 links at most. A pair that shares several bands is looked at in the first of them.
    """
    slot, asks = int(rows["slot"].iloc[0]), rows["asks"].to_numpy()
    x = np.frombuffer(b"".join(rows["samples"]), "<u4").reshape(len(rows), -1)
    node, packed, apart = (rows[c].to_numpy() for c in ("node", "bag", "apart"))
    root = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
    bags: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}

    def bag(at: int) -> tuple[np.ndarray, np.ndarray, float]:
        if at not in bags:
            key, w = weighed(packed[at], n_rows)
            bags[at] = key, w, float(w.sum())
        return bags[at]

    found: list[tuple[int, int]] = []
    for at in np.flatnonzero(asks).tolist():
        # Of two texts that both ask, the smaller one does.
        others = np.flatnonzero(~asks & (root != root[at]) & ~(apart & (node < node[at])))
        equal = x[others] == x[at]
        agreeing = equal.sum(1)
        first = equal.reshape(len(others), BANDS, ROWS).all(2).argmax(1)
        likely = (agreeing >= LEAST_AGREEING) & (first == slot)
        others, agreeing = others[likely], agreeing[likely]
        for other in others[np.argsort(-agreeing, kind="stable")].tolist():
            if root[other] == root[at]:
                continue
            (key, w, total), (key_b, w_b, total_b) = bag(at), bag(other)
            place = np.minimum(np.searchsorted(key_b, key), len(key_b) - 1)
            hit = key_b[place] == key
            shared = float(np.minimum(w[hit], w_b[place[hit]]).sum())
            if shared >= threshold * (total + total_b - shared):
                found.append((node[at], node[other]))
                root[root == root[other]] = root[at]
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def _blocks(labelled: DataFrame) -> DataFrame:
    """The rows (band, node, size, apart, ...) as blocks (band, i, j, asks) of a bounded size: i are
    blocks of the texts that are in another class than their band's leader, j blocks of all. A text
    is sent once for each i and, if it is apart, once for each j. So a band of n texts of which m
    are apart sends about 2 * n * m / BLOCK rows, and n + m while both are below BLOCK."""
    blocks = lambda rows, size: F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    own = F.col("apart").cast("int")
    bands = labelled.groupBy("band").agg(F.count("*").alias("n"), blocks(F.count("*"), F.sum("size")).alias("all_blocks"), blocks(F.sum(own), F.sum(own * F.col("size"))).alias("apart_blocks"))
    dealt = labelled.join(bands.filter("apart_blocks > 0 and n > 2").drop("n"), "band")
    dealt = dealt.withColumns({"i": F.pmod(F.xxhash64("node"), "apart_blocks").cast("int"), "j": F.pmod(F.xxhash64("node"), "all_blocks").cast("int")})
    answers = F.transform(F.sequence(F.lit(0), F.col("apart_blocks") - 1), lambda b: F.struct(b.alias("i"), F.col("j").alias("j"), F.lit(False).alias("asks")))
    asks = F.transform(F.sequence(F.lit(0), F.col("all_blocks") - 1), lambda b: F.struct(F.col("i").alias("i"), b.alias("j"), F.lit(True).alias("asks")))
    sent = F.explode(F.when(F.col("apart"), F.concat(answers, asks)).otherwise(answers)).alias("sent")
    return dealt.select(*labelled.columns, sent).select(*labelled.columns, "sent.*")


def _possible(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose doc_id is one of ``wanted`` (doc_id), and a few others: those with a hash of which a wanted one
    has the same FILTER_BITS. So texts that nobody asks for aren't shuffled. Were all bits set, every row would be
    left: an exact join has to follow."""

    def placed(df: DataFrame) -> DataFrame:
        at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
        return df.withColumns({"__bucket": F.shiftright(at, 15).cast("int"), "__bit": at.bitwiseAND(F.lit((1 << 15) - 1))})

    sets = placed(wanted.select("doc_id")).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    found = placed(rows).join(F.broadcast(sets), "__bucket")
    byte = "cast(conv(hex(substring(__bits, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int)"
    return found.filter(F.expr(f"shiftright({byte}, cast(__bit % 8 as int)) & 1 = 1")).select(*rows.columns)


def _digest(text: str) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, copy_of, class_id, kept of every row: texts whose TF-IDF five-word shingles have a
    weighted Jaccard similarity of at least ``threshold``, in classes of connected links.

    ``copy_of`` is the smallest id with the same text; ``class_id`` the smallest id of the class;
    ``kept`` marks the one that stays. Weights are term counts by inverse document frequency over
    all rows. Samples take frequencies from a table of one size, by slots of shingle hashes; what
    is verified has the exact frequency of each shingle, from an exchange of hashes.
    Every row is sampled in one pass; copies of a text are then one node. Texts that share a band
    are linked to the smallest in it if their similarity is verified. Texts that stay in another
    class than the smallest of a band are compared with all of that band, in blocks of a bounded
    size, by their samples; what agrees is verified, and only links that join classes come out.
    So links are linear in the rows of a band, yet no two texts of a band that are similar enough
    stay in different classes (but for a pair that agrees in fewer than ``LEAST_AGREEING`` samples:
    2e-5 at the threshold, besides the 4e-5 of the bands).

    Texts without words (null, empty, blank) are near-duplicates only as copies; null counts as
    empty. Rows with a null id are in no class: class_id is null and they are kept. A document is
    an id with a text: repeated rows count as one and come out each; of an id with several texts
    each text is a document of its own, so classes may share a class_id, and of the documents in a
    class that have its smallest id one is kept. Texts are read whole, one of many MB too: a worker
    holds one, with about 100 bytes for each of its words. An empty table gives an empty result. Other
    columns are ignored.
    """
    return _classified(docs, text, doc_id, threshold).select("doc_id", "copy_of", "class_id", "kept")


def _classified(docs: DataFrame, text: str, doc_id: str, threshold: float) -> DataFrame:
    """near_duplicates with the digest of each row's text, null for rows with a null id. Nodes are
    texts, whichever ids they have."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n, counts = document_frequencies(rows)
    idf = docs.sparkSession.sparkContext.broadcast(log_idf(n, counts))  # 2**SLOT_BITS floats

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                samples, has = signatures(batch.column("text"), idf.value)
                keys = pa.array([x if h else [] for x, h in zip(bands_of(samples).view(np.int64).tolist(), has)], pa.list_(pa.int64()))
                packed = pa.array([x.tobytes() for x in (samples >> np.uint64(32)).astype("<u4")], pa.binary())
                sizes = pc.cast(pc.binary_length(batch.column("text")), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), sizes, keys, packed], names=["doc_id", "digest", "size", "bands", "samples"])

    sampled = rows.filter("doc_id is not null").withColumn("digest", _digest("text"))
    sampled = materialise(sampled.mapInArrow(sample, "doc_id bigint, digest binary, size bigint, bands array<bigint>, samples binary"), "samples")
    # Written, so that nodes keep their numbers and the last join can split a digest that very many rows have.
    copies = sampled.groupBy("digest").agg(F.min("doc_id").alias("copy_of"))
    copies = materialise(copies.withColumn("node", F.monotonically_increasing_id()), "digests")
    # Bands and samples of a node are those of any copy; joined by id too, so copies don't gather.
    first = copies.select("digest", F.col("copy_of").alias("doc_id"), "node")
    nodes = sampled.join(first, ["digest", "doc_id"]).dropDuplicates(["node"])
    banded = nodes.select("node", "size", F.posexplode("bands").alias("slot", "band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    in_bands = materialise(banded.join(shared, "band"), "bands")
    pairs = in_bands.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    involved = materialise(first.join(in_bands.select("node").distinct(), "node"), "involved")
    texts = _possible(rows, involved).withColumn("digest", _digest("text")).join(involved, ["digest", "doc_id"]).dropDuplicates(["node"])
    bags = materialise(bags_of(rows, texts), "bags")
    links = materialise(_verified(pairs, bags, n, threshold), "verified")
    classes = materialise(components(links), "classes")

    # Bands where a text is in another class than the leader: blocks of a bounded size are
    # compared two by two, and give links that join classes, never all pairs.
    labelled = in_bands.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    leaders = classes.select(F.col("node").alias("leader"), F.col("component").alias("leads"))
    labelled = labelled.join(leaders, "leader", "left").withColumn("apart", F.col("component") != F.coalesce("leads", "leader"))
    labelled = materialise(labelled.select("band", "slot", "node", "size", "component", "apart"), "labelled")
    sent = _blocks(labelled).join(nodes.select("node", "samples"), "node").join(bags, "node")
    sent = sent.select("band", "i", "j", "asks", "slot", "node", "component", "apart", "samples", "bag")
    added = sent.groupBy("band", "i", "j").applyInPandas(lambda rows: _joining_links(rows, n, threshold), _LINKS)
    added = materialise(added, "joining")
    if not added.isEmpty():
        classes = components(links.select("a", "b").unionByName(added))
    labelled = copies.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialise(labelled.select("component", "digest", "copy_of"), "nodes")
    leads = labelled.groupBy("component").agg(F.min(F.struct("copy_of", "digest")).alias("lead"))
    found = labelled.join(leads, "component").select("digest", "copy_of", "lead")
    found = sampled.select("doc_id", "digest").join(found, "digest")
    kept = F.struct(F.col("doc_id").alias("copy_of"), "digest") == F.col("lead")
    found = found.select("doc_id", "digest", "copy_of", F.col("lead.copy_of").alias("class_id"), kept.alias("kept"))
    apart = rows.filter("doc_id is null").selectExpr("doc_id", "cast(null as binary) digest", "cast(null as bigint) copy_of", "cast(null as bigint) class_id", "true kept")
    return found.unionByName(apart)


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, of which one document for each class stays. Columns may have
    any names."""

    def without(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
        gone = _classified(docs, text, doc_id, threshold).filter("not kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
        marked = docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__own", _digest("__text"))
        return marked.join(gone, (F.col(doc_id).cast("bigint") == F.col("__id")) & (F.col("__own") == F.col("__digest")), "left_anti").drop("__text", "__own")

    return by_position(docs, (text, doc_id), without)
