"""Alignment of the tokens that two tokenizers make of the same texts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neargrain.llm.common import materialise, pieces

#: Bytes of text that are aligned together.
TOGETHER = 1 << 20
#: Pairs of ids whose counts every task gets (17 bytes each); counts of the others are joined.
SENT_PAIRS = 1 << 19
#: Distinct pairs that a task counts before it sends them on.
COUNTED = 1 << 21
#: A pair is one number: A's id times this, plus B's id.
SIDE = 1 << 31

_ALIGNED = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups {}, pairs binary"


@dataclass(frozen=True)
class Tokenizers:
    """A: a byte-level vocabulary of ``tokenizers``, and optionally the same as ranks, with which
    `tiktoken` finds the same ids faster. B: a `sentencepiece` model. None: those of public_tokenizers."""

    a: str
    b: str
    ranks: str | None = None

    @cached_property
    def _a(self):
        """(text -> ids, bytes by id); special tokens' strings are plain text."""
        if self.ranks:
            import public_tokenizers
            import tiktoken

            with open(self.ranks, "rb") as lines:
                table = {base64.b64decode(x): int(y) for x, y in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            return lambda text: fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64), {i: w for w, i in table.items()}
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(self.a)
        slow.encode_special_tokens = True
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        others = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}
        words = {i: bytes(byte[c] for c in w) for w, i in slow.get_vocab(with_added_tokens=False).items()}
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.int64), words

    @cached_property
    def _b(self):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=self.b)
        pieces_ = ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
        words = {i: bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces_}
        return lambda text: np.array(model.encode(text), np.int64), words

    @cached_property
    def _tables(self):
        """(bytes by id, lengths by id) of both sides, and what the ids are in a list of groups."""
        out, shown, base = [], [], []
        for (_, words), inner in ((self._a, b",|"), (self._b, b",;")):
            n = max(words, default=-1) + 1
            table = [words.get(i, b"") for i in range(n)]
            out.append((table, np.array([len(w) for w in table], np.int64)))
            base.append(len(shown))
            shown += [b"%d%c" % (i, end) for i in range(n) for end in inner]
        return out, np.array(shown, object), base

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none where a side's bytes aren't those of the text after a space."""
        whole = b" " + text.encode()
        ids = self._a[0](" " + text), self._b[0](text)
        (a, _), (b, _) = self._tables[0]
        if any(b"".join(map(table.__getitem__, x.tolist())) != whole for table, x in zip((a, b), ids)):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return ids


@lru_cache(maxsize=2)
def _loaded(tokenizers: Tokenizers) -> Tokenizers:
    """One for each worker: the tables are made once."""
    return tokenizers


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + sizes[0] - 1, then the same of the next, and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, n, group): for each A token the B tokens that its bytes overlap, n from ``first`` on;
    and the group of each B token. Tokens are given by where they end, the first at byte 0.

    B's tokens don't overlap each other, so their starts and ends, both in order, are the whole
    interval index: the tokens that a stretch stabs lie between two bisections. A gap between two
    B tokens that some A token overlaps on both sides is spanned; all other gaps part groups.
    """
    a_starts, b_starts = (np.concatenate(([0], x[:-1])) if len(x) else x for x in (a_ends, b_ends))
    first = np.searchsorted(b_ends, a_starts, "right")
    n = np.searchsorted(b_starts, a_ends, "left") - first
    spans = np.zeros(len(b_ends) + 1, np.int64)  # by gap: before B token j
    np.add.at(spans, first + 1, n > 1)
    np.add.at(spans, np.minimum(first + n, len(b_ends)), -(n > 1).astype(np.int64))
    spanned = np.cumsum(spans)[: len(b_ends)] > 0
    return first, n, np.cumsum(~spanned) - 1


def _align(texts: pa.Array, tokenizers: Tokenizers, as_text: bool) -> list[list]:
    """For each text: n_a, n_b, n_groups, n_links, groups, pairs."""
    ids = [tokenizers.encoded(t) if t else (np.zeros(0, np.int64),) * 2 for t in texts.to_pylist()]
    n_a, n_b = (np.array([len(x[side]) for x in ids], np.int64) for side in (0, 1))
    a, b = (np.concatenate([x[side] for x in ids]) for side in (0, 1))
    tables, shown, base = tokenizers._tables
    first, n, group = overlaps(np.cumsum(tables[0][1][a]), np.cumsum(tables[1][1][b]))
    # Texts lie end to end; a text's end is an end of both sides, so no group or link crosses it.
    of_a, of_b = (np.repeat(np.arange(len(ids)), x) for x in (n_a, n_b))
    n_groups_of = np.zeros(len(ids), np.int64)
    new_group = np.concatenate(([True], group[1:] != group[:-1])) if len(b) else np.zeros(0, bool)
    np.add.at(n_groups_of, of_b[new_group], 1)
    n_links = np.bincount(of_a, n, len(ids)).astype(np.int64) if len(a) else np.zeros(len(ids), np.int64)

    # The list of groups: all A tokens of a group, then its B tokens.
    of_group = group[first] if len(a) else first
    b_start = np.flatnonzero(new_group)
    a_stop = np.searchsorted(of_group, np.arange(len(b_start)), "right")
    listed = np.zeros(len(a) + len(b), np.int64)
    last = lambda g: np.concatenate((g[1:] != g[:-1], [True])) if len(g) else np.zeros(0, bool)
    listed[np.arange(len(a)) + b_start[of_group]] = base[0] + 2 * a + last(of_group)
    listed[np.arange(len(b)) + a_stop[group]] = base[1] + 2 * b + last(group)
    strings, ends = shown[listed].tolist(), np.cumsum(n_a + n_b).tolist()
    lists = [b"".join(strings[end - k : end])[:-1] for end, k in zip(ends, (n_a + n_b).tolist())]
    groups = [x.decode() for x in lists] if as_text else [hashlib.sha256(x).hexdigest() if x else "" for x in lists]

    # Distinct pairs of each text, and how many links have each.
    pair = np.repeat(a, n) * SIDE + b[ranges(first, n)]
    owner = np.repeat(of_a, n)
    order = np.lexsort((pair, owner))
    pair, owner = pair[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])))) if len(pair) else np.zeros(0, np.int64)
    times, pair = np.diff(np.append(new, len(pair))), pair[new]
    edges = np.searchsorted(owner[new], np.arange(len(ids) + 1))
    packed = [_packed(pair[x:y], times[x:y]) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return [n_a, n_b, n_groups_of, n_links, groups, packed]


def _packed(pair: np.ndarray, times: np.ndarray) -> bytes:
    """Rising numbers as gaps, byte by byte, so that the upper bytes compress; and small ones."""
    gaps = np.ascontiguousarray(np.diff(pair, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(gaps.tobytes() + times.astype("<u4").tobytes(), 1)


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(body)
    n = len(raw) // 12
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view("<i8").ravel()
    return np.cumsum(gaps), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): in how many texts of a partition; sums of up to COUNTED distinct pairs at once."""
    waiting: list[np.ndarray] = []
    pair, n, held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate((pair, *waiting))
        found, place = np.unique(every, return_inverse=True)
        return found, np.bincount(place, np.concatenate((n, np.ones(len(every) - len(pair), np.int64)))).astype(np.int64)

    for batch in batches:
        for body in batch.column("pairs").to_pylist():
            waiting.append(_unpacked(body)[0])
            held += len(waiting[-1])
            if held >= COUNTED:
                pair, n = merged()
                waiting, held = [], 0
                if len(pair) >= COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
                    pair = n = np.zeros(0, np.int64)
    pair, n = merged()
    if len(pair):
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])


def align(docs: DataFrame, tokenizers: Tokenizers | None = None, text: str = "text", doc_id: str = "doc_id", as_text: bool = True) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs: the tokens of every row's text by two
    tokenizers, aligned by the bytes that they stand for.

    ``groups`` lists the smallest stretches at whose ends tokens of both sides end, as
    ``a1,a2|b1;a3|b2,b3`` (with ``as_text`` off the SHA-256 of that); ``pairs`` packs the pairs of ids
    whose bytes overlap, with the number of such places. A takes a space and the text, B the text, to
    which it adds the space. Texts that are null, empty or that a side doesn't give back byte by byte
    have no tokens: zeros, and an empty list. Each task aligns what it reads, without a shuffle, whole
    texts at a time; a text of many MB needs about 200 times its size of memory. Repeated rows are
    aligned each; a null id stays null; an empty table gives an empty result; other columns are
    ignored. ``row`` is unique.
    """
    import public_tokenizers
    from pyspark import TaskContext

    given = tokenizers or Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    paths = given.a, given.b, given.ranks

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = _loaded(Tokenizers(*paths)), TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in pieces(whole, "text", TOGETHER):
                columns = _align(batch.column("text"), own, as_text)
                numbers = [pa.array(x, pa.int64()) for x in columns[:4]]
                rows = pa.array(np.arange(row, row + batch.num_rows), pa.int64())
                yield pa.RecordBatch.from_arrays([rows, pc.cast(batch.column("doc_id"), pa.int64()), *numbers, pa.array(columns[4], pa.string()), pa.array(columns[5], pa.binary())], names=[c.split()[0] for c in _ALIGNED.split(", ")])
                row += batch.num_rows

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(make, _ALIGNED.format("string"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n, best: in how many rows two ids are linked, and whether no other pair of the same A id
    is in more. Tasks count before they send."""
    counts = aligned.select("pairs").mapInArrow(_counted, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "pairs")
    a = F.floor(F.col("pair") / SIDE)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))  # a row for each id of A's vocabulary
    return counts.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _common(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` pairs have it or more; counts are looked at in
    steps of an eighth of a power of two, so that the driver gets some hundred rows."""
    step = F.ceil(F.log2("n") * 8)  # pairs of a step have at least 2 ** ((step - 1) / 8)
    kept, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("m"), F.min("n").alias("least")).collect(), reverse=True):
        kept += r["m"]
        if kept > most:
            break
        least = r["least"]
    return least if least is not None else (1 << 62)


def link_counts(aligned: DataFrame, counts: DataFrame, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """The rows of ``align``, written, with n_best and count_sum: links whose pair is its A id's best,
    and the sum over links of their pairs' counts.

    The counts of the most common pairs, a bounded number, go to all tasks; links of the others, which
    are in few rows each, are joined by pair and summed for each row."""
    spark = aligned.sparkSession
    least = _common(counts, sent_pairs)
    common = counts.filter(F.col("n") >= least).toArrow().sort_by("pair")
    table = spark.sparkContext.broadcast(tuple(common.column(c).to_numpy() for c in ("pair", "n", "best")))

    def places(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table.value[0], pair), max(len(table.value[0]) - 1, 0))
        return at, table.value[0][at] == pair if len(table.value[0]) else np.zeros(len(pair), bool)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((2, batch.num_rows), np.int64)
            for i, body in enumerate(batch.column("pairs").to_pylist()):
                pair, times = _unpacked(body)
                at, found = places(pair)
                at, times = at[found], times[found]
                sums[:, i] = times[table.value[2][at]].sum(), (times * table.value[1][at]).sum()
            columns = batch.drop_columns("pairs")
            yield pa.RecordBatch.from_arrays([*columns.columns, *map(pa.array, sums)], names=[*columns.schema.names, "n_best", "count_sum"])

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, body in zip(batch.column("row").to_pylist(), batch.column("pairs").to_pylist()):
                pair, times = _unpacked(body)
                missing = ~places(pair)[1]
                if missing.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(missing.sum()), row)), pa.array(pair[missing]), pa.array(times[missing])], names=["row", "pair", "times"])

    schema = ", ".join(c for c in _ALIGNED.format("string").split(", ") if not c.startswith("pairs"))
    out = aligned.mapInArrow(known, f"{schema}, n_best bigint, count_sum bigint")
    rest = counts.filter(F.col("n") < least)
    if rest.isEmpty():
        return out
    links = aligned.select("row", "pairs").mapInArrow(unknown, "row bigint, pair bigint, times bigint").join(rest, "pair")
    more = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return out.join(more, "row", "left").select(*[c.split()[0] for c in schema.split(", ")], add("n_best", "more_best"), add("count_sum", "more_sum"))


def alignment_report(docs: DataFrame, tokenizers: Tokenizers | None = None, text: str = "text", doc_id: str = "doc_id", as_text: bool = False, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """``align`` and ``link_counts`` of every row; alignments are written once in between."""
    aligned = materialise(align(docs, tokenizers, text, doc_id, as_text), "aligned")
    counts = materialise(pair_counts(aligned), "counts")
    return link_counts(aligned, counts, sent_pairs)
