"""Helpers that the operators share: text batches as byte buffers, words, hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neargrain.sources import cut as materialise
from neargrain.sources import shared_folder

__all__ = ["materialise", "shared_folder"]

#: Bytes of text that a vectorised step handles at once; bounds the memory of a Python worker.
BATCH_BYTES = 2 << 20


def pieces(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of ``column`` (a longer text stays whole)."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(lengths, dtype=np.int64) - lengths) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def by_position(docs: DataFrame, names: tuple[str, ...], make: Callable[..., DataFrame]) -> DataFrame:
    """``make`` of the rows, whose result has the same columns, with columns named by their places: so
    no name of theirs is one that an operator uses inside. ``names`` are passed on by their new names."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, own))
    return make(docs.toDF(*own), *(at[n] for n in names)).toDF(*docs.columns)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column as numpy arrays; a null text is empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


_RNG = np.random.default_rng(20240229)
#: Random values of bytes, an odd multiplier and its powers, for polynomial hashes modulo 2**64.
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, as a worker needs them again and again."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(1 << max(n, 1024).bit_length(), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive 64-bit values; entry i covers values[i : i + width]."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = _prefix(values)
    return mix((prefix[width:] - prefix[:n]) * powers(INVERSE, n))


def rolling_at(values: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The entries ``at`` of ``rolling``."""
    prefix = _prefix(values)
    return mix((prefix[at + width] - prefix[at]) * powers(INVERSE, len(prefix))[at])


def _prefix(values: np.ndarray) -> np.ndarray:
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(MULTIPLIER, len(values)), dtype=np.uint64, out=prefix[1:])
    return prefix


#: Bytes that separate words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row offsets into them) of the words of every text; words never cross texts."""
    inside = ~is_space[data]
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside.copy()
    after = np.concatenate((inside[1:], [False])) if len(data) else inside.copy()
    first, last = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    before[first], after[last] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words given as byte spans."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(MULTIPLIER, len(data)), dtype=np.uint64, out=prefix[1:])
    back = powers(INVERSE, len(data) + 1)
    return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))


#: Hashes are counted in 2**SLOT_BITS slots: a table of one size.
SLOT_BITS = 20


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_counts(texts: DataFrame, slots: Callable[[pa.Array], np.ndarray]) -> tuple[int, np.ndarray]:
    """(rows, how often each slot is in ``slots`` of the texts), over all rows of ``texts`` (text).
    The driver gets 2**SLOT_BITS sums, however large the input is."""
    width = 1 << (SLOT_BITS - 8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << SLOT_BITS, np.int64), 0
        for whole in batches:
            for batch in pieces(whole, "text"):
                total += np.bincount(slots(batch.column("text")), minlength=1 << SLOT_BITS)
                n += batch.num_rows
        if n:
            parts = [zstandard.compress(total[i * width : (i + 1) * width].astype("<i8").tobytes(), 1) for i in range(256)]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(256)], pa.int32()), pa.array([n, *[0] * 256], pa.int64()), pa.array([b"", *parts], pa.binary())], names=["part", "n", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches:
            for part, more, body in zip(*(c.to_pylist() for c in batch.columns)):
                n += more
                if part >= 0:
                    sums[part] = sums.get(part, 0) + np.frombuffer(zstandard.decompress(body), "<i8")
        if sums or n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *sums], pa.int32()), pa.array([n, *[0] * len(sums)], pa.int64()), pa.array([b"", *(x.tobytes() for x in sums.values())], pa.binary())], names=["part", "n", "body"])

    schema = "part int, n bigint, body binary"
    parts = texts.mapInArrow(count, schema).repartition(F.col("part")).mapInArrow(add, schema).collect()
    total, n = np.zeros(1 << SLOT_BITS, np.int64), 0
    for r in parts:
        n += r["n"]
        if r["part"] >= 0:
            total[r["part"] * width : (r["part"] + 1) * width] += np.frombuffer(r["body"], "<i8")
    return n, total
