"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neargrain.llm.common import buffer_of, per_row, pieces, word_hashes, words_of

#: Most labelled rows that the trees are fitted on; those with the smallest hash of their id.
TRAINING_ROWS = 20_000
ACCEPT = 0.7


def _share_repeated(keys: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of hashed items in rows: (items, distinct items, most frequent item's count) of each row."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(k)))
    most = np.zeros(n_rows)
    np.maximum.at(most, r[at], count)
    return np.bincount(r, minlength=n_rows), np.bincount(r[at], minlength=n_rows), most


def _table(*spans: str) -> np.ndarray:
    out = np.zeros(256, bool)
    for s in spans:
        out[[ord(c) for c in s]] = True
    return out


_BYTES = np.arange(256)
_CLASSES = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "space": _table(" \t"),
    "line": _table("\n"),
    "high": _BYTES >= 128,
    "stop": _table(".?"),
    "shout": _table("!"),
    "comma": _table(",;:"),
    "symbol": _table("#$%&*@^~+=_\\"),
    "bar": _table("|"),
    "bracket": _table("<>{}[]()"),
    "slash": _table("/"),
    "quote": _table("\"'`"),
    "dash": _table("-"),
}
#: Small integers for classes of bytes, so that one pass counts all.
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _i, _mask in enumerate(_CLASSES.values()):
    _CLASS_OF[_mask] = _i
FEATURES = [f"share_{c}" for c in _CLASSES] + ["log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "commonest_word", "distinct_pairs", "commonest_pair", "log_lines", "line_bytes", "distinct_lines", "bytes_in_repeated_lines", "capital_words", "words_a_stop", "odd_ends", "log_run"]


def statistics(texts: pa.Array) -> np.ndarray:
    """(rows, features) of whole texts, as float32; all zero for empty and null texts."""
    data, offsets = buffer_of(texts)
    n, size = len(texts), np.diff(offsets).astype(np.float64)
    bytes_ = np.maximum(size, 1)
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS_OF[data]
    counts = np.bincount(row_of * (len(_CLASSES) + 1) + kind, minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)[:, :-1]
    out = [counts[:, i] / bytes_ for i in range(len(_CLASSES))]

    starts, ends, rows = words_of(data, offsets)
    words = np.diff(rows)
    word_row = np.repeat(np.arange(n), words)
    hashes = word_hashes(data, starts, ends)
    per = np.maximum(words, 1)
    longest = np.zeros(n)
    np.maximum.at(longest, word_row, (ends - starts).astype(np.float64))
    _, distinct, most = _share_repeated(hashes, word_row, n)
    same = word_row[1:] == word_row[:-1]
    pairs = (hashes[1:] * np.uint64(31) + hashes[:-1])[same]
    n_pairs, distinct_pairs, most_pair = _share_repeated(pairs, word_row[1:][same], n)
    out += [np.log1p(size), np.log1p(words), per_row(ends - starts, rows) / per, np.log1p(longest), distinct / per, most / per, distinct_pairs / np.maximum(n_pairs, 1), most_pair / np.maximum(n_pairs, 1)]

    breaks = np.zeros(256, bool)
    breaks[10] = True
    line_a, line_b, line_rows = words_of(data, offsets, breaks)
    lines = np.diff(line_rows)
    line_row = np.repeat(np.arange(n), lines)
    line_hash = word_hashes(data, line_a, line_b)
    _, distinct_lines, _ = _share_repeated(line_hash, line_row, n)
    order = np.lexsort((line_hash, line_row))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (line_row[order[1:]] == line_row[order[:-1]])
    out += [np.log1p(lines), np.log1p(size / np.maximum(lines, 1)), distinct_lines / np.maximum(lines, 1), per_row((line_b - line_a) * again, line_rows) / bytes_]

    capital = _CLASSES["upper"][data[starts]] if len(starts) else np.zeros(0, bool)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    stops = _table(".?!")[last]
    odd = ~(_CLASSES["lower"] | _CLASSES["upper"] | _CLASSES["digit"] | _CLASSES["high"] | _table(".,;:?!)\"'"))[last]
    step = np.ones(len(data), bool)
    step[1:] = data[1:] != data[:-1]
    step[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(step)
    run = np.zeros(n)
    if len(at):
        np.maximum.at(run, row_of[at], np.diff(np.append(at, len(data))).astype(np.float64))
    out += [per_row(capital, rows) / per, np.log1p(words / np.maximum(per_row(stops, rows), 1)), per_row(odd, rows) / per, np.log1p(run)]
    return np.stack(out, 1).astype(np.float32)


@dataclass
class Trees:
    """Complete binary trees of one depth, as arrays: node i's children are 2i + 1 and 2i + 2."""

    feature: np.ndarray  # (trees, nodes)
    threshold: np.ndarray  # (trees, nodes); greater goes right
    value: np.ndarray  # (trees, leaves)
    prior: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 150, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Boosting with logistic loss on binned features. Without rows, the score is ACCEPT."""
    nodes, leaves = 2**depth - 1, 2**depth
    if not len(y):
        return Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes), np.float32), np.zeros((0, leaves)), float(np.log(ACCEPT / (1 - ACCEPT)) + 1e-9), depth)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Trees(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf, np.float32), np.zeros((trees, leaves)), float(np.log(mean / (1 - mean))), depth)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")).astype(np.float32) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    n_features, total = x.shape[1], np.full(len(y), model.prior)
    flat = binned + np.arange(n_features) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            index = (flat + ((node - first) * (n_features * bins))[:, None]).ravel()
            hist = [np.bincount(index, np.repeat(w, n_features), width * n_features * bins).reshape(width, n_features, bins) for w in (g, h)]
            left_g, left_h = (a.cumsum(2)[:, :, :-1] for a in hist)
            all_g, all_h = (a.sum(2)[:, :, None] for a in hist)
            gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
            gain[(left_h < least) | (all_h - left_h < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i in range(width):
                f, b = divmod(int(best[i]), bins - 1)
                if gain[i, f, b] > 1e-6 and b < len(edges[f]):
                    model.feature[t, first + i], model.threshold[t, first + i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), model.feature[t, node]] > model.threshold[t, node])
        leaf = node - nodes
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        model.value[t] = value
        total += value[leaf]
    return model


def training_labels(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", most: int = TRAINING_ROWS) -> DataFrame:
    """The labelled rows that may be learnt from: crc32 of the id's text modulo 4 is not 2; of
    several labels of an id, the largest; at most ``most`` rows, by a hash of the id."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(quality).isNotNull() & (F.crc32(F.col(doc_id).cast("string")) % 4 != 2))
    one = known.groupBy(F.col(doc_id).alias("__id")).agg(F.max(quality).cast("int").alias("__quality"))
    return one.orderBy(F.xxhash64("__id"), "__id").limit(most)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = TRAINING_ROWS) -> Trees:
    """Fits the trees on a bounded sample: statistics are computed by the executors, the driver
    gets ``most`` rows of them at most (an id that is there twice counts once)."""
    # TRAINING_ROWS ids and labels: a bounded broadcast.
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(training_labels(labels, most=most)), "__id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                x = statistics(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__quality"), pa.array(x.tolist(), pa.list_(pa.float32()))], names=["id", "quality", "x"])

    found = rows.select("__id", "__quality", "text").mapInArrow(measured, "id bigint, quality int, x array<float>").dropDuplicates(["id"]).orderBy("id").toArrow()
    x = np.array(found.column("x").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, found.column("quality").to_numpy().astype(np.float64))


def with_score(docs: DataFrame, model: Trees, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text, in one pass without a shuffle; a
    column that has the score's name already makes way."""
    docs = docs.drop(score)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(statistics(batch.column(text))), pa.float64())], names=[*batch.schema.names, score])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Scores depend on the text alone; null and empty texts get the score of all-zero statistics.
    Ids without a label are scored like others; a null id is not held out. Repeated rows get
    equal scores. With no label to learn from, every score is ``accept``. Texts are read whole, one of many
    MB too: a worker holds one, with some times its size. An empty table gives an empty result; other
    columns of both tables are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = with_score(rows, train(docs, labels, text, doc_id))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows, all columns, whose score is at least ``accept``."""
    names = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no clash with the score's name
    scored = with_score(renamed, train(docs, labels, text, doc_id), f"c{names.index(text)}", "__score")
    return scored.filter(F.col("__score") >= accept).drop("__score").toDF(*names)
