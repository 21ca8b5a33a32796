"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neargrain.llm.common import by_position, materialise

#: Words are runs of anything but space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: The weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is dealt into as many blocks as the square root of its rows, but into so many at least.
BLOCKS = 512


def fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Targets in proportion to weights that add up to ``total``; none is above ``most`` times
    its size, the excess is shared anew by weight among the others until none is above."""
    size, weight = np.array(sizes, np.float64), np.array(weights, np.float64)
    targets, left = np.zeros(len(size)), np.ones(len(size), bool)
    while left.any():
        share = (total - targets[~left].sum()) / weight[left].sum()
        above = left & (weight * share > most * size)
        if not above.any():
            targets[left] = weight[left] * share
            break
        targets[above] = most * size[above]
        left &= ~above
    return targets.tolist()


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards + 1, sources): where each output shard's run of drawn blocks begins in each source.

    A node of the tree has an exact quota of blocks for every source and a range of shards. Its
    left half gets a multivariate-hypergeometric draw of as many blocks as its share of shards,
    the right half the rest, down to single shards. A node's generator is seeded by its range, so
    any worker can redo its own path.
    """
    starts = np.zeros((shards + 1, len(quotas)), np.int64)
    starts[shards] = quotas
    todo = [(0, shards, np.zeros(len(quotas), np.int64), quotas.astype(np.int64))]
    while todo:
        a, b, begin, own = todo.pop()
        starts[a] = begin
        if b - a < 2:
            continue
        middle = (a + b) // 2
        draws = int(own.sum()) * (middle - a) // (b - a)
        left = np.random.default_rng([seed, a, b]).multivariate_hypergeometric(own, draws, method="marginals")
        todo += [(a, middle, begin, left), (middle, b, begin + left, own - left)]
    return starts


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows with a hash of id and text: rows without an id are dealt like others."""
    return docs.withColumn("__key", F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit(""))))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, most: float = 3.0, shards: int = 64, seed: int = 7, blocks: int = BLOCKS) -> DataFrame:
    """How much of every document the mixture takes, and where it goes.

    Returns a row per input row: doc_id, size (words of the text; null: 0), source_size, target,
    taken, epochs (whole copies taken), rest (words of a last, partial copy), shard (of the first
    copy; copy c goes to (shard + c) modulo shards) and place (the order within a shard).

    Sources in code point order, null last, weigh ``weights``, repeating; together they share all
    sizes, each at most ``most`` times its own. A source is dealt into blocks by a hash of id and
    text: as many as the square root of its rows, ``blocks`` at least. Blocks are permuted for each source by a second hash; a mixture takes whole
    passes over the source and then the first permuted blocks, up to the document in which the
    target is reached, of which it takes the words still missing. So a source's total is its
    target rounded to a word, and no document gives more than ceil(most) times its size. The
    blocks that the last pass draws are dealt to output shards by a splitting tree with exact
    quotas, the others by a second one, so every pass over a source lies over all shards; a
    shard's draws are runs of permuted blocks that no other shard has, and ``place`` shuffles
    them locally.

    Nothing is gathered but one row per source. Statistics are summed per block before they are
    shuffled, so a source may hold any part of the rows. Empty texts have size 0 and give 0
    words; repeated rows (same id and text) count each, share a block, and get equal parts where
    they fall in a whole pass. Rows without an id are mixed like others. A text of
    many MB is one document, whose words are counted where it is read. An empty table gives an empty
    result; other columns are ignored.
    """
    return _mix(_keyed(docs, text, doc_id), text, doc_id, source, weights, most, shards, seed, blocks).drop("key")


def _mix(docs: DataFrame, text: str, doc_id: str, source: str, weights: Sequence[float], most: float, shards: int, seed: int, blocks: int) -> DataFrame:
    """``mix`` with each row's ``key``."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col("__key").alias("row"), F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(source).cast("string"))).alias("key"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"))
    sized = materialise(sized, "mixing")
    spark = docs.sparkSession
    # One row per source.
    rows = sorted(sized.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: r["key"])
    few = len(rows) <= 50_000  # so the table of sources has some MB at most
    small = lambda table: F.broadcast(table) if few else table
    dealt = spark.createDataFrame([(r["key"], max(blocks, math.isqrt(r["n"]))) for r in rows], "key string, blocks bigint")
    sized = sized.join(small(dealt), "key").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row"), F.col("blocks")).cast("int")).drop("blocks")
    by_block = materialise(sized.groupBy("key", "block").agg(F.sum("size").alias("block_size")), "blocks")
    sizes = [r["size"] for r in rows]
    share = [float(weights[i % len(weights)]) for i in range(len(rows))]
    targets = fill(sizes, share, float(sum(sizes)), most)
    table = [(r["key"], int(r["size"]), float(t), int(np.floor(t + 0.5))) for r, t in zip(rows, targets)]
    plan = spark.createDataFrame(table, "key string, source_size bigint, target double, goal bigint")

    # A source's blocks in permuted order: a window has the square root of its rows.
    order = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 1), "key", "block"), "block")
    ranked = by_block.withColumn("rank", F.row_number().over(order) - 1).withColumn("before", F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.join(small(plan), "key")
    passes = F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(0)
    ranked = ranked.select(
        "key", "block", "source_size", "target", "rank", "block_size",
        passes.alias("passes"),
        # Words of the last pass that fall in this block.
        F.greatest(F.lit(0), F.least("block_size", F.col("goal") - passes * F.col("source_size") - F.coalesce("before", F.lit(0)))).alias("part"),
    )
    ranked = materialise(ranked, "ranked")
    # Blocks that the last pass draws, and the others, are split apart: so each pass lies over all shards.
    last = F.col("part") > 0
    counts = {r["key"]: (r["last"], r["others"]) for r in ranked.groupBy("key").agg(F.count_if(last).alias("last"), F.count_if(~last).alias("others")).collect()}
    quotas = np.array([counts[r["key"]] for r in rows], np.int64).reshape(-1, 2)
    ends = [split_quotas(quotas[:, i], shards, seed + i)[1:] for i in range(2)] if rows else []
    layout = spark.createDataFrame([(r["key"], *(x[:, i].tolist() for x in ends)) for i, r in enumerate(rows)], "key string, last_ends array<bigint>, other_ends array<bigint>")
    ranked = ranked.join(small(layout), "key")
    among = F.row_number().over(Window.partitionBy("key", last).orderBy("rank")) - 1
    ranked = ranked.withColumn("among", among).withColumn("ends", F.when(last, F.col("last_ends")).otherwise(F.col("other_ends")))
    ranked = ranked.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("among")))).drop("last_ends", "other_ends", "among", "ends")
    # Within the one block of a source that the last pass cuts, documents in hashed order.
    joined = sized.join(ranked, ["key", "block"])
    cut = joined.filter("part > 0 and part < block_size")
    inside = Window.partitionBy("key", "block").orderBy(F.xxhash64(F.lit(seed + 2), "row"), "row").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("rest", F.greatest(F.lit(0), F.least("size", F.col("part") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    whole = joined.filter("part = 0 or part = block_size").withColumn("rest", F.when(F.col("part") > 0, F.col("size")).otherwise(0))
    out = whole.unionByName(cut)
    taken = F.col("passes") * F.col("size") + F.col("rest")
    full = (F.col("rest") == F.col("size")) & (F.col("rest") > 0)
    return out.select(
        "doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"),
        (F.col("passes") + full.cast("int")).cast("bigint").alias("epochs"), F.when(full, 0).otherwise(F.col("rest")).cast("bigint").alias("rest"),
        "shard", F.xxhash64(F.lit(seed + 3), "row").alias("place"), F.col("row").alias("key"),
    )


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, most: float = 3.0, shards: int = 64, seed: int = 7, blocks: int = BLOCKS) -> DataFrame:
    """The mixture itself: the rows of ``docs``, all columns, each as often as taken. Documents stay
    whole: of the one in each source that the target cuts, a last copy is there if at least half of it
    is taken. Repeated rows (same id and text) come as often as the one that is taken most; rows
    without an id, or with an id that other texts have, too, are mixed like others.

    Rows come in the order of their output shards, shuffled locally: a partition has slices of
    shards, one after the other, each in the order of ``place``. Columns may have any names.
    """

    def mixed(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
        keyed = _keyed(docs, text, doc_id)
        parts = _mix(keyed, text, doc_id, source, weights, most, shards, seed, blocks).filter("taken > 0")
        times = F.col("epochs") + ((F.col("rest") > 0) & (2 * F.col("rest") >= F.col("size"))).cast("int")
        parts = parts.groupBy(F.col("key").alias("__key")).agg(F.max(times).cast("int").alias("__times"), F.max("shard").alias("__first")).filter("__times > 0")
        rows = keyed.join(parts, "__key").select("*", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy"))
        shard, place = F.pmod(F.col("__first") + F.col("__copy") - 1, F.lit(shards)), F.xxhash64(F.lit(seed + 3), "__key", "__copy")
        rows = rows.withColumns({"__shard": shard, "__place": place})
        slices = max(1, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
        return rows.repartition("__shard", F.pmod("__place", F.lit(slices))).sortWithinPartitions("__shard", "__place").select(docs.columns)

    return by_position(docs, (text, doc_id, source), mixed)
