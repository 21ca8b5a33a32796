"""Shards of near equal bytes from sampled splitters; DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neargrain.llm.common import materialise

SHARDS = 8
#: Points of the sample of a corpus and, where a range is subdivided, for each part that it gets.
SAMPLE_POINTS, PART_POINTS = 8192, 64
#: Ranges of the first level, and the parts that one of them may get at the second.
RANGES, MOST_PARTS = 64, 256
#: A range that holds more bytes is overfull, as is one of more than twice the mean.
RANGE_BYTES = 256 << 20
#: A boundary that would cut a group of equal keys moves to the group's edge if that costs at most
#: one in so many of a shard's bytes.
SLACK = 100


def _points(rows: DataFrame, per_byte: Column) -> DataFrame:
    """A size-weighted sample: a row stands for size * per_byte points, rounded at random by a hash
    of its place; rows without a point go."""
    u = F.pmod(F.xxhash64("at", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.withColumn("points", F.floor(F.col("size") * per_byte + u)).filter("points > 0")


def _quantiles(points: DataFrame, by: str) -> DataFrame:
    """(by, cuts): the keys at which the running share of points passes 1 / parts, 2 / parts ... of
    all in a group. ``points`` is a sample, of a bounded size for each group."""
    own = Window.partitionBy(by)
    run = F.sum("points").over(own.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = points.withColumns({"run": run, "whole": F.sum("points").over(own)})
    step = lambda c: F.floor(c * F.col("parts") / F.col("whole"))
    crossing = rows.filter(F.least(step(F.col("run")), F.col("parts") - 1) > step(F.col("run") - F.col("points")))
    return crossing.groupBy(by).agg(F.array_sort(F.collect_set("key")).alias("cuts"))


def _in_ranges(keyed: DataFrame, total: int, n_ranges: int, range_bytes: int) -> DataFrame:
    """``keyed`` with ``range``, a number that rises with the key. Splitters are quantiles of a
    size-weighted sample; a range that holds too much gets splitters of its own."""

    def lookup(rows: DataFrame, cuts: DataFrame, name: str) -> DataFrame:
        found = F.size(F.filter("cuts", lambda c: c <= F.col("key")))
        return rows.join(F.broadcast(cuts), "all", "left").withColumn(name, F.coalesce(found, F.lit(0))).drop("cuts")

    keyed = keyed.withColumn("all", F.lit(0))
    sample = _points(keyed.select("all", "key", "at", "size"), F.lit(SAMPLE_POINTS / total)).withColumn("parts", F.lit(n_ranges))
    # Written, so that a lost executor can't give other cuts to some rows: one row of n_ranges cuts.
    first = lookup(keyed, materialise(_quantiles(sample, "all"), "splitters"), "first").withColumn("all", F.col("first"))
    limit = max(1, int(min(range_bytes, 2 * total / n_ranges)))
    held = first.groupBy("all").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > limit)
    parts = F.least(F.ceil(2 * F.col("bytes") / limit), F.lit(MOST_PARTS)).cast("int")
    overfull = materialise(held.withColumn("parts", parts), "overfull")  # a row a range
    inside = first.select("all", "key", "at", "size").join(F.broadcast(overfull), "all")
    cuts = materialise(_quantiles(_points(inside, F.col("parts") * PART_POINTS / F.col("bytes")), "all"), "splitters")
    second = lookup(first, cuts, "second")
    return second.withColumn("range", F.col("first") * MOST_PARTS + F.col("second")).drop("all", "first", "second")


def shard(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", group: str | None = None, shards: int = SHARDS, ranges: int = RANGES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """row, size, shard, slot: every row of ``docs`` (as a struct, so no name can clash) in one of
    ``shards`` shards of near equal bytes, and its place there, from 0 without a gap.

    Rows are in the order of the column ``group`` (by default a digest of the text), then of id, and
    shards are stretches of this order, so equal texts lie side by side. Splitters are drawn from a
    size-weighted sample of keys at its quantiles and divide the order into ranges; overfull ones are
    subdivided. The bytes before each range are exact sums, and the boundary between two shards is
    the row at which the byte i / ``shards`` of all lies, found in the one range that has it. Where
    it would cut a group, it moves to the group's edge if that costs at most 1 / ``SLACK`` of a
    shard, so only large groups are cut. A shard's bytes are within one row's and two such moves of an
    equal share.

    A row's size is its text's UTF-8 bytes and 1; a null text has no bytes, and lies with empty ones. Null
    ids come first in their group. Repeated rows are rows each, and a range of rows that are all alike
    is divided by their places in the input. A long text is one row and isn't cut. An empty table gives
    an empty result.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    body = F.coalesce(F.col(at[text]).cast("string"), F.lit(""))
    order = F.struct((F.col(at[group]).cast("string") if group else F.md5(body)).alias("group"), F.col(at[doc_id]).cast("bigint").alias("id"), "at")
    row = F.struct(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)]).alias("row")
    placed = docs.toDF(*names).withColumn("at", F.monotonically_increasing_id())
    # Written, so that places in the input stay the same however often they are read.
    keyed = materialise(placed.select(row, order.alias("key"), "at", (F.octet_length(body).cast("bigint") + 1).alias("size")), "keyed")
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    ranged = _in_ranges(keyed, max(total, 1), ranges, range_bytes)
    # A row a range, (ranges + 1) * MOST_PARTS at most: few enough for one task and a broadcast.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    sums = sums.select("range", "bytes", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")])
    sums = materialise(sums, "ranges")

    def run(rows: DataFrame, some: DataFrame) -> DataFrame:
        """Rows of some ranges with the bytes and rows before them in the whole order."""
        within = Window.partitionBy("range").orderBy("key")
        bytes_ = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
        return rows.join(F.broadcast(some.drop("bytes")), "range").withColumns({"bytes_before": F.col("bytes_before") + bytes_, "rows_before": F.col("rows_before") + F.row_number().over(within) - 1})

    edges = _edges(ranged.select("range", "key", "size"), sums, run, total, shards)
    bounds = F.array(*[F.lit(b).cast("bigint") for b, _ in edges]) if edges else F.array().cast("array<bigint>")
    starts = F.array(*[F.lit(r).cast("bigint") for r in (0, *[r for _, r in edges])])
    number = F.size(F.filter(bounds, lambda b: b <= F.col("bytes_before") * shards))
    out = run(ranged, sums).withColumn("shard", number)
    return out.select("row", "size", "shard", (F.col("rows_before") - F.get(starts, F.col("shard"))).alias("slot"))


def _edges(slim: DataFrame, sums: DataFrame, run: Callable[[DataFrame, DataFrame], DataFrame], total: int, shards: int) -> list[tuple[int, int]]:
    """(bytes times ``shards``, rows) before the first row of shards 1, 2 ... Bytes are counted in
    parts of 1 / ``shards``, so that equal shares are whole numbers. The driver gets one row for each
    boundary."""
    if not total:
        return []
    targets = F.array(*[F.lit(i * total).cast("bigint") for i in range(1, shards)]) if shards > 1 else F.array().cast("array<bigint>")
    crossed = lambda size: F.filter(targets, lambda t: (F.col("bytes_before") * shards < t) & (t <= (F.col("bytes_before") + F.col(size)) * shards))
    holding = sums.filter(F.size(crossed("bytes")) > 0)
    at = run(slim, holding).withColumn("target", F.explode(crossed("size")))
    found = at.select("target", F.col("key.group").alias("group"), ((F.col("bytes_before") + F.col("size")) * shards).alias("past"), (F.col("rows_before") + 1).alias("rows")).collect()
    groups = sorted({r["group"] for r in found}, key=lambda g: (g is not None, g))
    group, columns = F.col("key.group"), []
    for i, g in enumerate(groups):
        below = F.lit(False) if g is None else group.isNull() | (group < g)
        within = below | group.eqNullSafe(F.lit(g))
        for name, condition in (("low", below), ("high", within)):
            columns += [F.coalesce(F.sum(F.when(condition, F.col("size"))), F.lit(0)).alias(f"{name}{i}"), F.count_if(condition).alias(f"{name}_rows{i}")]
    edge = slim.agg(*columns).first() if columns else None
    out = []
    for r in sorted(found, key=lambda r: r["target"]):
        i, t = groups.index(r["group"]), r["target"]
        low, high = edge[f"low{i}"] * shards, edge[f"high{i}"] * shards
        if SLACK * (t - low) <= total:
            out.append((low, edge[f"low_rows{i}"]))
        elif SLACK * (high - t) <= total:
            out.append((high, edge[f"high_rows{i}"]))
        else:
            out.append((r["past"], r["rows"]))
    return out


def write_shards(sharded: DataFrame, folder: str) -> None:
    """Writes a folder ``shard=0``, ``shard=1`` ... for each shard, whose files hold slot and row."""
    sharded.select("shard", "slot", "row").write.partitionBy("shard").mode("overwrite").parquet(folder)
