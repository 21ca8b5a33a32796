"""Dot products of queries and training documents that share words, without joining more than a
search needs: hot words split into cells, score bounds, and a filter on overlaps.

Queries are (q, word, qw), training documents (doc_id, word, tw); a word is in either once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neargrain.sources import cut

#: Pairs that one word may make in one task; words that make more are split.
CELL = 1 << 20
#: So many words are split at most: those beyond make less than this part of all pairs each.
MOST_SPLIT = 4096
#: Training documents of one word in one list.
LIST = 1 << 16
#: Training documents, in multiples of k, that the rarest words of a query reach at least before
#: their scores bound the k-th.
SEED = 4


def grid(queries: DataFrame, train: DataFrame, cell: int = CELL, longest: int | None = None) -> DataFrame:
    """(word, a, b) of words whose frequencies in both make more than ``cell`` pairs: their queries are
    dealt to a rows and their training documents to b columns of cells of about ``cell`` pairs.
    ``MOST_SPLIT`` rows at most: the limit rises with the number of all pairs. With ``longest``, words that more training
    documents have are split too, about as many again at most."""
    counts = lambda rows, name: rows.groupBy("word").agg(F.count("*").alias(name))
    both = cut(counts(queries, "n_q").join(counts(train, "n_t"), "word").withColumn("pairs", F.col("n_q").cast("double") * F.col("n_t")))
    limit = F.greatest(F.lit(float(cell)), F.col("total") / MOST_SPLIT)
    totals = both.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("total"), F.coalesce(F.sum("n_t"), F.lit(0)).alias("total_t"))
    column = F.lit(None).cast("double") if longest is None else F.greatest(F.lit(float(longest)), F.col("total_t") / MOST_SPLIT)
    known = both.join(F.broadcast(totals), F.lit(True)).withColumns({"limit": limit, "column": column})
    large = known.filter("pairs > limit or n_t > column")
    side = F.sqrt("limit")
    a = F.when(F.col("n_q") <= side, 1).when(F.col("n_t") <= side, F.ceil(F.col("pairs") / F.col("limit"))).otherwise(F.ceil(F.col("n_q") / side))
    b = F.when(F.col("n_t") <= side, 1).when(F.col("n_q") <= side, F.ceil(F.col("pairs") / F.col("limit"))).otherwise(F.ceil(F.col("n_t") / side))
    a, b = F.when(F.col("pairs") <= F.col("limit"), 1).otherwise(a), F.when(F.col("pairs") <= F.col("limit"), 1).otherwise(b)
    b = F.greatest(b, F.ceil(F.col("n_t") / F.col("column")))
    return cut(large.select("word", a.cast("int").alias("a"), b.cast("int").alias("b")))


def joined(queries: DataFrame, train: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Rows of both that have the same word, once each: an equi-join, in which a word of ``cells`` is
    a grid of keys. A row of a split word is sent to all cells of its row or column."""
    left, right, on = _dealt(queries, train, cells)
    return left.join(right, on).drop(*on[1:])


def _dealt(queries: DataFrame, train: DataFrame, cells: DataFrame | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the keys to join them on."""
    if cells is None or cells.isEmpty():
        return queries, train, ["word"]
    known = F.broadcast(cells)
    one = lambda c: F.coalesce(c, F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), one(F.col(n)) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), one(F.col(n))).cast("int")
    left = queries.join(known, "word", "left").withColumn("i", own("q", "a")).withColumn("j", every("b")).drop("a", "b")
    right = train.join(known, "word", "left").withColumn("j", own("doc_id", "b")).withColumn("i", every("a")).drop("a", "b")
    return left, right, ["word", "i", "j"]


def narrowed(rows: DataFrame, *wide: str) -> DataFrame:
    """The same rows with whole numbers in the smallest type that holds them all, but for the columns ``wide``: in lists,
    a number takes the width of its type."""
    whole = [c for c, kind in rows.dtypes if kind in ("smallint", "int", "bigint") and c not in wide]
    if not whole:
        return rows
    ends = rows.agg(*(f(c).alias(f"{name} {c}") for c in whole for name, f in (("min", F.min), ("max", F.max)))).first()
    fits = lambda c, bits: ends[f"min {c}"] is not None and -(1 << bits) <= ends[f"min {c}"] and ends[f"max {c}"] < 1 << bits
    return rows.withColumns({c: F.col(c).cast(next((kind for kind, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)) if fits(c, bits)), "bigint")) for c in whole})


def listed(queries: DataFrame, train: DataFrame, key: str = "q") -> DataFrame:
    """The rows of ``joined``, sent to the places of ``key``. On the way there the training documents of a query's
    word are a list for each column, so that a pair takes no more than its numbers do."""
    numbers = narrowed(train, "word")
    left, right, on = _dealt(queries, numbers, grid(queries, train, longest=LIST))
    own, types = [c for c in train.columns if c != "word"], dict(train.dtypes)
    lists = right.repartition(*on).groupBy(*on).agg(F.collect_list(F.struct(*own)).alias("x"))
    sent = left.join(lists, on).select(*(c for c in queries.columns if c != "word"), *(F.col(f"x.{c}").alias(c) for c in own)).repartition(key)
    rows = sent.select(*(c for c in queries.columns if c != "word"), F.inline(F.arrays_zip(*own)))
    return rows.withColumns({c: F.col(c).cast(types[c]) for c in own if types[c] != dict(numbers.dtypes)[c]})


def dots(rows: DataFrame) -> DataFrame:
    """(q, doc_id, dot, shared) of joined rows, summed per pair before they are shuffled again."""
    return rows.groupBy("q", "doc_id").agg(F.sum(F.col("qw") * F.col("tw")).alias("dot"), F.count("*").alias("shared"))


def by_reach(queries: DataFrame, train: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of queries whose words have ``most`` training documents at most, repeats counted, and those of
    the others."""
    df = train.groupBy("word").agg(F.count("*").alias("df"))
    reach = queries.select("q", "word").join(df, "word").groupBy("q").agg(F.sum("df").alias("reach"))
    rows = cut(queries.join(reach.filter(F.col("reach") > most), "q", "left"))
    return rows.filter("reach is null").drop("reach"), rows.filter("reach is not null").drop("reach")


def all_pairs(queries: DataFrame, train: DataFrame, cell: int | None = CELL) -> DataFrame:
    """(q, doc_id, dot, shared) of every pair that shares a word."""
    return dots(joined(queries, train, None if cell is None else grid(queries, train, cell)))


def _finish(found: DataFrame, rest: DataFrame, on: str, other: DataFrame) -> DataFrame:
    """``found`` (q, doc_id, dot, shared) with what the words ``rest`` of one side of each pair add."""
    keys = ["q", "doc_id"]
    more = dots(found.select(*keys).join(rest, on).join(other, [*(k for k in keys if k != on), "word"]))
    added = found.join(more.select(*keys, F.col("dot").alias("more"), F.col("shared").alias("more_shared")), keys, "left")
    return added.select(*keys, (F.col("dot") + F.coalesce("more", F.lit(0))).alias("dot"), (F.col("shared") + F.coalesce("more_shared", F.lit(0))).alias("shared"))


@dataclass(frozen=True)
class Bounded:
    """The pairs that the k best documents of each query are among, by cosine of weights that are
    never negative, with exact dot products.

    A query's words are taken in rising document frequency. The rarest, which reach ``seed`` * k
    documents, are joined first. Of what they find, the 2 * k best are finished with the query's other
    words, looked up by document and word: the k-th largest of these cosines is a bound that the k best
    reach. Some words can add to a cosine no more than the sum of their weights in the query, each by
    its largest weight in any training document, and no more than the root of their squared weights
    in the query (all as parts of the norms). From the word on at which all that follow can't add up
    to the bound, words are the rest: a document that has only rest words isn't among the k best. So
    only words before it are joined. Pairs that could still reach the bound are finished with the
    rest words. A query that finds fewer than k documents has no bound, and all its words are joined.
    """

    queries: DataFrame
    train: DataFrame
    k: int
    margin: float  # scores that are closer may be equal once they are rounded
    seed: int = SEED
    cell: int = CELL

    @cached_property
    def _lengths(self) -> tuple[DataFrame, DataFrame]:
        root = F.sqrt(F.sum(F.col("w") * F.col("w")).cast("double"))
        of = lambda rows, key, w, name: rows.select(key, F.col(w).alias("w")).groupBy(key).agg(root.alias(name))
        return cut(of(self.queries, "q", "qw", "q_norm")), cut(of(self.train, "doc_id", "tw", "t_norm"))

    @cached_property
    def terms(self) -> DataFrame:
        """(q, word, qw, df, before, tail): the training documents that a query's words before one reach,
        and what it and all words after it can add to a cosine."""
        by_q, by_t = self._lengths
        part = F.coalesce(F.try_divide(F.col("tw").cast("double"), F.col("t_norm")), F.lit(0.0))
        most = self.train.join(by_t, "doc_id").groupBy("word").agg(F.count("*").alias("df"), F.max(part).alias("most"))
        rows = self.queries.join(most, "word").join(by_q, "q")
        own = F.coalesce(F.try_divide(F.col("qw").cast("double"), F.col("q_norm")), F.lit(0.0))
        order = Window.partitionBy("q").orderBy("df", "word")
        before = F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        tail = F.least(F.sum(own * F.col("most")).over(left), F.sqrt(F.sum(own * own).over(left)))
        return cut(rows.select("q", "word", "qw", "df", before.alias("before"), tail.alias("tail")))

    def _parts(self, sums: DataFrame) -> DataFrame:
        by_q, by_t = self._lengths
        part = F.try_divide(F.col("dot").cast("double"), F.col("q_norm") * F.col("t_norm"))
        return sums.join(by_q, "q").join(by_t, "doc_id").withColumn("part", F.coalesce(part, F.lit(0.0)))

    def _kth(self, sums: DataFrame) -> DataFrame:
        best = Window.partitionBy("q").orderBy(F.desc("part"))
        ranked = self._parts(sums).filter("part > 0").withColumn("rn", F.row_number().over(best))
        return ranked.filter(F.col("rn") == self.k).select("q", (F.col("part") - self.margin).alias("least"))

    @cached_property
    def first(self) -> DataFrame:
        """Dot products over the rarest words alone."""
        seeds = self.terms.filter(F.col("before") < self.seed * self.k).select("q", "word", "qw")
        return cut(all_pairs(seeds, self.train, self.cell))

    @cached_property
    def best(self) -> DataFrame:
        """The 2 * k best pairs of ``first`` for each query."""
        order = Window.partitionBy("q").orderBy(F.desc("part"))
        ranked = self._parts(self.first).withColumn("rn", F.row_number().over(order))
        return cut(ranked.filter(F.col("rn") <= 2 * self.k).select("q", "doc_id", "dot", "shared"))

    @cached_property
    def _least(self) -> DataFrame:
        others = self.terms.filter(F.col("before") >= self.seed * self.k).select("q", "word", "qw")
        return cut(self._kth(_finish(self.best, others, "q", self.train)))

    @cached_property
    def split(self) -> DataFrame:
        """``terms`` with ``kind``: seed, essential or rest."""
        bounded = self.terms.join(self._least, "q", "left")
        kind = F.when(F.col("before") < self.seed * self.k, "seed").when(F.col("tail") >= F.coalesce("least", F.lit(0.0)), "essential").otherwise("rest")
        return cut(bounded.withColumn("kind", kind).select("q", "word", "qw", "df", "tail", "kind"))

    @cached_property
    def candidates(self) -> DataFrame:
        """Dot products over all but rest words, of pairs that can reach the bound with them."""
        more = all_pairs(self.split.filter("kind = 'essential'").select("q", "word", "qw"), self.train, self.cell)
        both = self.first.unionByName(more).groupBy("q", "doc_id").agg(F.sum("dot").alias("dot"), F.sum("shared").alias("shared"))
        sums = cut(both)
        rest = self.split.filter("kind = 'rest'").groupBy("q").agg(F.max("tail").alias("rest"))
        able = self._parts(sums).join(rest, "q", "left").join(self._least, "q", "left")
        kept = able.filter(F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.coalesce("least", F.lit(0.0)))
        return cut(kept.select("q", "doc_id", "dot", "shared"))

    @cached_property
    def pairs(self) -> DataFrame:
        """(q, doc_id, dot, shared)"""
        return _finish(self.candidates, self.split.filter("kind = 'rest'").select("q", "word", "qw"), "q", self.train)

    @property
    def rows(self) -> dict[str, int]:
        """Rows that joins on words make, and those that the search of every pair would."""
        looked_up = lambda found, kinds: found.select("q", "doc_id").join(self.split.filter(kinds).select("q", "word"), "q").join(self.train.select("doc_id", "word"), ["doc_id", "word"]).count()
        finished = looked_up(self.best, "kind <> 'seed'") + looked_up(self.candidates, "kind = 'rest'")
        by = {r["kind"]: r["df"] for r in self.split.groupBy("kind").agg(F.sum("df").alias("df")).collect()}
        return {"joined": by.get("seed", 0) + by.get("essential", 0) + finished, "all": sum(by.values())}


def least_shared(size: str, overlap: float):
    """The least number of words that a pair shares if it is more than ``overlap`` of the smaller one's."""
    return F.floor(F.lit(float(overlap)) * F.col(size)) + 1


@dataclass(frozen=True)
class Overlapping:
    """The pairs that share more than ``overlap`` of the smaller side's words.

    If the smaller side, of s words, shares o with the other, it shares at least l of its first
    s - o + l words, whatever the order. In the order of rising frequency, the words that are left
    out are the most frequent. So only these first words are joined, with l half of o, and pairs
    that share fewer than l of them are dropped before the others are looked up.
    """

    queries: DataFrame
    train: DataFrame
    overlap: float
    cell: int = CELL

    @cached_property
    def _sides(self) -> tuple[DataFrame, DataFrame]:
        df = self.train.groupBy("word").agg(F.count("*").alias("df"))

        def placed(rows: DataFrame, key: str, size: str) -> DataFrame:
            order = Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "word")
            known = rows.join(df, "word", "left").withColumns({size: F.count("*").over(Window.partitionBy(key)), "place": F.row_number().over(order)})
            o = least_shared(size, self.overlap)
            half = F.ceil(o / 2)
            return cut(known.withColumns({"asked": half, "early": F.col("place") <= F.col(size) - o + half}).drop("df", "place"))

        return placed(self.queries, "q", "q_size"), placed(self.train, "doc_id", "t_size")

    def _candidates(self, small: DataFrame, large: DataFrame, key: str, fits: str) -> DataFrame:
        early, other = small.filter("early").drop("early"), large.drop("asked", "early")
        left, right = (early, other) if key == "q" else (other, early)
        rows = joined(left, right, grid(left, right, self.cell)).filter(fits)
        sums = rows.groupBy("q", "doc_id").agg(F.sum(F.col("qw") * F.col("tw")).alias("dot"), F.count("*").alias("shared"), F.first("asked").alias("asked"))
        return cut(sums.filter("shared >= asked").drop("asked"))

    @cached_property
    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """Pairs whose query is the smaller side (or as large), and the others."""
        q, t = self._sides
        return self._candidates(q, t, "q", "q_size <= t_size"), self._candidates(t, q, "doc_id", "t_size < q_size")

    @cached_property
    def pairs(self) -> DataFrame:
        """(q, doc_id, dot, shared), among them every pair that shares enough."""
        q, t = self._sides
        (small_q, small_t), late = self.candidates, "not early"
        with_q = _finish(small_q, q.filter(late).select("q", "word", "qw"), "q", t.select("doc_id", "word", "tw"))
        with_t = _finish(small_t, t.filter(late).select("doc_id", "word", "tw"), "doc_id", q.select("q", "word", "qw"))
        return with_q.unionByName(with_t)

    @property
    def rows(self) -> dict[str, int]:
        """Rows that joins on words make, and those that the search of every pair would."""
        q, t = self._sides
        count = lambda a, b, fits: a.join(b, "word").filter(fits).count()
        early = count(q.filter("early"), t, "q_size <= t_size") + count(t.filter("early"), q, "t_size < q_size")
        (small_q, small_t), late = self.candidates, "not early"
        finished = small_q.join(q.filter(late).select("q", "word"), "q").join(t.select("doc_id", "word"), ["doc_id", "word"]).count()
        finished += small_t.join(t.filter(late).select("doc_id", "word"), "doc_id").join(q.select("q", "word"), ["q", "word"]).count()
        return {"joined": early + finished, "all": count(q, t, F.lit(True))}
