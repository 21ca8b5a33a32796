"""The k most similar labelled entries of every query, by cosine over sparse vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neargrain.functions import cosine, ratio
from neargrain.operators import blocks, pairs
from neargrain.operators.weights import squares
from neargrain.sources import cut


#: How pairs are searched: ``join`` makes every pair that shares a word; ``bounds`` those that can be among
#: the k best; ``overlap`` those that share enough words for the overlap gate; ``blocks`` multiplies all queries and
#: documents block by block, for long texts, of which most pairs share many words.
SEARCHES = ("join", "bounds", "overlap", "blocks")


def _sums(queries: DataFrame, train: DataFrame, norm: str, overlap: float | None, digits: int, search: str, k: int, about: DataFrame | None) -> DataFrame:
    """(q, q_square, q_size, doc_id, t_square, ..., dot) of pairs (t_size, shared with ``overlap``), with what ``about`` (doc_id, ...)
    tells of training documents; documents that aren't in it are left out.

    What is a training document's goes along with the rows that are joined, and what is a query's meets them at the
    query: so a pair is shuffled once, to its query, where all rows of a query then lie. Queries that reach few
    documents have next to nothing that a search could leave out; they make every pair.
    """
    if search == "bounds":
        if norm != "l2" or overlap is not None:
            raise ValueError("scores are bounded for the l2 norm without an overlap gate")
        if queries.agg(F.min("w")).unionAll(train.agg(F.min("w"))).filter("`min(w)` < 0").count():
            raise ValueError("scores are bounded for weights that are not negative")
    elif search == "overlap":
        if overlap is None:
            raise ValueError("this search needs an overlap gate")
    elif search != "join":
        raise ValueError(f"no such search: {search}")
    q = queries.select(F.col("doc_id").alias("q"), "word", F.col("w").alias("qw"))
    own_q = squares(queries).withColumnsRenamed({"doc_id": "q", "square": "q_square", "size": "q_size"})
    # A document's rows are sent to one place for its norm and its labels.
    per = Window.partitionBy("doc_id")
    t = train.select("doc_id", "word", F.col("w").alias("tw"), F.sum(F.col("w") * F.col("w")).over(per).alias("t_square"), *([] if overlap is None else [F.count("*").over(per).alias("t_size")]))
    t = cut(t if about is None else t.join(about, "doc_id"))
    keys = ["q", *(c for c in t.columns if c not in ("word", "tw"))]
    sums = ["dot"] if overlap is None else ["dot", "shared"]
    whole, rest = (q, None) if search == "join" else pairs.by_reach(q, t, pairs.SEED * k)
    rows = pairs.listed(whole, t)
    rows = rows.select(*keys, (F.col("qw") * F.col("tw")).alias("dot"), F.lit(1).cast("bigint").alias("shared")).select(*keys, *sums)
    if rest is not None and not rest.isEmpty():
        q_rows, t_rows, own_t = rest.select("q", "word", "qw"), t.select("doc_id", "word", "tw"), t.drop("word", "tw").dropDuplicates(["doc_id"])
        found = (pairs.Bounded(q_rows, t_rows, k, 2.0 * 10**-digits) if search == "bounds" else pairs.Overlapping(q_rows, t_rows, overlap)).pairs
        rows = rows.unionByName(found.join(own_t, "doc_id").select(*keys, *sums)).repartition("q")
    added = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
    return added.join(own_q.hint("shuffle_hash"), "q")


def scores(queries: DataFrame, train: DataFrame, norm: str = "l2", overlap: float | None = None, gate: bool = False, digits: int = 9, search: str = "join", k: int = 70, about: DataFrame | None = None) -> DataFrame:
    """(q, doc_id, score) of pairs that share a word; both inputs are (doc_id, word, w).

    One equi-join on words, hot ones split into cells; then a pair's rows are shuffled to its query,
    with both squared norms, and summed. ``overlap``: pairs that share no more than that part (truncated) of
    the smaller one's words score 0. ``gate``: pairs with a dot product of 0 or less score 0. Scores are
    rounded, so that ties don't depend on the order of summation. ``search`` other than ``join``
    leaves out pairs that aren't among the k best, or that score 0 (``blocks`` does both). Columns of ``about`` (doc_id, ...) come along.
    """
    if search == "blocks":
        if norm != "l2" or overlap is not None:
            raise ValueError("blocks are multiplied for the l2 norm without an overlap gate")
        known, numbers = train if about is None else train.join(about, "doc_id", "left_semi"), blocks.word_numbers(queries)
        found = blocks.best(blocks.packed(queries, numbers), blocks.packed(known, numbers), k, digits, gate)
        return found if about is None else found.join(about, "doc_id").select("q", "doc_id", "score", *(c for c in about.columns if c != "doc_id"))
    found = _sums(queries, train, norm, overlap, digits, search, k, about)
    if norm == "l2":
        score = cosine("dot", "q_square", "t_square")
    elif norm == "log_l2":
        a, b = (F.log(F.sqrt(F.col(c).cast("double"))) for c in ("q_square", "t_square"))
        score = ratio(F.col("dot"), a * b)
    else:
        raise ValueError(f"no such norm: {norm}")
    if overlap is not None:
        score = F.when(F.col("shared") > F.floor(F.lit(float(overlap)) * F.least("q_size", "t_size")), score).otherwise(0.0)
    if gate:
        score = F.when(F.col("dot") > 0, score).otherwise(0.0)
    return found.select("q", "doc_id", F.round(score, digits).alias("score"), *([] if about is None else [c for c in about.columns if c != "doc_id"]))


#: Different lists of labels that are told by a number while documents are searched.
KINDS = 1 << 15

_DOCS = "array<struct<doc_id:{0},score:double,labels:array<{1}>>>"


def labels_of(doc_labels: DataFrame) -> DataFrame:
    """(doc_id, labels): each document's labels in their order."""
    return doc_labels.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label")))["label"].alias("labels"))


def entries_of(found: DataFrame, queries: DataFrame, labelled: DataFrame, k: int, fill: bool) -> DataFrame:
    """(q, rnk, doc_id, label, score): of scored pairs (q, doc_id, score, labels) the first k entries of each
    query. ``fill``: documents that score 0 rank by doc_id, whether or not they share a word. A query with
    n < k others has k - n of them among the first k documents of ``labelled`` (doc_id, labels).

    A query's k documents are one array, so nothing but the pairs is shuffled, where these lie
    together by query already.
    """
    best = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    some = found.filter("score <> 0") if fill else found
    ranked = some.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k)
    docs = ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rn", "doc_id", "score", "labels"))).alias("docs"))
    plain = F.transform("docs", lambda d: F.struct(d["doc_id"].alias("doc_id"), d["score"].alias("score"), d["labels"].alias("labels")))
    docs = docs.select("q", plain.alias("docs"))
    if fill:
        types = dict(labelled.dtypes)
        none = F.array().cast(_DOCS.format(types["doc_id"], types["labels"][6:-1]))
        first = labelled.orderBy("doc_id").limit(k).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.lit(0.0).alias("score"), "labels"))).alias("first"))  # one row
        every = queries.select(F.col("doc_id").alias("q")).distinct().join(docs, "q", "left").withColumn("docs", F.coalesce("docs", none)).join(F.broadcast(first), F.lit(True))
        # An array of one, so that what both have is found once and not for each element.
        both = F.array(F.array_intersect(F.col("first.doc_id"), F.col("docs.doc_id")))
        others = F.get(F.transform(both, lambda ids: F.filter("first", lambda d: ~F.array_contains(ids, d["doc_id"]))), F.lit(0))
        zeros = F.slice(others, F.lit(1), F.lit(k) - F.size("docs"))
        docs = every.select("q", F.when(F.size("docs") < k, F.concat("docs", zeros)).otherwise(F.col("docs")).alias("docs"))
    entries = F.flatten(F.transform("docs", lambda d: F.transform(d["labels"], lambda label: F.struct(d["doc_id"].alias("doc_id"), label.alias("label"), d["score"].alias("score")))))
    rows = docs.select("q", F.posexplode(F.slice(entries, 1, k)).alias("rnk", "x"))
    return rows.select("q", (F.col("rnk") + 1).alias("rnk"), "x.doc_id", "x.label", "x.score")


def top_k(queries: DataFrame, train: DataFrame, train_labels: DataFrame, k: int = 70, candidates: str = "all", **options) -> DataFrame:
    """(q, rnk, doc_id, label, score): of the entries (document, label) of training documents the k
    largest scores for each query; ties by doc_id and the label's place.

    An entry of a document beyond the k-th that has labels can't be among the first k: documents are cut to k
    before entries are made. ``candidates``: ``all`` documents, those without a shared word with score 0,
    or only those with ``shared`` words (which may score 0, so that every pair is made). Rows of a query lie together.
    """
    if candidates == "shared" and options.get("search", "join") in ("overlap", "blocks"):
        raise ValueError("pairs that share too few words, or score 0, are candidates here")
    if candidates not in ("all", "shared"):
        raise ValueError(f"no such candidates: {candidates}")
    labelled = cut(labels_of(train_labels))
    kinds = cut(labelled.select("labels").distinct())
    if kinds.count() <= KINDS:
        kinds = F.broadcast(cut(kinds.withColumn("kind", F.row_number().over(Window.orderBy("labels")))))
        found = scores(queries, train, k=k, about=labelled.join(kinds, "labels").select("doc_id", "kind"), **options).join(kinds, "kind").drop("kind")
    else:
        found = scores(queries, train, k=k, about=labelled, **options)
    return entries_of(found, queries, labelled, k, candidates == "all")
