"""Near-duplicate vectors: a robust-pruned flat graph on overlapping shards, range search, checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neargrain.llm.common import materialise
from neargrain.llm.graph import components

THRESHOLD = 0.95
#: The shards' centres are fitted on so many vectors at most, those with the smallest hash of id.
SAMPLE = 20_000
#: Bytes of the sample, about; so longer vectors make a smaller one (of 1,000 at least).
SAMPLE_BYTES = 64 << 20
#: Vectors a centre stands for, most centres, the nearest centres whose shards hold a vector, and
#: the nearest of these in which it is searched for.
PER_CENTRE, MOST_CENTRES, OVERLAP, SEARCHED = 500, 4096, 4, 2
#: Within a shard: points of a cluster, candidates and degree of a point, slack of the pruning.
CLUSTER, CANDIDATES, DEGREE, ALPHA = 256, 48, 24, 1.2
#: A shard of more vectors than this is divided by centres of its own, at most MOST_BELOW; what is
#: still larger is dealt into parts, which are searched two by two.
PART, MOST_BELOW = 8192, 1024
#: Width of the search beam, queries searched together, one query of so many is audited.
BEAM, TOGETHER, AUDIT = 12, 256, 20


def fit_centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    if not len(sample):
        return np.zeros((0, 0))
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1)
        centres[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return centres


def robust_prune(distance: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(points, degree) neighbours, -1 where there are fewer: of candidates in order of distance,
    the nearest, leaving out those that a chosen one is ``alpha`` times as near to."""
    n, k = candidates.shape
    own = np.take_along_axis(distance, candidates, 1)
    between = distance[candidates[:, :, None], candidates[:, None, :]]
    alive, out, rows = np.ones((n, k), bool), np.full((n, degree), -1, np.int64), np.arange(n)
    for i in range(degree):
        pick = alive.argmax(1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[some, i] = candidates[rows[some], pick[some]]
        alive &= ~((alpha * between[rows, pick] <= own) & some[:, None])
        alive[rows, pick] = False
    return out


def build_graph(x: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(adjacency lists padded with -1, medoids, each point's cluster). Overlapping clusters of unit
    vectors get pruned graphs of their own; a point's lists from its clusters are united."""
    n = len(x)
    k = max(1, -(-n // CLUSTER))
    centres = x[np.random.default_rng(seed).permutation(n)[:k]]
    near = x @ centres.T
    own = np.argsort(-near, axis=1)[:, : min(2, k)]
    lists = np.full((n, own.shape[1] * DEGREE), -1, np.int64)
    medoids = []
    for c in range(k):
        members = np.flatnonzero((own == c).any(1))
        # A cluster that came out large is graphed in parts that overlap by half.
        step = 2 * CLUSTER
        for a in range(0, max(len(members), 1), step):
            part = members[a : a + 2 * step]
            if not len(part) or (a and len(part) <= step):
                continue
            similar = x[part] @ x[part].T
            medoids.append(part[similar.sum(1).argmax()])
            if len(part) < 2:
                continue
            distance = np.maximum(1 - similar, 0)
            np.fill_diagonal(distance, np.inf)
            m = min(CANDIDATES, len(part) - 1)
            candidates = np.argpartition(distance, m - 1, axis=1)[:, :m]
            candidates = np.take_along_axis(candidates, np.argsort(np.take_along_axis(distance, candidates, 1), axis=1, kind="stable"), 1)
            pruned = robust_prune(distance, candidates, DEGREE, ALPHA)
            found = np.where(pruned >= 0, part[pruned], -1)
            free = np.where((own[part] == c)[:, 0], 0, lists.shape[1] - DEGREE)
            for j in range(DEGREE):
                at = lists[part, free + j]
                lists[part, free + j] = np.where(at < 0, found[:, j], at)
    return lists, np.unique(np.array(medoids, np.int64)), own[:, 0]


def with_back_links(lists: np.ndarray, extra: int = DEGREE) -> np.ndarray:
    """The lists, and for each point up to ``extra`` points that have it in theirs."""
    n = len(lists)
    source, column = np.nonzero(lists >= 0)
    target = lists[source, column]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    out = np.full((n, extra), -1, np.int64)
    ok = place < extra
    out[target[ok], place[ok]] = source[ok]
    return np.hstack((lists, out))


def range_search(x: np.ndarray, queries: np.ndarray, lists: np.ndarray, medoids: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs with a cosine of at least ``threshold``: greedy search from the medoids
    with a beam, and every point in range is expanded, too. Queries that are near each other are
    searched together: a point that one of them expands is seen by all, so a round is one product
    of matrices and the work is that of the points that are visited."""
    seen, new = np.zeros(len(x), bool), medoids
    best, found = np.full((len(queries), beam), -2.0), []
    while len(new):
        seen[new] = True
        similar = x[queries] @ x[new].T
        q, p = np.nonzero(similar >= threshold)
        found.append((q, new[p]))
        best = np.partition(np.hstack((best, similar)), len(new), axis=1)[:, len(new) :]
        # Bounds only rise, so a point that nobody expands now is never expanded.
        expand = (similar >= np.minimum(best[:, 0], threshold)[:, None]).any(0)
        near = np.unique(lists[new[expand]])
        near = near[near >= 0]
        new = near[~seen[near]]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def link_shard(x: np.ndarray, threshold: float = THRESHOLD, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(a, b, audited links, of these found): the links a < b in a shard of unit vectors of which an
    end is ``asked`` for (default: all).

    A part of the queries is audited against brute force; where less than 99 % of their links are
    found, the shard is searched with a wider beam, and at last in full."""
    n, asked = len(x), np.arange(len(x)) if asked is None else asked
    keyed = lambda q, p: np.unique(np.minimum(q, p) * n + np.maximum(q, p))
    lists, medoids, cluster = build_graph(x)
    lists = with_back_links(lists)
    audited = asked[::AUDIT]
    q, p = np.nonzero(x[audited] @ x.T >= threshold)
    true = keyed(audited[q], p)
    true = true[true // n != true % n]
    together, beam = asked[np.argsort(cluster[asked], kind="stable")], min(BEAM, n)
    while True:
        keys = [np.zeros(0, np.int64)]
        for a in range(0, len(together), TOGETHER):
            queries = together[a : a + TOGETHER]
            if beam > 8 * BEAM:
                q, p = np.nonzero(x[queries] @ x.T >= threshold)
            else:
                q, p = range_search(x, queries, lists, medoids, threshold, beam)
            keys.append(keyed(queries[q], p))
        key = np.unique(np.concatenate(keys))
        key = key[key // n != key % n]
        found = int(np.isin(true, key).sum())
        if found >= 0.99 * len(true):
            break
        beam *= 4
    a, b = key // n, key % n
    sure = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) >= threshold for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
    return a[sure], b[sure], len(true), found


_FOUND = "node bigint, n_links bigint, root bigint, audited bigint, audited_found bigint"


def _padded(shards: pd.Series, searched: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(rows, most shards of a row) shards, and in which of them the row is searched for; places
    that a row doesn't use hold a number that no other row has."""
    sizes = np.array([len(x) for x in shards])
    used = np.arange(sizes.max()) < sizes[:, None]
    out = np.repeat(-1 - np.arange(len(sizes))[:, None], sizes.max(), axis=1)
    asked = np.zeros(out.shape, bool)
    out[used], asked[used] = np.concatenate(shards.to_list()), np.concatenate(searched.to_list())
    return out, asked


def _roots(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each one reaches over links between the places a and b. Roots are linked
    and paths to them halved in turn, so a chain of n takes about log n rounds."""
    order = np.argsort(node)
    rank = np.empty(len(node), np.int64)
    rank[order] = root = np.arange(len(node))
    a, b = rank[a], rank[b]
    while True:
        low, before = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return node[order][root[rank]]


def _shard(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of a shard or, where it is large, of two of its parts (i, j)."""
    x = np.frombuffer(b"".join(rows["vector"]), "<f8").reshape(len(rows), -1)
    node, copies, here = rows["node"].to_numpy(), rows["copies"].to_numpy(), int(rows["shard"].iloc[0])
    shards, searched = _padded(rows["shards"], rows["searched"])
    a, b, audited, found = link_shard(x, threshold, np.flatnonzero(((shards == here) & searched).any(1)))
    # A link counts in the first shard that holds both ends and in which one of them is searched
    # for, and there where i and j are the parts of its ends.
    first = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 65536):
        at, to = a[i : i + 65536], b[i : i + 65536]
        s, t = shards[at], shards[to]
        common = (s[:, :, None] == t[:, None, :]) & (searched[at][:, :, None] | searched[to][:, None, :])
        first[i : i + 65536] = np.where(common.any(2), s, np.iinfo(np.int64).max).min(1)
    part, two = rows["part"].to_numpy(), rows["i"].iloc[0] != rows["j"].iloc[0]
    counted = (first == here) & ((part[a] != part[b]) if two else True)
    count = np.zeros(len(rows), np.int64)
    np.add.at(count, a[counted], copies[b[counted]])
    np.add.at(count, b[counted], copies[a[counted]])
    # Of the links of a component its star is enough.
    root = _roots(node, a, b)
    out = pd.DataFrame({"node": node, "n_links": count, "root": root, "audited": 0, "audited_found": 0})
    out.loc[out.index[:1], ["audited", "audited_found"]] = audited, found
    return out[(out["n_links"] > 0) | (out["root"] != out["node"]) | (out["audited"] > 0)]


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and unit vector of each embedding in double precision; null where it can't link."""
    for batch in batches:
        digests, vectors = [], []
        for v in batch.column("embedding").to_pylist():
            x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
            scale = np.abs(x).max(initial=0.0)
            if not np.isfinite(scale) or not scale or not np.isfinite(x).all():
                digests.append(None)
                vectors.append(None)
                continue
            x = x / scale  # so that no square overflows
            raw = (x / np.sqrt((x * x).sum())).astype("<f8").tobytes()
            digests.append(xxhash.xxh3_128_digest(raw))
            vectors.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "digest", "vector"])


def _divided(assigned: DataFrame) -> DataFrame:
    """``assigned`` (node, copies, vector, shards) with ``searched``, which says of each of a node's
    shards whether it is searched for there. A shard of more than PART vectors is replaced by
    shards of its own centres, fitted on a bounded sample of it."""
    part, most, sampled, sample_bytes = PART, MOST_BELOW, SAMPLE, SAMPLE_BYTES
    each, overlap, asked, level = PER_CENTRE, OVERLAP, SEARCHED, 1 << 52
    placed = assigned.select("node", F.posexplode("shards").alias("place", "shard"))
    large = materialise(placed.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > part), "large")
    if large.isEmpty():
        return assigned.withColumn("searched", F.transform("shards", lambda _, i: i < asked))
    members = placed.join(large, "shard").join(assigned.select("node", "vector"), "node")
    chunks = F.ceil(F.col("n") / part)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        x = np.frombuffer(b"".join(rows["vector"]), "<f8").reshape(len(rows), -1)
        k = int(min(most, -(-int(rows["n"].iloc[0]) // each)))
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "centres": [fit_centres(x, k).tobytes()]})

    def assign(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"node": [], "place": [], "below": []})
        x = np.frombuffer(b"".join(rows["vector"]), "<f8").reshape(len(rows), -1)
        # A shard of which the sample took no vector stays whole.
        c = np.frombuffer(centres["centres"].iloc[0], "<f8").reshape(-1, x.shape[1]) if len(centres) else np.zeros((1, x.shape[1]))
        near = [np.argsort(-(x[i : i + 2048] @ c.T), axis=1)[:, :overlap] for i in range(0, len(x), 2048)]
        below = level + int(rows["shard"].iloc[0]) * most + np.concatenate(near)
        return pd.DataFrame({"node": rows["node"], "place": rows["place"], "below": below.tolist()})

    # About ``sampled`` vectors of each shard, fewer if they are long.
    rows = F.least(F.lit(sampled), F.greatest(F.lit(1000), F.floor(F.lit(sample_bytes) / F.octet_length("vector"))))
    sample = members.filter(F.pmod(F.xxhash64("node", F.lit("sample")), F.col("n")) < rows).select("shard", "n", "node", "vector")
    centres = materialise(sample.groupBy("shard").applyInPandas(fit, "shard bigint, centres binary"), "centres")
    centres = centres.join(large, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("chunk"), "centres")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks)).select("shard", "chunk", "node", "place", "vector")
    below = members.groupBy("shard", "chunk").cogroup(centres.groupBy("shard", "chunk")).applyInPandas(assign, "node bigint, place int, below array<bigint>")
    placed = placed.join(below, ["node", "place"], "left").withColumn("below", F.coalesce("below", F.array("shard")))
    placed = placed.withColumn("searched", F.transform("below", lambda _, i: (i < asked) & (F.col("place") < asked)))
    # OVERLAP rows of each node.
    own = placed.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "below", "searched"))).alias("own"))
    own = own.select("node", F.flatten("own.below").alias("shards"), F.flatten("own.searched").alias("searched"))
    return materialise(assigned.drop("shards").join(own, "node"), "divided")


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept, copies of every row, whatever its other columns; and
    audited_links and audited_found, the sums of all shards' audits, the same in every row.

    Equal unit vectors are one node with a count of copies. Centres fitted on a bounded sample
    (``SAMPLE`` rows, ``SAMPLE_BYTES``) make overlapping shards: every vector goes to its ``OVERLAP``
    nearest, and is searched for in the ``SEARCHED`` nearest of these. A shard of more than
    ``PART`` vectors is divided by centres of its own in the same way, each vector in the
    ``OVERLAP`` nearest of them. One that is still larger is dealt into parts, of which each two
    are searched together, so that no task holds more than two parts and no vector is left out. A shard
    builds pruned graphs on overlapping clusters, unites their lists, searches the range of each
    vector from medoids, audits a part of the searches against brute force, and verifies
    links in double precision; a cosine of exactly ``threshold``, as double precision has it, links.
    A link that several shards find counts once. Shards give counts and stars, not pairs;
    components are joined afterwards.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different lengths don't link. A null id can't be linked to and is in no component.
    Repeated rows (same id and vector) count as copies of each other; of an id with several vectors
    each is a vector of its own, with links and a component of its own. Vectors may have any
    length, as all of a shard's part (``PART``) are in one task. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    prepared = materialise(rows.mapInArrow(_prepared, "vec_id bigint, digest binary, vector binary"), "vectors")
    usable = prepared.filter("digest is not null and vec_id is not null")
    nodes = usable.groupBy("digest").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n, longest = nodes.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vector")), F.lit(8))).first()
    sample = nodes.orderBy(F.xxhash64("digest"), "digest").limit(min(SAMPLE, max(1000, SAMPLE_BYTES // longest))).select("vector").toArrow().column(0).to_pylist()
    lengths = {len(v) for v in sample}
    k = int(min(MOST_CENTRES, max(1, -(-n // PER_CENTRE))))
    centres = {size: fit_centres(np.frombuffer(b"".join(v for v in sample if len(v) == size), "<f8").reshape(-1, size // 8), k) for size in lengths}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size in np.unique([len(v) for v in batch.column("vector").to_pylist()]).tolist():
                part = batch.filter(pa.array([len(v) == size for v in batch.column("vector").to_pylist()]))
                if size in centres:
                    x = np.frombuffer(b"".join(part.column("vector").to_pylist()), "<f8").reshape(part.num_rows, -1)
                    near = np.argsort(-(x @ centres[size].T), axis=1)[:, :OVERLAP] + size * MOST_CENTRES
                else:  # a length that the sample doesn't have
                    near = np.full((part.num_rows, 1), size * MOST_CENTRES)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "copies", "vector")), pa.array(near.tolist(), pa.list_(pa.int64()))], names=["node", "copies", "vector", "shards"])

    assigned = materialise(nodes.select("node", "copies", "vector").mapInArrow(assign, "node bigint, copies bigint, vector binary, shards array<bigint>"), "assigned")
    assigned = _divided(assigned)
    parts = assigned.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = assigned.withColumn("shard", F.explode("shards")).join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("node", "shard"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("shard", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "copies", "vector", "shards", "searched")
    found = materialise(dealt.groupBy("shard", "i", "j").applyInPandas(lambda f: _shard(f, threshold), _FOUND), "found")
    linked = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    audits = found.agg(F.coalesce(F.sum("audited"), F.lit(0)).alias("audited_links"), F.coalesce(F.sum("audited_found"), F.lit(0)).alias("audited_found"))
    classes = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = materialise(classes.join(nodes.select("node", "first_id"), "node"), "classes")
    classes = classes.join(classes.groupBy("component").agg(F.min("first_id").alias("least")), "component").select("node", "least")
    per_node = nodes.select("digest", "node", "first_id", "copies").join(linked, "node", "left").join(classes, "node", "left")
    per_node = per_node.select("digest", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first_id").alias("component_id"))
    out = prepared.join(per_node, "digest", "left")
    linkable = F.col("vec_id").isNotNull()
    component = F.when(linkable, F.coalesce("component_id", "vec_id"))
    out = out.join(F.broadcast(audits), F.lit(True))  # one row
    return out.select("vec_id", F.when(linkable, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"), "audited_links", "audited_found")
