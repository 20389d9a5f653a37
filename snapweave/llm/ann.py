"""Nearest neighbours by vantage-point trees, one per shard.

A tree of vantage points, fitted on a bounded sample, deals all vectors to at most
``LEAVES`` leaves; leaves of more than ``shard_rows`` rows are dealt on by a hash of
the id. Each such shard has a vantage-point tree of its own: a vantage point splits its
rows at the median distance, down to ``leaf`` rows. A query is searched in two rounds:
first in one shard of the leaf where it lies itself, then in the shards
that the triangle inequality doesn't exclude, given the ``k``-th distance found. In a tree it
visits a child unless the inequality says that it holds nothing nearer than
``radius / factor`` (radius: the k-th best so far): factor 1 is exact, above 1
fewer shards and leaves are read. A task holds one shard, and queries pass by.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapweave.llm._common import written

#: Leaves of the first tree, and vectors in the sample that it is fitted on, at most (about).
LEAVES, SAMPLE = 512, 8192
#: Leaf of vectors of another length than most: they are dealt by a hash alone.
_ODD = -1


class Router:
    """A complete binary tree of vantage points over vectors of ``size`` components."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 7) -> None:
        self.size, self.depth = sample.shape[1], depth
        rng = np.random.default_rng(seed)
        nodes = (1 << depth) - 1
        self.points, self.radius = np.zeros((nodes, self.size)), np.full(nodes, np.inf)
        rows = [np.arange(len(sample))]
        for at in range(nodes):
            own = rows[at]
            if len(own):
                self.points[at] = sample[own[rng.integers(len(own))]]
                d = np.sqrt(((sample[own] - self.points[at]) ** 2).sum(axis=1))
                self.radius[at] = np.median(d)
                rows += [own[d <= self.radius[at]], own[d > self.radius[at]]]
            else:
                rows += [own, own]

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        at = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            d = np.sqrt(((vectors - self.points[at]) ** 2).sum(axis=1))
            at = 2 * at + 1 + (d > self.radius[at])
        return at - len(self.points)

    def least(self, query: np.ndarray) -> np.ndarray:
        """For each leaf, a distance that none of its vectors is nearer than."""
        low = np.zeros(2 * len(self.points) + 1)
        d = np.sqrt(((self.points - query) ** 2).sum(axis=1))
        slack = 1e-9 * (1 + d)  # rounding of a distance must not hide a neighbour at the very bound
        for at in range(len(self.points)):
            low[2 * at + 1] = max(low[at], d[at] - self.radius[at] - slack[at])
            low[2 * at + 2] = max(low[at], self.radius[at] - d[at] - slack[at])
        return low[len(self.points) :]


class VpTree:
    def __init__(self, points: np.ndarray, leaf: int = 128, seed: int = 7) -> None:
        self.points, self.leaf = points, leaf
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(points)), rng)

    def _build(self, rows: np.ndarray, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        d = None
        if len(rows) > self.leaf:
            v = rows[rng.integers(len(rows))]
            d = np.sqrt(((self.points[rows] - self.points[v]) ** 2).sum(axis=1))
        if d is None or d.min() == d.max():  # few rows, or all as far away: copies can't be split
            self.nodes[me] = (rows,)
            return me
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        bounds = (d[near[0]], d[near[-1]], d[far[0]], d[far[-1]])
        self.nodes[me] = (v, bounds, self._build(rows[near], rng), self._build(rows[far], rng))
        return me

    def search(self, query: np.ndarray, ids: np.ndarray, own: int, k: int, factor: float, within: float = np.inf) -> list[tuple[float, int]]:
        """(distance, id) of the ``k`` nearest rows not further than ``within`` whose id isn't ``own``."""
        best: list[tuple[float, int]] = []  # max-heap by (distance, id), both negated
        todo = [(0.0, self.root)]
        while todo:
            low, at = heapq.heappop(todo)
            radius = min(within, -best[0][0]) if len(best) == k else within
            if low > radius / factor:
                break
            node = self.nodes[at]
            if len(node) == 1:
                rows = node[0]
                d = np.sqrt(((self.points[rows] - query) ** 2).sum(axis=1))
                for i in np.nonzero(d <= radius)[0].tolist():
                    it = (-float(d[i]), -int(ids[rows[i]]))
                    if -it[1] == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, it)
                    elif it > best[0]:
                        heapq.heapreplace(best, it)
                continue
            v, (a, b, c, e), near, far = node
            d = float(np.sqrt(((self.points[v] - query) ** 2).sum()))
            # rounding of a distance must not hide a neighbour at the very bound
            slack = 1e-9 * (1 + d)
            for child, lo, hi in ((near, a, b), (far, c, e)):
                heapq.heappush(todo, (max(low, lo - d - slack, d - hi - slack, 0.0), child))
        return sorted((-x, -y) for x, y in best)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Components of all vectors of a batch, and where each vector starts and ends in them."""
    flat = column.flatten().to_numpy()
    return flat, np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int64)


def _dealt(router: Router | None, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the leaf of each vector."""
    for b in batches:
        flat, cuts = _lists(b.column(1))
        leaf = np.full(b.num_rows, _ODD, np.int32)
        if router is not None:
            at = np.flatnonzero(np.diff(cuts) == router.size)
            for i in range(0, len(at), 1024):
                own = at[i : i + 1024]
                leaf[own] = router.leaf(flat[cuts[own][:, None] + np.arange(router.size)])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=["id", "v", "leaf"])


_FOUND = "query_id long, vec_id long, score double, leaf int, sub int, v array<double>, radius double"


class _Shard:
    """The vectors of one shard, with a tree for each length."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], leaf: int) -> None:
        self.trees = {}
        for size in {int(n) for _, _, cuts in parts for n in np.unique(np.diff(cuts))}:
            ids, rows = [], []
            for own, flat, cuts in parts:
                at = np.flatnonzero(np.diff(cuts) == size)
                ids.append(own[at])
                rows.append(flat[cuts[at][:, None] + np.arange(size)])
            self.trees[size] = (VpTree(np.concatenate(rows), leaf), np.concatenate(ids))

    def search(self, query: np.ndarray, own: int, k: int, factor: float, within: float) -> list[tuple[float, int]]:
        if len(query) not in self.trees:
            return []
        tree, ids = self.trees[len(query)]
        return tree.search(query, ids, own, k, factor, within)


def _searched(k: int, factor: float, leaf: int, router: Router | None, subs: dict[int, int], first: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns leaf, sub, tag, id, v, radius, sorted by the first three: a shard's vectors (tag 0), then queries. Out: what was found, and in the first round the shards still to be searched."""
    now, parts, shard = None, [], None
    for b in batches:
        where = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)])
        ids, (flat, cuts), radius = b.column(3).to_numpy(), _lists(b.column(4)), b.column(5).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (where[:, 1:] != where[:, :-1]).any(axis=0)])) if b.num_rows else []
        rows = []
        for s, e in zip(starts, [*starts[1:], b.num_rows]):
            at, sub, tag = where[:, s].tolist()
            if (at, sub) != now:
                now, parts, shard = (at, sub), [], None
            if tag == 0:
                parts.append((ids[s:e], flat[cuts[s] : cuts[e]], cuts[s : e + 1] - cuts[s]))
                continue
            shard = shard or _Shard(parts, leaf)
            for i in range(s, e):
                own, query = int(ids[i]), flat[cuts[i] : cuts[i + 1]]
                best = shard.search(query, own, k, factor, float(radius[i]))
                rows += [(own, n, d, None, None, None, None) for d, n in best]
                if first:
                    far = best[-1][0] if len(best) == k else np.inf
                    low = router.least(query) if at != _ODD else []
                    for other in [at] if at == _ODD else np.flatnonzero(low <= far / factor).tolist():
                        rows += [(own, None, None, other, j, query.tolist(), far) for j in range(subs.get(other, 0)) if (other, j) != now]
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["query_id", "vec_id", "score", "leaf", "sub", "v", "radius"])


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` of vectors that have only finite components, not all zero; of an id that stands more than once, each row counts."""
    v = df[vec_col].cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(df[id_col].cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(ok)


def fitted(points: DataFrame, leaves: int) -> Router | None:
    """A tree of ``leaves`` leaves (a power of two at most) over a sample of about ``SAMPLE`` of ``points``, for vectors of the length that is most frequent there."""
    n = points.count()
    some = points if n <= SAMPLE else points.sample(SAMPLE / n, seed=7)
    vectors = [np.array(r["v"]) for r in some.select("v").collect()]
    if not vectors:
        return None
    sizes = np.array([len(x) for x in vectors])
    most = np.bincount(sizes).argmax()
    return Router(np.stack([x for x in vectors if len(x) == most]), max(0, min(leaves, LEAVES, len(vectors) // 8).bit_length() - 1))


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, factor: float = 1.0, shard_rows: int = 8192, leaf: int = 512) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of ``df`` by Euclidean distance for each of ``queries``, which have the same columns.

    A row with the query's own id is no candidate; ties go to the smaller id. Vectors
    that are null, zero, or hold null or non-finite components take no part, nor do
    null ids. A vector is compared with those of its own length only. Queries that share an id
    get one list, of the nearest to any of them. No rows, no results.
    """
    points, asked = usable(df, id_col, vec_col), usable(queries, id_col, vec_col)
    router = fitted(points, -(-points.count() // shard_rows))
    deal = functools.partial(_dealt, router)
    placed, wanted = (d.mapInArrow(deal, "id long, v array<double>, leaf int") for d in (points, asked))
    counts = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a row a leaf
    subs = {at: -(-n // shard_rows) for at, n in counts.items()}
    many = F.array(*[F.lit(subs.get(at, 1)) for at in range(_ODD, LEAVES)])
    sub = F.pmod(F.xxhash64("id"), F.element_at(many, F.col("leaf") + (1 - _ODD))).cast("int")
    placed = placed.select("leaf", sub.alias("sub"), F.lit(0).alias("tag"), "id", "v", F.lit(float("inf")).alias("radius"))
    shards = min(max(sum(subs.values()), 1), 4096)

    def at_once(vectors: DataFrame, asking: DataFrame, first: bool) -> DataFrame:
        rows = vectors.unionByName(asking).repartition(shards, "leaf", "sub").sortWithinPartitions("leaf", "sub", "tag")
        return rows.mapInArrow(functools.partial(_searched, k, factor, leaf, router, subs, first), _FOUND)

    inf = F.lit(float("inf"))
    home = wanted.select("leaf", F.lit(0).alias("sub"), F.lit(1).alias("tag"), "id", "v", inf.alias("radius"))
    found = written(at_once(placed.where("sub = 0"), home, True), "found")
    more = found.where("leaf is not null").select("leaf", "sub", F.lit(1).alias("tag"), F.col("query_id").alias("id"), "v", "radius")
    both = found.where("leaf is null").unionByName(at_once(placed, more, False))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return both.select("query_id", "vec_id", "score").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
