"""Nearest neighbours by inner product: a vantage-point tree for each shard, with pruning relaxed by a factor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points in a leaf; rows of a shard, at least and at most; shards up to which shards stay small.
LEAF, SHARD_LEAST, SHARD_MOST, SHARDS = 96, 4096, 65_536, 64
#: Queries searched together; pairs of query and point held before they are cut to the best.
BLOCK, HELD = 4096, 1 << 20
#: Vectors whose lengths share these many binary digits of the exponent's range lie in one tree.
SPAN = 8
_EPS = np.finfo(np.float64).eps


class VantagePointTree:
    """A tree over distinct vectors of one length, and of lengths (norms) that are not too different.

    Largest inner products are made nearest neighbours: each vector gets one more component that brings it to the common norm
    `reach`, and each query is scaled to that norm with a zero there, so that the squared distance is 2 * reach² minus twice the
    inner product, to which the triangle inequality applies.
    """

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        norm2 = (vectors**2).sum(1)
        self.reach = float(np.sqrt(norm2.max())) * (1 + 4 * _EPS)
        self.points = np.column_stack([vectors, np.sqrt(np.maximum(self.reach**2 - norm2, 0))])
        #: By how much an inner product with a query of length one, and a distance, may be off.
        self.error = 8 * self.points.shape[1] * _EPS * self.reach
        self.slack = float(np.sqrt(8 * self.points.shape[1] * _EPS)) * self.reach
        self.random = np.random.default_rng(seed)
        self.visited = 0  # distances computed
        self.root = self._built(np.arange(len(vectors)))

    def _built(self, own: np.ndarray):
        """A leaf is an array of points; a node is (vantage point, radius, inside, outside)."""
        if len(own) <= LEAF:
            return own
        some = self.random.choice(own, min(8, len(own)), replace=False)
        test = self.points[self.random.choice(own, min(64, len(own)), replace=False)]
        # of a few, the point whose distances to others spread most
        spread = [np.linalg.norm(test - self.points[s], axis=1).std() for s in some]
        vantage = some[int(np.argmax(spread))]
        own = own[own != vantage]
        d = np.linalg.norm(self.points[own] - self.points[vantage], axis=1)
        order = np.argsort(d, kind="stable")
        half = len(own) // 2
        return vantage, float(d[order[half - 1]] + d[order[half]]) / 2, self._built(own[order[:half]]), self._built(own[order[half:]])

    def search(self, unit: np.ndarray, found: Best, factor: float = 1.0) -> None:
        """Offers `found` every point that may belong to the best of a query (rows of `unit`, of length one).

        A half of a node is left out if it lies farther off than the distance of the least of the best so far divided by `factor`;
        with 1 nothing that belongs to the best is left out, larger factors visit fewer points.
        """

        def tau(active: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(2 * self.reach**2 - 2 * self.reach * found.least(active), 0))

        def products(active: np.ndarray, points: np.ndarray) -> np.ndarray:
            self.visited += len(active) * len(points)
            return unit[active] @ self.points[points, :-1].T

        def visit(node, active: np.ndarray) -> None:
            active = active[found.least(active) <= self.reach + self.error]  # else nothing here comes up to the best
            if not len(active):
                return
            if isinstance(node, np.ndarray):
                found.offer(active, products(active, node), node, self)
                return
            vantage, radius, inside, outside = node
            ip = products(active, np.array([vantage]))
            found.offer(active, ip, np.array([vantage]), self)
            d = np.sqrt(np.maximum(2 * self.reach**2 - 2 * self.reach * ip[:, 0], 0))
            near = d <= radius
            visit(inside, active[near])
            visit(outside, active[~near])
            open_ = np.abs(d - radius) <= tau(active) / factor + self.slack
            visit(outside, active[near & open_])
            visit(inside, active[~near & open_])

        visit(self.root, np.arange(len(unit)))


class Best:
    """The k best rows of each query: by score, exactly as summed in double precision, then by id.

    Points come with inner products that may be off a little; all that may belong to the best are held, and scored exactly when
    many are held and at the end. So points that tie at the last place are all seen.
    """

    def __init__(self, shard: Shard, queries: np.ndarray, own: np.ndarray, k: int):
        self.shard, self.queries, self.own, self.k = shard, queries, own, k
        self.low = np.full((len(queries), k + 1), -np.inf)  # what the best k + 1 points have at least
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, id, score

    def least(self, active: np.ndarray) -> np.ndarray:
        return self.low[active, 0]

    def offer(self, active: np.ndarray, ip: np.ndarray, points: np.ndarray, tree: VantagePointTree) -> None:
        may = ip + tree.error >= self.low[active, 0][:, None]
        near = np.flatnonzero(may.any(1))
        if not len(near):
            return
        a = active[near]
        every = np.concatenate([self.low[a], ip[near] - tree.error], axis=1)
        self.low[a] = np.sort(np.partition(every, -(self.k + 1), axis=1)[:, -(self.k + 1) :], axis=1)
        q, p = np.nonzero(may[near] & (ip[near] + tree.error >= self.low[a, 0][:, None]))
        self.pairs.append((a[q], tree.own[points[p]], ip[near][q, p] + tree.error))
        self.held += len(q)
        if self.held > HELD:
            self.cut()

    def cut(self) -> None:
        """Scores what is held and keeps the k best rows of each query."""
        q, p, high = (np.concatenate([x[i] for x in self.pairs]) if self.pairs else np.zeros(0, np.int64) for i in range(3))
        use = high >= self.low[q, 0]
        q, p = q[use], p[use]
        s = self.shard
        score = np.zeros(len(q))
        for i in range(0, len(q), 1 << 14):
            score[i : i + (1 << 14)] = np.cumsum(self.queries[q[i : i + (1 << 14)]] * s.vectors[p[i : i + (1 << 14)]], axis=1)[:, -1]  # summed in order
        n = np.minimum(s.first[p + 1] - s.first[p], self.k + 1)  # of equal vectors the k + 1 smallest ids are enough
        at = np.repeat(s.first[p] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        q, score, ids = np.repeat(q, n), np.repeat(score, n), s.ids[at]
        other = ids != self.own[q]
        q, ids, score = (np.concatenate([a, b[other]]) for a, b in zip(self.rows, (q, ids, score), strict=True))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.rows = tuple(x[rank < self.k] for x in (q, ids, score))
        self.pairs, self.held = [], 0


class Shard:
    """Rows of one shard: equal vectors as one point with their ids in order, and a tree for each class of lengths."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.vectors, which = np.unique(vectors[order], axis=0, return_inverse=True)
        by = np.argsort(which.ravel(), kind="stable")
        self.ids = ids[order][by]
        self.first = np.searchsorted(which.ravel()[by], np.arange(len(self.vectors) + 1))
        # the largest component of all becomes 1 at most, so that no square is infinite; powers of two change no digit
        scaled = np.ldexp(self.vectors, -int(np.frexp(np.abs(self.vectors).max())[1]))
        size = np.sqrt((scaled**2).sum(1))
        step = np.frexp(size)[1] // SPAN
        self.trees = []
        for c in np.unique(step)[::-1]:  # the longest first: they tell most
            own = np.flatnonzero(step == c)
            tree = VantagePointTree(scaled[own])
            tree.own = own
            self.trees.append(tree)

    def nearest(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query id, row id and score of the k best rows of each query but its own, best first."""
        unit = queries / np.abs(queries).max(1)[:, None]
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        found = Best(self, queries, own, k)
        for tree in self.trees:
            tree.search(unit, found, factor)
        found.cut()
        q, ids, score = found.rows
        return own[q], ids, score

    @property
    def visited(self) -> int:
        return sum(t.visited for t in self.trees)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null nor zero, without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _search_shards(batches: Iterator[pa.RecordBatch], k: int, factor: float) -> Iterator[pa.RecordBatch]:
    """Reads shard after shard, of each the rows first, then the queries: one tree at a time, queries in blocks."""
    key, points, shard = None, [], None
    for b in batches:
        part, dim, kind = (b.column(i).to_numpy() for i in range(3))
        cuts = np.flatnonzero((part[1:] != part[:-1]) | (dim[1:] != dim[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
            if lo == hi:
                continue
            if (part[lo], dim[lo]) != key:
                key, points, shard = (part[lo], dim[lo]), [], None
            ids = b.column(3).slice(lo, hi - lo).to_numpy()
            vectors = b.column(4).slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1)
            if not kind[lo]:
                points.append((ids, vectors))
                continue
            if shard is None:
                if not points:
                    continue  # queries that no vector of the shard is as long as
                shard, points = Shard(*(np.concatenate(x) for x in zip(*points, strict=True))), []
            for i in range(0, hi - lo, BLOCK):
                q, found, score = shard.nearest(ids[i : i + BLOCK], vectors[i : i + BLOCK], k, factor)
                head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
                ends = pa.array(np.append(head, len(q)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (found, score)]
                yield pa.RecordBatch.from_arrays([pa.array(q[head]), *lists], names=["query_id", "ids", "scores"])


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query the k rows found with the largest inner products, but its own.

    Scores are sums in double precision; ties go to the smaller vec_id, also at the last place; an inner product beyond the range of
    doubles counts as infinite. Vectors that are not usable, and rows with a null vec_id, take no part; vectors meet only those of
    the same length; a vec_id that repeats is as many rows, as a query it counts once, with its smallest vector. No query or no
    vector gives an empty result.

    Rows are dealt by a hash of their id and vector to shards of bounded size. A task reads a shard, builds its tree once, and streams all
    queries through it; k rows of each query come back from each shard.
    """
    pick = lambda d: d.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows, asked = pick(df), pick(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n = rows.count()
    shards = max(1, -(-n // min(SHARD_MOST, max(SHARD_LEAST, n // SHARDS))))
    part = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int").alias("shard")
    columns = lambda d, kind, shard: d.select(shard, F.size("vector").alias("dim"), F.lit(kind).alias("kind"), "vec_id", "vector")
    both = columns(rows, 0, part).union(columns(asked, 1, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")))
    met = both.repartition(shards, "shard").sortWithinPartitions("shard", "dim", "kind")
    each = met.mapInArrow(lambda batches: _search_shards(batches, k, factor), "query_id long, ids array<long>, scores array<double>")
    paired = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("i")))
    best = each.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(paired))), 1, k).alias("found"))
    return best.select("query_id", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
