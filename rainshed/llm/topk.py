"""Exact top-k by inner product: dual-tree search over cover trees.

Rows are dealt into blocks of bounded size, queries likewise; each pair of blocks is one group of a cogrouped map.  In
a group both sides are indexed by a cover tree: the children's centres of a node are picked farthest first until all
points are within half the node's scale, then every point goes to its nearest centre; a node keeps the exact radius that
covers its points.  A small node is split only if its fan of centres covers it at half the scale.  Pairs of nodes are visited together.  The inner product of any two points of two nodes is at most
c.d + r|d| + s|c| + rs for centres c, d and radii r, s; a pair whose bound is below the worst k-th score of the query
node is pruned, reference nodes are otherwise taken in order of the bound.  The blocks' best are merged by rank.

Work is queries times rows where nothing can be pruned, as in any exact search; memory is a pair of blocks.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    k: int = 5
    rows: int = 8192
    queries: int = 4096
    leaf: int = 48
    least: int = 16
    fan: int = 24


class CoverTree:
    """Over the rows of ``points`` (n, d), n > 0; ``order`` lists them node by node."""

    def __init__(self, points: np.ndarray, params: Params):
        self.points, self.params = points.astype(np.float64), params
        self.order = np.arange(len(points))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.children: list[list[int]] = []
        todo = [self._node(0, len(points), 0)]
        while todo:
            todo += self._split(todo.pop())
        self.centres = self.points[self.centre]
        self.norms = np.sqrt((self.centres**2).sum(axis=1))
        self.radii = np.array(self.radius)
        self.points = self.points[self.order]

    def _far(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(axis=1))

    def _node(self, begin: int, end: int, centre: int) -> int:
        rows = self.order[begin:end]
        self.centre.append(centre)
        self.radius.append(float(self._far(rows, centre).max()))
        self.begin.append(begin)
        self.end.append(end)
        self.children.append([])
        return len(self.centre) - 1

    def _split(self, node: int) -> list[int]:
        begin, end = self.begin[node], self.end[node]
        if end - begin <= self.params.least or self.radius[node] == 0:
            return []
        rows = self.order[begin:end]
        centres = [self.centre[node]]
        near = self._far(rows, centres[0])
        owner = np.zeros(len(rows), dtype=np.int64)
        while len(centres) < self.params.fan and near.max() > self.radius[node] / 2:
            centres.append(int(rows[near.argmax()]))
            far = self._far(rows, centres[-1])
            owner[far < near] = len(centres) - 1
            near = np.minimum(near, far)
        if end - begin <= self.params.leaf and near.max() > self.radius[node] / 2:
            return []  # small, and without clusters to tell apart
        self.order[begin:end] = rows[np.argsort(owner, kind="stable")]
        at = begin + np.r_[0, np.cumsum(np.bincount(owner, minlength=len(centres)))]
        self.children[node] = [self._node(int(a), int(b), c) for a, b, c in zip(at[:-1], at[1:], centres) if a < b]
        return self.children[node]


class Search:
    """The k best references of each query of a pair of blocks; (score, id) from best to worst."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, params: Params):
        self.k, self.own = params.k, own
        order = np.lexsort((ids, *rows.T)) if rows.shape[1] else np.argsort(ids)
        rows, ids = rows[order], ids[order]
        first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
        self.ids = np.split(ids, first[1:])  # of each distinct vector, ascending
        distinct = rows[first]
        big = float(np.abs(queries).max(initial=0)) * float(np.abs(distinct).max(initial=0)) * max(rows.shape[1], 1)
        self.exact = (queries, distinct) if big >= 2.0**53 else None
        self.q, self.r = CoverTree(queries, params), CoverTree(distinct, params)
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries]
        self.worst = np.full(len(queries), -np.inf)
        self.visited = 0
        self._search(0, np.array([0]))

    def _bounds(self, q: int, refs: np.ndarray) -> np.ndarray:
        t, r = self.q, self.r
        bound = r.centres[refs] @ t.centres[q] + t.radii[q] * r.norms[refs] + r.radii[refs] * t.norms[q] + t.radii[q] * r.radii[refs]
        return bound + 1e-9 * np.abs(bound) + 1e-6

    def _least(self, q: int) -> float:
        return float(self.worst[self.q.order[self.q.begin[q] : self.q.end[q]]].min())

    def _search(self, q: int, refs: np.ndarray) -> None:
        refs = refs[self._bounds(q, refs) >= self._least(q)]
        if self.q.children[q]:
            below = [c for r in refs.tolist() for c in (self.r.children[r] or [r])]
            for child in self.q.children[q]:
                self._search(child, np.array(below, dtype=np.int64))
            return
        tie = count()
        heap = [(-b, next(tie), r) for b, r in zip(self._bounds(q, refs).tolist(), refs.tolist())]
        heapq.heapify(heap)
        while heap and -heap[0][0] >= self._least(q):
            _, _, r = heapq.heappop(heap)
            if below := self.r.children[r]:
                for b, c in zip(self._bounds(q, np.array(below)).tolist(), below):
                    heapq.heappush(heap, (-b, next(tie), c))
            else:
                self._compare(q, r)

    def _compare(self, q: int, r: int) -> None:
        t, u = self.q, self.r
        qs, rs = t.order[t.begin[q] : t.end[q]], u.order[u.begin[r] : u.end[r]]
        if self.exact is None:
            scores = t.points[t.begin[q] : t.end[q]] @ u.points[u.begin[r] : u.end[r]].T
        else:
            scores = self.exact[0][qs] @ self.exact[1][rs].T
        self.visited += scores.size
        maybe = scores >= self.worst[qs][:, None]
        for i in np.flatnonzero(maybe.any(axis=1)).tolist():
            query = int(qs[i])
            found = [(-s, v) for s, v in self.best[query]]
            for j in np.flatnonzero(maybe[i]).tolist():
                found += [(-int(scores[i, j]), v) for v in self._others(int(rs[j]), int(self.own[query]))]
            found = sorted(found)[: self.k]
            self.best[query] = [(-s, v) for s, v in found]
            if len(found) == self.k:
                self.worst[query] = -found[-1][0]

    def _others(self, vector: int, own: int) -> list[int]:
        """The k smallest ids of the vector's rows without the query's own."""
        out = []
        for v in self.ids[vector].tolist():
            if v != own:
                out.append(v)
                if len(out) == self.k:
                    break
        return out


def integers(vector: Column) -> Column:
    """floor(256 x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def _matrix(arrays: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width), dtype=np.int64)
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out


def top_k(vectors: DataFrame, is_query: Column, params: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of ``vectors`` (vec_id, embedding) where ``is_query`` holds.

    Ties go to the smaller vec_id; rows with the query's own vec_id are no candidates; fewer than k others give fewer
    rows.  Null vectors, vectors with a null or non-finite component and rows with a null vec_id take no part.  Shorter
    vectors count as padded with zeros.  A repeated row is a candidate each time; a repeated query is answered once.  Vectors so long that scores could
    pass 64 bits end the job with an error.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    known = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v"), is_query.alias("asks"))
    beyond = F.raise_error(F.lit("a vector's length is beyond 2^31: scores would pass 64 bits")).cast("boolean")
    known = known.where(F.when(length < 2.0**31, True).otherwise(beyond))
    n, asked = known.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    groups, blocks = -(-max(n, 1) // params.rows), -(-max(asked, 1) // params.queries)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = known.select("vec_id", "v", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int").alias("g")).withColumn("b", every(blocks))
    asks = known.where("asks").select("vec_id", "v").distinct()
    asks = asks.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("g", every(groups))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            width = max(max(map(len, left["v"])), max(map(len, right["v"])))
            queries = _matrix(left["v"], width)
            s = Search(queries, left["vec_id"].to_numpy(), _matrix(right["v"], width), right["vec_id"].to_numpy(), params)
            for i, (own, best) in enumerate(zip(left["vec_id"].tolist(), s.best)):
                key = zlib.crc32(queries[i].tobytes().rstrip(b"\0"))
                out += [(own, key, v, score) for score, v in best]
        return pd.DataFrame(out, columns=["query_id", "q", "vec_id", "score"])

    found = asks.groupBy("g", "b").cogroup(rows.groupBy("g", "b")).applyInPandas(search, "query_id bigint, q bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
