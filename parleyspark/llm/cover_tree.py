"""Exact top-k inner products by dual-tree search over cover trees.

Candidates and queries are dealt into blocks of bounded size by a hash of their id. Each pair of a query block
and a candidate block is one group of a Spark job: it builds a cover tree over either side and descends both
together. Two nodes with centres q, p and covering radii a, b cannot hold a score above
q.p + a|p| + b|q| + ab; a pair of nodes is left out if that lies below the worst kth score of the query
node. Groups run independently, so a lost executor costs its groups only; the k best of a query from each
candidate block are then ranked in Spark.

Defined results: vectors that are null, empty, or hold a null or a non-finite component take no part, nor do
rows without an id; vectors of different length have no score; rows that repeat an id with the same vector
count once, and a query never returns its own id; fewer candidates than k give all of them; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parleyspark.llm.common import keep

LEAF = 256
#: Points that are scored before the worst score is looked at again.
BATCH = 4096
#: A node with more than one centre for so many of its points stays a leaf: points that lie apart are scored together.
CROWDED = 16


class Tree:
    """A cover tree, built from the top: a node's children are centres more than half its scale apart, each with
    the points within half the scale that are nearest to it. `radius` is the distance to the farthest point
    below, rounded up. Points of a node are a stretch of `order`; nodes of at most LEAF points, or of points that are nearly all
    over half the scale apart, have no children."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.squares = np.einsum("ij,ij->i", points, points)
        self.order = np.arange(len(points))
        centre, radius, self.span, self.children = [], [], [], []

        def node(c: int, lo: int, hi: int) -> int:
            centre.append(c)
            self.span.append((lo, hi))
            radius.append(float(self._away(self.order[lo:hi], c).max()))
            self.children.append(None)
            return len(centre) - 1

        root = node(0, 0, len(points))
        todo = [(root, max(radius[root], 1.0))]
        while todo:
            top, scale = todo.pop()
            lo, hi = self.span[top]
            if hi - lo <= LEAF or radius[top] == 0:
                continue
            scale = min(scale, radius[top]) / 2
            own = self.order[lo:hi]
            near = np.full(hi - lo, np.inf)
            owner = np.zeros(hi - lo, np.int64)
            centres, at = [], int(np.flatnonzero(own == centre[top])[0])
            while True:
                away = self._away(own, own[at])
                closer = away < near
                owner[closer], near[closer] = len(centres), away[closer]
                owner[at], near[at] = len(centres), 0.0
                centres.append(own[at])
                at = int(near.argmax())
                if near[at] <= scale or len(centres) > len(own) // CROWDED:
                    break
            if near[at] > scale:
                continue
            ranked = np.argsort(owner, kind="stable")
            self.order[lo:hi] = own[ranked]
            ends = np.searchsorted(owner[ranked], np.arange(len(centres) + 1))
            below = [node(int(c), int(a), int(b)) for c, a, b in zip(centres, lo + ends[:-1], lo + ends[1:], strict=True) if b > a]
            self.children[top] = np.array(below)
            todo += [(child, scale) for child in below]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.inner = np.array([x is not None for x in self.children])

    def _away(self, rows: np.ndarray, c: int) -> np.ndarray:
        """Distances, rounded up: the squares are whole and exact below 2**52, else off by a few parts in 10**15."""
        total = self.squares[rows] + self.squares[c]
        return np.sqrt(np.maximum(total - 2 * (self.points[rows] @ self.points[c]), 0) + 1e-14 * total) * (1 + 1e-12)


class Best:
    """The k best scores and ids of each query: highest score, then smallest id. worst: the kth score, or less than any."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64) for _ in range(queries)]
        self.ids = [np.zeros(0, np.int64) for _ in range(queries)]
        self.worst = np.full(queries, -np.inf)

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        useful = scores >= self.worst[query]
        if not useful.any():
            return
        scores, ids = np.concatenate([self.scores[query], scores[useful]]), np.concatenate([self.ids[query], ids[useful]])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[first], ids[first]
        if len(first) == self.k:
            self.worst[query] = scores[first[-1]]


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score) of the k best points of each query, none with the query's own id. Whole-number vectors.

    A step takes a query node with all candidate nodes that it still may need. Those whose bound is below the
    worst kth score of the query node go; then the larger side is split, and when both are leaves their points
    are scored, the most promising nodes first.
    """
    largest = max(np.abs(queries).max(initial=0.0), np.abs(points).max(initial=0.0))
    exact = queries.shape[1] * largest * largest < 2**52  # then sums of doubles are whole and exact
    rows_of, cols_of = (queries, points) if exact else (queries.astype(np.int64), points.astype(np.int64))
    left, right = Tree(queries), Tree(points)
    norm_q, norm_p = np.sqrt(left.squares), np.sqrt(right.squares)
    best = Best(len(queries), k)

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        c, p, a, b = left.centre[q], right.centre[nodes], left.radius[q], right.radius[nodes]
        spread = a * norm_p[p] + b * norm_q[c] + a * b
        return points[p] @ queries[c] + spread + 1e-9 * (norm_p[p] * norm_q[c] + spread + 1)

    def score(rows: np.ndarray, nodes: np.ndarray) -> None:
        cols = np.concatenate([right.order[slice(*right.span[n])] for n in nodes])
        found = (rows_of[rows] @ cols_of[cols].T).astype(np.int64)
        least = np.iinfo(np.int64).min
        found[query_ids[rows][:, None] == ids[cols]] = least
        useful = (found > least) & (found >= best.worst[rows][:, None])
        if len(cols) > k:  # no more than the k best, and those equal to the last of them
            useful &= found >= np.partition(found, len(cols) - k, axis=1)[:, len(cols) - k, None]
        for i in np.flatnonzero(useful.any(1)):
            best.offer(rows[i], found[i][useful[i]], ids[cols][useful[i]])

    todo = [(0, np.array([0]))]
    while todo:
        q, nodes = todo.pop()
        rows = left.order[slice(*left.span[q])]
        tops = bounds(q, nodes)
        kept = tops >= best.worst[rows].min()
        nodes, tops = nodes[kept], tops[kept]
        inner = right.inner[nodes]
        reach = right.radius[nodes[inner]].max(initial=-1.0)
        if inner.any() and (not left.inner[q] or reach >= left.radius[q]):
            split = inner & (right.radius[nodes] >= reach / 2)
            todo.append((q, np.concatenate([nodes[~split], *[right.children[n] for n in nodes[split]]])))
        elif left.inner[q]:
            todo += [(child, nodes) for child in left.children[q]]
        else:
            ranked = np.argsort(-tops)
            nodes, tops = nodes[ranked], tops[ranked]
            sizes = np.cumsum([right.span[n][1] - right.span[n][0] for n in nodes])
            at = 0
            while at < len(nodes) and tops[at] >= best.worst[rows].min():
                end = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH)), at + 1)
                score(rows, nodes[at:end])
                at = end
    return [(int(query_ids[i]), int(n), int(x)) for i in range(len(queries)) for x, n in zip(best.scores[i], best.ids[i], strict=True)]


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, vector) of usable rows, components floor(scale * x) as doubles."""
    x = F.col(vector)
    usable = F.col(vec_id).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    made = rows.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(scale * v.cast("double")).cast("double")).alias("vector"))
    return made.distinct()


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block: int = 4096, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query, ties to the smaller id.

    is_query: a condition on the column vec_id. block: rows that one side of a group holds, about.
    """
    points = keep(whole_vectors(rows, vec_id, vector, scale))
    queries = points.where(is_query)
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    parts, groups = (-(-max(x.count(), 1) // block) for x in (points, queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = points.select("vec_id", "vector", deal(parts, "p").alias("part"), every(groups).alias("group"))
    left = queries.select("vec_id", "vector", deal(groups, "q").alias("group"), every(parts).alias("part"))
    side = lambda x, name: x.select("vec_id", "vector", "group", "part", F.lit(name).alias("side"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        length = frame["vector"].map(len)
        for n in length.unique():
            of = frame[length == n]
            q, p = of[of["side"] == "q"], of[of["side"] == "p"]
            if len(q) and len(p):
                pack = lambda x: np.array(x["vector"].tolist(), np.float64)
                out += search(pack(q), q["vec_id"].to_numpy(), pack(p), p["vec_id"].to_numpy(), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    both = side(left, "q").unionByName(side(right, "p"))
    found = both.groupBy("group", "part").applyInPandas(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
