"""Approximate nearest neighbours: a vantage-point tree for each shard.

Every vector goes to a shard by a hash of its id; shards hold a bounded number of vectors, so their number
follows the table. A shard's tree is built once, in one task, and staged as one row (arrays as bytes). A block
of queries then meets a shard's tree in one task; all queries of the block walk the tree together.

On unit vectors the Euclidean distance falls as the cosine rises, and it is a metric: a subtree whose distances
from the vantage point lie in [low, high] cannot hold anything nearer than ``tau`` (the k-th nearest so far) if
d - high > tau or low - d > tau. Pruning is relaxed by a factor f >= 1: subtrees are skipped from tau / f on.
With f = 1 the search is exact.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
another length than the query's are no candidates; a query's own id is no candidate; equal scores go to the
smaller id, vectors of one direction and different length among them; identical vectors of a shard are one point of its tree that keeps the k + 1 smallest of their ids,
which are all that can be among k results; repeated rows of an id count once.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import staged

SHARD_ROWS = 4096
QUERY_BLOCK = 256
LEAF = 256
FACTOR = 4.0
#: slack against rounding of distances, so that factor 1 is exact: all that lies within it of the k-th nearest found
#: is ranked by exact scores
ROUNDING = 1e-7


class VantageTree:
    """Points in tree order; a node is a slice of them whose first point is its vantage point."""

    def __init__(self, points: np.ndarray):
        self.points, self.order, self.nodes = points, np.arange(len(points)), []
        if len(points):
            self._split(0, len(points))
        self.points = points[self.order]
        self.nodes = np.array(self.nodes, dtype=float).reshape(-1, 8)

    def _split(self, start: int, stop: int) -> int:
        """Nodes are (start, stop, inner node, outer node, inner low, inner high, outer low, outer high)."""
        number = len(self.nodes)
        self.nodes.append([start, stop, -1, -1, 0, 0, 0, 0])
        if stop - start > LEAF:
            members = self.order[start:stop]
            middle = self.points[members].mean(axis=0)
            far = int(np.argmax(np.square(self.points[members] - middle).sum(axis=1)))
            members[[0, far]] = members[[far, 0]]
            distance = distances(self.points[members[:1]], self.points[members[1:]])[0]
            by = np.argsort(distance, kind="stable")
            self.order[start + 1:stop] = members[1:][by]
            distance, half = distance[by], (stop - start - 1) // 2
            cut = start + 1 + half
            inner, outer = self._split(start + 1, cut), self._split(cut, stop)
            self.nodes[number] = [start, stop, inner, outer, distance[0], distance[half - 1], distance[half],
                                  distance[-1]]
        return number


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (left @ right.T), 0.0))


def search(points: np.ndarray, nodes: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple:
    """Positions of the ``k`` nearest points of each query (-1: none) and their distances."""
    best = np.full((len(queries), k), np.inf)
    place = np.full((len(queries), k), -1)

    def offer(active: np.ndarray, start: int, stop: int, found: np.ndarray) -> None:
        nearer = found.min(axis=1) < best[active, -1]
        if not nearer.any():
            return
        active, found = active[nearer], found[nearer]
        every = np.concatenate([best[active], found], axis=1)
        where = np.concatenate([place[active], np.broadcast_to(np.arange(start, stop), found.shape)], axis=1)
        near = np.argpartition(every, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(every, near, axis=1), axis=1), axis=1)
        best[active] = np.take_along_axis(every, near, axis=1)
        place[active] = np.take_along_axis(where, near, axis=1)

    def visit(number: int, active: np.ndarray) -> None:
        start, stop, inner, outer = nodes[number, :4].astype(int)
        if inner < 0:
            offer(active, start, stop, distances(queries[active], points[start:stop]))
            return
        d = distances(queries[active], points[start:start + 1])
        offer(active, start, start + 1, d)
        d, (in_low, in_high, out_low, out_high) = d[:, 0], nodes[number, 4:]
        gap = {inner: np.maximum(d - in_high, in_low - d), outer: np.maximum(d - out_high, out_low - d)}
        inner_first = gap[inner] <= gap[outer]
        # each query walks its nearer child first; both groups then see the other child with a smaller tau
        for child, mine in ((inner, inner_first), (outer, ~inner_first), (outer, inner_first), (inner, ~inner_first)):
            go = mine & (gap[child] <= best[active, -1] / factor + ROUNDING)
            if go.any():
                visit(child, active[go])

    if len(nodes) and len(queries):
        visit(0, np.arange(len(queries)))
    return place, best


def within(points: np.ndarray, nodes: np.ndarray, query: np.ndarray, far: float) -> np.ndarray:
    """Positions of all points that are no farther than ``far`` from the query."""
    found, waiting = [], [0] if len(nodes) else []
    while waiting:
        number = waiting.pop()
        start, stop, inner, outer = nodes[number, :4].astype(int)
        d = distances(query[None], points[start:stop if inner < 0 else start + 1])[0]
        found.append(start + np.flatnonzero(d <= far))
        if inner >= 0:
            for child, low, high in ((inner, *nodes[number, 4:6]), (outer, *nodes[number, 6:8])):
                if low - far - ROUNDING <= d[0] <= high + far + ROUNDING:
                    waiting.append(child)
    return np.concatenate(found) if found else np.empty(0, int)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)`` of the vectors that take part, as doubles."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).alias("id"), vector.alias("vector")).where(
        F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard: ``shard, dim, points, nodes, vectors, ids, starts`` (arrays as bytes).

    ``vectors`` are the original ones in tree order; the ids of point i are ids[starts[i]:starts[i + 1]].
    """
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    dealt = rows.select("id", "vector", F.size("vector").alias("dim"),
                        F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable").drop_duplicates("id")
        vectors, ids = np.array(group["vector"].to_list()), group["id"].to_numpy()
        vectors = vectors + 0.0  # one zero
        _, first, same = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        same = same.reshape(-1)
        kept = np.concatenate([np.flatnonzero(same == i)[:k + 1] for i in range(len(first))]) \
            if len(first) < len(ids) else np.argsort(same)
        counts = np.bincount(same[kept], minlength=len(first))
        starts = np.concatenate([[0], np.cumsum(counts)])
        tree = VantageTree(vectors[first] / np.linalg.norm(vectors[first], axis=1, keepdims=True))
        ids = np.concatenate([ids[kept[starts[i]:starts[i + 1]]] for i in tree.order])
        starts = np.concatenate([[0], np.cumsum(counts[tree.order])])
        return pd.DataFrame({"shard": [key[1]], "dim": [key[0]], "points": [tree.points.tobytes()],
                             "nodes": [tree.nodes.tobytes()], "vectors": [vectors[first][tree.order].tobytes()],
                             "ids": [ids.astype("int64").tobytes()], "starts": [starts.astype("int64").tobytes()]})

    return staged(dealt.groupBy("dim", "shard").applyInPandas(
        build, "shard long, dim int, points binary, nodes binary, vectors binary, ids binary, starts binary"),
        "vantage-trees")


def search_index(index: DataFrame, queries: DataFrame, k: int, factor: float = FACTOR,
                 query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each query, by cosine in doubles."""
    n = queries.count()
    blocks = max(1, -(-n // query_block))
    packed = queries.select("id", "vector", F.size("vector").alias("dim"),
                            F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block"))
    shards = index.select(F.col("shard").alias("shard"), F.col("dim").alias("dim"))
    # a block of queries meets every shard; a shard's tree is sent once to each block, not to each query
    asked = packed.join(shards, "dim").select("dim", "shard", "block", "id", "vector")
    trees = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"))

    def run(key: tuple, tree: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if tree.empty or group.empty:
            return empty
        row, dim = tree.iloc[0], int(key[0])
        arrays = {c: np.frombuffer(row[c], float).reshape(-1, w)
                  for c, w in (("points", dim), ("nodes", 8), ("vectors", dim))}
        ids, starts = np.frombuffer(row["ids"], "int64"), np.frombuffer(row["starts"], "int64")
        group = group.sort_values("id").drop_duplicates("id")
        own, asked_for = np.array(group["vector"].to_list()), group["id"].to_numpy()
        unit = own / np.linalg.norm(own, axis=1, keepdims=True)
        place, best = search(arrays["points"], arrays["nodes"], unit, k + 2, factor)
        # one more than can count tells where points as near as the last one may have been left out
        more = best[:, k + 1] <= best[:, k] + 2 * ROUNDING
        of, at = np.nonzero((place >= 0) & ~more[:, None])
        point = place[of, at]
        for query in np.flatnonzero(more):
            tied = within(arrays["points"], arrays["nodes"], unit[query], best[query, k] + 2 * ROUNDING)
            of, point = np.append(of, np.full(len(tied), query)), np.append(point, tied)
        many = starts[point + 1] - starts[point]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        of, point = np.repeat(of, many), np.repeat(point, many)
        near = arrays["vectors"][point]
        score = (own[of] * near).sum(axis=1) / (np.sqrt(np.square(own).sum(axis=1))[of]
                                                * np.sqrt(np.square(near).sum(axis=1)))
        found = pd.DataFrame({"query_id": asked_for[of], "vec_id": ids[starts[point] + inside], "score": score})
        found = found[found["query_id"] != found["vec_id"]]
        found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found.groupby("query_id").head(k)

    found = (trees.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block"))
             .applyInPandas(run, "query_id long, vec_id long, score double"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Index ``rows`` and search the ``k`` nearest of each of ``queries``."""
    index = build_index(usable(rows, id_col, vector_col), k, shard_rows)
    return search_index(index, usable(queries, id_col, vector_col), k, factor)


__all__ = ["VantageTree", "build_index", "distances", "nearest", "search", "search_index", "usable"]
