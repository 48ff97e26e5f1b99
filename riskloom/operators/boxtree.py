"""A two-level box tree over clusters, walked where the queries are read.

Clusters are cut along the widest spread of their centroids until a group has about sqrt(K) of them; a group's box holds the boxes
of its clusters. The tree is one broadcast of ``MAX_CENTROIDS`` clusters at most, which is checked. A walk tests a query with the boxes of groups,
then with those of clusters in groups that come near enough, and forms a row only for a cluster that does: there is no cross join, and
what is pruned was never a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.clustering import MAX_CENTROIDS
from riskloom.operators.knn import CELLS, _matrix
from riskloom.sources.shared import sent_by_value

FAR = (1 << 63) - 1
#: What a walk emits for a cluster: its turn by (distance of the centroid, cluster_id) from 0, that distance, the box's lower bound and the query's bound.
FOUND = "turn int, cdist bigint, lb bigint, bound bigint"


class BoxTree:
    """names, centroids, low, high by cluster, in the order of groups; first and last of each group, and the groups' boxes."""

    def __init__(self, names: np.ndarray, centroids: np.ndarray, low: np.ndarray, high: np.ndarray):
        size, todo, leaves = max(1, round(len(names) ** 0.5)), [np.argsort(names)] * (len(names) > 0), []
        while todo:
            own = todo.pop()
            if len(own) <= size:
                leaves.append(own)
                continue
            axis = np.ptp(centroids[own], axis=0).argmax()
            cut = own[np.argsort(centroids[own, axis], kind="stable")]
            todo += [cut[len(cut) // 2 :], cut[: len(cut) // 2]]
        order = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        self.names, self.centroids, self.low, self.high = names[order], centroids[order], low[order], high[order]
        self.last = np.cumsum([len(x) for x in leaves])
        self.first = self.last - np.array([len(x) for x in leaves], np.int64)
        self.group_low = np.array([low[x].min(axis=0) for x in leaves])
        self.group_high = np.array([high[x].max(axis=0) for x in leaves])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances to all centroids, exact while codes are whole numbers below 2**20 or so."""
        c = self.centroids
        return (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * (q @ c.T)

    def nearest(self, q: np.ndarray) -> np.ndarray:
        """The position of the nearest centroid; of equals the one with the least name."""
        d = self.distances(q)
        order = np.argsort(self.names, kind="stable")
        return order[d[:, order].argmin(axis=1)]

    @staticmethod
    def _bound(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(low)))
        for i in range(q.shape[1]):
            gap = np.maximum(np.maximum(low[None, :, i] - q[:, i, None], q[:, i, None] - high[None, :, i]), 0)
            out += gap * gap
        return out

    def within(self, q: np.ndarray, bound: np.ndarray, strict: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, cluster, lb) of clusters whose box is nearer than bound, or as near if not strict, and how many boxes were tested."""
        near = (lambda x, b: x < b) if strict else (lambda x, b: x <= b)
        reach = near(self._bound(q, self.group_low, self.group_high), bound[:, None])
        tested, found = reach.size, []
        for g in np.nonzero(reach.any(axis=0))[0]:
            who, span = np.nonzero(reach[:, g])[0], slice(self.first[g], self.last[g])
            lb = self._bound(q[who], self.low[span], self.high[span])
            tested += lb.size
            i, j = np.nonzero(near(lb, bound[who, None]))
            found.append((who[i], j + self.first[g], lb[i, j]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), tested
        return (*(np.concatenate(x) for x in zip(*found, strict=True)), tested)


def box_tree(centroids: DataFrame, clusters: DataFrame) -> BoxTree:
    """The tree of all clusters that have members; more than MAX_CENTROIDS are an error."""
    rows = clusters.select("cluster_id", "bbox_min", "bbox_max").join(centroids.select("cluster_id", "q"), "cluster_id").limit(MAX_CENTROIDS + 1).toArrow().combine_chunks()
    if rows.num_rows > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} clusters")
    low, high, c = (_matrix(rows.column(k).combine_chunks()) if rows.num_rows else np.zeros((0, 0)) for k in (1, 2, 3))
    return BoxTree(rows.column(0).to_numpy(), c, low, high)


#: Rows that a walk forms at once, at most (or those of one query).
FORMED = 1 << 17


def _steps(part: pa.RecordBatch, clusters: int, cells: int = CELLS) -> Iterator[pa.RecordBatch]:
    step = max(1, cells // max(1, clusters))
    for at in range(0, part.num_rows, step):
        yield part.slice(at, step)


def walk_nearest(queries: DataFrame, tree: BoxTree) -> DataFrame:
    """(query_id, q, cluster_id): the nearest cluster of each query (vec_id, q); none without clusters."""
    sent = sent_by_value(queries.sparkSession, tree)
    kinds = dict(queries.dtypes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent()
        for part in parts:
            for some in _steps(part, len(tree.names)) if len(tree.names) else ():
                pick = tree.nearest(_matrix(some.column(1)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(tree.names[pick].astype(np.int32))], ["query_id", "q", "cluster_id"])

    return queries.select("vec_id", "q").mapInArrow(run, f"query_id {kinds['vec_id']}, q {kinds['q']}, cluster_id int")


def walk_within(bounded: DataFrame, tree: BoxTree, strict: bool = True, turns: bool = False) -> DataFrame:
    """(query_id, q, cluster_id, turn, cdist, lb, bound) of clusters whose box is nearer than ``bound`` (as near, if not strict), but for the one named ``done``.

    bounded: query_id, q, bound (a long; null: no bound) and done (null: none). turn is null unless asked for, as it takes all centroids' distances.
    """
    sent = sent_by_value(bounded.sparkSession, tree)
    kinds = dict(bounded.dtypes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent()
        order = np.argsort(tree.names, kind="stable")
        for part in parts:
            for some in _steps(part, len(tree.names), FORMED) if len(tree.names) else ():
                q = _matrix(some.column(1))
                bound, done = some.column(2).fill_null(FAR).to_numpy().astype(np.float64), some.column(3).fill_null(-1).to_numpy()
                i, j, lb, _ = tree.within(q, bound, strict)
                other = tree.names[j] != done[i]
                i, j, lb = i[other], j[other], lb[other]
                if turns:
                    d = tree.distances(q)
                    place = np.empty(d.shape, np.int32)
                    np.put_along_axis(place, order[np.argsort(d[:, order], axis=1, kind="stable")], np.arange(d.shape[1], dtype=np.int32)[None, :], 1)
                    turn, cdist = pa.array(place[i, j]), pa.array(d[i, j].astype(np.int64))
                else:
                    turn, cdist = pa.nulls(len(i), pa.int32()), pa.nulls(len(i), pa.int64())
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), pa.array(tree.names[j].astype(np.int32)), turn, cdist, pa.array(lb.astype(np.int64)), some.column(2).take(at)], ["query_id", "q", "cluster_id", "turn", "cdist", "lb", "bound"])

    return bounded.select("query_id", "q", F.col("bound").cast("long").alias("bound"), "done").mapInArrow(run, f"query_id {kinds['query_id']}, q {kinds['q']}, cluster_id int, {FOUND}")


def walk_counts(bounded: DataFrame, tree: BoxTree, strict: bool = True) -> DataFrame:
    """(n_queries, n_pairs, n_tested, n_formed): of all queries, their pairs with clusters, the boxes that walks test and the rows they form."""
    sent = sent_by_value(bounded.sparkSession, tree)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, out = sent(), np.zeros(4, np.int64)
        for part in parts:
            for some in _steps(part, len(tree.names)) if len(tree.names) else ():
                i, _, _, tested = tree.within(_matrix(some.column(0)), some.column(1).fill_null(FAR).to_numpy().astype(np.float64), strict)
                out += [some.num_rows, some.num_rows * len(tree.names), tested, len(i)]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], ["n_queries", "n_pairs", "n_tested", "n_formed"])

    each = bounded.select("q", "bound").mapInArrow(run, "n_queries bigint, n_pairs bigint, n_tested bigint, n_formed bigint")
    return each.selectExpr(*[f"coalesce(sum({c}), 0) AS {c}" for c in each.columns])
