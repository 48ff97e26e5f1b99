"""Exact nearest neighbours of a query set against all rows.

Queries are cut into blocks of BLOCK_BYTES; each block is sent to the tasks that read the members, which keep their own k best per
query with one matrix product per batch. Only k candidates per query and task are shuffled, and members never are.
Distances are sums of squares of whole numbers far below 2**53, so products in double precision are exact.
Ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the queries that are broadcast at once.
BLOCK_BYTES = 8 << 20
#: Matrix cells of one product.
CELLS = 1 << 22


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _best(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Per row of d the positions of the k least (d, id), in order."""
    if d.shape[1] > 4 * k:
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        worst = np.take_along_axis(d, near, 1).max(axis=1)
        tied = (d <= worst[:, None]).sum(axis=1) > k
    else:
        near, tied = np.tile(np.arange(d.shape[1]), (len(d), 1)), np.zeros(len(d), bool)
    order = np.lexsort((ids[near], np.take_along_axis(d, near, 1)), axis=1)[:, :k]
    out = np.take_along_axis(near, order, 1)
    for i in np.nonzero(tied)[0]:
        out[i] = np.lexsort((ids, d[i]))[:k]
    return out


class _Nearest:
    """The k best (dist, vec_id) of each query so far, in separate arrays, as ids need all their 64 bits."""

    def __init__(self, n: int, k: int):
        self.k, self.rows, self.size, self.worst, self.after = k, [], 0, np.full(n, np.inf), 4 * k * n + CELLS // 8

    def add(self, query: np.ndarray, d: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.rows.append((query, d, ids, labels))
        self.size += len(query)
        if self.size > self.after or np.isinf(self.worst).any():
            self.kept()

    def kept(self) -> tuple[np.ndarray, ...]:
        rows = tuple(np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((rows[2], rows[1], rows[0]))
        rows = tuple(x[order] for x in rows)
        rank = np.arange(len(order)) - np.searchsorted(rows[0], rows[0], "left")
        last = rank == self.k - 1
        self.worst[rows[0][last]] = rows[1][last]
        self.rows = [tuple(x[rank < self.k] for x in rows)]
        self.size = len(self.rows[0][0])
        return self.rows[0]


def _own(qid: np.ndarray, order: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) positions of equal ids; order sorts qid."""
    low, high = (np.searchsorted(qid, ids, side, sorter=order) for side in ("left", "right"))
    n = high - low
    column = np.repeat(np.arange(len(ids)), n)
    return order[np.arange(len(column)) - np.repeat(np.cumsum(n) - n, n) + low[column]], column


def _scan(parts: Iterator[pa.RecordBatch], qid: np.ndarray, q: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query of a task's members (vec_id, label, q). Once a query has k, only what is no farther than its k-th is looked at."""
    norm, order, found = (q * q).sum(axis=1), np.argsort(qid, kind="stable"), _Nearest(len(qid), k)
    step = max(1, CELLS // max(1, len(qid)))
    for part in parts:
        ids, labels, m = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2))
        for at in range(0, len(ids), step):
            to = slice(at, at + step)
            d = norm[:, None] + (m[to] * m[to]).sum(axis=1)[None, :] - 2.0 * (q @ m[to].T)
            d[_own(qid, order, ids[to])] = np.inf
            if np.isinf(found.worst).any():
                j = _best(d, ids[to], k)
                i, j = np.repeat(np.arange(len(qid)), j.shape[1]), j.ravel()
                real = np.isfinite(d[i, j])
                i, j = i[real], j[real]
            else:
                i, j = np.nonzero(d <= found.worst[:, None])
            found.add(i, d[i, j], ids[to][j], labels[to][j])
    if found.rows:
        n, d, ids, labels = found.kept()
        yield pa.RecordBatch.from_arrays([pa.array(qid[n]), pa.array(ids), pa.array(d.astype(np.int64)), pa.array(labels.astype(np.int32))], ["query_id", "vec_id", "dist", "label"])


def rank_neighbours(candidates: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query by (dist, vec_id), with their rank from 1."""
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id"))
    return candidates.withColumn("rank", turn).where(F.col("rank") <= k)


def block_filters(n: int, row_bytes: int, bound: int, key: Column) -> list[Column]:
    """Conditions that cut n rows into blocks of about ``bound`` bytes by a hash of key."""
    blocks = max(1, -(-n * row_bytes // bound))
    return [F.pmod(F.xxhash64(key), F.lit(blocks)) == b for b in range(blocks)]


def knn_exact(queries: DataFrame, members: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, dist, label, rank). queries: vec_id, q; members: vec_id, label, q. A query is not its own neighbour."""
    members = members.select("vec_id", "label", "q")
    queries = queries.select("vec_id", "q")
    first = queries.select(F.count("*").alias("n"), F.max(F.size("q")).alias("d")).first()
    found = None
    for some in block_filters(first["n"], 8 * (first["d"] or 1), BLOCK_BYTES, F.col("vec_id")):
        table = queries.where(some).toArrow().combine_chunks()
        if not table.num_rows:
            continue
        qid, q = table.column(0).to_numpy(), _matrix(table.column(1).combine_chunks())
        sent = members.sparkSession.sparkContext.broadcast((qid, q))
        near = members.mapInArrow(_scanner(sent, k), "query_id bigint, vec_id bigint, dist bigint, label int")
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = members.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, dist bigint, label int")
    return rank_neighbours(found, k)


def _scanner(sent, k):  # noqa: ANN001, ANN202
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scan(parts, *sent.value, k)

    return run


def vote(neighbours: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n): the frauds among the neighbours of each query; 0 where a query has none."""
    n = neighbours.groupBy("query_id").agg(F.sum("label").cast("int").alias("n"))
    return queries.select(F.col("vec_id").alias("query_id")).join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))
