"""Whitening of embeddings by a one-sided Jacobi SVD of a blockwise QR factor.

1. One pass adds up the whole-number codes x = floor(1024 * c) + 100000 of each dimension, exactly.
2. A second pass (TSQR) centres each Arrow batch with the exact sums and keeps, per task, one upper triangle R: the QR factor of
   the last R over the next centred rows. Triangles are stacked and factored again in groups of bounded bytes until one is left,
   so neither a task nor the driver ever holds more than a few triangles. R'R is n times the covariance, which is never formed.
3. Plane rotations make R's columns orthogonal, round after round of disjoint pairs (``jacobi``). The rotations add up to
   the components; the lengths of the columns are the standard deviations times sqrt(n), to full relative accuracy.
4. A third pass measures the covariance of what is returned (means and centred products of blocks, merged pairwise), a last one returns it.

What is broadcast (mean and components) and what meets on the driver depends on the number of dimensions alone.

Defined results: rows whose vector is null, empty, holds a null or a non-finite entry, or has another length than most vectors
(of equally frequent lengths, the longest) are left out. vec_ids may be null or repeat; each row counts. Codes beyond
2**52 are cut to it. A component without variance (one row, equal rows) has e = 0: its whitened values are null and it does not count for
identity_error; ``explained`` is null if nothing varies. A deviation beyond a long is null. Of a component's two directions the one whose largest
entry is positive is taken. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import merged

SCALE, SHIFT, MOST = 1024.0, 100_000, 1 << 52


def codes(column: pa.Array, dims: int) -> np.ndarray:
    """The whole-number codes of an Arrow column of vectors, one row each."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.floor(c * SCALE).clip(-MOST, MOST).astype(np.int64) + SHIFT


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that count, and the length of their vectors."""
    v = F.col("v")
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    limit = F.lit(float("inf"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != limit)))
    first = rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dims = first[0]["d"] if first else 1
    return rows.where(F.size(v) == dims), dims


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, rotations): r @ rotations has orthogonal columns of these lengths, the longest first.

    A sweep meets every two columns once, in rounds of disjoint pairs; it ends when no two columns have a cosine beyond rounding.
    """
    d = r.shape[1]
    order = np.argsort(-np.linalg.norm(r, axis=0), kind="stable")
    a, v = r[:, order].copy(), np.eye(d)[:, order]
    ring = np.arange(d + d % 2)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            p, q = np.sort(np.stack([ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]]), axis=0)
            p, q = p[q < d], q[q < d]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            cosine = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > 1e-15
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = np.where(turn, 1 / np.sqrt(1 + t * t), 1.0)
            s = np.where(turn, c * t, 0.0)
            for m in (a, v):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            ring = np.concatenate((ring[:1], ring[-1:], ring[1:-1]))
        if worst <= 4e-15:
            break
    lengths = np.linalg.norm(a, axis=0)
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def column_sums(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """(n, S): the number of rows and the exact sums of their codes, as Python numbers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)  # two halves, as codes may have 53 bits
        for part in parts:
            x = codes(part.column(0), dims)
            n, high, low = n + len(x), high + (x >> 26).sum(axis=0), low + (x & ((1 << 26) - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array([*high.tolist(), n]), pa.array([*low.tolist(), 0])], ["dim", "high", "low"])

    wide = "decimal(38,0)"
    sums = rows.select("v").mapInArrow(run, "dim bigint, high bigint, low bigint").groupBy("dim").agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    found = {r["dim"]: (int(r["high"]), int(r["low"])) for r in sums.collect()}  # dims + 1 rows
    if not found:
        return 0, np.zeros(dims, object)
    return found[dims][0], np.array([(found[i][0] << 26) + found[i][1] for i in range(dims)], object)


def triangle(rows: DataFrame, dims: int, mean: np.ndarray) -> np.ndarray:
    """R of the centred codes of all rows."""
    sent = rows.sparkSession.sparkContext.broadcast(mean)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for part in parts:
            x = codes(part.column(0), dims)
            for at in range(0, len(x), 4096):
                r = _triangle(np.concatenate((r, x[at : at + 4096] - sent.value)))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["blob"])

    def join(blobs: list[bytes]) -> bytes:
        return _triangle(np.concatenate([np.frombuffer(b).reshape(-1, dims) for b in blobs])).tobytes()

    blob = merged(rows.select("v").mapInArrow(run, "blob binary"), join, 8 * dims * dims)
    return np.frombuffer(blob).reshape(-1, dims)


def measured_error(rows: DataFrame, dims: int, mean: np.ndarray, axes: np.ndarray) -> float:
    """The largest absolute entry of the covariance of (x - mean) @ axes minus the identity."""
    sent, k = rows.sparkSession.sparkContext.broadcast((mean, axes)), axes.shape[1]

    def moments(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        m = w.mean(axis=0)
        return float(len(w)), m, (w - m).T @ (w - m)

    def add(one, two):  # noqa: ANN001, ANN202
        n, gap = one[0] + two[0], two[1] - one[1]
        return n, one[1] + gap * (two[0] / n), one[2] + two[2] + np.outer(gap, gap) * (one[0] * two[0] / n)

    def packed(x) -> bytes:  # noqa: ANN001
        return np.concatenate(([x[0]], x[1], x[2].ravel())).tobytes()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in parts:
            if part.num_rows:
                own = moments((codes(part.column(0), dims) - sent.value[0]) @ sent.value[1])
                held = own if held is None else add(held, own)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([packed(held)], pa.binary())], ["blob"])

    def join(blobs: list[bytes]) -> bytes:
        held = None
        for b in blobs:
            x = np.frombuffer(b)
            own = (x[0], x[1 : 1 + k], x[1 + k :].reshape(k, k))
            held = own if held is None else add(held, own)
        return packed(held)

    x = np.frombuffer(merged(rows.select("v").mapInArrow(run, "blob binary"), join, 8 * (1 + k + k * k)))
    return float(np.abs(x[1 + k :].reshape(k, k) / x[0] - np.eye(k)).max(initial=0.0))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Per row the sum over dimensions of (n * x - S)**2, exact; null beyond a long."""
    reach = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums.tolist()))
    y = x * n - sums.astype(np.int64) if reach < 1 << 62 else x.astype(object) * n - sums
    if reach < 1 << 62 and max(abs(int(y.max())), abs(int(y.min()))) ** 2 * x.shape[1] < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    exact = (y.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row per usable vector and component."""
    rows, dims = usable(embeddings, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    n, sums = column_sums(rows, dims)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    mean = np.array([float(int(s) // n) + int(s) % n / n for s in sums])
    lengths, turns = jacobi(triangle(rows, dims, mean))
    k = min(components, dims)
    e, total = lengths[:k] ** 2 / n, float((lengths**2).sum() / n)
    turns = turns[:, :k] * np.where(np.take_along_axis(turns[:, :k], np.abs(turns[:, :k]).argmax(axis=0)[None, :], 0)[0] < 0, -1.0, 1.0)
    real = e > total * 1e-24
    axes = np.divide(turns, np.sqrt(e), out=np.zeros_like(turns), where=real)
    error = measured_error(rows, dims, mean, axes[:, real])
    sent = rows.sparkSession.sparkContext.broadcast((n, sums, mean, axes, real, (e / total).tolist() if total > 0 else [None] * k, error))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean, axes, real, explained, error = sent.value
        k = len(real)
        for part in parts:
            for at in range(0, part.num_rows, 4096):
                some = part.slice(at, 4096)
                x = codes(some.column(1), dims)
                w, m = (x - mean) @ axes, len(x)
                each = np.repeat(np.arange(m), k)
                out = [
                    some.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                    pa.array(w.ravel(), mask=np.tile(~real, m)),
                    pa.array(explained * m, pa.float64()),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(out, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
