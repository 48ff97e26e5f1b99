"""k-means pieces: assignment, Lloyd steps, seeding by squared distance, and a fitted clustering.

Centroids are a bounded table (``MAX_CENTROIDS``); they are sent to the tasks, and members are assigned where they are
read, by one matrix product per batch: no shuffle, no cross join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.knn import _matrix
from riskloom.sources.shared import write_table

MAX_CENTROIDS = 65536


def _centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = centroids.select("cluster_id", "q").orderBy("cluster_id").limit(MAX_CENTROIDS + 1).toArrow().combine_chunks()
    if table.num_rows > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    if not table.num_rows:
        raise ValueError("no centroids")
    return table.column(0).to_numpy(), _matrix(table.column(1).combine_chunks())


def assign_nearest(members: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, label, q) with cluster_id and cdist of the nearest centroid; ties go to the smaller cluster_id."""
    ids, c = _centroid_matrix(centroids)
    sent = members.sparkSession.sparkContext.broadcast((ids, c, (c * c).sum(axis=1)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c, norm = sent.value
        step = max(1, (1 << 22) // len(ids))
        for part in parts:
            m = _matrix(part.column(2))
            best, dist = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64)
            for at in range(0, len(m), step):
                d = norm[None, :] - 2.0 * (m[at : at + step] @ c.T)
                pick = d.argmin(axis=1)  # the first of equals
                best[at : at + step] = pick
                dist[at : at + step] = d[np.arange(len(pick)), pick] + (m[at : at + step] ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids[best].astype(np.int32)), pa.array(dist)], ["vec_id", "label", "q", "cluster_id", "cdist"])

    kinds = dict(members.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, q {kinds['q']}, cluster_id int, cdist bigint"
    return members.select("vec_id", "label", "q").mapInArrow(run, schema)


def lloyd_sums(assigned: DataFrame, dims: int) -> DataFrame:
    """(cluster_id, n, sums): whole-number sums per dimension, combined before the shuffle."""
    sums = F.array(*[F.sum(F.get("q", i).cast("long")) for i in range(dims)])
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("n"), sums.alias("sums"))


def lloyd_step(assigned: DataFrame, dims: int) -> DataFrame:
    """(cluster_id, q): the means of the clusters, rounded down to whole codes."""
    sums = lloyd_sums(assigned, dims)
    return sums.select("cluster_id", F.transform("sums", lambda s: F.floor(s / F.col("n")).cast("int")).alias("q"))


def sse(assigned: DataFrame) -> DataFrame:
    """(n, total, mean): the squared distances of members to their centroids."""
    return assigned.agg(F.count("*").alias("n"), F.sum("cdist").alias("total"), (F.sum("cdist") / F.count("*")).alias("mean"))


def update_min_distance(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """members with min_dist, the squared distance to the nearest chosen centre (kept if smaller than one they have)."""
    now = assign_nearest(members, chosen).select("vec_id", "label", "q", F.col("cdist").alias("min_dist"))
    if "min_dist" not in members.columns:
        return now
    old = members.select("vec_id", F.col("min_dist").alias("old"))
    return now.join(old, "vec_id").select("vec_id", "label", "q", F.least("min_dist", "old").alias("min_dist"))


def weighted_pick(weighted: DataFrame, share: float, weight: str = "min_dist", buckets: int = 1024, range_rows: int = 1 << 20) -> DataFrame:
    """The first row, by vec_id, at which the running sum of weights reaches ``share`` of their total.

    The running sum goes over sums of id ranges first; the range that holds the row is cut again until it has
    ``range_rows`` rows at most (or one id), so no more are ever ordered in one place, however ids are spread.
    """
    span = weighted.agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"), F.sum(weight).alias("total")).first()
    if span["total"] is None:
        return weighted.select("vec_id", F.col(weight).alias("weight"), F.lit(0).cast("long").alias("running")).limit(0)
    target = share * float(span["total"])
    before, lo, hi = 0, span["lo"], span["hi"]
    while True:
        inside = weighted.where(F.col("vec_id").between(lo, hi))
        width = max(1, -(-(hi - lo + 1) // buckets))
        part = F.floor((F.col("vec_id") - lo) / width).alias("part")
        sums = inside.groupBy(part).agg(F.sum(weight).alias("s"), F.count("*").alias("n"), F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi")).orderBy("part").collect()  # ``buckets`` rows at most
        for r in sums:
            if before + (r["s"] or 0) >= target:
                break
            before += r["s"] or 0
        lo, hi = r["lo"], r["hi"]
        if r["n"] <= range_rows or lo == hi:
            break
    total = F.lit(before) + F.sum(weight).over(Window.orderBy("vec_id"))
    inside = weighted.where(F.col("vec_id").between(lo, hi))
    return inside.select("vec_id", F.col(weight).alias("weight"), total.alias("running")).where(F.col("running") >= target).orderBy("vec_id").limit(1)


def unit_hash(seed: str) -> Column:
    """A number from 0 to 1 of each vec_id, the same on any cluster: 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def least_rows(rows: DataFrame, key: str, n: int, most: int = 1 << 16) -> DataFrame:
    """The n rows with the least (key, vec_id), without a shuffle of rows: the range that holds the n-th is cut until it has ``most`` rows at most.

    key is a double. Rows that are equal in both are taken or left together.
    """
    low = high = None
    skip, inside = 0, rows
    while True:
        span = inside.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).first()
        if span["n"] + skip <= n:
            return rows if high is None else rows.where(F.col(key) <= high)
        low, high = span["low"], span["high"]
        if span["n"] <= most or low == high:
            break
        part = F.least(F.floor((F.col(key) - low) / (high - low) * 4096), F.lit(4095)).alias("part")
        for r in inside.groupBy(part).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy("part").collect():  # 4096 rows at most
            if skip + r["n"] >= n:
                break
            skip += r["n"]
        if (r["low"], r["high"]) == (low, high):
            break
        low, high = r["low"], r["high"]
        inside = rows.where(F.col(key).between(low, high))
    if n <= skip:
        return rows.where(F.col(key) < low)
    last = inside.select(key, "vec_id").orderBy(key, "vec_id").limit(n - skip).agg(F.max(F.struct(key, "vec_id")).alias("last")).first()["last"]
    return rows.where((F.col(key) < last[0]) | ((F.col(key) == last[0]) & (F.col("vec_id") <= last[1])))


def sample_exact(members: DataFrame, n: int, seed: str = "sample", weight: str | None = None) -> DataFrame:
    """Exactly n members (or all, if fewer), the same for the same seed; with a weight, each with a chance that grows with it (exponential keys: the least of -ln(u) / weight)."""
    u = unit_hash(seed)
    key = u if weight is None else F.when(F.col(weight) > 0, -F.log(F.greatest(u, F.lit(2.0**-53))) / F.col(weight))
    keyed = members.withColumn("_key", key.cast("double"))
    return least_rows(keyed.where("_key IS NOT NULL"), "_key", n).drop("_key")


def parallel_seeds(members: DataFrame, per_round: int, rounds: int = 4, seed: str = "seeds") -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """k-means||: (candidates (cluster_id, q), [(round, number of centres, cost)]).

    It starts with the member of least hash; each round costs one pass and takes every member with a chance of ``per_round`` times its share of
    the cost, all at once. Candidates are about rounds * per_round, and MAX_CENTROIDS at most.
    """
    spark = members.sparkSession
    first = least_rows(members.withColumn("_key", unit_hash(seed)), "_key", 1).select("q").limit(1).collect()
    centres, log = [list(r["q"]) for r in first], []
    for k in range(rounds + 1):
        if not centres:
            break
        near = assign_nearest(members, spark.createDataFrame(list(enumerate(centres)), "cluster_id int, q array<int>"))
        cost = near.agg(F.sum("cdist")).first()[0]
        log.append((k, len(centres), int(cost)))
        if k == rounds or not cost:
            break
        chosen = near.where(unit_hash(f"{seed}:{k}") * F.lit(float(cost)) < F.lit(float(per_round)) * F.col("cdist"))
        centres += [list(r["q"]) for r in chosen.select("q").orderBy("vec_id").limit(MAX_CENTROIDS - len(centres) + 1).collect()]
        if len(centres) > MAX_CENTROIDS:
            raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    return spark.createDataFrame(list(enumerate(centres)), "cluster_id int, q array<int>"), log


def reclustered(candidates: np.ndarray, weights: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k centres of weighted candidates, a bounded table: k-means++ seeding and Lloyd rounds with weights."""
    rng, far = np.random.default_rng(seed), np.full(len(candidates), np.inf)
    picked = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    while len(picked) < k:
        far = np.minimum(far, ((candidates - candidates[picked[-1]]) ** 2).sum(axis=1))
        share = weights * far
        if not share.sum():
            break
        picked.append(int(rng.choice(len(candidates), p=share / share.sum())))
    centres = candidates[picked]
    for _ in range(rounds):
        d = (candidates * candidates).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * candidates @ centres.T
        own = d.argmin(axis=1)
        total = np.bincount(own, weights, len(centres))
        sums = np.stack([np.bincount(own, weights * candidates[:, i], len(centres)) for i in range(candidates.shape[1])], axis=1)
        centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-300)[:, None], centres)
    return np.floor(centres + 0.5)


def lloyd_rounds(members: DataFrame, centroids: DataFrame, dims: int, iterations: int = 15) -> tuple[DataFrame, list[tuple[int, int]]]:
    """((cluster_id, q) after so many rounds of assignment and means, [(round, sum of squared distances before its means)]); fewer rounds if nothing moves.

    One pass a round gives error and means. A cluster that lost all its members is seeded again with one of the members farthest from their centroids.
    """
    spark, log = members.sparkSession, []
    ids, c = _centroid_matrix(centroids)
    rows = {int(i): [int(x) for x in q] for i, q in zip(ids, c, strict=True)}
    for k in range(iterations):
        table = spark.createDataFrame(sorted(rows.items()), "cluster_id int, q array<int>")
        assigned = assign_nearest(members, table)
        sums = assigned.groupBy("cluster_id").agg(F.sum("cdist").alias("d"), F.array(*[F.floor(F.sum(F.get("q", i).cast("long")) / F.count("*")).cast("int") for i in range(dims)]).alias("q")).collect()  # a row a cluster
        log.append((k, sum(r["d"] for r in sums)))
        means = {r["cluster_id"]: list(r["q"]) for r in sums}
        empty = sorted(set(rows) - set(means))
        far = assigned.where("cdist > 0").orderBy(F.desc("cdist"), "vec_id").select("q").limit(len(empty)).collect() if empty else []
        after = rows | means | {x: list(r["q"]) for x, r in zip(empty, far, strict=False)}
        if after == rows:
            break
        rows = after
    return spark.createDataFrame(sorted(rows.items()), "cluster_id int, q array<int>"), log


def lloyd(members: DataFrame, centroids: DataFrame, dims: int, iterations: int = 15) -> DataFrame:
    return lloyd_rounds(members, centroids, dims, iterations)[0]


def fit_centroids(members: DataFrame, k: int, dims: int, iterations: int = 15, sample_rows: int = 500_000) -> DataFrame:
    """(cluster_id, q) of a k-means clustering of an exact-size sample: k-means|| seeds, weighted by how many members each is nearest to, then Lloyd rounds."""
    some = write_table(sample_exact(members, sample_rows), "sample")
    candidates, _ = parallel_seeds(some, 2 * k)
    weights = assign_nearest(some, candidates).groupBy("cluster_id").agg(F.count("*").alias("n"))
    rows = candidates.join(weights, "cluster_id").orderBy("cluster_id").toArrow().combine_chunks()  # MAX_CENTROIDS rows at most
    if not rows.num_rows:
        return candidates
    centres = reclustered(_matrix(rows.column(1).combine_chunks()), rows.column(2).to_numpy().astype(np.float64), k)
    table = [(i, [int(x) for x in q]) for i, q in enumerate(np.unique(centres, axis=0))]
    return lloyd(some, members.sparkSession.createDataFrame(table, "cluster_id int, q array<int>"), dims, iterations)


def seed_centroids(members: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(cluster_id, q): k members picked one after another, each with a chance in proportion to its squared distance to those before.

    Two passes over members a centre, so for small k; ``fit_centroids`` seeds large k in a few passes.
    """
    rng = np.random.default_rng(seed)
    spark = members.sparkSession
    first = members.select("vec_id", "q", F.xxhash64("vec_id", F.lit(seed)).alias("turn")).orderBy("turn", "vec_id").limit(1).collect()
    picked = [(0, list(first[0]["q"]))] if first else []
    while picked and len(picked) < k:
        chosen = spark.createDataFrame(picked, "cluster_id int, q array<int>")
        near = assign_nearest(members, chosen).select("vec_id", "q", F.col("cdist").alias("min_dist"))
        hit = weighted_pick(near, float(rng.random())).select("vec_id")
        row = near.join(F.broadcast(hit), "vec_id").where("min_dist > 0").select("q").limit(1).collect()
        if not row:  # every member is a centre already
            break
        picked.append((len(picked), list(row[0]["q"])))
    return spark.createDataFrame(picked, "cluster_id int, q array<int>")
