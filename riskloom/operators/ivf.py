"""Clustered vector index: layout, probes, bounding-box pruning, exact and staged search.

The index is three tables: centroids, clusters (box, count, offset) and pages of members (``blocks``). Centroids and clusters are
bounded by the number of clusters and checked; they make a box tree (``boxtree``) that is broadcast and walked where queries are read, so a
pair of a query and a cluster becomes a row only if the search wants it. Wanted queries are dealt to the pages of their cluster in blocks, and a
task multiplies a page with a block. So members are never shuffled while the wanted queries can be broadcast, nothing passes through the driver but the tree, no
pair of a query and a member is a row, and what a bound or an early exit excludes is not computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators.blocks import LANES, scan_pages, to_pages
from riskloom.operators.boxtree import BoxTree, box_tree, walk_nearest, walk_within
from riskloom.operators.clustering import assign_nearest
from riskloom.operators.knn import rank_neighbours
from riskloom.sources.shared import write_table

#: Fixed values of the search: probes kept, early exit per dimension.
MAX_PROBES = 33
EARLY_PER_DIM = 1000 * 1000


def cluster_table(assigned: DataFrame, dims: int) -> DataFrame:
    """(cluster_id, n, bbox_min, bbox_max) of every cluster that has members."""
    low = F.array(*[F.min(F.get("q", i)) for i in range(dims)])
    high = F.array(*[F.max(F.get("q", i)) for i in range(dims)])
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("n"), low.alias("bbox_min"), high.alias("bbox_max"))


def with_offsets(clusters: DataFrame) -> DataFrame:
    """clusters with n_blocks and block_offset, the blocks of all clusters before. One row per cluster: bounded."""
    blocks = clusters.withColumn("n_blocks", F.ceil(F.col("n") / LANES).cast("long"))
    before = Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("block_offset", F.coalesce(F.sum("n_blocks").over(before), F.lit(0)))


def member_layout(assigned: DataFrame) -> DataFrame:
    """Members with their place in their cluster: pos by (distance to the centroid, vec_id), block and lane.

    All members are sorted by ranges of (cluster, distance, vec_id), so neither a cluster that owns most members nor one with most members at one
    distance is ordered in one task. A row's pos is its place in its range, and what earlier ranges hold of its cluster: a row a cluster and range.
    """
    keys = ["cluster_id", "cdist", "vec_id"]
    parts = int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = assigned.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    rows = write_table(rows, "layout").withColumn("range", F.shiftright("place", 33))
    runs = rows.groupBy("cluster_id", "range").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("cluster_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("cluster_id", "range", (F.col("start") - F.coalesce(before, F.lit(0))).alias("zero"))
    placed = rows.join(F.broadcast(runs), ["cluster_id", "range"]).withColumn("pos", (F.col("place") - F.col("zero")).cast("int"))
    return placed.select(*assigned.columns, "pos").withColumn("block", F.floor(F.col("pos") / LANES).cast("int")).withColumn("lane", F.col("pos") % LANES)


def _unbounded(queries: DataFrame) -> DataFrame:
    none = F.lit(None)
    return queries.select(F.col("vec_id").alias("query_id"), "q", none.cast("long").alias("bound"), none.cast("int").alias("done"))


def centroid_distances(queries: DataFrame, tree: BoxTree) -> DataFrame:
    """(query_id, q, cluster_id, turn, cdist, lb, bound): every query with every cluster that has members, made where the query is read."""
    return walk_within(_unbounded(queries), tree, turns=True)


def probes(distances: DataFrame, most: int = MAX_PROBES) -> DataFrame:
    """distances of the ``most`` nearest clusters of each query; turn is their place by (cdist, cluster_id) from 0."""
    return distances.where(F.col("turn") < most)


def scan(wanted: DataFrame, members: DataFrame, dims: int) -> DataFrame:
    """(wanted's columns, vec_id, label, dist): all members of the wanted (query_id, q, cluster_id), itself excluded."""
    both = wanted.join(members.select("cluster_id", "vec_id", "label", F.col("q").alias("v")), "cluster_id").where("vec_id <> query_id")
    return both.withColumn("dist", S.l2(F.col("q"), F.col("v"), dims)).drop("v")


def wanted_within(queries: DataFrame, tree: BoxTree, below: int) -> DataFrame:
    """(query_id, q, cluster_id, bound): the clusters whose box is nearer to a query than ``below``; a written table."""
    bounded = _unbounded(queries).withColumn("bound", F.lit(below).cast("long"))
    return write_table(walk_within(bounded, tree).select("query_id", "q", "cluster_id", "bound"), "wanted")


def range_search(queries: DataFrame, pages: DataFrame, tree: BoxTree, dims: int, below: int) -> DataFrame:
    """(query_id, vec_id, dist): all members nearer than ``below``; only clusters whose box comes as near are read."""
    return scan_pages(wanted_within(queries, tree, below), pages, dims, None).select("query_id", "vec_id", "dist")


def kth_distance(neighbours: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, n_found, worst): the k-th distance; null where fewer than k were found."""
    out = neighbours.groupBy("query_id").agg(F.count("*").alias("n_found"), F.max("dist").alias("worst"))
    return out.withColumn("worst", F.when(F.col("n_found") >= k, F.col("worst")))


def first_probe(queries: DataFrame, tree: BoxTree) -> DataFrame:
    """(query_id, q, cluster_id, bound): each query's nearest cluster, without a bound; a written table."""
    return write_table(walk_nearest(queries, tree).withColumn("bound", F.lit(None).cast("long")), "first-probe")


def search_exact(queries: DataFrame, pages: DataFrame, tree: BoxTree, dims: int, k: int = 5) -> DataFrame:
    """The k nearest of each query, by boxes: (query_id, vec_id, dist, label, rank).

    The nearest cluster gives a bound on the k-th distance; then only clusters whose box comes as near are read, for members that do.
    """
    first = first_probe(queries, tree)
    near = write_table(rank_neighbours(scan_pages(first, pages, dims, k), k), "first-near")
    wanted = write_table(walk_within(first_bounds(first, near, k), tree, strict=False).drop("turn", "cdist", "lb"), "wanted")
    found = scan_pages(wanted, pages, dims, k)
    return rank_neighbours(near.drop("rank").unionByName(found).select("query_id", "vec_id", "dist", "label"), k)


def first_bounds(first: DataFrame, near: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, q, bound, done): what a walk needs after the first probe; near: its k best."""
    bound = kth_distance(near, k).select("query_id", F.col("worst").alias("bound"))
    return first.select("query_id", "q", F.col("cluster_id").alias("done")).join(bound, "query_id", "left").select("query_id", "q", "bound", "done")


def _frauds(best: Column) -> Column:
    return F.aggregate(best, F.lit(0), lambda s, x: s + x["label"])


def _worst(best: Column, k: int) -> Column:
    return F.when(F.size(best) >= k, F.get(best, k - 1)["dist"]).otherwise(F.lit((1 << 63) - 1).cast("long"))


_KIND = "array<struct<dist:bigint,vec_id:bigint,label:int>>"


def near_lists(scanned: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, near): the k best rows of each key, sorted. Each task has passed on k rows of a query and cluster."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("dist", "vec_id"))
    best = scanned.withColumn("rank", turn).where(F.col("rank") <= k)
    return best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dist", F.col("vec_id").cast("long").alias("vec_id"), "label"))).alias("near"))


def fold_probes(lists: DataFrame, early: int, k: int = 5) -> DataFrame:
    """The staged search over each query's further probes in order, as a fold: (query_id, best, stopped).

    lists: query_id, best (from the first probe) and steps, an array sorted by turn of struct<turn, lb, near array<struct<dist, vec_id, label>>>, where near
    has the k best of that cluster. A step is skipped if its box is too far, else it is merged and may stop the fold (all
    or none are frauds, and near enough). At most 32 steps of k entries.
    """

    def step(acc: Column, x: Column) -> Column:
        merged = F.slice(F.array_sort(F.concat(acc["best"], x["near"])), 1, k)
        skip = acc["stopped"] | (x["lb"] >= _worst(acc["best"], k))
        stop = (_worst(merged, k) <= early) & ((_frauds(merged) >= k) | (_frauds(merged) < 1))
        return F.when(skip, acc).otherwise(F.struct(merged.alias("best"), stop.alias("stopped")))

    start = F.struct(F.col("best").cast(_KIND).alias("best"), F.lit(False).alias("stopped"))
    return lists.select("query_id", F.aggregate("steps", start, step).alias("a")).select("query_id", "a.best", "a.stopped")


def search_cascade(queries: DataFrame, pages: DataFrame, tree: BoxTree, dims: int, k: int = 5, early: int | None = None, most: int = MAX_PROBES) -> DataFrame:
    """(query_id, n): frauds among the neighbours that the staged search finds; not always the exact ones, by its rules.

    Stage 1 reads the nearest cluster, and queries whose neighbours are all frauds and near enough leave. Stage 2 reads, for the
    rest, the probes whose box is nearer than the k-th distance so far (others would be skipped, as it only shrinks), and
    folds them in order. Stage 3 reads, for those with fewer than k frauds, the clusters beyond the probes that can matter.
    """
    early = dims * EARLY_PER_DIM if early is None else early
    none, unbound = F.array().cast(_KIND), (1 << 63) - 1
    first = first_probe(queries, tree)
    near = near_lists(scan_pages(first, pages, dims, k), ["query_id"], k)
    one = first.join(near, "query_id", "left").select("query_id", "q", F.col("cluster_id").alias("done"), F.coalesce("near", none).alias("best"))
    leaves = (_frauds(F.col("best")) >= k) & (_worst(F.col("best"), k) <= early)
    one = write_table(one.withColumn("bound", _worst(F.col("best"), k)).withColumn("exited", leaves), "stage-1")
    going = one.where(~F.col("exited"))
    turns = write_table(walk_within(going.select("query_id", "q", F.nullif("bound", F.lit(unbound)).alias("bound"), "done"), tree, turns=True).drop("cdist"), "stage-2")
    turns = turns.withColumn("bound", F.coalesce("bound", F.lit(unbound)))
    probe = write_table(turns.where(F.col("turn") < most), "stage-2-probes")
    lists = near_lists(scan_pages(probe.select("query_id", "q", "cluster_id", "bound"), pages, dims, k), ["query_id", "cluster_id"], k)
    steps = probe.select("query_id", "cluster_id", "turn", "lb").join(lists, ["query_id", "cluster_id"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("turn", "lb", "near"))).alias("steps"))
    empty = F.array().cast(f"array<struct<turn:int,lb:bigint,near:{_KIND}>>")
    folded = fold_probes(going.join(steps, "query_id", "left").select("query_id", "best", F.coalesce("steps", empty).alias("steps")), early, k)
    folded = write_table(folded.withColumn("n", _frauds(F.col("best"))).withColumn("worst", _worst(F.col("best"), k)), "stage-2-folded")
    repair = folded.where(F.col("n") < k).select("query_id", "worst")
    rest = turns.where(F.col("turn") >= most).drop("bound").join(repair, "query_id").where(F.col("lb") < F.col("worst")).select("query_id", "q", "cluster_id", F.col("worst").alias("bound"))
    more = scan_pages(write_table(rest, "stage-3"), pages, dims, k).select("query_id", "dist", "vec_id", "label")
    kept = folded.where(F.col("n") < k).select("query_id", F.explode("best").alias("b")).select("query_id", "b.*")
    repaired = rank_neighbours(kept.unionByName(more), k).groupBy("query_id").agg(F.sum("label").cast("int").alias("repaired"))
    out = one.select("query_id", F.when(F.col("exited"), F.lit(k)).alias("left")).join(folded.select("query_id", "n"), "query_id", "left").join(repaired, "query_id", "left")
    every = queries.select(F.col("vec_id").alias("query_id")).join(out, "query_id", "left")
    return every.select("query_id", F.coalesce("left", "repaired", "n", F.lit(0)).cast("int").alias("n"))


def build_index(members: DataFrame, centroids: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """(clusters with offsets, pages of members); both written."""
    assigned = assign_nearest(members, centroids)
    return write_table(with_offsets(cluster_table(assigned, dims)), "clusters"), write_table(to_pages(member_layout(assigned)), "pages")


def index_tree(centroids: DataFrame, clusters: DataFrame) -> BoxTree:
    return box_tree(centroids, clusters)
