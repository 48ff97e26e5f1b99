"""The staged search, the index on disk and the tree against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import blocks, boxtree, clustering, ivf, knn, sweeps, tree
from riskloom.operators.boxtree import BoxTree, box_tree
from riskloom.operators.features import event_vectors
from riskloom.plans import scoring
from riskloom.sources.index_store import open_index, write_index

SF, DIMS = "/root/testdata/sf0.01", 14


@pytest.fixture(scope="module")
def index(spark):
    vectors = event_vectors(spark.read.parquet(f"{SF}/events.parquet")).cache()
    centroids = vectors.where("vec_id % 157 = 0").select((F.col("vec_id") / 157).cast("int").alias("cluster_id"), "q").cache()
    clusters, pages = ivf.build_index(vectors, centroids, DIMS)
    return vectors, centroids, clusters, pages, box_tree(centroids, clusters)


def l2(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain_cascade(query, centroids, clusters, members, early, k=5, most=33):
    """The staged search by its definition, cluster by cluster."""
    qid, q = query
    box = lambda c: sum(max(lo - x, x - hi, 0) ** 2 for lo, x, hi in zip(clusters[c][0], q, clusters[c][1], strict=True))
    order = sorted(clusters, key=lambda c: (l2(q, centroids[c]), c))[:most]
    best = []
    add = lambda c: sorted(best + [(l2(q, v), i, y) for i, v, y in members[c] if i != qid])[:k]
    worst = lambda: best[-1][0] if len(best) == k else float("inf")
    frauds = lambda: sum(b[2] for b in best)
    best = add(order[0])
    if frauds() == k and worst() <= early:
        return k
    for c in order[1:]:
        if box(c) >= worst():
            continue
        best = add(c)
        if (frauds() < 1 or frauds() == k) and worst() <= early:
            break
    if frauds() < k:
        for c in sorted(set(clusters) - set(order)):
            if box(c) < worst():
                best = add(c)
    return frauds()


@pytest.mark.parametrize("early", [DIMS * 1000 * 1000, 60_000_000, 0])
def test_cascade_equals_its_definition(index, early):
    vectors, centroids, clusters, pages, boxes_ = index
    queries = vectors.where("vec_id % 50 = 0")
    found = {r["query_id"]: r["n"] for r in ivf.search_cascade(queries, pages, boxes_, DIMS, early=early).collect()}
    c = {r["cluster_id"]: r["q"] for r in centroids.collect()}
    boxes = {r["cluster_id"]: (r["bbox_min"], r["bbox_max"]) for r in clusters.collect()}
    by = {}
    for r in clustering.assign_nearest(vectors, centroids).collect():
        by.setdefault(r["cluster_id"], []).append((r["vec_id"], r["q"], r["label"]))
    want = {r["vec_id"]: plain_cascade((r["vec_id"], r["q"]), c, boxes, by, early) for r in queries.collect()}
    assert found == want and len(set(want.values())) > 2


def test_exact_searches_agree(index):
    vectors, _, _, pages, boxes = index
    queries = vectors.where("vec_id % 100 = 0")
    a = knn.knn_exact(queries, vectors)
    b = ivf.search_exact(queries, pages, boxes, DIMS)
    assert a.select(sorted(a.columns)).exceptAll(b.select(sorted(a.columns))).count() == 0 and a.count() == b.count() == 500


def test_exact_search_in_blocks_and_with_ties(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, i % 2, [rng.randrange(3) for _ in range(4)]) for i in range(400)]
    members = spark.createDataFrame(rows, "vec_id long, label int, q array<int>")
    monkeypatch.setattr(knn, "BLOCK_BYTES", 1000)
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in knn.knn_exact(members.where("vec_id % 4 = 0"), members).collect()}
    want = {}
    for i, _, q in rows[::4]:
        near = sorted((l2(q, v), j) for j, _, v in rows if j != i)[:5]
        want.update({(i, r + 1): j for r, (_, j) in enumerate(near)})
    assert found == want


def test_search_of_few_members(spark):
    members = spark.createDataFrame([(1, 1, [0, 0]), (2, 1, [5, 5])], "vec_id long, label int, q array<int>")
    queries = spark.createDataFrame([(1, [0, 0]), (9, [1, 1])], "vec_id long, q array<int>")
    assert {r["query_id"]: r["n"] for r in knn.vote(knn.knn_exact(queries, members), queries).collect()} == {1: 1, 9: 2}
    assert knn.knn_exact(queries.limit(0), members).count() == 0
    assert {r["n"] for r in knn.vote(knn.knn_exact(queries, members.limit(0)), queries).collect()} == {0}


def test_index_on_disk(spark, index, tmp_path):
    vectors, centroids, clusters, pages, boxes = index
    write_index(f"file://{tmp_path}/i", centroids, clusters, pages)
    c, b, p = open_index(spark, f"file://{tmp_path}/i")
    queries = vectors.where("vec_id % 500 = 0")
    a = ivf.search_exact(queries, p, box_tree(c, b), DIMS)
    assert a.exceptAll(ivf.search_exact(queries, pages, boxes, DIMS)).count() == 0 and a.count() == 100
    assert "PushedFilters: [IsNotNull(cluster_id), EqualTo(cluster_id,7)]" in p.where("cluster_id = 7")._jdf.queryExecution().executedPlan().toString()
    spark.read.parquet(f"file://{tmp_path}/i/index_meta").withColumn("version", F.lit(3)).write.parquet(f"file://{tmp_path}/j/index_meta")
    with pytest.raises(ValueError, match="version"):
        open_index(spark, f"file://{tmp_path}/j")


def test_ids_keep_all_their_bits(spark, index):
    big = [(1 << 60) + 3 * i + 1 for i in range(30)]
    rows = [(v, i % 2, [i, i * i % 7]) for i, v in enumerate(big)]
    members = spark.createDataFrame(rows, "vec_id long, label int, q array<int>")
    found = knn.knn_exact(members.where(f"vec_id < {big[3]}"), members).collect()
    want = set()
    for v, _, q in rows[:3]:
        near = sorted((l2(q, w), u) for u, _, w in rows if u != v)[:5]
        want |= {(v, u, d, r + 1) for r, (d, u) in enumerate(near)}
    assert {(r["query_id"], r["vec_id"], r["dist"], r["rank"]) for r in found} == want
    centroids = members.where(f"vec_id IN ({big[5]}, {big[20]})").select((F.col("vec_id") % 2).cast("int").alias("cluster_id"), "q")
    clusters, pages = ivf.build_index(members, centroids, 2)
    again = ivf.search_exact(members.where(f"vec_id < {big[3]}"), pages, box_tree(centroids, clusters), 2).collect()
    assert {(r["query_id"], r["vec_id"], r["dist"], r["rank"]) for r in again} == want


def test_box_walks_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    c = rng.integers(-50, 50, (300, 5)).astype(float)
    low, high = c - rng.integers(0, 9, c.shape), c + rng.integers(0, 9, c.shape)
    boxes = BoxTree(np.arange(300) * 3, c, low, high)
    q = rng.integers(-60, 60, (80, 5)).astype(float)
    bound = np.append(rng.integers(0, 2000, 79), 1 << 62).astype(float)
    gap = np.maximum(np.maximum(low[None] - q[:, None], q[:, None] - high[None]), 0)
    lb = (gap**2).sum(axis=2)
    for strict in (True, False):
        i, j, found, tested = boxes.within(q, bound, strict)
        near = lb < bound[:, None] if strict else lb <= bound[:, None]
        assert {(a, int(boxes.names[b]) // 3) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
        assert all(lb[a, boxes.names[b] // 3] == x for a, b, x in zip(i, j, found, strict=True)) and tested < lb.size
    d = ((q[:, None] - c[None]) ** 2).sum(axis=2)
    assert boxes.names[boxes.nearest(q)].tolist() == (d.argmin(axis=1) * 3).tolist()


def test_searches_without_clusters_or_queries(spark, index):
    vectors, _, _, pages, boxes = index
    none = vectors.limit(0)
    assert ivf.search_exact(none, pages, boxes, DIMS).count() == 0 and ivf.search_cascade(none, pages, boxes, DIMS).count() == 0
    clusters, no_pages = ivf.build_index(none, index[1], DIMS)
    empty = box_tree(index[1], clusters)
    some = vectors.where("vec_id < 3")
    assert ivf.search_exact(some, no_pages, empty, DIMS).count() == 0
    assert {r["n"] for r in ivf.search_cascade(some, no_pages, empty, DIMS).collect()} == {0}


def test_fitted_centroids_and_trees(index):
    vectors = index[0]
    centroids = clustering.fit_centroids(vectors, 8, DIMS, iterations=3)
    first = clustering.sse(clustering.assign_nearest(vectors, centroids)).first()["total"]
    again = clustering.lloyd_step(clustering.assign_nearest(vectors, centroids), DIMS)
    assert clustering.sse(clustering.assign_nearest(vectors, again)).first()["total"] <= first * 1.01
    nodes = tree.fit_tree(vectors, depth=4)
    table = tree.rows_of(nodes)

    def walk(q):
        at = 0
        while at >= 0:
            feat, thr, left, right = table[at]
            at = left if q[feat] <= thr else right
        return -1 - at

    placed = tree.predict(vectors, nodes).limit(400).collect()
    assert all(walk(r["q"]) == r["leaf_id"] for r in placed)


def test_large_trees_are_walked_by_level(spark, index, monkeypatch):
    vectors = index[0].where("vec_id % 37 = 0")
    nodes = tree.balanced_tree(spark, [i % 14 for i in range(31)], [100 * i for i in range(31)])
    want = tree.predict(vectors, nodes).select("vec_id", "leaf_id")
    monkeypatch.setattr(tree, "MAX_CASES", 3)
    assert tree.predict(vectors, nodes).select("vec_id", "leaf_id").exceptAll(want).count() == 0


def test_boxes_give_the_same_leaves(spark, index):
    vectors = index[0].where("vec_id % 37 = 0")
    nodes = tree.balanced_tree(spark, [i % 14 for i in range(31)], [100 * i for i in range(31)])
    assert tree.predict_boxes(vectors, nodes).select("vec_id", "leaf_id").exceptAll(tree.predict(vectors, nodes).select("vec_id", "leaf_id")).count() == 0


def test_members_keep_their_order_over_ranges(spark):
    """One cluster owns most members, most of them at one distance."""
    rows = [(i, 0, [0], 7, 5 if i % 3 else i) for i in range(3000)] + [(5000 + i, 0, [0], i % 4, i) for i in range(50)]
    placed = ivf.member_layout(spark.createDataFrame(rows, "vec_id long, label int, q array<int>, cluster_id int, cdist long").repartition(7)).collect()
    by = {}
    for r in placed:
        by.setdefault(r["cluster_id"], []).append((r["cdist"], r["vec_id"], r["pos"], r["block"] * 8 + r["lane"]))
    assert len(placed) == len(rows) and all([(p, b) for _, _, p, b in sorted(v)] == [(k, k) for k in range(len(v))] for v in by.values())


def test_lloyd_rounds_seed_lost_clusters_again(spark):
    members = spark.createDataFrame([(i, 0, [i % 3 * 100, i]) for i in range(30)], "vec_id long, label int, q array<int>")
    start = spark.createDataFrame([(0, [0, 0]), (1, [9000, 9000])], "cluster_id int, q array<int>")
    fitted = clustering.lloyd(members, start, 2, 4)
    assert clustering.assign_nearest(members, fitted).select("cluster_id").distinct().count() == 2


def test_searches_in_small_blocks_agree(index, monkeypatch):
    vectors, centroids, clusters, pages, boxes = index
    queries = vectors.where("vec_id % 400 = 0")
    want = {tuple(r) for r in ivf.search_exact(queries, pages, boxes, DIMS).collect()}
    n = {tuple(r) for r in ivf.search_cascade(queries, pages, boxes, DIMS).collect()}
    monkeypatch.setattr(blocks, "SENT_BYTES", 0)
    monkeypatch.setattr(blocks, "QUERY_ROWS", 3)
    monkeypatch.setattr(blocks, "PAGE_BLOCKS", 2)
    small = blocks.to_pages(ivf.member_layout(clustering.assign_nearest(vectors, centroids))).cache()
    assert small.agg(F.max("n")).first()[0] == 16
    assert {tuple(r) for r in ivf.search_exact(queries, small, boxes, DIMS).collect()} == want
    assert {tuple(r) for r in ivf.search_cascade(queries, small, boxes, DIMS).collect()} == n


def test_staged_scores_use_safe_leaves(spark, index):
    vectors, _, _, pages, boxes = index
    queries = vectors.where("vec_id % 250 = 0")
    nodes = tree.balanced_tree(spark, [9], [5000])
    leaves = spark.createDataFrame([(0, 4, True), (1, 0, False)], "leaf_id int, count int, safe boolean")
    found = {r["query_id"]: r["n"] for r in scoring.score_staged(queries, pages, boxes, nodes, leaves).collect()}
    searched = {r["query_id"]: r["n"] for r in ivf.search_cascade(queries, pages, boxes, DIMS).collect()}
    assert found == {r["vec_id"]: 4 if r["q"][9] <= 5000 else searched[r["vec_id"]] for r in queries.collect()}


def test_seeds_are_members_apart_from_each_other(spark, index):
    vectors = index[0].where("vec_id % 20 = 0")
    seeds = clustering.seed_centroids(vectors, 5).collect()
    assert len({tuple(r["q"]) for r in seeds}) == 5
    assert vectors.select("q").distinct().join(spark.createDataFrame([(list(r["q"]),) for r in seeds], "q array<int>"), "q").count() == 5
    few = spark.createDataFrame([(1, 0, [1, 1]), (2, 0, [1, 1]), (3, 1, [9, 9])], "vec_id long, label int, q array<int>")
    assert clustering.seed_centroids(few, 4).count() == 2


def test_synthetic_queries_repeat(spark, index):
    from riskloom.operators.features import random_vectors

    a, b = random_vectors(spark, 50).collect(), random_vectors(spark, 50).repartition(7).orderBy("vec_id").collect()
    assert a == b and all(-10000 <= x < 10000 for r in a for x in r["q"])
    assert knn.knn_exact(random_vectors(spark, 20), index[0]).groupBy("query_id").count().where("count = 5").count() == 20


def test_samples_have_an_exact_size(spark, monkeypatch):
    rows = spark.range(20_000).select(F.col("id").alias("vec_id"), (F.col("id") % 5).cast("double").alias("w")).repartition(9)
    whole = [r["vec_id"] for r in rows.withColumn("u", clustering.unit_hash("s")).orderBy("u", "vec_id").limit(3000).collect()]
    least = clustering.least_rows
    monkeypatch.setattr(clustering, "least_rows", lambda r, key, n: least(r, key, n, 100))  # the branch of large tables
    assert {r["vec_id"] for r in clustering.sample_exact(rows, 3000, "s").collect()} == set(whole)
    assert clustering.sample_exact(rows, 30_000, "s").count() == 20_000 and clustering.sample_exact(rows, 0, "s").count() == 0
    heavy = clustering.sample_exact(rows, 2000, "s", "w").groupBy("w").count().collect()
    share = {r["w"]: r["count"] for r in heavy}
    assert sum(share.values()) == 2000 and 0.0 not in share and 3 < share[4.0] / share[1.0] < 5
    assert clustering.sample_exact(rows.limit(0), 5, "s").count() == 0


def test_parallel_seeds_beat_the_first_members(spark, index):
    vectors = index[0]
    found, log = clustering.parallel_seeds(vectors, 20, 3)
    assert [k for k, _, _ in log] == [0, 1, 2, 3] and all(a[2] > b[2] for a, b in zip(log, log[1:], strict=False)) and found.count() == log[-1][1]
    fitted = clustering.fit_centroids(vectors, 16, DIMS, iterations=3, sample_rows=4000)
    first = vectors.orderBy("vec_id").limit(16).select((F.col("vec_id")).cast("int").alias("cluster_id"), "q")
    cost = lambda c: clustering.sse(clustering.assign_nearest(vectors, c)).first()["total"]
    assert fitted.count() <= 16 and cost(fitted) < 0.8 * cost(first)
    same = spark.createDataFrame([(i, 0, [1, 1]) for i in range(9)], "vec_id long, label int, q array<int>")
    assert clustering.fit_centroids(same, 4, 2).collect()[0]["q"] == [1, 1]


def test_uneven_trees_have_their_shape():
    for splits, depth in ((1, 1), (5, 5), (26, 26), (100, 9), (511, 26)):
        shape = tree.uneven_shape(splits, depth)
        leaves, levels, todo = [], 0, [(0, 1)]
        while todo:
            node, level = todo.pop()
            levels = max(levels, level)
            for child in shape[node]:
                leaves.append(-1 - child) if child < 0 else todo.append((child, level + 1))
        assert levels == depth and sorted(leaves) == list(range(splits + 1))


def test_pruned_scans_leave_blocks(spark, index):
    vectors, _, _, pages, boxes = index
    queries = vectors.where("vec_id % 1000 = 0").select(F.col("vec_id").alias("query_id"), "q")
    wanted = queries.crossJoin(spark.createDataFrame([(int(c),) for c in boxes.names], "cluster_id int")).withColumn("bound", F.lit(30_000_000).cast("long")).cache()
    a = blocks.prune_pages(wanted, pages, DIMS).select("query_id", "vec_id", "dist")
    b = blocks.scan_pages(wanted, pages, DIMS, None).select("query_id", "vec_id", "dist")
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0
    left = blocks.blocks_left(wanted, pages, DIMS).agg(F.sum("n_blocks"), F.sum("left_0"), F.sum("left_1"), F.sum("left_2")).first()
    assert left[0] > sum(left[1:]) > left[0] / 2 and left[1] > 0 and left[2] > 0


def test_pages_keep_scans_to_the_members_near_a_query(spark, index):
    vectors = index[0]
    few, many = vectors.where("vec_id < 2500"), vectors
    pairs = []
    for members in (few, many):
        pages = blocks.to_pages(members.select(F.lit(0).alias("cluster_id"), F.lit(0).alias("pos"), "vec_id", "label", "q")).cache()
        wanted = members.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "q", F.lit(0).alias("cluster_id"), F.lit(None).cast("long").alias("bound"))
        trees = blocks.PageTrees(pages)
        bounded = blocks.with_bounds(wanted, pages, trees, DIMS, 5).cache()
        assert pages.agg(F.sum("n")).first()[0] == members.count() and bounded.where("bound IS NULL").count() == 0
        pairs.append(blocks.paged(bounded, trees).join(pages.select("page", "n"), "page").agg(F.sum("n")).first()[0] / (bounded.count() * members.count()))
    assert pairs[1] < 0.9 * pairs[0] and pairs[1] < 0.75  # brute force has 1


def test_nearest_members_equal_brute_force_with_copies(spark, index, monkeypatch):
    monkeypatch.setattr(blocks, "PAGE_BLOCKS", 4)
    monkeypatch.setattr(blocks, "GROUP_PAGES", 2)
    monkeypatch.setattr(blocks, "SENT_BYTES", 0)
    one = index[0].where("vec_id < 1500").select("vec_id", "label", "q")
    members = one.unionByName(one.select((F.col("vec_id") + 10_000).alias("vec_id"), "label", "q")).unionByName(spark.range(20_000, 21_000).select(F.col("id").alias("vec_id"), F.lit(1).alias("label"), F.array(*[F.lit(5)] * DIMS).alias("q"))).cache()
    queries = members.where("vec_id % 100 = 0")
    found, want = blocks.nearest_members(queries, members, DIMS), knn.knn_exact(queries, members)
    assert found.count() == want.count() == 5 * queries.count() and found.exceptAll(want.select(found.columns)).count() == 0


def test_a_walk_carries_the_bound_and_sums_of_first_dimensions_keep_what_is_nearer(spark):
    rng = np.random.default_rng(5)
    m, q = rng.integers(0, 60, (blocks.LANES * 20 - 3, DIMS)), rng.integers(0, 60, (70, DIMS))
    padded = np.zeros((20 * blocks.LANES, DIMS), "<i4")
    padded[: len(m)] = m
    page = padded.reshape(-1, blocks.LANES, DIMS).transpose(0, 2, 1)
    d = ((q[:, None, :] - m[None, :, :]) ** 2).cumsum(axis=2)
    bound = np.sort(d[:, :, -1], axis=1)[:, 9]
    found = [x for part in blocks._held(page, np.arange(len(m)), np.full(len(q), -1), bound, q.astype(float)) for x in zip(*part, strict=True)]
    stops = [*blocks.STOPS, DIMS]
    want = {(i, j): sum(bool(d[i, j, s - 1] < bound[i]) for s in stops) for i, j in zip(*np.nonzero(d[:, :, stops[0] - 1] < bound[:, None]), strict=True)}
    assert {(i, j): h for i, j, _, h in found} == want and all(t == d[i, j, -1] for i, j, t, h in found if h == len(stops))
    box = boxtree.BoxTree(np.array([3]), np.zeros((1, 2)), np.zeros((1, 2)), np.ones((1, 2)))
    walked = boxtree.walk_within(spark.createDataFrame([(1, [4, 0], 10, None), (2, [4, 0], None, None), (3, [4, 0], 9, None)], "query_id long, q array<int>, bound long, done int"), box)
    assert {(r["query_id"], r["lb"], r["bound"]) for r in walked.collect()} == {(1, 9, 10), (2, 9, None)}


def _small_sheets(monkeypatch):
    for name, value in {"SHEET_ROWS": 100, "RUN_ROWS": 16, "RUNS": 2, "GROUP_ROWS": 64, "PART_ROWS": 10}.items():
        monkeypatch.setattr(sweeps, name, value)


def _never_paged(monkeypatch):
    """A row for each query and page is what fills the disk on larger tables."""
    monkeypatch.setattr(blocks, "paged", lambda *a, **k: pytest.fail("rows of queries and pages"))


def test_blocks_are_counted_without_rows_of_queries_and_pages(spark, index, monkeypatch):
    vectors, centroids, clusters, pages, boxes = index
    layout = ivf.member_layout(clustering.assign_nearest(vectors, centroids))
    bounded = vectors.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "q", (F.col("vec_id") * 9000).cast("long").alias("bound"), (F.col("vec_id") % 64).cast("int").alias("done")).cache()
    wanted = boxtree.walk_within(bounded, boxes).select("query_id", "q", "cluster_id", "bound").cache()
    want = blocks.blocks_left(wanted, pages, DIMS).cache()
    assert want.where("left_0 < n_blocks AND left_1 > 0 AND left_2 > 0").count() > 10
    _small_sheets(monkeypatch)
    _never_paged(monkeypatch)
    groups = sweeps.layout_groups(layout, clusters, DIMS).cache()
    assert groups.count() > clusters.count()  # clusters are cut
    found = sweeps.blocks_swept(bounded, groups, DIMS)
    assert found.count() == want.count() and found.exceptAll(want).count() == 0
    assert sweeps.blocks_swept(bounded.limit(0), groups, DIMS).count() == 0 == sweeps.blocks_swept(bounded, groups.limit(0), DIMS).count()


def test_sums_below_a_bound_without_rows_of_queries_and_pages(spark, index, monkeypatch):
    vectors, pages = index[0], index[3]
    far = vectors.where("vec_id < 900").withColumn("vec_id", F.col("vec_id") + (1 << 40))
    pages = pages.unionByName(blocks.to_pages(far.select(F.lit(99).alias("cluster_id"), F.lit(0).alias("pos"), "vec_id", "label", "q"))).cache()
    rows = vectors.unionByName(far).select("vec_id", "q").collect()
    ids, m = np.array([r["vec_id"] for r in rows]), np.array([r["q"] for r in rows], np.int64)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "q", F.lit(40_000_000).alias("bound"), F.lit(None).alias("done")).cache()
    want = {}
    for r in queries.collect():
        d = ((m - np.array(r["q"])) ** 2).sum(axis=1)
        near = (d < 40_000_000) & (ids != r["query_id"])
        if near.any():
            want[r["query_id"]] = int(near.sum()), int(ids[near].sum()), int(d[near].sum())
    _small_sheets(monkeypatch)
    _never_paged(monkeypatch)
    found = {r["query_id"]: (r["n"], r["ids"], r["dist"]) for r in sweeps.sums_below(queries, pages, DIMS).collect()}
    assert found == want and len(want) > 100


def test_pairs_of_clusters_are_formed_without_a_shuffle_of_queries(spark, index, monkeypatch):
    vectors, _, _, pages, boxes = index
    queries = vectors.where("vec_id % 400 = 0")
    wanted = ivf.probes(ivf.centroid_distances(queries, boxes), 2).select("query_id", "q", "cluster_id").cache()
    members = pages.selectExpr("cluster_id", "explode(ids) AS vec_id").join(vectors, "vec_id")
    want = ivf.scan(wanted, members, DIMS).select("query_id", "vec_id", "dist").cache()
    _small_sheets(monkeypatch)
    monkeypatch.setattr(blocks, "dealt", lambda *a, **k: pytest.fail("blocks of queries joined to pages"))
    found = sweeps.pairs_of_clusters(wanted, pages, DIMS)
    assert found.count() == want.count() > 1000 and found.exceptAll(want).count() == 0
