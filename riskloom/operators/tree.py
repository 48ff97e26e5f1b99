"""Decision-tree tables and their inference as Spark plans.

A tree is a table nodes(node_id, feat, thr, left, right): a row goes left if q[feat] <= thr; a negative child is leaf -1 - child.
Trees are small (``MAX_NODES``); they become one generated expression, or, where that would be too large a method, a fold
over the tree's levels that looks up the next node in arrays: as many steps for a row as the tree is deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import bitset_popcount

MAX_NODES = 1 << 14
#: Splits up to which a tree becomes one expression.
MAX_CASES = 256
NODES = "node_id int, feat int, thr int, left int, right int"
LEAST, MOST = -(1 << 31), (1 << 31) - 1


def leaf_of(child: Column) -> Column:
    return -1 - child


def balanced_tree(spark: SparkSession, feats: list[int], thresholds: list[int]) -> DataFrame:
    """A complete tree in heap order: node i splits q[feats[i]] at thresholds[i]; len(feats) is 2**d - 1."""
    n = len(feats)
    if n + 1 & n:
        raise ValueError("a complete tree has 2**d - 1 splits")
    child = lambda c: c if c < n else -1 - (c - n)
    return spark.createDataFrame([(i, feats[i], thresholds[i], child(2 * i + 1), child(2 * i + 2)) for i in range(n)], NODES)


def uneven_shape(splits: int, depth: int) -> list[tuple[int, int]]:
    """(left, right) of each node of a tree with that many splits and that depth: a spine of right children, whose left children are complete trees, as large as is left."""
    out: list[list[int]] = [[0, 0] for _ in range(splits)]
    leaves, free = 0, depth

    def child(todo: list[int], node: int, side: int, more: int) -> int:
        nonlocal leaves, free
        if more and free < splits:
            out[node][side] = free
            todo.append(free)
            free += 1
        else:
            out[node][side] = -1 - leaves
            leaves += 1
        return free

    for node in range(depth):
        if node + 1 < depth:
            out[node][1] = node + 1
        else:
            child([], node, 1, 0)
        level: list[int] = []
        child(level, node, 0, depth - 1 - node)
        below = depth - 2 - node
        while level:
            after: list[int] = []
            for x in level:
                child(after, x, 0, below)
                child(after, x, 1, below)
            level, below = after, below - 1
    return [(a, b) for a, b in out]


def quantile_tree(rows: DataFrame, dims: int, splits: int = 511, depth: int = 26) -> DataFrame:
    """nodes of an uneven tree whose thresholds come from the rows: node i splits feature (5i + 3) % dims at one of its 97-quantiles, the (37i % 97)-th."""
    shape = uneven_shape(splits, depth)
    wanted = sorted({((5 * i + 3) % dims, 37 * i % 97) for i in range(splits)})
    each = rows.select(F.posexplode("q").alias("feat", "x")).groupBy("feat", "x").agg(F.count("*").alias("n"))  # as many rows as codes
    total = F.sum("n").over(Window.partitionBy("feat"))
    upto = F.sum("n").over(Window.partitionBy("feat").orderBy("x"))
    placed = each.withColumn("upto", upto).withColumn("total", total)
    asks = rows.sparkSession.createDataFrame(wanted, "feat int, part int")
    least = placed.join(F.broadcast(asks), "feat").where(F.col("upto") * 97 >= F.greatest(F.col("part") * F.col("total"), F.lit(1))).groupBy("feat", "part").agg(F.min("x").alias("thr"))
    nodes = [(i, (5 * i + 3) % dims, 37 * i % 97, a, b) for i, (a, b) in enumerate(shape)]
    table = rows.sparkSession.createDataFrame(nodes, "node_id int, feat int, part int, left int, right int")
    return table.join(F.broadcast(least), ["feat", "part"]).select("node_id", "feat", "thr", "left", "right")


def rows_of(nodes: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    rows = nodes.select("node_id", "feat", "thr", "left", "right").limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} splits")
    return {r["node_id"]: (r["feat"], r["thr"], r["left"], r["right"]) for r in rows}


def leaf_boxes(nodes: DataFrame, dims: int) -> DataFrame:
    """(leaf_id, low, high): leaf_id holds exactly the rows with low[i] < q[i] <= high[i] for all i."""
    table, out = rows_of(nodes), []
    todo = [(0, [LEAST] * dims, [MOST] * dims)]
    while todo:
        at, low, high = todo.pop()
        if at < 0:
            out.append((-1 - at, low, high))
            continue
        feat, thr, left, right = table[at]
        todo.append((left, low, [min(x, thr) if i == feat else x for i, x in enumerate(high)]))
        todo.append((right, [max(x, thr) if i == feat else x for i, x in enumerate(low)], high))
    return nodes.sparkSession.createDataFrame(sorted(out), "leaf_id int, low array<int>, high array<int>")


def predict(rows: DataFrame, nodes: DataFrame, q: str = "q") -> DataFrame:
    """rows with leaf_id."""
    table = rows_of(nodes)
    if len(table) <= MAX_CASES:

        def at(k: int) -> Column:
            if k < 0:
                return F.lit(-1 - k)
            feat, thr, left, right = table[k]
            return F.when(F.get(q, feat) <= thr, at(left)).otherwise(at(right))

        return rows.withColumn("leaf_id", at(0))
    order = sorted(table)
    place = {n: i for i, n in enumerate(order)}
    column = lambda k: F.array(*[F.lit(table[n][k] if k < 2 or table[n][k] < 0 else place[table[n][k]]) for n in order])

    def depth(levels: list[int]) -> int:
        below = [c for n in levels for c in table[n][2:] if c >= 0]
        return 1 + (depth(below) if below else 0)

    feats, thresholds, lefts, rights = (column(k) for k in range(4))
    step = lambda at, _: F.when(at < 0, at).when(F.get(F.col(q), F.get(feats, at)) <= F.get(thresholds, at), F.get(lefts, at)).otherwise(F.get(rights, at))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(depth([0]))), F.lit(place[0]), step)
    return rows.withColumn("leaf_id", -1 - walk)


def predict_boxes(rows: DataFrame, nodes: DataFrame, dims: int = 14, q: str = "q") -> DataFrame:
    """rows with leaf_id, by a range join with the leaves' boxes."""
    inside = F.lit(True)
    for i in range(dims):
        inside = inside & (F.get(q, i) > F.get("low", i)) & (F.get(q, i) <= F.get("high", i))
    return rows.join(F.broadcast(leaf_boxes(nodes, dims)), inside).drop("low", "high")


def fit_tree(rows: DataFrame, label: str = "label", depth: int = 6, seed: int = 7) -> DataFrame:
    """nodes of a tree fitted on q; thresholds are rounded down to codes, which splits whole numbers alike."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.transform("q", lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    model = DecisionTreeClassifier(maxDepth=depth, seed=seed).fit(data)
    out: list[list[int]] = []
    leaves = 0

    def walk(node) -> int:  # noqa: ANN001
        nonlocal leaves
        if node.subtreeDepth() == 0:
            leaves += 1
            return -leaves
        split = node.split()
        mine = [len(out), int(split.featureIndex()), int(split.threshold() // 1), 0, 0]
        out.append(mine)
        mine[3], mine[4] = walk(node.leftChild()), walk(node.rightChild())
        return mine[0]

    walk(model._java_obj.rootNode())
    return rows.sparkSession.createDataFrame([tuple(x) for x in out], NODES)


def leaf_statistics(scored: DataFrame, parts: int = 256) -> DataFrame:
    """leaves(leaf_id, count, purity_milli, part_bitset) from training rows (leaf_id, n, part).

    count: the most frequent n, the smaller of equals; purity_milli: its share in thousandths; part_bitset: which parts (0..255) the rows come from.
    """
    each = scored.groupBy("leaf_id", "n").agg(F.count("*").alias("c"))
    best = each.groupBy("leaf_id").agg(F.max_by("n", F.struct("c", -F.col("n"))).alias("count"), F.max("c").alias("top"), F.sum("c").alias("all"))
    words = [F.bit_or(F.when(F.floor(F.col("part") / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("part") % 64).cast("int"))).otherwise(F.lit(0).cast("long"))) for w in range(parts // 64)]
    bits = scored.groupBy("leaf_id").agg(F.array(*words).alias("part_bitset"))
    return best.join(bits, "leaf_id").select("leaf_id", "count", F.floor(F.col("top") * 1000 / F.col("all")).cast("int").alias("purity_milli"), "part_bitset")


def leaf_lookup(predicted: DataFrame, leaves: DataFrame) -> DataFrame:
    """predicted with its leaf's columns; leaves are bounded by the tree."""
    return predicted.join(F.broadcast(leaves), "leaf_id", "left")


def partition_count(leaves: DataFrame) -> DataFrame:
    return leaves.withColumn("n_parts", bitset_popcount(F.col("part_bitset")))
