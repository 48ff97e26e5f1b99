"""SimHash near-dedup with a Gray-order hierarchical index.

1. ``fingerprints`` makes 64-bit SimHashes of word shingles, in Arrow batches, from whole texts.
2. Equal fingerprints are one code (with ``verify``, if the shingle sets are equal too; else they are candidates). Two codes at distance ``limit`` or less agree on at least one of ``limit + 1`` bit
   segments, so every code enters one top node per segment: (mask, code & mask). A top node with more than ``node_rows``
   codes is refined exactly: its free bits are cut into ``limit + 1`` segments again, of which one must agree once more.
   So no node is unbounded, whatever the data, and no pair is lost. For a limit over EXACT_LIMIT, segments would be too
   short to tell codes apart; then the masks are random bit sets, as many as a recall of ``recall`` at the limit takes
   (nearer codes have more), and a node that is too large is cut into blocks, of which each two meet in a task, so it
   loses no pair. Their number follows the table's size slowly: 40 up to 2**26 codes, about 115 at 2**30.
3. Top nodes deal the codes to tasks. What a task holds of a mask's nodes is one binary hierarchy over their Gray order, the mask's bits first: every
   inner node keeps the bits all its codes share (mask and pattern), children only what their parent lacks. A search goes down with accumulated
   differences and drops a whole subtree when they exceed the limit; nothing else compares codes.
4. Each hierarchy emits a spanning forest of its links, not all pairs; connected components come from alternating large-star
   and small-star joins in checkpointed rounds. Documents join their code's class by ``common.lookup``.
5. Where links must hold for the texts as well (``verify``), every pair within the limit is a candidate, and only verified
   links take candidates away. Two rounds verify each code's nearest candidates by a join with exact shingle sets. Codes
   that still have a candidate which no verified link connects meet in a last search together with their sets, in blocks
   of a bounded number of shingles; it verifies in the task and emits a spanning forest of what holds. So no plan ever has
   a row for a pair beyond the four nearest, and nothing is left unverified. From the second round on, pairs are passed
   over that cannot share enough, as the counts of their shingles in ranges of hashes differ by too much: a bound, not an
   estimate. A group of many texts that are alike, but less than asked, costs its tasks time in proportion to its pairs.
6. With ``verify`` a document is a row: rows that repeat a doc_id, or have none, are told apart by ``common.with_row_id``,
   and one row of each class is marked as kept.

Defined results: a text with fewer words than a shingle is one shingle, without words (null, empty, blank) its
fingerprint is zero and links like any other; repeated rows have equal fingerprints and appear once each; null doc_ids
never name a component unless it has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import BROADCAST_BYTES, bounded, free_name, lookup, remove_table, with_row_id, write_table
from riskloom.llm.lm_scoring import _mix

BITS = 64
LEAF = 16
#: Up to this limit top nodes are segments, and no link is lost; above it they are random masks with a stated recall.
EXACT_LIMIT = 3
#: How many of a code's candidates, nearest first, a round verifies if they are still apart; the first round knows no bins.
ROUNDS = (1, 4)
#: Shingles of the sets of one block of the last search, on average (32 MB).
BLOCK_SHINGLES = 1 << 22
#: Ranges of hashes in which shingles are counted, a power of two.
BINS = 256


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of the XXH64 (seed 42) of all word shingles, repeats included; unsigned."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    n = len(tokens)
    if not n:
        return 0
    if n <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), 42)
    whole = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(whole[a:b], 42) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], "<u8")
        bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(parts):
            found = np.array([fingerprint(x, words) for x in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


def gray_rank(code: Column) -> Column:
    """The place of a code in the reflected Gray sequence, as an unsigned number in a signed long's order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segments(free: list[int], parts: int) -> list[int]:
    """Masks (signed) that cut the free bit positions into that many nearly equal runs."""
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [_signed(sum(1 << b for b in free[a:z])) for a, z in zip(cuts, cuts[1:], strict=False)]


def _free(mask: int) -> list[int]:
    return [b for b in range(BITS) if not mask >> b & 1]


def table_masks(n: int, limit: int, recall: float = 0.92, seed: int = 11) -> list[int]:
    """Masks (signed) of bits, on one of which two codes at distance ``limit`` agree with that probability; nearer ones with a higher one.

    A mask has 12 bits, or more once a node would hold over 16,384 of n unrelated codes; the number of masks follows. They
    are runs of random permutations of the bits, so masks of one permutation do not overlap.
    """
    rng = random.Random(seed)
    size = min(40, max(12, round(math.log2(max(2, n))) - 14))
    agree = math.prod((BITS - size - i) / (BITS - i) for i in range(limit))
    out: list[int] = []
    while len(out) < math.ceil(math.log(1 - recall) / math.log(1 - agree)):
        order = rng.sample(range(BITS), BITS)
        out += [_signed(sum(1 << b for b in order[k : k + size])) for k in range(0, BITS - size + 1, size)]
    return out


def top_nodes(codes: DataFrame, limit: int, node_rows: int) -> DataFrame:
    """(mask, value, the columns of codes, task, side): every code in its top nodes, none of which holds more than node_rows codes, or twice as many in a task of ``in_blocks``."""
    parts = limit + 1
    level = _segments(list(range(BITS)), parts) if limit <= EXACT_LIMIT else table_masks(codes.count(), limit)
    whole = [F.lit(0).cast("long").alias("task"), F.lit(0).cast("long").alias("side")]
    nodes = codes.select(*codes.columns, F.explode(F.array(*[F.lit(m).cast("long") for m in level])).alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), *codes.columns)
    if limit > EXACT_LIMIT:
        return in_blocks(nodes, F.lit(1), node_rows)
    done = []
    while True:
        nodes = write_table(nodes, "simhash-nodes")
        large = nodes.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > node_rows)
        large = write_table(large, "simhash-large")
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]  # one of a fixed set per level
        if not masks:
            return _union([*done, nodes]).select("*", *whole)
        done.append(nodes.join(large, ["mask", "value"], "left_anti"))
        children = [(m, _signed((m | c) & (2**64 - 1))) for m in masks for c in _segments(_free(m), parts)]
        cuts = F.broadcast(codes.sparkSession.createDataFrame(children, "mask bigint, child bigint"))
        hot = nodes.join(large.select("mask", "value"), ["mask", "value"], "left_semi")
        nodes = hot.join(cuts, "mask").select(*codes.columns, F.col("child").alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), *codes.columns).distinct()


def in_blocks(nodes: DataFrame, weight: Column, most: int) -> DataFrame:
    """nodes with task and side: the codes of a node that weighs over ``most`` fall into blocks by hash, and each two blocks, and each one, meet in a task; no pair is lost."""
    large = write_table(nodes.groupBy("mask", "value").agg(F.sum(weight).alias("n")).where(F.col("n") > most), "simhash-large")
    large = F.broadcast(large) if large.count() * 32 <= BROADCAST_BYTES else large
    own = nodes.join(large, ["mask", "value"], "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / most))
    own = own.withColumn("side", F.pmod(F.xxhash64("fp", *[c for c in ("unit",) if c in nodes.columns]), F.col("blocks")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    task = F.shiftleft(F.least("side", "other"), 31) + F.greatest("side", "other")
    return met.select(*nodes.columns, task.alias("task"), "side")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


class GrayTree:
    """A binary hierarchy over codes in Gray order; inner nodes hold shared masked bit patterns."""

    def __init__(self, codes: np.ndarray):
        n = max(1, -(-len(codes) // LEAF))
        width = 1 << (n - 1).bit_length()
        padded = np.full(width * LEAF, codes[-1], np.uint64)
        padded[: len(codes)] = codes
        self.codes, self.size = padded.reshape(width, LEAF), len(codes)
        ones, some = [np.bitwise_and.reduce(self.codes, 1)], [np.bitwise_or.reduce(self.codes, 1)]
        while len(ones[0]) > 1:
            ones.insert(0, ones[0][0::2] & ones[0][1::2])
            some.insert(0, some[0][0::2] | some[0][1::2])
        self.shared = [~(a ^ o) for a, o in zip(ones, some, strict=True)]
        self.pattern = ones
        self.own = [self.shared[0]] + [s & ~np.repeat(p, 2) for p, s in zip(self.shared, self.shared[1:], strict=False)]

    def pairs(self, limit: int, block: int = 512, fixed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j), i < j, of codes at distance limit or less that agree on the bits of ``fixed``; all of an i at once.

        ``dropped`` counts the subtrees that are left because what differs above them, or a fixed bit, is already too much; ``compared`` the codes that are looked at.
        """
        flat, fixed_, self.dropped = self.codes.reshape(-1), np.uint64(fixed), 0
        self.compared = 0

        def differing(x: np.ndarray) -> np.ndarray:
            n = np.bitwise_count(x).astype(np.int64)
            return n + (limit + 1) * ((x & fixed_) != 0) if fixed else n

        for at in range(0, self.size, block):
            query = np.arange(at, min(at + block, self.size))
            node = np.zeros(len(query), np.int64)
            apart = differing((flat[query] ^ self.pattern[0][0]) & self.own[0][0])
            for k in range(1, len(self.own)):
                keep = apart <= limit
                self.dropped += int((~keep).sum())
                query, apart = np.repeat(query[keep], 2), np.repeat(apart[keep], 2)
                node = np.repeat(node[keep] * 2, 2)
                node[1::2] += 1
                later = (node + 1) * (LEAF << (len(self.own) - 1 - k)) > query  # only codes after the query
                query, node, apart = query[later], node[later], apart[later]
                apart = apart + differing((flat[query] ^ self.pattern[k][node]) & self.own[k][node])
            keep = apart <= limit
            self.dropped += int((~keep).sum())
            query, node = query[keep], node[keep]
            near = differing(flat[query][:, None] ^ self.codes[node]) <= limit
            self.compared += near.size
            q, c = np.nonzero(near)
            i, j = query[q], node[q] * LEAF + c
            real = (j > i) & (j < self.size)
            yield i[real], j[real]


def _mask_first(codes: np.ndarray, mask: int) -> tuple[np.ndarray, int]:
    """codes with the bits of mask moved to the top, and those bits there."""
    order = [b for b in range(BITS) if not mask >> b & 1] + [b for b in range(BITS) if mask >> b & 1]
    out = np.zeros(len(codes), np.uint64)
    for place, b in enumerate(order):
        out |= (codes >> np.uint64(b) & np.uint64(1)) << np.uint64(place)
    n = bin(mask & (2**64 - 1)).count("1")
    return out, (2**64 - 1) ^ (2 ** (64 - n) - 1)


def gray_order(codes: np.ndarray) -> np.ndarray:
    """The order of codes by Gray rank."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return np.argsort(rank, kind="stable")


def hierarchies(codes: np.ndarray, mask: np.ndarray) -> Iterator[tuple[np.ndarray, GrayTree, int]]:
    """(positions, hierarchy, the mask's bits in it) of the codes of each mask: all that a task holds of its nodes, in one Gray order, the mask's bits first."""
    for m in np.unique(mask).tolist():
        rows = np.nonzero(mask == m)[0]
        moved, fixed = _mask_first(codes[rows], m)
        order = gray_order(moved)
        yield rows[order], GrayTree(moved[order]), fixed


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n positions the smallest position of its component under the links (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        for at in (label[i], label[j], i, j):
            np.minimum.at(label, at, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _tree_links(tree: GrayTree, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as positions (i, j), of all links within a hierarchy."""
    label = np.arange(tree.size)
    for i, j in tree.pairs(limit):  # only the forest is kept from block to block
        linked = np.nonzero(label != np.arange(tree.size))[0]
        label = _forest(tree.size, np.concatenate([i, linked]), np.concatenate([j, label[linked]]))
    linked = np.nonzero(label != np.arange(tree.size))[0]
    return linked, label[linked]


def _dealt(nodes: DataFrame) -> DataFrame:
    """Rows of nodes, dealt by node and in Gray order."""
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return nodes.repartition(parts, "mask", "value", "task").withColumn("rank", gray_rank(F.col("fp"))).sortWithinPartitions("mask", "value", "task", "rank").drop("rank")


def _whole_nodes(parts: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole nodes, which the first ``keys`` columns name, and where their nodes start."""
    held: list[pa.RecordBatch] = []
    last = None
    for part in parts:
        if not part.num_rows:
            continue
        names = np.column_stack([part.column(k).to_numpy() for k in range(keys)])
        edge = np.nonzero((names[1:] != names[:-1]).any(axis=1))[0] + 1
        cut = int(edge[-1]) if len(edge) else 0
        if last is not None and (names[0] != last).any() and not cut:
            yield _started(held, keys)
            held = []
        if cut:
            yield _started([*held, part.slice(0, cut)], keys)
            held = []
        held.append(part.slice(cut))
        last = names[-1]
    if held:
        yield _started(held, keys)


def _started(parts: list[pa.RecordBatch], keys: int) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(parts)
    names = np.column_stack([table.column(k).to_numpy() for k in range(keys)])
    return table, np.concatenate(([0], np.nonzero((names[1:] != names[:-1]).any(axis=1))[0] + 1))


def _node_pairs(codes: np.ndarray, mask: np.ndarray, starts: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of codes of one node at distance limit or less, each pair once, all pairs of an i at once."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    for rows, tree, fixed in hierarchies(codes, mask):
        for i, j in tree.pairs(limit, fixed=fixed):
            i, j = rows[i], rows[j]
            same = group[i] == group[j]
            yield i[same], j[same]


def links(codes: DataFrame, limit: int = 2, node_rows: int = 4096) -> DataFrame:
    """(a, b): a spanning forest, per hierarchy, of the links between codes; a > b as signed longs.

    Nodes deal the work, so that each linked pair meets in some task; what a task holds of a mask is one hierarchy, which is searched without regard to nodes.
    """
    dealt = _dealt(top_nodes(codes, limit, node_rows).select("mask", "value", "task", "fp"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in _whole_nodes(parts, 3):
            own = table.column(3).to_numpy().view(np.uint64)
            for rows, tree, _ in hierarchies(own, table.column(0).to_numpy()):
                i, j = _tree_links(tree, limit)
                a, b = own[rows[i]].view(np.int64), own[rows[j]].view(np.int64)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


def _open_pairs(table: pa.Table, starts: np.ndarray, limit: int, least: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, rank) of a table of ``candidates``: pairs that meet in this task and can hold, nearest first for each i."""
    mask, task, side, codes = (table.column(k).to_numpy() for k in (0, 2, 3, 4))
    codes = codes.view(np.uint64)
    single = task >> 31 == task & ((1 << 31) - 1)
    if least is not None:
        size = table.column(7).to_numpy()
        counts = np.frombuffer(b"".join(table.column(8).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)
        share = (1 - least) / (1 + least)
    for i, j in _node_pairs(codes, mask, starts, limit):
        meet = single[i] | (side[i] != side[j])
        i, j = i[meet], j[meet]
        if least is not None:
            able = np.zeros(len(i), bool)
            for at in range(0, len(i), 1 << 14):
                p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                able[at : at + (1 << 14)] = np.abs(counts[p] - counts[q]).sum(axis=1, dtype=np.int64) <= share * (size[p] + size[q]) + 1e-6
            i, j = i[able], j[able]
        order = np.lexsort((j, np.bitwise_count(codes[i] ^ codes[j]), i))
        i, j = i[order], j[order]
        yield i, j, np.arange(len(i)) - np.searchsorted(i, i)


def _columns(least: float | None) -> list[str]:
    return ["mask", "value", "task", "side", "fp", "unit", "root", *(["size", "bins"] if least is not None else [])]


def candidates(nodes: DataFrame, limit: int, end: int, least: float | None) -> DataFrame:
    """(a, b, nulls): pairs of units of one node, at distance limit or less, whose roots differ; (nulls, mask, value, task, side, fp, unit): the units of each node with more.

    nodes: mask, value, task, side, fp, unit, root, and with ``least`` size and bins. Of a unit's pairs with later ones, the ``end`` nearest are taken; both units of every other pair
    are named, so that a next round needs no other rows of the node.
    With ``least`` only pairs count that can share it: two sets differ in as many shingles at least as the counts of their bins do.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_nodes(parts, 3):
            unit, root = (table.column(k).to_numpy() for k in (5, 6))
            more = np.zeros(len(unit), bool)
            for i, j, rank in _open_pairs(table, starts, limit, least):
                apart = root[i] != root[j]
                later = apart & (rank >= end)
                more[i[later]] = more[j[later]] = True
                apart &= rank < end
                a, b = unit[i[apart]], unit[j[apart]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), *[pa.nulls(len(a), pa.int64())] * 6], ["a", "b", *names])
            for at in range(0, int(more.sum()), 1 << 17):
                some = pa.array(np.nonzero(more)[0][at : at + (1 << 17)])
                own = [table.column(k).take(some).combine_chunks() for k in range(6)]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some), pa.int64())] * 2, *own], ["a", "b", *names])

    names = _columns(None)[:6]
    return _dealt(nodes.select(*_columns(least))).mapInArrow(run, ", ".join(f"{c} bigint" for c in ("a", "b", *names)))


def still_open(nodes: DataFrame, limit: int, least: float) -> DataFrame:
    """(mask, value, unit): the units of a node that have a candidate of another root; nodes as of ``candidates``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_nodes(parts, 3):
            mask, value, unit, root = (table.column(k).to_numpy() for k in (0, 1, 5, 6))
            mine = np.zeros(len(unit), bool)
            for i, j, _ in _open_pairs(table, starts, limit, least):
                apart = root[i] != root[j]
                mine[i[apart]] = mine[j[apart]] = True
            if mine.any():
                yield pa.RecordBatch.from_arrays([pa.array(mask[mine]), pa.array(value[mine]), pa.array(unit[mine])], ["mask", "value", "unit"])

    return _dealt(nodes.select(*_columns(least))).mapInArrow(run, "mask bigint, value bigint, unit bigint").distinct()


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # two sorted runs
    return int((both[1:] == both[:-1]).sum())


def verified_forests(nodes: DataFrame, limit: int, least: float) -> DataFrame:
    """(a, b): links that hold, as few as connect what they connect; nodes as of ``candidates`` with the set s of each unit."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_nodes(parts, 3):
            unit, sets = table.column(5).to_numpy(), table.column(9).combine_chunks()
            ends, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
            _, label = np.unique(table.column(6).to_numpy(), return_inverse=True)
            a, b = [], []
            for i, j, _ in _open_pairs(table, starts, limit, least):
                for at in range(0, len(i), 4096):
                    p, q = i[at : at + 4096], j[at : at + 4096]
                    apart = label[p] != label[q]
                    for x, y in zip(p[apart].tolist(), q[apart].tolist(), strict=True):
                        if label[x] == label[y]:
                            continue
                        one, two = values[ends[x] : ends[x + 1]], values[ends[y] : ends[y + 1]]
                        n = len(one) + len(two)
                        if min(len(one), len(two)) >= least * (n / (1 + least)) - 1e-6 and (s := _shared(one, two)) >= least * (n - s):
                            label[label == label[y]] = label[x]
                            a.append(unit[x])
                            b.append(unit[y])
            if a:
                a_, b_ = np.array(a), np.array(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a_, b_)), pa.array(np.minimum(a_, b_))], ["a", "b"])

    return _dealt(nodes.select(*_columns(least), "s")).mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node of edges but the smallest of its component, with that smallest one.

    Alternating large-star and small-star rounds, each written to a table. The first joins every neighbour with the least
    neighbour of its node; as one node may have most of all neighbours, that is a ``lookup``. In the second no node
    has more than a few smaller neighbours.
    """
    edges = write_table(edges.select("a", "b"), "links")
    now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.count("*").alias("n"), F.least(F.min("b"), F.col("a")).alias("m"))
        low = write_table(low.withColumn("part", F.pmod("a", F.lit(1 << 30))), "links-least")
        later = both.where("b > a").select(F.pmod("a", F.lit(1 << 30)).alias("part"), "a", "b")
        large = lookup(later, low, ["part", "a"], 2 * now[0], 48, "inner", F.xxhash64("b"))
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = write_table(small, "links")
        remove_table(edges)
        remove_table(low)
        edges, seen = after, now
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
    return edges


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of all shingles of a text; of fewer words, of the whole sequence; of none, nothing."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(tokens) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), 43)] if tokens else [], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = len(tokens) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = _mix(out + np.uint64(0x9E3779B97F4A7C15)) + each[k : k + n]
    return np.unique(_mix(out))


def unit_of(fp: int, shingles: np.ndarray) -> int:
    """The unit, a signed long, of texts with this fingerprint and these distinct shingles."""
    return _signed(xxhash.xxh3_64_intdigest(shingles.tobytes(), fp))


def units(docs: DataFrame, words: int, verify_words: int) -> DataFrame:
    """(row_id, doc_id, fp, unit, size, bins): the number of a text's shingles, and how many, to 255, fall into each of BINS ranges of hashes."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("row_id", "doc_id")}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(parts):
            fps, found, sizes, bins = [], [], [], []
            for text in part.column(2).to_pylist():
                fp, own = fingerprint(text, words), shingle_set(text, verify_words)
                fps.append(_signed(fp))
                found.append(unit_of(fp, own))
                bins.append(np.bincount((own >> np.uint64(65 - BINS.bit_length())).astype(np.int64), minlength=BINS).clip(max=255).astype(np.uint8).tobytes())
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps, pa.int64()), pa.array(found, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bins, pa.binary())], ["row_id", "doc_id", "fp", "unit", "size", "bins"])

    return docs.select("row_id", "doc_id", "text").mapInArrow(run, f"row_id {kinds['row_id']}, doc_id {kinds['doc_id']}, fp bigint, unit bigint, size bigint, bins binary")


def linked_sets(wanted: DataFrame, docs: DataFrame, words: int, verify_words: int) -> DataFrame:
    """(unit, s): the distinct shingle hashes of the wanted units (unit, row: one of its rows); only those rows are read with their text."""
    ids = write_table(wanted.select(F.col("row").alias("_row")), "linked")
    some = F.broadcast(ids) if ids.count() * 48 <= BROADCAST_BYTES else ids

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(parts):
            texts = part.column(0).to_pylist()
            sets = [shingle_set(x, verify_words) for x in texts]
            found = [unit_of(fingerprint(x, words), s) for x, s in zip(texts, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["unit", "s"])

    rows = docs.join(some, F.col("row_id") == F.col("_row")).select("text")
    return write_table(rows.mapInArrow(run, "unit bigint, s array<bigint>"), "linked-shingles")


def verified(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """edges without those whose sets share less than ``least`` of their union."""
    both = edges.join(sets.select(F.col("unit").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("unit").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= least * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def verified_components(own: DataFrame, docs: DataFrame, limit: int, node_rows: int, words: int, verify_words: int, least: float) -> DataFrame:
    """(a, b): the components, as of ``components``, of the units of own (unit, fp, row, size, bins) over all links that hold by ``verified``."""
    nodes = write_table(top_nodes(own.select("fp", "unit"), limit, node_rows), "simhash-units")
    stars = sets = tried = None

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(own.select("unit", "size", "bins"), "unit").join(stars.select(F.col("a").alias("unit"), F.col("b").alias("root")), "unit", "left").withColumn("root", F.coalesce("root", "unit"))

    def known(ends: DataFrame) -> DataFrame:
        """The sets known so far and those of the units in ends."""
        more = ends if sets is None else ends.join(sets.select("unit"), "unit", "left_anti")
        more = linked_sets(write_table(more.join(own.select("unit", "row"), "unit"), "linked-units"), docs, words, verify_words)
        return more if sets is None else sets.unionByName(more)

    for k, end in enumerate(ROUNDS):
        rows = nodes.withColumn("root", F.col("unit")) if stars is None else rooted(nodes)
        found = write_table(candidates(rows, limit, end, least if k else None), "links")
        pairs = found.where("a IS NOT NULL").select("a", "b").distinct()
        pairs = write_table(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "links-apart")
        sets = known(pairs.select(F.col("a").alias("unit")).unionByName(pairs.select(F.col("b").alias("unit"))).distinct())
        tried = pairs if tried is None else tried.unionByName(pairs)
        good = verified(pairs, sets, least)
        stars = components(good if stars is None else stars.unionByName(good))
        after = write_table(found.where("mask IS NOT NULL").select(nodes.columns), "simhash-units")
        remove_table(nodes)
        nodes = after
        if not nodes.limit(1).count():
            return stars
    left = write_table(still_open(rooted(nodes), limit, least), "simhash-open")
    if not left.limit(1).count():
        return stars
    sets = known(left.select("unit").distinct())
    rows = left.join(own.select("unit", "fp", "size"), "unit").select("mask", "value", "fp", "unit", "size")
    blocks = rooted(write_table(in_blocks(rows, F.col("size") + 16, BLOCK_SHINGLES), "simhash-blocks").drop("size"))
    return components(stars.unionByName(verified_forests(blocks.join(sets, "unit"), limit, least)))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, limit: int = 2, node_rows: int = 4096, verify: float | None = None, verify_words: int = 5, row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable over links).

    With ``verify``, links between documents that share less of their distinct shingles of ``verify_words`` words are dropped,
    the rest connects only what real links connect, and there are two more columns: row_id (the values of ``row_col``, which
    must tell rows apart; without it, of ``with_row_id``) and kept, true for one row of each class.
    """
    if verify is None:
        marked = write_table(fingerprints(docs, id_col, text_col, words).withColumn("unit", F.col("fp")), "fingerprints")
        own = write_table(marked.groupBy("unit").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.lit(0).alias("row")), "codes")
        stars = components(links(own.select(F.col("unit").alias("fp")), limit, node_rows))
    else:
        row = row_col or free_name(docs, "row_id")
        docs = docs if row_col else with_row_id(docs, row)
        texts = docs.select(F.col(row).alias("row_id"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        marked = write_table(units(texts, words, verify_words), "fingerprints")
        # texts of one unit have one fingerprint and one set of shingles
        first = [F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min("row_id").alias("row"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("bins").alias("bins")]
        own = write_table(marked.groupBy("unit").agg(*first), "codes")
        stars = verified_components(own, texts, limit, node_rows, words, verify_words, verify)
    part = lambda c: F.pmod(c, F.lit(1 << 30)).alias("part")
    # the least doc_id and row of each class of several units; one unit may be the root of most
    rooted = stars.select(F.col("a").alias("unit"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("unit"), F.col("b").alias("root")).distinct())
    rooted = write_table(rooted.join(own.select("unit", "n", "first", "row"), "unit").withColumn("part", part("root")), "rooted")
    least = rooted.groupBy("part", "root").agg(F.count("*").alias("n"), F.min("first").alias("component_id"), F.min("row").alias("kept_row"))
    named = lookup(rooted.select("part", "root", "unit"), write_table(least, "classes"), ["part", "root"], rooted.count(), 64, "left", F.xxhash64("unit"))
    named = own.select("unit", "n", "first", "row").join(named.select("unit", "component_id", "kept_row"), "unit", "left")
    classes = named.select(part("unit"), "unit", "n", F.when(F.col("kept_row").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("kept_row", "row").alias("kept_row"))
    more = [] if verify is None else ["row_id"]
    keyed = marked.select(part("unit"), "unit", "fp", "doc_id", *more)
    out = lookup(keyed, write_table(classes, "classes"), ["part", "unit"], marked.count(), 64, "left", F.xxhash64("doc_id", *more))
    return out.select("doc_id", "fp", "component_id", *more, *([] if verify is None else [(F.col("row_id") == F.col("kept_row")).alias("kept")]))


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
