"""Classes of documents under Jaccard links of word shingles, by a size-aware heavy-light join.

Sets that are equal are one row. Two sets of sizes a and b link when they share c(a, b) = ceil(p (a + b) / (100 + p)) shingles at least (p: percent).

1. ``light`` sets are small: each enumerates, for each size b that it may link to, its subsets of exactly c(a, b) shingles. Sets of both sizes that have
   one subset in common share c(a, b) and so are linked, by definition: a group of equal subsets needs no comparison and gives a star.
2. ``heavy`` sets scan inverted lists. Linked sets have a shingle in common among the floor((100 - p) size / 100) + 1 first ones of each, in any order that
   is the same for all; so only these are listed. Here shingles that many sets have come last (``frequent_shingles``, a bounded table; it orders lists, it decides nothing), and
   lists of one set vanish. Light sets near the boundary are in the lists too, for heavy ones to find.
3. The boundary is the size with the least cost: rows enumerated up to it against list entries scanned above it (``boundary``).
4. A list of many near copies would be scanned in pairs. Instead the first rounds verify each set of a list against one other set only: a hub of the
   list, then the nearest set of another class; what is linked becomes one class. After that only pairs of a list whose classes still differ are left. Two sets differ in as many shingles at least as the parities of
   their shingles by hash value do (``odd_sketch``, about two bits a shingle): what differs in too many is dropped by this bound, all others are verified by
   their whole sets. No pair is dropped otherwise: a link that is left out joins what is already joined.
5. Only texts of sets that have a candidate are read again. Classes come from star joins (``simhash.components``), documents join theirs by ``common.lookup``.

Shingles and sets are named by 64-bit hashes: of n distinct sets two are confused with a chance of about n**2 / 2**65.

Defined results: a text of fewer words than a shingle is one shingle, the whole sequence; a text without words (null, empty, blank) has no shingles and is linked
with nothing, so it is its own class. Rows with equal sets are linked. A null doc_id names a class only if the class has no other.
An empty table gives an empty result. Very long texts are read in whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import BROADCAST_BYTES, bounded, free_name, lookup, with_row_id, write_table
from riskloom.llm.lm_scoring import _mix
from riskloom.llm.simhash import _signed, _whole_nodes, components, shingle_set

#: Sets up to so many shingles may be light.
LIGHT_MOST = 32
#: Shingles in the table of frequent ones, at most; how often one must be met; shingles that are counted at once.
FREQUENT, MET, CHUNK = 1 << 17, 32, 1 << 20
#: Bits of the folded sketch that travels with list entries, at least and at most, powers of two.
MINI = (256, 1024)
#: Rounds that verify a set of a list against the nearest of another class only; entries of a list that one task compares with each other; lists up to so many are compared together.
NEAR_ROUNDS, LIST_ROWS, SHORT = 3, 8192, 64
#: Bytes of the table of lists up to which it is broadcast.
LISTS_BYTES = 48 << 20
PART = 1 << 30


def least_shared(a: int, b: int, percent: int) -> int:
    """How many shingles linked sets of a and b shingles share at least."""
    return -(-percent * (a + b) // (100 + percent))


def partner_sizes(size: int, percent: int) -> list[int]:
    """Sizes that a set of this size may link to without being equal to it."""
    able = range(-(-percent * size // 100), 100 * size // percent + 1)
    return [b for b in able if b and least_shared(size, b, percent) <= min(size, b) and not (b == size and least_shared(size, b, percent) == size)]


def subsets_of(size: int, percent: int) -> int:
    """Rows that a light set of this size enumerates."""
    return sum(math.comb(size, least_shared(size, b, percent)) for b in partner_sizes(size, percent))


def listed(size: int, percent: int) -> int:
    return (100 - percent) * size // 100 + 1


def boundary(sizes: dict[int, int], entries: float, percent: int) -> int:
    """The largest light size, by least cost. sizes: how many sets have each size up to LIGHT_MOST; entries: those a set meets, on average, in a list that it is in."""
    costs, light = [], 0
    scan = {s: n * listed(s, percent) * entries for s, n in sizes.items()}
    for x in range(LIGHT_MOST + 1):
        light += sizes.get(x, 0) * (subsets_of(x, percent) if x else 0)
        costs.append((light + sum(c for s, c in scan.items() if s > x), x))
    return min(costs)[1]


def frequent_shingles(texts: DataFrame, words: int) -> DataFrame:
    """(token, n): shingles that were met often, counted where CHUNK shingles of neighbouring documents hold one twice; FREQUENT at most."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        twice = n > 1
        return pa.RecordBatch.from_arrays([pa.array(tokens[twice].view(np.int64)), pa.array(n[twice].astype(np.int64))], ["token", "n"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in bounded(parts):
            for text in part.column(0):
                held.append(shingle_set(text.as_py(), words))
                size += len(held[-1])
                if size >= CHUNK:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    found = texts.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= MET)
    found = write_table(found, "frequent-shingles")
    level = F.floor(F.log2("n"))
    levels = {r["level"]: r["c"] for r in found.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect()}  # 64 at most
    least, total = 64, 0
    while least and total + levels.get(least - 1, 0) <= FREQUENT:
        least -= 1
        total += levels.get(least, 0)
    return found.where(level >= least)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bytes whose bits tell whether an odd number of shingles has that hash value; a power of two, two bits a shingle at least."""
    bits = max(MINI[0], 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else MINI[0]
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(sketch: np.ndarray, bits: int) -> np.ndarray:
    """A sketch of fewer bits of the same sets; rows of sketches, or one."""
    while sketch.shape[-1] * 8 > bits:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def mini_bits(sketch: np.ndarray) -> int:
    return min(MINI[1], max(MINI[0], sketch.shape[-1] * 8 // 4))


def marked_sets(texts: DataFrame, frequent: DataFrame, words: int, percent: int) -> DataFrame:
    """(row_id, doc_id, set_id, size, sketch, mini, prefix, members): mini is the sketch folded for lists; members has all shingles of sets that may be light."""
    table = frequent.toArrow()
    tokens, n = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(tokens)
    sent = texts.sparkSession.sparkContext.broadcast((tokens[order], n[order]))
    kinds = {c: texts.schema[c].dataType.simpleString() for c in ("row_id", "doc_id")}

    def prefix(own: np.ndarray) -> np.ndarray:
        if not len(own):
            return own
        often, counts = sent.value
        weight = np.zeros(len(own), np.int64)
        if len(often):
            at = np.searchsorted(often, own).clip(max=len(often) - 1)
            weight = np.where(often[at] == own, counts[at], 0)
        return own[np.lexsort((own, weight))[: listed(len(own), percent)]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(parts):
            sets = [shingle_set(x.as_py(), words) for x in part.column(2)]
            sketches = [odd_sketch(s) for s in sets]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([set_name(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x.tobytes() for x in sketches], pa.binary()),
                    pa.array([folded(x, mini_bits(x)).tobytes() for x in sketches], pa.binary()),
                    pa.array([prefix(s).view(np.int64) for s in sets], longs),
                    pa.array([s.view(np.int64) if len(s) <= LIGHT_MOST else None for s in sets], longs),
                ],
                ["row_id", "doc_id", "set_id", "size", "sketch", "mini", "prefix", "members"],
            )

    schema = f"row_id {kinds['row_id']}, doc_id {kinds['doc_id']}, set_id bigint, size bigint, sketch binary, mini binary, prefix array<bigint>, members array<bigint>"
    return texts.select("row_id", "doc_id", "text").mapInArrow(run, schema)


def set_name(shingles: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(shingles.tobytes(), len(shingles)))


def light_links(own: DataFrame, most: int, percent: int) -> DataFrame:
    """(a, b): stars over sets of ``most`` shingles or fewer that have a subset of the needed size in common."""
    plans = {s: [(b, s - least_shared(s, b, percent)) for b in partner_sizes(s, percent) if b <= most] for s in range(1, most + 1)}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(parts):
            low, high, subset, owner, size = [], [], [], [], []
            for name, members in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                each = _mix(np.array(members.as_py(), np.int64).view(np.uint64))
                for b, less in plans[len(each)]:
                    gone = np.array(list(combinations(range(len(each)), less)), np.int64).reshape(math.comb(len(each), less), less)
                    found = _mix(each.sum(dtype=np.uint64) - each[gone].sum(axis=1, dtype=np.uint64))
                    subset.append(found)
                    for column, x in ((low, min(b, len(each))), (high, max(b, len(each))), (owner, name), (size, len(each))):
                        column.append(np.full(len(found), x, np.int64))
            if subset:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (low, high, subset, owner, size)], ["low", "high", "subset", "set_id", "size"])

    rows = own.where((F.col("size") > 0) & (F.col("size") <= most)).select("set_id", "members").mapInArrow(run, "low bigint, high bigint, subset bigint, set_id bigint, size bigint")
    rows = write_table(rows.withColumn("part", F.pmod("subset", F.lit(PART))), "subsets")
    keys = ["part", "low", "high", "subset"]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("set_id").alias("b"), F.min("size").alias("least"), F.max("size").alias("most"))
    groups = groups.where((F.col("n") > 1) & (F.col("least") == F.col("low")) & (F.col("most") == F.col("high"))).drop("least", "most")
    stars = lookup(rows, write_table(groups, "subset-groups"), keys, rows.count(), 64, "inner", F.xxhash64("set_id"))
    return stars.where("set_id <> b").select(F.greatest("set_id", "b").alias("a"), F.least("set_id", "b").alias("b")).distinct()


def sets_of(wanted: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(set_id, s): the shingles of the wanted sets (row: one of each set's rows); only those rows are read with their text."""
    ids = write_table(wanted.select(F.col("row").alias("_row")), "wanted-rows")
    some = F.broadcast(ids) if ids.count() * 48 <= BROADCAST_BYTES else ids

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(parts):
            sets = [shingle_set(x.as_py(), words) for x in part.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["set_id", "s"])

    return write_table(texts.join(some, F.col("row_id") == F.col("_row")).select("text").mapInArrow(run, "set_id bigint, s array<bigint>"), "shingle-sets")


class _Entries:
    """The entries of whole lists in a task, and which pairs of them can link."""

    def __init__(self, table: pa.Table, starts: np.ndarray, light: int, percent: int):
        self.own, self.root, self.size, self.side, task = (table.column(c).to_numpy() for c in ("fp", "root", "size", "side", "task"))
        self.single = (task >> 31) == (task & ((1 << 31) - 1))
        self.starts, self.ends = starts, np.append(starts[1:], len(self.own))
        self.group = np.repeat(np.arange(len(starts)), self.ends - starts)
        self.light, self.percent = light, percent
        minis = table.column("mini").to_pylist()
        self.bits = np.array([8 * len(x) for x in minis])
        self.words: dict[int, np.ndarray] = {}
        self.at: dict[int, np.ndarray] = {}
        widths = np.unique(self.bits).tolist()
        for w in widths:  # sets that link differ in size by less than twice, so in width by one step
            parts, self.at[w] = [], np.zeros(len(minis), np.int64)
            n = 0
            for wide in (w, 2 * w):
                rows = np.nonzero(self.bits == wide)[0]
                if len(rows):
                    parts.append(folded(np.frombuffer(b"".join([minis[k] for k in rows]), np.uint8).reshape(len(rows), -1), w).copy())
                    self.at[w][rows] = n + np.arange(len(rows))
                    n += len(rows)
            self.words[w] = np.concatenate(parts).view(np.uint64)

    def able(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, how much they differ at least) of those that can link and are not linked yet."""
        a, b = self.size[i], self.size[j]
        keep = (self.root[i] != self.root[j]) & (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)) & (np.maximum(a, b) > self.light)
        keep &= self.single[i] | (self.side[i] != self.side[j])
        i, j = i[keep], j[keep]
        apart = np.zeros(len(i), np.int64)
        width = np.minimum(self.bits[i], self.bits[j])
        for w, words in self.words.items():
            k = np.nonzero(width == w)[0]
            for at in range(0, len(k), 1 << 15):
                some = k[at : at + (1 << 15)]
                apart[some] = np.bitwise_count(words[self.at[w][i[some]]] ^ words[self.at[w][j[some]]]).sum(axis=1, dtype=np.int64)
        fits = _near_enough(apart, self.size[i] + self.size[j], self.percent)
        return i[fits], j[fits], apart[fits]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What ``able`` leaves of all pairs (i, j) of a list; all of an i at once."""
        n = self.ends - self.starts
        short, found = (n <= SHORT)[self.group], []
        for step in range(1, min(SHORT, len(self.own))):
            i = np.nonzero((self.group[step:] == self.group[:-step]) & short[step:])[0]
            if not len(i):
                break
            found.append(self.able(i, i + step))
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found, strict=True))
        for k in np.nonzero(n > SHORT)[0]:
            start, end = self.starts[k], self.ends[k]
            for at in range(start, end, 128):
                i, j = np.nonzero((self.root[at : min(at + 128, end), None] != self.root[None, start:end]) & (np.arange(start, end)[None, :] > np.arange(at, min(at + 128, end))[:, None]))
                yield self.able(i + at, j + start)


def open_pairs(lists: DataFrame, light: int, percent: int, nearest: bool) -> DataFrame:
    """(a, b, token): pairs of one list, not both light, whose classes differ and which can link by their sizes and folded sketches; with ``nearest`` one of each set and list.

    lists: token, task and side (see ``in_list_blocks``), fp (the set), root, size, mini.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_nodes(parts, 2):
            token, entries = table.column("token").to_numpy(), _Entries(table, starts, light, percent)
            for i, j, apart in entries.pairs():
                if nearest and len(i):
                    order = np.lexsort((apart, i))
                    order = order[np.append(True, i[order][1:] != i[order][:-1])]
                    i, j = i[order], j[order]
                if len(i):
                    one, two = entries.own[i], entries.own[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two)), pa.array(token[i])], ["a", "b", "token"])

    parts = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = lists.select("token", "task", "side", "fp", "root", "size", "mini").repartition(parts, "token", "task").sortWithinPartitions("token", "task")
    return dealt.mapInArrow(run, "a bigint, b bigint, token bigint")


def in_list_blocks(entries: DataFrame, large: DataFrame) -> DataFrame:
    """entries with task and side: those of large lists (token, n) fall into blocks by hash, and each two blocks, and each one, meet in a task; no pair is lost."""
    large = F.broadcast(large) if large.count() * 32 <= BROADCAST_BYTES else large
    own = entries.join(large, "token", "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / LIST_ROWS))
    own = own.withColumn("side", F.pmod(F.xxhash64("set_id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return own.withColumn("task", F.shiftleft(F.least("side", "other"), 31) + F.greatest("side", "other")).drop("n", "blocks", "other")


def _near_enough(apart: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets that differ in ``apart`` shingles at least can link; sizes: of both together."""
    return (100 + percent) * apart <= (100 - percent) * sizes


def sketched(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can link by their whole sketches."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for one, two, n in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                x, y = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
                bits = 8 * min(len(x), len(y))
                keep.append(_near_enough(np.bitwise_count(folded(x, bits) ^ folded(y, bits)).sum(dtype=np.int64), n, percent))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (own.select(F.col("set_id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("size").alias(f"n{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb", (F.col("na") + F.col("nb")).alias("n"))
    return both.mapInArrow(run, "a bigint, b bigint")


class _Verifier:
    """Verifies pairs of sets, each pair and each text once."""

    def __init__(self, own: DataFrame, texts: DataFrame, words: int, percent: int):
        self.own, self.texts, self.words, self.percent = own, texts, words, percent
        self.sets = self.tried = None

    def links(self, pairs: DataFrame) -> DataFrame:
        pairs = write_table(sketched(pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti"), self.own, self.percent), "pairs")
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        ends = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
        ends = ends if self.sets is None else ends.join(self.sets.select("set_id"), "set_id", "left_anti")
        more = sets_of(ends.join(self.own.select("set_id", "row"), "set_id"), self.texts, self.words)
        self.sets = more if self.sets is None else self.sets.unionByName(more)
        one, two = (self.sets.select(F.col("set_id").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
        both = pairs.join(one, "a").join(two, "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.where(100 * shared >= self.percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def heavy_links(own: DataFrame, entries: DataFrame, large: DataFrame, stars: DataFrame, light: int, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Classes as of ``components`` under the given stars and all links that the lists (entries: token, set_id, size; large: those that are cut) show."""
    verifier = _Verifier(own, texts, words, percent)
    for k in range(NEAR_ROUNDS + 1):
        roots = stars.select(F.col("a").alias("set_id"), F.col("b").alias("root"))
        sets = own.select("set_id", "mini").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        lists = in_list_blocks(entries, large).join(sets, "set_id").withColumnRenamed("set_id", "fp")
        found = write_table(open_pairs(lists, light, percent, k < NEAR_ROUNDS), "open-pairs")
        if not found.limit(1).count():
            return stars
        stars = components(stars.unionByName(verifier.links(found.select("a", "b").distinct())))
        if k < NEAR_ROUNDS:  # the other lists have no pair that can link
            still = write_table(found.select("token").distinct(), "open-lists")
            still = F.broadcast(still) if still.count() * 32 <= LISTS_BYTES else still
            entries = write_table(entries.join(still, "token", "left_semi"), "entries")
    return stars


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document; component_id is the smallest doc_id that links reach."""
    row = free_name(docs, "row_id")
    named = with_row_id(docs, row)
    texts = named.select(F.col(row).alias("row_id"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = write_table(marked_sets(texts, frequent_shingles(texts, words), words, percent), "sets")
    first = [F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min("row_id").alias("row"), *[F.first(c).alias(c) for c in ("size", "sketch", "mini", "prefix", "members")]]
    own = write_table(marked.where("size > 0").groupBy("set_id").agg(*first), "distinct-sets")
    part = lambda c: F.pmod(c, F.lit(PART)).alias("part")

    entries = own.select(F.explode("prefix").alias("token"), "set_id", "size").withColumn("part", part("token"))
    lists = write_table(entries.groupBy("part", "token").agg(F.count("*").alias("n")).where("n > 1"), "list-sizes")
    total, met = entries.count(), lists.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    sizes = {r["size"]: r["c"] for r in own.where(F.col("size") <= LIGHT_MOST).groupBy("size").agg(F.count("*").alias("c")).collect()}
    light = boundary(sizes, met / max(1, total) + 1, percent)
    stars = components(light_links(own, light, percent))
    near = entries.where(F.col("size") * 100 >= percent * (light + 1))  # those that a heavy set may link to
    shared = lookup(near, lists, ["part", "token"], total, 32, "inner", F.xxhash64("set_id"), LISTS_BYTES).select("token", "set_id", "size")
    large = lists.where(F.col("n") > LIST_ROWS).select("token", "n")
    stars = heavy_links(own, write_table(shared, "entries"), large, stars, light, texts, words, percent)

    rooted = stars.select(F.col("a").alias("set_id"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("set_id"), F.col("b").alias("root")).distinct())
    rooted = write_table(rooted.join(own.select("set_id", "n", "first"), "set_id").withColumn("part", part("root")), "rooted")
    least = write_table(rooted.groupBy("part", "root").agg(F.count("*").alias("n"), F.min("first").alias("component_id")), "classes")
    linked = lookup(rooted.select("part", "root", "set_id"), least, ["part", "root"], rooted.count(), 64, "left", F.xxhash64("set_id")).select("set_id", "component_id")
    classes = own.select("set_id", "n", "first").join(linked.withColumn("linked", F.lit(True)), "set_id", "left")
    classes = write_table(classes.select(part("set_id"), "set_id", "n", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id")), "classes")
    keyed = marked.select(part("set_id"), "set_id", "doc_id", "size")
    out = lookup(keyed, classes, ["part", "set_id"], marked.count(), 64, "left", F.xxhash64("doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
