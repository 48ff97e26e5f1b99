"""Language-model scores from a log-frequency Bloom filter.

1. Word and word-pair counts of all training texts: hashed and combined per few million tokens inside the tasks, then
   summed by a shuffle over filter segments (a pair that is in every document is one row per task, so no key is hot).
2. A count c is quantised to q = 1 + floor(log_b c), and the n-gram is inserted q times, as (n-gram, 1) ... (n-gram, q). The filter
   has as many bits as the insertions ask for, up to ``max_bits``, which proves the size of its broadcast. It is cut into
   segments, so that each is built by one task from its own n-grams and the driver gets the filter's bytes and nothing else.
3. A count is read back by membership probes for 1, 2, ... until one fails. Probabilities are smoothed by a Dirichlet
   prior: p(w|h) = (c(hw) + m p(w)) / (c(h) + m), p(w) with 0.5 added to each count. The weight m is the best of
   a grid for the leave-one-out likelihood of all training documents, summed up in the tasks.
4. All pairs count, those seen once too. Where they are more than ``max_bits`` hold, a histogram of counts over all data says
   which rare ones stay outside (least counts first, pairs before words). Pairs outside are not lost: a document's pairs
   that the filter does not know meet the outside pairs, with their quantised counts, by a shuffle, and what they add to
   its score is summed per row. Words outside the filter (from about 10**8 distinct words on) are unknown to the smoothed
   model; the baseline below knows them.
5. The baseline needs exact word counts. Words down to a count at which ``known_words`` of them fit are broadcast as
   sorted arrays of a proven size; if there are rarer words, those meet their counts by a shuffle join.

Words are told apart by 63-bit hashes: of 10**8 distinct words, two share one with a chance of about 1 in 2,000. Defined results: a null or empty text is the end token alone; null doc_ids are training rows;
repeated rows count and are scored each for itself; without training rows N = V = 0 and all tokens are unknown; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import bounded, with_row_id, write_table

SEGMENT_BITS = 16  # counts are dealt by so many bits of an n-gram's hash
LEAST_BITS = 22
MAX_LEVEL = 128
PROBES = 5
#: Bits an inserted item takes at the target load: five probes then err in about one of a hundred cases.
ITEM_BITS = 10
FLUSH = 2_000_000
#: Texts that are looked at together; what a task holds beside the broadcasts is a few numbers for each of their tokens.
BATCH = 128
PRIORS = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0, 16384.0, 65536.0)
_hash = xxhash.xxh3_64_intdigest
END, BEGIN = _hash(b" end"), _hash(b" begin")  # no word holds a blank
_ONE = np.uint64(1)


def held_out_expr(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row (the lowest bit is 0), the hashes of the pairs that end there (1), and where texts start."""
    out, sizes = [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        out += words
        out.append(b" end")
        sizes.append(len(words) + 1)
    starts = np.cumsum([0, *sizes[:-1]]) if sizes else np.array([], np.int64)
    words = np.fromiter(map(_hash, out), np.uint64, len(out))
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts] = BEGIN
    pairs = _mix(_mix(before + np.uint64(0x9E3779B97F4A7C15)) + words) | _ONE
    return words & ~_ONE, pairs, starts


def histories(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The word before each; the end token before a text's first, as both are seen once per document."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts] = np.uint64(END) & ~_ONE
    return before


def segment_bits(bits: int) -> int:
    """A filter of 2**bits bits has 2**segment_bits segments, of 8,192 bits at least, so that they fill evenly."""
    return min(SEGMENT_BITS, max(1, bits - 13))


class LogFrequencyFilter:
    """Quantised counts of hashed n-grams in a segmented Bloom filter of 2**bits bits."""

    def __init__(self, bits: int, base: float, data: np.ndarray | None = None):
        self.bits, self.base = bits, base
        self.data = np.zeros(1 << (bits - 3), np.uint8) if data is None else data

    @staticmethod
    def levels(counts: np.ndarray, base: float) -> np.ndarray:
        return 1 + np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)

    def places(self, grams: np.ndarray, level: np.ndarray | int) -> Iterator[np.ndarray]:
        mixed = _mix(grams + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level).astype(np.uint64))
        step, at = (mixed >> np.uint64(32)) | _ONE, mixed & np.uint64(0xFFFFFFFF)
        own = segment_bits(self.bits)
        inner = np.uint64((1 << (self.bits - own)) - 1)
        top = (grams >> np.uint64(64 - own)) << np.uint64(self.bits - own)
        for i in range(PROBES):
            yield top | ((at + np.uint64(i) * step) & inner)

    def insert(self, grams: np.ndarray, counts: np.ndarray) -> None:
        q = self.levels(counts, self.base)
        grams = np.repeat(grams, q)
        level = np.arange(len(grams)) - np.repeat(np.cumsum(q) - q, q) + 1
        for at in self.places(grams, level):
            np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), (_ONE << (at & np.uint64(7))).astype(np.uint8))

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """The middle of the range that each n-gram's level stands for; 0 if it is not in the filter."""
        level = np.zeros(len(grams), np.int64)
        live, k = np.arange(len(grams)), 0
        while len(live) and k < MAX_LEVEL:
            k += 1
            held = np.ones(len(live), bool)
            for at in self.places(grams[live], k):
                held &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            live = live[held]
            level[live] = k
        return self._middle(level)

    def _middle(self, level: np.ndarray) -> np.ndarray:
        low = np.ceil(np.power(self.base, level - 1) - 1e-9)
        high = np.maximum(low, np.ceil(np.power(self.base, level) - 1e-9) - 1)
        return np.where(level > 0, np.sqrt(low * high), 0.0)


def tally(held: list[np.ndarray], rows: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of all held arrays, so many rows at a time; held is emptied, as the sorted copy takes its place."""
    grams = np.concatenate(held)
    held.clear()
    grams.sort()
    starts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
    for at in range(0, len(starts), rows):
        own = starts[at : at + rows]
        after = starts[at + rows] if at + rows < len(starts) else len(grams)
        yield grams[own], np.diff(np.append(own, after))


class WordCounts:
    """Counts that a filter tells of words, kept for a task's next texts: frequent words have many levels to probe. At most ``most`` words are kept."""

    def __init__(self, own: LogFrequencyFilter, most: int = 1 << 18):
        self.own, self.most = own, most
        self.names, self.known = np.zeros(0, np.uint64), np.zeros(0)

    def __call__(self, each: np.ndarray) -> np.ndarray:
        """The counts of sorted distinct words."""
        place = np.searchsorted(self.names, each)
        new = np.append(self.names, _ONE)[place] != each  # no word is odd
        out = np.empty(len(each))
        out[~new] = self.known[place[~new]]
        out[new] = self.own.counts(each[new])
        if len(self.names) + new.sum() > self.most:
            self.names, self.known = each[: self.most], out[: self.most]
        elif new.any():
            self.names, self.known = np.insert(self.names, place[new], each[new]), np.insert(self.known, place[new], out[new])
        return out


def log_sums(top: np.ndarray, bottom: np.ndarray) -> float:
    """The sum of log10(top / bottom); ratios, each between 1e-38 and 1, are multiplied by eights first, as logarithms take longer."""
    ratio = np.ones(-(-len(top) // 8) * 8)
    np.divide(top, bottom, out=ratio[: len(top)])
    return float(np.log10(ratio.reshape(-1, 8).prod(axis=1)).sum())


def _count(docs: DataFrame) -> DataFrame:
    """(segment, gram, n): the counts of all words and pairs of docs; words have an even gram."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for grams, n in tally(held):
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int32))], ["gram", "n"])

        for part in bounded(parts, BATCH):
            words, pairs, _ = token_hashes(part.column(0).to_pylist())
            held += [words, pairs]
            size += len(words)
            if size >= FLUSH:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    rows = docs.select("text").mapInArrow(run, "gram bigint, n int").withColumn("segment", F.shiftrightunsigned("gram", 64 - SEGMENT_BITS))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "segment").groupBy("segment", "gram").agg(F.sum("n").alias("n"))


def _thresholds(counts: DataFrame, max_bits: int, base: float) -> tuple[int, int, int]:
    """The filter's bits, and the least counts of words and of pairs that go into it; from a histogram of 2 x 64 rows at most."""
    level = F.floor(F.log2("n") + 1e-9)
    insertions = F.sum(1 + F.floor(F.log("n") / float(np.log(base)) + 1e-9))
    hist = {(r["pair"], r["level"]): r["items"] for r in counts.groupBy((F.col("gram") % 2 != 0).alias("pair"), level.alias("level")).agg(insertions.alias("items")).collect()}
    bits = min(max_bits, max(LEAST_BITS, int(np.ceil(np.log2(max(1, sum(hist.values())) * ITEM_BITS)))))
    room, least = (1 << bits) / ITEM_BITS, []
    for pair in (False, True):
        k = 64
        while k > 0 and room >= hist.get((pair, k - 1), 0):
            k -= 1
            room -= hist.get((pair, k), 0)
        least.append(1 << k)
        if k > 0:
            room = -1
    return bits, least[0], least[1]


def _inside(least: tuple[int, int]) -> Column:
    """Whether an n-gram of the counts goes into the filter."""
    return F.col("n") >= F.when(F.col("gram") % 2 == 0, F.lit(least[0])).otherwise(F.lit(least[1]))


def build_filter(counts: DataFrame, bits: int, base: float) -> LogFrequencyFilter:
    """counts: gram and n of what goes in."""
    own_bits = segment_bits(bits)
    inner = 1 << (bits - own_bits - 3)  # bytes of a segment

    def segments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, names, made = np.full(1 << own_bits, -1, np.int64), [], np.zeros((0, inner), np.uint8)
        own = LogFrequencyFilter(bits, base, np.empty(0, np.uint8))
        for part in parts:
            grams, n = part.column(0).to_numpy().view(np.uint64), part.column(1).to_numpy()
            if not len(grams):
                continue
            q = own.levels(n, base)
            grams = np.repeat(grams, q)
            level = np.arange(len(grams)) - np.repeat(np.cumsum(q) - q, q) + 1
            spot = np.concatenate(list(own.places(grams, level)))
            segment, byte = (spot >> np.uint64(bits - own_bits)).astype(np.int64), (spot >> np.uint64(3)).astype(np.int64) & (inner - 1)
            new = np.unique(segment[row[segment] < 0])
            row[new] = len(made) + np.arange(len(new))
            names.extend(new.tolist())
            made = np.concatenate([made, np.zeros((len(new), inner), np.uint8)]) if len(new) else made
            np.bitwise_or.at(made.reshape(-1), row[segment] * inner + byte, (_ONE << (spot & np.uint64(7))).astype(np.uint8))
        yield from _segment_rows(dict(zip(names, made, strict=True)))

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for part in parts:
            for k, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                made[k] = made.get(k, 0) | np.frombuffer(data, np.uint8)
        yield from _segment_rows(made)

    kind = "segment int, data binary"
    rows = counts.select("gram", "n").mapInArrow(segments, kind).repartition("segment").mapInArrow(joined, kind)
    out = LogFrequencyFilter(bits, base)
    for r in rows.toLocalIterator():
        out.data[r["segment"] * inner : (r["segment"] + 1) * inner] = np.frombuffer(r["data"], np.uint8)
    return out


def _segment_rows(made: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    keys = sorted(made)
    for at in range(0, len(keys), 64):
        some = keys[at : at + 64]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([made[k].tobytes() for k in some], pa.binary())], ["segment", "data"])


def score_texts(docs: DataFrame, held_out: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", max_bits: int = 31, base: float = 1.5, known_words: int = 1 << 22) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    held_out: of a doc_id column, whether the row is kept from training. The broadcasts take 2**max_bits / 8 and
    12 x known_words bytes at most (16 x from 2**31 training tokens on).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    train = marked.where(~F.col("held_out")).select("text")
    counts = write_table(_count(train).select("gram", "n"), "ngram-counts")
    words = counts.where("gram % 2 = 0")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, v = int(total["n"]), int(total["v"])
    bits, *kept = _thresholds(counts, max_bits, base)
    bloom = spark.sparkContext.broadcast(build_filter(counts.where(_inside(kept)), bits, base).data)
    outside = counts.where(~_inside(kept) & (F.col("gram") % 2 != 0)) if kept[1] > 1 else None
    least, room = 64, known_words
    sizes = {r["k"]: r["n"] for r in words.groupBy(F.floor(F.log2("n") + 1e-9).alias("k")).agg(F.count("*").alias("n")).collect()}
    while least and room >= sizes.get(least - 1, 0):
        least -= 1
        room -= sizes.get(least, 0)
    table = words.where(F.col("n") >= (1 << least)).orderBy("gram").toArrow()
    names, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    known = spark.sparkContext.broadcast((names, n.astype(np.int32) if n_train < 1 << 31 else n))
    del table, names, n
    floor = n_train + 0.5 * (v + 1)

    def parts_of(texts: list[str | None], told: WordCounts) -> tuple[np.ndarray, ...]:
        """For each token c(w), c(h), c(hw) from the filter, the distinct words and which is the token's, and its pair; where texts start."""
        words_, pairs, starts = token_hashes(texts)
        each, at = np.unique(words_, return_inverse=True)
        c = told(each)
        two, at2 = np.unique(pairs, return_inverse=True)
        before = np.empty_like(at)
        before[1:] = at[:-1]
        end = np.searchsorted(each, np.uint64(END) & ~_ONE)
        before[starts] = end
        return c[at], c[before], told.own.counts(two)[at2], each, at, pairs, starts

    def likelihoods(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, told = np.zeros(len(PRIORS)), WordCounts(LogFrequencyFilter(bits, base, bloom.value))
        for part in bounded(parts, BATCH):
            c, ch, chw, _, _, _, starts = parts_of(part.column(0).to_pylist(), told)
            if len(starts):
                p, pair = (np.maximum(c - 1, 0) + 0.5) / floor, np.maximum(chw - 1, 0)
                before = np.maximum(np.maximum(ch - 1, 0), pair)
                sums += [log_sums(pair + m * p, before + m) for m in PRIORS]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(PRIORS)), pa.int32()), pa.array(sums)], ["k", "s"])

    tried = {r["k"]: r["s"] for r in train.mapInArrow(likelihoods, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    prior = PRIORS[max(tried, key=lambda k: tried[k])] if tried else PRIORS[-1]
    rest = [("lost", least > 0), ("open", outside is not None)]  # what the broadcasts do not tell
    rest = [name for name, there in rest if there]
    rows = with_row_id(docs, "row_id") if rest else docs.withColumn("row_id", F.lit(0))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("row_id", "doc_id")}

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, exact = known.value
        told = WordCounts(LogFrequencyFilter(bits, base, bloom.value))
        for part in bounded(parts, BATCH):
            c, ch, chw, each, at, pairs, starts = parts_of(part.column(1).to_pylist(), told)
            signed = each.view(np.int64)
            place = np.minimum(np.searchsorted(names, signed), max(len(names) - 1, 0))
            found = names[place] == signed if len(names) else np.zeros(len(each), bool)
            true = np.where(found, exact[place], 0).astype(np.int64)[at] if len(names) else np.zeros(len(at), np.int64)
            sizes_ = np.diff(np.append(starts, len(at)))
            fold = lambda x, s=starts: np.add.reduceat(x, s) if len(s) else np.zeros(0)
            p = (c + 0.5) / floor
            columns = [
                part.column(0),
                part.column(2),
                part.column(3),
                pa.array(sizes_.astype(np.int64)),
                pa.array(fold((true > 0).astype(np.int64)).astype(np.int64)),
                pa.array(fold(np.log10(true + 0.5)) - sizes_ * np.log10(floor)),
                pa.array(fold(np.log10((chw + prior * p) / (np.maximum(ch, chw) + prior)))),
            ]

            def lists(spots: np.ndarray, values: pa.Array, s: np.ndarray = starts) -> pa.Array:
                """values, one for each spot, as one list for each text."""
                of = np.searchsorted(s, spots, "right") - 1
                return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(s) + 1)).astype(np.int32)), values)

            if "lost" in rest:
                spots = np.nonzero(true == 0)[0]
                columns.append(lists(spots, pa.array(each[at[spots]].view(np.int64))))
            if "open" in rest:
                spots = np.nonzero(chw == 0)[0]
                columns.append(lists(spots, pa.StructArray.from_arrays([pa.array(pairs[spots].view(np.int64)), pa.array(p[spots]), pa.array(ch[spots])], ["gram", "p", "ch"])))
            yield pa.RecordBatch.from_arrays(columns, [*"row_id doc_id held_out n_tokens n_known base_score score".split(), *rest])

    more = {"lost": "lost array<bigint>", "open": "open array<struct<gram:bigint,p:double,ch:double>>"}
    schema = ", ".join([f"row_id {kinds['row_id']}, doc_id {kinds['doc_id']}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double", *(more[x] for x in rest)])
    out = write_table(rows.select("row_id", "text", "doc_id", "held_out").mapInArrow(score, schema), "lm-scores")
    bloom.destroy()  # all that needs them is written: neither the driver nor an executor holds them beside those of a next call
    known.destroy()
    if "lost" in rest:
        rare = words.where(F.col("n") < (1 << least))
        each = out.select("row_id", F.explode("lost").alias("gram")).groupBy("row_id", "gram").agg(F.count("*").alias("tf"))
        found = each.join(rare, "gram").groupBy("row_id").agg(F.sum("tf").alias("more_known"), F.sum(F.col("tf") * (F.log10(F.col("n") + 0.5) - float(np.log10(0.5)))).alias("more_base"))
        out = out.join(found, "row_id", "left").withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("more_base", F.lit(0.0)))
    if "open" in rest:
        each = out.select("row_id", F.inline("open")).groupBy("row_id", "gram").agg(F.count("*").alias("tf"), F.first("p").alias("p"), F.first("ch").alias("ch"))
        low = F.ceil(F.pow(F.lit(base), F.floor(F.log("n") / float(np.log(base)) + 1e-9)) - 1e-9)
        high = F.greatest(low, F.ceil(F.pow(F.lit(base), 1 + F.floor(F.log("n") / float(np.log(base)) + 1e-9)) - 1e-9) - 1)
        levelled = outside.select("gram", F.sqrt(low * high).alias("chw"))  # as a filter would tell it
        pm = prior * F.col("p")
        gain = F.log10((F.col("chw") + pm) / (F.greatest("ch", "chw") + prior)) - F.log10(pm / (F.col("ch") + prior))
        found = each.join(levelled, "gram").groupBy("row_id").agg(F.sum(F.col("tf") * gain).alias("more_score"))
        out = out.join(found, "row_id", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    return out.withColumn("train_tokens", F.lit(n_train).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
