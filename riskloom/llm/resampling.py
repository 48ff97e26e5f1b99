"""Resampling of documents towards a target distribution, with n-gram features that are never built as strings.

1. A feature is a run of 1 to ``orders`` words joined by a space; its bucket is its CRC-32 modulo ``buckets``. The CRC of each word, alone and
   after a space, is taken once. The CRC of A + B is the CRC of A, shifted by the length of B, XOR the CRC of B; a shift by
   2**k zero bytes is a 32 x 32 matrix over GF(2), kept as four tables of 256 words, so a whole batch of n-grams is a few table lookups.
2. One pass counts buckets over all documents, and one over the target texts: a task sums up its own and passes on a row a bucket at most.
   The table of gains (log ratios of smoothed shares) has ``buckets`` entries and is broadcast.
3. A second pass adds up each document's gains. Texts are never shuffled, and no feature is a row.
4. Each document's Gumbel noise comes from a hash of its doc_id, so the highest scores are a draw without replacement. Only those that can
   be among them (by a quantile with a bounded error, checked by a count) are dealt by ranges of scores and sorted; a document's rank is
   its place in its range and the sizes of the ranges before.

Defined results: a null text has no words, so weight 0; a null doc_id is hashed as an empty text and ranks after equal scores. Rows that
repeat a doc_id count each for itself and share their noise. Very long texts are read in whole. Without documents the result is empty;
without target texts all their buckets are empty. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import write_table

#: Words that a task remembers with their CRCs, and bytes of text that it works on at once.
WORDS, BYTES = 1 << 18, 4 << 20
#: Bytes that are part of words, A-Z lowered; all others are blanks. In UTF-8 what is not ASCII has bytes from 128 on.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _zero_byte() -> np.ndarray:
    """Tables (4, 256) of the linear map that one zero byte is to a CRC-32."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    every = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    return (every >> 8) ^ step[every & 255]


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def _powers(most: int = 32) -> list[np.ndarray]:
    out = [_zero_byte()]
    while len(out) < most:
        out.append(_apply(out[-1], out[-1]))
    return out


SHIFTS = _powers()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC after n zero bytes, n of its own."""
    out = crc.copy()
    for k in range(int(n.max(initial=0)).bit_length()):
        some = np.nonzero(n >> k & 1)[0]
        out[some] = _apply(SHIFTS[k], out[some])
    return out


class _Known(dict):
    """word -> its number; its CRC, the CRC after a space and its length are in lists."""

    def __init__(self) -> None:
        self.alone, self.after, self.length = [], [], []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.alone)
        self.alone.append(zlib.crc32(word))
        self.after.append(zlib.crc32(word, zlib.crc32(b" ")))
        self.length.append(len(word))
        return n


class Features:
    """CRCs of the features of batches of texts."""

    def __init__(self, orders: int):
        self.orders, self.known = orders, _Known()

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(n_words per text, for each order the owners and CRCs of its features); owners rise."""
        if len(self.known) > WORDS:
            self.known = _Known()
        tokens = [(t or b"").translate(_FOLD).split() for t in texts]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ids = np.fromiter((n for words in tokens for n in map(self.known.__getitem__, words)), np.int64, int(sizes.sum()))
        alone, after = np.array(self.known.alone, np.uint32)[ids], np.array(self.known.after, np.uint32)[ids]
        length = np.array(self.known.length, np.int64)[ids] + 1
        owner, crc, out = np.repeat(np.arange(len(tokens)), sizes), alone, []
        for k in range(self.orders):
            if k:  # one more word behind each run
                crc = shifted(crc[:-1], length[k:]) ^ after[k:]
            inside = owner[: len(crc)] == owner[k:]
            out.append((owner[k:][inside], crc[inside]))
        return sizes, out


def _chunks(part: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes | None]]]:
    """(where it starts, texts) of pieces of a batch of about BYTES; a longer text is a piece of its own."""
    at, held, size = 0, [], 0
    for i, value in enumerate(part.column(column)):
        held.append(value.as_py())
        size += len(held[-1] or b"")
        if size >= BYTES:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def bucket_counts(texts: DataFrame, text_col: str, orders: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts = Features(orders), np.zeros(buckets, np.int64)
        for part in parts:
            for _, some in _chunks(part, 0):
                for _, crc in features.of(some)[1]:
                    counts += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bucket", "n"])

    each = texts.select(F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket int, n bigint")
    found = each.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # ``buckets`` rows at most
    out = np.zeros(buckets, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in the documents)) of each bucket, with one added to every count."""
    k, s, t = len(own), int(own.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(y + 1) * float(s + k) / (float(x + 1) * float(t + k)))) for x, y in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, id_col: str, text_col: str, table: np.ndarray, orders: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight)."""
    sent = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, table = Features(orders), sent.value
        for part in parts:
            for at, some in _chunks(part, 1):
                sizes, found = features.of(some)
                n, weight = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
                for owner, crc in found:
                    upto = np.concatenate(([0], np.cumsum(table[crc % np.uint32(len(table))])))
                    edge = np.searchsorted(owner, np.arange(len(some) + 1))
                    weight += upto[edge[1:]] - upto[edge[:-1]]
                    n += np.diff(edge)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(some)), pa.array(sizes), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a SHA-256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, eligible: Column, k: int) -> DataFrame:
    """scored, a written table, with rank: 1.. for the k eligible rows that come first by (score falling, doc_id, n_features), null for others."""
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    n = scored.where(eligible).count()
    if not k or not n:
        return none
    fits = eligible
    for slack in (0.01, 0.1):  # a quantile with an error of a tenth of the slack
        share = max(0.0, 1 - k / n - slack)
        cut = scored.where(eligible).agg(F.percentile_approx("score", share, max(100, round(10 / slack))).alias("cut")).first()["cut"]
        if scored.where(eligible & (F.col("score") >= cut)).count() >= k:
            fits = eligible & (F.col("score") >= cut)
            break
    keys = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = scored.where(fits).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    sorted_ = write_table(sorted_, "sorted-scores").withColumn("range", F.shiftright("place", 33))
    sizes = {r["range"]: r["n"] for r in sorted_.groupBy("range").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, starts = 0, []
    for r in sorted(sizes):
        starts.append((r, before))
        before += sizes[r]
    starts = scored.sparkSession.createDataFrame(starts, "range bigint, before bigint")
    place = F.col("before") + F.col("place") - F.shiftleft("range", 33) + 1
    drawn = sorted_.join(F.broadcast(starts), "range").withColumn("rank", F.when(place <= k, place)).select(none.columns)
    return none.where(~F.coalesce(fits, F.lit(False))).unionByName(drawn)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", orders: int = 3, buckets: int = 10_000, least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): ``percent`` of the documents of least_words or more are drawn, by rank."""
    table = gains(bucket_counts(docs, text_col, orders, buckets), bucket_counts(target, text_col, orders, buckets))
    scored = weigh(docs, id_col, text_col, table, orders).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = write_table(scored, "scores")
    eligible = F.col("n_words") >= least_words
    return ranked(scored, eligible, percent * scored.where(eligible).count() // 100)
