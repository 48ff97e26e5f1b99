"""Line dedup over levelled, sorted runs of line hashes.

A run is a table of (h1, h2, n, last, fresh), bucketed and sorted by the 128-bit line hash: n documents of one batch hold
the line, the largest of their doc_ids is ``last``. A new batch is counted, merge-anti-joined with every run (what
survives is fresh, the rest only adds to counts) and written as a run of level 0. Two runs of a level are compacted into
one of the next by a full outer merge join; as all runs share their bucketing, neither join shuffles a run. So each line
hash is rewritten as often as there are levels, which is logarithmic in the number of batches.

Keys in ``min_docs`` documents or more lose all their lines except in the document with the largest doc_id. Only
keys (16 bytes) and doc_ids are shuffled. The keys that repeat are broadcast if they fit ``bound`` bytes, and texts are
rewritten where they are read; beyond it each row gets its list of dropped keys by ``common.lookup`` (a line that a third of
all documents hold is counted before the shuffle), and texts are shuffled once to meet these lists.

Defined results: a null or empty text is one empty line; rows that repeat a doc_id are one document, as are all rows without
one, and all of them keep the lines of which theirs is the largest doc_id; null is the smallest; every row is reported; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import BROADCAST_BYTES, bounded, lookup, remove_table, shared_dir, with_row_id, write_table

KEYS = ["h1", "h2"]


def line_key(line: str, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key; None if the key has fewer code points than min_chars."""
    key = line.encode("utf-8", "surrogatepass").strip().lower()  # of bytes: ASCII white space and A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


class LineRuns:
    """Levelled runs of line hashes in the shared folder."""

    def __init__(self, like: DataFrame, buckets: int | None = None):
        self.spark = like.sparkSession
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, DataFrame]]] = []

    def _write(self, df: DataFrame) -> tuple[str, DataFrame]:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        df.repartition(self.buckets, *KEYS).write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).option("path", path).format("parquet").saveAsTable(name)
        return name, self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [t for level in self.levels for _, t in level]

    def ingest(self, batch: DataFrame) -> None:
        """batch: (doc_id, h1, h2), one row per document and distinct line key. No document is in two batches."""
        counted = batch.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        fresh = counted
        for run in self.runs():
            fresh = fresh.join(run.select(*KEYS), KEYS, "left_anti")
        if self.runs():
            held = fresh.select(*KEYS, F.lit(True).alias("fresh"))
            run = counted.join(held, KEYS, "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
        else:
            run = fresh.withColumn("fresh", F.lit(True))
        self._add(0, self._write(run))

    def _add(self, level: int, run: tuple[str, DataFrame]) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == 2:
            self._add(level + 1, self._merge(*self.levels[level]))
            self.levels[level] = []

    def _merge(self, one: tuple[str, DataFrame], two: tuple[str, DataFrame]) -> tuple[str, DataFrame]:
        a, b = one[1].alias("a"), two[1].alias("b")
        both = a.join(b, KEYS, "full_outer").select(
            *KEYS,
            (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"),
            F.greatest("a.last", "b.last").alias("last"),
            (F.coalesce("a.fresh", F.lit(False)) | F.coalesce("b.fresh", F.lit(False))).alias("fresh"),
        )
        run = self._write(both)
        self._drop([one, two])
        return run

    def _drop(self, runs: list[tuple[str, DataFrame]]) -> None:
        for name, table in runs:
            remove_table(table)
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        """Drop all runs and their files."""
        self._drop([run for level in self.levels for run in level])
        self.levels = []

    def totals(self) -> DataFrame:
        """One row per key: in how many documents it is, and the largest of their doc_ids."""
        left = [run for level in self.levels for run in level]
        while len(left) > 1:
            left = [*left[2:], self._merge(left[0], left[1])]
        self.levels = [left]
        return left[0][1]


def _hashed(rows: DataFrame, min_chars: int) -> DataFrame:
    """rows (text last) with h1 and h2 for text, one row per row and distinct line key."""
    kept = rows.columns[:-1]

    def hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(parts):
            at, found = [], []
            for i, text in enumerate(part.column(len(kept)).to_pylist()):
                own = {k for line in (text or "").split("\n") if (k := line_key(line, min_chars))}
                found.extend(own)
                at.extend([i] * len(own))
            words = pa.Array.from_buffers(pa.int64(), 2 * len(found), [None, pa.py_buffer(b"".join(found))])
            both = words.to_numpy(zero_copy_only=False).reshape(-1, 2)
            rows_ = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows_) for k in range(len(kept))), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], [*kept, *KEYS])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(hashes, f"{kinds}, h1 bigint, h2 bigint")


def line_hashes(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """(doc_id, h1, h2, batch), one row per document and distinct line key, written by batch."""
    out = _hashed(docs.select("doc_id", "text"), min_chars)
    again = write_table(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_again")), "repeated-ids")
    n = again.count()
    if n:  # their rows may hold a line twice
        again = F.broadcast(again) if n * 32 <= BROADCAST_BYTES else again
        same = F.col("doc_id").eqNullSafe(F.col("_again"))
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").distinct())
    return write_table(out.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "line-hashes", "batch")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, bound: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_text."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashes = line_hashes(docs, min_chars, batches)
    runs = LineRuns(docs)
    for k in range(batches):
        runs.ingest(hashes.where(F.col("batch") == k).select("doc_id", *KEYS))
    repeated = runs.totals().where(F.col("n") >= min_docs).withColumn("part", F.pmod("h1", F.lit(1 << 30)))
    repeated = write_table(repeated.select("part", *KEYS, "n", "last"), "line-repeated")
    runs.close()
    remove_table(hashes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_text string"

    def rewritten(ids: pa.Array, texts: list[str | None], lost: Iterator[set | None]) -> pa.RecordBatch:
        """lost: for each text the keys that it loses; None if it loses none."""
        lines, kept = [], []
        for text, gone in zip(texts, lost, strict=True):
            every = (text or "").split("\n")
            stay = every if not gone else [x for x in every if line_key(x, min_chars) not in gone]
            lines.append((len(every), len(every) - len(stay)))
            kept.append("\n".join(stay))
        return pa.RecordBatch.from_arrays([ids, pa.array([x for x, _ in lines], pa.int64()), pa.array([x for _, x in lines], pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    joined = lambda a, b: a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True)
    if repeated.count() * 64 <= bound:
        last = docs.sparkSession.sparkContext.broadcast({joined(r["h1"], r["h2"]): r["last"] for r in repeated.select(*KEYS, "last").toLocalIterator()})

        def by_key(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keeper, none = last.value, object()
            for part in bounded(parts):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                own = ({k for x in (t or "").split("\n") if (k := line_key(x, min_chars)) and keeper.get(k, none) is not none and keeper[k] != i} for i, t in zip(ids, texts, strict=True))
                yield rewritten(part.column(0), texts, own)

        return docs.mapInArrow(by_key, schema)

    rows = with_row_id(docs, "row_id")
    keyed = _hashed(rows.select("row_id", "doc_id", "text"), min_chars).select(F.pmod("h1", F.lit(1 << 30)).alias("part"), *KEYS, "row_id", "doc_id")
    hits = lookup(keyed, repeated, ["part", *KEYS], docs.count(), 64, "inner", F.xxhash64("row_id"))
    lists = hits.where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("row_id").agg(F.collect_list(F.struct(*KEYS)).alias("lost"))
    listed = rows.join(lists, "row_id", "left").select("doc_id", "text", F.col("lost.h1").alias("h1"), F.col("lost.h2").alias("h2"))

    def by_list(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(parts):
            gone = ({joined(x, y) for x, y in zip(a, b, strict=True)} if a else None for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
            yield rewritten(part.column(0), part.column(1).to_pylist(), gone)

    return listed.mapInArrow(by_list, schema)
