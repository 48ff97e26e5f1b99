"""Pieces that several operators share: shared-folder tables, ASCII case folding and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.sources.shared import shared_dir, write_table

__all__ = ["BROADCAST_BYTES", "ascii_lower", "bounded", "free_name", "lookup", "merged", "remove_table", "shared_dir", "with_row_id", "write_table"]

#: Bytes that a broadcast side may take; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def remove_table(table: DataFrame) -> None:
    """Delete a table of ``write_table`` that nothing will read again."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def with_row_id(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column that tells its rows apart, although doc_ids may be null or repeat; the same in every job.

    Rows of a table of files are named by file and position, so nothing is copied. Other rows are written with a number first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in {c.lower() for c in docs.columns}:
        file, at = F.xxhash64("_metadata.file_path").cast("decimal(20,0)"), F.col("_metadata.row_index")
        return docs.select("*", (file * F.lit(1 << 40).cast("decimal(13,0)") + at).alias(name))
    return write_table(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def bounded(parts: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches of so many rows at most, so that the Python form of very long texts stays small."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same where all characters are ASCII, and is much faster there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], n_rows: int, row_bytes: int, how: str = "left", spread: Column | None = None, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Join rows to groups (unique on keys, with a row count ``n``) although one group may own a third of the rows.

    groups must be a written table. If all of it fits ``bound`` bytes it is broadcast. Otherwise only the groups that
    own more than 1/cap of the rows are: as the counts add up to n_rows at most, these are cap groups at most, and cap
    is chosen so that they fit ``bound``. All other rows join by a shuffle, in which no key is hot.
    keys[0] must be a non-negative whole number; spread (a long) deals rows that are already matched over all tasks.
    """
    if groups.count() * row_bytes <= bound:
        return rows.join(F.broadcast(groups), keys, how)
    cap = max(1, bound // row_bytes)
    own = [c for c in groups.columns if c not in keys]
    heavy = groups.where(F.col("n") * cap > n_rows).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in own], F.lit(True).alias("_hot"))
    light = groups.where(F.col("n") * cap <= n_rows).withColumn("_cold", F.lit(True)).withColumnRenamed(keys[0], "_key")
    spread = F.xxhash64(*[F.col(c) for c in rows.columns[:1]]) if spread is None else spread
    first = rows.join(F.broadcast(heavy), keys, "left").withColumn("_key", F.when(F.col("_hot"), -1 - F.pmod(spread, F.lit(65536))).otherwise(F.col(keys[0])).cast(groups.schema[keys[0]].dataType))
    both = first.join(light, ["_key", *keys[1:]], "left")
    picked = [F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in own]
    if how == "inner":
        both = both.where(F.col("_hot") | F.col("_cold"))
    return both.select(*rows.columns, *picked)


def merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes], blob_bytes: int, most: int = 32 << 20) -> bytes:
    """All of parts' column blob, one of ``blob_bytes`` a task, as one blob: groups of ``most`` bytes are merged in tasks until one group is left for the driver."""
    fan = max(8, most // blob_bytes)
    parts = write_table(parts.select(F.monotonically_increasing_id().alias("key"), "blob"), "merged")

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("key").to_numpy(), kind="stable")
        blobs = rows.column("blob").to_pylist()
        return pa.table({"key": rows.column("key").slice(0, 1), "blob": pa.array([merge([blobs[i] for i in order])], pa.binary())})

    while (n := parts.count()) > fan:
        parts = write_table(parts.groupBy(F.pmod(F.xxhash64("key"), F.lit(-(-2 * n // fan)))).applyInArrow(run, "key bigint, blob binary"), "merged")
    return merge([r["blob"] for r in parts.orderBy("key").collect()])
