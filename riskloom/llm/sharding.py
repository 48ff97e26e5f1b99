"""Sharding by a permutation-filled lookup table (the table of Maglev hashing).

Every shard has its own permutation of the slots of a prime-sized table, given by an offset and a step. The shards take
turns; at its turn a shard claims the first slot of its permutation that is still free. So slots are shared evenly
(shares differ by one slot at most) and adding or removing a shard moves few keys. A document goes to the shard that
owns slot ``hash(doc_id) mod size``: a broadcast join with the table, whose size is the parameter ``size``, in constant
time per row and without a shuffle, so no source or key can be hot.

Defined results: a null key has the hash of the empty string; equal keys share a shard; empty tables give empty results;
all input columns are kept, and the added columns replace input columns of the same names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free_name

#: Bound of the table that is broadcast.
MAX_SLOTS = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def claim_slots(shards: list[str], size: int) -> list[int]:
    """For each slot the position in ``shards`` of its owner. shards: distinct names; size: a prime above their count."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and there must be one at least")
    if not _is_prime(size) or not len(shards) < size <= MAX_SLOTS:
        raise ValueError(f"the table's size must be a prime above the number of shards, {MAX_SLOTS} at most")
    at = [_number(f"offset {s}") % size for s in shards]
    step = [_number(f"step {s}") % (size - 1) + 1 for s in shards]
    owner, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def place(docs: DataFrame, shards: list[str], size: int = 8191, key_col: str = "doc_id") -> DataFrame:
    """docs with the columns slot (int), shard (int, the position in shards) and shard_name."""
    spark = docs.sparkSession
    at = free_name(docs, "at_slot")
    table = spark.createDataFrame([(i, o, shards[o]) for i, o in enumerate(claim_slots(shards, size))], f"{at} int, shard int, shard_name string")
    digits = F.substring(F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit("")).cast("binary")), 1, 15)
    slot = F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size)).cast("int")
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {"slot", "shard", "shard_name"}]
    return docs.select(*rest, slot.alias(at)).join(F.broadcast(table), at).select(*rest, F.col(at).alias("slot"), "shard", "shard_name")


def write_shards(docs: DataFrame, path: str, shards: list[str], size: int = 8191, key_col: str = "doc_id") -> None:
    """Write one folder per shard; rows are dealt by shard and a salt, so a shard is written by several tasks."""
    placed = place(docs, shards, size, key_col)
    placed.repartition(F.col("shard"), F.pmod(F.xxhash64(F.col(key_col)), F.lit(16))).write.partitionBy("shard").parquet(path)
