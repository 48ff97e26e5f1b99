"""Exact dedup by distributed MSD radix partitioning.

The key of a text is its byte length followed by its bytes. Level 1 splits all documents by the length and the first
``first`` bytes; each further level splits what is still together by the next, ``growth`` times wider, slice. A group
is done when it is a singleton or its bytes have ended. Equality is decided by the bytes themselves, never by a digest.

* Level 1 shuffles only (length, slice) of each document. The text of a document is read again only if another one
  shares its length and first slice, so the later levels touch little besides true copies.
* A group of copies may own a third of all rows: its counts are combined before the shuffle, and ``common.lookup``
  brings its result to its rows by a broadcast of bounded size.
* Each level leaves behind only its result; the texts it worked on are removed.
* The number of levels is logarithmic in the longest copied text; each level reads a table in the shared folder.

Defined results: a null text counts as empty; null doc_ids count as smallest; of rows that agree in text and doc_id
exactly one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_lower, free_name, lookup, remove_table, with_row_id, write_table


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The groups of two rows and more: their size, the row that stays, and an id of their own, ``next``."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("rid", "doc_id"), F.min("rid")).alias("keep_rid"))
    return write_table(out.where("n > 1").withColumn("next", F.monotonically_increasing_id()), "radix-groups")


def _result(rows: DataFrame) -> DataFrame:
    """rows: with n and the keeper of their group, null for singletons."""
    return rows.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("rid").alias("row_id"),
    )


def text_digest(text: Column) -> Column:
    """SHA-256 of a text's normalised form, as reported in text_sha256 (it plays no part in finding copies)."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def radix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 32, growth: int = 32, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, row_id (the values of row_col, or of with_row_id)."""
    row = row_col or free_name(docs, "row_id")
    docs = docs if row_col else with_row_id(docs, row)
    body = docs.select(F.col(row).alias("rid"), F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("body"))
    body = body.withColumn("len", F.octet_length("body")).withColumn("head", F.expr(f"substring(body, 1, {first})")).withColumn("sha", F.sha2("body", 256))
    spine = write_table(body.select("rid", "doc_id", "len", "head", "sha"), "radix-spine")
    groups = _groups(spine, ["len", "head"])
    n_rows = spine.count()
    tagged = lookup(spine, groups, ["len", "head"], n_rows, first + 96, "left", F.xxhash64("rid"))
    ended = F.col("n").isNull() | (F.col("len") <= first)
    out = [_result(tagged.where(ended))]
    longer = groups.where(F.col("len") > first)
    live = longer.count() > 0
    if live:
        keys = write_table(longer.select("len", "head", "n", F.col("next").alias("gid")), "radix-keys")
        left = lookup(body, keys, ["len", "head"], n_rows, first + 64, "inner", F.xxhash64("rid"))
        rows = write_table(left.select("gid", "rid", "doc_id", "sha", F.expr(f"substring(body, {first + 1})").alias("rest")), "radix-level")
    width = first
    while live:
        width *= growth
        rows = rows.withColumn("slice", F.expr(f"substring(rest, 1, {width})"))
        groups = _groups(rows, ["gid", "slice"])
        tagged = lookup(rows, groups, ["gid", "slice"], rows.count(), width + 96, "left", F.xxhash64("rid"))
        ended = F.col("n").isNull() | (F.octet_length("rest") <= width)
        out.append(write_table(_result(tagged.where(ended)), "radix-ended"))
        more = tagged.where(~ended).select(F.col("next").alias("gid"), "rid", "doc_id", "sha", F.expr(f"substring(rest, {width + 1})").alias("rest"))
        after = write_table(more, "radix-level")
        remove_table(rows)
        remove_table(groups)
        rows = after
        live = rows.count() > 0
    done = out[0]
    for x in out[1:]:
        done = done.unionByName(x)
    return done
