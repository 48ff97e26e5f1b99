"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

A test item is short and a document may be long, so their Jaccard similarity says little. As in containment search over
size partitions, documents are partitioned by the size of their shingle set, and each partition has its own signature
width: the hash range is cut into about as many buckets as a document of that size has shingles, and the signature keeps
the least hash of every bucket. An item's signatures of all widths are one list. A shingle that a document shares with an
item is its bucket's minimum with a chance of 3/4 or more, whatever the document's length, and an item of q shingles with
containment 0.8 has 0.8 q such chances. The shortest item sets how much wider signatures are, so that every item is missed with a
chance of 1e-4 at most. Matching minima give candidates; these are verified by the exact containment of the item's
shingle strings in the document's.

* Signatures are made in the row that holds the text: nothing but candidates (doc_id, item_id) is ever shuffled while
  the items' signatures fit ``bound`` bytes, which is checked; beyond it, the signatures of documents join by a shuffle.
* A passage that a third of all documents hold yields one candidate row for each of them, and no more.
* Items with fewer words than a shingle are one shingle: their whole word sequence. The documents' side has shingles of
  those lengths added only where such items exist.

Defined results: null or blank texts and items never match; items or documents that repeat are reported once for each
(doc_id, item_id); null ids are kept as null; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import BROADCAST_BYTES, ascii_lower, write_table

#: Smallest and largest exponent of a signature's width.
LEAST, MOST = 4, 30
#: Tasks over which one signature value is dealt where signatures join by a shuffle.
SALTS = 32


def words_of(text: Column) -> Column:
    """Words of a text: runs without ASCII white space, A-Z in lower case; empty for null and blank."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once although ``use`` names it inside lambdas."""
    return F.transform(F.array(value), use)[0]


def shingles_of(words: Column, n: int) -> Column:
    """The distinct shingles of n words, as strings; of fewer words, the whole sequence; of none, no shingle."""

    def made(w: Column) -> Column:
        several = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        whole = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.when(F.size(w) >= n, several).otherwise(whole))

    return _bind(words, made)


def _folded(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))


def shingle_hashes(words: Column, n: int, also: list[int]) -> Column:
    """A hash for each shingle of n words, from the words' hashes; of a shorter text, of its whole sequence.

    also: lengths under n, of which all sequences are hashed like the whole of such a text.
    """
    none = F.array().cast("array<bigint>")

    def made(h: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        out = F.when(F.size(h) >= n, several).when(F.size(h) > 0, F.array(_folded(h))).otherwise(none)
        for m in also:
            runs = F.transform(F.sequence(F.lit(1), F.size(h) - m + 1), lambda i, m=m: _folded(F.slice(h, i, m)))
            out = F.concat(out, F.when(F.size(h) >= m, runs).otherwise(none))
        return out

    return _bind(F.transform(words, lambda w: F.xxhash64(w)), made)


def width_of(size: Column, extra: int = 1) -> Column:
    """The signature width's exponent for a set of that size: 2**extra buckets a shingle at least."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(1)))) + extra, F.lit(LEAST)), F.lit(MOST)).cast("int")


def extra_width(least_item: int, threshold: float, miss: float = 1e-4) -> int:
    """Extra exponent for which an item of least_item shingles is missed with at most that chance.

    With 2**e buckets a shingle, a shared shingle is not its bucket's minimum with a chance of 2**-(e+1) at most, and an
    item is missed only if none of its shared ones is.
    """
    shared = max(1, math.ceil(threshold * least_item))
    return max(1, math.ceil(-math.log2(miss) / shared) - 1)


def signature(hashes: Column, width: Column) -> Column:
    """The least hash of every bucket; a bucket is a hash's top ``width`` bits."""
    bucket = lambda x: F.call_function("shiftright", x, 64 - width)
    return _bind(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: (i == 0) | (bucket(x) != bucket(F.get(s, i - 1)))))


def all_signatures(hashes: Column) -> Column:
    """(value, from_width) for each distinct hash: it is in the signatures of that width and all greater ones.

    A hash is its bucket's least at a width iff the next smaller hash differs in the top bits that make the bucket.
    """
    apart = lambda s, x, i: F.when(i == 0, F.lit(0)).otherwise(65 - F.length(F.bin(x.bitwiseXOR(F.get(s, i - 1)))))
    return _bind(F.sort_array(F.array_distinct(hashes)), lambda s: F.transform(s, lambda x, i: F.struct(x.alias("value"), apart(s, x, i).cast("int").alias("from_width"))))


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 5, threshold: float = 0.8, bound: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): items of which a document holds ``threshold`` of the distinct shingles or more."""
    tests = items.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    tests = write_table(tests.select("item_id", shingles_of(F.col("w"), words).alias("item_shingles"), shingle_hashes(F.col("w"), words, []).alias("h"), F.size("w").alias("n_words")), "items")
    short = sorted(r[0] for r in tests.where(F.col("n_words") < words).select("n_words").distinct().collect())  # fewer than ``words`` numbers

    extra = extra_width(tests.agg(F.min(F.size("item_shingles"))).first()[0] or 1, threshold)
    signed = docs.select(F.col(doc_id).alias("doc_id"), shingle_hashes(words_of(F.col(text)), words, short).alias("h"))
    signed = signed.select("doc_id", "h", width_of(F.size("h"), extra).alias("width"))
    signed = signed.select("doc_id", "width", F.explode(signature(F.col("h"), F.col("width"))).alias("value"))
    probes = write_table(tests.select("item_id", F.inline(all_signatures(F.col("h")))), "item-signatures")
    if probes.count() * 64 <= bound:
        met = signed.join(F.broadcast(probes), "value")
    else:  # a passage that most documents hold is dealt over SALTS tasks
        salted = probes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = signed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["value", "salt"])
    candidates = met.where(F.col("width") >= F.col("from_width")).select("doc_id", "item_id").distinct()
    candidates = write_table(candidates, "candidates")

    pairs = F.broadcast(candidates) if candidates.count() * 48 <= bound else candidates
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    found = texts.join(pairs, F.col("_doc").eqNullSafe(F.col("doc_id")))
    sides = tests.select(F.col("item_id").alias("_item"), "item_shingles", "n_words")
    sides = F.broadcast(sides) if probes.count() * 256 <= bound else sides
    found = found.join(sides, F.col("item_id").eqNullSafe(F.col("_item")))
    own = lambda w: _bind(w, lambda v: _runs(v, words, short))
    shared = F.size(F.array_intersect("item_shingles", own(words_of(F.col("_text"))))).alias("n_shared")
    exact = found.select("doc_id", "item_id", shared, F.size("item_shingles").alias("n_item"))
    hits = exact.where(F.col("n_shared") >= F.col("n_item") * threshold)
    return hits.groupBy("doc_id", "item_id").agg(F.max("n_shared").cast("long").alias("n_shared"), F.max("n_item").cast("long").alias("n_item"))


def _runs(words: Column, n: int, also: list[int]) -> Column:
    """The shingles that an item's are held against; ``also`` as in shingle_hashes."""
    out = shingles_of(words, n)
    for m in also:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - m + 1), lambda i, m=m: F.array_join(F.slice(words, i, m), " "))
        out = F.concat(out, F.when(F.size(words) >= m, runs).otherwise(F.array().cast("array<string>")))
    return out
