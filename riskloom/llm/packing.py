"""Sequence packing by power-of-two decomposition.

A document's token ids, with one end id, are cut into pieces whose lengths are powers of two: whole pieces of ``size``,
then the binary digits of what is left, largest first. Pieces of equal length form a bucket; each piece is a sequence of
its own, so no sequence crosses documents and none needs padding (a batch takes sequences from one bucket).

Tokenising and cutting happen row by row in Arrow batches: nothing is shuffled and no key can be hot. ``write_buckets``
deals the pieces by bucket and a salt, so that one bucket is written by many tasks.

Defined results: a null or empty text is the end id alone; repeated rows are packed again, each for itself; an empty
table gives an empty result; all other columns are ignored. Texts over ``chunk`` characters are encoded in chunks that
end where the pre-tokeniser always splits, and long runs of white space are encoded apart, so the ids are those of the whole text. A special token's string in a text is
that token's id, as the tokeniser's own file has it.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import bounded

#: The pre-tokeniser starts a new piece between a lower-case ASCII letter and one blank with a letter after it.
_SPLIT = re.compile(r"(?<=[a-z])(?= [A-Za-z])")
#: Runs of white space from this length on are cut out before the pre-tokeniser sees them, as its look-ahead needs memory for each character of a run.
LONG_RUN = 4096
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
#: Special tokens of the default vocabulary.
SPECIAL = {"<|endoftext|>": 50256}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Byte-level BPE by ranks; the string of a special token in a text is that token."""

    def __init__(self, path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.piece = tiktoken.Encoding("packing-piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.special = tuple(special)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode(text, allowed_special="all", disallowed_special=()), np.uint32)

    def ids(self, text: str, chunk: int = 1 << 18) -> np.ndarray:
        """The ids of a text. Of a run of white space all but its last character is one piece; at the end of the text, or before a special token, all of it."""
        out, at = [], 0
        for run in _BLANKS.finditer(text) if len(text) >= LONG_RUN else ():
            start, end = run.span()
            stop = end if end == len(text) or (self.special and text.startswith(self.special, end)) else end - 1
            out += [self._parts(text[at:start], chunk), np.array(self.piece.encode_ordinary(text[start:stop]), np.uint32)]
            at = stop
        return np.concatenate([*out, self._parts(text[at:], chunk)]) if out else self._parts(text, chunk)

    def _parts(self, text: str, chunk: int) -> np.ndarray:
        if len(text) <= chunk:
            return self._encode(text)
        out, at = [], 0
        while at < len(text):
            cut = _SPLIT.search(text, at + chunk)
            end = cut.start() if cut else len(text)
            out.append(self._encode(text[at:end]))
            at = end
        return np.concatenate(out)


def binary_lengths(n: int, size: int) -> list[int]:
    """Powers of two, size at most, in descending order, that add up to n."""
    rest = n % size
    return [size] * (n // size) + [1 << k for k in reversed(range(size.bit_length())) if rest >> k & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, path: str | None = None, pattern: str | None = None, special: dict[str, int] | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset, and ids if asked for.

    size: a power of two. path: the vocabulary, as base64 tokens with ranks; it must lie at the same place on all machines.
    special: strings of special tokens and their ids.
    sequence_id is unique and rises within a task; offset is 0, as a piece is a whole sequence.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    import public_tokenizers

    path, pattern, special = path or vocabulary_path(), pattern or public_tokenizers.PATTERN, SPECIAL if special is None else special
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", *["ids"] * with_ids]

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern, special)
        for part in bounded(parts, 256):
            at, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                own = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4")
                s = 0
                for n in binary_lengths(len(own), size):
                    at.append(i)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(own[s : s + n].tobytes()))
                    total.append(len(own))
                    if with_ids:
                        ids.append(own[s : s + n].astype(np.int32))
                    s += n
            n = pa.array(length, pa.int64())
            columns = [part.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), n, pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array([x.bit_length() - 1 for x in length], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    kinds = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bucket int" + ", ids array<int>" * with_ids
    return rows.mapInArrow(cut, kinds).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str, salts: int = 64) -> None:
    """Write sequences by bucket: bucket=k holds those of 2**k tokens."""
    packed.repartition(F.col("bucket"), F.pmod("sequence_id", F.lit(salts))).write.partitionBy("bucket").parquet(path)
