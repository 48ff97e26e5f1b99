"""Language identification by cross-parsing against suffix automata.

For each language a bounded sample of labelled text becomes a suffix automaton. A text is parsed, from left to right, into the
longest phrases that occur in the sample; the language that needs the fewest phrases, each weighted by the
logarithm of its sample's length and divided by the text's length (a cross-entropy in bits a byte), wins.

* The sample is the only thing that is learned: per language ``sample_bytes`` bytes of labelled rows, taken whole in the
  order of a hash of doc_id, the last one cut. About ``sample_docs`` rows a language are looked at, a share by hash from
  counts over all labelled rows; so no language is ordered in a task. The automata together take ``table_bytes`` bytes at
  most and are broadcast; only where many languages would exceed that do all samples shrink alike.
* Whole texts are parsed. Blocks of ``block`` bytes run side by side as vectors, each as if a phrase began with it; then
  the phrase that really crosses a block's border is followed until both parses begin a phrase at one place, from
  where on they are the same. So the phrases are those of one parse of the whole text, whatever the block.
* There is no shuffle of texts, so nothing can be hot.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything when nothing was
learned. Ties go to the language whose name is first. Null doc_ids count as training rows; repeated rows are judged each
for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import bounded

MAX_LANGUAGES = 512


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions by state; state 0 is the root. Every path from the root spells a substring of data."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class CrossParser:
    """The automata of all languages as tables of transitions: state x symbol -> state, or -1."""

    def __init__(self, samples: dict[str, bytes], table_bytes: int, block: int = 1024):
        self.languages = sorted(samples)
        self.block = block
        self.symbols, self.tables, self.firsts, self.bits = [], [], [], []
        for name in self.languages:
            alphabet = sorted(set(samples[name]))
            most = max(64, table_bytes // (len(samples) * (len(alphabet) + 1) * 4 * 2))  # an automaton has two states a byte at most
            data = samples[name][:most]
            symbol = np.full(256, len(alphabet), np.int64)
            symbol[alphabet] = np.arange(len(alphabet))
            moves = suffix_automaton(data)
            table = np.full((len(moves) + 1, len(alphabet) + 1), -1, np.int32)
            for k, m in enumerate(moves):
                for c, to in m.items():
                    table[k, symbol[c]] = to
            first = table[0].copy()
            first[first < 0] = len(moves)  # after a symbol that the sample lacks: a phrase of its own, which the next symbol ends
            self.symbols.append(symbol)
            self.tables.append(table.reshape(-1))
            self.firsts.append(first)
            self.bits.append(np.log2(max(2, len(data))))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """(language, text) -> the number of phrases."""
        out = np.zeros((len(self.languages), len(texts)), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        whole = np.frombuffer(b"".join(texts), np.uint8)
        blocks = -(-sizes // self.block)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = (np.cumsum(sizes) - sizes)[owner] + nth * self.block
        length = np.minimum(self.block, sizes[owner] - nth * self.block)
        order = np.argsort(-length, kind="stable")
        live = np.searchsorted(-length[order], -np.arange(self.block), "left")  # blocks longer than t
        for k in range(len(self.languages)):
            codes, table, first = self.symbols[k][whole], self.tables[k], self.firsts[k]
            width = len(first)
            state = np.zeros(len(owner), np.int32)
            begins = np.zeros(len(whole) + 1, bool)
            for t in range(int(length.max(initial=0))):
                mine = order[: live[t]]
                spot = at[mine] + t
                c = codes[spot]
                if t:
                    new = table[state[mine] * np.int64(width) + c]
                    ends = new < 0
                    state[mine] = np.where(ends, first[c], new)
                    begins[spot] = ends
                else:
                    state[mine] = first[c]
                    begins[spot] = True
            before = np.concatenate(([0], np.cumsum(begins)))
            count = before[at + length] - before[at]
            for b in np.nonzero(nth > 0)[0].tolist():
                count[b], state[b] = self._joined(k, codes, begins, before, int(at[b]), int(at[b] + length[b]), int(state[b - 1]), int(state[b]))
            out[k] = np.bincount(owner, count, len(texts))
        return out

    def _joined(self, k: int, codes: np.ndarray, begins: np.ndarray, before: np.ndarray, at: int, end: int, state: int, last: int) -> tuple[int, int]:
        """How many phrases begin in a block that is entered in a state, and the state it is left in. last: that of its own parse."""
        table, first = self.tables[k], self.firsts[k]
        width, n = len(first), 0
        for x in range(at, end):
            c = int(codes[x])
            to = int(table[state * width + c])
            if to >= 0:
                state = to
                continue
            if begins[x]:  # both parses begin a phrase here
                return n + int(before[end] - before[x]), last
            n += 1
            state = int(first[c])
        return n, state

    def entropies(self, texts: list[bytes]) -> np.ndarray:
        """(language, text) -> bits a byte; texts must not be empty."""
        return self.phrases(texts) * np.array(self.bits)[:, None] / np.array([len(t) for t in texts])


def language_samples(docs: DataFrame, sample_docs: int, sample_bytes: int) -> dict[str, bytes]:
    """docs: training rows (doc_id, text, lang). About sample_docs rows a language, sample_bytes bytes of them at most."""
    rows = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: are these language labels?")
    out: dict[str, list[tuple]] = {r["lang"]: [] for r in counts}
    if not out:
        return {}
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1 << 30, -(-2 * sample_docs << 30) // r["n"]))])
    turn = F.xxhash64("doc_id", F.lit("sample"))
    some = rows.where(F.pmod(turn, F.lit(1 << 30)) < share[F.col("lang")])
    for r in some.select("lang", turn.alias("turn"), F.xxhash64("text").alias("tie"), F.substring("text", 1, sample_bytes).alias("text")).collect():  # about 2 x sample_docs rows a language
        out[r["lang"]].append((r["turn"], r["tie"], r["text"]))
    return {k: b"\n".join(x[2].encode("utf-8", "surrogatepass").lower() for x in sorted(v))[:sample_bytes] for k, v in out.items() if v}


def identify(docs: DataFrame, held_out: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 48, sample_bytes: int = 24_000, table_bytes: int = 192 << 20) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (the runner-up's share of the entropy of the best two)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).withColumn("held_out", held_out(F.col("doc_id")))
    samples = language_samples(docs.where(~F.col("held_out")), sample_docs, sample_bytes)
    parser = spark.sparkContext.broadcast(vars(CrossParser(samples, table_bytes)))  # plain arrays
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CrossParser.__new__(CrossParser)
        vars(own).update(parser.value)
        for part in bounded(parts):
            texts = part.column(1).to_pylist()
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if t and own.languages and any(map(str.isalpha, t))]
            if at:
                bits = own.entropies([texts[i].encode("utf-8", "surrogatepass").lower() for i in at])
                best = bits.argmin(axis=0)
                two = np.sort(bits, axis=0)[:2]
                sure = np.ones(len(at)) if len(own.languages) == 1 else two[1] / np.maximum(two.sum(axis=0), 1e-12)
                for j, i in enumerate(at):
                    names[i], scores[i] = own.languages[best[j]], float(sure[j])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
