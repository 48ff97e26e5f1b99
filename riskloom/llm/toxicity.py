"""Toxicity scores of deobfuscated text.

1. Noisy channel: a word with leetspeak, separators or repeated letters, and a run of single spaced letters, is a
   lattice: each character may stand for letters it is known to replace, may be a separator to drop, or may repeat the
   letter before it. Viterbi decoding under a character trigram model picks the restored letters.
2. The character model counts the trigrams of all labelled training rows; where they are more than MODEL_GRAMS, those with the least counts, told by a histogram, are left to the smoothing.
3. Evidence: how many toxic and how many other labelled training documents hold each restored word, counted over all of
   them by Spark, and the same for word beginnings. A feature's strength is its smoothed share of toxic documents;
   features with too little support keep near the prior. Only features that speak for toxicity are kept: those above
   ``least`` with a support of ``support`` documents. They are broadcast if they fit ``bound`` bytes; beyond it words meet
   them by a shuffle, to the same result.
4. A document falls in a cell by its strongest feature and by how many of its distinct words are toxic rather than not.
   Its score is the cell's share of toxic documents among all labelled training documents, smoothed by the share of its
   number of words, and that by the prior. To that end each training document is placed by evidence that leaves out the
   FOLDS-th of the documents, by a hash, to which it belongs; so no document speaks for itself. Cells are a few hundred
   at most, whatever the data.

Counts are combined per task before the shuffle, so a word in every document is one row a task. Scoring is row by row while the
features are broadcast.

Defined results: a null or empty text gets the prior (0.5 without any labelled training row); labels that are null or not
0 or 1 are ignored, and a doc_id with several labels counts as toxic if one of them is; null doc_ids have no label; repeated rows are scored each for itself; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import BROADCAST_BYTES, bounded, lookup, with_row_id, write_table

#: What a character may stand for, besides itself.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "&": "a", "^": "a",
}
SEPARATORS = frozenset(".-_*~'`,/\\:; ")
#: Costs in natural logs: a substituted letter, a dropped separator, a dropped repeat, a kept non-letter.
SUBSTITUTED, DROPPED, REPEATED, ODD = 1.0, 0.7, 1.0, 9.0
FOLDS = 4
PREFIXES = (4, 5, 6)
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+])(?:[ .\-_*]{1,2}(?:[^\W_]|[@$!|+])){2,}(?!\S)")
_TRIPLE = re.compile(r"(.)\1\1")
_CACHE = 300_000
#: Trigrams of the character model, which is broadcast.
MODEL_GRAMS = 1 << 19


class CharModel:
    """Interpolated character trigrams: logp(c | two letters before), from counts that are given."""

    def __init__(self, counts: dict[str, int]):
        self.tri = counts
        self.two: Counter[str] = Counter()
        self.mid: Counter[str] = Counter()
        self.one: Counter[str] = Counter()
        for k, n in self.tri.items():
            self.two[k[:2]] += n
            self.mid[k[1:]] += n
            self.one[k[2]] += n
        self.before: Counter[str] = Counter()
        for k, n in self.mid.items():
            self.before[k[0]] += n
        self.total = sum(self.one.values())
        self._seen: dict[str, float] = {}

    @staticmethod
    def grams(word: str) -> Iterator[str]:
        w = f"  {word} "
        return (w[i : i + 3] for i in range(len(w) - 2))

    def logp(self, gram: str) -> float:
        found = self._seen.get(gram)
        if found is None:
            p1 = (self.one[gram[2]] + 0.1) / (self.total + 20)
            p2 = (self.mid[gram[1:]] + 2 * p1) / (self.before[gram[1]] + 2)
            found = math.log((self.tri.get(gram, 0) + 2 * p2) / (self.two[gram[:2]] + 2))
            if len(self._seen) < _CACHE:
                self._seen[gram] = found
        return found


def options(c: str, before: str) -> list[tuple[str, float]]:
    """What an observed character may be, with costs; an empty string drops it. before: the observed one before it."""
    out = [(x, SUBSTITUTED) for x in STANDS_FOR.get(c, "")]
    if c in SEPARATORS:
        out.append(("", DROPPED))
    elif c.isalpha():
        out.append((c, 0.0))
    else:
        out += [(c, ODD), ("", ODD)]
    if c == before:
        out.append(("", REPEATED))
    return out


def decode(span: str, model: CharModel) -> str:
    """The most likely restored letters of an observed span, by Viterbi over (last two letters)."""
    states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}  # cost and the letters so far, last first
    before = ""
    for c in span:
        after: dict[str, tuple[float, tuple | None]] = {}
        for pair, (cost, way) in states.items():
            for x, extra in options(c, before):
                new = pair if not x else pair[1] + x
                now = cost + extra - (model.logp(pair + x) if x else 0.0)
                if new not in after or now < after[new][0]:
                    after[new] = (now, (x, way) if x else way)
        states, before = after, c
    ends = [(cost - model.logp(pair + " "), way) for pair, (cost, way) in states.items()]
    least = min(cost for cost, _ in ends)
    return min(_letters(way) for cost, way in ends if cost == least)


def _letters(way: tuple | None) -> str:
    out = []
    while way is not None:
        out.append(way[0])
        way = way[1]
    return "".join(reversed(out))


class Restorer:
    """Restores the words of a text; what it has decoded is kept, up to a bound."""

    def __init__(self, model: CharModel):
        self.model = model
        self.seen: dict[str, str] = {}

    def word(self, token: str) -> str:
        found = self.seen.get(token)
        if found is None:
            found = self._restored(token.rstrip(".,;:!?%&#*\"')]}>…»").lstrip("\"'([{<«¿¡#*%&"))
            if len(self.seen) < _CACHE:
                self.seen[token] = found
        return found

    def _restored(self, token: str) -> str:
        if token.isalpha() and not _TRIPLE.search(token):
            return token
        odd = any(c in STANDS_FOR for c in token) or _TRIPLE.search(token) or any(c in SEPARATORS for c in token)
        return decode(token, self.model) if odd and any(map(str.isalpha, token)) and not token.isdigit() else token

    def words(self, text: str) -> set[str]:
        text = text.lower()
        spans = [decode(re.sub(r"[ .\-_*]", " ", m.group()), self.model) for m in _SPACED.finditer(text)]
        return {self.word(t) for t in set(text.split())} | set(spans)

    def text(self, text: str) -> str:
        """The restored text, words joined by blanks."""
        text = _SPACED.sub(lambda m: decode(re.sub(r"[ .\-_*]", " ", m.group()), self.model), text.lower())
        return " ".join(self.word(t) for t in text.split())


def features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) >= n]]


def _labelled(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column]) -> DataFrame:
    """docs with toxic: the labelled training rows."""
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = F.broadcast(own) if labels.count() * 32 <= BROADCAST_BYTES else own
    return docs.where(~held_out(F.col("doc_id"))).join(own, "doc_id")


def char_model(train: DataFrame) -> CharModel:
    """From all rows of train. Texts stay in their tasks; a task counts words, whose trigrams are counted once for each distinct word."""

    def grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        words: Counter[str] = Counter()

        def add() -> None:
            for token, n in words.items():
                token = token.strip(".,;:!?")
                if token.isalpha():
                    for gram in CharModel.grams(token):
                        found[gram] += n
            words.clear()

        for part in bounded(parts):
            for text in part.column(0).to_pylist():
                words.update((text or "").lower().split())
                if len(words) > _CACHE:
                    add()
        add()
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["gram", "n"])

    sums = train.select("text").mapInArrow(grams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    sums = write_table(sums, "character-counts")
    least, room = 64, MODEL_GRAMS
    sizes = {r["k"]: r["n"] for r in sums.groupBy(F.floor(F.log2("n") + 1e-9).alias("k")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    while least and room >= sizes.get(least - 1, 0):
        least -= 1
        room -= sizes.get(least, 0)
    sums = sums.where(F.col("n") >= (1 << least))
    return CharModel({r["gram"]: r["n"] for r in sums.toLocalIterator()})


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(FOLDS)).cast("int")


def evidence(train: DataFrame, model: CharModel) -> DataFrame:
    """(feature, toxic, other): labelled training documents that hold each feature, over all of them; arrays by fold."""
    sent = train.sparkSession.sparkContext.broadcast(model.tri)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(CharModel(sent.value))
        found: dict[tuple[int, int], Counter[str]] = {(f, t): Counter() for f in range(FOLDS) for t in (0, 1)}

        def flush() -> Iterator[pa.RecordBatch]:
            for fold in range(FOLDS):
                other, toxic = found[fold, 0], found[fold, 1]
                keys = list(other.keys() | toxic.keys())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([fold] * len(keys), pa.int32()), *[pa.array([c[k] for k in keys], pa.int64()) for c in (toxic, other)]], ["word", "fold", "toxic", "other"])
                other.clear()
                toxic.clear()

        for part in bounded(parts):
            for text, toxic, fold in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                found[fold, toxic].update(restore.words(text or ""))
            if sum(map(len, found.values())) > _CACHE:
                yield from flush()
        yield from flush()

    words = train.select("text", "toxic", _fold(F.col("doc_id")).alias("fold")).mapInArrow(count, "word string, fold int, toxic bigint, other bigint")
    words = words.groupBy("word", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    starts = F.array(F.col("word"), *[F.when(F.length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in PREFIXES])
    each = words.select(F.explode(F.array_compact(starts)).alias("feature"), "fold", "toxic", "other")
    sums = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("toxic", "other") for k in range(FOLDS)]
    return each.groupBy("feature").agg(*sums).select("feature", *[F.array(*[f"{c}{k}" for k in range(FOLDS)]).alias(c) for c in ("toxic", "other")])


def strong_features(found: DataFrame, prior: float, weight: float, least: float, support: int) -> DataFrame:
    """(feature, n, shares): the shares of toxic documents by all folds, then by all but each of them; 0 where it is not strong."""

    def share(leave: int | None) -> Column:
        toxic, other = (sum((F.get(c, k) for k in range(FOLDS) if k != leave), F.lit(0)) for c in ("toxic", "other"))
        s = (toxic + weight * prior) / (toxic + other + weight)
        return F.when((toxic + other >= support) & (s >= max(least, prior)), s).otherwise(0.0)

    n = sum((F.get(c, k) for c in ("toxic", "other") for k in range(FOLDS)), F.lit(0))
    out = found.where(n >= support).select("feature", n.alias("n"), F.array(*[share(k) for k in (None, *range(FOLDS))]).alias("shares"))
    return out.where(F.array_max("shares") > 0)


def in_cells(rows: DataFrame, model: CharModel, strong: DataFrame, bound: int) -> DataFrame:
    """rows (without text) with the cell (hits, top) of their text; variant: which of the shares count. rows: text, variant, row_id and more."""
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c != "text"]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    rows = rows.select(*kept, "text")
    if strong.count() * 64 > bound:
        return _cells_by_join(rows, kept, kinds, model, strong)
    table = {r["feature"]: tuple(r["shares"]) for r in strong.select("feature", "shares").toLocalIterator()}
    sent = spark.sparkContext.broadcast((model.tri, table))
    at = kept.index("variant")

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, table_ = sent.value
        restore, known, none = Restorer(CharModel(counts)), {}, (0.0,) * (FOLDS + 1)
        for part in bounded(parts):
            out = []
            for text, variant in zip(part.column(len(kept)).to_pylist(), part.column(at).to_pylist(), strict=True):
                shares = []
                for word in restore.words(text or ""):
                    s = known.get(word)
                    if s is None:
                        s = tuple(map(max, zip(none, *(table_[f] for f in features(word) if f in table_), strict=True)))
                        if len(known) < _CACHE:
                            known[word] = s
                    if s[variant]:
                        shares.append(s[variant])
                out.append(cell_of(shares))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32())], [*kept, "hits", "top"])

    return rows.mapInArrow(place, ", ".join([*(f"{c} {kinds[c]}" for c in kept), "hits int, top int"]))


def _cells_by_join(rows: DataFrame, kept: list[str], kinds: dict[str, str], model: CharModel, strong: DataFrame) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model.tri)

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(CharModel(sent.value))
        for part in bounded(parts):
            at, word, feature = [], [], []
            for i, text in enumerate(part.column(2).to_pylist()):
                for k, w in enumerate(restore.words(text or "")):
                    for f in features(w):
                        at.append(i)
                        word.append(k)
                        feature.append(f)
            spot = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(spot), part.column(1).take(spot), pa.array(word, pa.int32()), pa.array(feature, pa.string())], ["row_id", "variant", "word", "feature"])

    part = F.pmod(F.xxhash64("feature"), F.lit(1 << 30)).alias("part")
    each = rows.select("row_id", "variant", "text").mapInArrow(spread, f"row_id {kinds['row_id']}, variant int, word int, feature string").select(part, "feature", "row_id", "variant", "word")
    groups = write_table(strong.select(part, "feature", "n", "shares"), "toxic-parts")
    met = lookup(each, groups, ["part", "feature"], groups.agg(F.sum("n")).first()[0], 96, "inner", F.xxhash64("row_id"))
    words = met.groupBy("row_id", "word").agg(F.max(F.get("shares", F.col("variant"))).alias("s")).where("s > 0")
    top = F.least(F.max("s"), F.lit(1 - 1e-9))
    odds = F.greatest(F.lit(-1), F.least(F.lit(14), F.floor(2 * F.log(top / (1 - top))))).cast("int")
    cells = words.groupBy("row_id").agg(F.least(F.lit(5), F.count_if(F.col("s") > 0.5)).cast("int").alias("hits"), odds.alias("top"))
    return rows.drop("text").join(cells, "row_id", "left").select(*kept, F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("top", F.lit(-1)).alias("top"))


def cell_of(shares: list[float]) -> tuple[int, int]:
    """How many words' shares are over one half (5 stands for more), and the greatest share in half units of log-odds."""
    if not shares:
        return 0, -1
    top = min(max(shares), 1 - 1e-9)
    return min(5, sum(s > 0.5 for s in shares)), max(-1, min(14, math.floor(2 * math.log(top / (1 - top)))))


def cell_shares(cells: dict[tuple[int, int], tuple[int, int]], prior: float, weight: float) -> dict[tuple[int, int], float]:
    """cells: other and toxic documents of each cell. The share of each, smoothed by that of its number of words."""
    rows: dict[int, list[int]] = {}
    for (hits, _), (other, toxic) in cells.items():
        row = rows.setdefault(hits, [0, 0])
        row[0] += other
        row[1] += toxic
    above = {h: (t + weight * prior) / (o + t + weight) for h, (o, t) in rows.items()}
    out = {k: (t + weight * above[k[0]]) / (o + t + weight) for k, (o, t) in cells.items()}
    for hits in range(6):
        for top in range(-1, 15):
            out.setdefault((hits, top), above.get(hits, max([prior, *(v for h, v in above.items() if h < hits)])))
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", weight: float = 4.0, least: float = 0.3, support: int = 4, threshold: float = 0.7, bound: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    train = _labelled(docs, labels, held_out)
    totals = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    model = char_model(train)
    strong = write_table(strong_features(evidence(train, model), prior, weight, least, support), "toxic-features")
    rows = docs if strong.count() * 64 <= bound else with_row_id(docs, "row_id")  # rows that meet features by a shuffle need a name
    rows = rows if "row_id" in rows.columns else rows.withColumn("row_id", F.lit(0))
    placed = in_cells(_labelled(rows, labels, held_out).select("row_id", "toxic", (_fold(F.col("doc_id")) + 1).alias("variant"), "text"), model, strong, bound)
    found: dict[tuple[int, int], list[int]] = {}
    for r in placed.groupBy("hits", "top", "toxic").agg(F.count("*").alias("n")).collect():
        found.setdefault((r["hits"], r["top"]), [0, 0])[r["toxic"]] += r["n"]
    shares = cell_shares({k: (o, t) for k, (o, t) in found.items()}, prior, weight)
    cells = spark.createDataFrame([(h, t, min(1.0, s)) for (h, t), s in shares.items()], "hits int, top int, score double")
    every = in_cells(rows.select("row_id", "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(0).alias("variant"), "text"), model, strong, bound)
    out = every.join(F.broadcast(cells), ["hits", "top"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
