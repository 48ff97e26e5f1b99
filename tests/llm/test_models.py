import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import lm_scoring, quality
from riskloom.llm.language_id import CrossParser, identify, suffix_automaton
from riskloom.llm.lm_scoring import LogFrequencyFilter, held_out_expr, score_texts
from riskloom.llm.toxicity import CharModel, Restorer, cell_of, cell_shares, decode, score_toxicity

from .conftest import awkward_rows

SF = "/root/testdata/sf0.001"


def held(i, m, r):
    return i is not None and zlib.crc32(str(i).encode()) % m == r


def tokens(text):
    return [*(text or "").encode().lower().split(), b" end"]


@pytest.mark.parametrize("known_words", [1 << 20, 8])
def test_base_score_equals_brute_force(awkward, known_words):
    rows = awkward_rows()
    counts = Counter(t for r in rows if not held(r[0], 5, 1) for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    found = score_texts(awkward, lambda c: held_out_expr(c, 5, 1), known_words=known_words).collect()
    want = sorted((str(r[0]), held(r[0], 5, 1), len(tokens(r[1])), sum(counts[t] > 0 for t in tokens(r[1])), n, round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(r[1])), 6)) for r in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_scores_of_nothing_and_without_training_rows(nothing, awkward):
    assert score_texts(nothing, lambda c: held_out_expr(c, 5, 1)).count() == 0
    out = score_texts(awkward, lambda c: F.lit(True)).agg(F.max("train_tokens"), F.max("n_known"), F.count("*")).first()
    assert tuple(out) == (0, 0, len(awkward_rows()))


def test_scores_beat_the_baseline_on_held_out_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = score_texts(docs, lambda c: held_out_expr(c, 5, 1)).where("held_out").agg(F.sum("score").alias("a"), F.sum("base_score").alias("b")).first()
    assert out["a"] > out["b"]


def test_filter_returns_the_level_of_every_count():
    rng = np.random.default_rng(3)
    grams, counts = rng.integers(0, 2**63, 4000, dtype=np.int64).astype(np.uint64), rng.integers(1, 5000, 4000)
    bloom = LogFrequencyFilter(22, 1.5)
    bloom.insert(grams, counts)
    got = bloom.counts(grams)
    ratio = got / counts
    assert ((ratio > 0.6) & (ratio < 1.6)).mean() > 0.99 and (got > 0).all()
    assert (bloom.counts(rng.integers(0, 2**63, 4000, dtype=np.int64).astype(np.uint64)) == 0).mean() > 0.97


def test_counting_n_grams_takes_little_beside_them():
    """Sorted in place and told run by run: less than twice their own bytes, which a whole ``unique`` with counts exceeds."""
    rng = np.random.default_rng(3)
    held = [rng.integers(0, 1 << 62, 1 << 17).astype(np.uint64) | np.uint64(k % 2) for k in range(16)] + [np.arange(5, dtype=np.uint64)] * 3
    want = dict(zip(*(x.tolist() for x in np.unique(np.concatenate(held), return_counts=True)), strict=True))
    size = sum(x.nbytes for x in held)
    tracemalloc.start()
    found = {}
    n_rows = 0
    for grams, n in lm_scoring.tally(held, 1 << 12):
        n_rows += len(grams)
        if grams[0] == 0:
            found |= dict(zip(grams.tolist(), n.tolist(), strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * size and not held and n_rows == len(want) and all(want[k] == v for k, v in found.items()) and found[4] == 3
    assert list(lm_scoring.tally([np.array([], np.uint64)])) == []


def test_kept_word_counts_and_grouped_logarithms():
    rng = np.random.default_rng(3)
    words, counts = rng.integers(0, 2**62, 900, dtype=np.int64).astype(np.uint64) << np.uint64(1), rng.integers(1, 5000, 900)
    bloom = LogFrequencyFilter(22, 1.5)
    bloom.insert(words[:700], counts[:700])
    for most in (4, 300, 1 << 18):
        told = lm_scoring.WordCounts(bloom, most)
        for k in range(0, 900, 90):
            each = np.unique(np.concatenate([words[k : k + 90], words[:40]]))
            assert (told(each) == bloom.counts(each)).all() and len(told.names) <= most
    assert (lm_scoring.WordCounts(bloom)(np.zeros(0, np.uint64))).size == 0
    low = 10.0 ** rng.uniform(-38, -30, 1001)
    assert math.isclose(lm_scoring.log_sums(low, np.ones(1001)), np.log10(low).sum(), rel_tol=1e-12)


def test_scores_hold_no_broadcast(awkward):
    """What is returned is written: neither the filter nor the words are needed to read it, so calls do not add up."""
    out = score_texts(awkward, lambda c: held_out_expr(c, 5, 1))
    assert "MapInArrow" not in out._jdf.queryExecution().toString() and out.count() == awkward.count()


def test_rare_pairs_stay_outside_when_the_filter_is_small(awkward):
    counts = lm_scoring._count(awkward.select("text"))
    small, large = lm_scoring._thresholds(counts, 13, 1.5), lm_scoring._thresholds(counts, 26, 1.5)
    assert large == (22, 1, 1) and small[0] == 13 and small[1] >= 1 and small[2] > 1


def brute_scores(rows, base, prior):
    """The smoothed scores from exact counts, quantised as the filter does; keyed by the text."""
    train = [tokens(r[1]) for r in rows if not held(r[0], 5, 1)]
    ones, twos = Counter(t for d in train for t in d), Counter(p for d in train for p in zip([b" begin", *d], d))  # noqa: B905
    n, v = sum(ones.values()), len(ones)
    own = LogFrequencyFilter(16, base)
    level = lambda c: float(own._middle(LogFrequencyFilter.levels(np.array([c]), base))[0]) if c else 0.0
    out = {}
    for text in {r[1] for r in rows}:
        d, s = tokens(text), 0.0
        for h, w in zip([b" begin", *d], d):  # noqa: B905
            ch, chw = level(ones[b" end" if h == b" begin" else h]), level(twos[h, w])
            s += math.log10((chw + prior * (level(ones[w]) + 0.5) / (n + 0.5 * (v + 1))) / (max(ch, chw) + prior))
        out[text] = s
    return out


@pytest.mark.parametrize("max_bits", [31, 16])
def test_score_equals_brute_force(awkward, monkeypatch, max_bits):
    monkeypatch.setattr(lm_scoring, "PRIORS", (16.0,))
    monkeypatch.setattr(lm_scoring, "ITEM_BITS", 40)  # next to no false positives, to compare exactly
    monkeypatch.setattr(lm_scoring, "PROBES", 12)
    rows = awkward_rows()
    want = brute_scores(rows, 1.5, 16.0)
    found = score_texts(awkward, lambda c: held_out_expr(c, 5, 1), max_bits=max_bits).join(awkward.select("doc_id", "text").distinct(), "doc_id").collect()
    counts = lm_scoring._count(awkward.where(~held_out_expr(F.col("doc_id"), 5, 1)).select("text"))
    assert (lm_scoring._thresholds(counts, max_bits, 1.5)[2] > 1) == (max_bits == 16)  # small: some pairs stay outside the filter
    close = [abs(r["score"] - want[r["text"]]) <= 1e-6 + 2e-3 * abs(want[r["text"]]) for r in found]
    assert len(close) > 70 and sum(close) >= len(close) - 2


def test_suffix_automaton_knows_exactly_the_substrings():
    text = b"abracadabra abrac"
    moves = suffix_automaton(text)

    def inside(s):
        at = 0
        for c in s:
            at = moves[at].get(c, -1)
            if at < 0:
                return False
        return True

    pieces = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(map(inside, pieces)) and not any(inside(p + b"z") for p in pieces) and not inside(b"ada ")


def test_phrases_equal_a_plain_parse():
    samples = {"x": b"the cat sat on the mat and the hat", "y": b"el gato en la casa de la gata"}

    def plain(text, ref):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i : j + 1] in ref:
                j += 1
            n, i = n + 1, j
        return n

    texts = [b"the cat in the casa", b"zzz", b"la gata sat on the gato and the rest of it", b"e", samples["x"], samples["y"] * 3, b"the cat sat on the mat " * 9 + b"???"]
    want = [[plain(t, samples[k]) for t in texts] for k in ("x", "y")]
    for block in (3, 7, 16, 1024):  # the phrases are those of the whole text, whatever the block
        assert CrossParser(samples, 1 << 20, block=block).phrases(texts).tolist() == want


def test_language_of_held_out_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = identify(docs, lambda c: held_out_expr(c, 5, 0)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where(F.col("lang") == F.col("lang_pred")).count() >= 0.95 * out.count()


def test_language_of_awkward_rows(awkward, nothing):
    found = identify(awkward, lambda c: held_out_expr(c, 5, 0)).collect()
    assert len(found) == len(awkward_rows())
    texts = Counter((str(r[0]), r[1]) for r in awkward_rows())
    assert all(0 <= r["score"] <= 1 for r in found) and {r["lang_pred"] for r in found} <= {"en", "de", "und"}
    blank = {str(i) for i, t in texts if t is None or not any(c.isalpha() for c in t)}
    assert blank and all((r["lang_pred"] == "und") == (str(r["doc_id"]) in blank) for r in found)
    assert identify(nothing, lambda c: held_out_expr(c, 5, 0)).count() == 0
    assert {r["lang_pred"] for r in identify(awkward, lambda c: F.lit(True)).collect()} == {"und"}


@pytest.fixture(scope="module")
def letters():
    words = "the idiot and stupid loser of worthless trash is disgusting moron clown pathetic scum there here when what that this with".split()
    return CharModel(Counter(g for w in words for g in CharModel.grams(w)))


@pytest.mark.parametrize(("seen", "meant"), [("1d10t", "idiot"), ("$tupid", "stupid"), ("stuuuupid", "stupid"), ("l0ser", "loser"), ("tr@sh", "trash"), ("s-c-u-m", "scum"), ("m.o.r.o.n", "moron"), ("cl0wn!", "clown"), ("the", "the"), ("book", "book")])
def test_restored_words(letters, seen, meant):
    assert Restorer(letters).word(seen) == meant


def test_spaced_words_are_restored(letters):
    assert "idiot" in Restorer(letters).words("you are an i d i o t here")
    assert "stupid" in Restorer(letters).text("so S T U P 1 D indeed").split()


def test_viterbi_equals_trying_everything(letters):
    from itertools import product

    from riskloom.llm.toxicity import options

    for span in ("1d10t", "5cuum", "a.b0"):
        best = None
        for way in product(*[options(c, span[i - 1] if i else "") for i, c in enumerate(span)]):
            text = "".join(x for x, _ in way)
            cost = sum(c for _, c in way) - sum(letters.logp(g) for g in CharModel.grams(text))
            best = min(best or (cost, text), (cost, text))
        assert decode(span, letters) == best[1]


def test_toxicity_of_held_out_text(spark):
    docs, labels = spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{SF[:-5]}0.01/labels.parquet")
    out = score_toxicity(docs, labels, lambda c: held_out_expr(c, 3, 1)).join(labels, "doc_id").where("held_out")
    hit = out.groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in hit}
    assert n.get((0, 1), 0) <= 0.05 * (n.get((0, 0), 0) + n.get((0, 1), 0))
    assert n.get((1, 1), 0) >= 0.4 * (n.get((1, 0), 0) + n.get((1, 1), 0))


def test_features_meet_words_by_a_shuffle_too(spark):
    docs, labels = spark.read.parquet(f"{SF[:-5]}0.01/documents.parquet"), spark.read.parquet(f"{SF[:-5]}0.01/labels.parquet")
    a, b = (sorted(map(tuple, score_toxicity(docs, labels, lambda c: held_out_expr(c, 3, 1), bound=x).collect())) for x in (16 << 20, 0))
    assert [r[:2] + r[3:] for r in a] == [r[:2] + r[3:] for r in b] and all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(a, b, strict=True))


def test_long_spans_are_decoded_whole(letters):
    assert decode("m-o-r-o-n-" * 40, letters) == "moron" * 40


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    found = score_toxicity(awkward, labels, lambda c: held_out_expr(c, 3, 1)).collect()
    assert len(found) == len(awkward_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert score_toxicity(nothing, labels, lambda c: held_out_expr(c, 3, 1)).count() == 0
    bare = score_toxicity(awkward, labels.limit(0), lambda c: held_out_expr(c, 3, 1)).select("score").distinct().collect()
    assert [r["score"] for r in bare] == [0.5]


def test_cells():
    assert cell_of([]) == (0, -1) and cell_of([0.9, 0.6, 0.4]) == (2, 4)
    shares = cell_shares({(0, -1): (90, 0), (2, 4): (1, 19)}, 0.1, 4.0)
    assert shares[0, -1] < 0.02 and shares[2, 4] > 0.8 and shares[5, 9] >= 0.8


def brute_kneser_ney(texts):
    """log p of each text by the textbook formulas, and its number of tokens."""
    docs = [["<b>", "<b>", *[w.decode() for w in (t or "").encode().lower().split()], "<e>"] for t in texts]
    tri = Counter((d[i - 2], d[i - 1], d[i]) for d in docs for i in range(2, len(d)))
    bi, uni = Counter(), Counter()
    for (_, v, w), n in tri.items():
        bi[v, w] += n if v == "<b>" else 1  # raw counts after the begin mark
    uni.update(w for _, w in bi)

    def discounts(c):
        n = [0, *[sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]]
        if not n[1]:
            return 0.5, 0.75, 0.9
        y = n[1] / (n[1] + 2 * n[2])
        out = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else 0.5 * k**0.5 for k in (1, 2, 3)]
        return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(out, (1, 2, 3), strict=True))

    d1, d2, d3 = map(discounts, (uni, bi, tri))
    less = lambda n, d: d[min(n, 3) - 1]
    n1 = sum(uni.values())
    unknown = sum(less(n, d1) for n in uni.values()) / n1 / (len(uni) + 1)

    by = {}
    for c in (bi, tri):
        for k, n in c.items():
            by.setdefault(k[:-1], []).append(n)

    def level(c, history, d):
        mine = by.get(history, [])
        return (sum(mine), sum(less(n, d) for n in mine) / sum(mine)) if mine else (0, 1.0)

    def p1(w):
        return unknown + ((uni[w] - less(uni[w], d1)) / n1 if w in uni else 0)

    def p2(v, w):
        total, gamma = level(bi, (v,), d2)
        return gamma * p1(w) + ((bi[v, w] - less(bi[v, w], d2)) / total if (v, w) in bi else 0)

    def p3(u, v, w):
        total, gamma = level(tri, (u, v), d3)
        return gamma * p2(v, w) + ((tri[u, v, w] - less(tri[u, v, w], d3)) / total if (u, v, w) in tri else 0)

    return p3


def test_perplexity_equals_the_textbook_model(spark):
    train = ["a b c a b d", "a b c", "b c a", "c c c a b", "", "d a b c a", "a b"]
    test = [(1, "a b c"), (2, "z a b"), (3, ""), (4, None), (5, "c a b q q"), (6, "A B")]
    values, unknown = quality.kneser_ney_values(spark.createDataFrame([(t,) for t in train], "text string"))
    found = {r["doc_id"]: r for r in quality.perplexities(spark.createDataFrame(test, "doc_id long, text string"), values, unknown).collect()}
    p3 = brute_kneser_ney(train)
    for i, t in test:
        d = ["<b>", "<b>", *(t or "").lower().split(), "<e>"]
        want = -sum(math.log(p3(*d[k - 2 : k + 1])) for k in range(2, len(d))) / (len(d) - 2)
        assert found[i]["n_tokens"] == len(d) - 2 and abs(found[i]["log_perplexity"] - want) < 1e-6


def test_the_shuffled_join_gives_the_same(spark, awkward, monkeypatch):
    values, unknown = quality.kneser_ney_values(awkward.where("doc_id < 20").select("text"))
    docs = awkward.select("doc_id", "text")
    key = lambda df: sorted((str(r[0]), r[1], round(r[2], 6)) for r in df.collect())
    want = key(quality.perplexities(docs, values, unknown))
    monkeypatch.setattr(quality, "SHARD_ROWS", 100)
    assert key(quality.perplexities(docs, values, unknown)) == want
    monkeypatch.setattr(quality, "MODEL_BYTES", 0)
    assert key(quality.perplexities(docs, values, unknown)) == want


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([*[(i, 1) for i in range(40)], (41, 0), (None, 1), (42, None)], "doc_id long, quality int")
    found = quality.judge(awkward, labels, least_docs=5)
    rows = found.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in awkward_rows()) and any(r["kept"] for r in rows)
    assert len({r["row_id"] for r in rows}) == len(rows)
    assert quality.judge(nothing, labels).count() == 0
    assert quality.judge(awkward, labels.limit(0)).where("NOT kept").count() == 0


def test_languages_give_their_share_to_the_sample(spark):
    rows = [(i, i, "en" if i % 3 else "de" if i % 2 else f"x{i % 40}", 100) for i in range(6000)]
    trusted = spark.createDataFrame(rows, "row_id long, doc_id long, lang string, n long")
    n = {r["lang"]: r["count"] for r in quality.trusted_sample(trusted, 600, 8000).join(trusted, "row_id").groupBy("lang").count().collect()}
    assert 450 < sum(n.values()) < 750 and all(10 < x < 60 for x in n.values()) and len(n) == 22
    assert quality.trusted_sample(trusted, 10**6, 8000).count() == trusted.where(quality.to_train(F.col("doc_id"))).count()
    assert quality.trusted_sample(trusted.limit(0), 600, 8000).count() == 0


def test_quality_keeps_trusted_and_rejects_junk(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality.judge(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert n[1, True] >= 0.97 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.4 * (n.get((0, False), 0) + n.get((0, True), 0))


def test_character_model_counts_all_rows(spark):
    from riskloom.llm.toxicity import char_model

    train = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("abc, abc").alias("text"), F.lit(0).alias("toxic"))
    assert char_model(train).tri["abc"] == 6000


def test_weight_of_the_prior_is_fitted_on_all_training_rows(spark):
    """Rows that a sample of 2,000 by hash left out decide it: with a small weight, what follows a word in them is nearly sure."""
    out = F.pmod(F.xxhash64("doc_id", F.lit("tune")), F.lit(1 << 30)) >= (1 << 29)
    rows = spark.range(4000).select(F.col("id").alias("doc_id")).withColumn("text", F.when(out, F.repeat(F.lit("p q "), 20)).otherwise(F.concat(F.lit("w"), F.col("doc_id"))))
    rows = rows.unionByName(spark.createDataFrame([(-1, "p q p q p q")], "doc_id long, text string"))
    score = score_texts(rows, lambda c: c < 0).where("doc_id = -1").first()["score"]
    assert score > -2.5


def test_quality_trains_on_all_trusted_text_of_its_half(spark):
    """What is trusted beyond 2,000 documents, or in a document of over 8,000 characters, is known to the model."""
    trained = quality.to_train(F.col("doc_id"))
    one = spark.range(9000).select(F.col("id").alias("doc_id")).where(trained).limit(4000).withColumn("text", F.concat(F.lit("alpha beta w"), F.col("doc_id").cast("string"), F.lit(" gamma delta")))
    long_id = spark.range(9000, 9100).select(F.col("id").alias("doc_id")).where(trained).first()["doc_id"]
    words = " ".join(f"rare{i} word{i} here{i}" for i in range(600))
    docs = one.unionByName(spark.createDataFrame([(long_id, words)], "doc_id long, text string")).withColumn("lang", F.lit("en"))
    docs = docs.unionByName(docs.select((F.col("doc_id") + 100_000).alias("doc_id"), "text", "lang"))  # unlabelled twins
    labels = docs.where("doc_id < 100000").select("doc_id", F.lit(1).alias("quality"))
    unseen = spark.createDataFrame([(300_000, " ".join(f"never{i} seen{i}" for i in range(900)), "en"), (300_001, "alpha beta zzz gamma delta", "en")], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["log_perplexity"] for r in quality.judge(docs.unionByName(unseen), labels).collect()}
    assert found[long_id + 100_000] < found[300_000] / 2
    assert max(v for k, v in found.items() if 100_000 <= k < 109_000) < found[300_001]
