"""The Jaccard join against brute force over all pairs of sets of strings."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import jaccard, queries

SF = "/root/testdata/sf0.001"


def brute_set(text, words=4):
    w = (text or "").encode().lower().split()
    if len(w) < words:
        return {b" ".join(w)} if w else set()
    return {b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(docs, percent=85, words=4):
    """Sorted (doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = [brute_set(t, words) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def rows_of(found):
    return sorted((tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def table(spark, texts, parts=6):
    return spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(parts)


def test_the_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op13_ngram_jaccard_join(spark, SF)
    assert found.columns == ["doc_id", "n_shingles", "component_id"] and rows_of(found) == brute(docs)


def test_awkward_rows(spark, awkward, nothing):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    odd = awkward.withColumns({"set_id": F.lit(1), "size": F.lit("s"), "row_id": F.lit(3), "part": F.lit(None), "prefix": F.lit(2)})
    assert rows_of(jaccard.link_classes(odd)) == brute(docs)
    assert jaccard.link_classes(nothing).count() == 0


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.5:
            out[at] = f"new{rng.randrange(10**9)}"
        elif kind < 0.75:
            out.insert(at, f"new{rng.randrange(10**9)}")
        elif len(out) > 1:
            del out[at]
    return out


@pytest.mark.parametrize(("seed", "percent"), [(0, 60), (1, 85)])
def test_texts_of_every_length_and_likeness(spark, seed, percent):
    """Chains and groups at all distances, so that light, heavy and mixed pairs lie on both sides of the threshold."""
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 3, 4, 8, 10, 13, 16, 20, 25, 40, 90]))]
        for _ in range(rng.randrange(1, 9)):
            texts.append(" ".join(base))
            base = edited(rng, base, rng.choice([0, 1, 1, 2, 5]))
    rng.shuffle(texts)
    assert rows_of(jaccard.link_classes(table(spark, texts), percent=percent)) == brute([*enumerate(texts)], percent)


@pytest.mark.parametrize("light", [0, 24])
def test_any_boundary_gives_the_same(spark, monkeypatch, light):
    rng = random.Random(9)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(8, 34))]
        texts += [" ".join(edited(rng, base, rng.randrange(3))) for _ in range(4)]
    monkeypatch.setattr(jaccard, "boundary", lambda *_: light)
    assert rows_of(jaccard.link_classes(table(spark, texts))) == brute([*enumerate(texts)])


def test_large_groups_hot_passages_and_cut_lists(spark, monkeypatch):
    """300 near copies of one text, some too far, beside 300 texts that are mostly one passage; lists are cut at 50 entries."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4]))) for _ in range(300)]
    texts += [" ".join(passage + [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([4, 8, 12, 30]))]) for _ in range(300)]
    made = []
    pairs = jaccard.open_pairs
    monkeypatch.setattr(jaccard, "open_pairs", lambda *a: made.append(pairs(*a)) or made[-1])
    monkeypatch.setattr(jaccard, "LIST_ROWS", 50)
    monkeypatch.setattr(jaccard, "MET", 8)
    found = rows_of(jaccard.link_classes(table(spark, texts)))
    assert found == brute([*enumerate(texts)])
    assert made


def test_a_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(edited(rng, base, 1)) for _ in range(600)]
    seen = []
    links = jaccard._Verifier.links
    monkeypatch.setattr(jaccard._Verifier, "links", lambda self, pairs: seen.append(pairs.count()) or links(self, pairs))
    found = jaccard.link_classes(table(spark, texts)).collect()
    assert {r["component_id"] for r in found} == {0} and sum(seen) < 20 * 600


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for n, m, both in ((1, 1, 0), (5, 9, 3), (280, 300, 260), (4000, 4700, 3900), (0, 4, 0)):
        every = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
        a, b = np.sort(every[:n]), np.sort(np.concatenate((every[:both], every[n : n + m - both])))
        for bits in (256, 512, 1 << 20):
            x, y = jaccard.odd_sketch(a), jaccard.odd_sketch(b)
            w = min(bits, 8 * len(x), 8 * len(y))
            apart = int(np.bitwise_count(jaccard.folded(x, w) ^ jaccard.folded(y, w)).sum())
            true = len(np.setxor1d(a, b))
            assert apart <= true and (w < 4 * n or apart >= 0.8 * true)


def test_subsets_are_exact():
    for percent in (60, 85, 95):
        for a in range(1, 30):
            for b in range(1, 40):
                c = jaccard.least_shared(a, b, percent)
                holds = [s for s in range(min(a, b) + 1) if 100 * s >= percent * (a + b - s)]
                assert (min(holds) if holds else None) == (c if c <= min(a, b) else None)
                assert (b in jaccard.partner_sizes(a, percent)) == (bool(holds) and not (a == b == c))
                if holds:
                    assert a - c + 1 <= jaccard.listed(a, percent)
    assert jaccard.boundary({13: 1000, 30: 1000}, 20.0, 85) == 13 and jaccard.boundary({}, 1.0, 85) == 0
