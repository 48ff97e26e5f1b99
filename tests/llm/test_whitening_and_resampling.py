"""Whitening against an eigenvalue routine, resampling against strings and CRCs of whole features."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import queries, resampling, whitening
from riskloom.llm.common import merged

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- whitening


def brute_whiten(rows):
    """{(position, component): (deviation, |whitened|, explained)} of lists of floats."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    centred = ((n * x - s) / n).astype(float)
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    e, vec = e[::-1], vec[:, ::-1]
    return n, deviation, centred @ vec, e


def check_whiten(found, vectors):
    """found: collected rows with vec_id the position in vectors."""
    n, deviation, projected, e = brute_whiten(vectors)
    k = min(8, len(vectors[0]))
    assert len(found) == n * k
    for r in found:
        i, c = r["vec_id"], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[i]
        assert r["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(projected[i, c] / math.sqrt(e[c])), rel=1e-6, abs=1e-7)
        assert r["identity_error"] <= 1e-9


def test_whitening_equals_eigenvalues(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(700, 12)) @ np.diag(np.arange(1, 13.0)) @ rng.normal(size=(12, 12)) + 5).tolist()
    rows = spark.createDataFrame([*enumerate(vectors), (1000, None), (1001, []), (1002, [1.0] * 11), (1003, [float("nan")] * 12), (1004, [float("inf")] * 12), (1005, [None] * 12)], "vec_id long, embedding array<double>").repartition(7)
    found = whitening.whiten(rows.withColumns({"n": F.lit("x"), "v": F.lit(1), "component": F.lit(None)}))
    check_whiten(found.collect(), vectors)


def test_the_query_equals_eigenvalues(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    found = queries.op11_embedding_whitening(spark, SF).collect()
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    check_whiten([r.asDict() | {"vec_id": place[r["vec_id"]]} for r in found], [r["embedding"] for r in rows])


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, 0.0), (2, 0, None, None, 0.0)]
    flat = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (5, [3.0, 2.0]), (5, [3.0, 2.0])], kind)).collect()
    assert len(flat) == 6 and all((r["whitened"] is None) == (r["component"] == 2) for r in flat)
    assert {r["explained"] for r in flat} == {0.0, 1.0} and max(r["identity_error"] for r in flat) < 1e-12
    huge = whitening.whiten(spark.createDataFrame([(i, [1e30 * (-1) ** i, float(i)]) for i in range(6)], kind)).collect()
    assert len(huge) == 12 and all(r["deviation"] is None for r in huge)


def test_rotations_of_hard_matrices():
    rng = np.random.default_rng(5)
    for d, scale in ((1, 0), (2, 0), (7, 3), (64, 12)):
        r = np.linalg.qr(rng.normal(size=(300, d)) * 10.0 ** -np.linspace(0, scale, d), mode="r")
        lengths, turns = whitening.jacobi(r)
        assert np.allclose(turns.T @ turns, np.eye(d), atol=1e-12)
        assert np.allclose(lengths, np.linalg.svd(r, compute_uv=False), rtol=1e-9)
    assert np.array_equal(whitening.jacobi(np.zeros((2, 3)))[0], np.zeros(3))


def test_deviations_beyond_machine_words():
    x = np.array([[1 << 40, 3], [-(1 << 40), 5]])
    n = 1 << 20
    want = [(n * int(a) - 7) ** 2 + (n * int(b) - 9) ** 2 for a, b in x]
    assert whitening.deviations(x, n, np.array([7, 9], object)) == [None if w >= 1 << 63 else w for w in want]
    small = np.array([[100, -3]])
    assert whitening.deviations(small, 10, np.array([1, 2], object)) == [(1000 - 1) ** 2 + (-30 - 2) ** 2]


def test_blobs_are_merged_in_several_rounds(spark):
    rows = spark.range(0, 500, 1, 50).select(F.col("id").cast("string").cast("binary").alias("blob"))
    found = merged(rows, lambda blobs: str(sum(map(int, blobs))).encode(), 1 << 22)
    assert int(found) == 499 * 250


# ---------------------------------------------------------------- resampling


def brute_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_buckets(text, buckets):
    w = brute_words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, buckets=10_000, least=20, percent=5):
    own, want = Counter(), Counter()
    for _, t in docs:
        own.update(brute_buckets(t, buckets))
    for t in target:
        want.update(brute_buckets(t, buckets))
    s, t = sum(own.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        each = brute_buckets(text, buckets)
        weight = sum(gain[b] for b in each)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(each), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(brute_words(text))])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def as_rows(found):
    return sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = queries.op12_importance_resampling(spark, SF)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert as_rows(found) == brute_resample(docs, target)


@pytest.mark.parametrize("percent", [0, 30, 100])
def test_resampling_of_awkward_rows(spark, awkward, benchmark_items, percent):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    target = [r["text"] for r in benchmark_items.collect()]
    found = resampling.resample(awkward.withColumns({"weight": F.lit("w"), "rank": F.lit(1), "place": F.lit(2)}), benchmark_items, buckets=97, percent=percent)
    assert as_rows(found) == brute_resample(docs, target, 97, percent=percent)


def test_resampling_of_empty_tables(spark, awkward, nothing, benchmark_items):
    assert resampling.resample(nothing, benchmark_items).count() == 0
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert as_rows(resampling.resample(awkward, nothing)) == brute_resample(docs, [])


def test_ranks_are_gapless_whatever_the_ties(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.lit(1).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), (F.col("id") % 3).alias("score"))
    from riskloom.llm.common import write_table

    found = resampling.ranked(write_table(rows.repartition(13), "ties"), F.col("n_words") >= 20, 2500).where("rank IS NOT NULL").orderBy("rank").collect()
    want = sorted(((-(i % 3), i) for i in range(5000)))[:2500]
    assert [(r["rank"], -r["score"], r["doc_id"]) for r in found] == [(k + 1, s, i) for k, (s, i) in enumerate(want)]


def test_shifted_crcs():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 2, 5, 31, 64, 1000, 70_000)]
    for a in words:
        crc = np.array([zlib.crc32(a)] * len(words), np.uint32)
        got = resampling.shifted(crc, np.array(list(map(len, words)))) ^ np.array([zlib.crc32(b) for b in words], np.uint32)
        assert got.tolist() == [zlib.crc32(a + b) for b in words]
