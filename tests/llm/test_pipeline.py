import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from riskloom.llm import quality
from riskloom.llm.common import with_row_id, write_table
from riskloom.llm.simhash import fingerprint

from .conftest import awkward_rows, words
from .test_dedup import low
from .test_models import brute_kneser_ney
from .test_search_and_packing import brute_containment

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_awkward_and_of_no_rows(spark, awkward, nothing, name):
    stage = STAGES[name]
    odd = ["row_id", "_row_id", "lost_row", "_gone", "_sha", "unit", "s.t"]
    rows = awkward.withColumns({c: F.lit(1) for c in odd})
    found = write_table(stage(spark, rows, SF), f"test-{name}")  # as run() does
    assert stage(spark, nothing, SF).count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert found.columns == rows.columns
        assert found.exceptAll(rows).count() == 0
    assert found.count() > 0


def test_exact_stage_leaves_one_row_for_each_text(spark, awkward):
    left = STAGES["exact_dedup"](spark, awkward, SF).collect()
    texts = [low(r["text"]) for r in left]
    assert len(texts) == len(set(texts)) and set(texts) == {low(r[1]) for r in awkward_rows()}


def test_rows_without_or_with_repeated_ids_are_judged_for_themselves(spark):
    import random

    rng = random.Random(8)
    base, own, other, item = (words(rng, 200) for _ in range(4))
    rows = [(1, base), (None, base + " more"), (None, own), (None, other), (7, base + " else"), (7, item), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r["text"])[:60] for r in STAGES["near_dedup"](spark, docs, SF).collect()) == sorted(str(x)[:60] for x in (base, own, other, item, None))
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([*rows, (7, benchmark), (None, benchmark + " x")], docs.schema)
    assert STAGES["decontamination"](spark, docs, SF).count() == len(rows)
    assert STAGES["exact_dedup"](spark, docs.union(docs), SF).count() == docs.count()


def test_row_ids_are_the_same_in_every_job(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = with_row_id(docs, "r").select("r", "doc_id"), with_row_id(docs.select("*"), "r")
    assert a.select("r").distinct().count() == docs.count() == b.select("r").distinct().count()
    again = with_row_id(spark.read.parquet(f"{SF}/documents.parquet"), "r").where("n_chars > 500").select("r", "doc_id")
    assert again.exceptAll(a).count() == 0


def brute_stages(docs, labels, benchmark, bounds, in_sample):
    """What the first four stages keep, by their definitions; the near stage up to links that SimHash does not find."""
    p3 = brute_kneser_ney([t for i, t, _ in docs if i in in_sample])
    import math

    kept = []
    for i, t, lang in docs:
        d = ["<b>", "<b>", *(t or "").encode().lower().decode().split(), "<e>"]
        perplexity = -sum(math.log(p3(*d[k - 2 : k + 1])) for k in range(2, len(d))) / (len(d) - 2)
        if perplexity <= bounds[lang] + 1e-7:
            kept.append((i, t))
    sizes = [len(kept)]
    last = {}
    for i, t in kept:
        last[low(t)] = max(i, last.get(low(t), i))
    kept = [(i, t) for i, t in kept if last[low(t)] == i]
    return sizes, kept


def shingle_classes(kept, limit):
    """Classes of (id, text) over links of 0.8 and more: all of them, and those within ``limit`` bits."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (low(t).split() for _, t in kept)]
    codes = [fingerprint(t) for _, t in kept]
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if root[i] != root[j] and (codes[i] ^ codes[j]).bit_count() <= limit and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


def test_pipeline_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000")
    docs = write_table(table, "small-documents")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    judged = quality.judge(docs, labels).collect()
    bounds = {r["lang"]: r["threshold"] for r in judged}
    trusted = with_row_id(docs, "row_id").join(labels.where("quality = 1"), "doc_id").select("row_id", "doc_id", "lang", F.length("text").alias("n"))
    sample = {r["doc_id"] for r in quality.trusted_sample(trusted, 2000, 8000).join(trusted, "row_id").collect()}
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    sizes, kept = brute_stages(rows, None, None, bounds, sample)

    left = docs
    for name in ("quality", "exact_dedup"):
        left = write_table(STAGES[name](spark, left, SF), f"test-{name}")
        sizes.append(left.count())
    assert sizes[0] == sizes[1] and {r["doc_id"] for r in left.collect()} == {i for i, _ in kept} and sizes[2] == len(kept)

    left = write_table(STAGES["near_dedup"](spark, left, SF), "test-near")
    stay = {r["doc_id"] for r in left.collect()}
    near, root = shingle_classes(kept, 8), shingle_classes(kept, 12)
    place = {i: k for k, (i, _) in enumerate(kept)}
    assert {root[place[i]] for i in stay} == set(root)  # of each class one stays at least,
    assert len(stay) <= len(set(near))  # and one only, where links are near enough to be found for sure

    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    leaks = {int(d) for d, *_ in brute_containment([(i, t) for i, t in kept if i in stay], items)}
    left = write_table(STAGES["decontamination"](spark, left, SF), "test-clean")
    assert {r["doc_id"] for r in left.collect()} == stay - leaks

    packed = STAGES["packing"](spark, left, SF).collect()
    by = {}
    for r in packed:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == stay - leaks
    for pieces in by.values():
        assert sum(p["length"] for p in pieces) == pieces[0]["doc_tokens"]
        assert all(len(p["ids"]) == p["length"] and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p["ids"])) == p["ids_crc32"] for p in pieces)


def test_stages_work_on_what_their_predecessor_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_table(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.4 * sizes[0]
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
