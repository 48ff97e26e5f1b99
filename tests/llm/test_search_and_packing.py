import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm.decontamination import contained_items, shingle_hashes, signature, width_of, words_of
from riskloom.llm.packing import SPECIAL, Encoder, binary_lengths, pack, vocabulary_path, write_buckets
from riskloom.llm.sharding import claim_slots, place

from .conftest import awkward_rows
from .test_dedup import low


def shingles(text, n=5):
    w = [x for x in low(text).replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def runs_of(text, n):
    w = [x for x in low(text).replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_containment(docs, items):
    out = {}
    for d, text in docs:
        for i, item in items:
            s = shingles(item)
            if not s:
                continue
            n = len(next(iter(s)))
            own = shingles(text) | (runs_of(text, n) if n < 5 else set())
            if len(s & own) >= 0.8 * len(s):
                out[d, i] = max(out.get((d, i), (0, 0)), (len(s & own), len(s)))
    return sorted((str(d), str(i), *v) for (d, i), v in out.items())


@pytest.mark.parametrize("bound", [16 << 20, 0])
def test_decontamination_equals_brute_force(awkward, benchmark_items, bound):
    found = sorted((str(r["doc_id"]), str(r["item_id"]), r["n_shared"], r["n_item"]) for r in contained_items(awkward, benchmark_items, bound=bound).collect())
    want = brute_containment([r[:2] for r in awkward_rows()], [tuple(r) for r in benchmark_items.collect()])
    assert found == want and len(want) > 8


def test_decontamination_of_nothing(nothing, awkward, benchmark_items):
    assert contained_items(nothing, benchmark_items).count() == 0
    assert contained_items(awkward, benchmark_items.limit(0)).count() == 0


def test_signature_has_the_least_hash_of_every_bucket(awkward):
    rows = awkward.select(shingle_hashes(words_of(F.col("text")), 5, []).alias("h")).withColumn("w", width_of(F.size("h"))).withColumn("s", signature(F.col("h"), F.col("w"))).collect()
    for r in rows:
        least = {}
        for h in r["h"]:
            b = h >> (64 - r["w"])
            least[b] = min(h, least.get(b, h))
        assert sorted(least.values()) == r["s"]


def test_decontamination_stays_native(awkward, benchmark_items):
    plan = contained_items(awkward, benchmark_items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.fixture(scope="module")
def packed(awkward):
    return pack(awkward).collect()


def test_packing_round_trip(packed):
    from tokenizers import Tokenizer
    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc = {}
    for r in packed:
        by_doc.setdefault(r["doc_id"], []).append(r)
    once = [r for r in awkward_rows() if sum(x[0] == r[0] for x in awkward_rows()) == 1]
    for r in once:
        want = [*reference.encode(r[1] or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[r[0]], key=lambda x: x["start"])
        assert [i for p in own for i in p["ids"]] == want
        assert [p["length"] for p in own] == binary_lengths(len(want), 1024)
        assert all(p["doc_tokens"] == len(want) and p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in own)


def test_sequences_are_single_pieces_of_a_power_of_two(packed):
    assert len({r["sequence_id"] for r in packed}) == len(packed)
    assert all(r["offset"] == 0 and r["length"] == 1 << r["bucket"] == len(r["ids"]) <= 1024 for r in packed)


def test_packing_of_nothing_and_of_repeated_rows(nothing, packed):
    assert pack(nothing).count() == 0
    assert sum(r["doc_id"] == 3 and r["start"] == 0 for r in packed) == 3


def test_long_texts_in_chunks_have_the_ids_of_the_whole():
    import public_tokenizers

    encoder = Encoder(vocabulary_path(), public_tokenizers.PATTERN, SPECIAL)
    text = next(r[1] for r in awkward_rows() if r[1] and len(r[1]) > 100_000) + " it's 12,345  naïve\n\n text " * 50
    assert list(encoder.ids(text)) == list(encoder.ids(text, chunk=1000))
    for odd in ("x" * 300_000, " " * 300_000, "é" * 100_000):
        assert len(encoder.ids(odd)) > 0


def test_ids_are_those_of_the_tokenizer_file():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Encoder(vocabulary_path(), public_tokenizers.PATTERN, SPECIAL)
    rng = random.Random(1)
    texts = ["<|endoftext|>", "foo <|endoftext|> bar", "a<|endoftext|><|endoftext|>b ", "<|endoftext|", "x  <|endoftext|>\n y", ""]
    texts += ["".join(rng.choice(["<|endoftext|>", " ", "  ", "\n", "'s", "it", "É", "½", "١٢", "你好", "\u200b", "\t", "ab1", "😀", "\xa0", "ſ", "ǅ"]) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    for t in texts:
        assert list(ours.ids(t)) == theirs.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("run", [" ", "\n", " \n", "\u3000", "中", "x", "7", "!"])
def test_long_runs_have_the_ids_of_the_tokenizer_file(run):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Encoder(vocabulary_path(), public_tokenizers.PATTERN, SPECIAL)
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for n in (4096, 1_000_000 if run in " \n" else 50_000):
        some = run * (n // len(run))
        for text in (f"ab{some}cd", some, f"{some}<|endoftext|>{some[:4500]}z", f"a{some[:-1]}.\t{some[:4096]}"):
            assert encoder.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_a_document_of_blanks_is_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "a" + "\n" * 1_500_000 + "b")], "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in pack(docs, with_ids=False).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == {1: 1_000_001, 2: 1 + 750_000 + 1 + 1 + 1}  # a, pairs of line ends and one alone, the last line end, b, the end id


def test_buckets_are_written_by_length(awkward, tmp_path, spark):
    write_buckets(pack(awkward), f"file://{tmp_path}/out", 2)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.where("length <> shiftleft(1, bucket)").count() == 0 and back.count() > 100


def brute_slots(shards, size):
    """The table by its definition: whole permutations, then turns."""
    from riskloom.llm.sharding import _number

    rows = [[(_number(f"offset {s}") + j * (_number(f"step {s}") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    owner = [None] * size
    while None in owner:
        for i, row in enumerate(rows):
            free = next((x for x in row if owner[x] is None), None)
            if free is not None:
                owner[free] = i
    return owner


def test_slots_equal_the_definition_and_are_even():
    names = [f"shard-{i:02d}" for i in range(7)]
    table = claim_slots(names, 211)
    assert table == brute_slots(names, 211)
    sizes = [table.count(i) for i in range(7)]
    assert max(sizes) - min(sizes) <= 1


def test_removing_a_shard_moves_little():
    names = [f"shard-{i:02d}" for i in range(64)]
    before, after = claim_slots(names, 8191), claim_slots(names[:-1], 8191)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 63)
    assert moved < 0.1 * 8191


@pytest.mark.parametrize(("shards", "size"), [([], 11), (["a", "a"], 11), (["a"], 10), (["a", "b", "c"], 3)])
def test_bad_tables_are_refused(shards, size):
    with pytest.raises(ValueError):
        claim_slots(shards, size)


def test_place_keeps_rows_and_columns(awkward, nothing):
    names = [f"s{i}" for i in range(5)]
    found = place(awkward.withColumn("shard", F.lit("mine")).withColumn("at_slot", F.lit(1)).withColumn("_slot", F.lit(2)).withColumn("a.b", F.lit(3)), names, 101)
    assert found.count() == len(awkward_rows()) and set(awkward.columns) | {"at_slot", "_slot", "a.b"} < set(found.columns)
    assert found.where("at_slot = 1 AND _slot = 2").count() == found.count()
    assert found.groupBy("doc_id").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    assert place(nothing, names, 101).count() == 0


def test_short_items_widen_signatures():
    from riskloom.llm.decontamination import extra_width

    assert extra_width(11, 0.8) == 1 and extra_width(1, 0.8) == 13 and extra_width(4, 0.8) == 3
