import hashlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import common
from riskloom.llm.exact_dedup import radix_dedup
from riskloom.llm.line_dedup import LineRuns, dedup_lines, line_hashes
from riskloom.llm.simhash import GrayTree, components, fingerprint, hierarchies, links, near_dedup

from .conftest import awkward_rows

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(x):
    return (x or "").translate(UPPER)


def check_exact(found, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    want = []
    for text, ids in groups.items():
        best = max((-1 if i is None else i) for i in ids)
        best = None if best < 0 else best
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in sorted(ids, key=lambda x: (x != best, str(x))):
            want.append((i, best, len(ids), first, sha))
            first = False
    key = lambda x: tuple(map(str, x))
    assert sorted(map(key, map(tuple, found.drop("row_id").collect()))) == sorted(map(key, want))


def test_exact_dedup_equals_brute_force(awkward):
    check_exact(radix_dedup(awkward), awkward_rows())


def test_exact_dedup_in_many_levels(awkward):
    check_exact(radix_dedup(awkward, first=2, growth=8), awkward_rows())


def test_exact_dedup_when_hot_groups_are_split_from_the_rest(spark, monkeypatch):
    monkeypatch.setattr(common.lookup, "__defaults__", ("left", None, 1000))
    rows = [(i, "same text " * 9 if i % 3 else f"text {i % 50} " * 9) for i in range(3000)]
    check_exact(radix_dedup(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_exact_dedup_of_nothing(nothing):
    assert radix_dedup(nothing).count() == 0


def brute_lines(rows, min_chars=20, min_docs=3):
    docs, last = defaultdict(set), {}
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            if len(k) >= min_chars:
                docs[k].add(r[0])
                last[k] = max(last.get(k, -1), -1 if r[0] is None else r[0])
    held = defaultdict(int, {k: len(v) for k, v in docs.items()})
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        mine = -1 if r[0] is None else r[0]
        kept = [x for x in lines if not (held[key(x)] >= min_docs and last[key(x)] != mine)]
        out.append((str(r[0]), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("bound", [16 << 20, 0])
def test_line_dedup_equals_brute_force(awkward, bound):
    found = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in dedup_lines(awkward, bound=bound).collect())
    assert found == brute_lines(awkward_rows())
    assert any(r[2] for r in found)


def test_rows_of_one_document_count_once(spark):
    line = "a line of more than twenty characters"
    rows = [(1, line), (1, line), (1, line + "\nx"), (2, line), (None, f"{line} two\n{line} two"), (None, f"{line} two"), (3, f"{line} two"), (4, f"{line} two")]
    found = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == brute_lines(rows)
    assert sum(r[2] for r in found) == 4  # those of null and 3; the first line is in two documents only


def test_line_dedup_leaves_no_run_behind(spark, awkward):
    before = {t.name for t in spark.catalog.listTables()}
    dedup_lines(awkward).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_line_dedup_of_nothing(nothing):
    assert dedup_lines(nothing).count() == 0


def test_line_runs_are_levelled_and_mark_fresh_keys(spark, awkward):
    hashes = line_hashes(awkward.select("doc_id", "text"), 20, 3)
    runs = LineRuns(hashes, buckets=4)
    shape = []
    for k in range(3):
        runs.ingest(hashes.where(F.col("batch") == k).select("doc_id", "h1", "h2"))
        shape.append([len(x) for x in runs.levels])
    assert shape == [[1], [0, 1], [1, 1]]
    totals = runs.totals()
    want = hashes.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    assert totals.select("h1", "h2", "n", "last").exceptAll(want).count() == 0
    assert want.count() == totals.where("fresh").count() == totals.count()


def test_runs_join_without_shuffling_a_run(spark, awkward):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hashes = line_hashes(awkward.select("doc_id", "text"), 20, 2)
        runs = LineRuns(hashes, buckets=8)
        runs.ingest(hashes.where("batch = 0").select("doc_id", "h1", "h2"))
        runs.ingest(hashes.where("batch = 1").select("doc_id", "h1", "h2"))
        a, b = runs.runs()[0], runs.runs()[0]
        plan = a.join(b.select("h1", "h2", F.col("n").alias("m")), ["h1", "h2"], "full_outer")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints_equal_brute_force():
    texts = {r[1] for r in awkward_rows() if r[1] is None or len(r[1]) < 5000}
    assert all(fingerprint(t) == brute_fingerprint(t) for t in texts)
    assert fingerprint(None) == fingerprint(" \n") == 0


def brute_components(pairs):
    """pairs: (doc_id, fingerprint) -> the smallest doc_id by document, links being two bits or fewer."""
    codes = sorted({f for _, f in pairs})
    up = {c: c for c in codes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return sorted((str(d), f, str(least.get(root(f)))) for d, f in pairs)


def test_near_dedup_equals_brute_force(awkward):
    found = sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), str(r["component_id"])) for r in near_dedup(awkward).collect())
    want = brute_components([(r[0], fingerprint(r[1])) for r in awkward_rows()])
    assert found == want


def test_near_dedup_of_nothing(nothing):
    assert near_dedup(nothing).count() == 0


def random_codes(n, seed):
    """Chains and balls of near codes, with a few segments shared by all, so that nodes overflow and are refined."""
    import random

    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        c = rng.getrandbits(22) << 42 | 0x2A5A5A5A5 if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            out.add(c)
            for _ in range(rng.randrange(1, 4)):
                c ^= 1 << rng.randrange(64)
    return sorted(out)


def test_links_of_refined_nodes_lose_no_component(spark):
    codes = random_codes(700, 3)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    found = components(links(spark.createDataFrame([(c,) for c in signed], "fp long"), node_rows=20))
    root = {r["a"]: r["b"] for r in found.collect()}
    label = {c: root.get(c, c) for c in signed}
    want = brute_components([(i, c) for i, c in enumerate(codes)])
    groups = defaultdict(set)
    for (i, _, least) in want:
        groups[least].add(signed[int(i)])
    assert {frozenset(g) for g in groups.values()} == {frozenset(c for c in label if label[c] == r) for r in set(label.values())}


def test_gray_tree_finds_every_pair():
    import numpy as np

    codes = np.array(random_codes(333, 5), np.uint64)
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = codes[np.argsort(rank)]
    found = {(int(i), int(j)) for a, b in GrayTree(codes).pairs(2, 50) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 2}
    assert found == want and want


@pytest.mark.parametrize(("limit", "held"), [(2, False), (3, False), (12, True)])
def test_hierarchies_drop_subtrees_and_lose_no_pair(limit, held):
    """2,000 random codes and near ones of theirs; with ``held`` only pairs that agree on the mask count."""
    import numpy as np

    rng = np.random.default_rng(limit)
    own = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    near = own[:500].copy()
    for _ in range(limit):
        near ^= np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)
    codes = rng.permutation(np.concatenate((own, near)))
    masks = [0xFFF, 0xFFF << 30, -(1 << 52)]
    for rows, tree, fixed in hierarchies(np.tile(codes, 3), np.repeat(masks, len(codes))):
        mask = np.uint64(masks[rows[0] // len(codes)] & (2**64 - 1))
        assert bin(fixed).count("1") == 12
        got = {frozenset((int(rows[i]) % len(codes), int(rows[j]) % len(codes))) for a, b in tree.pairs(limit, fixed=fixed if held else 0) for i, j in zip(a, b, strict=True)}
        apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
        linked = (apart <= limit) & ((((codes[:, None] ^ codes[None, :]) & mask) == 0) | (not held))
        assert got == {frozenset((int(i), int(j))) for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True)} and got
        assert tree.dropped > 5 * len(codes) and tree.compared < len(codes) ** 2 / 3


def test_components_of_long_chains(spark):
    edges = [(i + 1, i) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)]
    found = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 301)) and all(found[1000 + i] == 1000 for i in range(1, 50))


def test_wide_limits_find_nine_of_ten_links(spark):
    import random

    rng = random.Random(9)
    codes, pairs = [], 0
    for _ in range(300):
        c = rng.getrandbits(64)
        codes.append(c)
        for _ in range(3):
            d = c
            for b in rng.sample(range(64), rng.randrange(3, 9)):
                d ^= 1 << b
            codes.append(d)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    root = {r["a"]: r["b"] for r in components(links(spark.createDataFrame([(c,) for c in signed], "fp long").distinct(), limit=8, node_rows=30)).collect()}
    label = {c: root.get(c, c) for c in signed}
    hit = 0
    for k in range(0, len(codes), 4):
        for j in (1, 2, 3):
            pairs += 1
            hit += label[signed[k]] == label[signed[k + j]]
    assert hit >= 0.9 * pairs
    assert len({label[signed[k]] for k in range(0, len(codes), 4)}) == 300  # and unrelated codes stay apart


def test_verified_links_share_shingles(spark):
    from .conftest import words
    import random

    rng = random.Random(2)
    base = words(rng, 300)
    near = base.replace(base.split()[150], "changed", 1)
    rows = [(1, base), (2, near), (3, words(rng, 300)), (4, None), (5, ""), (None, base.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup(docs, limit=8, verify=0.5).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, None: 1}
    apart = {r["doc_id"]: r["component_id"] for r in near_dedup(docs, limit=8, verify=0.999).collect()}
    assert apart[2] == 2


def test_verified_links_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    texts = []
    for _ in range(4):
        base = [f"w{rng.randrange(4000)}" for _ in range(200)]
        for _ in range(40):  # one to nine changed words: on both sides of the similarity of 0.8
            own = list(base)
            for at in rng.sample(range(200), rng.randrange(1, 10)):
                own[at] = f"w{rng.randrange(4000)}"
            texts.append(" ".join(own))
    texts += [" ".join(f"w{rng.randrange(4000)}" for _ in range(100)) for _ in range(30)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert 4 < len(set(root[:160])) < 160
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (4096, 24):  # whole nodes, and nodes that are refined
        found = {r["doc_id"]: r["component_id"] for r in near_dedup(docs, limit=12, node_rows=rows, verify=0.8).collect()}
        assert all(root[found[i]] == root[i] for i in found)  # no link that does not hold
        assert sum(found[i] != root[i] for i in found) <= 4


def test_many_nearer_siblings_hide_no_copy(spark):
    import random

    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = fresh(200)
    texts = {fingerprint(t): t for t in (" ".join(shared + fresh(30)) for _ in range(900))}  # siblings: about 0.77 of their shingles
    texts = list(texts.values())[:700]
    for _ in range(40):
        own = shared + fresh(30)
        texts += [" ".join(own), " ".join(own + fresh(54))]  # a true copy, with more text: over 0.8, and further away than siblings
    fps = [fingerprint(t) for t in texts]
    within = [i for i in range(700, 780, 2) if (fps[i] ^ fps[i + 1]).bit_count() <= 10]
    found = {r["doc_id"]: r["component_id"] for r in near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), limit=12, verify=0.8).collect()}
    hit = sum(found[i + 1] == i for i in within)
    assert hit >= 0.9 * len(within) > 20, (hit, len(within))


def test_equal_fingerprints_are_verified(spark):
    import random

    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    filler = ["-"] * 90
    texts = [" ".join(filler + fresh(60)) for _ in range(50)]  # one fingerprint, and little in common
    texts += [t + " - -" for t in texts[:5]]  # the same shingles but for a few
    assert len({fingerprint(t) for t in texts}) == 1
    found = {r["doc_id"]: r["component_id"] for r in near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), limit=12, verify=0.8).collect()}
    assert found == {i: i if i < 50 else i - 50 for i in range(55)}


def test_overfull_nodes_lose_no_pair_at_wide_limits(spark):
    import random
    from riskloom.llm.simhash import table_masks

    rng = random.Random(8)
    codes, pairs = set(), []
    for _ in range(400):  # pairs at twelve bits among codes that share twelve bits
        c = rng.getrandbits(52) << 12 | 0x5A5
        d = c
        for b in rng.sample(range(64), 12):
            d ^= 1 << b
        codes |= {c, d}
        pairs.append((c, d))
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    masks = table_masks(len(codes), 12)
    meet = [(c, d) for c, d in pairs if any(not (c ^ d) & m for m in masks)]
    found = {r["a"]: r["b"] for r in components(links(spark.createDataFrame([(signed(c),) for c in sorted(codes)], "fp long"), limit=12, node_rows=2)).collect()}
    root = lambda c: found.get(signed(c), signed(c))
    hit = sum(root(c) == root(d) for c, d in meet)
    assert hit == len(meet) >= 0.9 * len(pairs), (hit, len(meet), len(pairs))


@pytest.mark.parametrize("node_rows", [4096, 2])
def test_nine_of_ten_pairs_are_found_at_every_distance(spark, node_rows):
    import random

    rng = random.Random(12)
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    codes, pairs = {rng.getrandbits(64) for _ in range(2000)}, []
    for apart in range(1, 13):
        for _ in range(250):
            c = rng.getrandbits(64)
            d = c
            for b in rng.sample(range(64), apart):
                d ^= 1 << b
            codes |= {c, d}
            pairs.append((c, d, apart))
    found = {r["a"]: r["b"] for r in components(links(spark.createDataFrame([(signed(c),) for c in sorted(codes)], "fp long"), limit=12, node_rows=node_rows)).collect()}
    root = lambda c: found.get(signed(c), signed(c))
    for apart in range(1, 13):
        mine = [root(c) == root(d) for c, d, k in pairs if k == apart]
        assert sum(mine) >= (0.9 if apart > 10 else 0.95) * len(mine), (apart, sum(mine))


def test_the_last_search_verifies_what_the_rounds_leave(spark, monkeypatch):
    import random

    from riskloom.llm import simhash

    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = fresh(300)
    texts = []
    for _ in range(60):  # siblings under 0.8, each with two true copies
        own = shared + fresh(45)
        texts += [" ".join(own), " ".join(own + fresh(9)), " ".join(own[:-6])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert 20 < len(set(root)) <= 70
    seen = []
    forests = simhash.verified_forests
    monkeypatch.setattr(simhash, "verified_forests", lambda *x: seen.append(1) or forests(*x))
    for rounds, block in (((0, 0), 1 << 22), ((1, 1), 3000)):  # all by the last search; and with sets in small blocks
        monkeypatch.setattr(simhash, "ROUNDS", rounds)
        monkeypatch.setattr(simhash, "BLOCK_SHINGLES", block)
        found = {r["doc_id"]: r["component_id"] for r in near_dedup(docs, limit=20, verify=0.8).collect()}
        assert all(root[found[i]] == root[i] for i in found)
        assert sum(found[i] != root[i] for i in found) <= 4
    assert len(seen) == 2


def test_verified_rows_are_told_apart(spark):
    from .conftest import words
    import random

    rng = random.Random(2)
    base, own, other = words(rng, 300), words(rng, 300), words(rng, 300)
    rows = [(1, base), (None, base + " more"), (None, own), (None, other), (1, base), (7, own + " more"), (7, "a text that is not like any other one here")]
    found = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), limit=12, verify=0.8)
    assert found.where("kept").count() == 4 and found.select("row_id").distinct().count() == 7


def test_equal_codes_in_overfull_nodes_are_compared(spark):
    import random

    rng = random.Random(6)
    texts = [" ".join(["-"] * 90 + [f"w{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(50)]
    texts += [t + " - -" for t in texts[:5]]
    found = {r["doc_id"]: r["component_id"] for r in near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), limit=12, node_rows=16, verify=0.8).collect()}
    assert found == {i: i if i < 50 else i - 50 for i in range(55)}
