"""A small table that holds the awkward cases: nulls, empty and blank texts, a very long one, repeated rows, odd columns."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, n long, key string, h1 long, _hot boolean"


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta omega sigma kappa lambda theta zeta eta iota".split()) + rng.choice(["", "s", "x", "ing"]) for _ in range(n))


def awkward_rows():
    rng = random.Random(7)
    long = words(rng, 30_000)
    base = [words(rng, rng.randrange(8, 90)) for _ in range(40)]
    texts = [*base, *base[:6], base[0].upper(), base[0] + "\n", None, None, "", "", " \t\n ", "one", "one two", "ONE TWO", "é" * 40, "É" * 40, "x" * 30, "X" * 30, long, long, long[:-1], long + "y", "a\x00b c", "\n\n\n", "Größe über alles", "GRÖßE über alles"]
    texts += ["\n".join([base[i], f"  The Shared Line Of Many {'!' * 5}\t", base[i + 1]]) for i in range(8)]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 2}", None if t is None else len(t), i, 1, "k", i, True) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[45], (None, base[5], None, None, None, None, None, None, None, None), (None, "a text of its own", "en", None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark_items(spark, awkward):
    texts = [r["text"] for r in awkward.where(F.length("text") > 200).orderBy("doc_id").limit(6).collect()]
    cut = [" ".join(t.split()[3:30]) for t in texts]
    return spark.createDataFrame([*enumerate(cut), (90, None), (91, ""), (92, "one two"), (93, cut[0]), (0, cut[0]), (None, cut[1])], "item_id long, text string")
