"""Histories of heavy users and picks by running weight, cut into parts, against the same work done whole."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions.dates import epoch_seconds
from riskloom.operators import clustering, features


@pytest.fixture(scope="module")
def base(spark):
    """Events of one user who owns a third, some at equal times or a day apart, some without user, time, merchant or amount."""
    rng = random.Random(3)
    none = lambda share, x: None if rng.random() < share else x
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(2000):
        second = rng.choice([rng.randrange(86400 * 6), 86400 * rng.randrange(6)])
        user = 1 if rng.random() < 0.33 else none(0.05, rng.randrange(30))
        rows.append((i, user, none(0.05, rng.randrange(6)), none(0.03, rng.randrange(1000)), none(0.02, start + datetime.timedelta(seconds=second))))
    table = spark.createDataFrame(rows, "event_id long, user_id long, k int, cents long, ts timestamp")
    return table.withColumn("sec", epoch_seconds(F.col("ts")))


@pytest.mark.parametrize("heavy_rows, most", [(1, 1 << 19), (300, 1 << 19), (1, 2)])
def test_histories_by_day_equal_those_by_user(base, monkeypatch, heavy_rows, most):
    monkeypatch.setattr(features, "HEAVY_USERS", most)
    whole = features.history_by_user(base)
    split = features.user_history(base, heavy_rows)
    assert split.dtypes == whole.dtypes and split.count() == whole.count() == 2000
    assert split.exceptAll(whole).count() == 0


def test_histories_of_no_events(base):
    assert features.user_history(base.limit(0)).count() == 0
    assert features.history_by_day(base.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.2, 0.375, 1.0])
def test_weighted_pick_cuts_ranges_until_they_are_small(spark, share):
    rows = [(i**3, i % 7 * 3) for i in range(1000)]  # ids that crowd at one end
    found = clustering.weighted_pick(spark.createDataFrame(rows, "vec_id long, min_dist long"), share, buckets=4, range_rows=10).collect()
    total, running = sum(w for _, w in rows), 0
    for i, w in rows:
        running += w
        if running >= share * total:
            break
    assert [tuple(r) for r in found] == [(i, w, running)]
