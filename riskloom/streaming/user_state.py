"""The past of each user as state of a stream: its last day by seconds, and its last event for good."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

DAY = 86400
#: Seconds for which an event counts for later ones: a day, and as long again for events that come late.
KEPT = 2 * DAY
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class UserPast(StatefulProcessor):
    """One value a user: the last event, which never expires, and its recent seconds with their events. It is read and written once a batch;
    seconds go when they are too old for any event that may still come, those of a user who falls silent by one timer."""

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", "us long, event_id long, sec long, k int, seconds array<long>, n array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = list(rows)
        us, event_id, sec, k = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("us", "event_id", "sec", "k"))
        order = np.lexsort((event_id, us))
        us, event_id, sec, k = us[order], event_id[order], sec[order], k[order]
        old = self.past.get()
        kept = ([], []) if old is None else (old[4], old[5])
        seconds, at = np.unique(np.concatenate([np.array(kept[0], np.int64), sec]), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.array(kept[1], np.int64), np.ones(len(sec), np.int64)]), len(seconds)).astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(n)))
        n24 = upto[np.searchsorted(seconds, sec)] - upto[np.searchsorted(seconds, sec - DAY)]
        first = np.arange(len(sec)) == 0
        none, last = first & (old is None), (0, 0, 0, 0) if old is None else old[:4]
        last_sec, last_k = np.concatenate(([last[2]], sec[:-1])), np.concatenate(([last[3] or 0], k[:-1]))
        latest = (int(us[-1]), int(event_id[-1]), int(sec[-1]), None if pd.isna(k[-1]) else int(k[-1]))
        if old is not None and latest[:2] < tuple(old[:2]):
            latest = tuple(old[:4])
        live = seconds + KEPT > timerValues.getCurrentWatermarkInMs() // 1000
        self.past.update((*latest, seconds[live].tolist(), n[live].tolist()))
        self.handle.registerTimer(int(seconds[-1] + KEPT) * 1000)
        unknown = none | pd.isna(last_k) | (first & (last[3] is None))
        numbers = np.where(unknown, 0, last_k).astype(np.int32)
        yield pd.DataFrame({"event_id": event_id, "user_id": key[0], "tx_count_24h": n24, "last_sec": pd.arrays.IntegerArray(last_sec.astype(np.int64), none), "last_k": pd.arrays.IntegerArray(numbers, unknown)})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.past.get()
        live = [x + KEPT > expiredTimerInfo.getExpiryTimeInMs() // 1000 for x in old[4]]
        self.past.update((*old[:4], *([x for x, keep in zip(old[j], live, strict=True) if keep] for j in (4, 5))))
        return iter([])

    def close(self) -> None:
        pass


def user_state(base: DataFrame, late: str = "1 hour") -> DataFrame:
    """(event_id, user_id, tx_count_24h, last_sec, last_k) of a stream of event_base rows: what ``features.user_history`` says of each.

    An event is judged by those before it that have arrived; one that is later than the watermark is dropped. Events of one
    second do not count each other. The last event is kept however long a user is silent; its seconds go two days after.
    """
    base.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = base.select("event_id", "user_id", "k", "sec", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").cast("timestamp").alias("ts"))
    out = "event_id long, user_id long, tx_count_24h long, last_sec long, last_k int"
    return rows.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(UserPast(), out, "Append", "EventTime")
