"""Requests out of the bytes of connections: chunks of any size, with what is not complete carried over as state."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the protocol: where a head ends, the two known requests, the shortest request.
END, SCORE, READY, LEAST = b"\r\n\r\n", b"POST /fraud-score", b"GET /ready", 16
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]*)")


def cut_requests(data: bytes) -> tuple[list[tuple[str, bytes]], bytes, bool]:
    """((route, body) of each whole request at the front of data, what is left, whether the connection must be closed)."""
    found, at = [], 0
    while len(data) - at >= LEAST:
        end = data.find(END, at)
        if end < 0:
            break
        head, end = data[at:end], end + len(END)
        if head.startswith(SCORE):
            length = _LENGTH.search(head)
            if length is None:
                return [*found, ("bad", b"")], b"", True
            stop = end + int(length[1] or 0)
            if len(data) < stop:
                break
            found.append(("score", data[end:stop]))
            end = stop
        else:
            found.append(("ready" if head.startswith(READY) else "other", b""))
        at = end
    return found, data[at:], False


def reassembled(chunks: DataFrame) -> DataFrame:
    """(conn, turn, route, body) of a stream of (conn, seq, chunk): the requests of each connection in order, each once.

    seq counts a connection's chunks from 0; chunks that overtake others wait in the state. After a request without a length the
    connection is closed, and what it still sends is dropped. The state of a connection is one unfinished request, and what waits.
    """
    state = "next long, turn long, rest binary, closed boolean, waiting_seq array<long>, waiting array<binary>"

    def read(key: tuple, parts: Iterator[pd.DataFrame], held: Any) -> Iterator[pd.DataFrame]:
        at, turn, rest, closed, seqs, waiting = held.get if held.exists else (0, 0, b"", False, [], [])
        stock = dict(zip(seqs, waiting, strict=True))
        for part in parts:
            stock.update((s, c) for s, c in zip(part["seq"], part["chunk"], strict=True) if s >= at)
        pieces = [bytes(rest)]
        while at in stock:
            pieces.append(bytes(stock.pop(at)))
            at += 1
        found, rest, bad = ([], b"", True) if closed else cut_requests(b"".join(pieces))
        if found:
            yield pd.DataFrame({"conn": key[0], "turn": range(turn, turn + len(found)), "route": [r for r, _ in found], "body": [b.decode("utf-8", "replace") if r == "score" else None for r, b in found]})
        held.update((at, turn + len(found), rest, closed or bad, list(stock), list(stock.values())))

    rows = chunks.select("conn", "seq", F.col("chunk").cast("binary").alias("chunk"))
    kind = dict(rows.dtypes)["conn"]
    return rows.groupBy("conn").applyInPandasWithState(read, f"conn {kind}, turn long, route string, body string", state, "append", "NoTimeout")
