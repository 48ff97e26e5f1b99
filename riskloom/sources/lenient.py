"""A lenient reader of scoring requests: it takes what a scanner without a grammar would take.

Members may come in any order and without commas, a name may come twice (the last counts), what is unknown is skipped, and what follows
the outermost object is not looked at. A string ends at the next quote. A whole number is a run of digits; another number without an exponent is its
whole part plus its fraction, each in single precision. An object, list, name or known value of another form makes the request malformed.
What is skipped ends at its own closing bracket, those in strings counted, or, if it is neither text, object nor list, at a comma or bracket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from riskloom.functions.dates import parse_ts
from riskloom.sources.requests import PAYLOAD

#: The kinds of the known members.
SHAPE = {
    "transaction": {"amount": "number", "installments": "whole", "requested_at": "text"},
    "customer": {"avg_amount": "number", "tx_count_24h": "whole", "known_merchants": "texts"},
    "merchant": {"id": "text", "mcc": "text", "avg_amount": "number"},
    "terminal": {"is_online": "flag", "card_present": "flag", "km_from_home": "number"},
    "last_transaction": {"timestamp": "text", "km_from_current": "number"},
}
_BLANK = rb"[ \t\r\n]*"
_OPEN = re.compile(_BLANK + rb"\{")
_MEMBER = re.compile(_BLANK + rb'(?:(\})|"([^"]*)"' + _BLANK + b":" + _BLANK + b")")
_COMMA = re.compile(_BLANK + b",?")
_TEXT = re.compile(_BLANK + rb'"([^"]*)"')
_WHOLE = re.compile(_BLANK + b"([0-9]+)")
_FLAG = re.compile(_BLANK + b"(true|false)")
_NUMBER = re.compile(_BLANK + rb"([+-]?)([0-9]*)(?:\.([0-9]*))?([eE][0-9.eE+-]*)?")
_LIST = re.compile(_BLANK + rb"\[")
_ITEM = re.compile(_BLANK + rb'(?:(\])|"([^"]*)")' + _COMMA.pattern)
_SCALAR = re.compile(rb'"[^"]*"?|[^,}\]]*')
_BRACKETS = {b"{": re.compile(rb"[{}]"), b"[": re.compile(rb"[\[\]]")}


class Malformed(ValueError):
    """A request that cannot be read."""


def _matched(pattern: re.Pattern, data: bytes, at: int) -> re.Match:
    found = pattern.match(data, at)
    if found is None:
        raise Malformed
    return found


def _number(found: re.Match) -> float:
    sign, whole, fraction, exponent = found.groups()
    if exponent is not None:
        try:
            return float(np.float32(found[0].strip()))
        except ValueError as error:
            raise Malformed from error
    if not (sign or whole or fraction is not None):
        raise Malformed
    x = np.float32(int(whole or 0)) + np.float32(int(fraction or 0)) / np.float32(10 ** len(fraction or b""))
    return float(-x if sign == b"-" else x)


def _skipped(data: bytes, at: int) -> int:
    kind = data[at : at + 1]
    if kind not in _BRACKETS:
        return _SCALAR.match(data, at).end()
    depth = 0
    for found in _BRACKETS[kind].finditer(data, at):
        depth += 1 if found[0] == kind else -1
        if not depth:
            return found.end()
    return len(data)


def _value(kind: str | None, data: bytes, at: int) -> tuple[Any, int]:
    if kind is None:
        return None, _skipped(data, at)
    if kind == "texts":
        at, out = _matched(_LIST, data, at).end(), []
        while not (found := _matched(_ITEM, data, at))[1]:
            out.append(found[2].decode("utf-8", "replace"))
            at = found.end()
        return out, found.end(1)
    found = _matched({"text": _TEXT, "whole": _WHOLE, "flag": _FLAG, "number": _NUMBER}[kind], data, at)
    if kind == "number":
        return _number(found), found.end()
    text = found[1]
    return (text.decode("utf-8", "replace") if kind == "text" else text == b"true" if kind == "flag" else int(text) & 0xFFFFFFFF), found.end()


def _object(data: bytes, at: int, shape: dict) -> tuple[dict, int]:
    at, out = _matched(_OPEN, data, at).end(), {}
    while not (found := _matched(_MEMBER, data, at))[1]:
        name, at = found[2].decode("utf-8", "replace"), found.end()
        kind = shape.get(name)
        if isinstance(kind, dict):
            if name == "last_transaction" and data.startswith(b"null", at):
                value, at = None, at + 4
            else:
                value, at = _object(data, at, kind)
                value = (out.get(name) or {}) | value
        else:
            value, at = _value(kind, data, at)
        if kind is not None:
            out[name] = value
        at = _COMMA.match(data, at).end()
    return out, found.end()


def read_request(data: bytes | None) -> dict | None:
    """The known members of a request; None if it is malformed."""
    try:
        return _object(data or b"", 0, SHAPE)[0]
    except Malformed:
        return None


def parse_lenient(rows: DataFrame, column: str = "body") -> DataFrame:
    """rows with p (the payload) and malformed, as ``requests.parse_payload`` gives them."""
    kind = to_arrow_type(PAYLOAD)
    names = [*rows.columns, "p"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bodies = part.column(part.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([read_request(b) for b in bodies], kind)], names)

    out = rows.withColumn("_bytes", F.col(column).cast("binary")).mapInArrow(run, T.StructType([*rows.schema, T.StructField("p", PAYLOAD)]))
    late = F.col("p.last_transaction").isNotNull() & parse_ts(F.col("p.last_transaction.timestamp")).isNull()
    bad = F.col("p").isNull() | parse_ts(F.col("p.transaction.requested_at")).isNull() | late
    return out.withColumn("malformed", F.coalesce(bad, F.lit(True)))
