"""Scalar functions of the scoring engine, as Column expressions that stay inside generated code.

Feature arithmetic is single precision: each division is rounded to float before the next step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: They must equal the scoring rules' for right results.
DIMS = 14
SCALE = 10000.0
MAX_AMOUNT = 10000.0
MAX_INSTALLMENTS = 12.0
AMOUNT_VS_AVERAGE = 10.0
MAX_MINUTES = 1440.0
MAX_KM = 1000.0
MAX_COUNT_24H = 20.0
MAX_MERCHANT_AVERAGE = 10000.0
MAX_KNOWN_MERCHANTS = 16
TOP_K = 5
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
MCC_DEFAULT = 0.5
#: Widest array whose distance is written out term by term.
UNROLL = 128


def f32(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, f32(0)), f32(1))


def ratio(x: Column, y: Column | float) -> Column:
    """x / y in single precision."""
    return f32(f32(x) / f32(y))


def mcc_risk(code: Column) -> Column:
    """The risk of a merchant category; 0.5 for one that is unknown, null or of another length."""
    table = F.create_map(*[v for k, r in MCC_RISK.items() for v in (F.lit(k), f32(r))])
    return F.coalesce(F.try_element_at(table, code), f32(MCC_DEFAULT))


def round_half_away(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("long")


def quantize_one(x: Column) -> Column:
    scaled = f32(x) * f32(SCALE)
    return round_half_away(F.least(F.greatest(scaled, f32(-SCALE)), f32(SCALE))).cast("int")


def quantize(vector: Column) -> Column:
    """An array of floats as codes in -10000..10000, halves rounded away from zero."""
    return F.transform(vector, quantize_one)


def pad_truncate(vector: Column, dims: int = DIMS) -> Column:
    """Exactly dims floats: zeros are added, what is too much is cut off."""
    return F.slice(F.concat(vector, F.array_repeat(f32(0), dims)), 1, dims)


def label_encode(label: Column) -> Column:
    return F.when(label == "fraud", 1).otherwise(0)


def _at(v: Column, i: int) -> Column:
    return F.get(v, i).cast("long")


def partial_l2(q: Column, v: Column, first: int, last: int) -> Column:
    """The squared distance over dimensions first .. last-1, as a long."""
    terms = [(_at(q, i) - _at(v, i)) * (_at(q, i) - _at(v, i)) for i in range(first, last)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def l2(q: Column, v: Column, dims: int = DIMS) -> Column:
    """The exact squared distance of two code arrays."""
    if dims <= UNROLL:
        return partial_l2(q, v, 0, dims)
    return F.aggregate(F.zip_with(q, v, lambda a, b: (a.cast("long") - b) * (a.cast("long") - b)), F.lit(0).cast("long"), lambda s, x: s + x)


def l2_single(a: Column, b: Column) -> Column:
    """The squared distance of two float arrays in single precision, added up dimension by dimension."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), f32(0), lambda s, x: s + x)


def bbox_lower_bound(q: Column, low: Column, high: Column, dims: int = DIMS) -> Column:
    """The least squared distance of q to any point of the box low..high."""
    out = None
    for i in range(dims):
        gap = F.greatest(_at(low, i) - _at(q, i), _at(q, i) - _at(high, i), F.lit(0).cast("long"))
        out = gap * gap if out is None else out + gap * gap
    return out


def fraud_score(n: Column) -> Column:
    return F.least(n, F.lit(TOP_K)) / F.lit(float(TOP_K))


def approved(n: Column) -> Column:
    return n <= 2


def bitset_popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))


def bit_is_set(words: Column, position: Column) -> Column:
    """Whether a bit of an array of 64-bit words is set."""
    word = F.get(words, F.floor(position / 64).cast("int"))
    return F.call_function("shiftright", word, F.pmod(position, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
