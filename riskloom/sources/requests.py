"""Readers for scoring requests, labelled vectors and calibration entries, with explicit schemas.

A request that breaks a rule is malformed and approved with score 0 (fail open). Differences from a hand-written scanner:
commas are required, string escapes are understood, and a timestamp under 19 characters is malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import scalars as S
from riskloom.functions.dates import epoch_seconds, parse_ts
from riskloom.sources.json_array import read_json_array


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_F, _I, _S, _B = T.FloatType(), T.LongType(), T.StringType(), T.BooleanType()
PAYLOAD = _struct(
    transaction=_struct(amount=_F, installments=_I, requested_at=_S),
    customer=_struct(avg_amount=_F, tx_count_24h=_I, known_merchants=T.ArrayType(_S)),
    merchant=_struct(id=_S, mcc=_S, avg_amount=_F),
    terminal=_struct(is_online=_B, card_present=_B, km_from_home=_F),
    last_transaction=_struct(timestamp=_S, km_from_current=_F),
)
VECTORS = _struct(vector=T.ArrayType(_F), label=_S)
ENTRIES = _struct(entries=T.ArrayType(_struct(request=PAYLOAD, expected_approved=_B, expected_fraud_score=T.DoubleType())))
#: Fields for which a JSON null is not allowed.
_NOT_NULL = [
    "$.transaction", "$.transaction.amount", "$.transaction.installments", "$.transaction.requested_at", "$.customer", "$.customer.avg_amount", "$.customer.tx_count_24h", "$.customer.known_merchants",
    "$.merchant", "$.merchant.id", "$.merchant.mcc", "$.merchant.avg_amount", "$.terminal", "$.terminal.is_online", "$.terminal.card_present", "$.terminal.km_from_home", "$.last_transaction.timestamp", "$.last_transaction.km_from_current",
]


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(vector of 14 floats, is_fraud) from a JSON array file, by byte ranges; plain or gzip. Objects without vector or label are left out; any bad value fails the read."""
    return labelled_vectors(read_json_array(spark, path, VECTORS))


def labelled_vectors(rows: DataFrame) -> DataFrame:
    kept = rows.where(F.col("vector").isNotNull() & F.col("label").isNotNull())
    return kept.select(S.pad_truncate(F.col("vector")).alias("vector"), S.label_encode(F.col("label")).alias("is_fraud"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(request, expected_approved, expected_fraud_score), one row per calibration entry, by byte ranges."""
    return read_json_array(spark, path, ENTRIES["entries"].dataType.elementType, 2, "PERMISSIVE")


def read_http(rows: DataFrame) -> DataFrame:
    """Raw requests (value) as route (score, ready, other, incomplete, bad) and body, cut to its content-length."""
    v = F.col("value")
    split = F.locate("\r\n\r\n", v)
    head, body = F.substring(v, F.lit(1), split - 1), F.substring(v, split + 4, F.length(v))
    length = F.regexp_extract(F.lower(head), "(?m)^content-length:[ \\t]*([0-9]+)", 1)
    size = F.try_to_number(length, F.lit("999999999")).cast("int")
    whole = F.encode(body, "UTF-8")
    route = (
        F.when((F.length(v) < 16) | (split == 0), "incomplete")
        .when(v.startswith("GET /ready"), "ready")
        .when(~v.startswith("POST /fraud-score"), "other")
        .when(size.isNull(), "bad")
        .when(F.octet_length(whole) < size, "incomplete")
        .otherwise("score")
    )
    return rows.select(*rows.columns, route.alias("route"), F.when(route == "score", F.decode(F.substring(whole, F.lit(1), size), "UTF-8")).alias("body"))


def parse_payload(rows: DataFrame, column: str = "body") -> DataFrame:
    """rows with p (the payload) and malformed."""
    schema = T.StructType([*PAYLOAD.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    tree = F.try_parse_json(F.col(column))
    nulls = F.lit(False)
    for path in _NOT_NULL:
        nulls = nulls | F.coalesce(F.is_variant_null(F.try_variant_get(tree, path, "variant")), F.lit(False))
    out = rows.withColumn("p", parsed)
    object_ = F.coalesce(F.trim(F.col(column)).startswith("{"), F.lit(False))
    late = F.col("p.last_transaction").isNotNull() & parse_ts(F.col("p.last_transaction.timestamp")).isNull()
    bad = ~object_ | F.col("p").isNull() | F.col("p._corrupt").isNotNull() | nulls | parse_ts(F.col("p.transaction.requested_at")).isNull() | late
    return out.withColumn("malformed", F.coalesce(bad, F.lit(True)))


def flatten_payload(rows: DataFrame) -> DataFrame:
    """Parsed rows with the flat columns that features read; what is missing has its zero value."""
    p = lambda name, default: F.coalesce(F.col(f"p.{name}"), default)
    zero, none = S.f32(0), F.lit(0).cast("long")
    known = F.slice(F.coalesce(F.col("p.customer.known_merchants"), F.array().cast("array<string>")), 1, S.MAX_KNOWN_MERCHANTS)
    columns: dict[str, Column] = {
        "amount": p("transaction.amount", zero),
        "installments": p("transaction.installments", none),
        "ts": parse_ts(F.col("p.transaction.requested_at")),
        "customer_avg": p("customer.avg_amount", zero),
        "tx_count_24h": p("customer.tx_count_24h", none),
        "is_known": F.array_contains(known, p("merchant.id", F.lit(""))),
        "risk": S.mcc_risk(p("merchant.mcc", F.lit(""))),
        "merchant_avg": p("merchant.avg_amount", zero),
        "is_online": p("terminal.is_online", F.lit(False)),
        "card_present": p("terminal.card_present", F.lit(False)),
        "km_from_home": p("terminal.km_from_home", zero),
        "last_sec": epoch_seconds(parse_ts(F.col("p.last_transaction.timestamp"))),
        "km_from_last": p("last_transaction.km_from_current", zero),
    }
    return rows.withColumns(columns)
