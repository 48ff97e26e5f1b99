"""Zone-free timestamp functions. Only the first 19 characters of a timestamp count; a zone after them is ignored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ts(text: Column) -> Column:
    """TIMESTAMP_NTZ of the first 19 characters; null if they are no timestamp."""
    plain = F.regexp_replace(F.substring(text, 1, 19), "T", " ")
    return F.when(F.length(text) >= 19, F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def days_since_epoch(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 00:00:00 of the same wall clock."""
    return (days_since_epoch(ts).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))).cast("long")
