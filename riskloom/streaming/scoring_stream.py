"""Streaming forms: stateless scoring, and counts by tumbling, sliding and session windows with a watermark."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.blocks import member_pages
from riskloom.plans.scoring import score_by_pages


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A file stream over one table of a folder."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def window_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(day, event_type, n): tumbling windows; rows later than the watermark are dropped once a window is closed."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = rows.withWatermark("at", late) if rows.isStreaming else rows
    counted = timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def sliding_counts(events: DataFrame, width: str = "1 day", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n): windows that overlap; an event is in as many as fit into a width."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = rows.withWatermark("at", late) if rows.isStreaming else rows
    counted = timed.groupBy(F.window("at", width, slide), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events of which each follows the one before within the gap; end is a gap after the last."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = rows.withWatermark("at", late) if rows.isStreaming else rows
    counted = timed.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def run_in_steps(steps: list[DataFrame], make: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Feed a stream step by step and return its sink: after each step the query has ended, and starts again from its checkpoint.

    Each step appends files to the source's folder; they are read by as many tasks as they have splits.
    """
    spark = steps[0].sparkSession
    for step in steps:
        step.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(steps[0].schema).parquet(f"{folder}/in")
        run_once(make(source), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


def in_time_steps(events: DataFrame, steps: int = 3, ended: bool = True) -> list[DataFrame]:
    """events in ranges of ts, and, if ``ended``, one row without a user far behind the last, which closes all windows."""
    span = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    if span["low"] is None:
        return [events]
    cuts = [span["low"] + (span["high"] - span["low"]) * i / steps for i in range(1, steps)]
    at = F.lit(0)
    for cut in cuts:
        at = at + (F.col("ts") > F.lit(cut)).cast("int")
    parts = [events.where(F.coalesce(at, F.lit(0)) == i) for i in range(steps)]
    if ended:
        one = events.sparkSession.range(1)
        mark = {f.name: F.lit(None).cast(f.dataType) for f in events.schema} | {"ts": F.lit(span["high"] + timedelta(days=400)).cast(events.schema["ts"].dataType)}
        parts.append(one.select(*[mark[c].alias(c) for c in events.columns]))
    return parts


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process all there is and stop; the sink is a Parquet folder, so results are exactly once."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def score_stream(requests: DataFrame, members: DataFrame, sink: str, checkpoint: str, id_col: str = "event_id", k: int = 5, pages: DataFrame | None = None) -> None:
    """Score a stream of (id, body) per micro-batch against a static member table, by pages that are made once; a batch that is redone overwrites its own folder.

    pages: ``blocks.member_pages`` of the members, where the caller has them.
    """
    pages = member_pages(members) if pages is None else pages

    def batch(rows: DataFrame, number: int) -> None:
        score_by_pages(rows, id_col, pages, k).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    each: Callable[[DataFrame, int], None] = batch
    query = requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
