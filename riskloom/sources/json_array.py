"""One huge JSON array, read by many tasks.

Spark's text reader cuts a file into byte ranges and lines at ``}``. A line's effect on the state (inside a string or not, how many brackets are open) is
known without the lines before: quotes flip the string state, and brackets are counted for both states. One pass sums these effects up by byte range,
a window over ranges gives each its state at the start, and a second pass cuts whole elements out. What an element has in several ranges are pieces,
two a range at most, which are put together by their order. Gzip files are read the same way, by one task each, as they cannot be cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.DOTALL)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"?', re.DOTALL)


def _effect(line: str, inside: int) -> tuple[int, int]:
    """(inside after the line, brackets it leaves open), with the } that ended it; inside: 1 in a string."""
    runs = (_ESCAPED.sub("", line) if "\\" in line else line).split('"')
    after = inside ^ (len(runs) - 1 & 1)
    outer = "".join(runs[inside::2])
    return after, outer.count("{") + outer.count("[") - outer.count("}") - outer.count("]") - (not after)


def _opening(line: str, inside: int, depth: int, level: int) -> int:
    """Where the line opens an object at this level; -1 if it does not."""
    at = _STRING_END.match(line).end() if inside else 0
    for mark in _MARKS.finditer(line, at):
        kind = mark[0][0]
        if kind == "{" and depth == level:
            return mark.start()
        depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(kind, 0)
    return -1


def _by_range(parts: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, list[str]]]:
    """(key columns, some lines of that byte range), in order; a range may come in several runs."""
    for part in parts:
        keys = list(zip(*(part.column(k).to_pylist() for k in range(1, columns)), strict=True))
        lines, at = part.column(0).to_pylist(), 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                yield keys[at], lines[at:i]
                at = i


def array_elements(spark: SparkSession, path: str, level: int = 1) -> DataFrame:
    """(text): the objects that are elements of the array at this level; 1: the file is the array, 2: it is a member of an outermost object."""
    lines = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        for key, some in _by_range(parts, 3):
            now = held.setdefault(key, [0, 0, 0])  # quotes, brackets if it starts outside of a string, if inside
            for line in some:
                flip, outer = _effect(line, now[0])
                _, inner = _effect(line, now[0] ^ 1)
                held[key] = now = [flip, now[1] + outer, now[2] + inner]
        rows = [(*key, *now) for key, now in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string(), *[pa.int64()] * 4])], ["file", "start", "quotes", "outer", "inner"])

    ranges = lines.mapInArrow(sums, "file string, start bigint, quotes bigint, outer bigint, inner bigint")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    ranges = ranges.withColumn("open", F.when(F.col("inside") == 1, F.col("inner")).otherwise(F.col("outer")))
    ranges = ranges.withColumn("depth", F.coalesce(F.sum("open").over(before), F.lit(0))).select("file", "start", "inside", "depth")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, depth, held, first = None, 0, 0, [], False

        def rows(texts: list[str], turn: int | None) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array([turn] * n, pa.int64()), pa.array(texts, pa.string())], ["file", "start", "turn", "text"])

        for own, some in _by_range(parts, 5):
            if own != key:
                if held:
                    yield rows(["".join(held)], 0 if first else 1)
                key, (inside, depth), held = own, own[2:], []
                first = depth > level  # it starts within an element
            whole, pieces = [], []
            for line in some:
                if depth <= level:
                    at = _opening(line, inside, depth, level)
                    rest = line[at:] if at >= 0 else None
                else:
                    rest = line
                inside, change = _effect(line, inside)
                depth += change
                if rest is None:
                    continue
                held.append(rest + "}")
                if depth <= level:
                    (pieces if first else whole).append("".join(held))
                    held, first = [], False
            if pieces:
                yield rows(pieces, 0)
            if whole:
                yield rows(whole, None)
        if held:
            yield rows(["".join(held)], 0 if first else 1)

    found = lines.join(F.broadcast(ranges), ["file", "start"]).select("value", "file", "start", "inside", "depth").mapInArrow(cut, "file string, start bigint, turn bigint, text string")
    order = Window.partitionBy("file").orderBy("start", "turn")
    pieces = found.where("turn IS NOT NULL").withColumn("element", F.sum(F.col("turn")).over(order))
    joined = pieces.groupBy("file", "element").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "turn", "text"))), lambda p: p["text"]), "").alias("text"))
    return found.where("turn IS NULL").select("text").unionByName(joined.select("text"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, level: int = 1, mode: str = "FAILFAST") -> DataFrame:
    """The elements as rows; one value of another kind fails the read, unless the mode is PERMISSIVE."""
    rows = array_elements(spark, path, level)
    return rows.select(F.from_json("text", schema, {"mode": mode}).alias("o")).select("o.*")


def write_json_array(rows: DataFrame, path: str, compression: str = "none") -> None:
    """rows as JSON array files, one a task."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for part in parts:
            texts = part.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([(lead if not i else ",") + t for i, t in enumerate(texts)])], ["value"])
            lead = "," if texts else lead
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], ["value"])

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInArrow(run, "value string").write.option("compression", compression).text(path)
