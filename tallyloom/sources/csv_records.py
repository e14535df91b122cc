"""Records of CSV files whose quoted cells may hold line ends, read by many tasks a file.

Files are read as lines, by byte ranges. Whether a range begins inside a quoted cell depends on all before it, so each
range first tells, for either case, whether it ends inside one; these pairs are combined along a file, and the ranges are
read once more from the state that they really begin in. Only records that lie across ranges are put together by a
shuffle, a piece or two of each range. Cells are told apart as by Python's csv module: a quote means something
only at the beginning of a cell, and inside a quoted one, where two stand for one.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scanner(sep: str = ",") -> Callable[[str, bool], bool]:
    """A function that tells, of a line and whether it begins inside a quoted cell, whether it ends inside one."""
    end = re.compile(f"[{re.escape(sep)}\r]")

    def after(line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        at = 0
        while True:
            if inside:
                at = line.find('"', at)
                if at < 0:
                    return True
                if line.startswith('""', at):
                    at += 2
                    continue
                at += 1
            elif line.startswith('"', at):
                inside = True
                at += 1
                continue
            found = end.search(line, at)
            if not found:
                return False
            at, inside = found.end(), False

    return after


def cells_of(text: str, sep: str = ",") -> list[list[str]]:
    """The records of a text, blank lines left out."""
    text = text.removesuffix("\r")
    if '"' not in text and "\r" not in text and "\n" not in text:
        return [text.split(sep)] if text else []
    csv.field_size_limit(sys.maxsize)
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """Where the lines of a file's range are in a batch: its file and first byte, begin and end."""
    keys = list(zip(batch.column("_file").to_pylist(), batch.column("_block").to_pylist()))
    begin = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[begin]:
            yield keys[begin], begin, i
            begin = i


def _ends(sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, state = scanner(sep), {}
        for batch in batches:
            for key, begin, end in _runs(batch):
                out, inside = state.get(key, (False, True))
                for line in batch.column("value").slice(begin, end - begin).to_pylist():
                    if '"' in line:
                        out, inside = after(line, out), after(line, inside)
                state[key] = out, inside
        yield pa.RecordBatch.from_pydict({"_file": [f for f, _ in state], "_block": pa.array([b for _, b in state], pa.int64()), "out": pa.array([a for a, _ in state.values()], pa.bool_()), "inside": pa.array([b for _, b in state.values()], pa.bool_())})

    return run


def _along(ranges: pa.Table) -> pa.Table:
    """Whether each range of a file begins inside a quoted cell."""
    rows, inside, got = sorted(ranges.to_pylist(), key=lambda r: r["_block"]), False, []
    for r in rows:
        got.append(inside)
        inside = r["inside"] if inside else r["out"]
    return pa.table({"_file": [r["_file"] for r in rows], "_block": pa.array([r["_block"] for r in rows], pa.int64()), "_inside": pa.array(got, pa.bool_())})


_RECORD = "_file string, _block bigint, _row bigint, _first boolean, cells array<string>, piece string, starts boolean"


def _records(sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole records, and as pieces what comes before the first and after the last of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = scanner(sep)
        key, inside, held, begun, opening, first, row = None, False, [], 0, False, True, 0
        out: list[tuple] = []

        def piece() -> None:
            """What is held when a range ends, or when the record that it began in ends."""
            if held:
                out.append((*key, begun, False, None, "\n".join(held), not opening))
                held.clear()

        for batch in batches:
            for now, begin, end in _runs(batch):
                if now != key:
                    piece()
                    key, inside, first = now, batch.column("_inside")[begin].as_py(), now[1] == 0
                    opening = inside
                for line, row in zip(batch.column("value").slice(begin, end - begin).to_pylist(), batch.column("_line").slice(begin, end - begin).to_pylist()):
                    if not held:
                        begun = row
                    held.append(line)
                    inside = after(line, inside)
                    if inside:
                        continue
                    if opening:
                        piece()
                        opening = False
                        continue
                    for k, cells in enumerate(cells_of("\n".join(held), sep)):
                        out.append((*key, begun, first, cells, None, True))
                        first = False
                    held.clear()
            if out:
                yield made(out)
                out = []
        piece()
        if out:
            yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["_file", "_block", "_row", "_first", "cells", "piece", "starts"])

    return run


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """_file, _row, _first (whether it is the first of its file) and cells of each record that isn't a blank line; _row ascends as the records stand.

    An empty file has none. A file that ends inside a quoted cell ends with that record. A byte order mark goes.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    ends = lines.mapInArrow(_ends(sep), "_file string, _block bigint, out boolean, inside boolean")
    begins = ends.groupBy("_file").applyInArrow(_along, "_file string, _block bigint, _inside boolean")
    # A row for each range of a file, that is for each partition of some megabytes.
    got = lines.join(F.broadcast(begins), ["_file", "_block"]).select("value", "_file", "_block", "_line", "_inside").mapInArrow(_records(sep), _RECORD)
    whole = got.where("piece is null").select("_file", "_row", "_first", "cells")
    by = Window.partitionBy("_file").orderBy("_block", "_row")
    pieces = got.where("piece is not null").withColumn("of", F.last(F.when(F.col("starts"), F.col("_row")), True).over(by))
    joined = pieces.groupBy("_file", "of").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_block", "_row", "piece"))).piece, "\n").alias("text"))
    joined = joined.mapInArrow(_joined(sep), "_file string, _row bigint, cells array<string>")
    # A first record that lies across ranges is the first of its file.
    firsts = whole.where("_first").select("_file", F.lit(True).alias("_has"))
    least = joined.groupBy("_file").agg(F.min("_row").alias("_least")).join(firsts, "_file", "left_anti")
    joined = joined.join(F.broadcast(least), "_file", "left").select("_file", "_row", F.coalesce(F.col("_row") == F.col("_least"), F.lit(False)).alias("_first"), "cells")
    out = whole.unionByName(joined)
    bare = F.when(F.col("_first"), F.transform("cells", lambda c, i: F.when(i == 0, F.regexp_replace(c, "^﻿", "")).otherwise(c))).otherwise(F.col("cells"))
    return out.withColumn("cells", bare)


def _joined(sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["_file"], r["of"], c) for r in batch.to_pylist() for c in cells_of(r["text"], sep)]
            files, at, cells = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(at, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=["_file", "_row", "cells"])

    return run


def table(spark: SparkSession, path: str, sep: str = ",", empty: str | None = "") -> DataFrame:
    """Rows under the header of the first file; each file's own first record goes. All columns are text, cells that lack are null.

    empty: what empty cells are. Cells beyond the header go.
    """
    rows = records(spark, path, sep)
    head = rows.where("_first").orderBy("_file").select("cells").first()
    names = list(dict.fromkeys(head.cells)) if head else []
    if not names:
        return rows.limit(0).select()
    cell = lambda i: F.get("cells", F.lit(i)) if empty == "" else F.nullif(F.get("cells", F.lit(i)), F.lit(""))
    return rows.where(~F.col("_first")).select(*[cell(len(head.cells) - 1 - head.cells[::-1].index(c)).alias(c) for c in names])
