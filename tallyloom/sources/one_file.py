"""A table as one file of lines: encoded and written in parts by executors, joined on the driver by bytes, which appears whole or not at all.

The parts go to the shared folder through Spark's own writer, which keeps what a task has written only if the task ends, however
often it is tried. Joining them copies bytes, in the memory of one buffer, and a last rename shows the file under its name.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import scratch_path


def cell(v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def _plain(kind: pa.DataType) -> Callable[[object], object] | None:
    """What makes of a value from Arrow the one that a row would hold; None where they are the same."""
    if pa.types.is_timestamp(kind):
        return lambda v: v and v.replace(tzinfo=None)
    if pa.types.is_map(kind):
        key, item = _plain(kind.key_type) or (lambda v: v), _plain(kind.item_type) or (lambda v: v)
        return lambda v: v and {key(k): item(x) for k, x in v} if v != [] else {}
    if pa.types.is_list(kind) and (each := _plain(kind.value_type)):
        return lambda v: v and [each(x) for x in v]
    if pa.types.is_struct(kind):
        inner = {f.name: f_ for f in kind if (f_ := _plain(f.type))}
        return (lambda v: v and {k: inner[k](x) if k in inner else x for k, x in v.items()}) if inner else None
    return None


def json_line(names: list[str], values: tuple) -> str:
    return json.dumps(dict(zip(names, values)), ensure_ascii=False, default=str)


def csv_line(names: list[str], values: tuple) -> str:
    """A record without its line feed."""
    out = io.StringIO()
    csv.writer(out).writerow([cell(v) for v in values])
    return out.getvalue()[:-1]


def write(rows: DataFrame, path: str, *, by: str | None = None) -> int:
    """Rows as a JSONL or, by the path's end, CSV file with a header; by a column's order, else as they are dealt. Returns how many they are.

    path: on the driver, or of a store that Spark writes to. A file that is there is replaced at the end. An empty table makes an empty file, in CSV a header.
    """
    spark, names = rows.sparkSession, rows.columns
    line = csv_line if path.lower().endswith(".csv") else json_line

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = []
            for c in batch.columns:
                plain, values = _plain(c.type), c.to_pylist()
                cols.append([plain(v) for v in values] if plain else values)
            yield pa.RecordBatch.from_arrays([pa.array([line(names, v) for v in zip(*cols)], pa.string())], names=["value"])

    seen, parts = Observation(), scratch_path(spark, "parts")
    plain = rows.toDF(*[f"_{i}" for i in range(len(names))])  # a name may hold a dot
    ordered = (plain.orderBy(f"_{names.index(by)}") if by else plain).observe(seen, F.count(F.lit(1)).alias("n"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()  # noqa: SLF001
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    shared = folder.getFileSystem(conf)
    try:
        ordered.mapInArrow(run, "value string").write.option("lineSep", "\n").text(parts)
        found = sorted((int(re.match(r"part-(\d+)", p.getName())[1]), p.toString()) for p in (s.getPath() for s in shared.listStatus(folder)) if p.getName().startswith("part-"))
        join(spark, [p for _, p in found], path, (csv_line(names, tuple(names)) + "\n").encode() if line is csv_line else b"")
    finally:
        shared.delete(folder, True)
    return seen.get["n"]


def join(spark, parts: list[str], path: str, head: bytes) -> None:
    """The parts' bytes after the head, under a name of its own until all are there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()  # noqa: SLF001
    stamp = f".{os.getpid()}-{dt.datetime.now():%H%M%S%f}.part"
    if "://" in path:
        target = jvm.org.apache.hadoop.fs.Path(path)
        store = target.getFileSystem(conf)
        part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}{stamp}")
        out, drop = store.create(part), lambda: store.delete(part, False)

        def show() -> None:
            if store.exists(target):
                store.delete(target, False)
            if not store.rename(part, target):
                raise OSError(f"cannot rename {part} to {path}")
    else:
        place, name = os.path.split(os.path.abspath(path))
        os.makedirs(place, exist_ok=True)
        part = os.path.join(place, f".{name}{stamp}")
        out, drop, show = jvm.java.io.FileOutputStream(part), lambda: os.path.exists(part) and os.remove(part), lambda: os.replace(part, path)
    try:
        try:
            if head:
                out.write(bytearray(head))
            for p in parts:
                at = jvm.org.apache.hadoop.fs.Path(p)
                read = at.getFileSystem(conf).open(at)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 20, False)
                finally:
                    read.close()
        finally:
            out.close()
        show()
    except BaseException:
        drop()
        raise
