"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names the folder. Only where it is unset, and only on a local master,
a folder of this process is used instead.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_working: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def working():
    """Tables that are stored inside are deleted at the end, but for those that go through kept()."""
    made: list[DataFrame] = []
    _working.append(made)
    try:
        yield
    finally:
        _working.pop()
        discard(*made)


def kept(df: DataFrame) -> DataFrame:
    """A stored table that outlives the innermost working(), as what is returned reads it."""
    if _working:
        _working[-1][:] = [x for x in _working[-1] if x is not df]
        if len(_working) > 1:
            _working[-2].append(df)
    return df


#: Bytes of a batch that goes to a Python worker while a table is stored; long texts then take little memory on both sides.
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Inside, batches to Python workers hold BATCH_BYTES or one row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def files_for(rows: int, each: int = 20_000) -> int:
    """How many files hold so many rows, about so many in each."""
    return max(1, -(-rows // each))


def stored(df: DataFrame, name: str, files: int | None = None, codec: str | None = None) -> DataFrame:
    """Write df once and read it back: later actions neither recompute it nor depend on the executors that made it.

    files: no more files than these, written by as many tasks; for tables of a known size that many partitions would make
    of tiny files, each of which costs processes where a file system sets permissions. codec: how it is compressed, if not as
    the session says; zstd takes less disk and more time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        (df.coalesce(files) if files else df).write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # noqa: SLF001
    if _working:
        _working[-1].append(out)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what stored() wrote for frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)  # noqa: SLF001
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
