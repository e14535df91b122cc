"""The writer of one file: bytes as Python's writers would make them, and nothing left of a write that fails."""

import csv
import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom import storage
from tallyloom.sources import manifest, one_file

KIND = "id string, n bigint, x double, ok boolean, d date, t timestamp, m map<string,string>, s struct<a:int,b:array<string>>, said string"


def rows():
    for i in range(57):
        yield (f"s{i:03}", i if i % 5 else None, i / 7, i % 2 == 0, dt.date(2024, 1, 1), dt.datetime(2024, 5, 6, 7, 8, i), {"B": f"é{i}", "A": ""} if i % 3 else {}, (i, ["x\n", None]) if i % 4 else None, 'a "quoted",\nline\r\n中' * (i % 3))


@pytest.fixture
def table(spark):
    return spark.createDataFrame(list(rows()), KIND).repartition(5)


def left(spark):
    folder = storage.shared_dir(spark).removeprefix("file://") + "/tallyloom"
    return [x for x in os.listdir(folder) if x.startswith("parts-")] if os.path.isdir(folder) else []


def test_json_lines_equal_a_single_writer(spark, table, tmp_path):
    path = str(tmp_path / "new" / "a.jsonl")
    assert one_file.write(table, path, by="id") == 57
    want = [json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str) for r in table.orderBy("id").collect()]
    assert open(path, encoding="utf-8", newline="").read() == "".join(w + "\n" for w in want)
    assert os.listdir(tmp_path / "new") == ["a.jsonl"] and left(spark) == []


def test_csv_equals_a_single_writer(spark, table, tmp_path):
    path = str(tmp_path / "a.csv")
    one_file.write(table.select("id", "n", "x", "ok", "said"), path, by="id")
    with open(tmp_path / "want.csv", "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(["id", "n", "x", "ok", "said"])
        out.writerows([r[0], "" if r[1] is None else r[1], f"{r[2]:.6g}", str(r[3]).lower(), r[8]] for r in sorted(rows()))
    assert open(path, newline="", encoding="utf-8").read() == open(tmp_path / "want.csv", newline="", encoding="utf-8").read()
    one_file.write(table.select("id").limit(0), path)
    assert open(path, newline="").read() == "id\r\n"


def test_a_failed_task_leaves_what_was_there(spark, table, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text("before")
    bad = table.withColumn("n", F.when(F.col("id") == "s031", F.raise_error(F.lit("no"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="no"):
        one_file.write(bad, str(path), by="id")
    assert path.read_text() == "before" and os.listdir(tmp_path) == ["m.jsonl"] and left(spark) == []


def test_a_failed_join_leaves_what_was_there(spark, table, tmp_path, monkeypatch):
    path = tmp_path / "m.jsonl"
    path.write_text("before")

    def broken(*a):
        raise OSError("disk")

    monkeypatch.setattr(one_file.os, "replace", broken)
    with pytest.raises(OSError, match="disk"):
        one_file.write(table, str(path))
    assert path.read_text() == "before" and os.listdir(tmp_path) == ["m.jsonl"] and left(spark) == []


def test_names_with_dots(spark, tmp_path):
    one_file.write(spark.createDataFrame([(2, "x"), (1, "y")], "`a.b` int, `c d` string"), str(tmp_path / "a.jsonl"), by="a.b")
    assert (tmp_path / "a.jsonl").read_text() == '{"a.b": 1, "c d": "y"}\n{"a.b": 2, "c d": "x"}\n'


def test_paths_of_a_store(spark, table, tmp_path):
    for _ in range(2):
        assert manifest.write_file(table.select("id"), f"file://{tmp_path}/a.jsonl", by="id") == 57
    assert [json.loads(x)["id"] for x in open(tmp_path / "a.jsonl")] == sorted(r[0] for r in rows())
