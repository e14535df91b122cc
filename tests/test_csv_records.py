"""CSV files cut into ranges anywhere, against Python's csv module on the whole file."""

import csv
import random

import pytest

from tallyloom.sources import csv_records, manifest, questions


@pytest.fixture
def ranges(spark):
    """Files are read in ranges of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    was = {n: spark.conf.get(n, None) for n in names}

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield cut
    for n, v in was.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def whole(path, sep=","):
    with open(path, encoding="utf-8", newline="") as f:
        return [r for r in csv.reader(f, delimiter=sep) if r]


def read(spark, path, sep=","):
    return [r.cells for r in csv_records.records(spark, str(path), sep).orderBy("_row").collect()]


@pytest.mark.parametrize("size", [29, 400])
@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_csv_module(spark, tmp_path, ranges, size, seed):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(['a', 'é', ' ', ',', '"', '\n', '\r\n', '""', ';', "x" * 30, "\n\n\n"]) for _ in range(rng.randrange(5)))
    with open(tmp_path / "a.csv", "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator=rng.choice(["\n", "\r\n"]))
        out.writerow(["one", "two\nlines", "three"])
        for _ in range(60):
            out.writerow([cell() for _ in range(rng.randrange(1, 5))])
    ranges(size)
    assert read(spark, tmp_path / "a.csv") == whole(tmp_path / "a.csv")


@pytest.mark.parametrize("text", ['a,b"c,d\n"x"y,"z"\n', '"open\nto,the\nend', '\n\na\n\nb,"1\n\n2"\n', "", '""\n"",""\n', 'a\n"b\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\nc",d\ne,f', "one\rtwo\rthree,4\n"])
@pytest.mark.parametrize("size", [3, 1000])
def test_odd_files(spark, tmp_path, ranges, text, size):
    (tmp_path / "a.csv").write_text(text, encoding="utf-8", newline="")
    ranges(size)
    assert read(spark, tmp_path / "a.csv") == whole(tmp_path / "a.csv")


def test_tables_of_several_files(spark, tmp_path, ranges):
    for k in range(3):
        with open(tmp_path / f"{k}.csv", "w", encoding="utf-8", newline="") as f:
            f.write("﻿")
            out = csv.writer(f)
            out.writerow(["id", "a b", "said\nhere"])
            for i in range(40):
                out.writerow([f"{k}-{i}", "", "x\ny" * (i % 4), "more"][: 2 + i % 3])
    ranges(90)
    got = csv_records.table(spark, f"{tmp_path}/*.csv")
    assert got.columns == ["id", "a b", "said\nhere"] and got.count() == 120
    by = {r.id: r for r in got.collect()}
    assert by["1-0"][2] is None and by["2-1"][2] == "x\ny" and by["0-4"][1] == ""
    assert {r[1] for r in csv_records.table(spark, f"{tmp_path}/*.csv", empty=None).collect()} == {None}


def test_manifests_and_questions_in_ranges(spark, tmp_path, ranges):
    ranges(60)
    rows = [("s" + str(i), "asl", "c", "video", f"m/{i}.mp4", 'said "this",\nand that\n' * (i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "sample_id string, experiment string, condition string, media_type string, media_path string, ground_truth string")
    manifest.write_file(df, str(tmp_path / "m.csv"))
    back = manifest.read(spark, str(tmp_path / "m.csv"))
    assert {r.sample_id: r.ground_truth for r in back.collect()} == {r[0]: r[5] for r in rows}
    with open(tmp_path / "x_test.csv", "w", newline="") as f:
        csv.writer(f).writerows([["question", "A", "B", "C", "D", "answer"], *[[f"q{i}\nmore, \"so\"", "a", "b\nb", "c", "d", "ABCD"[i % 4]] for i in range(20)]])
    got = questions.load(spark, str(tmp_path / "x_test.csv")).orderBy("_row").collect()
    assert [(r.stem, r.answer) for r in got] == [(f'q{i}\nmore, "so"', "ABCD"[i % 4]) for i in range(20)] and {r.source for r in got} == {"x"}
