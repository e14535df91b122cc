"""Progress lines with a clock of the test's own, and those of real jobs."""

import io
import time

from pyspark.sql import functions as F

from tallyloom.plans import config, progress


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


class Terminal(io.StringIO):
    def isatty(self):
        return True


def made(states, stream):
    clock = Clock()
    return progress.Progress(lambda: states[-1], "asl", stream=stream, clock=clock), clock


def test_a_line_each_ten_seconds_off_a_terminal():
    states, out = [(0, 40)], io.StringIO()
    p, clock = made(states, out)
    for now, done in ((1, 0), (9.9, 3), (10, 10), (15, 12), (19.9, 15), (20, 20), (31, 40)):
        clock.now = now
        states.append((done, 40))
        p.tick()
    p.end()
    assert out.getvalue().splitlines() == ["asl: 10 of 40 tasks (25%), 10 s so far, about 30 s left", "asl: 20 of 40 tasks (50%), 20 s so far, about 20 s left", "asl: 40 of 40 tasks (100%), 31 s so far, about 0 s left"]


def test_without_a_total_or_anything_done():
    p, clock = made([(0, 0)], io.StringIO())
    clock.now = 12
    assert p.line() == "asl: 0 tasks, 12 s so far"
    p, clock = made([(0, 9)], io.StringIO())
    assert p.line() == "asl: 0 of 9 tasks (0%), 0 s so far"


def test_a_terminal_line_is_written_over():
    states, out = [(1, 4)], Terminal()
    p, clock = made(states, out)
    clock.now = 100
    p.tick()
    states.append((4, 4))
    clock.now = 104
    p.tick()
    p.end()
    first, second, end = out.getvalue().split("\r")[1:4]
    assert first == "asl: 1 of 4 tasks (25%), 100 s so far, about 300 s left" and second.rstrip() == "asl: 4 of 4 tasks (100%), 104 s so far, about 0 s left" and len(second) == len(first) and not end.strip()


def test_jobs_of_a_run(spark, monkeypatch):
    monkeypatch.setattr(progress, "LINE_EVERY", 0.0)
    monkeypatch.setattr(progress, "LOOK_EVERY", 0.05)
    out = io.StringIO()
    slow = F.udf(lambda x: (time.sleep(0.25), x)[1], "bigint")
    with progress.shown(spark, "asl", stream=out):
        spark.range(0, 8, 1, 8).select(slow("id")).collect()
    lines = out.getvalue().splitlines()
    assert lines and all(x.startswith("asl: ") for x in lines) and any(" of 8 tasks" in x for x in lines)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    out = io.StringIO()
    with progress.shown(spark, "asl", quiet=True, stream=out):
        spark.range(3).count()
    assert out.getvalue() == ""


def test_hashes_of_columns_equal_those_of_files(spark):
    rows = [({"run": {"seed": 1, "workers": 4, "resume": True}, "vidéo": {"fps": 29.97, "big": 1e22, "small": 1e-7, "n": None}, "b": [1, {"z": " \"", "a": []}], "ok": False},), ({},), (None,)]
    import json

    texts = spark.createDataFrame([(None if r[0] is None else json.dumps(r[0]),) for r in rows], "c string")
    want = [None if r[0] is None else config.config_hash(r[0]) for r in rows]
    assert [r[0] for r in texts.select(config.config_hashes(F.col("c"))).collect()] == want
    assert [r[0] for r in texts.select(config.config_hashes(F.parse_json("c"), "variant")).collect()] == want
    m = spark.createDataFrame([({"b": 1.5, "a": 2.0},)], "c map<string,double>").select(config.config_hashes(F.col("c"), "map")).first()[0]
    assert m == config.config_hash({"a": 2.0, "b": 1.5})
