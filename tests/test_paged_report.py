"""Reports of many rows: what the pages beside them hold."""

import json
import os
import re

from pyspark.sql import functions as F

from tallyloom.plans import report


def called(path, name):
    text = open(path, encoding="utf-8").read().strip()
    assert text.startswith(f"report.{name}(") and text.endswith("])")
    return json.loads("[" + text[len(f"report.{name}(") : -1] + "]")


def test_pages_and_orders_hold_every_row(spark, tmp_path):
    n = 1030
    rows = spark.range(0, n, 1, 5).select(
        F.format_string("s%05d", (F.col("id") * 7) % n).alias("sample_id"), F.lit("asl").alias("experiment"), F.concat(F.lit("c<"), F.col("id") % 3).alias("condition"), F.when(F.col("id") % 2 == 0, "media/a.mp4").alias("media_path"),
        F.lit("</script>\ntruth").alias("ground_truth"), F.lit("é out").alias("model_output"), F.when(F.col("id") % 10 > 0, (F.col("id") * 13 % 100) / 100).alias("score_wer"), F.col("id").alias("extra"),
    )
    path = report.write_paged(rows, str(tmp_path / "r.html"), page_rows=100)
    page = open(path, encoding="utf-8").read()
    index = json.loads(re.search(r"<script id=index type=application/json>(.*?)</script>", page)[1])
    assert index == {"data": "r_data", "rows": n, "pageRows": 100, "pages": 11, "conditions": ["c<0", "c<1", "c<2"], "metrics": ["wer"]} and f"<b>{n}</b> samples" in page and f"<b>{n // 2}</b> media linked" in page
    assert sorted(os.listdir(tmp_path / "r_data")) == sorted([f"page-{k:05d}.js" for k in range(11)] + [f"order0-{k:05d}.js" for k in range(11)])
    held = []
    for k in range(11):
        text = open(tmp_path / f"r_data/page-{k:05d}.js", encoding="utf-8").read()
        assert "</script>" not in text and text.count("\n") <= 1
        at, some = called(tmp_path / f"r_data/page-{k:05d}.js", "page")
        assert at == k and len(some) == (100 if k < 10 else 30)
        held += some
    assert [r["id"] for r in held] == [f"s{i:05d}" for i in range(n)] and held[0]["groundTruth"] == "</script>\ntruth" and held[3]["details"]["extra"]
    places = [p for k in range(11) for p in called(tmp_path / f"r_data/order0-{k:05d}.js", "order")[2]]
    assert sorted(places) == list(range(n))
    scores = [held[p]["scores"].get("wer", float("-inf")) for p in places]
    assert scores == sorted(scores) and scores.count(float("-inf")) == 103


def test_rows_that_fit_stay_in_the_page(spark, tmp_path, monkeypatch):
    rows = spark.range(30).select(F.col("id").cast("string").alias("sample_id"), F.lit("asl").alias("experiment"), F.lit("c").alias("condition"), F.lit(0.5).alias("score_wer"))
    report.write(rows, str(tmp_path / "a.html"))
    assert os.listdir(tmp_path) == ["a.html"] and "id=data" in (tmp_path / "a.html").read_text()
    monkeypatch.setattr(report, "HELD_ROWS", 20)
    report.write(rows, str(tmp_path / "b.html"), title="B")
    assert sorted(os.listdir(tmp_path)) == ["a.html", "b.html", "b_data"] and "<h1>B</h1>" in (tmp_path / "b.html").read_text()
    report.write(rows, str(tmp_path / "c.html"), max_samples=3)
    assert "id=data" in (tmp_path / "c.html").read_text()
