import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def _own():
    from tallyloom.plans import catalogue

    return sorted(catalogue.SQL)


@pytest.mark.parametrize("name", _own())
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    text = lambda df: sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).map(lambda v: round(float(v), 5) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)).values.tolist()), key=str)
    assert text(got) == text(want)


def test_sources(spark, tmp_path):
    from tallyloom.sources import manifest, questions

    rows = spark.createDataFrame([("s1", "asl", "c", "video", "m/a.mp4"), ("s0", "asl", "c", "image", "m/b.jpg")], "sample_id string, experiment string, condition string, media_type string, media_path string")
    full = manifest.canonical(manifest.checked(rows), {"seed": 3})
    assert full.columns[-1] == "model_output" and "cfg_seed" in full.columns
    for name in ("m.jsonl", "m.csv"):
        path = str(tmp_path / name)
        assert manifest.write_file(full, path) == 2
        back = manifest.read(spark, path)
        assert [r.sample_id for r in back.orderBy("sample_id").collect()] == ["s0", "s1"]
    (tmp_path / "bad.jsonl").write_text('{"sample_id":"a","experiment":"b"}\nBAD\n')
    with pytest.raises(Exception, match="not a JSON object"):
        manifest.read(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "q.jsonl").write_text('{"stem":"S","options":["a","b","c","d"],"answer":"B"}\n{"id":"q_0001","stem":"T","options":["a","b","c","d"],"answer":"2"}\n')
    got = {r.stem: (r.id, r.answer) for r in questions.shaped(questions.read_json(spark, str(tmp_path / "q.jsonl"))).collect()}
    assert got == {"S": ("q_0000", "B"), "T": ("q_0001", "C")}


def test_config():
    from tallyloom.plans import config

    a = {"run": {"seed": 1, "workers": 3}, "video": {"fps": 30, "sizes": [1, 2]}}
    assert config.config_hash(a) == config.config_hash(config.merged(a, {"run": {"workers": 9}}))
    assert config.config_hash(a) != config.config_hash(config.merged(a, config.override("video.fps=25")))
    assert config.flat(a)["video.sizes"] == "[1, 2]"
    with pytest.raises(config.ConfigError):
        config.Reader({"a": True}).get("a", int)


def test_report(spark):
    from tallyloom.plans import report

    rows = spark.createDataFrame([("s", "wbw_mcq", "x", "</script>", 1.0)], "sample_id string, experiment string, condition string, model_output string, score_correct double")
    page = report.build(rows)
    assert "\\u003c/script\\u003e" in page and "<meter" in page


def test_stream(spark, tmp_path):
    from tallyloom.streaming import scores

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"ground_truth":"B","model_output":"ANSWER: B"}\n')
    q = scores.scored_stream(spark, str(tmp_path / "in"), "ground_truth string, model_output string").writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("scored").first().score_correct == 1.0
