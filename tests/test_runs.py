"""Configurations, run folders, prompts, media, the three experiments and the command line."""

import datetime as dt
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom import cli
from tallyloom.errors import ConfigError, LayoutError, MediaError, PromptError, QuestionError, SamplingError, UnknownExperiment
from tallyloom.functions import items
from tallyloom.operators import chess, evaluate, sampling
from tallyloom.plans import config, experiments, frames, prompts, report, runs
from tallyloom.sources import manifest, media, questions

NOW = dt.datetime(2024, 5, 6, 7, 8, 9)


def backend():
    """A backend that writes what a video would be as JSON; made here, so that it is sent to workers by value."""
    class Fake:
        def probe(self, path):
            if "bad" in path:
                raise MediaError("cannot be probed")
            d = json.loads(Path(path).read_text() or "{}")
            return media.Stats(d.get("w", 2), d.get("h", 2), 30.0, d.get("n", 60), d.get("s", 2.0), "h264", Path(path).stat().st_size)

        def write(self, path, segments, video):
            shown, by = media.reduced(segments)
            n = sum(k for _, k in shown)
            h, w = shown[0][0].shape[:2]
            Path(path).write_text(json.dumps({"w": w, "h": h, "n": n * by, "s": n * by / video.fps, "holds": [k * by for _, k in shown]}))
            return media.Stats(w, h, float(video.fps), n * by, n * by / video.fps, "h264", 10, n)

        def picture(self, path, frame, quality):
            Path(path).write_bytes(b"\xff\xd8\xff\xc0\x00\x11\x08" + frame.shape[0].to_bytes(2, "big") + frame.shape[1].to_bytes(2, "big") + bytes(8))
            return media.known(path, self)

        def cut(self, source, target, video, *, start, duration, height, fps):
            if "fail" in source:
                raise MediaError("cannot be cut")
            Path(target).write_text(json.dumps({"s": duration or 2.0, "start": start, "h": height}))
            return self.probe(target)

    class Blocks:
        def width(self, text, size):
            return len(text) * size / 2

        def draw(self, frame, text, x, y, size, colour):
            frame[y : y + size, x : x + int(self.width(text, size))] = colour

    return Fake(), Blocks()


@pytest.fixture
def fake():
    tool, painter = backend()
    media.register(tool)
    frames.register(painter)
    yield tool
    media.register(media.Ffmpeg())
    frames.register(None)


def test_sections():
    s = config.Settings.of({"experiment": "chess", "video": {"fps": 25, "tune": None}, "run": None})
    assert s.video.fps == 25 and s.video.tune is None and s.run.seed == 1234 and s.as_dict()["run"]["output_root"] == "data"
    assert s.hash() == config.Settings.of({"experiment": "chess", "video": {"fps": 25, "tune": None}, "run": {"workers": 2, "run_id": "x"}}).hash()
    assert s.columns()["cfg_video.fps"] == 25
    assert config.run_id(s.as_dict(), NOW) == f"20240506-070809-{s.hash()}"
    for bad in (
        {"experiment": "chess", "vidoe": {}}, {"run": {}}, {"experiment": "chess", "video": {"fps": True}}, {"experiment": "chess", "video": {"fps": 0}}, {"experiment": "chess", "video": {"crf": 52}}, {"experiment": "chess", "video": {"preset": "x"}},
        {"experiment": "chess", "video": {"tune": "x"}}, {"experiment": "chess", "run": {"run_id": ".x"}}, {"experiment": "chess", "run": {"overwrite": True}}, {"experiment": "chess", "run": {"workers": 257}}, {"experiment": "chess", "run": {"output_root": ""}}, {"experiment": "chess", "params": [1]},
    ):
        with pytest.raises(ConfigError):
            config.Settings.of(bad)
    r = config.Reader({"a": [1, 2.0], "b": None, "p": "~/x"})
    assert r.items("a", (int, float)) == [1, 2.0] and r.get("b", int, 3) == 3 and not str(r.path("p")).startswith("~")
    with pytest.raises(ConfigError):
        config.Reader({"a": [True]}).items("a", int)


def test_load_and_snapshot(tmp_path):
    (tmp_path / "c.yaml").write_text("experiment: chess\nrun: {seed: 5}\nparams: {durations: [{label: a, seconds: 1}]}\n")
    s = config.Settings.load(str(tmp_path / "c.yaml"), ["run.seed=6", "run.seed=7", "video.tune=null", "params.durations=[]"])
    assert s.run.seed == 7 and s.video.tune is None and s.params["durations"] == []
    s.snapshot(tmp_path / "s.yaml", NOW)
    assert config.load(str(tmp_path / "s.yaml"))["_meta"] == {"config_hash": s.hash(), "source_path": str(tmp_path / "c.yaml"), "written_at": "2024-05-06T07:08:09"}
    for text in ("", "[1]", "a: [", None):
        path = tmp_path / "bad.yaml"
        path.unlink(missing_ok=True)
        if text is not None:
            path.write_text(text)
        with pytest.raises(ConfigError):
            config.load(str(path))
    for bad in ("x", "=1", "a..b=1", "a=["):
        with pytest.raises(ConfigError):
            config.override(bad)


def test_folder(tmp_path):
    f = runs.RunFolder(tmp_path, "chess", "r1").create()
    assert (f.path / "media").is_dir() and not (f.path / "ground_truth").exists()
    assert f.relative(f.media("a.mp4")) == "media/a.mp4" and f.relative("x/y") == "x/y" and f.resolve("media/a.mp4") == f.media("a.mp4")
    assert f.store_truth("short", "a.txt") == ("short", "")
    cell, path = f.store_truth("x" * 1990 + " " * 10 + "y", "a.txt")
    assert cell == "x" * 1990 + runs.CUT and f.resolve(path).read_text().endswith("y")
    f.discard_if_empty()
    assert f.exists()
    f.create(overwrite=True)
    assert not (f.path / "ground_truth").exists()
    f.discard_if_empty()
    assert not (tmp_path / "chess").exists()
    for bad in ("", ".", "..", "a/b", "a\\b"):
        with pytest.raises(LayoutError):
            f.media(bad)
        with pytest.raises(LayoutError):
            runs.RunFolder(tmp_path, "chess", bad)
    with pytest.raises(LayoutError):
        f.relative("/elsewhere/a")
    text = runs.RunResult(f, 3, 1, [(f"s{i}", "e") for i in range(12)], {"notes": ["one", "two"], "k": 1}).text()
    assert "skipped (already there): 1" in text and text.count("  note: ") == 2 and "s9: e" in text and "s10: e" not in text


def test_prompts():
    assert ("asl", "judge") in prompts.available() and prompts.kinds("chess") == ["task", "task_legacy"] and prompts.experiments() == ["asl", "chess", "wbw_mcq"]
    assert prompts.placeholders("wbw_mcq", "user_text") == ["A", "B", "C", "D", "stem"] and prompts.placeholders("asl", "judge") == ["ground_truth", "model_output"]
    said = prompts.render("asl", "judge", ground_truth="{model_output}", model_output="x")
    assert "{model_output}" in said and '{"strict"' in said
    assert prompts.for_condition("wbw_mcq", "vanishing_slow") == "" and prompts.for_condition("chess", "video_5s") == prompts.get("chess")
    for f in (lambda: prompts.get("x"), lambda: prompts.get("asl", "x"), lambda: prompts.render("asl", "judge", ground_truth=""), lambda: prompts.for_condition("wbw_mcq", "x")):
        with pytest.raises(PromptError):
            f()


def test_media(spark, tmp_path, fake):
    tool = media.Ffmpeg()
    tool._program = lambda name: name
    video = config.Video(threads=2)
    made = tool.write_command("o.mp4", 8, 4, "30/6", video)
    assert made[made.index("-s") + 1] == "8x4" and made[made.index("-framerate") + 1] == "30/6" and made[-3:] == ["-tune", "stillimage", "o.mp4"] and made[made.index("-threads") + 1] == "2"
    cut = tool.cut_command("a", "b", video, start=1, duration=2.5, height=480, fps=24)
    assert cut.index("-ss") < cut.index("-i") and cut[cut.index("-t") + 1] == "2.500" and "scale=-2:480" in cut and cut[cut.index("-r") + 1] == "24"
    for bad in ({"start": -1}, {"duration": 0}):
        with pytest.raises(MediaError):
            tool.cut_command("a", "b", video, **bad)
    got = media.described({"streams": [{"width": 2, "height": 4, "avg_frame_rate": "0/0", "r_frame_rate": "30/1", "nb_frames": "N/A", "codec_name": "h264"}], "format": {"duration": "2.0"}}, 9)
    assert (got.fps, got.n_frames, got.duration_sec, got.file_size_bytes) == (30.0, 60, 2.0, 9)
    with pytest.raises(MediaError):
        media.described({"streams": []}, 0)
    assert [n for _, n in media.reduced([(0, 60), (1, 0), (2, 4)])[0]] == [15, 1] and media.reduced([])[1] == 1
    assert media.rgb(np.full((2, 3), 300.0)).tolist() == [[[255] * 3] * 3] * 2 and media.rgb(np.zeros((2, 2, 4))).shape == (2, 2, 3)
    with pytest.raises(MediaError):
        media.rgb(np.zeros(3))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + bytes(8) + (640).to_bytes(4, "big") + (480).to_bytes(4, "big"))
    assert media.image_size(str(tmp_path / "a.png")) == (640, 480)
    for name in ("a.mp4", "b.mp4", "bad.mp4", "c.txt"):
        (tmp_path / name).write_text('{"s": 3.5}')
    files = media.listed(spark, str(tmp_path), ".mp4")
    assert {Path(r.path).name for r in files.collect()} == {"a.mp4", "b.mp4", "bad.mp4"}
    got = media.probed(files)
    assert {Path(r.path).name: r.duration for r in got.collect()} == {"a.mp4": 3.5, "b.mp4": 3.5, "bad.mp4": None}
    cache = str(tmp_path / "cache")
    assert media.durations_cache(spark, cache).count() == 0 and media.save_durations(media.durations_cache(spark, cache), got, cache)
    assert media.durations_cache(spark, cache).count() == 2 and not media.save_durations(media.durations_cache(spark, cache), got.limit(0), cache)


def test_frames():
    theme = frames.Theme(square=8, padding=2, panel=4).checked()
    at = frames.board(chess.START, theme)
    assert at.shape == (72, 68, 3) and (at[2 + 8 * 4 + 1, 3] != at[2 + 8 * 5 + 1, 3]).any()
    moved = frames.board(chess.START, theme, source=52, target=36, skip=52, floating=("P", 34.0, 40.0))
    assert (moved != at).any() and (frames.board(chess.START, theme) == at).all()
    assert frames.wrapped("aa bb cc\n\ndddddd e", 5, len) == ["aa bb", "cc", "", "dddddd", "e"]
    for bad in (lambda: frames.Theme(square=7).checked(), lambda: frames.Theme(panel=1).checked(), lambda: frames.Canvas(width=65).checked(), lambda: frames.Canvas(width=64, video_padding=32).checked()):
        with pytest.raises(ConfigError):
            bad()
    page = frames.words("one two", frames.Canvas(), backend()[1])
    assert page.shape == (800, 1200, 3) and (page == 0).any() and (frames.words("", frames.Canvas(), backend()[1]) == 255).all()


def settings(tmp_path, name, params, **run):
    return config.Settings.of({"experiment": name, "run": {"output_root": str(tmp_path / "out"), "run_id": "r", "seed": 7, **run}, "params": params})


@pytest.mark.parametrize("motion", ["static", "animated"])
def test_chess_run(spark, tmp_path, fake, motion):
    s = settings(tmp_path, "chess", {"num_games": 2, "durations": [{"label": "1s", "seconds": 1}, {"label": "5s", "seconds": 5}], "motion": motion, "max_half_moves": 8, "max_game_attempts": 2, "theme": {"square": 8, "padding": 2, "panel": 12}})
    made = experiments.build(s, NOW)
    clips = {r.label: r for r in made.clips(spark).collect()}
    assert made.notes(made.clips(spark)) and clips["5s"].total_frames == clips["5s"].intro_frames + clips["5s"].n_moves * 36 + clips["5s"].outro_frames
    result = made.run(spark)
    assert result.ok and result.n_rows == 4 and result.stats["moves_per_duration"] == {"1s": clips["1s"].n_moves, "5s": clips["5s"].n_moves}
    rows = [json.loads(x) for x in made.folder.manifest.read_text().splitlines()]
    assert [r["sample_id"] for r in rows] == ["game0000_1s", "game0000_5s", "game0001_1s", "game0001_5s"] and list(rows[0])[-1] == "model_output" and rows[0]["cfg_run.seed"] == 7
    for r in rows:
        n = min(clips[r["duration_label"]].n_moves, r["game_total_half_moves"])
        text = made.folder.resolve(r["ground_truth_path"]).read_text()
        assert r["n_half_moves"] == n and r["ground_truth"].count(";") == n - 1 and text.endswith(f"Result: {r['game_result']}\nTotal half-moves: {n}\n") and text.splitlines()[5].startswith("1       White     ")
        holds = json.loads(made.folder.resolve(r["media_path"]).read_text())["holds"]
        plan = clips[r["duration_label"]]
        per = [36] if motion == "static" else [1] * 14 + [22]
        want = [plan.intro_frames] + per * n
        want[-1] += plan.outro_frames
        assert holds == want and r["n_frames"] == sum(want) and r["config_hash"] == s.hash() and r["generated_at"] == "2024-05-06T07:08:09"
    again = experiments.build(s, NOW).run(spark)
    assert again.n_skipped == 4 and again.n_rows == 4


def test_captions_do_not_tell_the_move():
    assert experiments.move_label(8) == "Move 8" and experiments.move_label(8, False) == ""


def test_words_run(spark, tmp_path, fake):
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps({"id": f"q{i}", "question": f"what is {i}", "choices": ["a", "b b", "c", "d"], "answer": i % 4, "subject": "x"}) for i in range(3)) + "\n")
    params = {"questions_path": str(tmp_path / "q.jsonl"), "limit": 2, "speeds": {"fast": 5, "slow": 1}, "canvas": {"width": 64, "height": 64, "video_padding": 4, "static_padding": 4}}
    made = experiments.build(settings(tmp_path, "wbw_mcq", params), NOW)
    assert made.problems() == [] and made.inputs(spark) == [f"questions  : 2 from {tmp_path}/q.jsonl"]
    result = made.run(spark)
    rows = {r["sample_id"]: r for r in map(json.loads, made.folder.manifest.read_text().splitlines())}
    assert result.n_rows == 10 and set(r["condition"] for r in rows.values()) == {"static_image", "vanishing_fast", "vanishing_slow", "cumulative_fast", "cumulative_slow"}
    words = 3 + 4 + 5
    one = rows["q1_vanishing_slow"]
    assert one["word_count"] == words and one["n_frames"] == words * (30 + 4) and rows["q1_cumulative_fast"]["n_frames"] == words * 6 and one["ground_truth"] == "B" and one["option_b"] == "b b"
    static = rows["q0_static"]
    assert static["media_type"] == "image" and (static["width"], static["height"], static["n_frames"], static["fps"], static["speed_wps"], static["frames_per_word"]) == (64, 64, 1, 0.0, None, None)
    shuffled = experiments.build(settings(tmp_path, "wbw_mcq", params | {"shuffle": True}, workers=1), NOW)
    shuffled.folder.path  # the same folder, so all is there already
    import random

    ids = [0, 1, 2]
    random.Random(7).shuffle(ids)
    assert shuffled.run(spark).n_rows == 10
    assert {json.loads(x)["question_id"] for x in shuffled.folder.manifest.read_text().splitlines()} == {f"q{i}" for i in ids[:2]}


def test_clips_run(spark, tmp_path, fake):
    videos = tmp_path / "v"
    videos.mkdir()
    names = [f"clip {i}" for i in range(6)]
    for i, n in enumerate([*names, "bad", "fail"]):
        (videos / f"{n}.mp4").write_text(json.dumps({"s": float(i)}))
    lines = ["SENTENCE_NAME\tSENTENCE\tSTART\tEND", *[f"{n}\tsays {n} \t1\t{3 + i}" for i, n in enumerate([*names, "bad", "fail", "gone", names[0], ""])]]
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    params = {"metadata_csv": str(tmp_path / "m.csv"), "video_dir": str(videos), "buckets": {"edges": [0, 3, 100], "labels": ["short", "long"]}, "samples_per_bucket": 9, "use_time_range": True, "max_clip_seconds": 4}
    made = experiments.build(settings(tmp_path, "asl", params), NOW)
    assert made.problems() == [] and made.inputs(spark) == [f"source     : 8 clips in {videos}"]
    result = made.run(spark)
    assert result.stats["videos_missing"] == 1 and result.stats["videos_probed"] == 8 and result.stats["bucket_counts"] == {"short": 3, "long": 4}
    assert [i for i, _ in result.errors] == ["fail"] and not result.ok
    rows = {r["sample_id"]: r for r in map(json.loads, made.folder.manifest.read_text().splitlines())}
    assert set(rows) == {f"clip_{i}" for i in range(6)} and rows["clip_4"]["condition"] == "video_long" and rows["clip_4"]["ground_truth"] == "says clip 4" and rows["clip_4"]["source_duration_sec"] == 4.0
    assert rows["clip_0"]["duration_sec"] == 2.0 and rows["clip_5"]["duration_sec"] == 4.0
    again = experiments.build(settings(tmp_path, "asl", params), NOW).run(spark)
    assert again.stats["videos_probed"] == 1 and again.n_skipped == 6  # the one that can't be probed is tried again


def test_bad_params(tmp_path):
    clips = {"metadata_csv": "m", "video_dir": "v", "buckets": {"edges": [0, 3]}, "total_samples": 2}
    words = {"questions_path": "q"}
    games = {"durations": [{"label": "a", "seconds": 1}]}
    for name, params in (
        ("asl", clips | {"samples_per_bucket": 1}), ("asl", {k: v for k, v in clips.items() if k != "total_samples"}), ("asl", clips | {"delimiter": "ab"}), ("asl", clips | {"video_extension": "mp4"}), ("asl", clips | {"buckets": {"edges": [3, 0]}}),
        ("asl", clips | {"buckets": {"edges": [0, 3], "labels": ["a", "b"]}}), ("asl", clips | {"max_clip_seconds": 0}), ("asl", clips | {"x": 1}), ("wbw_mcq", {}), ("wbw_mcq", words | {"limit": 0}), ("wbw_mcq", words | {"modes": ["x"]}), ("wbw_mcq", words | {"modes": [], "static_image": False}),
        ("wbw_mcq", words | {"speeds": {"a b": 1}}), ("wbw_mcq", words | {"speeds": {"a": 0}}), ("wbw_mcq", words | {"canvas": {"width": 65}}), ("chess", {}), ("chess", {"durations": games["durations"] * 2}), ("chess", games | {"motion": "x"}),
        ("chess", games | {"timing": {"intro_share": 0.5, "outro_share": 0.5}}), ("chess", games | {"theme": {"square": 9, "panel": 1}}),
    ):
        with pytest.raises(ConfigError):
            experiments.build(settings(tmp_path, name, params))
    with pytest.raises(UnknownExperiment):
        experiments.build(settings(tmp_path, "none", {}))
    assert experiments.build(settings(tmp_path, "asl", clips)).problems() == ["metadata_csv not found: m", "video_dir not found: v"]
    made = experiments.build(settings(tmp_path, "wbw_mcq", words | {"modes": ["cumulative", "vanishing", "cumulative"]}))
    assert made.params.modes == ("cumulative", "vanishing") and made.params.speeds == experiments.SPEEDS


def test_questions(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    rows = [
        {"stem": "one", "options": {"A": "a", "B": "b", "C": "c", "D": "d"}, "answer": "b"}, {"id": "q_0000", "question": "two", "choices": ["a", "b", "c", "d"], "answer": 3, "subject": "s"},
        {"qid": "x", "question": "three", "options": ["1", "2", "3", "4"], "correct": "4"}, {"question": "four", "A": "a", "B": 2, "C": "c", "D": "d", "answer": "0"},
    ]
    path.write_text("\n\n".join(map(json.dumps, rows)))
    got = {r.stem: r for r in questions.load(spark, str(path)).collect()}
    assert {k: (r.id, r.answer) for k, r in got.items()} == {"one": ("q_0001", "B"), "two": ("q_0000", "D"), "three": ("x", "D"), "four": ("q_0002", "A")} and got["four"].options["B"] == "2" and got["two"].source == "s"
    d = questions.load(spark, str(path)).select(questions.as_dict().alias("d")).where("d.stem = 'one'").first().d
    assert d.word_count == 9 and list(d.word_sequence) == ["one", "(A)", "a", "(B)", "b", "(C)", "c", "(D)", "d"]
    for bad, at in (('{"stem": "x"}', "options"), ("BAD", "JSON"), ("[1]", "JSON"), ('{"stem":"x","choices":["a","b"],"answer":1}', "four"), ('{"stem":"x","choices":["a","b","c","d"],"answer":true}', "answer"), ('{"stem":"x","choices":["a","b","c","d"],"answer":4}', "answer"), ('{"choices":["a","b","c","d"],"answer":1}', "stem")):
        path.write_text(json.dumps(rows[0]) + "\n\n" + bad + "\n")
        with pytest.raises(QuestionError, match=f"q.jsonl:3: .*{at}"):
            questions.load(spark, str(path))
    path.write_text("\n".join(json.dumps(r | {"id": "same"}) for r in rows[:2]))
    with pytest.raises(QuestionError, match="repeat"):
        questions.load(spark, str(path))
    path.write_text("")
    for p, kind in ((str(path), "auto"), (str(tmp_path / "none.jsonl"), "auto"), (str(path), "x")):
        with pytest.raises(QuestionError):
            questions.load(spark, p, kind)
    table = tmp_path / "high_school_physics_test.csv"
    table.write_text('question,A,B,C,D,answer\n"a, b",1,2,3,4,C\n\n"two\nlines",1,2,3,4,1\nlast,1,2,3,4,D,more\n')
    got = questions.load(spark, str(table)).orderBy("id").collect()
    assert [(r.id, r.stem, r.answer, r.source) for r in got] == [("q_0000", "a, b", "C", "high school physics"), ("q_0001", "two\nlines", "B", "high school physics"), ("q_0002", "last", "D", "high school physics")]
    table.write_text("a,1,2,3,4,C\nb,1,2\n")
    with pytest.raises(QuestionError, match="6 cells"):
        questions.load(spark, str(table))


def test_question_set(spark, tmp_path, capsys):
    import random

    for name, n in (("law_test", 7), ("anatomy_dev", 3), ("virology_val", 5)):
        (tmp_path / f"{name}.csv").write_text("".join(f"{name} {i} {'w ' * i},a,b,c,d,{'ABCDE'[i % 5]}\n" for i in range(n)) + "short,1\n")
    raw = questions.from_folder(spark, str(tmp_path))
    assert raw.count() == 15 and {r.subject for r in raw.collect()} == {"law", "anatomy", "virology"} and questions.from_folder(spark, str(tmp_path), ["law"]).count() == 7
    good = questions.usable(raw)
    assert good.count() == 13 and {r.domain for r in good.where("source = 'virology'").collect()} == {"medical"}
    out = questions.chosen(good, limit=7, max_words=13).orderBy("id").collect()
    assert [r.id for r in out] == [f"q_{i:05d}" for i in range(7)] and [r.source for r in out][:3] == ["anatomy", "law", "virology"]
    kept = [r for r in good.orderBy("_row").collect() if 2 + int(r.stem.split()[1]) + 8 <= 13]
    by: dict = {}
    for r in kept:
        by.setdefault(r.source, []).append(r.stem)
    rng = random.Random(42)
    for pool in by.values():
        rng.shuffle(pool)
    want = [by[s][d] for d in range(9) for s in sorted(by) if d < len(by[s])][:7]
    assert [r.stem for r in out] == want
    assert cli.main(["questions", "--from-csv", str(tmp_path), "--out", str(tmp_path / "set.jsonl"), "--limit", "7", "--max-words", "13"]) == 0
    assert "wrote 7 questions" in capsys.readouterr().out and questions.load(spark, str(tmp_path / "set.jsonl")).count() == 7


def test_ranked_equals_a_window(spark):
    from pyspark.sql import Window

    rows = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 5).alias("g"), F.xxhash64("id").alias("o"))
    want = {r.id: r.k for r in rows.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("o"))).collect()}
    assert {r.id: r["rank"] for r in sampling.ranked(rows, ["g"], ["o"]).collect()} == want
    assert sampling.ranked(rows.limit(0), [], ["o"]).count() == 0
    assert sampling.identity(rows).__class__.__name__ == "Column" and rows.withColumnRenamed("o", "name").select(sampling.identity(rows).alias("x")).first().x
    with pytest.raises(SamplingError):
        sampling.allocate(1, 0)


def test_board_lines():
    text = chess.drawn(chess.START).split("\n")
    assert len(text) == 19 and text[0] == "    a  b  c  d  e  f  g  h" and text[2] == "8 ║r │n │b │q │k │b │n │r ║ 8" and text[6] == "6 ║. │  │. │  │. │  │. │  ║ 6"
    assert chess.place("e4") == 36 and chess.square(36) == "e4"
    with pytest.raises(ValueError):
        chess.place("i9")


def test_long_games(spark):
    got = chess.long_games(spark, 2, seed=3, wanted=5, limit=6, attempts=2).groupBy("game_index", "seed").count().orderBy("game_index").collect()
    assert [tuple(r) for r in got] == [(0, 3, 6), (1, 4, 6)]
    assert chess.long_enough(0, 0, 99, 6, 3)[0] == 0  # ties fall to the first attempt


def test_metrics_of(spark):
    rows = spark.createDataFrame([("a", "1.5", "x", True, 2.0, "", "7"), ("b", "", "2", False, None, "", "z")], "sample_id string, score_a string, score_b string, score_c boolean, score_d double, score_e string, score_f string")
    assert evaluate.metrics_of(rows) == ["score_a", "score_b", "score_d", "score_f"] and evaluate.metrics_of(rows, all_numbers=True) == ["score_a", "score_d"]


def test_report_parts(spark):
    rows = spark.createDataFrame([("media/a.MP4",), ("b.png",), ("c.txt",), (None,)], "p string")
    got = rows.select(report.media_kind(F.col("p")).alias("k"), report.media_link(F.col("p"), "/r/run", "/r").alias("l")).collect()
    assert [(r.k, r.l) for r in got] == [("video", "run/media/a.MP4"), ("image", "run/b.png"), ("", "run/c.txt"), ("", "")]


def test_command_line(spark, tmp_path, capsys, fake):
    run = cli.main
    assert run(["experiments"]) == 0 and capsys.readouterr().out.split() == ["asl", "chess", "wbw_mcq"]
    assert run(["prompt", "--list"]) == 0 and "asl      judge  (fields: ground_truth, model_output)" in capsys.readouterr().out
    assert run(["prompt", "chess"]) == 0 and "Move 1: White Pawn e2e4" in capsys.readouterr().out
    assert run(["prompt"]) == 2 and run(["prompt", "asl", "-k", "task", "--condition", "x"]) == 2 and run(["prompt", "none"]) == 2 and run(["prompt", "wbw_mcq", "--condition", "x"]) == 2
    (tmp_path / "c.yaml").write_text("experiment: chess\nparams: {num_games: 1, max_half_moves: 4, durations: [{label: a, seconds: 1}], theme: {square: 8, padding: 2, panel: 0}}\n")
    conf = ["-c", str(tmp_path / "c.yaml"), "--set", f"run.output_root={tmp_path}/out", "--set", "run.run_id=r"]
    assert run(["validate", *conf]) == 0 and "OK (chess" in capsys.readouterr().out
    assert run(["generate", "--dry-run", *conf]) == 0 and "nothing was written" in capsys.readouterr().out and not (tmp_path / "out").exists()
    assert run(["generate", "-q", *conf]) == 0 and "1 artifact(s)" in capsys.readouterr().out
    for bad in (["--set", "video.fps=0"], ["--set", "experiment=none"], ["--set", "x"]):
        assert run(["validate", *conf, *bad]) == 2
    assert run(["validate", "-c", str(tmp_path / "none.yaml")]) == 2 and "config error" in capsys.readouterr().err
    (tmp_path / "w.yaml").write_text("experiment: wbw_mcq\nparams: {questions_path: /nowhere/q.jsonl}\n")
    assert run(["generate", "--dry-run", "-c", str(tmp_path / "w.yaml")]) == 2 and "NOT ready" in capsys.readouterr().err
    path = tmp_path / "out/chess/r/manifest.jsonl"
    row = json.loads(path.read_text())
    truth = (path.parent / row["ground_truth_path"]).read_text()
    path.write_text("\n".join(json.dumps(row | {"sample_id": f"s{i}", "model_output": out, "model": "m"}) for i, out in enumerate((truth, "", "Move 1: White Pawn a2a3"))) + "\n")
    assert run(["eval", "-i", str(path), "-o", str(tmp_path / "e"), "--report", str(tmp_path / "e/r.html")]) == 0
    said = capsys.readouterr().out
    assert "Scored 3 row(s) across chess" in said and "1 row(s) had an empty model_output" in said
    scored = [json.loads(x) for x in (tmp_path / "e/scored.jsonl").read_text().splitlines()]
    assert scored[0]["score_strict"] == 1.0 and scored[1]["score_strict"] == 0.0 and scored[1]["score_moves_expected"] == row["n_half_moves"]
    assert run(["report", "-i", str(tmp_path / "e/scored.jsonl"), "--title", "T"]) == 0 and "<h1>T</h1>" in (tmp_path / "e/scored.html").read_text()
    assert "media linked" in (tmp_path / "e/r.html").read_text()
    assert run(["eval", "-i", str(path), "--group-by", "nothing"]) == 2 and run(["eval", "-i", str(tmp_path / "none.jsonl")]) == 2
    capsys.readouterr()
    (path.parent / row["ground_truth_path"]).unlink()
    assert run(["eval", "-i", str(path)]) != 0
    (tmp_path / "bad.jsonl").write_text('{"sample_id": "a", "experiment": "chess"}\n\nBAD\n')
    assert run(["eval", "-i", str(tmp_path / "bad.jsonl")]) == 2 and "bad.jsonl:3: not a JSON object" in capsys.readouterr().err
    (tmp_path / "odd.jsonl").write_text('{"sample_id": "a", "experiment": "none", "model_output": "x"}\n')
    assert run(["eval", "-i", str(tmp_path / "odd.jsonl")]) == 2


def test_interrupts_and_faults(monkeypatch, capsys):
    for error, code in ((KeyboardInterrupt, 130), (RuntimeError("x"), 1), (FileNotFoundError("f"), 2)):

        def fail(args, error=error):
            raise error

        monkeypatch.setattr(cli, "experiments", fail)
        assert cli.main(["experiments"]) == code
    assert "internal error: RuntimeError: x" in capsys.readouterr().err


def test_reserved_names():
    manifest.reserved(["a"])
    with pytest.raises(manifest.ManifestError):
        manifest.reserved(["fps", "model_output"])


def test_codec():
    assert items.CODEC_NAMES["libx264"] == "h264"


def test_package_names(spark):
    import tallyloom

    assert tallyloom.Settings is config.Settings and tallyloom.evaluate is evaluate.evaluate and tallyloom.prompts is prompts and tallyloom.build is experiments.build
    assert all(getattr(tallyloom, n) is not None for n in tallyloom.__all__)
    with pytest.raises(AttributeError):
        tallyloom.nothing
    assert tallyloom.register_functions(spark) == ["tallyloom_normalise", "tallyloom_word_edits"]
    r = spark.sql("select tallyloom_normalise('The ﬁne Été!') as t, tallyloom_word_edits(array('a', 'b'), array('a', 'c', 'd')) as n").first()
    assert (r.t, r.n) == ("fine ete", 2)


def test_templates_are_filled_once(spark):
    rows = spark.createDataFrame([("{a} and {b}, {{a}} {a}", "{b}", "X"), ("{b}{a}", None, "Y")], "t string, a string, b string")
    assert [r.x for r in rows.select(items.render(F.col("t"), {"a": F.col("a"), "b": F.col("b")}).alias("x")).collect()] == ["{b} and X, {a} {b}", None]
    with pytest.raises(Exception, match="fields"):
        rows.select(items.render(F.col("t"), {"a": F.col("a")}).alias("x")).collect()


def test_first_wins(spark):
    rows = spark.createDataFrame([(3, " a", "x"), (1, "a ", "y"), (2, None, "z"), (4, " ", "w"), (5, "b", "v")], "n int, k string, o string")
    assert sorted(tuple(r) for r in sampling.first_wins(rows, F.col("k"), ["n"]).collect()) == [(1, "a ", "y"), (5, "b", "v")]


def test_intermediate_tables(spark):
    from tallyloom import storage

    rows = spark.range(10)
    with storage.working():
        gone = storage.stored(rows, "a", 1)
        with storage.working():
            inner = storage.kept(storage.stored(rows, "b"))
        stays = storage.kept(storage.stored(rows, "c"))
        assert gone.count() == inner.count() == 10
    assert stays.count() == 10 and storage.files_for(0) == 1 and storage.files_for(20_001) == 2
    for df in (gone, inner):
        with pytest.raises(Exception):
            df.count()
    storage.discard(stays)


def test_question_numbers_past_five_digits(spark):
    rows = spark.range(100_002).selectExpr("id as _row", "'s' as stem", "map('A', 'a', 'B', 'b', 'C', 'c', 'D', 'd') as options", "'x' as source")
    out = questions.chosen(rows.orderBy("_row"))
    assert out.select("id").distinct().count() == 100_002
    assert [(r.id, r._row) for r in out.where("_row in (0, 99999, 100000, 100001)").orderBy("_row").collect()] == [("q_00000", 0), ("q_99999", 99999), ("q_100000", 100000), ("q_100001", 100001)]


def test_clip_timeline_counts_plies(spark):
    from tallyloom.operators import plans

    sizes = {1: 1, 2: 3, 3: 4, 4: 9, None: 2}
    rows = spark.createDataFrame([(g, (7 * i) % 5) for g, n in sizes.items() for i in range(n)], "g bigint, p int")
    for n_moves in (0, 1, 4):
        out = plans.clip_timeline(rows, "g", "p", n_moves=n_moves, per_move=36, intro=60, outro=120)
        want = [(g, k, 60 if k == 0 else 36 + 120 * (k == min(n, n_moves))) for g, n in sizes.items() if n_moves for k in range(min(n, n_moves) + 1)]
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and out.dtypes == [("g", "bigint"), ("seg", "int"), ("hold", "int")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan  # no task holds a game's plies, or sorts them
