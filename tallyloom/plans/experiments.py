"""The three experiments: their params, what they need before they start, and a run's manifest as a DataFrame.

A run is a table of planned artifacts. What is there already is joined, the rest goes through a media backend on the executors,
a row for each artifact, and the manifest is the join of plans and results. An artifact that fails is an error of the run,
not its end.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..errors import ConfigError, SamplingError, TallyloomError, UnknownExperiment
from ..functions import items
from ..operators import chess, plans, sampling
from ..sources import manifest, media, questions
from ..storage import stored
from . import frames
from .config import Reader, Settings, run_id
from .runs import INLINE, MEDIA, TRUTH, RunFolder, RunResult, put_text

MOTIONS, MODES, FORMATS = ("static", "animated"), ("vanishing", "cumulative"), ("auto", "jsonl", "mmlu_csv")
#: Words a second where a configuration names none.
SPEEDS = {"slow": 0.5, "normal": 2.0, "fast": 5.0}
_STATS = "width int, height int, fps double, n_frames bigint, duration_sec double, codec string, file_size_bytes bigint, piped_frames bigint, skipped boolean, error string"


def stamped(rows: DataFrame, settings: Settings, run: str, now: dt.datetime) -> DataFrame:
    """rows with the run they come from; a row without a seed has the run's."""
    seed = F.coalesce(F.col("seed").cast("bigint"), F.lit(settings.run.seed)) if "seed" in rows.columns else F.lit(settings.run.seed).cast("bigint")
    return rows.withColumns({"experiment": F.lit(settings.experiment), "seed": seed, "run_id": F.lit(run), "config_hash": F.lit(settings.hash()), "pov_version": F.lit(__version__), "generated_at": F.lit(now.isoformat(timespec="seconds"))})


def made(plan: DataFrame, job: Callable[[dict, media.Backend], media.Stats], *, resume: bool, tool: media.Backend | None = None) -> DataFrame:
    """plan (with target, a file) with what its artifacts are: made by the job, or probed where resume finds them."""
    tool = tool or media.backend()
    names = [x.split()[0] for x in _STATS.split(", ")]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if not len(batch):
                continue
            out = []
            for row in batch.to_dict("records"):
                there = resume and Path(row["target"]).exists()
                try:
                    stats = media.known(row["target"], tool) if there else job(row, tool)
                    out.append((stats.width, stats.height, stats.fps, stats.n_frames, round(stats.duration_sec, 3), stats.codec, stats.file_size_bytes, 0 if there else stats.piped_frames, there, None))
                except Exception as e:  # one artifact must not end the run
                    out.append((0, 0, 0.0, 0, 0.0, "", 0, 0, False, f"{type(e).__name__}: {e}"))
            yield batch.assign(**dict(zip(names, zip(*out))))

    kind = plan.limit(0).select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in _STATS.split(", ")]).schema
    return plan.mapInPandas(run, kind)


def totals(rows: DataFrame) -> dict:
    """A run's sums: artifacts skipped and failed, frames encoded and piped, and what holding frames saved."""
    new = F.when(~F.col("skipped") & F.col("error").isNull(), True)
    r = rows.agg(F.count_if("skipped").alias("skipped"), F.sum(F.when(new, F.col("n_frames"))).alias("frames"), F.sum(F.when(new, F.col("piped_frames"))).alias("piped")).first()
    frames_, piped = r.frames or 0, r.piped or 0
    return {"skipped": r.skipped, "frames_encoded": frames_, "frames_piped": piped, "pipe_reduction": f"{1 - piped / frames_ if frames_ else 0:.1%}"}


class Experiment:
    """A configured experiment. Subclasses read params, check their inputs and plan rows."""

    name = ""

    def __init__(self, settings: Settings, now: dt.datetime | None = None):
        if settings.experiment != self.name:
            raise ConfigError(f"the configuration is for {settings.experiment!r}, not for {self.name!r}")
        self.settings, self.now = settings, now or dt.datetime.now()
        r = Reader(settings.params, "params")
        self.params = self.read(r)
        r.done()
        self.folder = RunFolder(settings.run.output_root, self.name, run_id(settings.as_dict(), self.now))

    def read(self, r: Reader): ...

    def problems(self) -> list[str]:
        """What would stop the run, before anything is written."""
        return []

    def inputs(self, spark: SparkSession) -> list[str]:
        """Lines about the data at hand."""
        return []

    def generate(self, spark: SparkSession) -> tuple[DataFrame, dict]:
        """The finished rows, with what made() adds, and statistics."""
        raise NotImplementedError

    def run(self, spark: SparkSession) -> RunResult:
        """Make the artifacts and write the manifest, by sample_id, with the configuration beside it."""
        if found := self.problems():
            raise TallyloomError("not ready to run:\n" + "\n".join(f"  - {x}" for x in found))
        was_there = self.folder.exists()
        self.folder.create(self.settings.run.overwrite)
        self.settings.snapshot(self.folder.snapshot, self.now)
        try:
            rows, stats = self.generate(spark)
            rows = stored(stamped(rows, self.settings, self.folder.run_id, self.now), "artifacts")  # so none is made twice
            errors = [(r.sample_id, r.error) for r in rows.where("error is not null").select("sample_id", "error").orderBy("sample_id").collect()]
            stats = {**totals(rows), **stats}
            good = rows.where("error is null").drop("skipped", "error", "piped_frames", "target")
            manifest.unique_ids(good)
            n = manifest.write_file(manifest.canonical(manifest.checked(good), {k.removeprefix("cfg_"): v for k, v in self.settings.columns().items()}), str(self.folder.manifest))
        except BaseException:
            if not was_there:
                self.folder.discard_if_empty()
            raise
        return RunResult(self.folder, n, stats.pop("skipped"), errors, stats)

    def _target(self, name: Column) -> Column:
        return F.concat(F.lit(f"{self.folder.path}/{MEDIA}/"), name)


# Chess


@dataclass(frozen=True)
class Timing:
    """Frames of a clip's parts. Intro and outro are at most these, and at most their shares of the clip."""

    intro_frames: int = 60
    hold_frames: int = 36
    slide_frames: int = 14
    pause_frames: int = 22
    outro_frames: int = 120
    intro_share: float = 0.10
    outro_share: float = 0.20

    def per_move(self, motion: str) -> int:
        return self.slide_frames + self.pause_frames if motion == "animated" else self.hold_frames


@dataclass(frozen=True)
class ChessParams:
    num_games: int
    durations: dict[str, float]
    motion: str
    max_half_moves: int
    max_game_attempts: int
    timing: Timing
    theme: frames.Theme
    show_labels: bool


class Chess(Experiment):
    name = "chess"

    def read(self, r: Reader) -> ChessParams:
        durations: dict[str, float] = {}
        for i, item in enumerate(r.items("durations", dict, least=1)):
            d = Reader(item, f"params.durations[{i}]")
            label = d.get("label", str)
            if label in durations:
                raise ConfigError(f"params.durations: {label!r} comes twice")
            durations[label] = d.get("seconds", float, least=0.001)
            d.done()
        t, b = r.section("timing"), r.section("theme")
        timing = Timing(*[t.get(k, int, getattr(Timing, k), least=least) for k, least in (("intro_frames", 0), ("hold_frames", 1), ("slide_frames", 1), ("pause_frames", 0), ("outro_frames", 0))], *[t.get(k, float, getattr(Timing, k), least=0, most=1) for k in ("intro_share", "outro_share")])
        if timing.intro_share + timing.outro_share >= 1:
            raise ConfigError("params.timing: intro_share and outro_share leave no room for a move")
        theme = frames.Theme(b.get("square", int, 48, least=8), b.get("padding", int, 16, least=0), b.get("panel", int, 64, least=0)).checked()
        t.done()
        b.done()
        r.get("use_svg_pieces", bool, True)  # pieces are drawn here, so it changes nothing
        return ChessParams(r.get("num_games", int, 10, least=1), durations, r.get("motion", str, "static", among=MOTIONS), r.get("max_half_moves", int, 400, least=1), r.get("max_game_attempts", int, 12, least=1), timing, theme, r.get("show_labels", bool, True))

    def clips(self, spark: SparkSession) -> DataFrame:
        """label, target_seconds and the plan of each duration: its frames, how many moves it shows and what it lasts."""
        p, fps = self.params, self.settings.video.fps
        rows = spark.createDataFrame(sorted(p.durations.items()), "label string, target_seconds double")
        plan = items.clip_plan(F.col("target_seconds"), fps=fps, per_move=p.timing.per_move(p.motion), intro=p.timing.intro_frames, outro=p.timing.outro_frames, intro_share=p.timing.intro_share, outro_share=p.timing.outro_share)
        return rows.withColumns(plan)

    @staticmethod
    def notes(clips: DataFrame) -> list[str]:
        """Clips that last a tenth more or less than their label says."""
        far = clips.where(F.abs(F.col("actual_seconds") - F.col("target_seconds")) / F.col("target_seconds") > 0.1)
        said = F.format_string("clip '%s' is %.1fs, not %ss (%d whole moves fit); duration_sec has what it is", "label", "actual_seconds", F.regexp_replace(F.col("target_seconds").cast("string"), r"\.0$", ""), "n_moves")
        return [r[0] for r in far.orderBy("label").select(said).collect()]

    def planned(self, spark: SparkSession, clips: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Every game in every clip, and the plies of the games."""
        p, run = self.params, self.settings.run
        wanted = clips.agg(F.max("n_moves")).first()[0]
        plies = chess.long_games(spark, p.num_games, seed=run.seed, wanted=wanted, limit=p.max_half_moves, attempts=p.max_game_attempts)
        games = plies.groupBy("game_index", "seed").agg(F.count("*").cast("int").alias("game_total_half_moves"), F.max("result").alias("whole_result"))
        pairs = games.crossJoin(F.broadcast(clips.select("label", "target_seconds", "n_moves", "intro_frames", "outro_frames")))  # the second side is the configured durations
        pairs = pairs.withColumn("n_half_moves", F.least("n_moves", "game_total_half_moves"))
        result = F.when(F.col("n_half_moves") >= F.col("game_total_half_moves"), F.col("whole_result")).otherwise(F.concat(F.lit("Clip ends at move "), F.col("n_half_moves").cast("string")))
        named = F.concat(F.format_string("game%04d_", "game_index"), "label")
        return pairs.select(
            named.alias("sample_id"), F.concat(F.lit("video_"), "label").alias("condition"), F.lit("video").alias("media_type"), F.concat(F.lit(f"{MEDIA}/"), named, F.lit(".mp4")).alias("media_path"),
            self._target(F.concat(named, F.lit(".mp4"))).alias("target"), "seed", F.col("game_index").cast("bigint").alias("game_index"), F.col("label").alias("duration_label"), "target_seconds", "n_half_moves",
            "game_total_half_moves", result.alias("game_result"), F.lit(p.motion).alias("motion"), F.col("intro_frames").alias("_intro"), F.col("outro_frames").alias("_outro"),
        ), plies

    def generate(self, spark: SparkSession) -> tuple[DataFrame, dict]:
        clips = self.clips(spark).cache()
        rows, plies = self.planned(spark, clips)
        shown = rows.select("sample_id", "game_index", "n_half_moves").join(plies.drop("result"), "game_index").where(F.col("ply") <= F.col("n_half_moves"))
        texts = chess.transcript_texts(shown, rows.select("sample_id", "game_index", "game_result", "n_half_moves"))
        folder, p, video, own = self.folder, self.params, self.settings.video, frames.registered()
        folder.truth("x").parent.mkdir(parents=True, exist_ok=True)
        cell = F.when(F.length("compact") <= INLINE, F.col("compact")).otherwise(F.concat(F.rtrim(F.substring("compact", 1, INLINE)), F.lit(" …[truncated, see ground_truth_path]")))
        rows = rows.join(texts, "sample_id").withColumn("ground_truth", cell).withColumn("ground_truth_path", F.concat(F.lit(f"{TRUTH}/"), "sample_id", F.lit(".txt")))

        def job(row: dict, tool: media.Backend) -> media.Stats:
            game = list(zip(*(list(row[k]) for k in ("_src", "_dst", "_no", "_boards"))))
            return tool.write(row["target"], _chess_segments(game, p, int(row["_intro"]), int(row["_outro"]), own), video)

        def truths(batches: Iterator) -> Iterator:
            for batch in batches:
                for path, text in zip(batch["ground_truth_path"], batch["transcript"]):
                    put_text(folder.resolve(path), text)
                yield batch

        out = made(rows.mapInPandas(truths, rows.schema), job, resume=self.settings.run.resume)
        stats = {"moves_per_duration": {r.label: r.n_moves for r in clips.orderBy("label").collect()}}
        if notes := self.notes(clips):
            stats["notes"] = notes
        return out.drop("compact", "transcript", "_src", "_dst", "_no", "_boards", "_intro", "_outro"), stats


def move_label(number: int, shown: bool = True) -> str:
    """The caption of a move: its number, and nothing that tells the move."""
    return f"Move {number}" if shown else ""


def _chess_segments(game: list[tuple[str, str, int, str]], p: ChessParams, intro: int, outro: int, own: frames.Painter | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """The frames of a clip and how long each is held; the last one is held for the outro as well."""
    painter = (own or frames.Pillow()) if p.show_labels and p.theme.panel else None
    at = chess.START
    if intro:
        yield frames.board(at, p.theme, label="Starting position" if p.show_labels else "", painter=painter), intro
    for k, (src, dst, number, after) in enumerate(game):
        a, b, label = chess.place(src), chess.place(dst), move_label(number, p.show_labels)
        if p.motion == "animated":
            (x0, y0), (x1, y1) = frames.origin(a, p.theme), frames.origin(b, p.theme)
            for step in range(p.timing.slide_frames):
                t = step / p.timing.slide_frames
                yield frames.board(at, p.theme, source=a, skip=a, floating=(at[a], x0 + (x1 - x0) * t, y0 + (y1 - y0) * t), label=label, painter=painter), 1
        hold = p.timing.pause_frames if p.motion == "animated" else p.timing.hold_frames
        yield frames.board(after, p.theme, source=a, target=b, label=label, painter=painter), hold + (outro if k == len(game) - 1 else 0)
        at = after


# Word by word


@dataclass(frozen=True)
class WordParams:
    path: Path
    kind: str
    limit: int | None
    shuffle: bool
    speeds: dict[str, float]
    modes: tuple[str, ...]
    static_image: bool
    gap: int
    least: int
    quality: int
    canvas: frames.Canvas


class Words(Experiment):
    name = "wbw_mcq"

    def read(self, r: Reader) -> WordParams:
        s, c = r.section("speeds"), r.section("canvas")
        for k in s.data:
            if not re.sub(r"[_-]", "", str(k)).isalnum():
                raise ConfigError(f"params.speeds: {k!r} goes into a file's name and must be letters and digits")
        speeds = {k: s.get(k, float, least=0.0001) for k in sorted(s.data)} or dict(SPEEDS)
        sizes = {k: c.get(k, int, v, least=64 if k in ("width", "height") else 6 if k.endswith("size") else 0) for k, v in vars(frames.Canvas()).items()}
        modes = tuple(dict.fromkeys(r.items("modes", str, list(MODES))))
        if odd := [m for m in modes if m not in MODES]:
            raise ConfigError(f"params.modes: unknown {odd}, there are {list(MODES)}")
        static = r.get("static_image", bool, True)
        if not modes and not static:
            raise ConfigError("params: neither static_image nor a mode, so there is nothing to make")
        for x in (s, c):
            x.done()
        return WordParams(
            r.path("questions_path"), r.get("questions_format", str, "auto", among=FORMATS), r.get("limit", int, None, least=1), r.get("shuffle", bool, False), speeds, modes, static,
            r.get("blank_gap_frames", int, 4, least=0), r.get("min_frames_per_word", int, 1, least=1), r.get("jpeg_quality", int, 90, least=1, most=100), frames.Canvas(**sizes).checked(),
        )

    def problems(self) -> list[str]:
        if not self.params.path.exists():
            return [f"questions file not found: {self.params.path}"]
        try:
            questions.load(SparkSession.active(), str(self.params.path), self.params.kind).isEmpty()
        except Exception as e:
            return [f"questions file is unreadable: {self.params.path}: {str(e).splitlines()[0]}"]
        return []

    def inputs(self, spark: SparkSession) -> list[str]:
        n = questions.load(spark, str(self.params.path), self.params.kind).count()
        return [f"questions  : {min(n, self.params.limit or n)} from {self.params.path}"]

    def planned(self, asked: DataFrame) -> DataFrame:
        """Every question in every condition: the image, and each mode at each speed."""
        p, fps = self.params, self.settings.video.fps
        seq = items.word_sequence(F.col("stem"), F.col("options"))
        wide = asked.select("id", "stem", "options", "answer", "domain", "difficulty", "source", seq.alias("words"))
        dim = [("static", None, None)] * p.static_image + [(m, s, w) for m in p.modes for s, w in p.speeds.items()]
        pairs = wide.crossJoin(F.broadcast(asked.sparkSession.createDataFrame(dim, "mode string, speed string, speed_wps double")))  # the second side is the configured conditions
        moving = F.col("mode") != "static"
        each = F.when(moving, items.frames_per_word(F.lit(float(fps)), F.col("speed_wps"), p.least))
        tail = F.when(moving, F.concat_ws("_", "mode", "speed")).otherwise("static")
        sample = F.concat_ws("_", "id", tail)
        file = F.concat(sample, F.when(moving, ".mp4").otherwise(".jpg"))
        option = lambda k: F.element_at("options", F.lit(k)).alias(f"option_{k.lower()}")
        return pairs.select(
            sample.alias("sample_id"), F.when(moving, tail).otherwise("static_image").alias("condition"), F.when(moving, "video").otherwise("image").alias("media_type"), F.concat(F.lit(f"{MEDIA}/"), file).alias("media_path"),
            self._target(file).alias("target"), F.col("answer").alias("ground_truth"), F.col("id").alias("question_id"), F.size("words").alias("word_count"), "stem", *[option(k) for k in items.LETTERS],
            F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("difficulty", F.lit("")).alias("difficulty"), F.coalesce("source", F.lit("")).alias("question_source"), "mode", "speed", "speed_wps", each.alias("frames_per_word"), F.col("words").alias("_words"),
            items.question_text(F.col("stem"), F.col("options")).alias("_text"),
        )

    def generate(self, spark: SparkSession) -> tuple[DataFrame, dict]:
        p, video = self.params, self.settings.video
        asked = questions.load(spark, str(p.path), p.kind)
        if p.shuffle:
            asked = sampling.shuffled_limit(asked, "_row", p.limit or asked.count(), self.settings.run.seed)
        elif p.limit:
            asked = asked.orderBy("_row").limit(p.limit)
        asked, own = stored(asked, "asked"), frames.registered()

        def job(row: dict, tool: media.Backend) -> media.Stats:
            painter = own or frames.Pillow()
            if row["mode"] == "static":
                return tool.picture(row["target"], frames.question(row["_text"], p.canvas, painter), p.quality)
            return tool.write(row["target"], _word_segments(list(row["_words"]), row["mode"], int(row["frames_per_word"]), p.gap, p.canvas, painter), video)

        rows = made(self.planned(asked), job, resume=self.settings.run.resume)
        return rows.drop("_words", "_text"), {"questions": asked.count(), "speeds": ", ".join(f"{k}={v:g}" for k, v in p.speeds.items())}


def _word_segments(shown: list[str], mode: str, hold: int, gap: int, canvas: frames.Canvas, painter: frames.Painter) -> Iterator[tuple[np.ndarray, int]]:
    blank = frames.words("", canvas, painter)
    for i, word in enumerate(shown):
        yield frames.words(word if mode == "vanishing" else " ".join(shown[: i + 1]), canvas, painter), hold
        if mode == "vanishing" and gap:
            yield blank, gap


# Sign language


@dataclass(frozen=True)
class ClipParams:
    metadata_csv: Path
    video_dir: Path
    delimiter: str
    id_column: str
    text_column: str
    duration_column: str | None
    extension: str
    edges: tuple[float, ...]
    labels: tuple[str, ...] | None
    per_bucket: int | None
    total: int | None
    height: int | None
    fps: int | None
    most_seconds: float | None
    use_range: bool
    start_column: str
    end_column: str
    cache: str | None
    extra: dict = field(default_factory=dict)


class SignClips(Experiment):
    name = "asl"

    def read(self, r: Reader) -> ClipParams:
        b = r.section("buckets")
        edges, labels = tuple(map(float, b.items("edges", (int, float), least=2))), b.items("labels", str, None)
        b.done()
        try:
            sampling.buckets(list(edges), labels)
        except SamplingError as e:
            raise ConfigError(f"params.buckets: {e}") from e
        per, total = r.get("samples_per_bucket", int, None, least=1), r.get("total_samples", int, None, least=1)
        if (per is None) == (total is None):
            raise ConfigError("params: exactly one of samples_per_bucket and total_samples")
        delimiter, extension = r.get("delimiter", str, "auto"), r.get("video_extension", str, ".mp4")
        if delimiter != "auto" and len(delimiter) != 1:
            raise ConfigError(f"params.delimiter: one character or auto, not {delimiter!r}")
        if not extension.startswith("."):
            raise ConfigError(f"params.video_extension: must start with a dot, is {extension!r}")
        cache = None if r.data.get("duration_cache", "auto") is None else r.get("duration_cache", str, "auto")
        r.asked.add("duration_cache")
        if cache == "auto":
            cache = str(Path(self.settings.run.output_root) / self.name / ".durations.parquet")
        r.get("probe_workers", int, 16, least=1, most=256)  # executors probe, as many as there are
        height = None if r.data.get("scale_height", 480) is None else r.get("scale_height", int, 480, least=1)
        r.asked.add("scale_height")
        most = r.get("max_clip_seconds", float, None)
        if most is not None and most <= 0:
            raise ConfigError(f"params.max_clip_seconds must be above 0, is {most}")
        return ClipParams(
            r.path("metadata_csv"), r.path("video_dir"), delimiter, r.get("id_column", str, "SENTENCE_NAME"), r.get("text_column", str, "SENTENCE"), r.get("duration_column", str, None), extension, edges, tuple(labels) if labels else None,
            per, total, height, r.get("target_fps", int, None, least=1), most, r.get("use_time_range", bool, False), r.get("start_column", str, "START"), r.get("end_column", str, "END"), cache if cache not in ("", "none", "off") else None,
        )

    def problems(self) -> list[str]:
        p, out = self.params, []
        if not p.metadata_csv.exists():
            out.append(f"metadata_csv not found: {p.metadata_csv}")
        if not p.video_dir.is_dir():
            out.append(f"video_dir not found: {p.video_dir}")
        elif not any(p.video_dir.glob(f"*{p.extension}")):
            out.append(f"video_dir has no {p.extension} files: {p.video_dir}")
        return out

    def inputs(self, spark: SparkSession) -> list[str]:
        return [f"source     : {media.listed(spark, str(self.params.video_dir), self.params.extension).count()} clips in {self.params.video_dir}"]

    def records(self, spark: SparkSession) -> DataFrame:
        """The metadata's rows, the first of each name: name, path, sentence, the range and what else a row of the manifest takes."""
        p = self.params
        rows = questions.read_table(spark, str(p.metadata_csv), [p.id_column, p.text_column], None if p.delimiter == "auto" else p.delimiter)
        rows = sampling.first_wins(rows.withColumn("_row", F.monotonically_increasing_id()), F.col(p.id_column), ["_row"])
        column = lambda c: F.col(f"`{c}`") if c and c in rows.columns else F.lit(None).cast("string")
        name = F.trim(F.col(f"`{p.id_column}`"))
        number = lambda c: column(c).try_cast("double")
        return rows.select(
            name.alias("name"), F.concat(F.lit(f"{p.video_dir.resolve()}/"), name, F.lit(p.extension)).alias("path"), F.trim(F.coalesce(column(p.text_column), F.lit(""))).alias("sentence"),
            number(p.start_column).alias("start"), number(p.end_column).alias("end"), number(p.duration_column).alias("given"), F.coalesce(column("VIDEO_ID"), F.lit("")).alias("video_id"), F.coalesce(column("SENTENCE_ID"), F.lit("")).alias("sentence_id"),
        )

    def timed(self, spark: SparkSession, rows: DataFrame, files: DataFrame) -> tuple[DataFrame, int]:
        """The rows whose video is there, with its duration, and how many had to be probed; those that can't be have none and go."""
        p = self.params
        found = rows.join(files, "path")
        if p.duration_column:
            return found.withColumn("duration", F.col("given")).where("duration is not null"), 0
        old = media.durations_cache(spark, p.cache) if p.cache else spark.createDataFrame([], media.PROBED)
        known = stored(plans.cached(found, old), "known")
        pending = known.where("duration is null").select("path", "size", "mtime").distinct()
        new = stored(media.probed(pending), "probed")
        n = new.count()
        if p.cache:
            media.save_durations(old, new, p.cache)
        both = known.where("duration is not null").unionByName(known.where("duration is null").drop("duration").join(new.select("path", "duration"), "path"))
        return both.where("duration is not null"), n

    def planned(self, rows: DataFrame) -> DataFrame:
        """The sampled rows with the part of the video that each clip takes and the bucket that it stands for."""
        p = self.params
        end = F.when(F.lit(p.use_range) & (F.col("end") > F.col("start")), F.col("end") - F.col("start"))
        sample, bucket = items.safe_id(F.col("name")), sampling.bucket_of(F.col("duration"), list(p.edges), p.labels and list(p.labels))
        file = F.concat(sample, F.lit(p.extension))
        return rows.select(
            sample.alias("sample_id"), F.concat(F.lit("video"), F.coalesce(F.concat(F.lit("_"), bucket), F.lit(""))).alias("condition"), F.lit("video").alias("media_type"), F.concat(F.lit(f"{MEDIA}/"), file).alias("media_path"),
            self._target(file).alias("target"), F.col("sentence").alias("ground_truth"), F.coalesce(bucket, F.lit("")).alias("bucket"), F.col("name").alias("source_name"), F.bround("duration", 3).alias("source_duration_sec"),
            F.col("path").alias("source_path"), "video_id", "sentence_id", F.when(F.lit(p.use_range), F.col("start")).alias("_start"), clip_seconds(end, p.most_seconds).alias("_seconds"),
        )

    def generate(self, spark: SparkSession) -> tuple[DataFrame, dict]:
        p, video = self.params, self.settings.video
        rows = stored(self.records(spark), "records")
        files = media.listed(spark, str(p.video_dir), p.extension)
        n, here = rows.count(), rows.join(files, "path", "left_semi").count()
        if not here:
            raise ConfigError(f"none of the {n} videos of {p.metadata_csv} is in {p.video_dir}")
        timed, probed = self.timed(spark, rows, files)
        timed = stored(timed, "timed")
        chosen = sampling.sample_buckets(timed, "duration", "name", list(p.edges), labels=p.labels and list(p.labels), total=p.total, per_bucket=p.per_bucket, seed=self.settings.run.seed)
        chosen = stored(chosen, "chosen")

        def job(row: dict, tool: media.Backend) -> media.Stats:
            some = lambda x: None if x is None or x != x else x
            return tool.cut(row["source_path"], row["target"], video, start=some(row["_start"]), duration=some(row["_seconds"]), height=p.height, fps=p.fps)

        counts = {r.bucket: r.n for r in sampling.bucket_counts(chosen, "duration", list(p.edges), p.labels and list(p.labels)).orderBy("ord").collect()}
        out = made(self.planned(chosen), job, resume=self.settings.run.resume)
        return out.drop("_start", "_seconds"), {"metadata_rows": n, "videos_missing": n - here, "videos_probed": probed, "bucket_counts": counts}


def clip_seconds(given: Column, most: float | None) -> Column:
    """How long a clip is: what its range gives, and no longer than most; null for the whole video."""
    return F.least(given, F.lit(most)) if most is not None else given


EXPERIMENTS: dict[str, type[Experiment]] = {c.name: c for c in (SignClips, Chess, Words)}


def register(kind: type[Experiment]) -> None:
    EXPERIMENTS[kind.name] = kind


def build(settings: Settings, now: dt.datetime | None = None) -> Experiment:
    if settings.experiment not in EXPERIMENTS:
        raise UnknownExperiment(f"unknown experiment {settings.experiment!r}, there are {sorted(EXPERIMENTS)}")
    return EXPERIMENTS[settings.experiment](settings, now)
