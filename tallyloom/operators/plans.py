"""What is still to do, and how long it takes: resumes, caches, conditions, timelines, clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import items


def to_build(planned: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    return planned.join(existing, on, "left_anti")


def built(planned: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    return planned.join(existing, on, "left_semi")


def cached(rows: DataFrame, cache: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """rows (path, size, mtime) with the cached duration, where size is equal and mtime within tolerance."""
    c = cache.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), "duration")
    same = (F.col("path") == F.col("_path")) & (F.col("size") == F.col("_size")) & (F.abs(F.col("mtime") - F.col("_mtime")) <= tolerance)
    return rows.join(c, same, "left").drop("_path", "_size", "_mtime")


def ground_truth(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows with truth: of the file that ground_truth_path names (files: path, content), else inline; a path without file raises."""
    f = files.select(F.col("path").alias("ground_truth_path"), "content", F.lit(True).alias("_there"))
    got = rows.join(f, "ground_truth_path", "left")
    named = F.trim(F.coalesce("ground_truth_path", F.lit(""))) != ""
    dangling = named & F.col("_there").isNull()
    truth = F.when(dangling, F.raise_error(F.concat(F.lit("no file "), F.col("ground_truth_path")))).when(named, F.col("content")).otherwise(F.coalesce("ground_truth", F.lit("")))
    return got.withColumn("truth", truth).drop("content", "_there")


def conditions(questions: DataFrame, speeds: list[tuple[str, float]], modes: list[str], *, fps: int = 30, gap: int = 6) -> DataFrame:
    """Questions (question_id, word_count) by mode and speed, with frames: cumulative shows words only, vanishing adds gaps."""
    spark = questions.sparkSession
    dim = F.broadcast(spark.createDataFrame([(m, s, float(w)) for m in modes for s, w in speeds], "mode string, speed string, speed_wps double"))
    out = questions.crossJoin(dim)  # the second side is the configured conditions
    each = items.frames_per_word(F.lit(float(fps)), F.col("speed_wps"))
    frames = F.col("word_count") * (F.col("frames_per_word") + F.when(F.col("mode") == "vanishing", gap).otherwise(0))
    return out.withColumn("frames_per_word", each).withColumn("n_frames", frames.cast("bigint")).withColumn("duration_sec", F.col("n_frames") / float(fps))


def reveal(questions: DataFrame, words: Column, *, cumulative: bool, hold: int, gap: int = 0) -> DataFrame:
    """A row for each frame shown: question_id, seg, shown, hold. Vanishing words are each followed by a blank."""
    seq = questions.select("question_id", words.alias("words"))
    if cumulative:
        return seq.select("question_id", "words", F.posexplode("words").alias("i", "w")).select("question_id", F.col("i").alias("seg"), F.array_join(F.slice("words", F.lit(1), F.col("i") + 1), " ").alias("shown"), F.lit(hold).alias("hold"))
    frames = F.flatten(F.transform("words", lambda w: F.array(F.struct(w.alias("shown"), F.lit(hold).alias("hold")), F.struct(F.lit("").alias("shown"), F.lit(gap).alias("hold")))))
    return seq.select("question_id", F.posexplode(frames).alias("seg", "f")).select("question_id", "seg", "f.shown", "f.hold").where("hold > 0")


def referred(segments: DataFrame, content: list[str], frame: str = "frame") -> DataFrame:
    """Segments that name their frame, by a digest of what it shows, instead of holding it; equal frames of any clip have one name.

    Each part of the content counts with its length, so that parts don't run into each other; null is told from empty.
    """
    part = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return segments.withColumn(frame, F.sha2(F.concat(*map(part, content)), 256)).drop(*content)


def distinct_frames(segments: DataFrame, content: list[str], frame: str = "frame") -> DataFrame:
    """The frames that segments show, each once: its name and content, the segments that refer to it, and for how many frames they hold it.

    What a run has to draw; segments that all show one frame, as the blank one, are counted where they are before they meet.
    """
    named = referred(segments.select(*content, "hold", *[F.col(c).alias(f"_{c}") for c in content]), content, frame).withColumnsRenamed({f"_{c}": c for c in content})
    return named.groupBy(frame).agg(*[F.first(c).alias(c) for c in content], F.count("*").alias("n_segments"), F.sum("hold").cast("bigint").alias("n_held"))


def reduced(segments: DataFrame, key: str) -> DataFrame:
    """Holds by their divisor: what an encoder writes of each timeline, and what it saves."""
    per = segments.groupBy(key).agg(F.sum("hold").cast("bigint").alias("n_frames"), F.sort_array(F.collect_set(F.col("hold").cast("bigint"))).alias("holds"))
    per = per.withColumn("divisor", items.gcd_of(F.col("holds"))).withColumn("piped", F.expr("n_frames div divisor"))
    return per.select(key, "n_frames", "divisor", "piped", F.bround(1 - F.coalesce(F.try_divide("piped", "n_frames"), F.lit(1.0)), 6).alias("savings"))


def clip_timeline(plies: DataFrame, game: str, ply: str, *, n_moves: int, per_move: int, intro: int, outro: int, slides: int | None = None) -> DataFrame:
    """The segments of each game's first n_moves: an intro, a segment for each move, and the outro in the last.

    With slides, each move is so many frames of one on their way before the position that is held; place orders all of them.
    Segments hold places in the order of ply and nothing of the plies, so a game's plies are counted where they are, not sorted.
    """
    last = F.least(F.count(F.lit(1)), F.lit(n_moves)).cast("int")
    games = plies.groupBy(game).agg(last.alias("_last")).where("_last > 0")
    hold = F.when(F.col("seg") == 0, intro).otherwise(per_move + F.when(F.col("seg") == F.col("_last"), outro).otherwise(0))
    out = games.select(game, "_last", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("seg")).select(game, "seg", hold.alias("hold"))
    if slides is None:
        return out
    step = F.struct(F.lit(1).alias("hold"))
    each = F.when(F.col("seg") == 0, F.array(F.struct("hold"))).otherwise(F.concat(F.array_repeat(step, slides), F.array(F.struct("hold"))))
    return out.select(game, "seg", F.posexplode(each).alias("k", "f")).select(game, (F.col("seg") * 100 + F.col("k")).alias("place"), "f.hold") if slides < 100 else _too_many(slides)


def _too_many(slides: int) -> DataFrame:
    raise ValueError(f"{slides} frames of a move, 99 at most")


def before(plies: DataFrame, game: str, ply: str | list[str], state: str, first: str) -> DataFrame:
    """Each ply with the state that it starts from."""
    return plies.withColumn("before", F.coalesce(F.lag(state).over(Window.partitionBy(game).orderBy(ply)), F.lit(first)))
