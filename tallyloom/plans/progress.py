"""How far the jobs of a run are, and how long the rest may take: from the states of tasks that the driver has anyway."""

from __future__ import annotations

import contextlib
import sys
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

#: Seconds between lines where the stream is no terminal, and between looks at the tasks.
LINE_EVERY, LOOK_EVERY = 10.0, 0.5


def tasks_of(spark: SparkSession, group: str) -> Callable[[], tuple[int, int]]:
    """A function that gives the tasks of a group of jobs that are done, and all that are known of.

    Stages whose states are no longer kept count as they were last seen; stages that were skipped, as done already, count for nothing.
    """
    tracker, seen = spark.sparkContext.statusTracker(), {}

    def look() -> tuple[int, int]:
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = tracker.getStageInfo(stage)
                if s:
                    seen[stage] = (s.numCompletedTasks, s.numTasks, info.status == "RUNNING")
        live = [(done, total) for done, total, running in seen.values() if done or running]
        return sum(d for d, _ in live), sum(t for _, t in live)

    return look


class Progress:
    """Lines about what is done: one that is written over on a terminal, else one each LINE_EVERY seconds."""

    def __init__(self, look: Callable[[], tuple[int, int]], label: str, *, unit: str = "task", stream=None, clock: Callable[[], float] = time.monotonic):
        self.look, self.label, self.unit, self.clock = look, label, unit, clock
        self.stream = sys.stderr if stream is None else stream
        self.began = self.said = clock()
        try:
            self.live = bool(self.stream.isatty())
        except Exception:  # whatever the stream is, it's no terminal
            self.live = False
        self.width = 0

    def line(self) -> str:
        done, total = self.look()
        took = self.clock() - self.began
        if not total:
            return f"{self.label}: {done} {self.unit}s, {took:.0f} s so far"
        left = f", about {took * (total - done) / done:.0f} s left" if done else ""
        return f"{self.label}: {done} of {total} {self.unit}s ({done / total:.0%}), {took:.0f} s so far{left}"

    def tick(self) -> None:
        """Say where the run is, if it is time."""
        if self.live:
            text = self.line()
            self.stream.write("\r" + text.ljust(self.width))
            self.width = len(text)
        elif self.clock() - self.said >= LINE_EVERY:
            self.said = self.clock()
            self.stream.write(self.line() + "\n")
        self.stream.flush()

    def end(self) -> None:
        if self.live and self.width:
            self.stream.write("\r" + " " * self.width + "\r")
            self.stream.flush()


@contextlib.contextmanager
def shown(spark: SparkSession, label: str, *, quiet: bool = False, stream=None) -> Iterator[None]:
    """Shows the progress of the jobs that this thread starts inside. A stream that breaks ends the lines, not the run."""
    if quiet:
        yield
        return
    context, group, over = spark.sparkContext, f"tallyloom-{uuid.uuid4().hex}", threading.Event()
    was = context.getLocalProperty("spark.jobGroup.id"), context.getLocalProperty("spark.job.description")
    context.setJobGroup(group, label)
    progress = Progress(tasks_of(spark, group), label, stream=stream)

    def watch() -> None:
        with contextlib.suppress(Exception):
            while not over.wait(LOOK_EVERY):
                progress.tick()

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        with contextlib.suppress(Exception):
            progress.end()
        context.setLocalProperty("spark.jobGroup.id", was[0])
        context.setLocalProperty("spark.job.description", was[1])
