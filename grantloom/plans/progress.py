"""The stages of the plan run one after the other, with their progress while Spark works on them.

Each stage's result is written to a folder and read again, so that what is reported has been done. Within the tasks' stage the
percent follows Spark's own count of tasks that have ended, stage by stage, which a thread on the driver asks for. What the report
raises stops nothing, and percents never fall.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

from grantloom.operators import sections
from grantloom.plans import pipeline

#: Percent when a stage begins, and when all is done; within the tasks' stage it rises to TASKS_DONE.
PERCENT = {"tables": 10, "tasks": 40, "assembly": 90, "done": 100}
TASKS_DONE = 85
#: Seconds between two looks at running work.
EVERY = 0.2


class Progress:
    """report gets a stage's name and a percent, each time that either changes."""

    def __init__(self, spark: SparkSession, report: Callable[[str, int], None], every: float = EVERY):
        self.context, self.report, self.every = spark.sparkContext, report, every
        self.last: tuple[str, int] = ("", 0)
        self.lock = threading.Lock()

    def told(self, stage: str, percent: int) -> None:
        with self.lock:
            now = (stage, max(percent, self.last[1]))
            if now != self.last:
                self.last = now
                with suppress(Exception):
                    self.report(*now)

    @contextmanager
    def running(self, stage: str, until: int | None = None) -> Iterator[None]:
        """Spark's jobs within it count for the stage; until: the percent that it rises to as their tasks end."""
        self.told(stage, PERCENT[stage])
        if until is None:
            yield
            return
        group, over = f"{stage} {uuid.uuid4().hex}", threading.Event()
        self.context.setJobGroup(group, stage)

        def watch() -> None:
            while not over.wait(self.every):
                with suppress(Exception):
                    self.told(stage, PERCENT[stage] + int((until - PERCENT[stage]) * self.share(group)))

        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            yield
        finally:
            over.set()
            watcher.join()
            for key in ("spark.jobGroup.id", "spark.job.description"):
                self.context.setLocalProperty(key, None)
        self.told(stage, until)

    def share(self, group: str) -> float:
        """How far a group's jobs are. Spark plans stages as it goes, so how many will come isn't known: each stage takes the
        part of its tasks that have ended from one half of what the ones before it have left."""
        status, left = self.context.statusTracker(), 1.0
        jobs = [x for x in map(status.getJobInfo, status.getJobIdsForGroup(group)) if x]
        for k in sorted({k for job in jobs for k in job.stageIds}):
            stage = status.getStageInfo(k)
            if stage and stage.numTasks:
                left *= 1 - 0.5 * stage.numCompletedTasks / stage.numTasks
        return 1 - left


def run_reported(pages: DataFrame, raw_tables: DataFrame, company: str, folder: str, report: Callable[[str, int], None], extract: pipeline.TaskExtractor = sections.tasks, label_of=None, assemble: pipeline.Assembler = pipeline.stage3, whole_document: bool = False, votes: DataFrame | None = None, every: float = EVERY) -> DataFrame:
    """What pipeline.run() gives, made stage by stage in a folder of its own, with reports of (stage, percent)."""
    spark, progress = pages.sparkSession, Progress(pages.sparkSession, report, every)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    with progress.running("tables"):
        counted = raw_tables if whole_document else pipeline.of_section3(pages, raw_tables, votes)[0]
        made = pipeline.stage1(counted, company, label_of, keep=lambda df: written(df, "labelled"))
        first = pipeline.Stage1(*(written(getattr(made, x), x) for x in ("wp_info", "effort", "deliverables", "warnings")))
    with progress.running("tasks", TASKS_DONE):
        tasks = written(pipeline.stage2(pages, extract), "tasks")
    with progress.running("assembly"):
        result = written(assemble(first, tasks, company), "work_packages")
    progress.told("done", PERCENT["done"])
    return result
