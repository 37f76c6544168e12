"""A worker for queued jobs: one try for each job, so many jobs at a time, and a limit on each one's time.

Before a trigger's jobs begin they are written to a ledger of tries. A job that the ledger has from another trigger isn't
tried again, and neither is one whose trigger is repeated after a crash: by then nobody knows how far its work had gone. Such a job
has failed, unless its result had been written.

In the worker's folder are ledger/trigger=N (job_id), results/job_id=J (what work made of it) and outcomes/trigger=N (job_id,
status, error); a table counts once its write has ended.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from grantloom.sources import files

#: Jobs at a time, seconds that one may take, and what a client may know of an error that isn't its own.
AT_A_TIME, LIMIT_SECONDS = 2, 1800
INTERNAL = "Internal extraction error"
ONE_TRY = "The job was interrupted and isn't tried again"
OUTCOME = "job_id long, status string, error string"
_TRIED = "job_id long, trigger long"


class Worker:
    """A function for foreachBatch. work: makes a job's result from its rows of the queue. A ValueError's text is for the client; other errors are
    internal. after: is called with the job when it has ended, whatever came of it; its errors don't count."""

    def __init__(self, work: Callable[[DataFrame], DataFrame], folder: str, at_a_time: int = AT_A_TIME, limit_seconds: float = LIMIT_SECONDS, after: Callable[[int], None] | None = None):
        self.work, self.folder, self.at_a_time, self.limit_seconds, self.after = work, folder, at_a_time, limit_seconds, after

    def __call__(self, queued: DataFrame, trigger: int) -> None:
        spark, ledger, outcomes = queued.sparkSession, f"{self.folder}/ledger/trigger={trigger}", f"{self.folder}/outcomes/trigger={trigger}"
        if files.committed(spark, outcomes):
            return
        began = files.committed(spark, ledger)
        if not began:
            tried = files.read(spark, f"{self.folder}/ledger", _TRIED).filter(F.col("trigger") != trigger).select("job_id")
            queued.select("job_id").distinct().join(tried, "job_id", "left_anti").write.mode("overwrite").parquet(ledger)
        jobs = (r["job_id"] for r in spark.read.schema("job_id long").parquet(ledger).toLocalIterator())
        if began:
            found = [self._interrupted(queued, job) for job in jobs]
        else:
            with ThreadPoolExecutor(self.at_a_time) as pool:
                found = list(pool.map(lambda job: self._tried(queued, job, trigger), jobs))
        spark.createDataFrame(found, OUTCOME).coalesce(1).write.mode("overwrite").parquet(outcomes)

    def _result(self, job: int) -> str:
        return f"{self.folder}/results/job_id={job}"

    def _interrupted(self, queued: DataFrame, job: int) -> tuple[int, str, str | None]:
        whole = files.committed(queued.sparkSession, self._result(job))
        self._ended(job)
        return (job, "completed", None) if whole else (job, "failed", ONE_TRY)

    def _tried(self, queued: DataFrame, job: int, trigger: int) -> tuple[int, str, str | None]:
        context, group, late = queued.sparkSession.sparkContext, f"{self.folder} {trigger} {job}", threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobGroup(group)

        clock = threading.Timer(self.limit_seconds, stop)
        clock.daemon = True
        clock.start()
        try:
            context.setJobGroup(group, f"job {job}", interruptOnCancel=True)
            self.work(queued.filter(F.col("job_id") == job)).drop("job_id").write.mode("overwrite").parquet(self._result(job))
            return job, "completed", None
        except ValueError as error:
            return job, "failed", str(error)
        except Exception:
            return job, "failed", f"The job took more than {self.limit_seconds:g} seconds" if late.is_set() else INTERNAL
        finally:
            clock.cancel()
            self._ended(job)

    def _ended(self, job: int) -> None:
        if self.after:
            with suppress(Exception):
                self.after(job)


def work_off(queue: DataFrame, worker: Worker, checkpoint: str) -> DataStreamWriter:
    """queue: a stream with job_id and whatever else a job needs; how many jobs a trigger gets is the source's to limit."""
    return queue.writeStream.foreachBatch(worker).option("checkpointLocation", checkpoint)

