"""Streams against their batch forms, expiry of state, restarts, and a worker that is killed between ledger and result."""

import datetime
import threading
import time

import pytest
from conftest import SF
from pyspark.sql import functions as F

from grantloom.operators import sections
from grantloom.plans import fixtures, job_queries, pipeline, progress
from grantloom.streaming import keyed, worker

LOG = "job_id long, ts timestamp, seq long, op string, percent int"
AT = datetime.datetime(2025, 1, 1)


@pytest.fixture(autouse=True)
def no_empty_triggers(spark):
    """States that expire ask for triggers without end; the given files are all that there is to run here."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def run(frame, folder, name):
    """One start of a query, up to the end of its input; what it adds goes to a table of files."""
    writer = frame.writeStream.outputMode("update").option("checkpointLocation", str(folder / f"{name}-checkpoint"))

    def each(rows, trigger):
        rows.write.mode("overwrite").parquet(str(folder / name / f"trigger={trigger}"))

    query = writer.foreachBatch(each).trigger(availableNow=True).start()
    finished = query.awaitTermination(120)
    query.stop()
    assert finished and query.exception() is None


def test_stream_with_ttl_equals_replay(spark, tmp_path):
    log = job_queries._log(spark, SF)
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    run(keyed.stream_states(stream), tmp_path, "states")
    columns = ["job_id", "status", "percent", "events"]
    got = spark.read.parquet(str(tmp_path / "states")).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, job_queries.job_latest_state(spark, SF).select(*columns).collect()))


def test_state_expires_and_outlives_a_restart(spark, tmp_path):
    def step(n, rows, ttl):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        run(keyed.stream_states(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")), ttl), tmp_path, "states")
        found = spark.read.parquet(str(tmp_path / "states"))
        return sorted(tuple(r)[:4] for r in found.filter(F.col("trigger") == n).select("job_id", "status", "percent", "events").collect())

    assert step(0, [(1, AT, 1, "report", 40), (2, AT, 1, "create", 0)], 8) == [(1, "running", 40, 1), (2, "queued", 0, 1)]
    # Each step starts the query anew from its checkpoint.
    assert step(1, [(1, AT, 2, "fail", 0)], 8) == [(1, "failed", 40, 2)]
    time.sleep(9)
    assert step(2, [(1, AT, 3, "fail", 0), (2, AT, 2, "report", 5)], 8) == [(1, "failed", 0, 1), (2, "running", 5, 1)]


def written_in_order(frame, at, folder, slices):
    """A file for each slice of time, older files first."""
    for k, (low, high) in enumerate(slices):
        frame.filter((F.unix_micros(F.col(at).cast("timestamp")) > low) & (F.unix_micros(F.col(at).cast("timestamp")) <= high)).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.01 * k)


@pytest.mark.parametrize("files", [1, 4])
def test_feed_stream_equals_batch(spark, tmp_path, files):
    log = job_queries._log(spark, SF)
    at = F.timestamp_seconds(F.floor((F.unix_timestamp(F.min("ts").cast("timestamp")) + F.unix_timestamp(F.max("ts").cast("timestamp"))) / 2)).cast("timestamp_ntz")
    asked = log.groupBy("job_id").agg(at.alias("asked_at")).withColumn("client", F.lit("c"))
    first, last = log.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    edges = [first - 1 + (last - first + 1) * k // files for k in range(files)] + [last]
    slices = list(zip(edges[:-1], edges[1:], strict=True))
    written_in_order(log, "ts", tmp_path / "log", slices)
    written_in_order(asked, "asked_at", tmp_path / "asked", slices)
    log_stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    asked_stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "asked"))
    run(keyed.stream_feed(log_stream, asked_stream), tmp_path, "fed")
    got = spark.read.parquet(str(tmp_path / "fed")).select("job_id", "place", "frame").collect()
    want = job_queries.job_feed(spark, SF).select("job_id", "place", "frame").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_feed_loses_and_doubles_nothing(spark, tmp_path):
    """Operations that come again after a restart, several clients, a client after the end, and one of an unknown job."""
    sec = lambda k: AT + datetime.timedelta(seconds=k)
    ask = "job_id long, client string, asked_at timestamp"

    def step(log, asked):
        spark.createDataFrame(log, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        spark.createDataFrame(asked, ask).coalesce(1).write.mode("append").parquet(str(tmp_path / "asked"))
        run(keyed.stream_feed(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")), spark.readStream.schema(ask).parquet(str(tmp_path / "asked"))), tmp_path, "fed")

    step([(1, sec(0), 1, "create", 0), (1, sec(2), 2, "report", 10)], [(1, "a", sec(1)), (9, "x", sec(1))])
    step([(1, sec(2), 2, "report", 10), (1, sec(3), 3, "report", 40)], [(1, "b", sec(3))])
    step([(1, sec(4), 4, "complete", 0), (1, sec(5), 5, "report", 7)], [(1, "c", sec(4))])
    got = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "fed")).collect(), key=lambda r: (r["client"], r["place"])):
        got.setdefault(r["client"], []).append((r["place"], r["frame"].split("data: ")[1].strip()))
    end = '{"job_id":"1","result_url":"/api/v1/extractions/1/result"}'
    assert got == {
        "a": [(0, '{"percent":0}'), (1, '{"percent":10}'), (2, '{"percent":40}'), (3, end)],
        "b": [(0, '{"percent":40}'), (1, end)],
        "c": [(0, '{"percent":100}'), (1, end)],
    }


# ---------------------------------------------------------------- worker


def started(spark, folder, worker_):
    queue = spark.readStream.schema("job_id long, n long").option("maxFilesPerTrigger", 1).parquet(str(folder / "queue"))
    return worker.work_off(queue, worker_, str(folder / "checkpoint")).trigger(availableNow=True).start()


def outcomes(spark, folder):
    return {r["job_id"]: (r["status"], r["error"]) for r in spark.read.parquet(str(folder / "out" / "outcomes")).collect()}


def queue_of(spark, folder, ids):
    spark.createDataFrame([(k, k) for k in ids], "job_id long, n long").coalesce(1).write.mode("append").parquet(str(folder / "queue"))


def test_worker_tries_each_job_once(spark, tmp_path):
    tries, ended = [], []

    def work(rows):
        job = rows.first()["job_id"]
        tries.append(job)
        if job == 2:
            raise ValueError("no section 3")
        if job == 3:
            raise RuntimeError("a secret")
        return rows.withColumn("result", F.col("n") * 2)

    for ids in ([1, 2, 2, 3], [1, 3, 4]):
        queue_of(spark, tmp_path, ids)
        assert started(spark, tmp_path, worker.Worker(work, str(tmp_path / "out"), after=lambda job: ended.append(job) or 1 / 0)).awaitTermination(120)
    assert sorted(tries) == sorted(ended) == [1, 2, 3, 4]
    assert outcomes(spark, tmp_path) == {1: ("completed", None), 2: ("failed", "no section 3"), 3: ("failed", worker.INTERNAL), 4: ("completed", None)}
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / "results")).select("job_id", "result").collect())) == [(1, 2), (4, 8)]


class Killed(Exception):
    """Ends a trigger as a lost driver would: nothing after it runs."""


def test_worker_killed_between_ledger_and_result(spark, tmp_path, monkeypatch):
    tries = []

    def work(rows):
        tries.append(rows.first()["job_id"])
        return rows

    def dies(self, queued, job, trigger):
        if job == 6:
            raise Killed
        return tried(self, queued, job, trigger)

    tried = worker.Worker._tried
    queue_of(spark, tmp_path, [5, 6])
    monkeypatch.setattr(worker.Worker, "_tried", dies)
    query = started(spark, tmp_path, worker.Worker(work, str(tmp_path / "out"), at_a_time=1))
    with pytest.raises(Exception):  # noqa: B017
        query.awaitTermination(120)
    assert not (tmp_path / "out" / "outcomes").exists()
    monkeypatch.setattr(worker.Worker, "_tried", tried)
    queue_of(spark, tmp_path, [6, 7])
    assert started(spark, tmp_path, worker.Worker(work, str(tmp_path / "out"), at_a_time=1)).awaitTermination(120)
    found, finished = outcomes(spark, tmp_path), (tmp_path / "out" / "results" / "job_id=5" / "_SUCCESS").exists()
    assert found[6] == ("failed", worker.ONE_TRY) and found[7] == ("completed", None)
    assert found[5] == (("completed", None) if finished else ("failed", worker.ONE_TRY)) and sorted(set(tries)) == sorted(tries) and 6 not in tries


def test_worker_runs_two_at_a_time_within_a_limit(spark, tmp_path):
    lock, now, most = threading.Lock(), [0], [0]

    def work(rows):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        try:
            if rows.first()["job_id"] == 1:
                slow = F.udf(lambda n: time.sleep(60) or n, "long")
                rows = rows.withColumn("n", slow("n"))
                rows.count(), rows.agg(F.max("n")).collect()
            time.sleep(0.5)
            return rows
        finally:
            with lock:
                now[0] -= 1

    queue_of(spark, tmp_path, [1, 2, 3, 4, 5])
    began = time.monotonic()
    assert started(spark, tmp_path, worker.Worker(work, str(tmp_path / "out"), limit_seconds=6)).awaitTermination(120)
    assert time.monotonic() - began < 55 and most[0] == 2
    assert outcomes(spark, tmp_path) == {1: ("failed", "The job took more than 6 seconds")} | {k: ("completed", None) for k in range(2, 6)}


# ---------------------------------------------------------------- progress


def test_progress_rises_while_tasks_run(spark, tmp_path):
    def extract(found):
        slow = F.udf(lambda x: time.sleep(0.25) or x, "string")
        many = spark.range(0, 24, 1, 12).select(slow(F.col("id").cast("string")).alias("id"))
        none = sections.tasks(found)
        return none.unionByName(many.filter("id = 'x'").select(*[F.lit(None).cast(none.schema[c].dataType).alias(c) if c != "id" else F.col("id") for c in none.columns]))

    pages = spark.createDataFrame([("p", 0, "nothing")], "proposal string, page_idx int, text string")
    raw = spark.createDataFrame([("p", 0, 0, fixtures.WP_ONE)], "proposal string, page_idx int, table_idx int, rows array<array<string>>")
    told = []

    def report(stage, percent):
        told.append((stage, percent))
        raise RuntimeError

    result = progress.run_reported(pages, raw, "CD", str(tmp_path / "run"), report, extract=extract, whole_document=True, every=0.05)
    percents = [p for _, p in told]
    assert [s for k, (s, _) in enumerate(told) if not k or told[k - 1][0] != s] == ["tables", "tasks", "assembly", "done"]
    assert percents == sorted(percents) and percents[0] == 10 and percents[-2:] == [90, 100]
    within = [p for s, p in told if s == "tasks"]
    assert within[0] == 40 and within[-1] == 85 and sum(40 < p < 85 for p in within) >= 3
    assert sorted(map(str, result.collect())) == sorted(map(str, pipeline.run(pages, raw, "CD", whole_document=True).collect()))
