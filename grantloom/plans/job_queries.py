"""Queries of the job-state operators: events of the driver's stream, replayed in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.streaming import jobs

_SQL = """
    WITH op AS (SELECT user_id AS job_id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'report' END AS op, CAST(event_id % 100 AS INTEGER) AS percent FROM events),
    last AS (SELECT job_id, arg_max(CASE op WHEN 'create' THEN 'queued' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'running' END, (ts, seq)) AS status,
                    coalesce(arg_max(CASE op WHEN 'create' THEN 0 WHEN 'complete' THEN 100 ELSE percent END, (ts, seq)) FILTER (op <> 'fail'), 0) AS percent, count(*) AS events FROM op GROUP BY job_id)
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "signup", "create").when(kind == "purchase", "complete").when(kind == "error", "fail").otherwise("report")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 100).cast("int").alias("percent"))


def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_state(_log(spark, sf_dir)).select("job_id", "status", "percent", "events")


def job_result_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for every job, and for as many that there never were."""
    states = jobs.latest_state(_log(spark, sf_dir))
    requests = states.select("job_id").unionByName(states.select((-F.col("job_id") - 1).alias("job_id")))
    return jobs.result_gate(jobs.looked_up(requests, states), F.col("job_id") % 2 == 0).select("job_id", "code")


def job_status_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("error", F.when(F.col("op") == "fail", F.concat(F.lit("at "), F.col("percent").cast("string"))))
    return jobs.status_view(jobs.latest_state(log))


def job_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every client asks when half of its job's time is over."""
    log = _log(spark, sf_dir)
    at = F.timestamp_seconds(F.floor((F.unix_timestamp(F.min("ts").cast("timestamp")) + F.unix_timestamp(F.max("ts").cast("timestamp"))) / 2)).cast("timestamp_ntz")
    return jobs.feed(log, log.groupBy("job_id").agg(at.alias("asked_at"))).withColumn("place", F.col("place").cast("long"))


def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.frames(_log(spark, sf_dir)).select("job_id", "seq", "frame")


def queries():
    return {f.__name__: f for f in (job_latest_state, job_result_gate, job_status_view, job_feed, sse_frames)}


_DATA = """CASE op WHEN 'complete' THEN '{"job_id":"' || job_id || '","result_url":"/api/v1/extractions/' || job_id || '/result"}' WHEN 'fail' THEN '{"job_id":"' || job_id || '","error":""}' ELSE '{"percent":' || percent || '}' END"""
ORACLES = {
    "job_latest_state": f"{_SQL} SELECT * FROM last",
    "job_result_gate": f"{_SQL} SELECT -job_id - 1 AS job_id, CAST(404 AS INTEGER) AS code FROM last UNION ALL SELECT job_id, CAST(CASE status WHEN 'failed' THEN 422 WHEN 'completed' THEN CASE WHEN job_id % 2 = 0 THEN 200 ELSE 410 END ELSE 409 END AS INTEGER) AS code FROM last",
    "sse_frames": f"""{_SQL} SELECT job_id, seq, 'event: ' || CASE op WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'progress' END || chr(10)
        || 'data: ' || {_DATA} || chr(10) || chr(10) AS frame FROM op""",
    "job_status_view": f"""{_SQL}, failed AS (SELECT job_id, arg_max(percent, (ts, seq)) AS fail_percent FROM op WHERE op = 'fail' GROUP BY job_id)
        SELECT job_id, status, percent, CASE WHEN status = 'completed' THEN '/api/v1/extractions/' || job_id || '/result' END AS result_url, CASE WHEN status = 'failed' THEN 'at ' || fail_percent END AS error
        FROM last LEFT JOIN failed USING (job_id)""",
    "job_feed": f"""{_SQL}, asked AS (SELECT job_id, make_timestamp(CAST(floor((epoch(date_trunc('second', min(ts))) + epoch(date_trunc('second', max(ts)))) / 2) AS BIGINT) * 1000000) AS asked_at FROM op GROUP BY job_id),
        every AS (SELECT *, {_DATA} AS data, CASE op WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'progress' END AS event FROM op JOIN asked USING (job_id)),
        now AS (SELECT job_id, arg_max(op, (ts, seq)) AS last_op, arg_max(data, (ts, seq)) AS last_data, arg_max(event, (ts, seq)) AS last_event, coalesce(arg_max(CASE op WHEN 'create' THEN 0 WHEN 'complete' THEN 100 ELSE percent END, (ts, seq)) FILTER (op <> 'fail'), 0) AS p FROM every WHERE ts <= asked_at GROUP BY job_id),
        tail AS (SELECT *, row_number() OVER w AS place, coalesce(max(CASE WHEN op IN ('complete', 'fail') THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over
                 FROM every SEMI JOIN (SELECT job_id FROM now WHERE last_op NOT IN ('complete', 'fail')) n USING (job_id) WHERE ts > asked_at WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq)),
        f AS (SELECT job_id, 0 AS place, 'progress' AS event, '{{"percent":' || p || '}}' AS data FROM now
              UNION ALL SELECT job_id, 1, last_event, last_data FROM now WHERE last_op IN ('complete', 'fail')
              UNION ALL SELECT job_id, place, event, data FROM tail WHERE over = 0)
        SELECT job_id, CAST(place AS BIGINT) AS place, 'event: ' || event || chr(10) || 'data: ' || data || chr(10) || chr(10) AS frame FROM f""",
}
