"""Job states and progress events: the same rules as a batch replay and as a stream with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What an operation makes of a job, and the days a state lives without one (in seconds).
STATUS = {"create": "queued", "report": "running", "complete": "completed", "fail": "failed"}
TTL_SECONDS = 86_400
FRAME = {"complete": "completed", "fail": "failed"}
STATE = "status string, percent int, events long"
OUTPUT = "job_id long, status string, percent int, events long"


def _chosen(values: dict[str, object], column: str, otherwise: Column) -> Column:
    result = None
    for k, v in values.items():
        result = (F if result is None else result).when(F.col(column) == k, F.lit(v))
    return result.otherwise(otherwise)


def latest_state(log: DataFrame) -> DataFrame:
    """One row per job from its log (job_id, ts, seq, op, percent): the last operation's status; a failure keeps the percent."""
    order = F.struct("ts", "seq")
    percent = F.when(F.col("op") == "create", 0).when(F.col("op") == "complete", 100).otherwise(F.col("percent"))
    moved = F.when(F.col("op") != "fail", F.struct(order.alias("o"), percent.alias("p")))
    status = _chosen(STATUS, "op", F.lit("running"))
    error = [F.max_by(F.when(F.col("op") == "fail", F.col("error")), order).alias("error")] if "error" in log.columns else []
    return log.groupBy("job_id").agg(F.max_by(status, order).alias("status"), F.coalesce(F.max(moved)["p"], F.lit(0)).alias("percent"), F.count("*").alias("events"), F.max("ts").alias("updated_at"), *error)


def result_url(job_id: Column) -> Column:
    return F.concat(F.lit("/api/v1/extractions/"), job_id.cast("string"), F.lit("/result"))


def looked_up(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Requests (job_id) with their job's state; all null for a job that is unknown or expired."""
    return requests.join(states, "job_id", "left")


def status_view(states: DataFrame) -> DataFrame:
    """What a client sees of a job: the result's address only once it is completed, an error only if there is one."""
    error = F.nullif(F.col("error"), F.lit("")) if "error" in states.columns else F.lit(None).cast("string")
    return states.select("job_id", "status", "percent", F.when(F.col("status") == "completed", result_url(F.col("job_id"))).alias("result_url"), error.alias("error"))


def result_gate(found: DataFrame, has_result: Column) -> DataFrame:
    """The HTTP code of a result request, from looked_up(): 404 unknown, 422 failed, 409 not ready, 410 expired, else 200."""
    status = F.col("status")
    code = F.when(status.isNull(), 404).when(status == "failed", 422).when(status != "completed", 409).when(~has_result, 410).otherwise(200)
    return found.withColumn("code", code)


def frames(log: DataFrame) -> DataFrame:
    """Adds frame: the server-sent event of each operation. Progress has the percent, a completed job its result's address,
    and a failed one its error."""
    event = _chosen(FRAME, "op", F.lit("progress"))
    job, op = F.col("job_id").cast("string"), F.col("op")
    ends = op.isin(*FRAME)
    error = F.coalesce(F.col("error"), F.lit("")) if "error" in log.columns else F.lit("")
    # to_json() leaves out what is null.
    data = F.to_json(F.struct(F.when(ends, job).alias("job_id"), F.when(op == "complete", result_url(job)).alias("result_url"), F.when(op == "fail", error).alias("error"), F.when(~ends, F.col("percent")).alias("percent")))
    return log.withColumn("frame", F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n")))


def feed(log: DataFrame, since: DataFrame) -> DataFrame:
    """What a client that asks at some time gets: job_id, place, frame. since: job_id and asked_at.

    First the state then (place 0), as a progress frame; a job that has ended has its last frame next, and others go on with
    every later operation up to the first that ends them. Jobs without any operation by then are unknown and get nothing.
    Batch form; as a stream it is the states' table and the tail of the log behind it."""
    asked = log.join(since, "job_id")
    seen, later = asked.filter(F.col("ts") <= F.col("asked_at")), asked.filter(F.col("ts") > F.col("asked_at"))
    now = latest_state(seen)
    snapshot = frames(now.select("job_id", F.lit("report").alias("op"), "percent")).select("job_id", F.lit(0).alias("place"), "frame")
    ended = now.filter(F.col("status").isin(*FRAME.values())).select("job_id", F.when(F.col("status") == "completed", "complete").otherwise("fail").alias("op"), "percent", *(["error"] if "error" in log.columns else []))
    last = frames(ended).select("job_id", F.lit(1).alias("place"), "frame")
    by = W.partitionBy("job_id").orderBy("ts", "seq")
    over = F.coalesce(F.max(F.col("op").isin(*FRAME).cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    going = later.join(now.filter(~F.col("status").isin(*FRAME.values())).select("job_id"), "job_id", "left_semi")
    tail = going.withColumns({"over": over, "place": F.row_number().over(by)}).filter(F.col("over") == 0)
    return snapshot.unionByName(last).unionByName(frames(tail).select("job_id", "place", "frame"))


def work_off(queue: DataFrame, work: Callable[[DataFrame], DataFrame], results: str, checkpoint: str) -> DataStreamWriter:
    """A worker: each trigger's jobs go through work(), and what it gives is written to the trigger's own folder of results.
    A trigger that is repeated writes the same folder again, so no job's result comes twice."""

    def each(jobs: DataFrame, trigger: int) -> None:
        work(jobs).write.mode("overwrite").parquet(f"{results}/trigger={trigger}")

    return queue.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def applied(state: tuple[str, int, int] | None, rows: pd.DataFrame) -> tuple[str, int, int]:
    """The state after a trigger's operations, in the order of time and sequence number; a failure keeps the percent."""
    _, percent, events = state or ("queued", 0, 0)
    rows = rows.sort_values(["ts", "seq"])
    moved = rows[rows["op"] != "fail"]
    if len(moved):
        op = moved["op"].iloc[-1]
        percent = {"create": 0, "complete": 100}.get(op, int(moved["percent"].iloc[-1]))
    return STATUS.get(rows["op"].iloc[-1], "running"), percent, events + len(rows)


def kept_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, ttl_seconds: int) -> Iterator[pd.DataFrame]:
    """A job's state moves on with its operations; without any for the TTL it is forgotten."""
    if state.hasTimedOut:
        state.remove()
        return
    now = applied(state.get if state.exists else None, pd.concat(list(batches)))
    state.update(now)
    state.setTimeoutDuration(ttl_seconds * 1000)
    yield pd.DataFrame({"job_id": [key[0]], "status": [now[0]], "percent": [now[1]], "events": [now[2]]})


def stream_states(log: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """The stream's states, a row for each job and trigger that touches it; a job without events for the TTL is forgotten."""

    def apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from kept_state(key, batches, state, ttl_seconds)

    return log.groupBy("job_id").applyInPandasWithState(apply, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
