"""Job states and client feeds as streams with state that expires by itself.

Both keep a job's state in a value that each operation writes anew, and so keeps alive for the TTL. Expired values are as
good as never written; Spark drops them when it next looks at them or compacts the store. The state store is RocksDB, which
the first call names in the session if nothing else does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from grantloom.streaming.jobs import FRAME, OUTPUT, STATE, STATUS, TTL_SECONDS, applied, frames

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State with a TTL needs this store; another choice of the session's is an error that Spark names."""
    if "HDFSBacked" in spark.conf.get(_PROVIDER, "HDFSBacked"):
        spark.conf.set(_PROVIDER, _ROCKSDB)


class LatestState(StatefulProcessor):
    """A job's status, percent and number of operations; forgotten ttl_seconds after its last operation."""

    def __init__(self, ttl_seconds: int):
        self.ttl_seconds = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", STATE, self.ttl_seconds * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = applied(self.state.get() if self.state.exists() else None, pd.concat(list(rows)))
        self.state.update(now)
        yield pd.DataFrame({"job_id": [key[0]], "status": [now[0]], "percent": [now[1]], "events": [now[2]]})

    def close(self) -> None:
        pass


def stream_states(log: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """A row for each job and trigger that touches it: job_id, status, percent, events. log: job_id, ts, seq, op, percent."""
    use_rocksdb(log.sparkSession)
    return log.groupBy("job_id").transformWithStateInPandas(LatestState(ttl_seconds), OUTPUT, "Update", "ProcessingTime")


ASK = "ask"
_FEED_STATE = "status string, percent int, error string, at long, seq long"
_FED = "job_id long, client string, place long, op string, percent int, error string"


class Feed(StatefulProcessor):
    """What the clients of a job get. The job's state and its clients change in one place, one after the other, so a client
    gets the state of one moment and then every operation behind it. An operation at or before the last one that was
    applied (by time and sequence number) has been delivered before and is passed over."""

    def __init__(self, ttl_seconds: int):
        self.ttl_seconds = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", _FEED_STATE, self.ttl_seconds * 1000)
        self.clients = handle.getMapState("clients", "client string", "place long", self.ttl_seconds * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        job = self.job.get() if self.job.exists() else None
        clients = {k[0]: v[0] for k, v in self.clients.iterator()}
        known, out = job, []
        every = pd.concat(list(rows))
        every["asks"] = every["op"] == ASK
        for r in every.sort_values(["at", "asks", "seq"]).itertuples():
            if r.asks:
                if job is None:
                    continue
                status, percent, error = job[:3]
                out.append((r.client, 0, "report", percent, None))
                ended = next((op for op, name in FRAME.items() if name == status), None)
                if ended:
                    out.append((r.client, 1, ended, percent, error))
                else:
                    clients[r.client] = 0
                continue
            if job is not None and (r.at, r.seq) <= tuple(job[3:]):
                continue
            before = job[1] if job else 0
            percent = {"create": 0, "complete": 100, "fail": before}.get(r.op, None if pd.isna(r.percent) else int(r.percent))
            error = r.error if isinstance(r.error, str) else None
            job = (STATUS.get(r.op, "running"), percent, error, int(r.at), int(r.seq))
            for client in clients:
                clients[client] += 1
                out.append((client, clients[client], r.op, None if pd.isna(r.percent) else int(r.percent), error))
            if r.op in FRAME:
                clients = {}
        if job is not known:
            self.job.update(job)
        if out:
            self.clients.clear()
            for client, place in clients.items():
                self.clients.updateValue((client,), (place,))
        found = pd.DataFrame(out, columns=["client", "place", "op", "percent", "error"])
        found.insert(0, "job_id", key[0])
        yield found.astype({"percent": "Int32", "job_id": "int64", "place": "int64"})

    def close(self) -> None:
        pass


def stream_feed(log: DataFrame, asked: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """What each client gets, as a stream: job_id, client, place, frame. log: job_id, ts, seq, op, percent, perhaps error;
    asked: job_id, client, asked_at.

    First the job's state (place 0); then its last frame if it has ended, or else every later operation up to the first
    that ends it. Within a trigger requests count by their time; one that comes in a later trigger gets the state that the
    job has by then. Requests for an unknown or expired job get nothing."""
    use_rocksdb(log.sparkSession)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    error = F.col("error") if "error" in log.columns else F.lit(None).cast("string")
    operations = log.select("job_id", F.lit(None).cast("string").alias("client"), micros("ts").alias("at"), "seq", "op", "percent", error.alias("error"))
    none = F.lit(None)
    requests = asked.select("job_id", "client", micros("asked_at").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit(ASK).alias("op"), none.cast("int").alias("percent"), none.cast("string").alias("error"))
    fed = operations.unionByName(requests).groupBy("job_id").transformWithStateInPandas(Feed(ttl_seconds), _FED, "Update", "ProcessingTime")
    return frames(fed).select("job_id", "client", "place", "frame")
