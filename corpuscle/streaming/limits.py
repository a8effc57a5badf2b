"""Request limits in which only accepted requests count.

A client's request is accepted while fewer than ``limit`` of its requests were accepted in the ``seconds`` before it;
a rejected request does not count.  The rule is sequential: whether a request counts hangs on those before it.

``accepted_stream`` decides a stream with state per client: requests wait until the watermark has passed them and are
then decided in the order of time and key, whatever order they came in, so a replay decides alike.  The state is what waits
(bounded by the watermark) and at most ``limit`` accepted times.  ``accepted`` decides a table: the time of
a client is cut where a slot begins with nothing in the ``seconds`` before it, and every such run streams through one
task in order, with at most ``limit`` times in memory.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window as W

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get this code with the plan

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decide(times: deque, us: int, limit: int, seconds: int) -> bool:
    """Whether a request at ``us`` is accepted after the accepted ``times``, which are kept up to date."""
    while times and us - times[0] >= seconds * 1_000_000:
        times.popleft()
    if len(times) >= limit:
        return False
    times.append(us)
    return True


def accepted(events: DataFrame, key: str, limit: int = 120, seconds: int = 60, slot: int = 3600) -> DataFrame:
    """(client, ts, key, accepted) for every row of a table (client, ts, key); ties in time go by key.

    Rows without a client or a time are left out; a null key comes before others.
    """
    slot = max(slot, seconds)
    e = events.where("client IS NOT NULL AND ts IS NOT NULL").select("client", "ts", key, F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"))
    span, width = slot * 1_000_000, seconds * 1_000_000
    e = e.withColumn("_slot", F.floor(F.col("_us") / span))
    last = e.groupBy("client", "_slot").agg(F.max("_us").alias("last"))
    by_client = W.partitionBy("client").orderBy("_slot")
    # A slot begins a run if the requests before it are over for all of its own.
    fresh = F.coalesce(F.col("_slot") * span - F.lag("last").over(by_client) >= width, F.lit(True))
    runs = last.withColumn("start", F.when(fresh, F.col("_slot"))).select("client", "_slot", F.last("start", True).over(by_client).alias("_run"))
    rows = e.join(runs, ["client", "_slot"]).drop("_slot").repartition("client", "_run").sortWithinPartitions("client", "_run", "_us", key)
    kind = {c: events.schema[c].dataType.simpleString() for c in ("client", "ts", key)}

    def run(batches):
        import pyarrow as pa

        now, times = None, deque()
        for b in batches:
            ok = []
            for client, start, us in zip(*(b.column(c).to_pylist() for c in ("client", "_run", "_us"))):
                if (client, start) != now:
                    now, times = (client, start), deque()
                ok.append(decide(times, us, limit, seconds))
            yield pa.RecordBatch.from_arrays([b.column("client"), b.column("ts"), b.column(key), pa.array(ok, pa.bool_())], names=["client", "ts", key, "accepted"])

    return rows.mapInArrow(run, f"client {kind['client']}, ts {kind['ts']}, `{key}` {kind[key]}, accepted boolean")


class _Limiter(StatefulProcessor):
    def __init__(self, key: str, key_type: str, limit: int, seconds: int):
        self.key, self.key_type, self.limit, self.seconds = key, key_type, limit, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"us bigint, k {self.key_type}")
        self.times = handle.getListState("times", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["_us"], r["_k"]) for r in rows]
        if new:
            self.waiting.appendList(new)
            # A timer fires once the watermark has passed it; timers of one time are one.
            for ms in {us // 1000 for us, _ in new}:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = (expiredTimerInfo.getExpiryTimeInMs() + 1) * 1000
        every = list(self.waiting.get())
        due = sorted((r[0], r[1]) for r in every if r[0] < upto)
        if not due:
            return
        later = [(r[0], r[1]) for r in every if r[0] >= upto]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        times = deque(r[0] for r in self.times.get())
        for us, k in due:
            yield Row(client=key[0], us=us, k=k, accepted=decide(times, us, self.limit, self.seconds))
        self.times.put([(us,) for us in times])

    def close(self) -> None:
        pass


def accepted_stream(events: DataFrame, key: str, limit: int = 120, seconds: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """The streaming form: (client, ts, key, accepted), given out once the watermark has passed a request.

    Requests later than the watermark are left out.  The session's state store must be the RocksDB one
    (``spark.sql.streaming.stateStore.providerClass`` = ``ROCKS_DB``) when the query starts.
    """
    kind = events.schema[key].dataType.simpleString()
    client = events.schema["client"].dataType.simpleString()
    rows = events.where(f"client IS NOT NULL AND ts IS NOT NULL AND `{key}` IS NOT NULL").withWatermark("ts", watermark)
    rows = rows.select("client", "ts", F.unix_micros("ts").alias("_us"), F.col(key).alias("_k"))
    out = rows.groupBy("client").transformWithState(_Limiter(key, kind, limit, seconds), f"client {client}, us bigint, k {kind}, accepted boolean", "Append", "EventTime")
    return out.select("client", F.timestamp_micros("us").alias("ts"), F.col("k").alias(key), "accepted")
