"""Incremental forms: keyed ingest, request rates, running counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from corpuscle.operators.keyed import last_per_key


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Start a keyed ingest of a stream into ``path``.

    Every micro-batch writes its last row per key into its own folder; a replayed batch overwrites the
    same folder, so the result is exact after a failure.  ``current`` reads the last row per key.
    """
    def put(batch: DataFrame, batch_id: int) -> None:
        last_per_key(batch, key, order).withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return last_per_key(rows, key, [order, "_batch"]).drop("_batch")


def request_rates(events: DataFrame, limit: int = 120, watermark: str = "10 minutes") -> DataFrame:
    """Streaming: arrivals per client in sliding minutes, with the windows above the limit marked."""
    counted = events.withWatermark("ts", watermark).groupBy(F.window("ts", "60 seconds", "10 seconds"), "client").agg(F.count("*").alias("n"))
    return counted.select("client", F.col("window.start").alias("start"), "n", (F.col("n") > limit).alias("above"))


def arrivals(events: DataFrame, key: str, seconds: int = 60, slot: int = 600) -> DataFrame:
    """Batch: for every event, the arrivals of its client in the ``seconds`` up to it.

    ``events`` is (client, ts, key).  Time is cut into slots and the end of a slot is repeated as context
    for the next one, so a client with a third of all events is still counted slot by slot.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span, width = slot * 1_000_000, seconds * 1_000_000
    e = events.withColumns({"_us": us, "_slot": F.floor(us / span)})
    spill = F.when(F.floor((F.col("_us") + width) / span) > F.col("_slot"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = e.withColumn("_ahead", F.explode(spill)).withColumn("_slot", F.col("_slot") + F.col("_ahead"))
    w = W.partitionBy("client", "_slot").orderBy("_us").rangeBetween(-width, 0)
    return rows.withColumn("n", F.count("*").over(w)).where("_ahead = 0").select("client", "ts", key, "n")


def counters(events: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Requests, errors and mean latency per tumbling window; works on streams and on tables."""
    source = events.withWatermark("ts", watermark) if events.isStreaming else events
    g = source.groupBy(F.window("ts", window)).agg(
        F.count("*").alias("requests"), F.count_if(F.col("outcome") == "error").alias("errors"), F.avg("latency").alias("mean_latency")
    )
    return g.select(F.col("window.start").alias("start"), "requests", "errors", F.round("mean_latency", 4).alias("mean_latency"))
