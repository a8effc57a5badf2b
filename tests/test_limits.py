"""Accept-only request limits: table and stream against a plain loop."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpuscle.streaming import limits as L

START = datetime(2024, 5, 1, 10)
EVENTS = "client string, ts timestamp, k long"


def plain(rows, limit, seconds):
    out, kept = {}, defaultdict(deque)
    for c, ts, k in sorted(rows):
        kept[c] = deque(t for t in kept[c] if (ts - t).total_seconds() < seconds)
        out[(c, k)] = ok = len(kept[c]) < limit
        if ok:
            kept[c].append(ts)
    return out


def requests(rng, n=600):
    rows = [("hot", START + timedelta(seconds=rng.randrange(900) + rng.randrange(3) / 4), i) for i in range(n)]
    rows += [(f"c{rng.randrange(4)}", START + timedelta(seconds=rng.randrange(20_000)), n + i) for i in range(200)]
    rows += [("edge", START + timedelta(seconds=60 * i), 2 * n + i) for i in range(5)]  # exactly the window apart
    return rows + [("edge", START, 3 * n + i) for i in range(6)]  # at one time


def test_a_table_is_decided_like_a_plain_loop(spark):
    rows = requests(random.Random(1))
    want = plain(rows, 3, 60)
    df = spark.createDataFrame(rows, EVENTS).repartition(5)
    for slot in (60, 300, 3600):
        got = {(r.client, r.k): r.accepted for r in L.accepted(df, "k", 3, 60, slot).collect()}
        assert got == want and not all(want.values())
    assert L.accepted(df.limit(0), "k").count() == 0
    assert L.accepted(spark.createDataFrame([(None, START, 1), ("a", None, 2)], EVENTS), "k").count() == 0


def test_a_run_ends_where_nothing_is_left_to_count(spark):
    rows = [("a", START + timedelta(seconds=7200 * i + j), 10 * i + j) for i in range(5) for j in range(4)]
    df = spark.createDataFrame(rows, EVENTS)
    plan = L.accepted(df, "k", 2, 60)
    assert {(r.client, r.k): r.accepted for r in plan.collect()} == plain(rows, 2, 60)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(client" in text and "_run" in text


def test_the_stream_equals_the_loop_and_a_replay(spark, tmp_path):
    rng = random.Random(2)
    rows = requests(rng, 150)
    rows.sort(key=lambda r: r[1])
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for p in parts:
        rng.shuffle(p)  # out of order inside the watermark
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKS_DB)
    try:
        def go():
            stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
            q = L.accepted_stream(stream, "k", 3, 60, "6 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
            q.outputMode("append").trigger(availableNow=True).start().awaitTermination()

        half = len(parts) // 2
        for some in (parts[:half], parts[half:], [[("end", START + timedelta(days=9), 10**6)]]):
            for p in some:
                spark.createDataFrame(p, EVENTS).coalesce(1).write.mode("append").parquet(source)
            go()  # each start goes on from the checkpoint
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(out).where(F.col("client") != "end").collect()
    assert {(r.client, r.k): r.accepted for r in got} == plain(rows, 3, 60) and len(got) == len(rows)
