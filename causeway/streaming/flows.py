"""Streams: deduplication, windows, online clusters, sinks. The same functions run with ``availableNow`` in tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from causeway.operators import dedup
from causeway.session import ship

EVENTS = "message_id string, event_id bigint, ts timestamp, asset_id string, factor string, tag string, polarity string, value double"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)


def once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """At-least-once deliveries to one row for each message."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["message_id"])


def windowed(events: DataFrame, minutes: int = 15, grace: str = "5 minutes") -> DataFrame:
    """Contexts by asset, window and factor, emitted once the window and its grace are over."""
    w = F.window("ts", f"{minutes} minutes")
    g = events.withWatermark("ts", grace).groupBy(w, "asset_id", "factor").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.min(F.when(F.col("polarity") == "RESOLUTION", 1).otherwise(0)).alias("resolved"), F.count(F.lit(1)).alias("n_events"))
    return g.select("asset_id", F.col("window.start").alias("window_start"), "factor", "tags", (F.col("resolved") == 1).alias("resolved"), "n_events")


def judged(scores: DataFrame, notices: DataFrame, within: str = "9 days", delay: str = "1 hour") -> DataFrame:
    """scores: a stream of key, scored_at, r; notices: a stream of key, superseded_at, delivered at least once. Each score once, ``skipped`` if its decision was superseded by then.

    Whichever comes first waits in state for the other, up to ``within``; a score without a notice comes out when the watermark has passed all that could still concern it.
    """
    s = scores.withWatermark("scored_at", delay).alias("s")
    n = notices.withWatermark("superseded_at", delay).alias("n")
    near = (F.col("n.superseded_at") <= F.col("s.scored_at")) & (F.col("n.superseded_at") >= F.col("s.scored_at") - F.expr(f"interval {within}"))
    met = s.join(n, (F.col("s.key") == F.col("n.key")) & near, "leftOuter")
    told = met.select(F.col("s.key").alias("key"), F.col("s.scored_at").alias("scored_at"), F.col("s.r").alias("r"), F.col("n.key").isNotNull().alias("skipped"))
    return told.dropDuplicatesWithinWatermark(["key"])


CLUSTER = "cluster_id string, asset_id string, n bigint, first_ts timestamp, last_ts timestamp"


def clusters(events: DataFrame, quiet_minutes: int = 30, lifetime_hours: int = 24, delay: str = "30 minutes") -> DataFrame:
    """Runs of events of an asset, closed by a quiet gap or a lifetime, each emitted once. State: the open run's bounds and count."""
    ship(events.sparkSession)
    quiet, life = pd.Timedelta(minutes=quiet_minutes), pd.Timedelta(hours=lifetime_hours)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, now = [], None
        if state.exists:
            first, last, n = state.get
            now = [pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), n]
        row = lambda c: (f"{key[0]}|{c[0].isoformat()}", key[0], c[2], c[0], c[1])
        if state.hasTimedOut:
            closed.append(row(now))
            now = None
        else:
            for ts in sorted(t for b in batches for t in b["ts"]):
                if now and (ts - now[1] > quiet or ts - now[0] > life):
                    closed.append(row(now))
                    now = None
                now = [ts, ts, 1] if now is None else [now[0], max(now[1], ts), now[2] + 1]
        if now:
            micro = lambda t: int(t.value // 1000)
            state.update((micro(now[0]), micro(now[1]), now[2]))
            state.setTimeoutTimestamp(max(int((now[1] + quiet).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame(closed, columns=["cluster_id", "asset_id", "n", "first_ts", "last_ts"])

    return events.withWatermark("ts", delay).groupBy("asset_id").applyInPandasWithState(step, CLUSTER, "first bigint, last bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each micro-batch by ``sink``; restarts from ``checkpoint``."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def idempotent(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that a repeated micro-batch overwrites instead of doubling."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def relayed(pending: DataFrame, failing: Column) -> DataFrame:
    """Pending rows after an attempt to publish: each has its time; failing ones stay pending."""
    return pending.withColumn("attempted_at", F.current_timestamp()).withColumn("status", F.when(failing, "PENDING").otherwise("DELIVERED"))


def relay(publish: Callable[[list[dict]], list[bool]], path: str) -> Callable[[DataFrame, int], None]:
    """A sink that publishes each micro-batch from the executors, ``publish`` telling row by row what went out, and logs every row with the time of the attempt."""

    def write(batch: DataFrame, number: int) -> None:
        def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                p["status"] = ["DELIVERED" if ok else "PENDING" for ok in publish(p.to_dict("records"))]
                yield p

        out = StructType([*batch.schema.fields, StructField("status", StringType())])
        batch.mapInPandas(send, out).withColumn("attempted_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def consume(schema: str, path: str, failing: Callable[[DataFrame], Column], **options) -> Callable[[DataFrame, int], None]:
    """A sink that parts each micro-batch of deliveries into accepted, retried and quarantined ones, under a folder for each."""

    def write(batch: DataFrame, number: int) -> None:
        out = dedup.consumed(batch, "payload", schema, failing(batch), **options).persist()
        for folder, outcomes in (("accepted", ["ACK"]), ("retry", ["RETRY"]), ("quarantine", ["POISON", "DEAD"])):
            out.filter(F.col("outcome").isin(outcomes)).write.mode("overwrite").parquet(f"{path}/{folder}/batch={number}")
        out.unpersist()

    return write
