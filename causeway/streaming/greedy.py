"""Greedy near-duplicate deduplication of a stream, with the verdicts that a sequential pass in order of time gives.

A text waits until the stream's latest time is ``delay`` past its own; then it is judged with all that have come before it. State is a
table for each micro-batch: fingerprints kept in the last ``hours``, texts that still wait, and the latest time. A micro-batch reads
the state of the one before it and overwrites its own, so one that is repeated gives the same rows. State expires with its 48 hours.
Whether a text is near one kept depends on all of its fingerprint's blocks at once, so state isn't parted by block, but joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators import dedup
from causeway.scratch import materialize

KEPT, WAITING, CLOCK = "simhash bigint, at timestamp_ntz", "id bigint, at timestamp_ntz, simhash bigint", "latest timestamp_ntz"


def greedy_sink(path: str, hours: int = 48, delay: str = "1 hour") -> Callable[[DataFrame, int], None]:
    """A sink for texts of a stream: id, at (timestamp), text. Writes ``verdicts`` (id, kept) and its state under ``path``, by micro-batch; texts later than ``delay`` go to ``late``."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def before(name: str, schema: str) -> DataFrame:
            return spark.read.schema(schema).parquet(f"{path}/{name}/batch={number - 1}") if number else spark.createDataFrame([], schema)

        def put(rows: DataFrame, name: str) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

        clock = before("clock", CLOCK).first()
        last = clock.latest if clock else None
        own = batch.select("id", F.col("at").cast("timestamp_ntz").alias("at"), "text")
        prints = dedup.simhash(own.select("id", "text"), "id", "text").join(own.select("id", "at"), "id")
        coming = materialize(prints.select("id", "at", "simhash"), "coming")
        wait = F.expr(f"interval {delay}")
        late = (F.col("at") < F.lit(last).cast("timestamp_ntz") - wait) if last else F.lit(False)
        put(coming.filter(late).select("id"), "late")
        rows = before("waiting", WAITING).unionByName(coming.filter(~late))
        latest = coming.agg(F.greatest(F.max("at"), F.lit(last).cast("timestamp_ntz")).alias("latest"))
        now = latest.first().latest
        put(spark.createDataFrame([(now,)], CLOCK), "clock")
        line = F.lit(now).cast("timestamp_ntz") - wait
        put(rows.filter(F.col("at") >= line), "waiting")
        ready, kept = rows.filter(F.col("at") < line), before("kept", KEPT)
        both = ready.select("simhash", "at").unionByName(kept)
        links = materialize(dedup.near_links(both, at_col="at", hours=hours), "links")
        told = materialize(dedup.greedy(ready, links, hours, kept), "verdicts")
        put(told, "verdicts")
        keep = ready.join(told.filter("kept"), "id").select("simhash", "at").unionByName(kept)
        put(keep.filter(F.col("at") >= line - F.make_dt_interval(F.lit(0), F.lit(hours))).groupBy("simhash").agg(F.max("at").alias("at")), "kept")

    return write
