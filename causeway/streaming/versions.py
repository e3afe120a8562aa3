"""Contexts of a stream in versions: a window's first version comes with its end and grace, and an event that comes later makes a new one with all members.

State is a table for each micro-batch: the events of windows that may still change, and each window's last version. A micro-batch reads the state of the one
before it and overwrites its own, so one that is repeated gives the same rows. Windows older than ``keep`` are closed for good; events for them go to ``dropped``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from causeway.scratch import materialize

MEMBERS = "event_id bigint, asset_id string, ts timestamp_ntz, window_start timestamp_ntz"
LAST = "asset_id string, window_start timestamp_ntz, version bigint, n bigint"
CLOCK = "latest timestamp_ntz"


def versions_sink(path: str, minutes: int = 15, grace: str = "5 minutes", keep: str = "7 days") -> Callable[[DataFrame, int], None]:
    """A sink for a stream of event_id, asset_id, ts (timestamp). Writes ``versions`` (asset_id, window_start, version, members in order) by micro-batch, as the state under ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def before(name: str, schema: str) -> DataFrame:
            return spark.read.schema(schema).parquet(f"{path}/{name}/batch={number - 1}") if number else spark.createDataFrame([], schema)

        def put(rows: DataFrame, name: str) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

        ts = F.col("ts").cast("timestamp_ntz")
        come = batch.select("event_id", "asset_id", ts.alias("ts"), F.window(ts, f"{minutes} minutes")["start"].alias("window_start"))
        come = materialize(come.dropDuplicates(["event_id"]), "come")
        clock = before("clock", CLOCK).first()
        last = F.lit(clock.latest if clock else None).cast("timestamp_ntz")
        now = come.agg(F.greatest(F.max("ts"), last).alias("latest")).first().latest
        put(spark.createDataFrame([(now,)], CLOCK), "clock")
        over = F.col("window_start") + F.expr(f"interval {minutes} minutes")
        gone = lambda at: F.coalesce(over + F.expr(f"interval {keep}") < at, F.lit(False))
        put(come.filter(gone(last)).select("event_id"), "dropped")
        held = before("members", MEMBERS)
        members = held.unionByName(come.filter(~gone(last)).join(held.select("event_id"), "event_id", "left_anti"))
        versions = before("last", LAST)
        ready = members.filter(over + F.expr(f"interval {grace}") <= F.lit(now).cast("timestamp_ntz"))
        found = ready.groupBy("asset_id", "window_start").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("m")).join(versions, ["asset_id", "window_start"], "left")
        new = materialize(found.filter(F.size("m") > F.coalesce("n", F.lit(0))).select("asset_id", "window_start", (F.coalesce("version", F.lit(0)) + 1).alias("version"), F.col("m.event_id").alias("members")), "versions")
        put(new, "versions")
        alive = lambda df: df.filter(~gone(F.lit(now).cast("timestamp_ntz")))
        put(alive(members), "members")
        rest = versions.join(new, ["asset_id", "window_start"], "left_anti").unionByName(new.select("asset_id", "window_start", "version", F.size("members").cast("bigint").alias("n")))
        put(alive(rest), "last")

    return write


def contiguous(revisions: DataFrame, key: str, revision: str, applied: Column) -> DataFrame:
    """Revisions that may be applied in order: those that follow on ``applied``, the last one of a key, without a gap. Conflicting copies of a revision stop it too."""
    each = revisions.groupBy(key, revision).agg(F.count_distinct("content").alias("_contents"), F.first("content").alias("content"), F.first(applied).alias("_applied"))
    ahead = each.filter(F.col(revision) > F.col("_applied"))
    place = F.row_number().over(_ordered(key, revision))
    sound = F.min(F.when((F.col(revision) == F.col("_applied") + place) & (F.col("_contents") == 1), F.lit(1)).otherwise(0)).over(_ordered(key, revision).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ahead.withColumn("_place", place).withColumn("_sound", sound).filter("_sound = 1").select(key, revision, "content")


def _ordered(key: str, revision: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(revision)
