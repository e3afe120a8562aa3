"""Slot grids, carried observations, revision folds and intraday policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET = BAND = 0.003


def slotted(samples: DataFrame, seconds: int) -> DataFrame:
    """asset_id, session, slot of the day, value, event_id."""
    of_day = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return samples.select("asset_id", F.to_date("ts").alias("session"), F.floor(of_day / seconds).cast("int").alias("slot"), "value", "event_id")


def grid(samples: DataFrame, first: int, end: int) -> DataFrame:
    """Every slot of [first, end) on each (asset, session) sampled."""
    return samples.select("asset_id", "session").distinct().withColumn("slot", F.explode(F.sequence(F.lit(first), F.lit(end - 1))))


def missing_slots(samples: DataFrame, first: int, end: int) -> DataFrame:
    return grid(samples, first, end).join(samples, ["asset_id", "session", "slot"], "left_anti")


def carried(samples: DataFrame, first: int, end: int, expiry: int) -> DataFrame:
    """Last observation at each grid slot, no older than ``expiry`` slots: each sample is laid on the slots it can serve, the latest wins."""
    laid = samples.withColumn("at", F.explode(F.sequence(F.col("slot"), F.col("slot") + expiry))).filter((F.col("at") >= first) & (F.col("at") < end))
    last = laid.groupBy("asset_id", "session", "at").agg(F.max_by("value", F.struct("slot", "event_id")).alias("value")).withColumnRenamed("at", "slot")
    return grid(samples, first, end).join(last, ["asset_id", "session", "slot"], "left")


def contiguous(revisions: DataFrame, key: str, revision: str = "revision") -> DataFrame:
    """Revisions 1, 2, ... of each key up to the first gap; one row for each revision."""
    w = Window.partitionBy(key).orderBy(revision)
    return revisions.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == F.col(revision)).drop("_k")


def _closing(r: Column) -> Column:
    return F.when(F.abs(r) <= BAND, "NEUTRAL").when(r > 0, "UP").otherwise("DOWN")


def target_policy(samples: DataFrame, first: int, last: int) -> DataFrame:
    """Baseline, excursions, closing and verdicts of each (asset, session) from samples in slots first to last."""
    order = F.struct("slot", "event_id")
    b = samples.filter(F.col("slot").between(first, last)).groupBy("asset_id", "session").agg(
        F.min_by("value", order).alias("base"), F.max_by("value", order).alias("last"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.count_distinct("slot").alias("slots")
    )
    up, down = F.col("hi") / F.col("base") - 1, F.col("lo") / F.col("base") - 1
    few = F.col("slots") < 2
    return b.select(
        "asset_id", "session", up.alias("max_up"), down.alias("max_down"),
        F.when(few, "INSUFFICIENT_WINDOW").when(up >= TARGET, "TARGET_REACHED").otherwise("TARGET_NOT_REACHED").alias("verdict"),
        _closing(F.col("last") / F.col("base") - 1).alias("closing"), (F.col("slots") == last - first + 1).alias("complete"),
        F.when(few, "INSUFFICIENT_SAMPLES").when((up > BAND) | (down < -BAND), "BAND_BREACH_OBSERVED").otherwise("WITHIN_BAND_AT_SAMPLES").alias("outcome"),
    )
