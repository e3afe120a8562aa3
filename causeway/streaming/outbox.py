"""State with its outbox, and the relay of what is pending, on tables that change together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.scratch import materialize
from causeway.session import ship
from causeway.sources.ledger import Ledger

STATE, OUTBOX, SENT = "key string, value string, version bigint", "message_id string, key string, payload string, created_at timestamp_ntz", "message_id string, attempt bigint, delivered boolean, attempted_at timestamp"


def store(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark, path, {"state": STATE, "outbox": OUTBOX, "attempts": SENT})


def save(ledger: Ledger, txn: str, changes: DataFrame, telling: Column) -> bool:
    """changes: key, value, version, created_at. New versions of states, and a message for each one where ``telling`` holds, in one transaction."""
    new = changes.join(ledger.table("state").select("key", "version"), ["key", "version"], "left_anti").dropDuplicates(["key", "version"])
    new = materialize(new, "changes")
    message = F.sha2(F.concat_ws("|", "key", F.col("version").cast("string")), 256).alias("message_id")
    return ledger.commit(txn, {"state": new, "outbox": new.filter(telling).select(message, "key", F.col("value").alias("payload"), "created_at")})


def current(ledger: Ledger) -> DataFrame:
    """The latest version of each state."""
    return ledger.table("state").groupBy("key").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))


def pending(ledger: Ledger) -> DataFrame:
    """Messages not delivered yet, with the number of attempts so far."""
    tried = ledger.table("attempts").groupBy("message_id").agg(F.count(F.lit(1)).alias("attempts"), F.bool_or("delivered").alias("delivered"))
    return ledger.table("outbox").join(tried, "message_id", "left").filter(~F.coalesce("delivered", F.lit(False))).select("message_id", "key", "payload", "created_at", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def relay(ledger: Ledger, txn: str, publish: Callable[[dict], None], most: int = 100) -> bool:
    """Publishes the ``most`` oldest pending messages from the executors, each on its own: one that fails stays pending. The attempts are one transaction.

    A relay that is stopped after publishing and before its commit publishes again: delivery is at least once.
    """
    ship(ledger.spark)
    oldest = pending(ledger).withColumn("_rank", F.row_number().over(Window.orderBy("created_at", "message_id"))).filter(F.col("_rank") <= most).drop("_rank")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = []
            for row in b.to_dict("records"):
                try:
                    publish(row)
                    told.append(True)
                except Exception:  # a message's failure is its own  # noqa: BLE001
                    told.append(False)
            yield pd.DataFrame({"message_id": b["message_id"], "attempt": b["attempts"] + 1, "delivered": told})

    done = oldest.mapInPandas(send, "message_id string, attempt bigint, delivered boolean").withColumn("attempted_at", F.current_timestamp())
    return ledger.commit(txn, {"attempts": done})
