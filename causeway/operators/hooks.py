"""Extension points: classifiers, extractors and channels that a caller supplies. All are off unless given."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.session import ship

#: From texts to raw answers; called in the executors for a batch at a time.
Provider = Callable[[Sequence[str]], Sequence[str | None]]
#: From titles and bodies to (actor, action lemma, object).
Extractor = Callable[[Sequence[str], Sequence[str]], Sequence[tuple[str | None, str, str | None]]]


def identity(model: str, text_col: str):
    """Key of a cached answer: of the model and the text it was asked about."""
    return F.sha2(F.concat(F.lit(model + "|"), F.coalesce(text_col, F.lit(""))), 256)


def classify_rest(docs: DataFrame, kinds: Sequence[str], provider: Provider | None = None, cache: DataFrame | None = None, model: str = "none", text_col: str = "title") -> tuple[DataFrame, DataFrame]:
    """docs: event_type, allow_llm and a text. Returns them with ``event_type`` filled in by the provider where it may be, ``answered_by``; and the answers new to the cache (key, answer).

    Each distinct text is asked about once, and never if the cache (key, answer) has it. Blank answers and types outside ``kinds`` count as none.
    """
    ship(docs.sparkSession)
    keyed = docs.withColumn("_key", F.when(F.col("allow_llm"), identity(model, text_col)))
    known = cache if cache is not None else docs.sparkSession.createDataFrame([], "key string, answer string")
    todo = keyed.filter("_key is not null").select(F.col("_key").alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"]).join(known, "key", "left_anti")
    if provider is None:
        fresh = known.limit(0)
    else:

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"key": b["key"], "answer": list(provider([x or "" for x in b["text"]]))})

        fresh = todo.mapInPandas(ask, "key string, answer string")
    good = lambda c: F.when(F.upper(F.trim(c)).isin(*kinds), F.upper(F.trim(c)))
    answers = known.select("key", good(F.col("answer")).alias("_answer"), F.lit("cache").alias("_by")).unionByName(fresh.select("key", good(F.col("answer")).alias("_answer"), F.lit("provider").alias("_by")))
    out = keyed.join(answers, keyed["_key"] == answers["key"], "left").drop("key", "_key")
    filled = F.coalesce("_answer", "event_type")
    return out.withColumn("event_type", filled).withColumn("answered_by", F.when(F.col("_answer").isNotNull(), F.col("_by")).otherwise("rules")).drop("_answer", "_by"), fresh


def extract_actions(docs: DataFrame, extractor: Extractor | None = None, id_col: str = "article_id") -> DataFrame:
    """docs: id, title, body, event_type, keyword. id, actor, action_lemma, object, event_type: of the extractor, else the keyword alone."""
    if extractor is None:
        return docs.select(id_col, F.lit(None).cast("string").alias("actor"), F.coalesce("keyword", F.lit("OTHER")).alias("action_lemma"), F.lit(None).cast("string").alias("object"), "event_type")
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = list(extractor(list(b["title"].fillna("")), list(b["body"].fillna(""))))
            yield pd.DataFrame({id_col: b[id_col], "actor": [x[0] for x in got], "action_lemma": [x[1] for x in got], "object": [x[2] for x in got], "event_type": b["event_type"]})

    return docs.select(id_col, "title", "body", "event_type").mapInPandas(run, f"{id_col} {kind}, actor string, action_lemma string, object string, event_type string")


def notify(channels: dict[str, Callable[[list[dict]], None]], path: str) -> Callable[[DataFrame, int], None]:
    """A sink for alert streams: each partition's alerts go to every channel; the log tells which failed. A partition that no channel takes fails the batch."""

    def write(batch: DataFrame, number: int) -> None:
        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                alerts, rows = b.to_dict("records"), []
                for name, channel in channels.items():
                    try:
                        channel(alerts)
                        rows.append((name, len(alerts), None))
                    except Exception as e:  # a channel's failure must not stop the others  # noqa: BLE001
                        rows.append((name, len(alerts), str(e)))
                if alerts and all(r[2] for r in rows):
                    raise RuntimeError(f"no channel took the alerts: {rows}")
                yield pd.DataFrame(rows, columns=["channel", "n", "error"])

        batch.mapInPandas(send, "channel string, n bigint, error string").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
