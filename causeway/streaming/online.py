"""Online clusters as a stream: state by event type, event-time timers for what is due.

Rows wait in state until the watermark has passed them and are then taken in order of time, so results don't depend on
how deliveries fall into micro-batches. Needs the RocksDB state store, which :func:`use_rocksdb` sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from causeway.operators.clusters import CLUSTERED, COLUMNS, Cluster, OpenClusters, closed_row, micros, part_of
from causeway.session import ship

OPEN = "mean array<double>, n bigint, first bigint, last bigint, actors array<string>"
WAITING = "at array<bigint>, article array<string>, actor array<string>, vec array<binary>"
#: Rows of closed clusters that are sent at once.
SENT = 10_000


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state in RocksDB, with changelogs, from the next query on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class OnlineClusters(StatefulProcessor):
    """State of a type: open clusters by id, and the articles that the watermark hasn't passed, in chunks by slots of time. One timer, for the next article or cluster that is due.

    Slots are taken one after the other, so that the articles of one, and not all that wait, are in memory.
    """

    def __init__(self, threshold: float, quiet: int, lifetime: int, never: tuple[str, ...]):
        self.threshold, self.quiet, self.lifetime, self.never = threshold, quiet, lifetime, never
        self.slot = max(1, lifetime // 24)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "id string", OPEN)
        self.waiting = handle.getMapState("waiting", "slot bigint, number bigint", WAITING)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number = 1 + max((n for _, n in self._chunks()), default=-1)
        for b in rows:
            at = b["at"].astype("datetime64[us]").astype("int64").to_numpy()
            slots = at // self.slot
            order = np.argsort(slots, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(slots[order])) + 1) if len(order) else ():
                self._put(int(slots[part[0]]), number, [(int(at[i]), str(b["article_id"].iloc[i]), None if pd.isna(b["actor"].iloc[i]) else b["actor"].iloc[i], _packed(b["vec"].iloc[i])) for i in part])
                number += 1
        yield from self._settle(key, timerValues)

    def _chunks(self) -> list[tuple[int, int]]:
        return sorted((int(k[0]), int(k[1])) for k in self.waiting.keys()) if self.waiting.exists() else []

    def _put(self, slot: int, number: int, rows: list[tuple]) -> None:
        self.waiting.updateValue((slot, number), tuple(list(x) for x in zip(*rows, strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues)

    def _settle(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """Takes every article before the watermark, in order, and closes what is over by then."""
        kind, now = key[0], timerValues.getCurrentWatermarkInMs() * 1000
        before = {k[0]: v for k, v in self.open.iterator()} if self.open.exists() else {}
        state = OpenClusters(self.threshold, self.quiet, self.lifetime)
        for name in sorted(before):
            mean, n, first, last, actors = before[name]
            state.put(Cluster(name, np.asarray(mean, float), n, first, last, set(actors)))
        out, touched, gone = [], {}, set()

        def close(until: int) -> None:
            for c, why in state.closed(until):
                out.append(closed_row(kind, c, why))
                gone.add(c.id)
                touched.pop(c.id, None)

        due: int | None = None  # of the first article that is left
        for slot, keys in groupby(self._chunks(), key=lambda k: k[0]):
            if slot * self.slot >= now:
                due = slot * self.slot
                break
            keys = list(keys)
            rows = [r for k in keys for r in zip(*self.waiting.getValue(k), strict=True)]
            for at, article, actor, vec in sorted((r for r in rows if r[0] < now), key=lambda r: (r[0], _natural(r[1]))):
                close(at)
                c = state.add(f"{kind}|{article}", at, actor, _unpacked(vec), kind in self.never)
                touched[c.id] = c
                if len(out) >= SENT:
                    yield pd.DataFrame(out, columns=COLUMNS)
                    out.clear()
            left = [tuple(r) for r in rows if r[0] >= now]
            if len(left) < len(rows):
                for k in keys:
                    self.waiting.removeKey(k)
                if left:
                    self._put(slot, keys[-1][1], left)
            if left:
                due = min(r[0] for r in left)
                break  # this slot is the watermark's own
        close(now)
        for name in gone & before.keys():
            self.open.removeKey((name,))
        for name, c in touched.items():
            self.open.updateValue((name,), (c.mean.tolist(), c.n, c.first, c.last, sorted(c.actors)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = [x for x in (state.next_end(), due) if x is not None]
        if ends:
            self.handle.registerTimer(max(min(ends), now) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)


def _packed(vec: np.ndarray) -> bytes:
    """A vector as bytes, of single precision where that loses nothing."""
    wide = np.asarray(vec, "f8")
    with np.errstate(over="ignore"):
        narrow = wide.astype("f4")
    return b"4" + narrow.tobytes() if np.array_equal(narrow.astype("f8"), wide, equal_nan=True) else b"8" + wide.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    data = bytes(data)
    return np.frombuffer(data, "f" + data[:1].decode(), offset=1).astype(float)


def _natural(article: str) -> tuple[int, int | str]:
    """Numbers by value, as the batch orders them."""
    return (0, int(article)) if article.lstrip("-").isdigit() else (1, article)


def cluster_stream(articles: DataFrame, threshold: float = 0.80, quiet: str = "30 minutes", lifetime: str = "24 hours", never: tuple[str, ...] = ("OTHER",), delay: str = "30 minutes") -> DataFrame:
    """articles: a stream of article_id, event_type, at (timestamp), actor, vec. One row for each closed cluster, once, as :func:`causeway.operators.clusters.online_clusters` gives it.

    State is kept by event type; types in ``never`` are parted by article. Articles later than ``delay`` behind the latest are dropped, as usual with a watermark.
    """
    ship(articles.sparkSession)
    use_rocksdb(articles.sparkSession)
    rows = articles.select("article_id", "event_type", "at", "actor", "vec", part_of(never).alias("part")).withWatermark("at", delay)
    processor = OnlineClusters(threshold, micros(quiet), micros(lifetime), never)
    return rows.groupBy("event_type", "part").transformWithStateInPandas(processor, CLUSTERED, "append", "eventTime")


def cluster_events(closed: DataFrame) -> DataFrame:
    """One event for each closed cluster without conflict; deferred ones have none."""
    return closed.filter("status = 'EVENT'").select("event_type", F.sha2("cluster_id", 256).alias("event_id"), "first_at", "last_at", "n", "closed_by")
