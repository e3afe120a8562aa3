"""Feeds and price payloads as Spark data sources: batch and stream readers over an adapter that fetches.

An adapter is a function from a partition's name (a feed or a symbol) to payload text; by default it reads a file of that name
in the folder given. Each name is a partition, so feeds are fetched side by side and one that fails is retried as a task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from causeway.session import ship
from causeway.sources import readers

Adapter = Callable[[str], str]
SCHEMA = "source_id string, payload string"


class FileAdapter:
    """Payloads from files ``folder/name``."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, name: str) -> str:
        return (Path(self.folder) / name).read_text(encoding="utf-8")


class _Reader(DataSourceReader):
    def __init__(self, names: list[str], adapter: Adapter):
        self.names, self.adapter = names, adapter

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in self.names]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        yield partition.value, self.adapter(partition.value)


class _Stream(DataSourceStreamReader):
    """Polls every name once a batch, up to ``polls`` times; the offset counts polls."""

    def __init__(self, names: list[str], adapter: Adapter, polls: int):
        self.names, self.adapter, self.polls, self.now = names, adapter, polls, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.now = min(self.now + 1, self.polls)
        return {"poll": self.now}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.now = max(self.now, end["poll"])  # after a restart, go on from the checkpoint
        return [InputPartition(n) for _ in range(start["poll"], end["poll"]) for n in self.names]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        yield partition.value, self.adapter(partition.value)


BARS = "symbol string, session date, close double"


class _Bars(DataSourceReader):
    """Daily bars in one JSON-lines file for each symbol and month, ``symbol/yyyy-mm.jsonl``. Filters on symbol and session choose the files that are planned; bounds on the session are kept by the files' readers."""

    def __init__(self, folder: str, symbols: list[str], first: date, last: date):
        self.folder, self.symbols, self.first, self.last = folder, symbols, first, last

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality and membership of symbols and bounds of sessions; gives back what it can't answer."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if isinstance(f, IsNotNull) and name in (("symbol",), ("session",)):
                continue  # no bar lacks them
            if isinstance(f, EqualTo) and name == ("symbol",):
                self.symbols = [s for s in self.symbols if s == value]
            elif isinstance(f, In) and name == ("symbol",):
                self.symbols = [s for s in self.symbols if s in value]
            elif isinstance(f, (EqualTo, GreaterThanOrEqual)) and name == ("session",):
                self.first = max(self.first, value)
                self.last = min(self.last, value) if isinstance(f, EqualTo) else self.last
            elif isinstance(f, GreaterThan) and name == ("session",):
                self.first = max(self.first, value + timedelta(days=1))
            elif isinstance(f, LessThanOrEqual) and name == ("session",):
                self.last = min(self.last, value)
            elif isinstance(f, LessThan) and name == ("session",):
                self.last = min(self.last, value - timedelta(days=1))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        months, at = [], self.first.replace(day=1)
        while at <= self.last:
            months.append(f"{at:%Y-%m}")
            at = (at + timedelta(days=32)).replace(day=1)
        return [InputPartition((s, m)) for s in self.symbols for m in months]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, date, float]]:
        if partition is None:  # none was planned
            return
        symbol, month = partition.value
        path = Path(self.folder) / symbol / f"{month}.jsonl"
        if path.exists():
            for line in path.read_text(encoding="utf-8").splitlines():
                bar = json.loads(line)
                at = date.fromisoformat(bar["session"])
                if self.first <= at <= self.last:
                    yield symbol, at, bar["close"]


class BarSource(DataSource):
    """Options: ``folder``, ``symbols`` by commas, ``first`` and ``last`` (ISO days) of what there is."""

    @classmethod
    def name(cls) -> str:
        return "causeway_bars"

    def schema(self) -> str:
        return BARS

    def reader(self, schema) -> DataSourceReader:
        days = (date.fromisoformat(self.options[k]) for k in ("first", "last"))
        return _Bars(self.options["folder"], [x for x in self.options["symbols"].split(",") if x], *days)


def bars(spark: SparkSession, folder: str, symbols: list[str], first: date, last: date) -> DataFrame:
    """Daily bars; filters on symbol and session reach the reader, so that only the months asked for are planned and read."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BarSource)
    return spark.read.format("causeway_bars").options(folder=folder, symbols=",".join(symbols), first=first.isoformat(), last=last.isoformat()).load()


class PayloadSource(DataSource):
    """Options: ``names`` by commas, ``folder`` for the file adapter, ``polls`` of a stream. Subclasses give another adapter."""

    @classmethod
    def name(cls) -> str:
        return "causeway_payloads"

    def schema(self) -> str:
        return SCHEMA

    def adapter(self) -> Adapter:
        return FileAdapter(self.options["folder"])

    def names(self) -> list[str]:
        return [x for x in self.options["names"].split(",") if x]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.names(), self.adapter())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.names(), self.adapter(), int(self.options.get("polls", "1")))


def payloads(spark: SparkSession, names: list[str], source: type[PayloadSource] = PayloadSource, **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(names=",".join(names), **options).load()


def articles(spark: SparkSession, feeds: list[str], **options) -> DataFrame:
    """Articles of feeds; see :func:`readers.feed_items`."""
    return readers.feed_items(payloads(spark, feeds, **options), "payload", "source_id")


def prices(spark: SparkSession, symbols: list[str], **options) -> DataFrame:
    """Daily bars of symbols; see :func:`readers.chart_bars`."""
    return readers.chart_bars(payloads(spark, symbols, **options), "payload", "source_id")
