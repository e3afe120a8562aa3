"""Ordered folds of long histories in parallel: steps are composed within pieces of a key's history, then pieces within the key.

A fold whose step is a function of the state can be cut anywhere, if the composition of steps has a small form. Clamped
additions compose to a shift between two bounds; a policy with few states composes to a table from state to state.
Histories are cut by ranges of (key, order), so a key of any length is spread over tasks; what meets in one place per
key is a row for each piece of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from causeway.scratch import materialize
from causeway.session import ship


def cut(rows: DataFrame, key: str, order: list[str], pieces: int | None = None) -> DataFrame:
    """``rows`` with ``piece``, written to the shared folder: pieces follow each other in the order of (key, *order), ties stay together, and a key may have several."""
    dealt = rows.repartitionByRange(*([pieces] if pieces else []), key, *order)
    return materialize(dealt.withColumn("piece", F.spark_partition_id()), "pieces")


def running_sums(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, pieces: int | None = None) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` up to each row, within equal ``keys`` (all rows, if none). Rows that tie in ``order`` count each other.

    A key's rows are spread over as many tasks as they fill: sums of pieces are added up first, a row for each piece and key, then rows within a piece.
    Null values add nothing (a sum without any other is null); null keys are a group of their own.
    """
    head, *tail = [*keys, *order]
    parts = cut(rows, head, tail, pieces)
    sums = parts.groupBy("piece", *keys).agg(F.sum(value).alias("_sum")).select(F.col("piece").alias("_at"), *(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), "_sum")
    keyed = Window.partitionBy(*(f"_{i}" for i in range(len(keys)))).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.sum("_sum").over(keyed))
    on = F.col("piece") == F.col("_at")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_{i}"))
    own = F.sum(value).over(Window.partitionBy("piece", *keys).orderBy(*order))
    total = F.when(own.isNull(), F.col("_before")).otherwise(own + F.coalesce("_before", F.lit(0)))
    return parts.join(sums, on).withColumn(out, total).select(*rows.columns, out)


def _clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, x))


def _compose(a: Column, b: Column) -> Column:
    """First ``a``, then ``b``: x -> clamp(x + shift, low, high)."""
    low, high = _clamp(a["low"] + b["shift"], b["low"], b["high"]), _clamp(a["high"] + b["shift"], b["low"], b["high"])
    return F.struct((a["shift"] + b["shift"]).alias("shift"), low.alias("low"), high.alias("high"))


def clamped_sums(steps: DataFrame, key: str, order: list[str], delta: str, start: str, low: float, high: float, pieces: int | None = None) -> DataFrame:
    """key, ``value`` and ``n``: from ``start`` (the same in all rows of a key), each step adds ``delta`` and clamps to [low, high], in order.

    Equals the sequential fold but for rounding. A null delta adds nothing; ties are taken in the order of all columns of ``order``.
    """
    parts = cut(steps.select(key, *order, F.coalesce(delta, F.lit(0.0)).alias("_delta"), F.col(start).alias("_start")), key, order, pieces)
    inf = F.lit(float("inf"))
    same = F.struct(F.lit(0.0).alias("shift"), (-inf).alias("low"), inf.alias("high"))
    step = lambda x: F.struct(x["_delta"].alias("shift"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
    run = F.array_sort(F.collect_list(F.struct(*order, "_delta")))
    each = parts.groupBy(key, "piece").agg(F.first("_start").alias("_start"), run.alias("run")).select(key, "piece", "_start", F.size("run").alias("n"), F.aggregate("run", same, lambda a, x: _compose(a, step(x))).alias("f"))
    whole = each.groupBy(key).agg(F.first("_start").alias("_start"), F.sum("n").cast("bigint").alias("n"), F.array_sort(F.collect_list(F.struct("piece", "f"))).alias("fs"))
    f = F.aggregate("fs", same, lambda a, x: _compose(a, x["f"]))
    return whole.withColumn("_f", f).select(key, _clamp(F.col("_start") + F.col("_f.shift"), F.col("_f.low"), F.col("_f.high")).alias("value"), "n")


class Automaton:
    """A policy with few states. ``step`` takes a state and a symbol (a tuple of a row's columns) and gives the next state and the row's outcome; where the scope changes, ``renew`` gives the state to go on from."""

    def __init__(self, states: tuple, step: Callable[[Any, tuple], tuple[Any, str]], renew: Callable[[Any], Any] = lambda s: s):
        self.states, self.step, self.begin = states, step, 0
        self.renewed = tuple(states.index(renew(s)) for s in states)
        self.known: dict[tuple, tuple[tuple[int, ...], tuple[str, ...]]] = {}

    def moves(self, symbol: tuple) -> tuple[tuple[int, ...], tuple[str, ...]]:
        """Where each state goes, and what it tells."""
        if symbol not in self.known:
            told = [self.step(s, symbol) for s in self.states]
            self.known[symbol] = tuple(self.states.index(s) for s, _ in told), tuple(o for _, o in told)
        return self.known[symbol]


def outcomes(rows: DataFrame, automaton: Automaton, key: str, order: list[str], scope: str, symbol: list[str], pieces: int | None = None) -> DataFrame:
    """key, the columns of ``order`` and the outcome of each row, as the automaton gives it in order. Symbols and the scope don't fall as the order grows.

    Each piece is composed to a table of where it takes every state; a key's pieces, a row each, are chained; then each piece is run from its own state.
    """
    ship(rows.sparkSession)
    own = [key, *order, F.col(scope).cast("string").alias("_scope"), *(F.col(c).alias(f"_s{i}") for i, c in enumerate(symbol))]
    parts = cut(rows.select(*own), key, order, pieces)
    kind = rows.schema[key].dataType
    signs = [f"_s{i}" for i in range(len(symbol))]

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, out = None, []
        for b in batches:
            for piece, k, day, *sign in zip(b["piece"], b[key], b["_scope"], *(b[c] for c in signs), strict=True):
                if at != (piece, k):
                    if at:
                        out.append((at[1], at[0], first, last, list(ends)))
                    at, first, last, ends = (piece, k), day, day, tuple(range(len(automaton.states)))
                if day != last:
                    ends, last = tuple(automaton.renewed[e] for e in ends), day
                to, _ = automaton.moves(tuple(sign))
                ends = tuple(to[e] for e in ends)
            yield pd.DataFrame(out, columns=["key", "piece", "first", "last", "ends"])
            out = []
        if at:
            yield pd.DataFrame([(at[1], at[0], first, last, list(ends))], columns=["key", "piece", "first", "last", "ends"])

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        state, day, out = automaton.begin, None, []
        for k, piece, first, last, ends in group.sort_values("piece").itertuples(index=False):
            state = automaton.renewed[state] if day is not None and first != day else state
            out.append((k, piece, state))
            state, day = ends[state], last
        return pd.DataFrame(out, columns=["_key", "_piece", "_state"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for b in batches:
            told = []
            for piece, k, day, start, *sign in zip(b["piece"], b[key], b["_scope"], b["_state"], *(b[c] for c in signs), strict=True):
                if at != (piece, k):
                    at, state, last = (piece, k), int(start), day
                if day != last:
                    state, last = automaton.renewed[state], day
                to, said = automaton.moves(tuple(sign))
                told.append(said[state])
                state = to[state]
            yield b[[key, *order]].assign(outcome=told)

    sorted_ = lambda df: df.repartition("piece", key).sortWithinPartitions("piece", key, *order)
    field = lambda name: StructField(name, kind)
    ends = sorted_(parts).mapInPandas(tables, StructType([field("key"), *StructType.fromDDL("piece int, first string, last string, ends array<int>")]))
    begun = ends.groupBy("key").applyInPandas(chain, StructType([field("_key"), *StructType.fromDDL("_piece int, _state int")]))
    joined = parts.join(begun, (F.col(key) == F.col("_key")) & (F.col("piece") == F.col("_piece")))
    return sorted_(joined.drop("_key", "_piece")).mapInPandas(run, StructType([rows.schema[c] for c in (key, *order)] + [StructField("outcome", StringType())]))
