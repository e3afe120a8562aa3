"""Folds of long histories against sequential loops, with keys that several tasks share."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import folds, learning, stance


def plain_stance(rows, cap):
    active, today, out = None, {}, []
    for at, direction, is_open, propagated in sorted(rows):
        if propagated and active is not None and active != direction:
            out.append("CONTRADICTS")
        elif is_open and active == direction:
            out.append("SAME_DIRECTION")
        elif is_open and today.get(at.date(), 0) >= cap:
            out.append("DAILY_CAP")
        else:
            out.append("STORED" if is_open or active is None else "SUPERSEDES")
            today[at.date()] = today.get(at.date(), 0) + (out[-1] == "STORED")
            active = direction
    return out


@pytest.mark.parametrize(("pieces", "cap"), [(1, 2), (7, 2), (40, 1)])
def test_stance_equals_the_sequential_policy(spark, pieces, cap):
    rng, rows = random.Random(pieces), {}
    for asset, n in (("HOT", 600), ("A", 40), ("B", 1)):
        at = dt.datetime(2024, 1, 8, 9)
        rows[asset] = []
        for _ in range(n):
            at += dt.timedelta(minutes=rng.choice([0, 5, 60, 400]))
            rows[asset].append((at, rng.choice(["UP", "DOWN", "NEUTRAL"]), rng.random() < 0.8, rng.random() < 0.2))
    table = spark.createDataFrame([(a, *r) for a, rs in rows.items() for r in rs], "asset_id string, decision_at timestamp_ntz, direction string, open boolean, propagated boolean").repartition(5)
    got = stance.apply_stance(table, cap, pieces).collect()
    want = [(a, r[0], r[1], o) for a, rs in rows.items() for r, o in zip(sorted(rs), plain_stance(rs, cap), strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert len({o for *_, o in want}) == 5
    assert stance.apply_stance(table.limit(0)).count() == 0


def test_the_days_count_goes_on_in_the_next_piece(spark):
    at = dt.datetime(2024, 1, 8, 10)
    rows = [("A", at + dt.timedelta(minutes=i), "UP" if i % 2 else "DOWN", True, False) for i in range(30)] + [("A", at + dt.timedelta(days=1), "UP", True, False)]
    table = spark.createDataFrame(rows, "asset_id string, decision_at timestamp_ntz, direction string, open boolean, propagated boolean")
    got = [r.outcome for r in stance.apply_stance(table, 2, 10).orderBy("decision_at").collect()]
    assert got == ["STORED"] * 2 + ["DAILY_CAP", "SAME_DIRECTION"] * 14 + ["SAME_DIRECTION"]


def test_a_million_steps_of_one_edge(spark):
    """The history of one key is composed in many tasks, and equals the fold one by one."""
    n = 1_000_000
    steps = spark.range(n).select(
        F.lit("hot").alias("edge_id"), F.col("id").alias("scored_at"), F.lit("").alias("prediction_id"), F.lit(0.5).alias("weight"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("credit"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) < 49).alias("is_correct"),
    )
    rows = np.array(steps.selectExpr("if(is_correct, 1, -1) * 0.02 * credit").toPandas().iloc[:, 0])
    w = 0.5
    for x in rows.tolist():
        w = min(1.0, max(0.05, w + x))
    (got,) = learning.fold_weights(steps, 16).collect()
    assert got.n_steps == n and got.weight == pytest.approx(w, abs=1e-9)
    parts = folds.cut(steps.select("edge_id", "scored_at"), "edge_id", ["scored_at"], 16)
    sizes = [r["count"] for r in parts.groupBy("piece").count().collect()]
    assert len(sizes) == 16 and max(sizes) < n / 8


def test_clamped_sums_of_many_keys(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abcdef"), i, rng.choice([0.3, -0.4, 0.05, None])) for i in range(500)]
    table = spark.createDataFrame(rows, "k string, at int, d double").withColumn("w", F.lit(0.4))
    want = {k: 0.4 for k, *_ in rows}
    for k, _, d in rows:
        want[k] = min(0.9, max(0.1, want[k] + (d or 0.0)))
    for pieces in (1, 9):
        got = {r.k: r.value for r in folds.clamped_sums(table.repartition(4), "k", ["at"], "d", "w", 0.1, 0.9, pieces).collect()}
        assert got == pytest.approx(want)
    assert folds.clamped_sums(table.limit(0), "k", ["at"], "d", "w", 0.1, 0.9).count() == 0


@pytest.mark.parametrize("pieces", [1, 7, 30])
def test_running_sums_equal_a_loop(spark, pieces):
    rng = random.Random(pieces)
    rows = [(k, rng.randrange(300), rng.choice([None, *range(9)]), "clash") for k, n in (("HOT", 600), (None, 90), ("A", 1)) for _ in range(n)]
    rows.append(("EMPTY", 1, None, "clash"))
    table = spark.createDataFrame(rows, "k string, at int, n bigint, piece_of string").repartition(5)

    def plain(keyed):
        out = []
        for k, at, n, _ in rows:
            seen = [x for j, b, x, _ in rows if (j == k or not keyed) and b <= at and x is not None]
            out.append((k, at, n, sum(seen) if seen else None))
        return sorted(out, key=repr)

    for keys in (["k"], []):
        got = folds.running_sums(table, keys, ["at"], "n", "used", pieces)
        assert got.columns == [*table.columns, "used"]
        assert sorted(((r.k, r.at, r.n, r.used) for r in got.collect()), key=repr) == plain(bool(keys))
    assert folds.running_sums(table.limit(0), ["k"], ["at"], "n", "used").count() == 0
