"""Stateful streams against plain loops, whatever the micro-batches, and across restarts."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.operators import clusters
from causeway.streaming import flows, online, outbox, versions


def arrivals(n=150, seed=3):
    rng = np.random.default_rng(seed)
    centres, t, rows = rng.normal(size=(4, 8)), pd.Timestamp("2024-01-01"), []
    for i in range(n):
        t += pd.Timedelta(minutes=int(rng.integers(1, 25)))
        v = centres[rng.integers(4)] + rng.normal(size=8) * rng.choice([0.1, 0.6])
        rows.append((i, ["X", "Y", "OTHER"][i % 3], t.to_pydatetime(), "p" if i % 4 == 0 else "q" if i % 7 == 0 else None, v.tolist()))
    return rows


SCHEMA = "article_id bigint, event_type string, at {0}, actor string, vec array<double>"


@pytest.mark.parametrize("parts", [1, 4])
def test_streamed_clusters_equal_the_batch_and_survive_restarts(spark, tmp_path, parts):
    rows = arrivals()
    want = {tuple(r) for r in clusters.online_clusters(spark.createDataFrame(rows, SCHEMA.format("timestamp_ntz")), quiet="60 minutes", lifetime="3 hours").collect()}
    rng = np.random.default_rng(parts)
    clock = (10**6, "CLOCK", pd.Timestamp("2024-03-01").to_pydatetime(), None, [1.0] * 8)
    cuts = np.array_split(np.arange(len(rows)), parts)
    for k, cut in enumerate([*cuts, None]):
        # within a file, rows are out of order; each file is a run of its own, from the same checkpoint
        batch = [rows[i] for i in rng.permutation(cut)] if cut is not None else [clock]
        spark.createDataFrame(batch, SCHEMA.format("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA.format("timestamp")).parquet(f"{tmp_path}/in")
        out = online.cluster_stream(stream, quiet="60 minutes", lifetime="3 hours", delay="10 minutes")
        flows.run(out, flows.idempotent(f"{tmp_path}/out"), f"{tmp_path}/c").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {r.status for r in got} == {"EVENT", "DEFERRED"} and {r.closed_by for r in got} == {"QUIET", "LIFETIME"}


def test_a_transaction_appears_whole_or_not_at_all(spark, tmp_path):
    ledger = outbox.store(spark, f"file://{tmp_path}/store")
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(f"k{i}", "v", 1, t0 + dt.timedelta(minutes=i)) for i in range(8)], "key string, value string, version bigint, created_at timestamp_ntz").repartition(4)
    assert outbox.save(ledger, "one", rows, F.col("key") < "k5")
    assert not outbox.save(ledger, "one", rows, F.lit(True))  # repeated
    assert outbox.save(ledger, "two", rows, F.lit(True))  # a new name, but no new version
    assert ledger.table("state").count() == 8 and outbox.pending(ledger).count() == 5

    @F.udf("string")
    def failing(x):
        if x == "k7":
            raise RuntimeError("lost")
        return x

    later = rows.withColumn("version", F.lit(2).cast("bigint"))
    broken = later.withColumn("key", failing("key"))
    with pytest.raises(Exception, match="lost"):
        ledger.commit("three", {"state": later, "outbox": broken.select(F.col("key").alias("message_id"), "key", F.col("value").alias("payload"), "created_at")})
    assert ledger.table("state").count() == 8 and outbox.pending(ledger).count() == 5  # the states that were written are not seen
    assert outbox.save(ledger, "three", later, F.lit(False)) and {r.version for r in outbox.current(ledger).collect()} == {2}


def test_two_writers_take_different_numbers(spark, tmp_path):
    a, b = outbox.store(spark, f"file://{tmp_path}/s"), outbox.store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("k", "v", 1)], "key string, value string, version bigint")
    stale = a.commits  # one that looked before the other committed
    b.commit("b", {"state": rows})
    looks = iter([True, True])
    a.commits = lambda: [] if next(looks, False) else stale()
    assert a.commit("a", {"state": rows})
    assert [c["name"] for c in stale()] == ["b", "a"]


def test_relay_isolates_failures_and_goes_on(spark, tmp_path):
    ledger = outbox.store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(f"k{i}", "v", 1, dt.datetime(2024, 1, 1, 0, i)) for i in range(6)], "key string, value string, version bigint, created_at timestamp_ntz")
    outbox.save(ledger, "s", rows, F.lit(True))

    def publish(row):
        if row["key"] == "k1" and row["attempts"] == 0:
            raise RuntimeError("no")

    assert outbox.relay(ledger, "r1", publish, 4)
    assert {(r.key, r.attempts) for r in outbox.pending(ledger).collect()} == {("k1", 1), ("k4", 0), ("k5", 0)}
    assert outbox.relay(ledger, "r2", publish, 4) and outbox.pending(ledger).count() == 0
    assert not outbox.relay(ledger, "r2", publish)


def test_late_events_make_versions_with_all_members(spark, tmp_path):
    rng, t0 = random.Random(6), dt.datetime(2024, 1, 1)
    events = [(i, rng.choice("AB"), t0 + dt.timedelta(minutes=rng.randrange(0, 180))) for i in range(60)]
    arrived = sorted(events, key=lambda e: e[2] + dt.timedelta(minutes=rng.choice([0, 0, 0, 40, 90])))
    batches = [arrived[k * 15 : (k + 1) * 15] for k in range(4)]
    batches[2] += batches[1][:3]  # delivered twice
    want, state, version, now = [], {}, {}, None
    for batch in batches:
        now = max([e[2] for e in batch] + ([now] if now else []))
        for i, a, t in batch:
            w = t - dt.timedelta(minutes=t.minute % 15)
            state.setdefault((a, w), {})[i] = t
        for (a, w), members in state.items():
            if w + dt.timedelta(minutes=20) <= now and len(members) > version.get((a, w), (0, 0))[1]:
                version[a, w] = version.get((a, w), (0, 0))[0] + 1, len(members)
                want.append((a, w, version[a, w][0], tuple(i for i, _ in sorted(members.items(), key=lambda x: (x[1], x[0])))))
    for batch in batches:  # each batch is a run of its own, from the same checkpoint
        spark.createDataFrame(batch, "event_id bigint, asset_id string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("event_id bigint, asset_id string, ts timestamp").parquet(f"{tmp_path}/in")
        flows.run(stream, versions.versions_sink(f"{tmp_path}/out"), f"{tmp_path}/c").awaitTermination()
    got = [(r.asset_id, r.window_start, r.version, tuple(r.members)) for r in spark.read.parquet(f"{tmp_path}/out/versions").collect()]
    assert sorted(got) == sorted(want) and max(r[2] for r in got) > 1


def test_revisions_stop_at_a_gap_or_a_conflict(spark):
    rows = [("a", 2, "x"), ("a", 3, "y"), ("a", 5, "z"), ("b", 1, "x"), ("b", 2, "y"), ("b", 2, "other"), ("b", 3, "z"), ("c", 1, "old"), ("c", 3, "late")]
    done = F.when(F.col("k") == "a", 1).when(F.col("k") == "c", 2).otherwise(0)
    got = versions.contiguous(spark.createDataFrame(rows, "k string, r int, content string"), "k", "r", done).collect()
    assert sorted(map(tuple, got)) == [("a", 2, "x"), ("a", 3, "y"), ("b", 1, "x"), ("c", 3, "late")]


@pytest.mark.parametrize("first", ["scores", "notices"])
def test_scores_meet_notices_in_either_order(spark, tmp_path, first):
    t0 = dt.datetime(2024, 1, 1)
    day = lambda n: t0 + dt.timedelta(days=n)
    scores = [(f"k{i}", day(3), float(i)) for i in range(6)]
    notices = [("k0", day(1)), ("k0", day(2)), ("k1", day(4)), ("k2", day(3)), ("k2", day(3)), ("zz", day(1))]  # k1's comes after its score was due
    flush = [("clock", day(60), 0.0)], [("clock2", day(60))]
    schema = {"scores": "key string, scored_at timestamp, r double", "notices": "key string, superseded_at timestamp"}

    def put(name, rows):
        spark.createDataFrame(rows, schema[name]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def run():
        streams = [spark.readStream.schema(schema[n]).parquet(f"{tmp_path}/{n}") for n in ("scores", "notices")]
        flows.run(flows.judged(*streams), flows.idempotent(f"{tmp_path}/out"), f"{tmp_path}/c").awaitTermination()

    rows = {"scores": scores, "notices": notices}
    for name in ("scores", "notices"):
        put(name, rows[name] if name == first else rows[name][:0])
    run()
    put("scores" if first == "notices" else "notices", rows["scores" if first == "notices" else "notices"])
    run()
    for name, extra in zip(("scores", "notices"), flush, strict=True):
        put(name, extra)
    run()
    got = sorted((r.key, r.skipped) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.key != "clock")
    assert got == [("k0", True), ("k1", False), ("k2", True), ("k3", False), ("k4", False), ("k5", False)]
