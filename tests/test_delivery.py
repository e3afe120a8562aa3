"""Streams of deliveries, hooks, data sources and clusters in time, against plain loops."""

import datetime as dt
import json
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.functions import text as T
from causeway.operators import asof, clusters, hooks, rules
from causeway.sources import datasources
from causeway.streaming import flows


def test_consumer_quarantines_poison_and_gives_up_after_three_attempts(spark, tmp_path):
    rows = [(1, '{"k": 1}', 0), (2, "{broken", 0), (3, "{}", 0), (4, '{"k": 4}', 1), (5, '{"k": 5}', 3), (6, None, 0)]
    spark.createDataFrame(rows, "id int, payload string, attempts int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, payload string, attempts int").parquet(f"{tmp_path}/in")
    flows.run(stream, flows.consume("k int", f"{tmp_path}/out", lambda b: F.col("id").isin(4, 5)), f"{tmp_path}/c").awaitTermination()
    ids = lambda folder: {r.id: r.outcome for r in spark.read.parquet(f"{tmp_path}/out/{folder}").collect()}
    assert ids("accepted") == {1: "ACK"} and ids("retry") == {4: "RETRY"} and ids("quarantine") == {2: "POISON", 3: "POISON", 5: "DEAD", 6: "POISON"}


def test_relay_isolates_failures_and_stamps_attempts(spark, tmp_path):
    spark.range(9).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in")
    flows.run(stream, flows.relay(lambda rows: [r["id"] % 4 != 1 for r in rows], f"{tmp_path}/log"), f"{tmp_path}/c").awaitTermination()
    got = {r.id: r for r in spark.read.parquet(f"{tmp_path}/log").collect()}
    assert len(got) == 9 and {i for i, r in got.items() if r.status == "PENDING"} == {1, 5} and all(r.attempted_at for r in got.values())


def test_alerts_survive_a_failing_channel_but_not_all(spark, tmp_path):
    def broken(alerts):
        raise OSError("down")

    sink = hooks.notify({"mail": broken, "chat": lambda alerts: None}, f"{tmp_path}/log")
    sink(spark.range(3).coalesce(1), 0)
    assert {(r.channel, r.n, r.error) for r in spark.read.parquet(f"{tmp_path}/log").collect()} == {("mail", 3, "down"), ("chat", 3, None)}
    with pytest.raises(Exception, match="no channel"):
        hooks.notify({"mail": broken}, f"{tmp_path}/log2")(spark.range(3), 0)


def test_provider_is_asked_once_for_each_new_text(spark):
    docs = spark.createDataFrame([(1, "a", "OTHER", True), (2, "a", "OTHER", True), (3, "b", "OTHER", True), (4, "c", "TRADE", False), (5, "d", "OTHER", True), (6, None, "OTHER", True)], "id int, title string, event_type string, allow_llm boolean")
    cache = spark.createDataFrame([("b", "deal")], "t string, answer string").select(hooks.identity("m", "t").alias("key"), "answer")
    out, fresh = hooks.classify_rest(docs, ["TRADE", "DEAL"], lambda xs: [{"a": " trade ", "d": "nonsense"}.get(x) for x in xs], cache, "m")
    assert {r.id: (r.event_type, r.answered_by) for r in out.collect()} == {1: ("TRADE", "provider"), 2: ("TRADE", "provider"), 3: ("DEAL", "cache"), 4: ("TRADE", "rules"), 5: ("OTHER", "rules"), 6: ("OTHER", "rules")}
    assert fresh.count() == 3
    off, none = hooks.classify_rest(docs, ["TRADE"])
    assert {r.event_type for r in off.collect()} == {"OTHER", "TRADE"} and none.count() == 0


def test_extractor_hook(spark):
    d = spark.createDataFrame([(1, "Firm buys mill", "", "DEAL", "buy"), (2, None, None, "OTHER", None)], "article_id int, title string, body string, event_type string, keyword string")
    assert {(r.article_id, r.actor, r.action_lemma) for r in hooks.extract_actions(d).collect()} == {(1, None, "buy"), (2, None, "OTHER")}
    got = hooks.extract_actions(d, lambda ts, bs: [((t.split() or [None])[0], "x", None) for t in ts])
    assert {(r.article_id, r.actor) for r in got.collect()} == {(1, "Firm"), (2, None)}


def test_feeds_and_prices_as_data_sources(spark, tmp_path):
    item = "<item><title>t{0}</title><link>http://x/{0}</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>"
    for f in ("f1", "f2"):
        (tmp_path / f).write_text(f"<rss><channel><title>c</title>{item.format(f)}{item.format(f + 'b')}</channel></rss>")
    got = datasources.articles(spark, ["f1", "f2"], folder=str(tmp_path))
    assert {(r.source_id, r.title) for r in got.collect()} == {("f1", "tf1"), ("f1", "tf1b"), ("f2", "tf2"), ("f2", "tf2b")}
    chart = {"chart": {"result": [{"meta": {"symbol": "S", "exchangeTimezoneName": "UTC"}, "timestamp": [86400, 172800], "indicators": {"quote": [{"open": [1, 2], "high": [1, 2], "low": [1, 2], "close": [1.5, None]}]}}]}}
    (tmp_path / "S").write_text(json.dumps(chart))
    assert [(r.symbol, r.close) for r in datasources.prices(spark, ["S"], folder=str(tmp_path)).collect()] == [("S", 1.5)]
    stream = spark.readStream.format("causeway_payloads").options(names="f1,f2", folder=str(tmp_path), polls="2").load()
    q = flows.run(stream, flows.idempotent(f"{tmp_path}/out"), f"{tmp_path}/c", processingTime="0 seconds")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_runs_end_after_a_gap_or_a_lifetime(spark):
    rng, t0 = random.Random(5), pd.Timestamp("2024-01-01")
    rows = []
    for key in "ab":
        at = t0
        for _ in range(150):
            at += pd.Timedelta(minutes=rng.choice([1, 5, 20, 29, 30, 31, 60]))
            rows.append((key, at.to_pydatetime(), len(rows)))
    want = {}
    for key in "ab":
        started = last = None
        for k, at, i in rows:
            if k == key:
                if last is None or at - last > pd.Timedelta(minutes=30) or at - started > pd.Timedelta(hours=2):
                    started = at
                want[i], last = started, at
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, event_id bigint").repartition(4)
    got = clusters.session_clusters(df, ["key"], lifetime="2 hours").collect()
    assert {r.event_id: r.started for r in got} == want


def test_online_clusters_follow_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 8))
    rows, t = [], pd.Timestamp("2024-01-01")
    for i in range(120):
        t += pd.Timedelta(minutes=int(rng.integers(1, 25)))
        v = centres[rng.integers(4)] + rng.normal(size=8) * rng.choice([0.1, 0.6])
        rows.append((i, ["X", "Y", "OTHER"][i % 3], t.to_pydatetime(), "p" if i % 10 == 0 else "q" if i % 17 == 0 else None, v.tolist()))
    want = set()
    for kind in "X", "Y", "OTHER":
        open_ = []

        def close(now, open_=open_, kind=kind):
            for c in list(open_):
                if now is None or now > min(c[3] + pd.Timedelta(minutes=60), c[2] + pd.Timedelta(hours=3)):
                    open_.remove(c)
                    want.add((f"{kind}|{c[0]}", c[4], c[2], c[3], "DEFERRED" if len(c[5]) > 1 else "EVENT"))

        for i, k, at, actor, v in rows:
            if k != kind:
                continue
            at, v = pd.Timestamp(at), np.array(v)
            close(at)
            sims = sorted(((c[1] @ v / np.linalg.norm(c[1]) / np.linalg.norm(v), c) for c in open_), key=lambda x: -x[0]) if kind != "OTHER" else []
            if sims and sims[0][0] > 0.8:
                c = sims[0][1]
                c[1], c[3], c[4] = (c[1] * c[4] + v) / (c[4] + 1), at, c[4] + 1
            else:
                c = [i, v, at, at, 1, set()]
                open_.append(c)
            c[5] |= {actor} - {None}
        close(None)
    df = spark.createDataFrame(rows, "article_id bigint, event_type string, at timestamp_ntz, actor string, vec array<double>").repartition(5)
    got = clusters.online_clusters(df, quiet="60 minutes", lifetime="3 hours").collect()
    assert {(r.cluster_id, r.n, pd.Timestamp(r.first_at), pd.Timestamp(r.last_at), r.status) for r in got} == want
    assert any(r.n > 3 for r in got) and {r.closed_by for r in got} == {"QUIET", "LIFETIME"}


def test_tiers_of_the_classifier(spark):
    r = rules.Rules(specific=(("tariff", "TRADE"), ("rate cut", "POLICY")), generic=(("deal", "DEAL"),), reject=(("match", "SPORT"),), company=(("acme", "A1"),), industry=(("steel", "G1"),), override=("court",), terms=("bourse",), sections={"sport": "SPORT"}, guards=(("denied_event", ("denies", "merger"), "OTHER"),))
    rows = [
        (1, "Tariff raised", "", None, "TRADE", "title"), (2, "Tariff raised", "", "sport", "SPORT", "publisher_section"), (3, "Acme tariff", "", "sport", "TRADE", "title"), (4, "Court hears tariff", "", "sport", "TRADE", "title"),
        (5, "Match lost over tariff", "", None, "SPORT", "title"), (6, "Deal done", "", None, "OTHER", "title"), (7, "Deal done on bourse", "", None, "DEAL", "title"), (8, "Deal worth $5", "", None, "DEAL", "title"),
        (9, "Morning", "a rate cut", None, "POLICY", "body"), (10, "Tariffs up", "after the match", None, "SPORT", "body_veto"), (11, "Steel tariff", "after the match", None, "TRADE", "title"), (12, "Morning", "a deal", None, "OTHER", "title"),
        (13, None, None, None, "OTHER", "title"), (14, "Firm denies merger tariff", "", None, "OTHER", "title"),
    ]
    d = spark.createDataFrame([x[:4] for x in rows], "article_id int, title string, body string, section string")
    got = {x.article_id: (x.event_type, x.source) for x in rules.classify(d, r).collect()}
    assert got == {x[0]: (x[4], x[5]) for x in rows}


def test_as_of_takes_the_last_mark(spark):
    rng = random.Random(6)
    marks = [(rng.choice("ab"), rng.randrange(100), i) for i in range(20)]
    marks = list({(k, t): (k, t, i) for k, t, i in marks}.values())
    rows = [(rng.choice("abc"), rng.randrange(100), i) for i in range(200)]
    got = asof.as_of(spark.createDataFrame(rows, "k string, t int, id int"), spark.createDataFrame(marks, "k string, t int, mark int"), ["k"], "t", ["mark"]).collect()
    want = {i: max(((mt, m) for mk, mt, m in marks if mk == k and mt <= t), default=(0, None))[1] for k, t, i in rows}
    assert {r.id: r.mark for r in got} == want and len(got) == len(rows)


def test_phrases_are_found_whatever_their_number(spark):
    rng = random.Random(9)
    words = ["rate", "rates", "cut", "cuts", "bid", "take", "over", "the", "new"]
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", "", ",", " "]) for _ in range(rng.randint(0, 30))), rng.choice([None, "The rate-cut bid", ""])) for i in range(80)]
    listed = {(" ".join(rng.choices(words, k=k)) for _ in range(1)).__next__() for k in (1, 2, 2, 3, 3, 4) for _ in range(6)} | {"cut b", "rate c"}
    many = sorted(listed) + [f"nothing like it {i}" for i in range(20_000)]
    table = spark.createDataFrame([("r", k, "v") for k in many], "role string, keyword string, value string")
    got = {(r.id, r.field, r.keyword): r.pos for r in rules.scan(spark.createDataFrame(docs, "id int, title string, body string").repartition(3), table, "id", ["title", "body"]).collect()}
    want = {}
    for i, *texts in docs:
        for name, text in zip(("title", "body"), texts, strict=True):
            hay = " " + re.sub(r"[^\w\s]", " ", (text or "").lower()) + " "
            for k in listed:
                ends = [f" {k}{s} " for s in T.SUFFIXES] if " " not in k else [" " + k]
                at = min((hay.find(e) for e in ends if e in hay), default=-1)
                if at >= 0:
                    want[i, name, k] = hay[: at + 1].count(" ")
    assert got == want and len(want) > 100
    few = rules.scan(spark.createDataFrame(docs, "id int, title string, body string"), table.limit(40), "id", ["title"])
    assert few._jdf.queryExecution().executedPlan().toString().count("Join") == 1


def test_filters_reach_the_bars_reader(spark, tmp_path):
    first, last, rows = dt.date(2023, 11, 1), dt.date(2024, 4, 30), []
    for symbol in "ABC":
        (tmp_path / symbol).mkdir()
        for k in range(0, 180, 3):
            day = first + dt.timedelta(days=k)
            rows.append((symbol, day, float(k)))
            with (tmp_path / symbol / f"{day:%Y-%m}.jsonl").open("a") as f:
                f.write(json.dumps({"session": day.isoformat(), "close": float(k)}) + "\n")
    bars = datasources.bars(spark, str(tmp_path), list("ABC"), first, last)
    assert {tuple(r) for r in bars.collect()} == set(rows) and bars.rdd.getNumPartitions() == 18
    few = bars.filter("symbol IN ('A', 'C') AND session > DATE '2024-01-10' AND session <= DATE '2024-02-20' AND close > 80")
    assert {tuple(r) for r in few.collect()} == {r for r in rows if r[0] in "AC" and dt.date(2024, 1, 10) < r[1] <= dt.date(2024, 2, 20) and r[2] > 80}
    assert few.rdd.getNumPartitions() == 4  # two symbols, two months
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "session" not in plan.split("Filter", 1)[1].split("\n")[0]  # only the close is still tested after the scan
    assert bars.filter("symbol = 'D'").count() == 0 and bars.filter("session = DATE '2023-11-04'").count() == 3
