"""What failed on larger or odd tables."""

import hashlib
import itertools
import time
from datetime import datetime, timedelta
from pathlib import Path
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from causeway import plans
from causeway.functions import clean
from causeway.operators import clusters, dedup, overlap, rules
from causeway.streaming import flows, online
from pyspark.sql import functions as F


def written(tmp_path, **tables):
    for name, rows in tables.items():
        pq.write_table(pa.table(rows), f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def same(spark, query, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = sorted(con.execute(plans.ORACLES[query]).fetchall(), key=str)
    assert sorted(map(tuple, plans.QUERIES[query](spark, folder).collect()), key=str) == want
    return want


def test_nation_pairs_are_counted_not_made(spark, tmp_path):
    n = 200_000
    sf = written(tmp_path, customer={"c_custkey": np.arange(n), "c_nationkey": np.zeros(n, "int64")}, supplier={"s_nationkey": np.zeros(n, "int64")}, nation={"n_nationkey": [0, 0, 1], "n_name": ["A", "B", "C"]})
    began = time.monotonic()
    assert {tuple(r) for r in plans.QUERIES["d07_using"](spark, sf).collect()} == {("A", n * n), ("B", n * n)}
    assert time.monotonic() - began < 30


def test_many_times_of_one_key_are_clustered_in_one_pass(spark):
    n = 300_000
    df = spark.range(n).selectExpr("cast(null as string) AS key", "timestampadd(SECOND, cast(id * 10 as int), timestamp_ntz'2024-01-01') AS ts", "id AS event_id")
    began = time.monotonic()
    got = clusters.session_clusters(df, ["key"]).groupBy("started").count().orderBy("started").collect()
    assert time.monotonic() - began < 60
    day = 8641  # the start and the 24 hours after it, that end included
    assert [r["count"] for r in got] == [day] * (n // day) + [n % day]


def test_a_price_of_zero_reaches_the_target(spark, tmp_path):
    at = [datetime(2024, 1, 3, 10) + timedelta(minutes=k) for k in range(6)]
    sf = written(tmp_path, events={"event_id": [1, 2, 3, 4, 5, 6], "ts": at, "user_id": [1, 1, 2, 2, 3, 3], "event_type": ["view"] * 6, "value": [0.0, 5.0, 7.0, 7.0, 0.0, 0.0], "props": ['{"k": 1}'] * 6})
    assert [r[3] for r in same(spark, "v05_shadow_sweep", sf, "events")] == ["TARGET_REACHED", "NOT_REACHED", "TARGET_REACHED"]


def test_the_latest_order_is_told_among_equal_keys(spark, tmp_path):
    day = datetime(2024, 1, 1)
    sf = written(tmp_path, customer={"c_custkey": [1, 2, 3]}, orders={"o_orderkey": [7, 7, 7, 8], "o_custkey": [1, 1, 1, 2], "o_orderdate": [day] * 4, "o_totalprice": [1.0, 3.0, 2.0, 5.0]})
    assert same(spark, "d09_latest_lateral", sf, "customer", "orders") == [(1, 7, 3.0), (2, 8, 5.0), (3, None, None)]


def test_the_latest_order_survives_a_shuffle(spark, tmp_path):
    n, rng = 6_000, np.random.default_rng(3)
    at = datetime(2024, 1, 1)
    odd = {"o_orderkey": [n, n + 1, None], "o_custkey": [41, None, 42], "o_orderdate": [None, at, at], "o_totalprice": [float("inf"), 1.0, None]}
    orders = {"o_orderkey": np.arange(n), "o_custkey": rng.integers(0, 40, n), "o_orderdate": [at + timedelta(days=int(k)) for k in rng.integers(0, 900, n)], "o_totalprice": np.round(rng.random(n), 2)}
    sf = written(tmp_path, customer={"c_custkey": pa.array([*range(44), 3, None], "int64")}, orders={k: pa.array([*v, *odd[k]]) for k, v in orders.items()})
    conf, key = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(key, "50")  # sorts are merged from pieces, as those of large tables are
    try:
        want = same(spark, "d09_latest_lateral", sf, "customer", "orders")
    finally:
        conf.remove(key)
    assert len(want) == 46


def test_sentences_of_odd_texts_are_counted_as_the_sql_counts(spark, tmp_path):
    texts = [None, "", " ", "a", "a.", ". a", "a. ", "a.\n", "a.\n ", "a. \n", "a. b.\t", "a.\x0bb", "a. \x0b", "a.\xa0", "a.\u3000", "\u3000a. b", "a. \u2003", "a.\r\nb", "a。b", "a. b。c", "?! a", ". . .", "...", "\n.\n", "a.\x00 b", "a. \u200b", "a.\x1cb", "a.\u0085b"]
    sf = written(tmp_path, documents={"doc_id": list(range(len(texts))), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts)})
    got = dict(same(spark, "h05_sentences", sf, "documents"))
    assert (got[0], got[1], got[6], got[7], got[18]) == (None, 1, 1, 2, 1)


def test_rules_in_a_dictionary_find_what_the_join_finds(spark):
    rng = np.random.default_rng(5)
    words = ["rate", "cut", "cuts", "strike", "striker", "striking", "de", "la", "las", "", "x\ny", "İst", "a-b"]
    texts = [None, "", "rate", "rate cut", " rate  cut "] + [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, body string").withColumn("title", F.reverse("body"))
    pairs = [("strike", "LABOUR"), ("strik", "LABOUR"), ("strik", "OTHER"), ("rate cut", "POLICY"), ("rate cut", "POLICY"), ("rate cut de", "POLICY"), ("de la", "X"), ("rate rate rate", "Y"), ("", "EMPTY"), ("de  la", "GAP")]
    table = rules.rule_table(spark, [("specific", *p) for p in pairs] + [("generic", *p) for p in pairs[:3]])
    got = rules.scan(docs, table, "id", ["title", "body"])
    joined = rules._joined(docs, table, "id", ["title", "body"]).groupBy("id", "field", "role", "keyword", "value").agg(F.min("pos").alias("pos"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, joined.collect()))
    assert {r.keyword for r in got.collect()} >= {"strike", "rate cut", "rate cut de", "de la", ""}
    assert "posexplode" not in got._jdf.queryExecution().toString()  # no row for each word
    known = rules.BROADCAST_ROWS
    try:
        rules.BROADCAST_ROWS = 8
        assert sorted(map(tuple, rules.scan(docs, table, "id", ["title", "body"]).collect())) == sorted(map(tuple, got.collect()))
    finally:
        rules.BROADCAST_ROWS = known


def test_tokens_of_a_fingerprint_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, ""), (4, " ".join(f"w{k % 977}" for k in range(120_000))), (5, "a"), (1, "c")], "id bigint, text string").coalesce(1)
    got = dedup.simhash(docs, "id", "text")

    def plain(tokens):
        hashes = [int(hashlib.sha256(t.encode()).hexdigest()[:15], 16) for t in tokens]
        return sum(1 << b for b in range(60) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    want = {1: plain(["b", "a", "b", "c"]), 2: 0, 3: 0, 4: plain(f"w{k % 977}" for k in range(120_000)), 5: plain(["a"])}
    assert {r.id: r.simhash for r in got.collect()} == want
    assert "explode" not in got._jdf.queryExecution().toString()


def test_vectors_leave_in_small_pieces(spark):
    texts = [None, "", "a b a", "B"] * 200
    sizes = [len(s) for s in clean.embed.func(iter([pd.Series(texts)]))]
    assert sum(sizes) == len(texts) and max(sizes) <= clean.EMBEDDED
    v = np.concatenate([np.stack(list(s)) for s in clean.embed.func(iter([pd.Series(texts)]))])
    assert np.allclose((v * v).sum(1), [0, 0, 1, 1] * 200)


class Held(dict):
    """Map state in memory, with the most rows that were read at once."""

    most = 0
    exists = keys = lambda self: list(dict.keys(self))
    iterator = lambda self: iter(list(self.items()))
    updateValue = dict.__setitem__
    removeKey = dict.pop

    def getValue(self, key):
        self.most = max(self.most, len(self[key][0]))
        return self[key]


def test_waiting_articles_are_read_by_slots_of_time():
    rng = np.random.default_rng(9)
    n, minute = 2_000, 60_000_000
    at = np.sort(rng.choice(np.arange(1, 50_000), n, replace=False)) * minute
    vecs = rng.normal(size=(n, 4)).astype("float32")
    p = online.OnlineClusters(0.8, 30 * minute, 1440 * minute, ())
    p.open, p.waiting, timers = Held(), Held(), []
    p.handle = SimpleNamespace(listTimers=lambda: list(timers), deleteTimer=timers.remove, registerTimer=timers.append)
    told, mixed = [], rng.permutation(n)
    now = lambda t: SimpleNamespace(getCurrentWatermarkInMs=lambda: int(t) // 1000)
    for part in np.array_split(mixed, 3):
        told += p.handleInputRows(("T",), iter([pd.DataFrame({"at": pd.to_datetime(at[part], unit="us"), "article_id": part, "actor": None, "vec": list(vecs[part])})]), now(0))
    for t in (at[n // 2], at[-1] + 3000 * minute):
        told += p.handleExpiredTimer(("T",), now(t), None)
    assert not p.waiting and not timers and p.waiting.most < n / 20
    state, want = clusters.OpenClusters(0.8, 30 * minute, 1440 * minute), []
    for i in range(n):
        want += [clusters.closed_row("T", *x) for x in state.closed(at[i])]
        state.add(f"T|{i}", at[i], None, vecs[i].astype(float), False)
    want += [clusters.closed_row("T", *x) for x in state.closed(None)]
    assert sorted(map(tuple, pd.concat(told).itertuples(index=False))) == sorted(want)
    wide = np.array([1e300, 1 / 3, np.nan])
    assert np.array_equal(online._unpacked(online._packed(wide)), wide, equal_nan=True)


def test_a_stream_is_dealt_by_many_tasks(spark, tmp_path):
    text = ["a b c", None, "d e f g"] * 4
    pq.write_table(pa.table({"doc_id": list(range(12)), "text": text}), f"{tmp_path}/documents.parquet", row_group_size=3)
    seen = []
    run, parts = flows.run, spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    flows.run = lambda stream, sink, at: (seen.append(len(list(Path(at.removeprefix("file:")).parent.glob("in/*.parquet")))), run(stream, sink, at))[1]
    try:
        got = {r.id: r.kept for r in plans.QUERIES["i02_streamed_dedup"](spark, str(tmp_path)).collect()}
    finally:
        flows.run = run
        spark.conf.set("spark.sql.files.maxPartitionBytes", parts)
    assert got == {k: k < 3 for k in range(12)} and seen[0] > 1


def test_sets_that_meet_at_crowded_terms_are_compared_in_place(spark):
    n, shared = 16_000, list(itertools.combinations(range(8), 5))
    rows = [(i, [f"own{i}-{k}" for k in range(5)] + [f"common{c}" for c in shared[i % len(shared)]]) for i in range(n)]
    rows += [(n, [*rows[0][1][:4], *rows[0][1][5:]])]  # the only one that is near another
    df = spark.createDataFrame(rows, "id bigint, terms array<string>").repartition(4)
    began = time.monotonic()
    members, links = overlap.similar_sets(df, "id", "terms", 0.4)
    assert [tuple(r) for r in links.collect()] == [(0, n, 0.9)] and members.filter("id = class_id").count() == n + 1
    assert time.monotonic() - began < 60


def test_similar_sets_in_blocks_follow_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    sets = [sorted(map(str, rng.choice(12, rng.integers(0, 8), replace=False))) for _ in range(150)]
    df = spark.createDataFrame([(i, w or None) for i, w in enumerate(sets)], "id bigint, terms array<string>")
    first = {tuple(w): i for i, w in reversed(list(enumerate(sets)))}
    for least in (0.3, 0.5, 1.0):
        members, links = overlap.similar_sets(df, "id", "terms", least, crowd=7)
        assert {tuple(r) for r in members.collect()} == {(i, first[tuple(w)]) for i, w in enumerate(sets)}
        pairs = ((i, j, len(set(a) & set(b)) / len(set(a) | set(b))) for (a, i), (b, j) in itertools.product(first.items(), repeat=2) if i < j and a and b)
        assert sorted(map(tuple, links.collect())) == sorted(p for p in pairs if p[2] >= least - 1e-9)


def test_tokens_of_a_large_vocabulary_are_hashed_once(monkeypatch):
    made, plain = [], hashlib.blake2b
    monkeypatch.setattr(hashlib, "blake2b", lambda *a, **k: (made.append(a[0]), plain(*a, **k))[1])
    texts = [" ".join(f"W{k}x Été_{k}" for k in range(at, at + 500)) for at in range(0, 50_000, 500)]
    for _ in range(3):
        got = [clean.hashed(t) for t in texts]
    assert len(made) == len(set(made)) == 100_000
    want = np.zeros(1024)
    for token in texts[7].lower().split():
        h = plain(token.encode(), digest_size=8).digest()
        want[int.from_bytes(h[:4], "big") % 1024] += 1 if h[4] & 1 else -1
    assert np.array_equal(got[7], want) and not clean.hashed(None).any() and clean.hashed("a", 7).shape == (7,)


def test_sets_that_are_all_near_are_compared_by_blocks(spark):
    n = 9_000
    df = spark.range(n, numPartitions=4).selectExpr("id", "concat(array('c0', 'c1', 'c2', 'c3', 'c4', 'c5'), array('x' || id, if(id % 2 = 0, 'even', 'y' || id))) AS terms")
    began = time.monotonic()
    _, links = overlap.similar_sets(df, "id", "terms", 0.4)
    half = n // 2
    assert {tuple(r) for r in links.groupBy("similarity").count().collect()} == {(7 / 9, half * (half - 1) // 2), (0.6, half * half + half * (half - 1) // 2)}
    assert time.monotonic() - began < 60
