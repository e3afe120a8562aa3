"""Scans, sinks, point samples and read models over the driver tables, each with the same rows as SQL."""

from __future__ import annotations

import uuid

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.functions import text as T
from causeway.operators import dedup as D
from causeway.operators.asof import as_of
from causeway.plans.registry import register
from causeway.plans.relational_queries import statement
from causeway.scratch import materialize, scratch_dir
from causeway.sources import fixtures as X
from causeway.sources import readers as R
from causeway.sources.export import digests
from causeway.sources.ledger import Ledger


@dataclass(frozen=True)
class Dialect:
    """Wordings that differ between the two engines."""

    duck: bool

    def stamp(self, x: str) -> str:
        return f"strftime({x}, '%Y-%m-%d %H:%M:%S')" if self.duck else f"date_format({x}, 'yyyy-MM-dd HH:mm:ss')"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')" if self.duck else f"regexp_like({x}, '{pattern}')"

    def at(self, text: str) -> str:
        return f"TIMESTAMP '{text}'" if self.duck else f"TIMESTAMP_NTZ '{text}'"

    def sha(self, x: str) -> str:
        return f"sha256({x})" if self.duck else f"sha2({x}, 256)"

    def json(self, column: str, path: str) -> str:
        return f"json_extract_string({column}, '{path}')" if self.duck else f"get_json_object({column}, '{path}')"

    def joined(self, value: str, order: str) -> str:
        """An aggregate: values by one comma, in order."""
        return f"string_agg({value}, ',' ORDER BY {order})" if self.duck else f"listagg({value}, ',') WITHIN GROUP (ORDER BY {order})"

    def steps(self, first: str, last: str, by: str) -> str:
        """Integers from first to last, as rows."""
        return f"unnest(range({first}, {last} + 1, {by}))" if self.duck else f"explode(sequence({first}, {last}, {by}))"

    def seconds(self, x: str) -> str:
        return f"to_seconds({x})" if self.duck else f"make_dt_interval(0, 0, 0, {x})"

    def seconds_between(self, a: str, b: str) -> str:
        return f"floor(date_diff('microsecond', {a}, {b}) / 1000000)::BIGINT" if self.duck else f"timestampdiff(SECOND, {a}, {b})"


def both(name: str, text: Callable[[Dialect], str]) -> None:
    statement(name, text(Dialect(False)), text(Dialect(True)))


# --- scans ---


@register("a02_news_scan", "SELECT doc_id AS id, 'https://n.example/' || doc_id AS url, 'n' || doc_id AS title, '2024-01-0' || (doc_id % 9 + 1) || ' 10:00:00' AS published, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'SE' ELSE 'DE' END AS country, length(text)::BIGINT AS n FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0")
def a02(spark, sf):
    k, n = F.col("doc_id"), F.concat(F.lit("n"), F.col("doc_id"))
    item = F.struct(
        k.alias("id"), F.when(k % 7 != 0, F.concat(F.lit("https://n.example/"), k)).alias("url"), F.when(k % 11 == 0, " ").otherwise(n).alias("title"),
        F.when(k % 13 == 0, "soon").otherwise(F.concat(F.lit("2024-01-0"), k % 9 + 1, F.lit("T10:00:00Z"))).alias("published"),
    )
    d = X.read(spark, sf, "documents")
    lists = d.groupBy(F.floor(k / 50)).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("payload"))
    codes = F.when(k % 5 == 0, F.array(F.lit("world"))).when(k % 2 == 0, F.array(F.lit("EUR"), F.lit("se"), F.lit("no"))).otherwise(F.array(F.lit("de")))
    details = d.select(F.to_json(F.struct(k.alias("id"), codes.alias("countries"), F.col("text").alias("body"))).alias("payload"))
    got = R.news_items(lists, details)
    return got.select("id", "url", "title", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), "country", F.length("body").cast("bigint").alias("n"))


@register("a04_charset_decode", r"SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN 0 ELSE length(text) END::BIGINT AS n, CASE WHEN doc_id % 5 = 3 THEN true ELSE false END AS refused FROM documents")
def a04(spark, sf):
    """UTF-8 with a mark, UTF-16, declared Latin-1, bytes that aren't UTF-8, plain UTF-8."""
    k, t = F.col("doc_id") % 5, F.col("text")
    data = F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "utf-8"))).when(k == 1, F.encode(t, "UTF-16")).when(k == 2, F.encode(t, "ISO-8859-1")).when(k == 3, F.concat(F.encode(t, "utf-8"), F.unhex(F.lit("FF")))).otherwise(F.encode(t, "utf-8"))
    d = X.read(spark, sf, "documents").select("doc_id", R.decoded(data, F.when(k == 2, "Latin-1").otherwise("utf-8")).alias("out"))
    return d.select("doc_id", F.coalesce(F.length("out"), F.lit(0)).cast("bigint").alias("n"), F.col("out").isNull().alias("refused"))


@register("a07_minute_scan", "WITH " + X.EVENTS + " SELECT asset_id AS symbol, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS start, min(value) AS open, count(DISTINCT value) > 1 AS conflict FROM ev WHERE factor <> 'error' AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND date_trunc('minute', ts) < TIMESTAMP '2024-01-20 00:00:00' AND date_trunc('minute', ts) + INTERVAL 1 MINUTE <= TIMESTAMP '2024-01-18 12:00:30' GROUP BY ALL")
def a07(spark, sf):
    e = X.events(spark, sf).withColumn("v", F.when(F.col("factor") != "error", F.col("value"))).withColumn("at", F.unix_seconds(F.date_trunc("minute", "ts").cast("timestamp")))
    rows = F.sort_array(F.collect_list(F.struct("at", "v")))
    p = e.groupBy("asset_id", F.floor(F.col("at") / 86400)).agg(rows.alias("r")).select(F.to_json(F.struct(F.col("asset_id").alias("symbol"), F.col("r.at").alias("at"), *[F.col("r.v").alias(c) for c in ("open", "high", "low", "close")]), {"ignoreNullFields": "false"}).alias("payload"))
    at = lambda x: F.expr(f"timestamp_ntz'{x}'")
    return R.minute_bars(p, at("2024-01-05 00:00:00"), at("2024-01-20 00:00:00"), at("2024-01-18 12:00:30")).select("symbol", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "open", "conflict")


@register("a09_quote_texts", "WITH q AS (SELECT event_id, event_id % 5 AS k, 1000 + event_id % 9000 AS whole, event_id % 100 AS part FROM events) SELECT event_id, CASE WHEN k = 4 THEN NULL ELSE whole + part / 100.0::DOUBLE END AS price, ['OPEN', 'CLOSED', 'PAUSED', 'UNKNOWN', 'OPEN'][k + 1] AS status, CASE k WHEN 0 THEN 0 WHEN 1 THEN 900 WHEN 2 THEN 30 ELSE -1 END AS delay FROM q")
def a09(spark, sf):
    k, whole = F.col("event_id") % 5, 1000 + F.col("event_id") % 9000
    part = F.lpad((F.col("event_id") % 100).cast("string"), 2, "0")
    thousands, rest = F.floor(whole / 1000).cast("string"), F.lpad((whole % 1000).cast("string"), 3, "0")
    pick = lambda *xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (k + 1).cast("int"))
    price = pick(F.concat(thousands, F.lit(" "), rest, F.lit(","), part, F.lit(" SEK")), F.concat(thousands, F.lit("."), rest, F.lit(","), part), F.concat(thousands, F.lit(","), rest, F.lit("."), part, F.lit(" USD")), F.concat(thousands, rest, F.lit("."), part), "n/a")
    status, delay = pick("Market open", "Closed for today", "Trading halted", "?", "Continuous trading"), pick("Real-time", "15 min delay", "30 s", "unknown", "")
    return X.read(spark, sf, "events").select("event_id", R.price_text(price).alias("price"), R.status_text(status).alias("status"), F.coalesce(R.delay_seconds(delay), F.lit(-1)).alias("delay"))


@register("a10_registry_faults", """WITH a AS (SELECT 'S' || (s_suppkey % 37) AS asset_id, 'G' || (s_nationkey % 7) AS group_id, CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE 'P' || (s_suppkey % 50) END AS provider_symbol, CASE WHEN s_suppkey % 9 = 2 THEN 'kr' ELSE 'SEK' END AS currency, CASE s_suppkey % 8 WHEN 1 THEN 'S' || (s_suppkey % 37) WHEN 2 THEN 'S' || (s_suppkey % 60) END AS fallback FROM supplier)
SELECT 'DUPLICATE_ASSET' AS rule, asset_id AS key FROM a GROUP BY asset_id HAVING count(*) > 1 UNION ALL SELECT 'SEVERAL_GROUPS', asset_id FROM a GROUP BY asset_id HAVING count(DISTINCT group_id) > 1 UNION ALL SELECT 'SHARED_SYMBOL', provider_symbol FROM a WHERE provider_symbol IS NOT NULL GROUP BY provider_symbol HAVING count(DISTINCT asset_id) > 1
UNION ALL SELECT 'NO_SYMBOL', asset_id FROM a WHERE provider_symbol IS NULL UNION ALL SELECT 'BAD_CURRENCY', asset_id FROM a WHERE NOT regexp_matches(currency, '^[A-Z]{3}$') UNION ALL SELECT 'OWN_FALLBACK', asset_id FROM a WHERE fallback = asset_id UNION ALL SELECT 'UNKNOWN_FALLBACK', asset_id FROM a WHERE fallback NOT IN (SELECT asset_id FROM a)""")
def a10(spark, sf):
    k = F.col("s_suppkey")
    s = lambda n: F.concat(F.lit("S"), k % n)
    a = X.read(spark, sf, "supplier").select(
        s(37).alias("asset_id"), F.concat(F.lit("G"), F.col("s_nationkey") % 7).alias("group_id"), F.when(k % 10 != 3, F.concat(F.lit("P"), k % 50)).alias("provider_symbol"),
        F.when(k % 9 == 2, "kr").otherwise("SEK").alias("currency"), F.when(k % 8 == 1, s(37)).when(k % 8 == 2, s(60)).alias("fallback"),
    )
    return R.registry_faults(a)


MAPPING = """(SELECT concat('A', cast(s_suppkey % 40 AS string)) AS asset_id, CASE WHEN s_suppkey % 6 = 0 THEN 'kr' ELSE 'SEK' END AS currency,
  concat(CASE WHEN s_suppkey % 5 = 0 THEN 'http' ELSE 'https' END, '://q.example/listing/', cast(s_suppkey AS string)) AS url FROM {supplier})"""
CANONICAL = """concat(chr(123), '"asset_id":"', m.asset_id, '","currency":"', m.currency, '","url":"', m.url, '"', chr(125))"""
both("a12_mapping_hash", lambda d: f"""SELECT m.url, {d.matches("m.url", "^https://[a-z.]+/[a-z0-9/-]+$")} AND {d.matches("m.currency", "^[A-Z][A-Z][A-Z]$")} AND k.asset_id IS NOT NULL AS valid, {d.sha(CANONICAL)} AS mapping_hash
  FROM {MAPPING} m LEFT JOIN {{members}} k ON k.asset_id = m.asset_id""")


@register("a13_consumer", "SELECT event_id, CASE WHEN event_id % 17 = 0 OR json_extract_string(props, '$.k') IS NULL THEN 'POISON' WHEN event_id % 5 = 0 AND event_id % 4 < 3 THEN 'RETRY' WHEN event_id % 5 = 0 THEN 'DEAD' ELSE 'ACK' END AS outcome, CASE WHEN event_id % 17 <> 0 THEN json_extract_string(props, '$.k')::INT ELSE -1 END AS k FROM events")
def a13(spark, sf):
    """Unreadable messages go to quarantine at once, failing ones after three attempts."""
    e = X.read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 17 == 0, F.expr("left(props, 3)")).otherwise(F.col("props")).alias("payload"), (F.col("event_id") % 4).alias("attempts"), (F.col("event_id") % 5 == 0).alias("failing"))
    return D.consumed(e, "payload", "k int", F.col("failing")).select("event_id", "outcome", F.coalesce("message.k", F.lit(-1)).alias("k"))


@register("a14_graph_scan", "WITH " + X.CAUSES + ", " + X.MEMBERS + ", " + X.CORRELATIONS + " SELECT 'CAUSES' AS kind, factor AS source, target, coalesce(condition, '-') AS condition, weight FROM causes UNION ALL SELECT 'MEMBER_OF', asset_id, group_id, '-', NULL FROM members UNION ALL SELECT 'CORRELATES_WITH', source, target, condition, weight FROM correlations WHERE target IN (SELECT asset_id FROM members)")
def a14(spark, sf):
    """Nodes and edges written as seed files and scanned again; edges whose ends aren't nodes are refused."""
    t, path = X.edge_tables(spark, sf), f"{scratch_dir(spark)}/causeway-graph-seed-{uuid.uuid4().hex}"
    c, m, r = t["causes"], t["members"], t["correlations"]
    node = lambda df, col, label: df.select(F.col(col).alias("id"), F.lit(label).alias("label"))
    nodes = node(m, "asset_id", "Asset").union(node(m, "group_id", "AssetGroup")).union(node(c, "factor", "CausalFactor")).distinct()
    edges = c.withColumnRenamed("factor", "source").withColumn("kind", F.lit("CAUSES")).unionByName(m.select(F.lit("MEMBER_OF").alias("kind"), F.col("asset_id").alias("source"), F.col("group_id").alias("target")), allowMissingColumns=True).unionByName(r.withColumn("kind", F.lit("CORRELATES_WITH")))
    R.save_graph(nodes, edges, path)
    known, got = R.graph(spark, path)
    ends = lambda col: known.select(F.col("id").alias(col))
    return got.join(ends("source"), "source", "left_semi").join(ends("target"), "target", "left_semi").select("kind", "source", "target", F.coalesce("condition", F.lit("-")).alias("condition"), "weight")


@register("a16_corpus_files", "SELECT doc_id, lang, length(text)::BIGINT AS n FROM documents")
def a16(spark, sf):
    """Saved as sorted JSON lines, whole or not at all, and loaded again."""
    path = f"{scratch_dir(spark)}/causeway-corpus-{uuid.uuid4().hex}"
    R.save_corpus(X.read(spark, sf, "documents").select("doc_id", "lang", "text"), path, "doc_id")
    return R.load_corpus(spark, path, "doc_id bigint, lang string, text string").select("doc_id", "lang", F.length("text").cast("bigint").alias("n"))


@register("a18_feed_dates", "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 5 = 1 THEN '2024-01-0' || (doc_id % 9 + 1) || ' 08:00:00' ELSE '2024-01-0' || (doc_id % 9 + 1) || ' 10:00:00' END AS published FROM documents")
def a18(spark, sf):
    k = F.col("doc_id")
    day = F.concat(F.lit("0"), k % 9 + 1)
    pick = F.element_at(F.array(F.concat(F.lit("Mon, "), day, F.lit(" Jan 2024 10:00:00 +0000")), F.concat(F.lit("2024-01-"), day, F.lit("T10:00:00+02:00")), F.concat(F.lit("2024-01-"), day, F.lit("T10:00:00Z")), F.concat(F.lit("2024-01-"), day, F.lit(" 10:00:00")), F.lit("yesterday")), (k % 5 + 1).cast("int"))
    return X.read(spark, sf, "documents").select("doc_id", F.date_format(R.parsed_date(pick), "yyyy-MM-dd HH:mm:ss").alias("published"))


# --- sinks ---


@register("b05_state_and_outbox", "WITH k AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P') SELECT 'state' AS kind, sha256('state|' || o_orderkey) AS key, o_orderstatus AS value FROM k UNION ALL SELECT 'outbox', sha256('outbox|' || o_orderkey), 'PENDING' FROM k WHERE o_orderstatus = 'F'")
def b05(spark, sf):
    """A batch of states with the messages they call for, in one transaction; the same batch again adds nothing."""
    o = X.read(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    row = lambda df, kind, value: df.select(F.lit(kind).alias("kind"), F.sha2(F.concat(F.lit(kind + "|"), F.col("o_orderkey")), 256).alias("key"), value.alias("value"))
    batch = {"state": row(o, "state", F.col("o_orderstatus")), "outbox": row(o.filter("o_orderstatus = 'F'"), "outbox", F.lit("PENDING"))}
    ledger = Ledger(spark, f"{scratch_dir(spark)}/causeway-ledger-{uuid.uuid4().hex}", dict.fromkeys(batch, "kind string, key string, value string"))
    for _ in range(2):
        ledger.commit("orders", batch)
    return ledger.table("state").unionByName(ledger.table("outbox"))


both("b06_outbox_relay", lambda d: """SELECT o_orderkey, CASE WHEN place IS NULL THEN 'WAITING' WHEN o_orderkey % 9 = 4 THEN 'PENDING' ELSE 'DELIVERED' END AS status, CASE WHEN place IS NOT NULL THEN 1 ELSE 0 END AS attempts
  FROM {orders} o LEFT JOIN (SELECT o_orderkey AS id, 1 AS place FROM {orders} WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 100) c ON o.o_orderkey = c.id WHERE o_orderstatus = 'P'""")
both("b07_typed_dispatch", lambda d: f"""SELECT event_id, event_type, CASE WHEN event_type = 'purchase' THEN cast({d.json("payload", "$.amount")} AS double) END AS amount, CASE WHEN event_type = 'error' THEN cast({d.json("payload", "$.code")} AS int) ELSE -1 END AS code, event_type NOT IN ('purchase', 'error') AS unknown
  FROM (SELECT event_id, event_type, CASE event_type WHEN 'purchase' THEN concat(chr(123), '"amount":', cast(event_id % 500 AS string), '.5', chr(125)) WHEN 'error' THEN concat(chr(123), '"code":', cast(event_id % 40 AS string), chr(125)) END AS payload FROM {{events}}) t""")
both("b08_retention", lambda d: f"""SELECT 'article' AS kind, article_id AS id FROM {{articles}} WHERE published_at >= {d.at("2024-01-31 00:00:00")} - INTERVAL 30 DAY
  UNION ALL SELECT 'outbox', o_orderkey FROM {{orders}} WHERE NOT (o_orderstatus = 'F' AND o_orderdate < {d.at("2001-06-01 00:00:00")} - INTERVAL 7 DAY)""")
@register("b09_export_manifest", """WITH a AS (SELECT lang, doc_id, sha256(doc_id || '|' || text) AS h FROM documents),
b AS (SELECT lang, doc_id // 1000 AS part, sha256(string_agg(h, '' ORDER BY doc_id)) AS h, count(*) AS n FROM a GROUP BY ALL), c AS (SELECT lang, b.part // 1000 AS part, sha256(string_agg(h, '' ORDER BY b.part)) AS h, sum(n) AS n FROM b GROUP BY lang, b.part // 1000),
d AS (SELECT lang, c.part // 1000 AS part, sha256(string_agg(h, '' ORDER BY c.part)) AS h, sum(n) AS n FROM c GROUP BY lang, c.part // 1000) SELECT lang, sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY part)) AS digest FROM d GROUP BY lang""")
def b09(spark, sf):
    """Rows and one digest of each language's texts in the order of their ids, from a tree of hashes."""
    return digests(X.read(spark, sf, "documents"), ["lang"], "doc_id", F.concat_ws("|", F.col("doc_id").cast("string"), "text"))


# --- predicates over samples ---
ELIGIBLE = """currency = 'SEK' AND quote_unit = 'UNIT' AND mapping_version = 'm1' AND registry_version = 'r1' AND kind = 'LAST' AND market_state = 'OPEN' AND quality = 'FRESH' AND price > 0
  AND observed_at >= opens_at AND observed_at < closes_at AND provider_quote_at >= observed_at - INTERVAL 2 MINUTE"""
both("c07_sample_eligibility", lambda d: f"SELECT sample_id FROM {{samples}} s WHERE {ELIGIBLE} AND EXISTS (SELECT 1 FROM {{members}} m WHERE m.asset_id = s.asset_id)")
both("c08_sample_batches", lambda d: f"""SELECT asset_id, cast(session AS string) AS session, CASE WHEN currencies > 1 OR mappings > 1 THEN 'MIXED_IDENTITY' WHEN misaligned > 0 THEN 'MISALIGNED' WHEN late > 0 THEN 'LATE' WHEN n > slots THEN 'DUPLICATE_SLOT' ELSE 'OK' END AS verdict FROM (
  SELECT asset_id, session, count(DISTINCT currency) AS currencies, count(DISTINCT mapping_version) AS mappings, count(*) FILTER (WHERE (minute(scheduled_at) * 60 + second(scheduled_at)) % interval_seconds <> 0) AS misaligned,
    count(*) FILTER (WHERE observed_at > scheduled_at + INTERVAL 8 MINUTE) AS late, count(*) AS n, count(DISTINCT scheduled_at) AS slots FROM {{samples}} GROUP BY asset_id, session) t""")
both("c10_batch_validator", lambda d: f"""SELECT asset_id, cast(day AS string) AS day, CASE WHEN bounds > 0 THEN 'BOUNDS' WHEN sources > 1 THEN 'MIXED_PROVENANCE' WHEN n > starts THEN 'DUPLICATE_START' WHEN final AND last_start < close_at THEN 'FINAL_BEFORE_CLOSE' ELSE 'OK' END AS verdict FROM (
  SELECT asset_id, day, count(*) FILTER (WHERE high < open OR high < low OR low > open) AS bounds, count(DISTINCT source) AS sources, count(*) AS n, count(DISTINCT start) AS starts, max(k) % 2 = 0 AS final, max(start) AS last_start, max(date_trunc('day', start)) + INTERVAL 22 HOUR AS close_at FROM (
    SELECT asset_id, cast(ts AS date) AS day, date_trunc('minute', ts) AS start, event_id AS k, value AS open, value + event_id % 11 - 0.01 * CASE WHEN event_id % 97 = 0 THEN 100 ELSE 0 END AS high, value - event_id % 5 AS low, CASE WHEN event_id % 53 = 0 THEN 'b' ELSE 'a' END AS source FROM {{ev}}) b GROUP BY asset_id, day) t""")
both("c13_numeric_validity", lambda d: f"""SELECT event_id, lower(raw) NOT IN ('true', 'false') AND x IS NOT NULL AND NOT isnan(x) AND x > 0 AND x < 1e308 AS valid FROM (SELECT event_id, raw, try_cast(raw AS double) AS x FROM (
  SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN 'abc' WHEN 2 THEN 'NaN' WHEN 3 THEN '-1.5' WHEN 4 THEN '0' WHEN 5 THEN 'Infinity' ELSE cast(event_id AS string) END AS raw FROM {{ev}}) r) t""")

# --- joins over samples and sessions ---
@register("d16_session_as_of", "WITH " + X.CLOSES + " SELECT e.event_id, max(CASE WHEN c.done <= e.ts THEN c.session END)::VARCHAR AS baseline, min(CASE WHEN c.done > e.ts THEN c.session END)::VARCHAR AS settlement FROM ev e JOIN (SELECT asset_id, session, session::TIMESTAMP + INTERVAL 16 HOUR AS done FROM closes) c ON c.asset_id = e.asset_id GROUP BY e.event_id")
def d16(spark, sf):
    """The last session that is over at an event, and the one after it; before all of them, the first is next."""
    c = X.closes(spark, sf).select("asset_id", "session")
    marks = c.withColumn("following", F.lead("session").over(Window.partitionBy("asset_id").orderBy("session"))).withColumn("ts", F.col("session").cast("timestamp_ntz") + F.expr("interval 16 hours"))
    got = as_of(X.events(spark, sf).select("asset_id", "ts", "event_id"), marks, ["asset_id"], "ts", ["session", "following"])
    first = c.groupBy("asset_id").agg(F.min("session").alias("first"))
    out = got.join(first, "asset_id")
    return out.select("event_id", F.col("session").cast("string").alias("baseline"), F.when(F.col("session").isNull(), F.col("first")).otherwise(F.col("following")).cast("string").alias("settlement"))


both("d19_interval_join", lambda d: f"""SELECT j.asset_id, {d.stamp("j.opens_at")} AS opens_at, count(s.sample_id) AS evidence, min(s.sample_id) AS first_sample FROM (SELECT DISTINCT asset_id, session, opens_at + {d.seconds("h * 3600")} AS opens_at FROM {{samples}} CROSS JOIN (SELECT {d.steps("0", "7", "1")} AS h) hours) j
  LEFT JOIN {{samples}} s ON s.asset_id = j.asset_id AND s.session = j.session AND s.observed_at >= j.opens_at AND s.observed_at < j.opens_at + INTERVAL 1 HOUR AND s.received_at <= j.opens_at + INTERVAL 1 HOUR + INTERVAL 2 MINUTE GROUP BY j.asset_id, j.opens_at""")
both("d19_following_events", lambda d: """SELECT event_id, count(*) OVER (PARTITION BY asset_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 30 MINUTE FOLLOWING) AS n FROM {ev}""")
both("d27_paired_methods", lambda d: """SELECT asset_id, count(*) AS contexts, count(*) FILTER (WHERE a <> actual AND b = actual) AS corrected, count(*) FILTER (WHERE a = actual AND b <> actual) AS harmed FROM (
  SELECT asset_id, window_start, actual, max(CASE WHEN method = 'graph' THEN verdict END) AS a, max(CASE WHEN method = 'rule' THEN verdict END) AS b FROM (
    SELECT asset_id, window_start, actual, 'graph' AS method, direction AS verdict FROM {sc} WHERE actual IS NOT NULL UNION ALL SELECT asset_id, window_start, actual, 'rule', CASE WHEN confidence > 0.5 THEN direction ELSE 'NEUTRAL' END FROM {sc} WHERE actual IS NOT NULL) m
  GROUP BY asset_id, window_start, actual) t GROUP BY asset_id""")

# --- aggregates ---
both("e02_accuracy_by_type", lambda d: """SELECT event_type, count(*) AS n, round(avg(cast(CASE WHEN s.direction = s.actual THEN 1 ELSE 0 END AS double)), 4) AS accuracy FROM {sc} s JOIN (SELECT asset_id, date_trunc('minute', ts) - make_interval_minutes AS window_start, min_by(factor, event_id) AS event_type FROM (SELECT *, INTERVAL 1 MINUTE * (minute(ts) % 15) AS make_interval_minutes FROM {ev}) e GROUP BY 1, 2) f
  ON f.asset_id = s.asset_id AND f.window_start = s.window_start WHERE s.actual IS NOT NULL GROUP BY event_type""")
both("e18_source_credit", lambda d: """SELECT cluster, source, cast(1 AS double) / count(*) OVER (PARTITION BY cluster) AS credit FROM (SELECT DISTINCT concat(language, cast(article_id % 40 AS string)) AS cluster, lower(trim(source_id)) AS source FROM {articles}) t""")
both("e22_session_ohlc", lambda d: """SELECT asset_id, cast(session AS string) AS session, min_by(price, observed_at) AS open, max(price) AS high, min(price) AS low, max_by(price, observed_at) AS close, count(DISTINCT scheduled_at) AS slots, count(DISTINCT scheduled_at) = 48 AS complete FROM {samples} WHERE quality = 'FRESH' GROUP BY asset_id, session""")
both("e26_baseline_gate", lambda d: """SELECT n, base_n, concat_ws(',', CASE WHEN n < 0.25 * base_n THEN 'VOLUME' END, CASE WHEN share < 0.6 THEN 'JUSTIFIED' END, CASE WHEN share < base_share THEN 'REGRESSION' END) AS reasons FROM (
  SELECT count(*) FILTER (WHERE doc_id % 2 = 1) AS n, count(*) FILTER (WHERE doc_id % 2 = 0) AS base_n, avg(CASE WHEN doc_id % 2 = 1 THEN quality END) AS share, avg(CASE WHEN doc_id % 2 = 0 THEN quality END) AS base_share FROM {labels}) t""")
CLASSES = "(SELECT l.doc_id, l.quality AS actual, CASE WHEN length(d.text) > 400 AND position('###' IN d.text) = 0 THEN 1 ELSE 0 END AS expected, d.lang FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id)"
both("e27_class_metrics", lambda d: f"""SELECT lang, class, precision_, recall, f1, avg(f1) OVER (PARTITION BY lang) AS macro_f1, accuracy FROM (SELECT lang, class, tp / nullif(predicted, 0) AS precision_, tp / nullif(support, 0) AS recall, CASE WHEN predicted + support = 0 THEN cast(0 AS double) ELSE round(2 * tp / (predicted + support), 9) END AS f1, accuracy FROM (
  SELECT coalesce(lang, 'all') AS lang, class, cast(count(*) FILTER (WHERE actual = class AND expected = class) AS double) AS tp, count(*) FILTER (WHERE expected = class) AS predicted, count(*) FILTER (WHERE actual = class) AS support, avg(cast(CASE WHEN actual = expected THEN 1 ELSE 0 END AS double)) AS accuracy
  FROM {CLASSES} t CROSS JOIN (SELECT {d.steps("0", "1", "1")} AS class) c GROUP BY GROUPING SETS ((lang, class), (class))) g) h""")
both("e28_balanced_metrics", lambda d: f"""SELECT support0, support1, round((r0 + r1) / 2, 9) AS balanced, round((2 * t1 / nullif(p1 + support1, 0) + 2 * t0 / nullif(p0 + support0, 0)) / 2, 9) AS macro_f1, round(brier, 9) AS brier FROM (
  SELECT count(*) FILTER (WHERE actual = 0) AS support0, count(*) FILTER (WHERE actual = 1) AS support1, cast(count(*) FILTER (WHERE actual = 1 AND expected = 1) AS double) AS t1, cast(count(*) FILTER (WHERE actual = 0 AND expected = 0) AS double) AS t0, count(*) FILTER (WHERE expected = 1) AS p1, count(*) FILTER (WHERE expected = 0) AS p0,
    avg(CASE WHEN actual = 0 THEN cast(1 - expected AS double) END) AS r0, avg(CASE WHEN actual = 1 THEN cast(expected AS double) END) AS r1, avg(cast((0.2 + 0.6 * expected - actual) * (0.2 + 0.6 * expected - actual) AS double)) AS brier FROM {CLASSES} t) m""")
both("e29_paired_net", lambda d: """SELECT corrected, harmed, corrected - harmed AS net, CASE WHEN corrected + harmed < 10 THEN 'STOP' WHEN corrected > harmed THEN 'PASS' ELSE 'REVISE' END AS verdict FROM (
  SELECT count(*) FILTER (WHERE direction <> actual AND rule = actual) AS corrected, count(*) FILTER (WHERE direction = actual AND rule <> actual) AS harmed FROM (SELECT direction, actual, CASE WHEN magnitude = 'LARGE' THEN direction ELSE 'UP' END AS rule FROM {sc} WHERE actual IS NOT NULL) p) t""")
both("e30_learning_replay", lambda d: """SELECT asset_id, 1 + count(*) FILTER (WHERE correct) AS alpha, 1 + count(*) FILTER (WHERE NOT correct) AS beta FROM (SELECT asset_id, window_start, max(direction) = max(actual) AS correct FROM (SELECT asset_id, window_start, direction, actual FROM {sc} WHERE actual IS NOT NULL UNION ALL SELECT asset_id, window_start, direction, actual FROM {sc} WHERE actual IS NOT NULL AND confidence > 0.5) twice GROUP BY asset_id, window_start) t GROUP BY asset_id""")

# --- windows ---
both("f09_largest_gap", lambda d: f"""SELECT asset_id, cast(session AS string) AS session, max(gap) AS gap FROM (SELECT asset_id, session, {d.seconds_between("coalesce(lag(observed_at) OVER w, opens_at)", "observed_at")} AS gap FROM {{samples}} WINDOW w AS (PARTITION BY asset_id, session ORDER BY observed_at, sample_id)
  UNION ALL SELECT asset_id, session, {d.seconds_between("max(observed_at)", "max(closes_at)")} FROM {{samples}} GROUP BY asset_id, session) t GROUP BY asset_id, session""")
both("f14_top_k_claim", lambda d: f"""SELECT asset_id, {d.stamp("deadline")} AS deadline, state FROM (SELECT asset_id, max(ts) + INTERVAL 30 MINUTE AS deadline, CASE WHEN max(event_id) % 4 = 0 THEN 'ERROR' WHEN max(event_id) % 2 = 0 THEN 'QUIET' ELSE 'OPEN' END AS state FROM {{ev}} GROUP BY asset_id, factor) c WHERE state IN ('OPEN', 'QUIET') AND deadline <= {d.at("2024-01-30 12:00:00")} ORDER BY deadline, asset_id, state LIMIT 20""")
both("f16_pagination", lambda d: "SELECT o_orderkey, (SELECT count(*) FROM {orders} WHERE o_orderstatus = 'O') AS total FROM {orders} WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
both("f18_slot_grid", lambda d: f"""SELECT asset_id, {d.stamp(f"opens_at + {d.seconds('slot')}")} AS slot_at, kind FROM (SELECT asset_id, opens_at, {d.steps("0", "28200", "600")} AS slot, 'SAMPLE' AS kind FROM (SELECT DISTINCT asset_id, opens_at FROM {{samples}}) a UNION ALL SELECT asset_id, opens_at, 28800 + CASE k WHEN 0 THEN 0 WHEN 1 THEN 120 ELSE 300 END, 'CLOSE_CHECK' FROM (SELECT DISTINCT asset_id, opens_at FROM {{samples}}) b CROSS JOIN (SELECT {d.steps("0", "2", "1")} AS k) checks) t""")
