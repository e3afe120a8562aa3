"""Relational, window, storage, intraday and report queries. Most are one declarative statement that both engines read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import dedup as D
from causeway.operators import intraday as I
from causeway.plans import graph_queries as GQ
from causeway.plans.registry import register
from causeway.sources import fixtures as X

TABLES = "region nation customer supplier part orders lineitem documents pages embeddings labels benchmark conversations".split()
ENTITIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "ev": (X.events, X.EVENTS),
    "articles": (X.articles, X.ARTICLES),
    "closes": (X.closes, X.CLOSES.removeprefix(X.EVENTS + ", ")),
    "samples": (X.samples, X.SAMPLES),
    "causes": (lambda s, d: X.edge_tables(s, d)["causes"], X.CAUSES),
    "members": (lambda s, d: X.edge_tables(s, d)["members"], X.MEMBERS),
    "decided": (GQ.decided, ""),
    "sc": (GQ.scored, ""),
}


def statement(name: str, text: str, duck: str | None = None) -> None:
    """Registers one statement; ``{x}`` stands for an entity or a driver table, ``duck`` for the other engine's wording."""
    used = list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))
    ours = [x for x in used if x in ENTITIES]
    if {"decided", "sc"} & set(ours):
        head = GQ.SCORED if "sc" in ours else GQ.CHAIN
        rest = [ENTITIES[x][1] for x in ours if x in ("articles",)]
        head = ", ".join([head, *rest]) + " "
    else:
        parts = [ENTITIES[x][1] for x in ours]
        if {"closes", "samples"} & set(ours) and "ev" not in ours:
            parts.insert(0, X.EVENTS)
        parts.sort(key=lambda p: not p.startswith("ev AS"))
        head = "WITH " + ", ".join(parts) + " " if parts else ""
    body = re.sub(r"\{(\w+)\}", r"\1", duck or text)

    @register(name, head + body)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {x: ENTITIES[x][0](spark, sf_dir) if x in ENTITIES else X.read(spark, sf_dir, x) for x in used}
        return spark.sql(text, **frames)


# --- joins ---
statement("d01_order_items", "SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
statement("d03_multi_left", "SELECT count(*) AS n, count(o_orderkey) AS with_order, count(c_custkey) AS with_customer FROM {lineitem} LEFT JOIN {orders} ON l_orderkey = o_orderkey AND o_orderstatus = 'F' LEFT JOIN {customer} ON o_custkey = c_custkey AND c_acctbal > 0")
statement("d04_lineage", "SELECT DISTINCT r_name, n_name, c_mktsegment, o_orderstatus FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey")
statement("d05_gap_anti", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")
statement("d06_baseline_and_settlement", "SELECT s.asset_id, s.baseline, s.settlement, b.close AS base_close, e.close AS end_close FROM (SELECT DISTINCT asset_id, baseline, settlement FROM {sc}) s LEFT JOIN {closes} b ON b.asset_id = s.asset_id AND b.session = s.baseline LEFT JOIN {closes} e ON e.asset_id = s.asset_id AND e.session = s.settlement".replace("s.baseline, s.settlement, b", "cast(s.baseline AS string) AS baseline, cast(s.settlement AS string) AS settlement, b"), "SELECT s.asset_id, s.baseline::VARCHAR AS baseline, s.settlement::VARCHAR AS settlement, b.close AS base_close, e.close AS end_close FROM (SELECT DISTINCT asset_id, baseline, settlement FROM sc) s LEFT JOIN closes b ON b.asset_id = s.asset_id AND b.session = s.baseline LEFT JOIN closes e ON e.asset_id = s.asset_id AND e.session = s.settlement")

@register("d07_using", "SELECT n_name, count(*) AS n FROM (SELECT c_nationkey AS k, c_custkey FROM customer) a JOIN (SELECT n_nationkey AS k, n_name FROM nation) b USING (k) JOIN (SELECT s_nationkey AS k FROM supplier) d USING (k) GROUP BY n_name")
def d07(spark, sf):
    """Pairs of a customer and a supplier of the same nation are counted, not made: each side is counted by nation first."""
    count = lambda table, key: X.read(spark, sf, table).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias(f"n_{table}"))
    nations = X.read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    both = nations.join(count("customer", "c_nationkey"), "k").join(count("supplier", "s_nationkey"), "k")
    return both.groupBy("n_name").agg(F.sum(F.col("n_customer") * F.col("n_supplier")).alias("n"))


@register("d09_latest_lateral", "SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders x WHERE x.o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC, o_totalprice DESC LIMIT 1) o ON true")
def d09(spark, sf):
    """The latest order is picked by an aggregation: a lateral join sorts all orders, and the shuffle that follows may lose that order."""
    latest = X.read(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("o"))
    customers = X.read(spark, sf, "customer")
    return customers.join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o.o_orderkey", "o.o_totalprice")


statement("d17_arithmetic_as_of", "SELECT event_id, cast(date_sub(cast(ts AS date), CASE weekday(ts) WHEN 5 THEN 1 WHEN 6 THEN 2 ELSE 0 END) AS string) AS session FROM {ev}", "SELECT event_id, (ts::DATE - CASE isodow(ts) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END)::DATE::VARCHAR AS session FROM ev")
statement("d21_mixed", "SELECT a.source_id, count(*) AS n, count(l.doc_id) AS labelled FROM {articles} a JOIN {documents} d ON a.article_id = d.doc_id LEFT JOIN {labels} l ON l.doc_id = a.article_id GROUP BY a.source_id")
statement("d22_headlines", "SELECT source_id, title FROM (SELECT source_id, title, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, article_id DESC) AS k FROM {articles}) t WHERE k <= 3")
statement("d23_point_in_time", "SELECT count(*) AS n FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND l.l_shipdate < TIMESTAMP '1998-06-01 00:00:00' AND l.l_shipdate >= o.o_orderdate", "SELECT count(*)::BIGINT AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND l.l_shipdate < TIMESTAMP '1998-06-01 00:00:00' AND l.l_shipdate >= o.o_orderdate")
statement("d24_update_from", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM {documents} d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM {labels} GROUP BY doc_id) l ON d.doc_id = l.doc_id")
statement("d26_label_join", "SELECT coalesce(d.doc_id, l.doc_id) AS ref, d.doc_id IS NULL AS extra, l.doc_id IS NULL AS missing FROM {documents} d FULL OUTER JOIN {labels} l ON d.doc_id = l.doc_id")

# --- aggregations ---
statement("e05_gap_summary", "SELECT count(*) AS n, count(l.doc_id) AS with_label, count(*) FILTER (WHERE l.toxic = 1) AS toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
statement("e06_cohort_json", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE cast(get_json_object(props, '$.k') AS int) > 50) AS high FROM {events_raw} GROUP BY event_type".replace("{events_raw}", "{events}"), "SELECT event_type, count(*)::BIGINT AS n, (count(*) FILTER (json_extract_string(props, '$.k')::INT > 50))::BIGINT AS high FROM events GROUP BY event_type")
statement("e07_state_counts", "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus")
statement("e08_local_day", "SELECT cast(to_date(from_utc_timestamp(ts, 'America/New_York')) AS string) AS day, asset_id, count(*) AS n FROM {ev} GROUP BY 1, 2", "SELECT timezone('America/New_York', timezone('UTC', ts))::DATE::VARCHAR AS day, asset_id, count(*)::BIGINT AS n FROM ev GROUP BY ALL")
statement("e09_majority", "SELECT asset_id, tag FROM (SELECT asset_id, tag, row_number() OVER (PARTITION BY asset_id ORDER BY count(*) DESC, min(event_id)) AS k FROM {ev} GROUP BY asset_id, tag) t WHERE k = 1")
statement("e10_first_seen_union", "SELECT asset_id, array_join(transform(array_sort(collect_list(struct(first_id, factor))), x -> x.factor), ',') AS factors FROM (SELECT asset_id, factor, min(event_id) AS first_id FROM {ev} GROUP BY asset_id, factor) t GROUP BY asset_id", "SELECT asset_id, string_agg(factor, ',' ORDER BY first_id) AS factors FROM (SELECT asset_id, factor, min(event_id) AS first_id FROM ev GROUP BY asset_id, factor) t GROUP BY asset_id")
statement("e11_conflicts", "SELECT asset_id, cast(ts AS date) = DATE '2024-01-10' AS that_day, count(DISTINCT polarity) > 1 AS conflict FROM {ev} GROUP BY 1, 2")
statement("e12_strict_majority", "SELECT asset_id, CASE WHEN count(*) FILTER (WHERE polarity = 'RESOLUTION') > count(*) FILTER (WHERE polarity <> 'RESOLUTION') THEN 'RESOLUTION' ELSE 'OCCURRENCE' END AS polarity FROM {ev} GROUP BY asset_id")
statement("e24_audit_metrics", "SELECT count(*) AS n, count(DISTINCT asset_id) AS assets, count(*) FILTER (WHERE n_edges = 1) AS single, (SELECT count(*) FROM (SELECT asset_id FROM {decided} WHERE direction <> 'NEUTRAL' GROUP BY asset_id HAVING count(DISTINCT direction) > 1) c) AS conflicted FROM {decided}")
statement("e25_hit_rate_by_verdict", "SELECT CASE quality WHEN 1 THEN 'justified' ELSE 'unjustified' END AS verdict, sum(toxic) * 1.0D / nullif(count(*), 0) AS rate FROM {labels} GROUP BY quality", "SELECT CASE quality WHEN 1 THEN 'justified' ELSE 'unjustified' END AS verdict, sum(toxic)::DOUBLE / nullif(count(*), 0) AS rate FROM labels GROUP BY quality")
statement("e31_low_credibility", "SELECT s_suppkey, round(s_acctbal, 2) AS balance FROM {supplier} WHERE s_acctbal < 0 ORDER BY balance, s_suppkey")
statement("e32_value_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus")

# --- filters ---
statement("c01_projection", "SELECT event_id, asset_id AS subject, factor AS action FROM {ev}")
statement("c03_rolling_window", "SELECT article_id FROM {articles} WHERE published_at >= TIMESTAMP_NTZ '2024-01-01 06:00:00' AND language = 'en'", "SELECT article_id FROM articles WHERE published_at >= TIMESTAMP '2024-01-01 06:00:00' AND language = 'en'")
statement("c04_optional_bounds", "SELECT event_id FROM {ev} WHERE (NULL IS NULL OR value > 1e9) AND (50.0 IS NULL OR value < 50.0)")
statement("c05_membership", "SELECT asset_id, window_start IS NOT NULL AS ok, direction FROM {decided} WHERE asset_id IN ('A1', 'A2', 'A3')")
statement("c09_first_mismatch", "SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'NO_ORDER' WHEN l_shipdate < o_orderdate THEN 'EARLY' WHEN l_discount > 0.08 THEN 'DISCOUNT' END AS reason FROM {lineitem} LEFT JOIN {orders} ON l_orderkey = o_orderkey")
statement("c12_status_filter", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus IS NULL OR o_orderstatus <> 'F'")
statement("c14_json_predicate", "SELECT event_id FROM {events} WHERE cast(get_json_object(props, '$.k') AS int) % 7 = 0", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::INT % 7 = 0")
statement("x31_recipients", "SELECT c_custkey FROM (SELECT c_custkey, concat('+4', lpad(cast(c_custkey AS string), 8, '0')) AS phone FROM {customer}) t WHERE phone RLIKE '^[+][1-9][0-9]+$' AND length(phone) BETWEEN 9 AND 16", "SELECT c_custkey FROM (SELECT c_custkey, '+4' || lpad(c_custkey::VARCHAR, 8, '0') AS phone FROM customer) t WHERE regexp_matches(phone, '^[+][1-9][0-9]+$') AND length(phone) BETWEEN 9 AND 16")

# --- windows ---
statement("f02_hourly", "SELECT date_format(date_trunc('hour', ts), 'yyyy-MM-dd HH:mm:ss') AS hour, count(*) AS n FROM {ev} GROUP BY 1", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*)::BIGINT AS n FROM ev GROUP BY 1")
statement("f03_ready_windows", "SELECT asset_id, count(*) AS n FROM {decided} WHERE window_start + INTERVAL 20 MINUTE <= TIMESTAMP_NTZ '2024-01-15 00:00:00' GROUP BY asset_id", "SELECT asset_id, count(*)::BIGINT AS n FROM decided WHERE window_start + INTERVAL 20 MINUTE <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY asset_id")
statement("f06_latest_stance", "SELECT asset_id, max_by(direction, window_start) AS direction FROM {sc} WHERE actual IS NULL GROUP BY asset_id")
statement("f10_first_hit", "SELECT asset_id, min(event_id) FILTER (WHERE value > 90) AS first_hit FROM {ev} GROUP BY asset_id")
statement("f11_first_last", "SELECT asset_id, min_by(value, event_id) AS first_value, max_by(value, event_id) AS last_value FROM {ev} GROUP BY asset_id")
statement("f15_top_assets", "SELECT asset_id, count(*) AS n FROM {ev} GROUP BY asset_id ORDER BY n DESC, asset_id LIMIT 10")
statement("f19_ordered_output", "SELECT factor, coalesce(condition, '') AS condition, target FROM {causes} ORDER BY factor, coalesce(condition, ''), target")
statement("a19_recent_closes", "SELECT asset_id, cast(session AS string) AS session, close FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY session DESC) AS k FROM {closes}) t WHERE k <= least(greatest(5, 1), 250)")
statement("a20_keyset_page", "SELECT event_id FROM {ev} WHERE ts < TIMESTAMP_NTZ '2024-01-20 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 1000", "SELECT event_id FROM ev WHERE ts < TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 1000")
statement("a11_registry_lookup", "SELECT e.event_id, m.group_id FROM {ev} e JOIN {members} m ON e.asset_id = m.asset_id")
statement("a08_fallback_routing", "SELECT e.asset_id, e.event_id, coalesce(c.close, e.value) AS price, c.close IS NULL AS fell_back FROM {ev} e LEFT JOIN {closes} c ON c.asset_id = e.asset_id AND c.session = cast(e.ts AS date)")
statement("a15_null_safe_import", "SELECT a.factor, a.target FROM {causes} a JOIN {causes} b ON a.factor = b.factor AND a.target = b.target AND a.condition IS NOT DISTINCT FROM b.condition")

# --- sets and storage ---
statement("g01_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'cause' AS kind FROM {causes} UNION ALL SELECT 'member' FROM {members}) t GROUP BY kind")
statement("g03_set_difference", "SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}")
statement("g04_unvisited", "SELECT asset_id FROM {members} m WHERE NOT EXISTS (SELECT 1 FROM {decided} d WHERE d.asset_id = m.asset_id AND d.confidence > 0.8)")
statement("b03_earliest_tombstone", "SELECT o_custkey, date_format(min(o_orderdate), 'yyyy-MM-dd') AS first_day FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day FROM orders GROUP BY o_custkey")
statement("b04_conditional_upsert", "SELECT coalesce(a.c_custkey, b.c_custkey) AS k, CASE WHEN a.c_mktsegment = b.c_mktsegment THEN a.c_acctbal ELSE b.c_acctbal END AS balance FROM {customer} a FULL OUTER JOIN (SELECT c_custkey + 5 AS c_custkey, c_mktsegment, c_acctbal FROM {customer}) b ON a.c_custkey = b.c_custkey")

# --- streams as batches ---
statement("i08_conflicting_payloads", "SELECT asset_id, cast(cast(ts AS date) AS string) AS day FROM {ev} GROUP BY asset_id, cast(ts AS date) HAVING count(DISTINCT tag) > 1")
statement("i12_expire_overdue", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00' THEN 'EXPIRED' ELSE o_orderstatus END AS state FROM {orders}")
statement("i15_two_source_closes", "SELECT asset_id, cast(session AS string) AS session, close FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, session ORDER BY priority) AS k FROM (SELECT asset_id, session, close, 0 AS priority FROM {closes} WHERE close > 20 UNION ALL SELECT asset_id, session, close * 2, 1 FROM {closes}) u) t WHERE k = 1")

# --- policies and helpers ---
statement("v06_sample_quality", "SELECT event_id, CASE WHEN value <= 0 THEN 'INVALID' WHEN factor = 'error' THEN 'HALTED' WHEN second(ts) > 50 THEN 'STALE' ELSE 'GOOD' END AS quality FROM {ev}")
statement("h19_direction_flip", "SELECT factor, target, CASE direction WHEN 'UP' THEN 'DOWN' WHEN 'DOWN' THEN 'UP' ELSE direction END AS flipped FROM {causes}")
statement("h20_magnitude_bucket", "SELECT factor, target, CASE WHEN weight < 0.40 THEN 'SMALL' WHEN weight < 0.70 THEN 'MEDIUM' ELSE 'LARGE' END AS bucket FROM {causes}")
statement("h21_reliability", "SELECT factor, target, round(alpha / (alpha + beta), 6) AS reliability FROM {causes}")
statement("h22_edge_ids", "SELECT concat(factor, '->', target, CASE WHEN condition IS NULL THEN '' ELSE concat('|', condition) END) AS edge_id FROM {causes}")
statement("h24_beta_update", "SELECT factor, target, greatest(alpha + 0.25, 1.0) AS alpha, greatest(beta - 1.5, 1.0) AS beta FROM {causes}")
statement("h25_weight_clamp", "SELECT factor, target, least(1.0, greatest(0.05, weight - 0.4)) AS weight FROM {causes}")
statement("h28_outcome_bucket", "SELECT asset_id, actual, count(*) AS n FROM {sc} WHERE actual IS NOT NULL GROUP BY 1, 2")
statement("h29_signed_value", "SELECT event_id, CASE WHEN polarity = 'RESOLUTION' THEN -value ELSE value END AS signed FROM {ev}")
statement("h33_sessions", "SELECT event_id, CASE weekday(ts) WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE 1 END AS ahead FROM {ev}", "SELECT event_id, CASE isodow(ts) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS ahead FROM ev")
statement("h31_local_time", "SELECT event_id, date_format(from_utc_timestamp(ts, 'Europe/Stockholm'), 'yyyy-MM-dd HH:mm') AS local FROM {ev}", "SELECT event_id, strftime(timezone('Europe/Stockholm', timezone('UTC', ts)), '%Y-%m-%d %H:%M') AS local FROM ev")
statement("h37_backoff", "SELECT n_nationkey, least(2.0D * pow(2.0D, n_nationkey), 8.0D) AS seconds FROM {nation}", "SELECT n_nationkey, least(2.0::DOUBLE * pow(2.0::DOUBLE, n_nationkey), 8.0::DOUBLE) AS seconds FROM nation")
statement("h43_percentage", "SELECT lang, round(100.0D * count(*) FILTER (WHERE n_chars > 1000) / nullif(count(*), 0), 4) AS share FROM {documents} GROUP BY lang", "SELECT lang, round(100.0::DOUBLE * count(*) FILTER (n_chars > 1000) / nullif(count(*), 0), 4) AS share FROM documents GROUP BY lang")
statement("h44_null_tolerant", "SELECT doc_id, coalesce(nullif(trim(lang), ''), 'und') AS lang FROM {documents}")
statement("x01_point_lookup", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey = 33")
statement("x02_ordered_children", "SELECT conv_id, array_join(transform(array_sort(collect_list(struct(turn, role))), x -> x.role), ',') AS roles FROM {conversations} GROUP BY conv_id", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
statement("x04_state_transition", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'O' WHEN 'O' THEN 'F' ELSE o_orderstatus END AS state FROM {orders}")
statement("x08_earliest_correlation", "SELECT source_id, min_by(article_id, published_at) AS correlation_id FROM {articles} GROUP BY source_id")
statement("x11_output_guards", "SELECT event_id, CASE WHEN factor IN ('view', 'click', 'purchase') THEN nullif(trim(factor), '') END AS event_type FROM {ev}")
statement("x18_fallback_reason", "SELECT asset_id, CASE WHEN base_close IS NULL THEN 'NO_BASELINE' WHEN end_close IS NULL THEN 'NO_SETTLEMENT' ELSE 'NONE' END AS reason, count(*) AS n FROM {sc} GROUP BY 1, 2")
statement("x19_price_pairs", "SELECT DISTINCT asset_id, base_close, end_close FROM {sc} WHERE base_close IS NOT NULL AND end_close IS NOT NULL")
statement("x30_alert_projection", "SELECT asset_id, magnitude, CASE magnitude WHEN 'LARGE' THEN 'STRONG' WHEN 'MEDIUM' THEN 'MODERATE' ELSE 'WEAK' END AS strength, count(*) AS n FROM {decided} WHERE confidence >= 0.6 GROUP BY 1, 2, 3")


@register("b01_insert_new", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def b01(spark, sf):
    return D.insert_new(X.read(spark, sf, "documents").select("doc_id"), X.read(spark, sf, "labels"), ["doc_id"])


@register("b02_upsert", "WITH r AS (SELECT conv_id, turn, role FROM conversations) SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM r GROUP BY conv_id")
def b02(spark, sf):
    c = X.read(spark, sf, "conversations").select("conv_id", "turn", "role")
    return D.upsert(c.filter("turn % 2 = 1"), c.filter("turn % 2 = 0"), ["conv_id"], "turn").select("conv_id", "turn", "role")


@register("g02_carry_forward", "SELECT asset_id, factor FROM (SELECT DISTINCT 'A' || (user_id % 29) AS asset_id, event_type AS factor FROM events)")
def g02(spark, sf):
    e = X.events(spark, sf).select("asset_id", "factor", "event_id")
    return e.filter("event_id % 2 = 0").unionByName(e.filter("event_id % 2 = 1")).dropDuplicates(["asset_id", "factor"]).select("asset_id", "factor")


SLOTS = X.EVENTS + """, s AS (SELECT asset_id, ts::DATE AS session, ((hour(ts) * 3600 + minute(ts) * 60 + second(ts)::INT) // 900)::INT AS slot, value, event_id FROM ev),
days AS (SELECT DISTINCT asset_id, session FROM s)"""


@register("d20_missing_slots", "WITH " + SLOTS + " SELECT asset_id, session::VARCHAR AS session, k::INT AS slot FROM days, range(32, 36) r(k) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.asset_id = days.asset_id AND s.session = days.session AND s.slot = k)")
def d20(spark, sf):
    return I.missing_slots(I.slotted(X.events(spark, sf), 900), 32, 36).select("asset_id", F.col("session").cast("string"), "slot")


@register("f13_carry_forward_grid", "WITH " + SLOTS + ", g AS (SELECT asset_id, session, k::INT AS slot FROM days, range(32, 40) r(k)) SELECT g.asset_id, g.session::VARCHAR AS session, g.slot, (SELECT arg_max(value, {'t': s.slot, 'e': event_id}) FROM s WHERE s.asset_id = g.asset_id AND s.session = g.session AND s.slot BETWEEN g.slot - 4 AND g.slot) AS value FROM g")
def f13(spark, sf):
    return I.carried(I.slotted(X.events(spark, sf), 900), 32, 40, 4).select("asset_id", F.col("session").cast("string"), "slot", "value")


@register("i07_revision_fold", "WITH " + X.EVENTS + ", r AS (SELECT asset_id, event_id % 12 + 1 AS revision, value, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY asset_id, event_id % 12 ORDER BY event_id) = 1), c AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY revision) AS k FROM r) SELECT asset_id, max(revision)::BIGINT AS last_revision, arg_max(value, revision) AS value FROM c WHERE k = revision GROUP BY asset_id")
def i07(spark, sf):
    e = X.events(spark, sf).withColumn("revision", F.col("event_id") % 12 + 1)
    r = D.first_by(e, ["asset_id", "revision"], [F.col("event_id")])
    return I.contiguous(r, "asset_id").groupBy("asset_id").agg(F.max("revision").alias("last_revision"), F.max_by("value", "revision").alias("value"))


POLICY = "WITH " + SLOTS + """, b AS (SELECT asset_id, session, arg_min(value, {'s': slot, 'e': event_id}) AS base, count(DISTINCT slot) AS slots, max(value) AS hi, min(value) AS lo, arg_max(value, {'s': slot, 'e': event_id}) AS last FROM s WHERE slot BETWEEN 32 AND 67 GROUP BY ALL)"""


@register("v02_target_policy", POLICY + " SELECT asset_id, session::VARCHAR AS session, round(hi / base - 1, 8) AS max_up, round(lo / base - 1, 8) AS max_down, CASE WHEN slots < 2 THEN 'INSUFFICIENT_WINDOW' WHEN hi / base - 1 >= 0.003 THEN 'TARGET_REACHED' ELSE 'TARGET_NOT_REACHED' END AS verdict FROM b")
def v02(spark, sf):
    return I.target_policy(I.slotted(X.events(spark, sf), 900), 32, 67).select("asset_id", F.col("session").cast("string"), F.round("max_up", 8).alias("max_up"), F.round("max_down", 8).alias("max_down"), "verdict")


@register("v04_point_sample_policy", POLICY + " SELECT asset_id, session::VARCHAR AS session, CASE WHEN slots < 2 THEN 'INSUFFICIENT_SAMPLES' WHEN hi / base - 1 > 0.003 OR lo / base - 1 < -0.003 THEN 'BAND_BREACH_OBSERVED' ELSE 'WITHIN_BAND_AT_SAMPLES' END AS outcome FROM b")
def v04(spark, sf):
    return I.target_policy(I.slotted(X.events(spark, sf), 900), 32, 67).select("asset_id", F.col("session").cast("string"), "outcome")
