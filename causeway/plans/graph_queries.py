"""Contexts, firing edges, decisions, propagation, scores and learning over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import calendar as C
from causeway.functions import scoring as S
from causeway.operators import graph as G
from causeway.operators import learning as L
from causeway.plans.registry import register
from causeway.sources import fixtures as X

WITH = "WITH "
CTX = X.EVENTS + """, ctx AS (SELECT asset_id, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, factor,
  list_sort(list(DISTINCT tag)) AS tags, bool_and(polarity = 'RESOLUTION') AS resolved, count(*) AS n_events FROM ev GROUP BY ALL)"""
FIRE = ",\n".join([CTX, X.CAUSES, X.MEMBERS]) + """, own AS (
  SELECT c.*, e.direction, e.weight, e.alpha, e.beta, e.condition, NULL::VARCHAR AS inherited_from FROM ctx c JOIN causes e
  ON c.factor = e.factor AND c.asset_id = e.target WHERE e.condition IS NULL OR list_contains(c.tags, e.condition)),
inh AS (
  SELECT c.*, e.direction, e.weight, e.alpha, e.beta, e.condition, m.group_id AS inherited_from FROM ctx c JOIN members m USING (asset_id)
  JOIN causes e ON e.factor = c.factor AND e.target = m.group_id
  WHERE (e.condition IS NULL OR list_contains(c.tags, e.condition))
  AND NOT EXISTS (SELECT 1 FROM own o WHERE o.asset_id = c.asset_id AND o.window_start = c.window_start AND o.factor = c.factor)),
fire AS (SELECT * FROM own UNION ALL SELECT * FROM inh)"""
ELEVATED = """lastc AS (SELECT asset_id, close, row_number() OVER (PARTITION BY asset_id ORDER BY session DESC) AS k FROM closes),
elev AS (SELECT asset_id, coalesce(count(*) FILTER (k BETWEEN 2 AND 11) >= 1 AND avg(close) FILTER (k BETWEEN 2 AND 11) > 0
  AND max(close) FILTER (k = 1) > avg(close) FILTER (k BETWEEN 2 AND 11) * 1.01, false) AS elevated FROM lastc GROUP BY asset_id)"""
DECIDE = """turned AS (SELECT f.* EXCLUDE (direction), CASE WHEN resolved AND direction = 'UP' THEN 'DOWN' WHEN resolved AND direction = 'DOWN' THEN 'UP' ELSE direction END AS direction,
  coalesce(elevated, false) AS elevated FROM fire f LEFT JOIN elev USING (asset_id)),
kept AS (SELECT * FROM turned WHERE NOT (resolved AND direction = 'DOWN' AND NOT elevated)),
frc AS (SELECT asset_id, window_start, sum(CASE direction WHEN 'UP' THEN 1 ELSE -1 END * weight * alpha / (alpha + beta)) AS net, sum(weight * alpha / (alpha + beta)) AS total,
  avg(weight) FILTER (direction = 'UP') AS upw, avg(weight) FILTER (direction = 'DOWN') AS downw, avg(weight) AS allw, count(*) AS n_edges
  FROM kept WHERE direction IN ('UP', 'DOWN') GROUP BY ALL),
conf AS (SELECT *, round(least(1.0, abs(net) / total * total / (total + 0.5)), 4) AS confidence FROM frc),
dir AS (SELECT *, CASE WHEN confidence < 0.15 THEN 'NEUTRAL' WHEN net > 0 THEN 'UP' ELSE 'DOWN' END AS direction FROM conf),
decided AS (SELECT asset_id, window_start, direction, confidence, n_edges,
  CASE WHEN w < 0.40 THEN 'SMALL' WHEN w < 0.70 THEN 'MEDIUM' ELSE 'LARGE' END AS magnitude
  FROM (SELECT *, CASE direction WHEN 'UP' THEN upw WHEN 'DOWN' THEN downw ELSE allw END AS w FROM dir))"""
CHAIN = WITH + FIRE + ",\n" + X.CLOSES.removeprefix(X.EVENTS + ", ") + ",\n" + ELEVATED + ",\n" + DECIDE
ZONE = "['America/New_York', 'Europe/London', 'Europe/Stockholm'][(substr(asset_id, 2)::INT % 3) + 1]"
SCORED = CHAIN + f""", loc AS (SELECT *, window_start + INTERVAL 15 MINUTE AS decision_at, timezone({ZONE}, timezone('UTC', window_start + INTERVAL 15 MINUTE)) AS lt FROM decided),
day AS (SELECT *, lt::DATE - CASE isodow(lt) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS d FROM loc),
base AS (SELECT *, CASE WHEN lt::DATE > d OR hour(lt) * 60 + minute(lt) >= 960 THEN d ELSE d - CASE isodow(d) WHEN 1 THEN 3 ELSE 1 END END AS baseline FROM day),
sess AS (SELECT *, baseline + CASE isodow(baseline) WHEN 5 THEN 3 ELSE 1 END AS settlement FROM base),
scored AS (SELECT s.asset_id, s.window_start, s.decision_at, s.direction, s.magnitude, s.confidence, s.baseline, s.settlement, b.close AS base_close, e.close AS end_close,
  e.close / b.close - 1 AS r FROM sess s LEFT JOIN closes b ON b.asset_id = s.asset_id AND b.session = s.baseline LEFT JOIN closes e ON e.asset_id = s.asset_id AND e.session = s.settlement),
sc AS (SELECT *, CASE WHEN abs(r) < 0.003 THEN 'NEUTRAL' WHEN r > 0 THEN 'UP' WHEN r IS NOT NULL THEN 'DOWN' END AS actual FROM scored)"""
TS = "strftime(%s, '%%Y-%%m-%%d %%H:%%M:%%S')"


def ts(c: str) -> str:
    return TS % c


def ctx(spark, sf):
    return G.contexts(X.events(spark, sf))


def fire(spark, sf):
    t = X.edge_tables(spark, sf)
    return G.firing_edges(ctx(spark, sf), t["causes"], t["members"])


def decided(spark: SparkSession, sf: str) -> DataFrame:
    edges = fire(spark, sf).join(G.elevated(X.closes(spark, sf)), "asset_id", "left")
    return G.decide(G.resolve(edges), ["asset_id", "window_start"])


def zone(asset):
    return F.element_at(F.array(*map(F.lit, X.ZONES)), F.substring(asset, 2, 4).cast("int") % 3 + 1)


def sure(session):
    """A session that is never null: joins on it then push no null tests, with all the zone arithmetic in them, down to each event."""
    return F.coalesce(session, F.expr("date'1900-01-01'"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions with their sessions, closes, return and actual direction."""
    c = X.closes(spark, sf)
    at = F.expr("window_start + interval 15 minutes")
    d = decided(spark, sf).withColumn("decision_at", at).withColumn("baseline", sure(C.baseline_session(F.col("decision_at"), zone(F.col("asset_id")), X.CLOSE_MINUTE)))
    d = d.withColumn("settlement", sure(C.next_session(F.col("baseline"))))
    d = d.join(c.select("asset_id", F.col("session").alias("baseline"), F.col("close").alias("base_close")), ["asset_id", "baseline"], "left")
    d = d.join(c.select("asset_id", F.col("session").alias("settlement"), F.col("close").alias("end_close")), ["asset_id", "settlement"], "left")
    d = d.withColumn("r", F.col("end_close") / F.col("base_close") - 1)
    return d.withColumn("actual", F.when(F.col("r").isNotNull(), S.outcome(F.col("r"))))


@register("f01_contexts", WITH + CTX + f" SELECT asset_id, {ts('window_start')} AS window_start, factor, array_to_string(tags, ',') AS tags, resolved, n_events::BIGINT AS n_events FROM ctx")
def f01(spark, sf):
    return ctx(spark, sf).select("asset_id", X.stamp("window_start").alias("window_start"), "factor", F.array_join("tags", ",").alias("tags"), "resolved", "n_events")


@register("e14_tags_by_context", WITH + CTX + f" SELECT asset_id, {ts('window_start')} AS window_start, len(list_distinct(flatten(list(tags))))::BIGINT AS n_tags, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags FROM ctx GROUP BY asset_id, window_start")
def e14(spark, sf):
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags"))))
    return ctx(spark, sf).groupBy("asset_id", "window_start").agg(tags.alias("t")).select("asset_id", X.stamp("window_start").alias("window_start"), F.size("t").cast("bigint").alias("n_tags"), F.array_join("t", ",").alias("tags"))


@register("e15_resolved_types", WITH + CTX + " SELECT factor, count(*)::BIGINT AS n_contexts, count(*) FILTER (resolved)::BIGINT AS n_resolved FROM ctx GROUP BY factor")
def e15(spark, sf):
    return ctx(spark, sf).groupBy("factor").agg(F.count(F.lit(1)).alias("n_contexts"), F.count_if("resolved").alias("n_resolved"))


EDGE = f"asset_id, {ts('window_start')} AS window_start, factor, direction, weight, coalesce(condition, '-') AS condition, coalesce(inherited_from, '-') AS inherited_from"


def _edges(df):
    return df.select("asset_id", X.stamp("window_start").alias("window_start"), "factor", "direction", "weight", F.coalesce("condition", F.lit("-")).alias("condition"), F.coalesce("inherited_from", F.lit("-")).alias("inherited_from"))


@register("d10_own_edges", WITH + FIRE + f" SELECT {EDGE} FROM own")
def d10(spark, sf):
    return _edges(G.own_edges(ctx(spark, sf), X.edge_tables(spark, sf)["causes"]))


@register("d11_inherited_edges", WITH + FIRE + f" SELECT {EDGE} FROM inh")
def d11(spark, sf):
    t, c = X.edge_tables(spark, sf), ctx(spark, sf)
    return _edges(G.inherited_edges(c, t["causes"], t["members"], G.own_edges(c, t["causes"])))


@register("d12_firing_edges", WITH + FIRE + f" SELECT {EDGE} FROM fire")
def d12(spark, sf):
    return _edges(fire(spark, sf))


@register("d13_correlation_edges", WITH + X.CORRELATIONS + " SELECT source, condition, count(*)::BIGINT AS n, round(avg(weight), 6) AS weight FROM correlations GROUP BY ALL")
def d13(spark, sf):
    return X.edge_tables(spark, sf)["correlations"].groupBy("source", "condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("weight"), 6).alias("weight"))


@register("p02_firing_with_price_gate", CHAIN + f" SELECT asset_id, {ts('window_start')} AS window_start, factor, direction, weight, elevated FROM kept")
def p02(spark, sf):
    e = G.resolve(fire(spark, sf).join(G.elevated(X.closes(spark, sf)), "asset_id", "left"))
    return e.select("asset_id", X.stamp("window_start").alias("window_start"), "factor", "direction", "weight", F.coalesce("elevated", F.lit(False)).alias("elevated"))


@register("e16_force_aggregation", CHAIN + f" SELECT asset_id, {ts('window_start')} AS window_start, round(net, 6) AS net, round(total, 6) AS total, n_edges::BIGINT AS n_edges FROM frc")
def e16(spark, sf):
    e = G.resolve(fire(spark, sf).join(G.elevated(X.closes(spark, sf)), "asset_id", "left"))
    return G.forces(e, ["asset_id", "window_start"]).select("asset_id", X.stamp("window_start").alias("window_start"), F.round("net", 6).alias("net"), F.round("total", 6).alias("total"), "n_edges")


@register("p03_decisions", CHAIN + f" SELECT asset_id, {ts('window_start')} AS window_start, direction, magnitude, confidence, n_edges::BIGINT AS n_edges FROM decided")
def p03(spark, sf):
    return decided(spark, sf).select("asset_id", X.stamp("window_start").alias("window_start"), "direction", "magnitude", "confidence", "n_edges")


@register("e23_elevated_price", WITH + X.CLOSES + ", " + ELEVATED + " SELECT asset_id, elevated FROM elev")
def e23(spark, sf):
    return G.elevated(X.closes(spark, sf))


@register("p01_event_fan_out", WITH + X.EVENTS + ", " + X.MEMBERS + " SELECT e.event_id, m.asset_id FROM ev e JOIN members g ON e.asset_id = g.asset_id JOIN members m ON m.group_id = g.group_id")
def p01(spark, sf):
    m = X.edge_tables(spark, sf)["members"]
    fan = m.withColumnRenamed("asset_id", "other").join(m, "group_id").groupBy("other").agg(F.collect_list("asset_id").alias("affected"))
    return X.events(spark, sf).join(fan.withColumnRenamed("other", "asset_id"), "asset_id").select("event_id", F.explode("affected").alias("asset_id"))


@register("p08_idempotency_key", CHAIN + f" SELECT asset_id || '|' || {ts('window_start')} || '|ONE_TRADING_DAY|1' AS key FROM decided")
def p08(spark, sf):
    return decided(spark, sf).select(F.concat_ws("|", "asset_id", X.stamp("window_start"), F.lit("ONE_TRADING_DAY"), F.lit("1")).alias("key"))


def _level(k: int, before: str, visited: str) -> str:
    return f"""hit{k} AS (SELECT l.context_id, c.target AS asset_id, c.direction, c.weight, c.alpha, c.beta FROM {before} l JOIN correlations c ON c.source = l.asset_id
  AND c.condition = 'UPSTREAM_' || l.direction WHERE NOT EXISTS (SELECT 1 FROM ({visited}) v WHERE v.context_id = l.context_id AND v.asset_id = c.target)),
f{k} AS (SELECT context_id, asset_id, sum(CASE direction WHEN 'UP' THEN 1 ELSE -1 END * weight * alpha / (alpha + beta)) AS net, sum(weight * alpha / (alpha + beta)) AS total,
  avg(weight) FILTER (direction = 'UP') AS upw, avg(weight) FILTER (direction = 'DOWN') AS downw, avg(weight) AS allw, count(*)::BIGINT AS n_edges FROM hit{k} WHERE direction IN ('UP', 'DOWN') GROUP BY ALL),
c{k} AS (SELECT *, round(least(1.0, abs(net) / total * total / (total + 0.5)), 4) AS confidence FROM f{k}),
l{k} AS (SELECT *, CASE WHEN confidence < 0.15 THEN 'NEUTRAL' WHEN net > 0 THEN 'UP' ELSE 'DOWN' END AS direction, {k} AS depth FROM c{k})"""


DIRECT = ", direct AS (SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS context_id, asset_id, direction, confidence FROM decided)"
PROPAGATE = (
    CHAIN + DIRECT + ", " + X.CORRELATIONS + ", l0 AS (SELECT * FROM direct WHERE direction IN ('UP', 'DOWN') AND confidence >= 0.30), "
    + _level(1, "l0", "SELECT context_id, asset_id FROM direct") + ", m1 AS (SELECT * FROM l1 WHERE direction <> 'NEUTRAL'), "
    + _level(2, "m1", "SELECT context_id, asset_id FROM direct UNION ALL SELECT context_id, asset_id FROM hit1") + ", m2 AS (SELECT * FROM l2 WHERE direction <> 'NEUTRAL'), "
    + _level(3, "m2", "SELECT context_id, asset_id FROM direct UNION ALL SELECT context_id, asset_id FROM hit1 UNION ALL SELECT context_id, asset_id FROM hit2")
    + " SELECT context_id, asset_id, direction, confidence, n_edges, depth FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"
)


@register("p07_propagation", PROPAGATE)
def p07(spark, sf):
    d = decided(spark, sf).select(X.stamp("window_start").alias("context_id"), "asset_id", "direction", "confidence")
    return G.propagate(d, X.edge_tables(spark, sf)["correlations"]).select("context_id", "asset_id", "direction", "confidence", "n_edges", "depth")


SCORE_COLUMNS = f"asset_id, {ts('window_start')} AS window_start, baseline::VARCHAR AS baseline, settlement::VARCHAR AS settlement"


@register("h41_sessions", SCORED + f" SELECT {SCORE_COLUMNS} FROM sc")
def h41(spark, sf):
    return scored(spark, sf).select("asset_id", X.stamp("window_start").alias("window_start"), F.col("baseline").cast("string"), F.col("settlement").cast("string"))


@register("v01_daily_score", SCORED + f" SELECT {SCORE_COLUMNS}, direction, actual, round(r, 8) AS r, CASE WHEN abs(r) < 0.003 THEN 'NEUTRAL' WHEN abs(r) < 0.01 THEN 'SMALL' WHEN abs(r) < 0.03 THEN 'MEDIUM' ELSE 'LARGE' END AS size, CASE WHEN direction = actual THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM sc WHERE r IS NOT NULL")
def v01(spark, sf):
    s = scored(spark, sf).filter("r is not null")
    return s.select("asset_id", X.stamp("window_start").alias("window_start"), F.col("baseline").cast("string"), F.col("settlement").cast("string"), "direction", "actual", F.round("r", 8).alias("r"), S.outcome_size(F.col("r")).alias("size"), F.when(F.col("direction") == F.col("actual"), 1.0).otherwise(0.0).alias("score"))


@register("e01_filtered_counts", SCORED + " SELECT count(*)::BIGINT AS total, count(actual)::BIGINT AS scored, count(*) FILTER (actual IS NULL)::BIGINT AS pending, count(*) FILTER (direction = actual)::BIGINT AS correct, count(*) FILTER (direction = 'UP')::BIGINT AS up, count(*) FILTER (direction = 'DOWN')::BIGINT AS down, count(*) FILTER (direction = 'NEUTRAL')::BIGINT AS neutral FROM sc")
def e01(spark, sf):
    n = lambda c, a: F.count_if(c).alias(a)
    d, a = F.col("direction"), F.col("actual")
    return scored(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count("actual").alias("scored"), n(a.isNull(), "pending"), n(d == a, "correct"), n(d == "UP", "up"), n(d == "DOWN", "down"), n(d == "NEUTRAL", "neutral"))


@register("e03_confidence_histogram", CHAIN + " SELECT round(confidence, 2) AS confidence, count(*)::BIGINT AS n FROM decided GROUP BY 1")
def e03(spark, sf):
    return decided(spark, sf).groupBy(F.round("confidence", 2).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@register("e04_busy_asset_days", CHAIN + " SELECT asset_id, window_start::DATE::VARCHAR AS day, count(*)::BIGINT AS n, count(*) FILTER (direction <> 'NEUTRAL')::BIGINT AS firm FROM decided GROUP BY ALL HAVING count(*) FILTER (direction <> 'NEUTRAL') > 2 ORDER BY firm DESC, asset_id, day LIMIT 10")
def e04(spark, sf):
    g = decided(spark, sf).groupBy("asset_id", F.to_date("window_start").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("direction") != "NEUTRAL").alias("firm"))
    return g.filter("firm > 2").orderBy(F.desc("firm"), "asset_id", "day").limit(10)


@register("c02_relabel", SCORED + f" SELECT asset_id, {ts('window_start')} AS window_start, CASE WHEN actual IS NULL THEN 'pending' WHEN direction = actual THEN 'correct' ELSE 'wrong' END AS verification FROM sc")
def c02(spark, sf):
    v = F.when(F.col("actual").isNull(), "pending").when(F.col("direction") == F.col("actual"), "correct").otherwise("wrong")
    return scored(spark, sf).select("asset_id", X.stamp("window_start").alias("window_start"), v.alias("verification"))


@register("c06_confidence_gate", CHAIN + f" SELECT asset_id, {ts('window_start')} AS window_start, confidence FROM decided WHERE confidence >= 0.6")
def c06(spark, sf):
    return decided(spark, sf).filter("confidence >= 0.6").select("asset_id", X.stamp("window_start").alias("window_start"), "confidence")


@register("f05_latest_window", CHAIN + f" SELECT asset_id, {ts('max(window_start)')} AS window_start, arg_max(direction, window_start) AS direction FROM decided GROUP BY asset_id")
def f05(spark, sf):
    return decided(spark, sf).groupBy("asset_id").agg(F.max("window_start").alias("w"), F.max_by("direction", "window_start").alias("direction")).select("asset_id", X.stamp("w").alias("window_start"), "direction")


RET = X.CLOSES + ", ret AS (SELECT *, close / lag(close) OVER (PARTITION BY asset_id ORDER BY session) - 1 AS r FROM closes)"
VOL = RET + ", vol AS (SELECT asset_id, coalesce(stddev_pop(r), 0) AS volatility FROM ret GROUP BY asset_id)"


@register("f08_previous_return", WITH + RET + " SELECT asset_id, session::VARCHAR AS session, round(r, 8) AS r FROM ret")
def f08(spark, sf):
    return L.returns(X.closes(spark, sf)).select("asset_id", F.col("session").cast("string"), F.round("r", 8).alias("r"))


@register("e19_volatility", WITH + VOL + " SELECT asset_id, round(volatility, 8) AS volatility FROM vol")
def e19(spark, sf):
    return L.volatility(X.closes(spark, sf)).select("asset_id", F.round("volatility", 8).alias("volatility"))


@register("h30_abnormal", WITH + VOL + " SELECT asset_id, session::VARCHAR AS session, volatility > 0 AND abs(r) >= 2 * volatility AS is_abnormal FROM ret JOIN vol USING (asset_id) WHERE r IS NOT NULL")
def h30(spark, sf):
    c = X.closes(spark, sf)
    return L.returns(c).filter("r is not null").join(L.volatility(c), "asset_id").select("asset_id", F.col("session").cast("string"), S.abnormal(F.col("r"), F.col("volatility")).alias("is_abnormal"))


SAMPLES = VOL + """, nexts AS (SELECT asset_id, session, lead(close) OVER (PARTITION BY asset_id ORDER BY session) / close - 1 AS r FROM closes),
samples AS (SELECT e.event_id, e.factor, t.condition, e.asset_id, CASE WHEN polarity = 'RESOLUTION' THEN -n.r ELSE n.r END AS r, v.volatility > 0 AND abs(n.r) >= 2 * v.volatility AS is_abnormal
  FROM ev e JOIN nexts n ON n.asset_id = e.asset_id AND n.session = e.ts::DATE JOIN vol v ON v.asset_id = e.asset_id, unnest([NULL, e.tag]) AS t(condition) WHERE n.r IS NOT NULL)"""


def samples(spark, sf):
    """Event, condition (none and its tag), asset and signed return to the next session."""
    from pyspark.sql import Window

    c = X.closes(spark, sf)
    nxt = c.withColumn("nr", F.lead("close").over(Window.partitionBy("asset_id").orderBy("session")) / F.col("close") - 1).select("asset_id", "session", "nr").join(L.volatility(c), "asset_id")
    e = X.events(spark, sf).withColumn("session", F.to_date("ts")).join(nxt, ["asset_id", "session"]).filter("nr is not null")
    e = e.withColumn("condition", F.explode(F.array(F.lit(None).cast("string"), F.col("tag"))))
    return e.select("event_id", "factor", "condition", "asset_id", S.signed_return(F.col("nr"), F.col("polarity")).alias("r"), S.abnormal(F.col("nr"), F.col("volatility")).alias("is_abnormal"))


@register("l01_samples", WITH + SAMPLES + " SELECT event_id, factor, coalesce(condition, '-') AS condition, asset_id, round(r, 8) AS r, is_abnormal FROM samples")
def l01(spark, sf):
    return samples(spark, sf).select("event_id", "factor", F.coalesce("condition", F.lit("-")).alias("condition"), "asset_id", F.round("r", 8).alias("r"), "is_abnormal")


ESTIMATE = SAMPLES + """, est0 AS (SELECT factor, coalesce(condition, '-') AS condition, asset_id, count(*) AS n, avg(r) AS mean, count(*) FILTER (r > 0) AS up, count(*) FILTER (r < 0) AS down, bool_or(is_abnormal) AS ab FROM samples GROUP BY ALL),
est AS (SELECT *, CASE WHEN mean > 0.002 THEN 'UP' WHEN mean < -0.002 THEN 'DOWN' ELSE 'NEUTRAL' END AS direction, CASE WHEN mean > 0.002 THEN up WHEN mean < -0.002 THEN down ELSE 0 END AS agree FROM est0 WHERE n >= CASE WHEN ab THEN 2 ELSE 5 END)"""


@register("e20_edge_estimation", WITH + ESTIMATE + " SELECT factor, condition, asset_id, n::BIGINT AS n, direction, round(least(1.0, abs(mean) / 0.05), 6) AS weight, round(agree / n, 6) AS confidence, (agree + 1)::BIGINT AS alpha, (n - agree + 1)::BIGINT AS beta FROM est")
def e20(spark, sf):
    s = samples(spark, sf).withColumn("condition", F.coalesce("condition", F.lit("-")))
    return L.estimate(s, ["factor", "condition", "asset_id"]).withColumn("weight", F.round("weight", 6)).withColumn("confidence", F.round("confidence", 6))


@register("e21_correlation_estimation", WITH + RET + """, pairs AS (SELECT a.asset_id AS source, CASE WHEN a.r > 0 THEN 'UPSTREAM_UP' ELSE 'UPSTREAM_DOWN' END AS condition, b.asset_id AS target, b.r FROM ret a JOIN ret b ON a.session = b.session AND a.asset_id <> b.asset_id WHERE abs(a.r) >= 0.003 AND b.r IS NOT NULL),
g AS (SELECT source, condition, target, count(*) AS n, avg(r) AS mean, count(*) FILTER (r > 0) AS up, count(*) FILTER (r < 0) AS down FROM pairs GROUP BY ALL HAVING count(*) >= 5)
SELECT source, condition, target, n::BIGINT AS n, CASE WHEN mean > 0.002 THEN 'UP' WHEN mean < -0.002 THEN 'DOWN' ELSE 'NEUTRAL' END AS direction, round(least(1.0, abs(mean) / 0.05), 6) AS weight FROM g""")
def e21(spark, sf):
    r = L.returns(X.closes(spark, sf)).filter("r is not null")
    a = r.filter(F.abs("r") >= S.DEADBAND).select(F.col("asset_id").alias("source"), "session", F.when(F.col("r") > 0, "UPSTREAM_UP").otherwise("UPSTREAM_DOWN").alias("condition"))
    p = a.join(r.withColumnRenamed("asset_id", "target"), "session").filter("source <> target").withColumn("is_abnormal", F.lit(False))
    return L.estimate(p, ["source", "condition", "target"]).select("source", "condition", "target", "n", "direction", F.round("weight", 6).alias("weight"))


@register("l03_add_only_edges", WITH + ESTIMATE + ", " + X.CAUSES + " SELECT factor, condition, asset_id FROM est e WHERE direction <> 'NEUTRAL' AND condition <> '-' AND NOT EXISTS (SELECT 1 FROM causes c WHERE c.factor = e.factor AND c.target = e.asset_id AND c.condition = e.condition)")
def l03(spark, sf):
    s = samples(spark, sf).withColumn("condition", F.coalesce("condition", F.lit("-")))
    new = L.estimate(s, ["factor", "condition", "asset_id"]).filter("direction <> 'NEUTRAL' and condition <> '-'")
    have = X.edge_tables(spark, sf)["causes"].select("factor", "condition", F.col("target").alias("asset_id"))
    return new.join(have, ["factor", "condition", "asset_id"], "left_anti").select("factor", "condition", "asset_id")


CREDIT = SCORED + """, con AS (SELECT s.asset_id || '|' || strftime(s.window_start, '%Y-%m-%d %H:%M:%S') AS prediction_id, k.factor || '->' || coalesce(k.inherited_from, k.asset_id) || coalesce('|' || k.condition, '') AS edge_id,
  k.weight AS influence, k.weight, s.settlement AS scored_at, s.direction = s.actual AS is_correct FROM sc s JOIN kept k ON k.asset_id = s.asset_id AND k.window_start = s.window_start WHERE s.actual IS NOT NULL),
cr AS (SELECT *, CASE WHEN sum(influence) OVER p > 0 THEN influence / sum(influence) OVER p ELSE 1.0 / count(*) OVER p END AS credit FROM con WINDOW p AS (PARTITION BY prediction_id))"""


def contributions(spark, sf):
    k = G.resolve(fire(spark, sf).join(G.elevated(X.closes(spark, sf)), "asset_id", "left")).drop("direction")
    s = scored(spark, sf).filter("actual is not null").select("asset_id", "window_start", "settlement", (F.col("direction") == F.col("actual")).alias("is_correct"))
    j = k.join(s, ["asset_id", "window_start"])
    return j.select(F.concat_ws("|", "asset_id", X.stamp("window_start")).alias("prediction_id"), S.edge_id(F.col("factor"), F.coalesce("inherited_from", "asset_id"), F.col("condition")).alias("edge_id"), F.col("weight").alias("influence"), "weight", F.col("settlement").alias("scored_at"), "is_correct")


@register("e17_proportional_credit", CREDIT + " SELECT prediction_id, edge_id, round(credit, 6) AS credit FROM cr")
def e17(spark, sf):
    return L.credits(contributions(spark, sf)).select("prediction_id", "edge_id", F.round("credit", 6).alias("credit"))


@register("l04_credit_fold", CREDIT + """, st AS (SELECT edge_id, first(weight) AS w0, list(CASE WHEN is_correct THEN 0.02 ELSE -0.02 END::DOUBLE * credit ORDER BY scored_at, prediction_id, credit) AS steps FROM cr GROUP BY edge_id)
SELECT edge_id, round(list_reduce(steps, lambda w, x: least(1.0::DOUBLE, greatest(0.05::DOUBLE, w + x)), w0::DOUBLE), 6) AS weight, len(steps)::BIGINT AS n_steps FROM st""")
def l04(spark, sf):
    return L.fold_weights(L.credits(contributions(spark, sf))).withColumn("weight", F.round("weight", 6))


@register("c15_graph_assertions", WITH + ", ".join([X.CAUSES, X.MEMBERS]) + """ SELECT * FROM (SELECT 'orphan_target' AS rule, count(*)::BIGINT AS n FROM causes c WHERE target NOT IN (SELECT asset_id FROM members UNION SELECT group_id FROM members)
UNION ALL SELECT 'missing_properties', count(*) FROM causes WHERE weight IS NULL OR alpha IS NULL OR beta IS NULL
UNION ALL SELECT 'conditioned_and_unconditional', count(*) FROM (SELECT factor, target FROM causes GROUP BY ALL HAVING count(*) FILTER (condition IS NULL) > 0 AND count(condition) > 0)
UNION ALL SELECT 'group_cardinality', count(*) FROM (SELECT asset_id FROM members GROUP BY asset_id HAVING count(*) <> 1)
UNION ALL SELECT 'null_condition', count(*) FROM causes WHERE condition = '')""")
def c15(spark, sf):
    t = X.edge_tables(spark, sf)
    c, m = t["causes"], t["members"]
    known = m.select(F.col("asset_id").alias("target")).unionByName(m.select(F.col("group_id").alias("target"))).distinct()
    one = lambda rule, df: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
    both = c.groupBy("factor", "target").agg(F.count_if(F.col("condition").isNull()).alias("a"), F.count("condition").alias("b")).filter("a > 0 and b > 0")
    parts = [one("orphan_target", c.join(known, "target", "left_anti")), one("missing_properties", c.filter("weight is null or alpha is null or beta is null")), one("conditioned_and_unconditional", both),
             one("group_cardinality", m.groupBy("asset_id").count().filter("count <> 1")), one("null_condition", c.filter("condition = ''"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
