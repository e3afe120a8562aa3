"""Identities, calendars, clusters, learning, streams and read models over the driver tables, each with the same rows as SQL where SQL can tell them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.functions import clean as K
from causeway.functions import scoring as S
from causeway.functions import text as T
from causeway.operators import clusters as C
from causeway.operators import dedup as D
from causeway.operators import folds
from causeway.operators import graph as G
from causeway.operators import hooks as H
from causeway.operators import learning as L
from causeway.operators import nearest as N
from causeway.plans import extra_queries as EQ
from causeway.plans import graph_queries as GQ
from causeway.plans import rule_queries as RQ
from causeway.plans import text_queries as TQ
from causeway.plans.market_queries import both
from causeway.plans.registry import register
from causeway.scratch import materialize, scratch_dir
from causeway.sources import fixtures as X
from causeway.sources import readers as R
from causeway.streaming import flows, greedy, online

A = "WITH " + X.ARTICLES
NTZ = "yyyy-MM-dd HH:mm:ss"

# --- scalar functions ---
URL_PARTS = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q"


@register("h02_url_variant", f"WITH u AS (SELECT page_id, {URL_PARTS} FROM pages) SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS url FROM (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_'))) AS k FROM u)")
def h02(spark, sf):
    return X.read(spark, sf, "pages").select("page_id", T.collector_url(F.col("url")).alias("url"))


@register("h07_normalize", A + r" SELECT article_id, CASE WHEN regexp_matches(left(body, 200), '(?i)<!doctype html|<html') THEN '' ELSE left(trim(regexp_replace(nfc_normalize(body), '\s+', ' ', 'g')), 2000) END AS body FROM articles")
def h07(spark, sf):
    text = F.when(T.looks_like_page(F.col("body")), F.lit("")).otherwise(F.left(T.collapse(K.nfc("body")), F.lit(2000)))
    return X.articles(spark, sf).select("article_id", text.alias("body"))


@register("h09_observation_hash", "WITH " + X.EVENTS + """ SELECT event_id, sha256(asset_id || '|' || factor || '|' || tag) AS observation_hash, sha256('{"asset":"' || asset_id || '","factor":"' || factor || '","polarity":"' || polarity || '","tag":"' || tag || '"}') AS canonical_hash, sha256('{"band":0.003,"target":0.003}') AS policy_hash FROM ev""")
def h09(spark, sf):
    """Hashes of the key fields, of the record as JSON with sorted names, and of the policy's constants."""
    canonical = F.to_json(F.struct(*[F.col(c).alias(n) for n, c in sorted({"tag": "tag", "asset": "asset_id", "polarity": "polarity", "factor": "factor"}.items())]))
    policy = F.to_json(F.struct(F.lit(0.003).alias("band"), F.lit(0.003).alias("target")))
    return X.events(spark, sf).select("event_id", F.sha2(F.concat_ws("|", "asset_id", "factor", "tag"), 256).alias("observation_hash"), F.sha2(canonical, 256).alias("canonical_hash"), F.sha2(policy, 256).alias("policy_hash"))


@register("h23_rationale", GQ.CHAIN + ", r AS (SELECT asset_id, window_start, string_agg(upper(factor) || ' ' || direction, '; ' ORDER BY factor, direction, coalesce(condition, ''), weight) AS parts FROM kept GROUP BY ALL) SELECT asset_id, " + GQ.ts("window_start") + " AS window_start, left(parts, 2000) AS rationale, list_extract(regexp_extract_all(left(parts, 2000), '[A-Z_]+'), 1) AS first_label, len(list_distinct(regexp_extract_all(left(parts, 2000), '[A-Z_]+')))::BIGINT AS labels FROM r")
def h23(spark, sf):
    kept = G.resolve(GQ.fire(spark, sf).join(G.elevated(X.closes(spark, sf)), "asset_id", "left"))
    part = F.concat(F.upper("factor"), F.lit(" "), F.col("direction"))
    parts = F.array_sort(F.collect_list(F.struct("factor", "direction", F.coalesce("condition", F.lit("")).alias("c"), "weight", part.alias("p"))))
    r = kept.groupBy("asset_id", "window_start").agg(F.left(F.array_join(F.transform(parts, lambda x: x["p"]), "; "), F.lit(2000)).alias("rationale"))
    labels = F.regexp_extract_all("rationale", F.lit("([A-Z_]+)"), F.lit(1))
    return r.select("asset_id", X.stamp("window_start").alias("window_start"), "rationale", F.try_element_at(labels, F.lit(1)).alias("first_label"), F.size(F.array_distinct(labels)).cast("bigint").alias("labels"))


both("h27_score_buckets", lambda d: """SELECT asset_id, direction, actual, size_, direction = actual AS correct, count(*) AS n FROM (SELECT asset_id, direction, actual, CASE WHEN abs(q) < 0.003 THEN 'NEUTRAL' WHEN abs(q) < 0.01 THEN 'SMALL' WHEN abs(q) < 0.03 THEN 'MEDIUM' ELSE 'LARGE' END AS size_ FROM (SELECT *, end_close / base_close - 1 AS q FROM {sc} WHERE actual IS NOT NULL) x) t GROUP BY asset_id, direction, actual, size_""")


@register("h35_us_summer_time", "WITH " + X.EVENTS + ", d AS (SELECT event_id, (ts + to_days((event_id % 12 * 30)::INT)) AS u FROM ev) SELECT event_id, hour(timezone('America/New_York', timezone('UTC', u)))::INT AS local_hour FROM d")
def h35(spark, sf):
    """By the rule: from the second Sunday of March to the first of November the offset is four hours, else five; both change at two in the morning."""
    u = F.col("ts") + F.make_dt_interval((F.col("event_id") % 12 * 30).cast("int"))
    sunday = lambda month, n: F.date_add(F.next_day(F.date_sub(F.make_date(F.year("u"), F.lit(month), F.lit(1)), 1), "Sun"), 7 * (n - 1)).cast("timestamp_ntz")
    summer = (F.col("u") >= sunday(3, 2) + F.expr("interval 7 hours")) & (F.col("u") < sunday(11, 1) + F.expr("interval 6 hours"))
    return X.events(spark, sf).withColumn("u", u).select("event_id", F.hour(F.when(summer, F.col("u") - F.expr("interval 4 hours")).otherwise(F.col("u") - F.expr("interval 5 hours"))).alias("local_hour"))


both("h36_session_calendar", lambda d: f"""SELECT k.calendar_id, {d.stamp(f"day + {d.seconds('opens * 60')}")} AS opens_at, {d.stamp(f"day + {d.seconds('closes * 60')}")} AS closes_at, pause, closes - opens - pause AS minutes FROM (SELECT DISTINCT date_trunc('day', ts) AS day FROM {{ev}}) s
  CROSS JOIN (SELECT 'NYSE' AS calendar_id, 570 AS opens, 960 AS closes, 0 AS pause UNION ALL SELECT 'TSE', 540, 900, 60 UNION ALL SELECT 'STO', 540, 1050, 0) k WHERE {"isodow(day) < 6" if d.duck else "weekday(day) < 5"} AND NOT (k.calendar_id = 'NYSE' AND day = {d.at("2024-01-15 00:00:00")})""")
both("h39_evidence_reasons", lambda d: f"""SELECT asset_id, {d.stamp("window_start")} AS window_start, concat_ws(',', CASE WHEN base_close IS NULL THEN 'NO_BASELINE' END, CASE WHEN n_edges < 2 THEN 'SINGLE_EDGE' END, CASE WHEN end_close IS NULL THEN 'NO_SETTLEMENT' END, CASE WHEN confidence < 0.3 THEN 'WEAK' END) AS reasons,
  {d.sha(f"concat(chr(123), '\"asset\":\"', asset_id, '\",\"at\":\"', {d.stamp('window_start')}, '\",\"direction\":\"', direction, '\"', chr(125))")} AS evidence_hash FROM (SELECT s.asset_id, s.window_start, s.base_close, s.end_close, s.confidence, s.direction, k.n_edges FROM {{sc}} s JOIN {{decided}} k ON k.asset_id = s.asset_id AND k.window_start = s.window_start) t""")


@register("h42_token_budget", A + ", t AS (SELECT article_id, ceil(length(body) / 4.0)::BIGINT AS n FROM articles), c AS (SELECT *, sum(n) OVER (ORDER BY article_id)::BIGINT AS used FROM t) SELECT article_id, n, used, round(n * 0.25 / 1000, 6)::DOUBLE AS cost FROM c WHERE used <= 50000")
def h42(spark, sf):
    """Tokens, cost and the budget used up to each article in order: running sums over pieces of the table."""
    t = X.articles(spark, sf).select("article_id", F.ceil(F.length("body") / 4.0).cast("bigint").alias("n"))
    return folds.running_sums(t, [], ["article_id"], "n", "used").filter("used <= 50000").select("article_id", "n", "used", F.round(F.col("n") * 0.25 / 1000, 6).alias("cost"))


# --- joins, windows, rules ---


@register("d14_nearest_centroids", "WITH " + TQ.CENTRE + """, k AS (SELECT vec_id, cv.label AS cluster, round(list_cosine_similarity(embedding::DOUBLE[], c), 9) AS s FROM embeddings e JOIN cv ON cv.label % 5 <> 4),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cluster) AS rank FROM k) SELECT vec_id, cluster, s AS similarity, rank::INT AS rank, s > 0.80 AND rank = 1 AS joins FROM r WHERE rank <= 5""")
def d14(spark, sf):
    """Every vector against all open clusters' centroids (a label is open unless it is 4 or 9): top five first, then the threshold."""
    c = TQ.centroids(spark, sf).withColumnRenamed("label", "cluster").filter("cluster % 5 <> 4")
    r = N.nearest(X.read(spark, sf, "embeddings"), c, 5, "vec_id", "embedding", "cluster", "c")
    return r.select("vec_id", "cluster", "similarity", "rank", ((F.col("similarity") > 0.80) & (F.col("rank") == 1)).alias("joins"))


@register("d18_close_lookup", "WITH " + X.CLOSES + ", v AS (SELECT *, 'r1' AS registry_version FROM closes UNION ALL SELECT asset_id, session, close + 1, 'r2' FROM closes WHERE day(session) % 3 = 0) SELECT asset_id, session::VARCHAR AS session, arg_max(close, registry_version) AS close, max(registry_version) AS registry_version FROM v GROUP BY ALL")
def d18(spark, sf):
    c = X.closes(spark, sf)
    v = c.withColumn("registry_version", F.lit("r1")).unionByName(c.filter(F.day("session") % 3 == 0).withColumn("close", F.col("close") + 1).withColumn("registry_version", F.lit("r2")))
    return v.groupBy("asset_id", F.col("session").cast("string").alias("session")).agg(F.max_by("close", "registry_version").alias("close"), F.max("registry_version").alias("registry_version"))


@register("f04_session_clusters", "WITH RECURSIVE " + X.EVENTS + """, g AS (SELECT event_id, factor, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 WHEN lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS cut FROM ev WINDOW w AS (PARTITION BY factor ORDER BY ts, event_id)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY factor ORDER BY ts, event_id) AS run FROM g),
s AS (SELECT factor, run, min(ts) AS started FROM r GROUP BY ALL UNION SELECT s.factor, s.run, (SELECT min(r.ts) FROM r WHERE r.factor = s.factor AND r.run = s.run AND r.ts > s.started + INTERVAL 24 HOUR) FROM s WHERE s.started IS NOT NULL)
SELECT r.event_id, strftime(max(s.started), '%Y-%m-%d %H:%M:%S') AS started FROM r JOIN s ON s.factor = r.factor AND s.run = r.run AND s.started <= r.ts GROUP BY r.event_id""")
def f04(spark, sf):
    got = C.session_clusters(X.events(spark, sf).select("factor", "ts", "event_id"), ["factor"], quiet="2 hours")
    return got.select("event_id", X.stamp("started").alias("started"))


@register("f17_smallest_title", A + f", s AS (SELECT article_id, CASE WHEN article_id % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS direction, language AS rule, {TQ.KEY} AS key FROM articles) SELECT direction, rule, min(key) AS key, arg_min(article_id, {{'k': key, 'a': article_id}}) AS article_id FROM s GROUP BY ALL")
def f17(spark, sf):
    s = X.articles(spark, sf).select("article_id", F.when(F.col("article_id") % 2 == 0, "UP").otherwise("DOWN").alias("direction"), F.col("language").alias("rule"), T.title_key(F.col("title")).alias("key"))
    return s.groupBy("direction", "rule").agg(F.min("key").alias("key"), F.min_by("article_id", F.struct("key", "article_id")).alias("article_id"))


#: rule, asset, direction, pattern. Our own nine, on words that the texts have.
SIGNALS = [("r1", "A1", "UP", "the"), ("r2", "A1", "DOWN", "of"), ("r3", "A2", "UP", "and"), ("r4", "A2", "DOWN", "und"), ("r5", "A3", "UP", "la|le"), ("r6", "A3", "DOWN", "de"), ("r7", "A4", "UP", "in"), ("r8", "A4", "DOWN", "que"), ("r9", "A5", "UP", "der|die")]


@register("t18_signal_rules", A + " " + " UNION ALL ".join(f"SELECT article_id, '{r}' AS rule, '{a}' AS asset_id, '{d}' AS direction, regexp_matches(body, '[0-9]') AS strict FROM articles WHERE regexp_matches(lower(title), '(^|[^\\p{{L}}])({p})([^\\p{{L}}]|$)')" for r, a, d, p in SIGNALS))
def t18(spark, sf):
    """Forces of nine rules on a title; strict ones have a figure in the text too."""
    t = F.lower("title")
    force = [F.when(t.rlike(rf"(^|[^\p{{L}}])({p})([^\p{{L}}]|$)"), F.struct(F.lit(r).alias("rule"), F.lit(a).alias("asset_id"), F.lit(d).alias("direction"))) for r, a, d, p in SIGNALS]
    return X.articles(spark, sf).select("article_id", F.col("body").rlike("[0-9]").alias("strict"), F.explode(F.array_compact(F.array(*force))).alias("f")).select("article_id", "f.rule", "f.asset_id", "f.direction", "strict")


@register("t20_reviewed_subset", "WITH r AS (SELECT DISTINCT doc_id FROM labels UNION ALL SELECT -1 - item_id FROM benchmark WHERE item_id < 3), k AS (SELECT r.doc_id, d.doc_id IS NOT NULL AS known FROM r LEFT JOIN documents d ON d.doc_id = r.doc_id) SELECT doc_id, CASE WHEN NOT known THEN 'UNKNOWN' WHEN (SELECT count(*) FROM k WHERE known) < 30 THEN 'TOO_FEW' ELSE 'FROZEN' END AS verdict FROM k")
def t20(spark, sf):
    """Reviewed ids are frozen if the corpus has them and they are thirty or more."""
    reviewed = X.read(spark, sf, "labels").select("doc_id").distinct().unionByName(X.read(spark, sf, "benchmark").filter("item_id < 3").select((-1 - F.col("item_id")).alias("doc_id")))
    k = reviewed.join(X.read(spark, sf, "documents").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    enough = k.filter("known").limit(30).count() >= 30
    return k.select("doc_id", F.when(F.col("known").isNull(), "UNKNOWN").otherwise("FROZEN" if enough else "TOO_FEW").alias("verdict"))


WEIGHTS = [("view", 0.2), ("signup", 0.5), ("purchase", 1.0), ("error", -1.5), ("click", 0.1)]


@register("t21_rule_baseline", "WITH " + X.EVENTS + ", " + X.values(WEIGHTS, "wt", "factor, weight") + ", s AS (SELECT asset_id, date_trunc('day', ts) AS day, sum(CASE WHEN polarity = 'RESOLUTION' THEN -weight ELSE weight END) AS s FROM ev JOIN wt USING (factor) GROUP BY ALL), v AS (SELECT asset_id, day, CASE WHEN s > 0.05 THEN 'UP' WHEN s < -0.05 THEN 'DOWN' ELSE 'NEUTRAL' END AS verdict FROM s), m AS (SELECT arg_min(verdict, {'n': -n, 'v': verdict}) AS verdict FROM (SELECT verdict, count(*) AS n FROM v GROUP BY 1)) SELECT asset_id, strftime(day, '%Y-%m-%d') AS day, 'weighted' AS method, verdict FROM v UNION ALL SELECT asset_id, strftime(day, '%Y-%m-%d'), 'always', 'NEUTRAL' FROM v UNION ALL SELECT asset_id, strftime(day, '%Y-%m-%d'), 'majority', (SELECT verdict FROM m) FROM v")
def t21(spark, sf):
    """Frozen weights, always neutral, and the commonest verdict, for each context."""
    w = spark.createDataFrame(WEIGHTS, "factor string, weight double")
    s = X.events(spark, sf).join(F.broadcast(w), "factor").groupBy("asset_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(F.when(F.col("polarity") == "RESOLUTION", -F.col("weight")).otherwise(F.col("weight"))).alias("s"))
    v = s.select("asset_id", "day", F.when(F.col("s") > 0.05, "UP").when(F.col("s") < -0.05, "DOWN").otherwise("NEUTRAL").alias("weighted"))
    major = v.groupBy("weighted").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("weighted", F.struct(-F.col("n"), "weighted")).alias("m")).scalar()
    methods = F.array(F.struct(F.lit("weighted").alias("method"), F.col("weighted").alias("verdict")), F.struct(F.lit("always").alias("method"), F.lit("NEUTRAL").alias("verdict")), F.struct(F.lit("majority").alias("method"), major.alias("verdict")))
    return v.select("asset_id", "day", F.explode(methods).alias("x")).select("asset_id", "day", "x.*")


def _stub(texts):
    return ["trade" if len(t) % 3 == 0 else "" if len(t) % 3 == 1 else "NOT A TYPE" for t in texts]


@register("t22_provider_fallback", f"WITH {RQ.SCAN} SELECT article_id, CASE WHEN event_type = 'OTHER' AND reason = 'unmapped' AND (article_id % 10 = 0 OR length(title) % 3 = 0) THEN CASE WHEN article_id % 10 = 0 THEN 'DEAL' ELSE 'TRADE' END ELSE event_type END AS event_type, CASE WHEN event_type = 'OTHER' AND reason = 'unmapped' THEN CASE WHEN article_id % 10 = 0 THEN 'cache' WHEN length(title) % 3 = 0 THEN 'provider' ELSE 'rules' END ELSE 'rules' END AS answered_by FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY article_id) AS k FROM dec) WHERE k = 1")
def t22(spark, sf):
    """Articles that no rule types are asked of a provider, here a stand-in; cached answers are not asked again."""
    c = RQ.classified(spark, sf).withColumn("allow_llm", (F.col("event_type") == "OTHER") & (F.col("reason") == "unmapped"))
    c = materialize(c.withColumn("k", F.row_number().over(Window.partitionBy("title").orderBy("article_id"))).filter("k = 1").select("article_id", "title", "event_type", "allow_llm"), "typed")
    cache = c.filter("allow_llm and article_id % 10 = 0").select(H.identity("stub", "title").alias("key"), F.lit("DEAL").alias("answer"))
    return H.classify_rest(c, ["TRADE", "DEAL"], _stub, cache, "stub")[0].select("article_id", "event_type", "answered_by")


# --- graph and learning ---


@register("p04_contributing_filter", GQ.CHAIN + f", c AS (SELECT e.asset_id, time_bucket(INTERVAL 15 MINUTE, e.ts) AS window_start, e.event_id, k.factor IS NOT NULL AS fired FROM ev e LEFT JOIN (SELECT DISTINCT asset_id, window_start, factor FROM kept) k ON k.asset_id = e.asset_id AND k.factor = e.factor AND k.window_start = time_bucket(INTERVAL 15 MINUTE, e.ts)) SELECT asset_id, {GQ.ts('window_start')} AS window_start, CASE WHEN bool_or(fired) THEN count(*) FILTER (fired) ELSE count(*) END::BIGINT AS n_events, NOT bool_or(fired) AS fell_back FROM c GROUP BY ALL")
def p04(spark, sf):
    """A context's events of factors that fire an edge; all of them where none does."""
    kept = G.resolve(GQ.fire(spark, sf).join(G.elevated(X.closes(spark, sf)), "asset_id", "left")).select("asset_id", "window_start", "factor", F.lit(True).alias("fired")).distinct()
    e = X.events(spark, sf).select("asset_id", F.window("ts", "15 minutes")["start"].alias("window_start"), "factor", "event_id").join(kept, ["asset_id", "window_start", "factor"], "left")
    fired = F.count("fired")
    g = e.groupBy("asset_id", "window_start").agg(F.when(fired > 0, fired).otherwise(F.count(F.lit(1))).alias("n_events"), (fired == 0).alias("fell_back"))
    return g.withColumn("window_start", X.stamp("window_start"))


UP_SAMPLES = GQ.SCORED + ", " + X.CORRELATIONS + """, ret AS (SELECT *, close / lag(close) OVER (PARTITION BY asset_id ORDER BY session) - 1 AS x FROM closes), vol AS (SELECT asset_id, coalesce(stddev_pop(x), 0) AS volatility FROM ret GROUP BY asset_id),
smp AS (SELECT s.asset_id AS source, k.condition, k.target, s.window_start, e.close / b.close - 1 AS r, v.volatility > 0 AND abs(e.close / b.close - 1) >= 2 * v.volatility AS is_abnormal FROM sc s JOIN correlations k ON k.source = s.asset_id AND k.condition = 'UPSTREAM_' || s.direction
  JOIN closes b ON b.asset_id = k.target AND b.session = s.baseline JOIN closes e ON e.asset_id = k.target AND e.session = s.settlement JOIN vol v ON v.asset_id = k.target WHERE s.direction <> 'NEUTRAL')"""


def upstream_samples(spark, sf):
    """Decisions up the correlation edges: the target's return between the decision's sessions."""
    c = X.closes(spark, sf)
    k = X.edge_tables(spark, sf)["correlations"].select(F.col("source").alias("asset_id"), "condition", "target")
    s = GQ.scored(spark, sf).filter("direction <> 'NEUTRAL'").select("asset_id", "window_start", "baseline", "settlement", F.concat(F.lit("UPSTREAM_"), "direction").alias("condition"))
    at = lambda role: c.select(F.col("asset_id").alias("target"), F.col("session").alias(role), F.col("close").alias(f"{role}_close"))
    j = s.join(k, ["asset_id", "condition"]).join(at("baseline"), ["target", "baseline"]).join(at("settlement"), ["target", "settlement"]).join(L.volatility(c).withColumnRenamed("asset_id", "target"), "target")
    r = F.col("settlement_close") / F.col("baseline_close") - 1
    return j.select(F.col("asset_id").alias("source"), "condition", "target", "window_start", r.alias("r"), S.abnormal(r, F.col("volatility")).alias("is_abnormal"))


@register("l02_correlation_samples", UP_SAMPLES + f" SELECT source, condition, target, {GQ.ts('window_start')} AS window_start, round(r, 8) AS r, is_abnormal FROM smp")
def l02(spark, sf):
    return upstream_samples(spark, sf).withColumn("window_start", X.stamp("window_start")).withColumn("r", F.round("r", 8))


@register("l05_source_credit", GQ.SCORED + """, u AS (SELECT DISTINCT s.asset_id || '|' || s.window_start AS p, lower(trim('Src' || (e.event_id % 6))) AS source, s.direction = s.actual AS ok FROM sc s JOIN ev e ON e.asset_id = s.asset_id AND time_bucket(INTERVAL 15 MINUTE, e.ts) = s.window_start WHERE s.actual IS NOT NULL),
c AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY p) AS credit FROM u) SELECT source, round(greatest(1 + sum(CASE WHEN ok THEN credit ELSE 0 END), 1), 6)::DOUBLE AS alpha, round(greatest(1 + sum(CASE WHEN ok THEN 0 ELSE credit END), 1), 6)::DOUBLE AS beta FROM c GROUP BY source""")
def l05(spark, sf):
    e = X.events(spark, sf).select("asset_id", F.window("ts", "15 minutes")["start"].alias("window_start"), F.concat(F.lit(" Src"), F.col("event_id") % 6).alias("source"))
    s = GQ.scored(spark, sf).filter("actual is not null").select("asset_id", "window_start", (F.col("direction") == F.col("actual")).alias("is_correct"))
    j = s.join(e, ["asset_id", "window_start"]).withColumn("prediction_id", F.concat_ws("|", "asset_id", "window_start"))
    return L.source_credits(j).select("source", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"))


@register("l06_process_once", "WITH m AS (SELECT o_orderkey AS prediction_id, CASE WHEN o_orderstatus = 'P' THEN 'WITHDRAWN' ELSE 'SCORED' END AS status FROM orders WHERE o_orderkey % 3 < 2) SELECT DISTINCT prediction_id, status <> 'WITHDRAWN' AS applied FROM m WHERE prediction_id % 5 <> 0")
def l06(spark, sf):
    o = X.read(spark, sf, "orders").select(F.col("o_orderkey").alias("prediction_id"), F.when(F.col("o_orderstatus") == "P", "WITHDRAWN").otherwise("SCORED").alias("status"))
    m = o.filter("prediction_id % 3 < 2")
    return L.claimed(m.unionByName(m.filter("prediction_id % 2 = 0")), o.filter("prediction_id % 5 = 0")).select("prediction_id", "applied")


both("l07_edge_state", lambda d: """SELECT k.factor, k.target, coalesce(k.condition, '-') AS condition, s.alpha, s.beta, s.target IS NOT NULL AS found FROM (SELECT factor, target, condition FROM {causes} UNION ALL SELECT factor, target, 'GONE' FROM {causes} WHERE condition IS NULL) k
  LEFT JOIN {causes} s ON s.factor = k.factor AND s.target = k.target AND s.condition IS NOT DISTINCT FROM k.condition""")


@register("l08_missing_edges", "WITH " + X.CAUSES + """, up AS (SELECT factor, target, condition, weight / 2 AS nw FROM causes WHERE direction = 'UP' UNION ALL SELECT factor, 'A99', condition, weight FROM causes WHERE direction = 'DOWN')
SELECT 'WRITTEN' AS outcome, c.factor, c.target, coalesce(c.condition, '-') AS condition, coalesce(u.nw, c.weight) AS weight FROM causes c LEFT JOIN up u ON u.factor = c.factor AND u.target = c.target AND u.condition IS NOT DISTINCT FROM c.condition UNION ALL SELECT 'MISSING_EDGE', factor, target, coalesce(condition, '-'), nw FROM up WHERE target = 'A99'""")
def l08(spark, sf):
    """Weights are written where the edge exists; the others come back as errors."""
    c = X.edge_tables(spark, sf)["causes"].select("factor", "target", "condition", "direction", "weight")
    up = c.filter("direction = 'UP'").select("factor", "target", "condition", (F.col("weight") / 2).alias("new_weight")).unionByName(c.filter("direction = 'DOWN'").select("factor", F.lit("A99").alias("target"), "condition", F.col("weight").alias("new_weight")))
    written, missing = L.write_weights(c, up, ["factor", "target", "condition"])
    row = lambda df, outcome, w: df.select(F.lit(outcome).alias("outcome"), "factor", "target", F.coalesce("condition", F.lit("-")).alias("condition"), F.col(w).alias("weight"))
    return row(written, "WRITTEN", "weight").unionByName(row(missing, "MISSING_EDGE", "new_weight"))


@register("l10_learner_run", UP_SAMPLES + ", " + GQ.ESTIMATE.split("samples AS (", 1)[1].join(["esamples AS (", ""]).replace("FROM samples GROUP", "FROM esamples GROUP").replace("FROM ev e JOIN nexts", "FROM ev e JOIN (SELECT asset_id, session, lead(close) OVER (PARTITION BY asset_id ORDER BY session) / close - 1 AS r FROM closes)") + """,
g AS (SELECT source, condition, target, count(*) AS n, avg(r) AS mean, bool_or(is_abnormal) AS ab FROM smp GROUP BY ALL), new AS (
SELECT 'CAUSES' AS kind, factor AS source, condition, asset_id AS target, direction FROM est e WHERE direction <> 'NEUTRAL' AND condition <> '-' AND NOT EXISTS (SELECT 1 FROM causes c WHERE c.factor = e.factor AND c.target = e.asset_id AND c.condition = e.condition)
UNION ALL SELECT 'CORRELATES_WITH', source, condition, target, CASE WHEN mean > 0.002 THEN 'UP' ELSE 'DOWN' END FROM g WHERE n >= CASE WHEN ab THEN 2 ELSE 5 END AND abs(mean) > 0.002 AND NOT EXISTS (SELECT 1 FROM correlations k WHERE k.source = g.source AND k.target = g.target AND k.condition = g.condition))
SELECT *, count(*) OVER (PARTITION BY kind)::BIGINT AS created FROM new""")
def l10(spark, sf):
    """Both kinds of samples built, estimated and written, with the number of edges created."""
    t = X.edge_tables(spark, sf)
    s = GQ.samples(spark, sf).withColumnRenamed("asset_id", "target")
    created, report = L.learn_edges(s, t["causes"], upstream_samples(spark, sf).drop("window_start"), t["correlations"])
    return created.join(F.broadcast(report), "kind").select("kind", "source", "condition", "target", "direction", "created")  # two rows


@register("x15_correlation_credit", UP_SAMPLES + """, cr AS (SELECT source || '->' || target || '|' || condition AS edge_id, window_start, 1.0::DOUBLE / count(*) OVER (PARTITION BY source, window_start) AS credit, (condition = 'UPSTREAM_UP') = (r > 0) AS ok FROM smp),
st AS (SELECT edge_id, list(CASE WHEN ok THEN 0.02 ELSE -0.02 END::DOUBLE * credit ORDER BY window_start) AS steps FROM cr GROUP BY edge_id)
SELECT st.edge_id, round(list_reduce(steps, lambda w, x: least(1.0::DOUBLE, greatest(0.05::DOUBLE, w + x)), weight::DOUBLE), 6) AS weight FROM st JOIN correlations k ON st.edge_id = k.source || '->' || k.target || '|' || k.condition""")
def x15(spark, sf):
    """Credit of decisions to the correlation edges they passed, folded in order."""
    w = Window.partitionBy("source", "window_start")
    edge = F.concat("source", F.lit("->"), "target", F.lit("|"), "condition").alias("edge_id")
    weights = X.edge_tables(spark, sf)["correlations"].select(edge, "weight")
    c = upstream_samples(spark, sf).select(edge, F.col("window_start").alias("scored_at"), F.lit("").alias("prediction_id"), (1.0 / F.count(F.lit(1)).over(w)).alias("credit"), ((F.col("condition") == "UPSTREAM_UP") == (F.col("r") > 0)).alias("is_correct"))
    return L.fold_weights(c.join(weights, "edge_id")).select("edge_id", F.round("weight", 6).alias("weight"))


# --- streams ---


def _streamed(spark, sf, rows, flow):
    """Rows written as files in four parts and streamed through ``flow`` until all are read."""
    path = f"{scratch_dir(spark)}/causeway-stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    flows.run(flow(stream), flows.idempotent(f"{path}/out"), f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


def messages(spark, sf):
    e = X.events(spark, sf)
    return e.select(F.concat(F.lit("m"), "event_id").alias("message_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "asset_id", "factor", "tag", "polarity", "value")


@register("i01_message_dedup", "SELECT 'm' || event_id AS message_id, event_id FROM events")
def i01(spark, sf):
    """Deliveries, a third of them twice, streamed with the ids seen as state."""
    m = messages(spark, sf)
    out = _streamed(spark, sf, m.unionByName(m.filter("event_id % 3 = 0")).coalesce(1), lambda s: flows.once(s, "60 days"))
    return out.select("message_id", "event_id")


@register("i05_windows_with_grace", GQ.WITH + GQ.CTX + f" SELECT asset_id, {GQ.ts('window_start')} AS window_start, factor, array_to_string(tags, ',') AS tags, resolved, n_events::BIGINT AS n_events FROM ctx WHERE window_start + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM ev) - INTERVAL 5 MINUTE")
def i05(spark, sf):
    """Windows that the watermark, five minutes behind the latest event, has passed."""
    out = _streamed(spark, sf, messages(spark, sf).coalesce(1), flows.windowed)
    return out.select("asset_id", F.date_format("window_start", NTZ).alias("window_start"), "factor", F.array_join("tags", ",").alias("tags"), "resolved", "n_events")


@register("i03_online_clusters")
def i03(spark, sf):
    """Articles replayed ten minutes apart: cosine to running centroids, quiet and lifetime timers; deferred where members name different actors."""
    return C.online_clusters(arrivals(spark, sf), quiet="30 hours", lifetime="100 hours").withColumn("first_at", X.stamp("first_at")).withColumn("last_at", X.stamp("last_at"))


@register("i03_streamed_clusters")
def i03s(spark, sf):
    """The same rows from a stream: state by type, timers in event time. A row far in the future, of a type of its own, lets the watermark pass all others."""
    a = arrivals(spark, sf).withColumn("at", F.col("at").cast("timestamp"))
    last = X.articles(spark, sf).agg(F.max("article_id").alias("article_id"))  # its vector is never read
    clock = last.select("article_id", F.lit("CLOCK").alias("event_type"), (arrival("article_id").cast("timestamp") + F.expr("interval 30 days")).alias("at"), F.lit(None).cast("string").alias("actor"), F.array(F.lit(0).cast("float")).alias("vec"))
    out = _streamed(spark, sf, a.unionByName(clock), lambda s: online.cluster_stream(s, quiet="30 hours", lifetime="100 hours", delay="1 hour"))
    return out.withColumn("first_at", X.stamp("first_at")).withColumn("last_at", X.stamp("last_at"))


def arrival(article):
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col(article) * 10).cast("int"))


def arrivals(spark, sf):
    c = RQ.classified(spark, sf)
    return c.select("article_id", "event_type", arrival("article_id").alias("at"), F.try_element_at("company", F.lit(1)).alias("actor"), K.embed("body").alias("vec"))


@register("i04_cluster_events")
def i04(spark, sf):
    """One event for each cluster that the stream closes without conflict."""
    return online.cluster_events(i03s(spark, sf))


@register("i02_streamed_dedup", EQ.GREEDY)
def i02s(spark, sf):
    """The verdicts of the sequential pass, from documents that come as a stream in three parts, the second and third with stragglers of the one before."""
    at = (F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") * 10).cast("int"))).alias("at")
    docs = X.read(spark, sf, "documents")
    last = docs.agg(F.max("doc_id")).first()[0]
    part = F.floor(F.col("doc_id") * 3 / (last + 1))
    near_next = F.floor((F.col("doc_id") + 5) * 3 / (last + 1)) > part
    dealt = docs.select(F.col("doc_id").alias("id"), at, "text", F.when(near_next & (F.col("doc_id") % 2 == 0), F.least(F.lit(2), part + 1)).otherwise(part).alias("part"))
    path = f"{scratch_dir(spark)}/causeway-stream-{uuid.uuid4().hex}"
    clock = spark.range(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit("2100-01-01").cast("timestamp").alias("at"), F.lit("").alias("text"))
    for k in range(4):
        rows = dealt.filter(F.col("part") == k).drop("part") if k < 3 else clock
        rows.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("id bigint, at timestamp, text string").parquet(f"{path}/in")
        flows.run(stream, greedy.greedy_sink(f"{path}/state"), f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("id bigint, kept boolean").parquet(f"{path}/state/verdicts").select("id", "kept")


@register("i09_tombstones", GQ.SCORED + f", n AS (SELECT asset_id, window_start, actual, settlement, lead(window_start) OVER (PARTITION BY asset_id ORDER BY window_start) + INTERVAL 15 MINUTE AS superseded_at FROM sc) SELECT asset_id, {GQ.ts('window_start')} AS window_start, superseded_at IS NOT NULL AND superseded_at <= settlement::TIMESTAMP + INTERVAL 16 HOUR AS skipped FROM n WHERE actual IS NOT NULL")
def i09(spark, sf):
    """A score meets the earliest notice that its decision was superseded, whichever came first: tombstones are kept by decision, notices may come twice."""
    s = GQ.scored(spark, sf)
    after = F.lead("window_start").over(Window.partitionBy("asset_id").orderBy("window_start")) + F.expr("interval 15 minutes")
    notice = s.select("asset_id", "window_start", after.alias("superseded_at")).filter("superseded_at is not null")
    late = notice.filter("minute(window_start) = 0").withColumn("superseded_at", F.col("superseded_at") + F.expr("interval 9 days"))
    tombs = notice.unionByName(late).groupBy("asset_id", "window_start").agg(F.min("superseded_at").alias("superseded_at"))
    over = F.col("superseded_at") <= F.col("settlement").cast("timestamp_ntz") + F.expr("interval 16 hours")
    return s.filter("actual is not null").join(tombs, ["asset_id", "window_start"], "left").select("asset_id", X.stamp("window_start").alias("window_start"), F.coalesce(over, F.lit(False)).alias("skipped"))


both("v05_shadow_sweep", lambda d: f"""SELECT asset_id, {d.stamp("closes_at")} AS closes_at, n, CASE WHEN n < 2 THEN 'INSUFFICIENT_SAMPLES' WHEN {"hi / lo - 1 >= 0.003" if d.duck else "CASE WHEN lo = 0 THEN true ELSE hi / lo - 1 >= 0.003 END"} THEN 'TARGET_REACHED' ELSE 'NOT_REACHED' END AS outcome FROM (
  SELECT p.asset_id, p.closes_at, count(s.sample_id) AS n, max(s.price) AS hi, min(s.price) AS lo FROM (SELECT asset_id, closes_at FROM (SELECT DISTINCT asset_id, closes_at FROM {{samples}}) k WHERE closes_at + INTERVAL 600 SECOND <= {d.at("2024-01-20 12:00:00")} ORDER BY closes_at, asset_id LIMIT 100) p
  LEFT JOIN {{samples}} s ON s.asset_id = p.asset_id AND s.closes_at = p.closes_at AND s.received_at <= p.closes_at + INTERVAL 600 SECOND AND s.quality = 'FRESH' GROUP BY p.asset_id, p.closes_at) t""")

def _email(alerts: list[dict]) -> None:
    if not all(a["asset_id"] for a in alerts):
        raise ValueError("an alert without an asset")


def _messenger(alerts: list[dict]) -> None:
    raise ConnectionError("no route")


ALERT = "magnitude = 'LARGE' AND direction <> 'NEUTRAL'"


@register("b11_alert_dispatch", GQ.CHAIN + f" SELECT channel, (SELECT count(*) FROM decided WHERE {ALERT})::BIGINT AS n, channel = 'messenger' AS failed FROM (VALUES ('email'), ('messenger')) v(channel)")
def b11(spark, sf):
    """Alerts of strong decisions, streamed to two channels; one is down, and the log tells so."""
    path = f"{scratch_dir(spark)}/causeway-alerts-{uuid.uuid4().hex}"
    rows = GQ.decided(spark, sf).filter(ALERT).select("asset_id", F.col("window_start").cast("timestamp").alias("at"), "direction", "magnitude", "confidence")
    rows.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    flows.run(stream, H.notify({"email": _email, "messenger": _messenger}, f"{path}/log"), f"{path}/checkpoint").awaitTermination()
    log = spark.read.schema("channel string, n bigint, error string").parquet(f"{path}/log")
    return log.groupBy("channel").agg(F.sum("n").alias("n"), F.bool_or(F.col("error").isNotNull()).alias("failed"))


def _subject_verb_object(titles, bodies):
    """An extractor: the first three words."""
    found = [re.findall(r"\w+", t) + [None] * 3 for t in titles]
    return [(w[0], (w[1] or "OTHER").lower(), w[2]) for w in found]


@register("u02_action_extractors", f"WITH {RQ.SCAN}, w AS (SELECT *, regexp_extract_all(title, '[\\p{{L}}\\p{{N}}_]+') AS w FROM dec) SELECT article_id, 'pluggable' AS extractor, w[1] AS actor, lower(coalesce(w[2], 'OTHER')) AS action_lemma, w[3] AS object, event_type FROM w UNION ALL SELECT article_id, 'keyword', NULL, coalesce(keyword, 'OTHER'), NULL, event_type FROM dec")
def u02(spark, sf):
    """Actions by an extractor that the caller supplies, and by keyword where none is."""
    c = RQ.classified(spark, sf)
    told = lambda name, df: df.select("article_id", F.lit(name).alias("extractor"), "actor", "action_lemma", "object", "event_type")
    return told("pluggable", H.extract_actions(c, _subject_verb_object)).unionByName(told("keyword", H.extract_actions(c)))


# --- storage and read models ---


@register("x03_keyed_inserts", "SELECT doc_id, kind, NOT (kind = 'label' AND doc_id % 4 = 0) AS inserted FROM (SELECT DISTINCT doc_id, 'label' AS kind FROM labels UNION ALL SELECT doc_id, 'document' FROM documents)")
def x03(spark, sf):
    """Children under (parent, kind): a repeated row or one that the target has is not inserted again."""
    rows = X.read(spark, sf, "labels").select("doc_id", F.lit("label").alias("kind")).unionByName(X.read(spark, sf, "documents").select("doc_id", F.lit("document").alias("kind")))
    target = rows.filter("kind = 'label' and doc_id % 4 = 0").distinct()
    return D.insert_new(rows, target, ["doc_id", "kind"]).withColumn("inserted", F.lit(True)).unionByName(target.withColumn("inserted", F.lit(False)))


@register("x05_split_targets", "WITH " + X.EVENTS + ", " + X.SAMPLES + ", r AS (SELECT asset_id, session, max(CASE WHEN kind = 'CLOSE' THEN price END) AS sampled, arg_max(price, sample_id) AS price FROM samples GROUP BY ALL) SELECT asset_id, session::VARCHAR AS session, CASE WHEN sampled IS NOT NULL THEN 'sampled_closes' ELSE 'daily_closes' END AS target, coalesce(sampled, price) AS close FROM r")
def x05(spark, sf):
    """Requests registered once; closes upserted to one of two tables by whether a sample is the evidence."""
    s = X.samples(spark, sf)
    requests = D.insert_new(s.select("asset_id", "session"), s.select("asset_id", "session").limit(0), ["asset_id", "session"])
    r = s.groupBy("asset_id", "session").agg(F.max(F.when(F.col("kind") == "CLOSE", F.col("price"))).alias("sampled"), F.max_by("price", "sample_id").alias("price")).join(requests, ["asset_id", "session"], "left_semi")
    return r.select("asset_id", F.col("session").cast("string"), F.when(F.col("sampled").isNotNull(), "sampled_closes").otherwise("daily_closes").alias("target"), F.coalesce("sampled", "price").alias("close"))


@register("x12_evidence_stamp", "SELECT doc_id, sha256(text) AS evidence_hash, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '2024-02-01 00:00:00' END AS available_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY text) AS k FROM documents) WHERE k = 1")
def x12(spark, sf):
    """Evidence is saved once; what was committed gets the time from which it is available."""
    e = X.read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("evidence_hash"))
    saved = materialize(D.insert_new(e.unionByName(e), e.limit(0), ["doc_id"]), "evidence")
    committed = saved.filter("doc_id % 7 <> 0").select("doc_id", F.lit("2024-02-01 00:00:00").alias("available_at"))
    return saved.join(committed, "doc_id", "left")


@register("x13_prediction_relay", "SELECT o_orderkey, o_orderkey % 11 <> 5 AS delivered, true AS attempted FROM orders WHERE o_orderstatus = 'P'")
def x13(spark, sf):
    """Pending rows relayed with the time of the attempt; one that fails doesn't hold up the others."""
    o = X.read(spark, sf, "orders").filter("o_orderstatus = 'P'").select("o_orderkey")
    return flows.relayed(o, F.col("o_orderkey") % 11 == 5).select("o_orderkey", (F.col("status") == "DELIVERED").alias("delivered"), F.col("attempted_at").isNotNull().alias("attempted"))


@register("x14_point_reports", "WITH " + X.EVENTS + ", " + X.SAMPLES + " SELECT sample_id, asset_id, round(price, 4) AS price, quality = 'FRESH' AS fresh FROM samples WHERE asset_id = 'A3'")
def x14(spark, sf):
    """Reports stored as JSON, read by asset and decoded."""
    body = F.to_json(F.struct(F.round("price", 4).alias("price"), F.struct((F.col("quality") == "FRESH").alias("fresh")).alias("flags")))
    stored = X.samples(spark, sf).select("sample_id", "asset_id", body.alias("report"))
    got = stored.filter("asset_id = 'A3'").withColumn("r", F.from_json("report", "price double, flags struct<fresh:boolean>"))
    return got.select("sample_id", "asset_id", "r.price", "r.flags.fresh")


both("x16_provenance", lambda d: f"SELECT sample_id, {d.stamp(f'least(scheduled_at + {d.seconds('interval_seconds')}, closes_at)')} AS expires_at, concat(kind, '/', quality, '/', mapping_version) AS provenance FROM {{samples}}")
both("x17_session_reads", lambda d: f"""SELECT s.asset_id, cast(s.session AS string) AS session, s.samples, s.open, s.high, s.low, s.close, 48 - s.slots AS missing, row_number() OVER (PARTITION BY s.asset_id ORDER BY s.session DESC) <= 5 AS recent, g.minutes FROM (SELECT asset_id, session, count(*) AS samples, min_by(price, observed_at) AS open, max(price) AS high, min(price) AS low, max_by(price, observed_at) AS close, count(DISTINCT scheduled_at) AS slots FROM {{samples}} GROUP BY asset_id, session) s
  JOIN (SELECT asset_id, session, count(DISTINCT minute_) AS minutes FROM (SELECT asset_id, session, date_trunc('minute', observed_at) + {d.seconds("k * 60")} AS minute_, closes_at FROM {{samples}} CROSS JOIN (SELECT {d.steps("0", "9", "1")} AS k) m) x WHERE minute_ < closes_at GROUP BY asset_id, session) g ON g.asset_id = s.asset_id AND g.session = s.session""")


@register("x20_stream_identity", "WITH " + X.EVENTS + ", " + X.SAMPLES + ", k AS (SELECT DISTINCT asset_id, session::VARCHAR AS session FROM samples), h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(asset_id || '|' || session)) AS x FROM k) SELECT asset_id, session, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', ('0x' || substr(x, 17, 1))::INT % 4 + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS stream_id FROM h")
def x20(spark, sf):
    """One stream for each asset and session, however often it is asked for, under a name-based id."""
    k = X.samples(spark, sf).select("asset_id", F.col("session").cast("string").alias("session")).distinct()
    return k.withColumn("stream_id", T.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.concat_ws("|", "asset_id", "session")))


both("x21_job_transitions", lambda d: f"""SELECT j.asset_id, {d.stamp("j.slot_at")} AS slot_at, CASE WHEN s.n > 0 THEN 'SAVED' WHEN j.slot_at + INTERVAL 2 MINUTE < {d.at("2024-01-17 12:00:00")} THEN 'EXPIRED' WHEN j.slot_at <= {d.at("2024-01-17 12:00:00")} THEN 'DUE' ELSE 'SCHEDULED' END AS state, {d.stamp(f"greatest(j.slot_at, {d.at('2024-01-17 11:00:00')})")} AS not_before
  FROM (SELECT asset_id, opens_at + {d.seconds("slot")} AS slot_at FROM (SELECT asset_id, opens_at, {d.steps("0", "28200", "600")} AS slot FROM (SELECT DISTINCT asset_id, opens_at FROM {{samples}} WHERE session = DATE '2024-01-17') a) b) j
  LEFT JOIN (SELECT asset_id, scheduled_at, count(*) AS n FROM {{samples}} WHERE quality = 'FRESH' GROUP BY asset_id, scheduled_at) s ON s.asset_id = j.asset_id AND s.scheduled_at = j.slot_at""")


@register("x24_allowed_urls", "SELECT page_id, CASE page_id % 6 WHEN 4 THEN false WHEN 5 THEN false WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE true END AS allowed, CASE page_id % 4 WHEN 0 THEN page_id WHEN 1 THEN 3600 WHEN 2 THEN 0 ELSE -1 END AS wait FROM pages")
def x24(spark, sf):
    """https on an allowed host or below it; seconds to wait by a header, a number or a date."""
    k = F.col("page_id")
    pick = lambda n, *xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    url = pick(6, "https://q.example/a", "http://q.example/a", "https://m.q.example/b?x=1", "https://user@q.example/", "https://q.example:8443/", "https://evilq.example/")
    header = pick(4, k.cast("string"), "Wed, 17 Jan 2024 13:00:00 GMT", "Wed, 17 Jan 2024 11:00:00 GMT", "later")
    return X.read(spark, sf, "pages").select("page_id", R.allowed_url(url, ("q.example",)).alias("allowed"), R.retry_after(header, F.expr("timestamp_ntz'2024-01-17 12:00:00'")).alias("w")).withColumn("wait", F.coalesce("w", F.lit(-1))).drop("w")


both("x25_read_endpoints", lambda d: f"""SELECT 'ohlc' AS view_, asset_id, cast(session AS string) AS at, max_by(price, observed_at) AS value FROM {{samples}} GROUP BY asset_id, session
  UNION ALL SELECT 'minutes', asset_id, {d.stamp("date_trunc('minute', observed_at)")}, max_by(price, observed_at) FROM {{samples}} WHERE session = DATE '2024-01-17' GROUP BY asset_id, date_trunc('minute', observed_at)
  UNION ALL SELECT 'status', asset_id, {d.stamp("max(observed_at)")}, cast(count(*) AS double) FROM {{samples}} GROUP BY asset_id
  UNION ALL SELECT 'recent', asset_id, session, close FROM (SELECT asset_id, cast(session AS string) AS session, close, row_number() OVER (PARTITION BY asset_id ORDER BY session DESC) AS k FROM {{closes}}) t WHERE k <= 3""")


@register("x27_tracking_filter", "WITH p AS (SELECT page_id, unnest(string_split('utm_source=a&id=' || page_id || '&fbclid=z&Ref=q&q=', '&')) AS pair FROM pages) SELECT page_id, string_agg(pair, '&' ORDER BY pair) AS kept FROM p WHERE NOT starts_with(lower(split_part(pair, '=', 1)), 'utm_') AND lower(split_part(pair, '=', 1)) NOT IN (" + RQ.quoted(T.TRACKING_KEYS) + ") GROUP BY page_id")
def x27(spark, sf):
    pairs = F.split(F.concat(F.lit("utm_source=a&id="), "page_id", F.lit("&fbclid=z&Ref=q&q=")), "&")
    key = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    kept = F.filter(pairs, lambda p: ~key(p).isin(*T.TRACKING_KEYS) & ~key(p).startswith(T.TRACKING_PREFIX))
    return X.read(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(kept), "&").alias("kept"))


def _model(texts):
    return [[float(len(t)), 3.0, 4.0] for t in texts]


@register("x28_model_embedder", "SELECT doc_id, 3 AS dims, round(length(text) / sqrt(length(text) * length(text) + 25.0), 2)::DOUBLE AS first FROM documents")
def x28(spark, sf):
    """A model that the caller supplies, its vectors scaled to length 1; here a stand-in."""
    v = X.read(spark, sf, "documents").select("doc_id", K.embedder(_model)(F.col("text")).alias("v"))
    return v.select("doc_id", F.size("v").alias("dims"), F.round(F.col("v")[0].cast("double"), 2).alias("first"))


@register("x29_prompt_excerpt", A + """, k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, article_id DESC) AS k FROM articles) SELECT source_id, string_agg(article_id::VARCHAR || ':' || length(left(body, 300))::VARCHAR, ',' ORDER BY k) AS excerpts FROM k WHERE k <= 3 GROUP BY source_id""")
def x29(spark, sf):
    """A prompt for each source: its three newest articles, cut to 300 characters, as JSON; read back to show what it holds."""
    w = Window.partitionBy("source_id").orderBy(F.desc("published_at"), F.desc("article_id"))
    top = X.articles(spark, sf).withColumn("k", F.row_number().over(w)).filter("k <= 3")
    prompt = top.groupBy("source_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("k", "article_id", F.left("body", F.lit(300)).alias("excerpt")))), lambda x: F.struct(x["article_id"].alias("id"), x["excerpt"].alias("excerpt")))).alias("prompt"))
    back = F.from_json("prompt", "array<struct<id:bigint,excerpt:string>>")
    return prompt.select("source_id", F.array_join(F.transform(back, lambda x: F.concat_ws(":", x["id"].cast("string"), F.length(x["excerpt"]).cast("string"))), ",").alias("excerpts"))


@register("x32_graph_seed", "WITH " + X.MEMBERS + " SELECT 'NODE' AS kind, asset_id AS a, 'Asset' AS b FROM members UNION SELECT 'NODE', group_id, 'AssetGroup' FROM members UNION SELECT 'MEMBER_OF', asset_id, group_id FROM members UNION SELECT 'FAULT', asset_id, 'NO_SYMBOL' FROM members WHERE substr(asset_id, 2)::INT % 10 = 9")
def x32(spark, sf):
    """Nodes, membership edges and faults from a registry of groups with arrays of assets."""
    m = X.edge_tables(spark, sf)["members"]
    symbol = F.when(F.substring("asset_id", 2, 4).cast("int") % 10 != 9, F.concat(F.lit("S"), "asset_id"))
    registry = m.groupBy("group_id").agg(F.collect_list(F.struct("asset_id", symbol.alias("provider_symbol"), F.lit("SEK").alias("currency"), F.lit(None).cast("string").alias("fallback"))).alias("assets"))
    assets = registry.select("group_id", F.explode("assets").alias("x")).select("group_id", "x.*")
    row = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    out = row(assets, "NODE", F.col("asset_id"), F.lit("Asset")).unionByName(row(registry, "NODE", F.col("group_id"), F.lit("AssetGroup"))).unionByName(row(assets, "MEMBER_OF", F.col("asset_id"), F.col("group_id")))
    return out.unionByName(row(R.registry_faults(assets), "FAULT", F.col("key"), F.col("rule")))


@register("x34_trial_budget", "WITH t AS (SELECT doc_id, lang, sha256('m1|' || text) AS key, ceil(length(text) / 4.0)::BIGINT AS n FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS k FROM t), u AS (SELECT doc_id, n, lang, sum(n) OVER (PARTITION BY lang ORDER BY doc_id)::BIGINT AS used FROM f WHERE k = 1 AND doc_id % 4 <> 0) SELECT doc_id, CASE WHEN used <= 20000 THEN 'ASK' ELSE 'OVER_BUDGET' END AS plan, used FROM u UNION ALL SELECT doc_id, CASE WHEN k > 1 THEN 'REPEAT' ELSE 'CACHED' END, 0 FROM f WHERE k > 1 OR doc_id % 4 = 0")
def x34(spark, sf):
    """A dry run: repeats and cached questions cost nothing, the others use a budget for each language in order."""
    t = X.read(spark, sf, "documents").select("doc_id", "lang", F.sha2(F.concat(F.lit("m1|"), "text"), 256).alias("key"), F.ceil(F.length("text") / 4.0).cast("bigint").alias("n"))
    first = t.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    f = t.join(first, ["key", "doc_id"], "left").withColumn("new", F.when(F.col("is_first") & (F.col("doc_id") % 4 != 0), F.col("n")))
    u = folds.running_sums(f.select("doc_id", "lang", "is_first", "new"), ["lang"], ["doc_id"], "new", "spent")
    plan = F.when(F.col("is_first").isNull(), "REPEAT").when(F.col("doc_id") % 4 == 0, "CACHED").when(F.col("spent") <= 20000, "ASK").otherwise("OVER_BUDGET")
    return u.select("doc_id", plan.alias("plan"), F.when(F.col("new").isNotNull(), F.col("spent")).otherwise(0).alias("used"))


@register("x35_corpus_identity", "WITH " + TQ.URL + ", c AS (SELECT page_id, scheme || '://' || h || p || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS u FROM v), all_ AS (SELECT page_id, u FROM c UNION ALL SELECT page_id + 1000000, u FROM c) SELECT sha256(u) AS id, min(page_id) AS page_id, count(*)::BIGINT AS seen FROM all_ GROUP BY u")
def x35(spark, sf):
    """The first page of each canonical URL wins, over two collections."""
    c = X.read(spark, sf, "pages").select("page_id", T.canonical_url(F.col("url")).alias("u"))
    both_ = c.unionByName(c.withColumn("page_id", F.col("page_id") + 1_000_000))
    return both_.groupBy(F.sha2("u", 256).alias("id")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("seen"))


@register("x36_column_backfill", "SELECT doc_id, lang, 0 AS depth, 'v1' AS schema_version, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'unknown' END AS source FROM documents")
def x36(spark, sf):
    """Old rows, which lack columns or values, read under today's schema with defaults; reading twice changes nothing."""
    old = X.read(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source"))
    once = R.with_schema(old, "doc_id bigint, lang string, depth int, schema_version string, source string", {"depth": 0, "schema_version": "v1", "source": "unknown"})
    return R.with_schema(once, "doc_id bigint, lang string, depth int, schema_version string, source string", {"depth": 0, "schema_version": "v1", "source": "unknown"})
