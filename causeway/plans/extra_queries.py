"""Queries of readers, cleaning, statistics, stance and streams. Those without SQL are checked by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import clean as K
from causeway.functions import statistics as B
from causeway.functions import text as T
from causeway.operators import dedup as D
from causeway.operators import stance
from causeway.operators import graph as G
from causeway.plans import graph_queries as GQ
from causeway.plans import text_queries as TQ
from causeway.plans.registry import register
from causeway.plans.relational_queries import statement
from causeway.scratch import materialize
from causeway.sources import fixtures as X
from causeway.sources import readers as R


@register("h04_clean_text")
def h04(spark, sf):
    return X.read(spark, sf, "pages").select("page_id", K.clean_text("html").alias("text"))


@register("h06_assess_text")
def h06(spark, sf):
    cleaned = X.articles(spark, sf).select("article_id", K.clean_text("body").alias("t"))
    return K.assess_text(cleaned, "article_id", "t").select("article_id", "status", F.array_join("reasons", ",").alias("reasons"))


@register("h11_blake_hash")
def h11b(spark, sf):
    return X.articles(spark, sf).select(F.explode(T.tokens(F.col("title"))).alias("token")).distinct().select("token", K.blake_hash("token").alias("h"))


@register("h14_hashing_embedder")
def h14(spark, sf):
    a = X.articles(spark, sf)
    return a.select("article_id", K.embed(F.concat_ws(" ", "title", "body")).alias("v"))


@register("h26_beta_interval")
def h26(spark, sf):
    t = X.edge_tables(spark, sf)["causes"].select("factor", "target", B.beta_interval("alpha", "beta").alias("ci"))
    return t.select("factor", "target", F.round("ci.lower", 6).alias("lower"), F.round("ci.upper", 6).alias("upper"))


@register("l09_history", None)
def l09(spark, sf):
    t = X.edge_tables(spark, sf)["causes"].select("factor", "target", "alpha", "beta", (F.col("alpha") + 1).alias("alpha_after"), "weight")
    return t.withColumn("ci", B.beta_interval("alpha_after", "beta")).select("factor", "target", "alpha", "alpha_after", F.col("ci.lower").alias("ci_lower"), F.col("ci.upper").alias("ci_upper"), "weight")


STANCE = GQ.CHAIN.replace("WITH ", "WITH RECURSIVE ", 1) + """, st AS (SELECT asset_id, window_start + INTERVAL 15 MINUTE AS decision_at, direction, isodow(window_start + INTERVAL 15 MINUTE) < 6 AS opened, row_number() OVER (PARTITION BY asset_id ORDER BY window_start) AS k FROM decided WHERE direction <> 'NEUTRAL'),
fold(asset_id, k, decision_at, direction, outcome, n, active) AS (SELECT asset_id, k, decision_at, direction, 'STORED', 1, direction FROM st WHERE k = 1 UNION ALL SELECT s.asset_id, s.k, s.decision_at, s.direction, o.outcome, CASE WHEN o.outcome = 'STORED' THEN o.today + 1 ELSE o.today END, CASE WHEN o.outcome = 'DAILY_CAP' THEN o.active ELSE s.direction END FROM (
  SELECT f.asset_id, f.k, f.active, CASE WHEN s.opened AND f.active = s.direction THEN 'SAME_DIRECTION' WHEN s.opened AND CASE WHEN s.decision_at::DATE = f.decision_at::DATE THEN f.n ELSE 0 END >= 2 THEN 'DAILY_CAP' WHEN s.opened THEN 'STORED' ELSE 'SUPERSEDES' END AS outcome, CASE WHEN s.decision_at::DATE = f.decision_at::DATE THEN f.n ELSE 0 END AS today
  FROM fold f JOIN st s ON s.asset_id = f.asset_id AND s.k = f.k + 1) o JOIN st s ON s.asset_id = o.asset_id AND s.k = o.k + 1)
SELECT asset_id, strftime(decision_at, '%Y-%m-%d %H:%M:%S') AS decision_at, direction, outcome FROM fold"""


@register("p05_stance_policy", STANCE)
def p05(spark, sf):
    d = GQ.decided(spark, sf).filter("direction <> 'NEUTRAL'").withColumn("decision_at", F.expr("window_start + interval 15 minutes"))
    return stance.apply_stance(d.select("asset_id", "decision_at", "direction", (F.weekday("decision_at") < 5).alias("open"), F.lit(False).alias("propagated"))).withColumn("decision_at", X.stamp("decision_at"))


@register("p06_two_pass_batch", GQ.PROPAGATE.rsplit(" SELECT context_id", 1)[0] + " SELECT asset_id, context_id, direction, 0 AS depth FROM direct WHERE direction <> 'NEUTRAL' UNION ALL SELECT asset_id, context_id, direction, depth FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)")
def p06(spark, sf):
    """All direct decisions first, then what they propagate to."""
    d = materialize(GQ.decided(spark, sf).select(X.stamp("window_start").alias("context_id"), "asset_id", "direction", "confidence"), "direct")
    far = G.propagate(d, X.edge_tables(spark, sf)["correlations"]).select("asset_id", "context_id", "direction", "depth")
    return d.filter("direction <> 'NEUTRAL'").select("asset_id", "context_id", "direction", F.lit(0).alias("depth")).unionByName(far)


GREEDY = "WITH RECURSIVE " + TQ.SIM + """, st AS MATERIALIZED (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 10) AS at, row_number() OVER (ORDER BY doc_id) AS k FROM sim),
nb AS MATERIALIZED (SELECT a.k, a.doc_id, coalesce(list(b.doc_id) FILTER (b.doc_id IS NOT NULL), []) AS near FROM st a LEFT JOIN st b ON b.k < a.k AND bit_count(xor(a.simhash, b.simhash)) <= 3 AND a.at - b.at <= INTERVAL 48 HOUR GROUP BY ALL),
r(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.k, CASE WHEN list_has_any(r.kept, n.near) THEN r.kept ELSE list_append(r.kept, n.doc_id) END FROM r JOIN nb n ON n.k = r.k + 1)
SELECT doc_id AS id, list_contains((SELECT kept FROM r ORDER BY k DESC LIMIT 1), doc_id) AS kept FROM st"""


@register("i02_greedy_dedup", GREEDY)
def i02(spark, sf):
    """In order of time a document is dropped if one kept in the 48 hours before is near; documents come ten minutes apart."""
    prints = TQ.prints_in_time(spark, sf).withColumnRenamed("doc_id", "id")
    return D.greedy(prints, materialize(D.near_links(prints, at_col="at"), "links"))


@register("a05_chart_scan", "WITH " + X.CLOSES + " SELECT asset_id AS symbol, session::VARCHAR AS session, close FROM closes")
def a05(spark, sf):
    c = X.closes(spark, sf).groupBy("asset_id", F.year("session").alias("year")).agg(F.array_sort(F.collect_list(F.struct("session", "close"))).alias("r"))
    at = F.transform("r", lambda x: F.unix_seconds(F.to_timestamp(x["session"])) + 43200)
    close = F.transform("r", lambda x: x["close"])
    quote = F.array(F.struct(close.alias("open"), close.alias("high"), close.alias("low"), close.alias("close")))
    meta = F.struct(F.lit("USD").alias("currency"), F.lit("UTC").alias("exchangeTimezoneName"), F.col("asset_id").alias("symbol"))
    result = F.array(F.struct(meta.alias("meta"), at.alias("timestamp"), F.struct(quote.alias("quote")).alias("indicators")))
    payload = c.select(F.col("asset_id").alias("symbol"), F.to_json(F.struct(F.struct(result.alias("result")).alias("chart"))).alias("payload"))
    return R.chart_bars(payload).select("symbol", F.col("session").cast("string"), "close")


@register("a06_ohlc_scan", "WITH " + X.CLOSES + " SELECT asset_id AS symbol, session::VARCHAR AS session, close FROM closes")
def a06(spark, sf):
    bar = F.struct(F.concat(F.col("session").cast("string"), F.lit("T00:00:00Z")).alias("time"), F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), F.col("close"), F.lit(False).alias("isOpen"))
    payload = X.closes(spark, sf).groupBy(F.col("asset_id").alias("symbol"), F.year("session")).agg(F.to_json(F.collect_list(bar)).alias("payload"))
    return R.ohlc_bars(payload).select("symbol", F.col("session").cast("string"), "close")


@register("a01_feed_scan", "WITH " + X.ARTICLES + " SELECT source_id, 'n' || article_id AS title, 'https://x.example/' || article_id AS url FROM articles")
def a01(spark, sf):
    a = X.articles(spark, sf)
    item = F.concat(F.lit("<item><title>n"), F.col("article_id"), F.lit("</title><link>https://x.example/"), F.col("article_id"), F.lit("</link><description>d</description><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>"))
    feed = a.groupBy("source_id", F.floor(F.col("article_id") / 1000)).agg(F.concat(F.lit("<rss><channel><title>t</title>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("xml"))
    return R.feed_items(feed).select("source_id", "title", "url")


statement("p09_price_available", "SELECT m.asset_id, count(c.close) > 0 AS available FROM {members} m LEFT JOIN {closes} c ON c.asset_id = m.asset_id GROUP BY m.asset_id")
