"""Parsers, identities, calendars, records and read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import text as T
from causeway.operators import learning as L
from causeway.plans.registry import register
from causeway.plans.relational_queries import statement
from causeway.sources import fixtures as X
from causeway.sources import readers as R

# --- parsers and scans ---


# --- identities, calendars, records ---
statement("h38_abandoned", "SELECT asset_id, count(*) AS n FROM {sc} WHERE end_close IS NULL AND settlement < date_sub(DATE '2024-02-10', 7) GROUP BY asset_id", "SELECT asset_id, count(*)::BIGINT AS n FROM sc WHERE end_close IS NULL AND settlement < DATE '2024-02-10' - 7 GROUP BY asset_id")
statement("h32_completion", "SELECT event_id, hour(from_utc_timestamp(ts, 'Europe/London')) * 60 + minute(from_utc_timestamp(ts, 'Europe/London')) >= 960 AS completed FROM {ev}", "SELECT event_id, hour(timezone('Europe/London', timezone('UTC', ts))) * 60 + minute(timezone('Europe/London', timezone('UTC', ts))) >= 960 AS completed FROM ev")
statement("h34_bar_session", "SELECT event_id, cast(to_date(from_utc_timestamp(ts, 'Asia/Tokyo')) AS string) AS session FROM {ev}", "SELECT event_id, timezone('Asia/Tokyo', timezone('UTC', ts))::DATE::VARCHAR AS session FROM ev")


SHA = "sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(source_id || '/' || article_id))"


@register("h40_name_uuid", "WITH " + X.ARTICLES + f" SELECT article_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT article_id, {SHA} AS h FROM articles)")
def h40(spark, sf):
    return X.articles(spark, sf).select("article_id", T.uuid5("6ba7b8109dad11d180b400c04fd430c8", F.concat_ws("/", "source_id", "article_id")).alias("uuid"))
