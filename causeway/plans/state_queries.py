"""Lifecycles, publication, evaluation and report queries: what changes state, and on what grounds."""

from __future__ import annotations

from causeway.plans.market_queries import both

# --- joins ---
both("d02_predictions_left_scores", lambda d: f"""SELECT p.asset_id, {d.stamp("p.window_start")} AS window_start, p.direction, s.actual, s.actual IS NULL AS pending FROM {{decided}} p
  LEFT JOIN (SELECT asset_id, window_start, actual FROM {{sc}} WHERE actual IS NOT NULL) s ON s.asset_id = p.asset_id AND s.window_start = p.window_start""")
both("d08_cohort_left", lambda d: """SELECT e.magnitude, count(*) AS n, count(s.actual) AS scored, cast(sum(CASE WHEN s.actual = e.direction THEN 1 ELSE 0 END) AS bigint) AS hits FROM {decided} e
  LEFT JOIN (SELECT asset_id, window_start, actual FROM {sc} WHERE actual IS NOT NULL AND direction <> 'NEUTRAL') s ON s.asset_id = e.asset_id AND s.window_start = e.window_start GROUP BY e.magnitude""")
#: The hundred oldest open orders with a large line are claimed; orders without lines are cancelled; the others stay.
both("d25_claim_and_cancel", lambda d: """SELECT o.o_orderkey, CASE WHEN c.id IS NOT NULL THEN 'CLAIMED' WHEN l.id IS NULL THEN 'CANCELLED' ELSE o.o_orderstatus END AS state FROM {orders} o
  LEFT JOIN (SELECT DISTINCT l_orderkey AS id FROM {lineitem}) l ON l.id = o.o_orderkey
  LEFT JOIN (SELECT o_orderkey AS id FROM {orders} WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_quantity > 45) ORDER BY o_orderdate, o_orderkey LIMIT 100) c ON c.id = o.o_orderkey""")

# --- aggregates and windows ---
both("e13_cluster_to_event", lambda d: f"""SELECT language, count(*) AS n, {d.stamp("min(published_at)")} AS first_at, {d.stamp("max(published_at)")} AS last_at, min(CASE WHEN k = 1 THEN title END) AS title,
  {"string_agg(DISTINCT source_id, ',' ORDER BY source_id)" if d.duck else "array_join(array_sort(collect_set(source_id)), ',')"} AS sources FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY published_at, article_id) AS k FROM {{articles}}) t GROUP BY language""")
both("f07_latest_in_window", lambda d: f"""SELECT asset_id, {d.stamp("day")} AS day, {d.stamp("window_start")} AS window_start, direction FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id, day ORDER BY window_start DESC) AS k FROM (SELECT *, date_trunc('day', window_start) AS day FROM {{decided}}) p
  WHERE (asset_id, day) IN (SELECT asset_id, date_trunc('day', window_start) FROM {{sc}} WHERE actual = direction)) t WHERE k = 1""")
both("f12_excursions", lambda d: """SELECT event_id, round(max(value) OVER w / first_value(value) OVER w - 1, 8) AS up, round(min(value) OVER w / first_value(value) OVER w - 1, 8) AS down FROM {ev}
  WINDOW w AS (PARTITION BY asset_id, cast(ts AS date) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")

# --- scans ---
#: Each asset's days in windows of a week, the last one cut.
both("a17_date_tiling", lambda d: f"""SELECT asset_id, cast(day AS string) AS starts, cast(least({"day + 6" if d.duck else "date_add(day, 6)"}, hi) AS string) AS ends FROM (
  SELECT asset_id, hi, {"unnest(generate_series(lo, hi, INTERVAL 7 DAY))::DATE" if d.duck else "explode(sequence(lo, hi, INTERVAL 7 DAY))"} AS day FROM (SELECT asset_id, min(cast(ts AS date)) AS lo, max(cast(ts AS date)) AS hi FROM {{ev}} GROUP BY asset_id) b) t""")
#: Open work that was never tried, or whose next attempt is due, oldest first; unknown customers are skipped.
both("a21_due_work", lambda d: f"""SELECT o_orderkey FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + {d.seconds("o_orderkey % 50 * 86400")} END AS next_attempt FROM {{orders}}) w
  WHERE o_orderstatus IN ('O', 'P') AND (next_attempt IS NULL OR next_attempt <= (SELECT max(o_orderdate) FROM {{orders}})) AND o_custkey IN (SELECT c_custkey FROM {{customer}}) ORDER BY o_orderdate, o_orderkey LIMIT 100""")
both("x26_body_resolution", lambda d: f"""SELECT page_id, CASE WHEN fetched THEN html ELSE concat('Summary of ', url) END AS body, fetched, cast(sum(CASE WHEN fetched THEN 1 ELSE 0 END) OVER (PARTITION BY host) AS bigint) AS fetched_of_host, count(*) OVER (PARTITION BY host) AS polled_of_host FROM (
  SELECT page_id, url, html, {"regexp_extract(url, '://([^/]*)', 1)" if d.duck else "regexp_extract(url, '://([^/]*)', 1)"} AS host, html IS NOT NULL AND trim(html) <> '' AND lower(left(html, 200)) NOT LIKE '%<html%' AS fetched FROM {{pages}}) t""")

# --- lifecycles ---
#: Bars that a consumer must hear of: new ones, changed ones that weren't final, all of an asset whose source switched.
both("i11_delta_publication", lambda d: """SELECT asset_id, cast(session AS string) AS session, action, close FROM (
  SELECT coalesce(n.asset_id, o.asset_id) AS asset_id, coalesce(n.session, o.session) AS session, n.close, CASE WHEN n.session IS NULL THEN NULL WHEN n.switched THEN 'REPLACED' WHEN o.session IS NULL THEN 'NEW' WHEN NOT o.final AND n.close IS DISTINCT FROM o.close THEN 'CHANGED' END AS action
  FROM (SELECT asset_id, session, close, day(session) < 12 AS final FROM {closes} WHERE day(session) % 7 <> 0) o
  FULL OUTER JOIN (SELECT asset_id, session, close + CASE WHEN day(session) % 3 = 0 THEN 1 ELSE 0 END AS close, asset_id IN ('A3', 'A17') AS switched FROM {closes} WHERE day(session) % 11 <> 0) n ON n.asset_id = o.asset_id AND n.session = o.session) t WHERE action IS NOT NULL""")
#: A request waits for its baseline, then for its settlement; one whose settlement is a week behind the latest session is given up.
both("i13_request_lifecycle", lambda d: f"""SELECT asset_id, {d.stamp("window_start")} AS window_start, CASE WHEN base_close IS NOT NULL AND end_close IS NOT NULL THEN 'COMPLETED' WHEN over THEN 'ABANDONED' WHEN base_close IS NOT NULL THEN 'BASELINE' ELSE 'PENDING' END AS state,
  concat('PENDING', CASE WHEN base_close IS NOT NULL THEN '>BASELINE' ELSE '' END, CASE WHEN base_close IS NOT NULL AND end_close IS NOT NULL THEN '>COMPLETED' WHEN over THEN '>ABANDONED' ELSE '' END) AS path FROM (
  SELECT *, {"settlement + 7" if d.duck else "date_add(settlement, 7)"} < (SELECT max(session) FROM {{closes}}) AS over FROM {{sc}}) t""")
#: Both closes of a pair come from one source: the first that has both.
both("i14_pair_selection", lambda d: f"""SELECT s.asset_id, {d.stamp("s.window_start")} AS window_start, CASE WHEN s.base_close IS NOT NULL AND s.end_close IS NOT NULL THEN 'PRIMARY' WHEN b.close IS NOT NULL AND e.close IS NOT NULL THEN 'FALLBACK' END AS source,
  CASE WHEN s.base_close IS NOT NULL AND s.end_close IS NOT NULL THEN s.base_close WHEN e.close IS NOT NULL THEN b.close END AS base, CASE WHEN s.base_close IS NOT NULL AND s.end_close IS NOT NULL THEN s.end_close WHEN b.close IS NOT NULL THEN e.close END AS settled FROM (
    SELECT asset_id, window_start, baseline, settlement, CASE WHEN day(baseline) % 4 <> 0 THEN base_close END AS base_close, CASE WHEN day(settlement) % 5 <> 0 THEN end_close END AS end_close FROM {{sc}}) s
  LEFT JOIN {{closes}} b ON b.asset_id = s.asset_id AND b.session = s.baseline AND day(b.session) % 3 <> 0 LEFT JOIN {{closes}} e ON e.asset_id = s.asset_id AND e.session = s.settlement AND day(e.session) % 3 <> 0""")
#: Each content that an event was delivered with, by its hash: when it was first received, and which version that makes it.
both("i16_first_received", lambda d: f"""SELECT id, hash, {d.stamp("received")} AS first_received, row_number() OVER (PARTITION BY id ORDER BY received, hash) AS version FROM (
  SELECT id, hash, min(ts) AS received FROM (SELECT concat(asset_id, '|', factor, '|', cast(cast(ts AS date) AS string)) AS id, {d.sha("concat(tag, '|', polarity)")} AS hash, ts FROM {{ev}}) e GROUP BY id, hash) v""")
EVALUATED = """SELECT asset_id, window_start, direction, settlement, end_close, base_close, CASE WHEN lead(direction) OVER (PARTITION BY asset_id, cast(window_start AS date) ORDER BY window_start) <> direction THEN 'WITHDRAWN' ELSE 'OPEN' END AS status FROM {{sc}} WHERE direction <> 'NEUTRAL'"""
#: One evaluation for each decision that takes a side; it is withdrawn when another of the day turns against it.
both("i18_evaluations", lambda d: f"""SELECT asset_id, {d.stamp("window_start")} AS window_start, {d.sha(f"concat(asset_id, '|', {d.stamp('window_start')})")} AS evaluation_id, status FROM ({EVALUATED.replace("{{", "{").replace("}}", "}")}) t""")
#: Prices meet evaluations: scored, skipped because withdrawn, or orphans without any.
both("i19_orphan_scores", lambda d: f"""SELECT c.asset_id, cast(c.session AS string) AS session, CASE WHEN v.asset_id IS NULL THEN 'ORPHAN' WHEN v.status = 'WITHDRAWN' THEN 'SKIPPED' ELSE 'SCORED' END AS outcome, {d.stamp("v.window_start")} AS window_start,
  CASE WHEN v.status = 'OPEN' THEN round(c.close / v.base_close - 1, 8) END AS r FROM {{closes}} c LEFT JOIN ({EVALUATED.replace("{{", "{").replace("}}", "}")}) v ON v.asset_id = c.asset_id AND v.settlement = c.session""")
#: A window's first version has the events that came in time; each later one (a tenth of them) makes a version with one member more.
both("i06_late_versions", lambda d: f"""SELECT asset_id, {d.stamp("w")} AS window_start, version, members FROM (
  SELECT asset_id, w, 1 AS version, n AS members FROM (SELECT asset_id, date_trunc('hour', ts) AS w, cast(sum(CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END) AS bigint) AS n FROM {{ev}} GROUP BY asset_id, date_trunc('hour', ts)) a WHERE n > 0
  UNION ALL SELECT asset_id, w, k + CASE WHEN n > 0 THEN 1 ELSE 0 END, n + k FROM (SELECT asset_id, w, event_id, row_number() OVER (PARTITION BY asset_id, w ORDER BY event_id) - n0 AS k, n0 AS n FROM (
    SELECT asset_id, date_trunc('hour', ts) AS w, event_id + CASE WHEN event_id % 10 = 0 THEN 1000000000000 ELSE 0 END AS event_id, event_id % 10 = 0 AS late, cast(sum(CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id, date_trunc('hour', ts)) AS bigint) AS n0 FROM {{ev}}) b) c WHERE k > 0) t""")

# --- policies and reports ---
#: Of each slot the sample received last; a session's samples must agree on what they are of, and fill its slots.
both("v03_last_known_policy", lambda d: """SELECT asset_id, cast(session AS string) AS session, CASE WHEN identities > 1 THEN 'MIXED_IDENTITY' WHEN n < 2 THEN 'INSUFFICIENT_SAMPLES' WHEN abs(last / base - 1) <= 0.003 THEN 'NEUTRAL' WHEN last > base THEN 'UP' ELSE 'DOWN' END AS closing, n = 48 AS complete, n FROM (
  SELECT asset_id, session, count(*) AS n, count(DISTINCT concat(currency, quote_unit, mapping_version, registry_version)) AS identities, min(CASE WHEN first = 1 THEN price END) AS base, min(CASE WHEN final = 1 THEN price END) AS last FROM (
    SELECT *, row_number() OVER (PARTITION BY asset_id, session ORDER BY scheduled_at) AS first, row_number() OVER (PARTITION BY asset_id, session ORDER BY scheduled_at DESC) AS final FROM (
      SELECT *, row_number() OVER (PARTITION BY asset_id, session, scheduled_at ORDER BY received_at DESC, sample_id DESC) AS k FROM {samples}) u WHERE k = 1) s GROUP BY asset_id, session) t""")
both("b10_audit_report", lambda d: """SELECT asset_id, concat(chr(123), '"asset":"', asset_id, '","predictions":', cast(n AS string), ',"scored":', cast(scored AS string), ',"hits":', cast(hits AS string), ',"pending":', cast(n - scored AS string), chr(125)) AS report, n, scored, hits FROM (
  SELECT asset_id, count(*) AS n, count(actual) AS scored, count(*) FILTER (WHERE actual = direction) AS hits FROM {sc} GROUP BY asset_id) t""")
#: The newest twenty with their status, every one's detail by id, and figures by direction: one table of rows by view.
both("x37_statistics", lambda d: f"""SELECT 'list' AS view, {d.sha("concat(asset_id, '|', made)")} AS id, concat(direction, '|', status) AS value FROM (SELECT *, row_number() OVER (ORDER BY made DESC, asset_id) AS k FROM (SELECT asset_id, {d.stamp("window_start")} AS made, direction, CASE WHEN actual IS NULL THEN 'pending' WHEN actual = direction THEN 'correct' ELSE 'wrong' END AS status FROM {{sc}}) a) l WHERE k <= 20
  UNION ALL SELECT 'detail', {d.sha(f"concat(asset_id, '|', {d.stamp('window_start')})")}, concat(asset_id, '|', {d.stamp("window_start")}, '|', direction, '|', magnitude, '|', coalesce(actual, '-')) FROM {{sc}}
  UNION ALL SELECT 'statistics', direction, concat(cast(count(*) AS string), '|', cast(count(actual) AS string), '|', cast(count(*) FILTER (WHERE actual = direction) AS string)) FROM {{sc}} GROUP BY direction""")
