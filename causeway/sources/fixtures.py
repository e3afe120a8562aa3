"""The engine's entities derived from the driver tables, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import ship

FACTORS = ("view", "signup", "purchase", "error", "click")
TAGS = ("CALM", "RISK", "SUPPLY")
ASSETS = 29
ZONES = ("America/New_York", "Europe/London", "Europe/Stockholm")
CLOSE_MINUTE = 16 * 60


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    minutes = F.col("doc_id").cast("int")
    return d.select(
        F.col("doc_id").alias("article_id"),
        F.left("text", F.lit(80)).alias("title"),
        F.col("text").alias("body"),
        F.col("source").alias("source_id"),
        F.col("lang").alias("language"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("_t0"),
        minutes.alias("_m"),
    ).withColumn("published_at", F.col("_t0") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("_m"))).drop("_t0", "_m")


ARTICLES = """articles AS (SELECT doc_id AS article_id, left(text, 80) AS title, text AS body, source AS source_id, lang AS language,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS published_at FROM documents)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("A"), F.col("user_id") % ASSETS).alias("asset_id"),
        F.col("event_type").alias("factor"),
        F.element_at(F.array(*map(F.lit, TAGS)), k % 3 + 1).alias("tag"),
        F.when(F.col("event_id") % 5 < 3, "RESOLUTION").otherwise("OCCURRENCE").alias("polarity"),
        "value",
    )


EVENTS = """ev AS (SELECT event_id, ts, 'A' || (user_id % 29) AS asset_id, event_type AS factor,
  ['CALM', 'RISK', 'SUPPLY'][(json_extract_string(props, '$.k')::INT % 3) + 1] AS tag,
  CASE WHEN event_id % 5 < 3 THEN 'RESOLUTION' ELSE 'OCCURRENCE' END AS polarity, value FROM events)"""


def values(rows: list[tuple], name: str, columns: str) -> str:
    """A common table expression of literal rows."""
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """factor, its number i, and the number a of an asset, for every factor and asset that events name: FACTORS times ASSETS at most."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("factor"), (F.col("user_id") % ASSETS).cast("int").alias("a")).distinct()
    return e.withColumn("i", F.array_position(F.array(*map(F.lit, FACTORS)), F.col("factor")).cast("int") - 1)


def edge_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The graph that a seed would hold, for the factors and assets in the events: causes (factor, target, direction, weight, alpha, beta, condition; targets are assets
    or groups), members (asset_id, group_id) and correlations (source, target, condition, direction, weight, alpha, beta). Small by what _seen bounds, hence broadcast."""
    seen = _seen(spark, sf_dir)
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    name = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    a, i, g = F.col("a"), F.col("i"), F.col("g")
    own = seen.filter((a * 7 + i * 3) % 5 < 2).select(
        "factor", name("A", a).alias("target"), pick(("UP", "DOWN", "UP", "NEUTRAL", "DOWN"), (a + 2 * i) % 5).alias("direction"), F.round(0.2 + (a * 13 + i * 5) % 16 / 20, 2).alias("weight"),
        (1.0 + a % 4).alias("alpha"), (1.0 + i % 3).alias("beta"), F.when(a % 3 == 0, pick(TAGS, (a + i) % 3)).alias("condition"),
    )
    group = seen.select("factor", "i", (a % 7).alias("g")).distinct().filter((g + i) % 2 == 1).select(
        "factor", name("G", g).alias("target"), pick(("DOWN", "UP"), g % 2).alias("direction"), F.round(0.3 + g / 20, 2).alias("weight"), F.lit(2.0).alias("alpha"), F.lit(1.0).alias("beta"), F.when(g % 3 == 0, TAGS[0]).alias("condition"),
    )
    assets, k = seen.select("a").distinct(), F.col("k")
    to = (a * k + 5) % ASSETS
    pairs = assets.select("a", F.explode(F.array(F.lit(2), F.lit(3))).alias("k")).filter(to != a).select(
        name("A", a).alias("source"), name("A", to).alias("target"), pick(("UPSTREAM_UP", "UPSTREAM_DOWN"), (a + k) % 2).alias("condition"), pick(("UP", "DOWN"), (a + F.floor(k / 2)) % 2).alias("direction"),
        F.round(0.3 + (a + k) % 12 / 20, 2).alias("weight"), (1.0 + a % 3).alias("alpha"), F.lit(1.0).alias("beta"),
    )
    members = assets.select(name("A", a).alias("asset_id"), name("G", a % 7).alias("group_id"))
    return {"causes": F.broadcast(own.unionByName(group)), "members": F.broadcast(members), "correlations": F.broadcast(pairs)}


_SEEN = f"(SELECT DISTINCT event_type AS factor, (user_id % {ASSETS})::INT AS a, list_position({list(FACTORS)}, event_type)::INT - 1 AS i FROM events)"
CAUSES = f"""causes AS (SELECT factor, 'A' || a AS target, ['UP', 'DOWN', 'UP', 'NEUTRAL', 'DOWN'][(a + 2 * i) % 5 + 1] AS direction, round(0.2::DOUBLE + (a * 13 + i * 5) % 16 / 20.0::DOUBLE, 2) AS weight, (1 + a % 4)::DOUBLE AS alpha, (1 + i % 3)::DOUBLE AS beta,
  CASE WHEN a % 3 = 0 THEN {list(TAGS)}[(a + i) % 3 + 1] END AS condition FROM {_SEEN} WHERE (a * 7 + i * 3) % 5 < 2
  UNION ALL SELECT factor, 'G' || g, ['DOWN', 'UP'][g % 2 + 1], round(0.3::DOUBLE + g / 20.0::DOUBLE, 2), 2.0::DOUBLE, 1.0::DOUBLE, CASE WHEN g % 3 = 0 THEN '{TAGS[0]}' END FROM (SELECT DISTINCT factor, i, a % 7 AS g FROM {_SEEN}) WHERE (g + i) % 2 = 1)"""
MEMBERS = f"members AS (SELECT DISTINCT 'A' || a AS asset_id, 'G' || (a % 7) AS group_id FROM {_SEEN})"
CORRELATIONS = f"""correlations AS (SELECT 'A' || a AS source, 'A' || ((a * k + 5) % {ASSETS}) AS target, ['UPSTREAM_UP', 'UPSTREAM_DOWN'][(a + k) % 2 + 1] AS condition, ['UP', 'DOWN'][(a + k // 2) % 2 + 1] AS direction,
  round(0.3::DOUBLE + (a + k) % 12 / 20.0::DOUBLE, 2) AS weight, (1 + a % 3)::DOUBLE AS alpha, 1.0::DOUBLE AS beta FROM (SELECT DISTINCT a FROM {_SEEN}), (VALUES (2), (3)) AS n(k) WHERE (a * k + 5) % {ASSETS} <> a)"""


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value by (ts, event_id) of each asset and weekday."""
    e = events(spark, sf_dir).withColumn("session", F.to_date("ts")).filter(F.weekday("session") < 5)
    return e.groupBy("asset_id", "session").agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))


CLOSES = EVENTS + """, closes AS (SELECT asset_id, ts::DATE AS session, arg_max(value, {'t': ts, 'e': event_id}) AS close
  FROM ev WHERE isodow(ts) < 6 GROUP BY ALL)"""


def stamp(c):
    """Timestamps without zone as text, alike in every session zone."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled point samples of a session from 09:00 to 17:00, every 10 minutes, derived from events of these hours."""
    e, k = events(spark, sf_dir).filter(F.hour("ts").between(9, 16)), F.col("event_id")
    either = lambda n, odd, usual: F.when(k % n == 0, odd).otherwise(usual)
    seconds = lambda x: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), x.cast("double"))
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    slot = F.floor((F.hour("ts") * 60 + F.minute("ts")) / 10) * 600
    return e.select(
        k.alias("sample_id"), "asset_id", F.to_date("ts").alias("session"), (day + seconds(F.lit(32400))).alias("opens_at"), (day + seconds(F.lit(61200))).alias("closes_at"),
        (day + seconds(slot)).alias("scheduled_at"), F.col("ts").alias("observed_at"), (F.col("ts") - seconds(k % 180)).alias("provider_quote_at"), (F.col("ts") + seconds(k % 400)).alias("received_at"),
        F.col("value").alias("price"), either(19, "EUR", "SEK").alias("currency"), F.lit("UNIT").alias("quote_unit"), either(23, "m2", "m1").alias("mapping_version"), F.lit("r1").alias("registry_version"),
        either(29, "CLOSE", "LAST").alias("kind"), either(31, "CLOSED", "OPEN").alias("market_state"), either(13, "STALE", "FRESH").alias("quality"), F.lit(600).alias("interval_seconds"),
    )


SAMPLES = """samples AS (SELECT event_id AS sample_id, asset_id, ts::DATE AS session, date_trunc('day', ts) + INTERVAL 9 HOUR AS opens_at, date_trunc('day', ts) + INTERVAL 17 HOUR AS closes_at,
  time_bucket(INTERVAL 10 MINUTE, ts) AS scheduled_at, ts AS observed_at, ts - to_seconds(event_id % 180) AS provider_quote_at, ts + to_seconds(event_id % 400) AS received_at, value AS price,
  CASE WHEN event_id % 19 = 0 THEN 'EUR' ELSE 'SEK' END AS currency, 'UNIT' AS quote_unit, CASE WHEN event_id % 23 = 0 THEN 'm2' ELSE 'm1' END AS mapping_version, 'r1' AS registry_version,
  CASE WHEN event_id % 29 = 0 THEN 'CLOSE' ELSE 'LAST' END AS kind, CASE WHEN event_id % 31 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS market_state, CASE WHEN event_id % 13 = 0 THEN 'STALE' ELSE 'FRESH' END AS quality,
  600 AS interval_seconds FROM ev WHERE hour(ts) BETWEEN 9 AND 16)"""
