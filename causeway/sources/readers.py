"""Readers of provider payloads and corpora. Parsing is declarative; fetching stays with the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHART = (
    "chart struct<error:string,result:array<struct<meta:struct<currency:string,exchangeTimezoneName:string,symbol:string>,timestamp:array<bigint>,"
    "indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>>>>>>>"
)
OHLC = "array<struct<time:string,open:double,high:double,low:double,close:double,isOpen:boolean>>"


def chart_bars(payloads: DataFrame, json_col: str = "payload", symbol_col: str = "symbol") -> DataFrame:
    """symbol, session, open to close: parallel arrays to rows; gaps (null close) and payloads of another symbol are skipped."""
    p = payloads.select(F.col(symbol_col).alias("symbol"), F.from_json(json_col, CHART)["chart"]["result"][0].alias("r"))
    q = F.col("r.indicators.quote")[0]
    rows = p.filter(F.col("r.meta.symbol") == F.col("symbol")).select("symbol", F.col("r.meta.exchangeTimezoneName").alias("zone"), F.explode(F.arrays_zip(F.col("r.timestamp").alias("at"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"), q["close"].alias("close"))).alias("b"))
    session = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("b.at"), F.col("zone")))
    return rows.filter("b.close is not null").select("symbol", session.alias("session"), "b.open", "b.high", "b.low", "b.close")


def ohlc_bars(payloads: DataFrame, json_col: str = "payload", symbol_col: str = "symbol") -> DataFrame:
    """symbol, session, open to close of finished bars, at UTC midnight."""
    rows = payloads.select(F.col(symbol_col).alias("symbol"), F.explode(F.from_json(json_col, OHLC)).alias("b")).filter(~F.coalesce("b.isOpen", F.lit(False)))
    return rows.select("symbol", F.to_date(F.left("b.time", F.lit(10))).alias("session"), "b.open", "b.high", "b.low", "b.close")


def parsed_date(text: Column) -> Column:
    """Dates as feeds write them: RFC 822, ISO 8601 with or without zone."""
    formats = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss")
    text = F.regexp_replace(text, "^[A-Za-z]{3}, *", "")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def feed_items(feeds: DataFrame, xml_col: str = "xml", source_col: str = "source_id") -> DataFrame:
    """source_id, title, url, summary, published of feed items with link, title and date."""
    items = feeds.select(source_col, F.explode(F.from_xml(xml_col, "channel struct<item:array<struct<title:string,link:string,description:string,pubDate:string>>>")["channel"]["item"]).alias("i"))
    out = items.select(source_col, F.trim("i.title").alias("title"), F.trim("i.link").alias("url"), F.col("i.description").alias("summary"), F.date_format(parsed_date(F.regexp_replace("i.pubDate", "GMT$", "+0000")), "yyyy-MM-dd HH:mm:ss").alias("published"))
    return out.filter("title <> '' and url <> '' and published is not null")


def decoded(data: Column, declared: Column | str = "utf-8") -> Column:
    """Text of bytes: by their byte order mark, else strictly by the declared charset, else strict UTF-8; null rather than a loss."""
    declared = F.lower(F.lit(declared) if isinstance(declared, str) else declared)
    head = lambda n: F.hex(F.substring(data, 1, n))
    body = lambda n: F.substring(data, n + 1, 1 << 30)
    strict = lambda b: F.when(F.is_valid_utf8(b.cast("string")), b.cast("string"))
    return (
        F.when(head(3) == "EFBBBF", strict(body(3)))
        .when(head(2) == "FFFE", F.decode(body(2), "UTF-16LE"))
        .when(head(2) == "FEFF", F.decode(body(2), "UTF-16BE"))
        .when(declared.isin("latin-1", "iso-8859-1"), F.decode(data, "ISO-8859-1"))
        .when(declared.isin("us-ascii", "ascii"), F.when(F.regexp_replace(F.hex(data), "([0-7][0-9A-F])", "") == "", data.cast("string")))
        .otherwise(strict(data))
    )


NEWS_LIST = "items array<struct<id:bigint,url:string,title:string,published:string>>"
NEWS_DETAIL = "id bigint, countries array<string>, body string"


def news_items(lists: DataFrame, details: DataFrame, json_col: str = "payload") -> DataFrame:
    """id, url, title, published, country, body: items of list payloads with what their detail payloads add. Items without url, title or date are dropped; the country is the first two-letter code."""
    items = lists.select(F.explode(F.from_json(json_col, NEWS_LIST)["items"]).alias("i")).select("i.id", F.trim("i.url").alias("url"), F.trim("i.title").alias("title"), parsed_date(F.col("i.published")).alias("published"))
    more = details.select(F.from_json(json_col, NEWS_DETAIL).alias("d")).select("d.id", F.get(F.filter("d.countries", lambda c: F.trim(c).rlike("^[A-Za-z]{2}$")), F.lit(0)).alias("country"), "d.body")
    return items.filter("url <> '' and title <> '' and published is not null").join(more, "id", "left").withColumn("country", F.upper(F.trim("country")))


MINUTES = "symbol string, at array<bigint>, open array<double>, high array<double>, low array<double>, close array<double>"


def minute_bars(payloads: DataFrame, begin: Column, end: Column, now: Column, json_col: str = "payload") -> DataFrame:
    """symbol, start, open to close, conflict: bars of [begin, end) whose minute is over at ``now`` and whose prices are all there; a bar given twice is one, unless its prices differ."""
    p = payloads.select(F.from_json(json_col, MINUTES).alias("p")).select("p.*")
    bars = p.select("symbol", F.explode(F.arrays_zip("at", "open", "high", "low", "close")).alias("b")).select("symbol", F.timestamp_seconds("b.at").cast("timestamp_ntz").alias("start"), "b.open", "b.high", "b.low", "b.close")
    prices = F.struct("open", "high", "low", "close")
    full = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    kept = bars.filter(full & (F.col("start") >= begin) & (F.col("start") < end) & (F.col("start") + F.expr("interval 1 minute") <= now))
    return kept.groupBy("symbol", "start").agg(F.min(prices).alias("p"), (F.count_distinct(prices) > 1).alias("conflict")).select("symbol", "start", "p.*", "conflict")


def price_text(text: Column) -> Column:
    """Price as a page prints it: spaces between thousands; the last comma or point is the decimal mark unless it parts thousands."""
    bare = F.regexp_replace(F.regexp_replace(text, "[^0-9,.\\u2212-]", ""), "\u2212", "-")
    both = F.contains(bare, F.lit(",")) & F.contains(bare, F.lit("."))
    comma_last = F.instr(F.reverse(bare), ",") < F.instr(F.reverse(bare), ".")
    plain = F.when(both & comma_last, F.translate(bare, ".", "")).when(both, F.translate(bare, ",", "")).otherwise(bare)
    return F.translate(plain, ",", ".").try_cast("double")


def status_text(text: Column) -> Column:
    """OPEN, CLOSED, PAUSED or UNKNOWN."""
    t = F.lower(text)
    return F.when(t.rlike("halt|pause|suspend"), "PAUSED").when(t.rlike("clos"), "CLOSED").when(t.rlike("open|continuous"), "OPEN").otherwise("UNKNOWN")


def delay_seconds(text: Column) -> Column:
    """Seconds of a quote's delay: 0 for real time, null if it isn't told."""
    n, t = F.regexp_extract(text, "([0-9]+)", 1).try_cast("int"), F.lower(text)
    return F.when(t.rlike("real.?time"), F.lit(0)).when(t.rlike("[0-9] *(m|min|minutes)\\b"), n * 60).when(t.rlike("[0-9] *(s|sec|seconds)\\b"), n)


def retry_after(text: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number, or a date less ``now``; never negative, null if neither."""
    until = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, "^[A-Za-z]{3}, *", ""), "GMT$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    wait = F.coalesce(F.trim(text).try_cast("bigint"), F.unix_seconds(until) - F.unix_seconds(now.cast("timestamp")))
    return F.when(wait < 0, 0).otherwise(wait)


def allowed_url(url: Column, hosts: tuple[str, ...]) -> Column:
    """https on one of the hosts or below it, without credentials, port or fragment."""
    host = F.lower(F.regexp_extract(url, "^https://([^/?#]*)", 1))
    of = F.lit(False)
    for h in hosts:
        of = of | (host == h) | host.endswith("." + h)
    return F.coalesce(url.startswith("https://") & ~host.contains("@") & ~host.contains(":") & ~url.contains("#") & of, F.lit(False))


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of seed files, JSON lines under ``nodes`` and ``edges``, with their fixed schemas."""
    nodes = spark.read.schema("id string, label string").json(f"{path}/nodes")
    edges = spark.read.schema("kind string, source string, target string, direction string, weight double, alpha double, beta double, condition string").json(f"{path}/edges")
    return nodes, edges


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """groups and assets of a registry file: registry_version, groups[group_id, display_name, assets[...]]."""
    raw = spark.read.option("multiLine", True).json(path)
    groups = raw.select("registry_version", F.explode("groups").alias("g")).select("registry_version", "g.*")
    return groups.drop("assets"), groups.select("group_id", F.explode("assets").alias("a")).select("group_id", "a.*")


def registry_faults(assets: DataFrame) -> DataFrame:
    """assets: asset_id, group_id, provider_symbol, currency, fallback. rule and key of every breach of the registry's rules."""
    fault = lambda rule, df, key="asset_id": df.select(F.lit(rule).alias("rule"), F.col(key).alias("key"))
    twice = assets.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("groups"))
    shared = assets.filter("provider_symbol is not null").groupBy("provider_symbol").agg(F.count_distinct("asset_id").alias("n"))
    ids = assets.select(F.col("asset_id").alias("fallback")).distinct()
    return (
        fault("DUPLICATE_ASSET", twice.filter("n > 1"))
        .unionByName(fault("SEVERAL_GROUPS", twice.filter("groups > 1")))
        .unionByName(fault("SHARED_SYMBOL", shared.filter("n > 1"), "provider_symbol"))
        .unionByName(fault("NO_SYMBOL", assets.filter("provider_symbol is null or trim(provider_symbol) = ''")))
        .unionByName(fault("BAD_CURRENCY", assets.filter(~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False)))))
        .unionByName(fault("OWN_FALLBACK", assets.filter("fallback = asset_id")))
        .unionByName(fault("UNKNOWN_FALLBACK", assets.filter("fallback is not null").join(ids, "fallback", "left_anti")))
    )


def load_corpus(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def save_corpus(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines, range-partitioned and sorted within files; written whole or not at all."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def with_schema(df: DataFrame, ddl: str, defaults: dict) -> DataFrame:
    """df under a schema: columns it lacks, and nulls in columns that have a default, get the default; other columns go."""
    out = []
    for f in StructType.fromDDL(ddl).fields:
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        out.append((F.coalesce(value, F.lit(defaults[f.name])) if f.name in defaults else value).cast(f.dataType).alias(f.name))
    return df.select(*out)
