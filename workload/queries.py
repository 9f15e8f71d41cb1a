"""The registered queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickerloom import names, schemas
from tickerloom.functions import clock, payload, pricing, text
from tickerloom.operators import lookup, rolling
from tickerloom.plans import evaluation, incremental, marts, predictions, refresh, staging, unified
from tickerloom.session import shared_dir
from tickerloom.sources import bronze, landing, versions
from tickerloom.sources.tables import Tables
from tickerloom.streaming import dedup as stream_dedup, ingest, market, outcomes
from workload import inputs
from workload.inputs import (BARS_SQL, ENTITY_NEWS_SQL, HEADLINES_SQL, PREDICTIONS_SQL, QUOTES_SQL, REST, REST_SQL,
                             TITLE, TITLE_SQL, TRADES_SQL, WORD_RULES, evaluated_sql, rules_sql, sentiment_sql, table)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

AS_OF = "2024-01-20 12:00:00"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder on the shared storage of the session."""
    return f"{shared_dir(spark)}/{what}-{uuid4().hex}"


def plain(df: DataFrame, **casts: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()})


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; compare without them."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ------------------------------------------------------------------ raw layer

@query("s3_parse_roundtrip", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def _(spark, sf):
    raw = table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("raw_payload"))
    return raw.select("event_id", payload.at(F.col("raw_payload"), "$.k", "bigint").alias("k"))


def queue_records(events: DataFrame) -> DataFrame:
    """Every event as a message; its type decides topic and readability, a small value makes it an empty one."""
    return events.selectExpr(
        "cast(user_id as string) AS key",
        "CASE WHEN value < 5 THEN NULL WHEN event_type = 'error' THEN concat('broken ', props) ELSE props END AS value",
        """CASE event_type WHEN 'click' THEN 'raw_finnhub_ticks' WHEN 'view' THEN 'raw_alltick_ticks'
             WHEN 'purchase' THEN 'raw_newsapi_news' WHEN 'error' THEN 'raw_marketaux_news'
             ELSE 'some_other_topic' END AS topic""",
        "0 AS partition", "event_id AS offset", "cast(ts as timestamp) AS timestamp")


BRONZE_SQL = """
SELECT CASE event_type WHEN 'click' THEN 'bronze_finnhub_ticks' WHEN 'view' THEN 'bronze_alltick_ticks'
         WHEN 'purchase' THEN 'bronze_newsapi_news' ELSE 'unreadable' END AS bronze_table,
       event_id AS "offset", CAST(user_id AS VARCHAR) AS key,
       CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
       CASE WHEN event_type = 'error' THEN 'broken ' || props END AS unreadable_text
FROM events WHERE event_type <> 'signup' AND value >= 5"""


def bronze_rows(rows: DataFrame) -> DataFrame:
    return rows.select("bronze_table", "record_metadata.offset", "record_metadata.key",
                       payload.at(F.col("raw_payload"), "$.k", "bigint").alias("k"), "unreadable_text")


@query("s2_topic_routing", BRONZE_SQL)
def _(spark, sf):
    return bronze_rows(bronze.raw_rows(queue_records(table(spark, sf, "events"))))


@query("s15_ingest_metadata", """
SELECT CASE event_type WHEN 'click' THEN 'bronze_finnhub_ticks' WHEN 'view' THEN 'bronze_alltick_ticks'
         WHEN 'purchase' THEN 'bronze_newsapi_news' ELSE 'unreadable' END AS bronze_table,
       CAST(ts AS DATE)::VARCHAR AS ingest_date, count(*) AS messages, min(event_id) AS first_offset,
       max(event_id) AS last_offset
FROM events WHERE event_type <> 'signup' AND value >= 5 GROUP BY ALL""")
def _(spark, sf):
    rows = bronze.raw_rows(queue_records(table(spark, sf, "events")))
    return rows.groupBy("bronze_table", F.col("ingest_date").cast("string").alias("ingest_date")).agg(
        F.count(F.lit(1)).alias("messages"), F.min("record_metadata.offset").alias("first_offset"),
        F.max("record_metadata.offset").alias("last_offset"))


# --------------------------------------------------------------- edge: shaping

def trade_bodies(events: DataFrame) -> DataFrame:
    """A response per event.  Its type decides what is in it:
    click: no conditions; view: numbers as text; purchase: two trades; signup: the second trade
    is bad; error: a ping without data."""
    return events.selectExpr("event_id", "event_type", """
        CASE event_type
          WHEN 'click' THEN to_json(named_struct('type', 'trade', 'data', array(
            named_struct('s', cast(user_id as string), 'p', value, 't', event_id, 'v', 1.0D))))
          WHEN 'view' THEN to_json(named_struct('type', 'trade', 'data', array(
            named_struct('s', cast(user_id as string), 'p', cast(value as string), 't', cast(event_id as string),
                         'v', 2, 'c', array('x'), 'unknown', props))))
          WHEN 'purchase' THEN to_json(named_struct('type', 'trade', 'data', array(
            named_struct('s', cast(user_id as string), 'p', value, 't', event_id, 'v', 3.0D, 'c', array('x', 'y')),
            named_struct('s', cast(user_id as string), 'p', value + 1, 't', event_id, 'v', 4.0D, 'c', array('z', 'w')))))
          WHEN 'signup' THEN to_json(named_struct('type', 'trade', 'data', array(
            named_struct('s', cast(user_id as string), 'p', cast(value as string), 't', event_id, 'v', 5.0D),
            named_struct('s', cast(user_id as string), 'p', 'n/a', 't', event_id, 'v', 6.0D))))
          ELSE '{"type": "ping"}' END AS value""")


def triaged_trades(spark, sf) -> DataFrame:
    return landing.triage(trade_bodies(inputs.spread(table(spark, sf, "events"))), names.TRADES)


@query("i7_validate_split", """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'rejected' WHEN 'error' THEN 'dropped' ELSE 'accepted' END AS verdict,
       CASE event_type WHEN 'signup' THEN 'data' END AS reason
FROM events""")
def _(spark, sf):
    return triaged_trades(spark, sf).select("event_id", "verdict", "reason")


VERDICT_COUNTS_SQL = """
SELECT CASE event_type WHEN 'signup' THEN 'rejected' WHEN 'error' THEN 'dropped' ELSE 'accepted' END AS verdict,
       CASE event_type WHEN 'signup' THEN 'data' END AS reason, count(*) AS bodies
FROM events GROUP BY ALL"""


@query("i16_verdict_counts", VERDICT_COUNTS_SQL)
def _(spark, sf):
    return landing.tally(triaged_trades(spark, sf))


@query("i16_counts_on_write", VERDICT_COUNTS_SQL)
def _(spark, sf):
    triaged, seen = landing.counted(triaged_trades(spark, sf), names.TRADES)
    accepted = landing.messages(landing.elements(triaged, names.TRADES), names.TRADES)
    accepted.write.parquet(scratch(spark, "messages"))
    return landing.observed_tally(spark, seen, names.TRADES)


@query("i1_envelope_unnest", """
SELECT CAST(user_id AS VARCHAR) AS s, value AS p, event_id AS t,
       CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 2.0 ELSE 3.0 END::DOUBLE AS v,
       CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'x' ELSE 'x,y' END AS c
FROM events WHERE event_type IN ('click', 'view', 'purchase')
UNION ALL
SELECT CAST(user_id AS VARCHAR), value + 1, event_id, 4.0::DOUBLE, 'z,w' FROM events WHERE event_type = 'purchase'""")
def _(spark, sf):
    return landing.elements(triaged_trades(spark, sf), names.TRADES).withColumn("c", F.array_join("c", ","))


@query("i10_canonical_json", """
SELECT CAST(user_id AS VARCHAR) AS key, 'raw_finnhub_ticks' AS topic,
       '{"s":"' || user_id || '","p":' || p || ',"t":' || event_id || ',"v":' || v || ',"c":[' || c || ']}' AS value
FROM (SELECT user_id, event_id, value AS p,
             CASE event_type WHEN 'click' THEN '1.0' WHEN 'view' THEN '2.0' ELSE '3.0' END AS v,
             CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN '"x"' ELSE '"x","y"' END AS c
      FROM events WHERE event_type IN ('click', 'view', 'purchase')
      UNION ALL
      SELECT user_id, event_id, value + 1, '4.0', '"z","w"' FROM events WHERE event_type = 'purchase')""")
def _(spark, sf):
    return landing.messages(landing.elements(triaged_trades(spark, sf), names.TRADES), names.TRADES)


@query("i9_default_fill", """
SELECT CAST(l_suppkey AS VARCHAR) AS code, l_orderkey * 10 + l_linenumber AS seq,
       CASE WHEN l_discount = 0 THEN 0 ELSE 1 END AS asks
FROM lineitem""")
def _(spark, sf):
    bodies = inputs.spread(table(spark, sf, "lineitem")).selectExpr("""to_json(named_struct('cmd_id', 22999, 'data', named_struct(
        'code', cast(l_suppkey as string), 'seq', l_orderkey * 10 + l_linenumber, 'tick_time', 0,
        'asks', if(l_discount = 0, null, array(named_struct('price', '1', 'volume', '2')))))) AS value""")
    rows = landing.elements(landing.triage(bodies, names.QUOTES), names.QUOTES)
    return rows.select("data.code", "data.seq", F.size("data.asks").alias("asks"))


@query("i2_cmd_filter", """
SELECT CAST(l_suppkey AS VARCHAR) AS code, l_orderkey * 10 + l_linenumber AS seq, count(*) * 2 AS n
FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL""")
def _(spark, sf):
    bodies = inputs.quotes_raw(spark, sf).withColumnRenamed("raw_payload", "value")
    rows = landing.elements(landing.triage(bodies, names.QUOTES), names.QUOTES)
    return rows.groupBy("data.code", "data.seq").agg(F.count(F.lit(1)).alias("n"))


@query("i3_drop_notices", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'dropped' ELSE 'accepted' END AS verdict FROM orders""")
def _(spark, sf):
    bodies = inputs.spread(table(spark, sf, "orders")).selectExpr("o_orderkey", """
        if(o_orderstatus = 'F', '{"Note": null}', to_json(named_struct(
           'Meta Data', map('2. Symbol', cast(o_custkey as string)),
           'Time Series (Daily)', map(date_format(o_orderdate, 'yyyy-MM-dd'), named_struct(
              '1. open', '1', '2. high', '2', '3. low', '0', '4. close', cast(o_totalprice as string),
              '5. volume', '7'))))) AS value""")
    return landing.triage(bodies, names.BARS).select("o_orderkey", "verdict")


def article_bodies(documents: DataFrame) -> DataFrame:
    """A response per document with an article per line; German ones are error bodies."""
    return documents.selectExpr("doc_id", "lang", """
        if(lang = 'de', to_json(named_struct('status', 'error', 'message', source)),
           to_json(named_struct('status', 'ok', 'totalResults', size(split(text, '\\n')),
             'articles', transform(split(text, '\\n'), x -> named_struct(
               'source', named_struct('id', cast(null as string), 'name', source), 'author', cast(null as string),
               'title', x, 'description', lang, 'url', 'http://news.example/', 'urlToImage', cast(null as string),
               'publishedAt', '2024-01-01T00:00:00Z', 'content', cast(doc_id as string)))),
             map('ignoreNullFields', 'false'))) AS value""")


@query("i5_drop_error_status", """
SELECT doc_id, CASE WHEN lang = 'de' THEN 'dropped' ELSE 'accepted' END AS verdict FROM documents""")
def _(spark, sf):
    return landing.triage(article_bodies(inputs.spread(table(spark, sf, "documents"))), names.HEADLINES).select("doc_id", "verdict")


@query("i6_unnest_articles", """
SELECT content, title, description FROM (
  SELECT CAST(doc_id AS VARCHAR) AS content, unnest(string_split(text, chr(10))) AS title, lang AS description
  FROM documents WHERE lang <> 'de')""")
def _(spark, sf):
    triaged = landing.triage(article_bodies(inputs.spread(table(spark, sf, "documents"))), names.HEADLINES)
    return landing.elements(triaged, names.HEADLINES).select("content", "title", "description")


@query("i4_drop_error_bodies", """
SELECT doc_id, CASE WHEN lang = 'fr' THEN 'dropped' WHEN lang = 'es' THEN 'rejected' ELSE 'accepted' END AS verdict,
       CASE WHEN lang = 'es' THEN 'data' END AS reason
FROM documents""")
def _(spark, sf):
    bodies = inputs.spread(table(spark, sf, "documents")).selectExpr("doc_id", f"""
        CASE lang WHEN 'fr' THEN to_json(named_struct('error', named_struct('message', text)))
          WHEN 'es' THEN to_json(named_struct('meta', map('found', 1), 'data', array(named_struct('uuid', text))))
          ELSE to_json(named_struct('meta', map('found', 1), 'data', array(named_struct(
            'uuid', cast(doc_id as string), 'title', {TITLE}, 'description', {REST}, 'snippet', cast(null as string),
            'url', 'u', 'image_url', cast(null as string), 'language', lang, 'published_at', '2024-01-01T00:00:00Z',
            'source', source, 'entities', array(named_struct('symbol', source, 'name', text,
              'exchange', cast(null as string), 'sentiment_score', cast(null as double)))))),
            map('ignoreNullFields', 'false')) END AS value""")
    return landing.triage(bodies, names.ENTITY_NEWS).select("doc_id", "verdict", "reason")


@query("i8_alias_rename", """
SELECT CAST(o_custkey AS VARCHAR) AS stock_ticker, o_orderdate AS api_refreshed_at,
       o_totalprice - 2 AS open_price, o_totalprice AS close_price, o_orderkey AS trading_volume
FROM orders""")
def _(spark, sf):
    bodies = inputs.spread(table(spark, sf, "orders")).selectExpr("""to_json(named_struct(
        'Meta Data', map('2. Symbol', cast(o_custkey as string),
                         '3. Last Refreshed', date_format(o_orderdate, 'yyyy-MM-dd')),
        'Time Series (Daily)', map(date_format(o_orderdate, 'yyyy-MM-dd'), named_struct(
          '1. open', cast(o_totalprice - 2 as string), '2. high', cast(o_totalprice as string),
          '3. low', cast(o_totalprice as string), '4. close', cast(o_totalprice as string),
          '5. volume', cast(o_orderkey as string))))) AS value""")
    out = landing.messages(landing.elements(landing.triage(bodies, names.BARS), names.BARS), names.BARS)
    parsed = staging.parse_bars(out.select(F.col("value").alias("raw_payload")))
    return parsed.select("stock_ticker", "api_refreshed_at", "open_price", "close_price", "trading_volume")


@query("i11_watchlist", """
SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')""")
def _(spark, sf):
    return landing.watched(table(spark, sf, "events"), "event_type", ["click", "purchase"]).select(
        "event_id", "event_type")


@query("i11_watchlist_table", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(spark, sf):
    watch = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return landing.watched(table(spark, sf, "orders"), "o_custkey", watch).select("o_orderkey", "o_custkey")


@query("i12_look_back", """
SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-13 00:00:00'""")
def _(spark, sf):
    return landing.recent(table(spark, sf, "events"), F.col("ts").cast("timestamp"), "2024-01-20").select("event_id", "ts")


@query("i13_keywords", """
SELECT doc_id FROM documents WHERE lang = 'en' AND (text ILIKE '%THTHER%' OR text ILIKE '%einge%' OR text ILIKE '%enst%')""")
def _(spark, sf):
    return landing.on_topic(table(spark, sf, "documents"), F.col("text"), F.col("lang"),
                            ["THTHER", "einge", "enst"]).select("doc_id")


@query("i14_newest_per_poll", """
SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id LIMIT 10""")
def _(spark, sf):
    return landing.newest(table(spark, sf, "events").select("event_id", "ts", "value"), "ts", "event_id")


@query("i15_best_price", """
SELECT l_orderkey, l_linenumber, l_extendedprice,
       CASE WHEN l_discount = 0 THEN 'N/A' ELSE l_shipmode END AS top_price
FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("levels", F.expr("""
        if(l_discount = 0, cast(array() as array<struct<price: string>>),
           array(named_struct('price', l_returnflag || l_linestatus), named_struct('price', 'second')))"""))
    return lines.select("l_orderkey", "l_linenumber", "l_extendedprice",
                        landing.best_price(F.col("levels")).alias("top_price"))


# ------------------------------------------------------------------ clock

@query("f14_second_distance", """
SELECT event_id, date_diff('second', ts, ts + to_milliseconds(CAST(value * 100 AS BIGINT))) AS seconds FROM events""")
def _(spark, sf):
    later = F.expr("timestampadd(MILLISECOND, cast(round(value * 100) as int), ts)")
    return table(spark, sf, "events").select(
        "event_id", (clock.epoch_second(later) - clock.epoch_second(F.col("ts"))).alias("seconds"))


# --------------------------------------------------------------- staging models

@query("w2_dedup_any", f"WITH {TRADES_SQL} SELECT * FROM trades")
def _(spark, sf):
    return staging.trades(inputs.trades_raw(spark, sf)).withColumn("trade_conditions", F.array_join("trade_conditions", ","))


@query("w1_keep_latest", f"WITH {QUOTES_SQL} SELECT * FROM quotes")
def _(spark, sf):
    return staging.quotes(inputs.quotes_raw(spark, sf))


@query("j5_flatten_map", f"""
WITH {BARS_SQL} SELECT * REPLACE (CAST(candle_date AS VARCHAR) AS candle_date) FROM bar_messages""")
def _(spark, sf):
    return plain(staging.parse_bars(inputs.bars_raw(spark, sf)), candle_date="string")


@query("w3_candles", f"""
WITH {BARS_SQL} SELECT * REPLACE (CAST(candle_date AS VARCHAR) AS candle_date) FROM bars""")
def _(spark, sf):
    return plain(staging.bars(inputs.bars_raw(spark, sf)), candle_date="string")


@query("j4_flatten_array", """
SELECT CAST(doc_id AS VARCHAR) AS article_uuid, entity AS entity_ticker,
       CASE WHEN length(entity) > 0 THEN length(entity) / 100.0::DOUBLE END AS sentiment_score, source AS entity_name
FROM (SELECT *, unnest(string_split(text, chr(10))) AS entity FROM documents)""")
def _(spark, sf):
    return staging.parse_entity_news(inputs.entity_news_raw(spark, sf)).select(
        "article_uuid", "entity_ticker", "sentiment_score", "entity_name")


@query("w4_entity_news", f"WITH {ENTITY_NEWS_SQL} SELECT * FROM entity_news")
def _(spark, sf):
    return plain(staging.entity_news(inputs.entity_news_raw(spark, sf)), published_timestamp="timestamp_ntz")


@query("w5_headlines", f"WITH {HEADLINES_SQL} SELECT * FROM headlines")
def _(spark, sf):
    return plain(staging.headlines(inputs.headlines_raw(spark, sf)), published_timestamp="timestamp_ntz")


# ----------------------------------------------------------------- unified models

TICKS_SQL = f"""{QUOTES_SQL}, {TRADES_SQL},
ticks AS (
  SELECT asset_ticker AS stock_ticker, event_timestamp, (best_bid_price + best_ask_price) / 2.0 AS trade_price,
         best_bid_volume + best_ask_volume AS trade_volume, CAST(NULL AS VARCHAR) AS trade_conditions,
         'AllTick' AS price_source FROM quotes
  UNION ALL
  SELECT stock_ticker, event_timestamp, trade_price, trade_volume, trade_conditions, 'Finnhub' FROM trades)"""


def market_ticks(spark, sf) -> DataFrame:
    return unified.market_ticks(staging.quotes(inputs.quotes_raw(spark, sf)),
                                staging.trades(inputs.trades_raw(spark, sf)))


@query("u1_union_ticks", f"WITH {TICKS_SQL} SELECT * FROM ticks")
def _(spark, sf):
    return market_ticks(spark, sf).withColumn("trade_conditions", F.array_join("trade_conditions", ","))


@query("p13_mid_price", f"""
WITH {QUOTES_SQL}
SELECT sequence_id, asset_ticker AS stock_ticker, (best_bid_price + best_ask_price) / 2.0 AS mid,
       best_bid_volume + best_ask_volume AS liquidity FROM quote_messages""")
def _(spark, sf):
    quotes = staging.parse_quotes(inputs.quotes_raw(spark, sf))
    return quotes.select("sequence_id", F.col("asset_ticker").alias("stock_ticker"),
                         pricing.mid_price(F.col("best_bid_price"), F.col("best_ask_price")).alias("mid"),
                         pricing.joint_volume(F.col("best_bid_volume"), F.col("best_ask_volume")).alias("liquidity"))


def titled(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id", f"{TITLE} AS title", f"{REST} AS description", "lang")


TITLED_SQL = f"titled AS (SELECT doc_id, {TITLE_SQL} AS title, {REST_SQL} AS description, lang FROM documents)"


@query("p9_classifier", f"""
WITH {TITLED_SQL}
SELECT doc_id, {rules_sql(names.TICKER_RULES)} AS ticker, {rules_sql(WORD_RULES)} AS ticker_by_words FROM titled""")
def _(spark, sf):
    title, description = F.col("title"), F.col("description")
    return titled(spark, sf).select("doc_id", text.ticker_by_rules(title, description).alias("ticker"),
                                    text.ticker_by_rules(title, description, WORD_RULES).alias("ticker_by_words"))


@query("p18_text_payload", f"""
WITH {TITLED_SQL}
SELECT doc_id, trim(title || ' - ' || coalesce(description, lang, ''), ' ') AS nlp_text_payload FROM titled""")
def _(spark, sf):
    return titled(spark, sf).select("doc_id", text.news_payload(
        F.col("title"), F.col("description"), F.col("lang")).alias("nlp_text_payload"))


@query("f7_hashed_key", f"""
SELECT doc_id, md5({TITLE_SQL} || strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(n_chars),
                                            '%Y-%m-%d %H:%M:%S.%g +0000')) AS news_id
FROM documents""")
def _(spark, sf):
    published = F.expr("timestamp_seconds(unix_seconds(timestamp'2024-01-01 00:00:00') + n_chars * 60)")
    return table(spark, sf, "documents").select("doc_id", text.headline_id(F.expr(TITLE), published).alias("news_id"))


NEWS_SQL = f"""{ENTITY_NEWS_SQL}, {HEADLINES_SQL},
news AS (
  SELECT article_uuid AS news_id, entity_ticker AS asset_ticker, sentiment_score, title, description,
         snippet AS content_body, CAST(NULL AS VARCHAR) AS author, news_source, CAST(NULL AS VARCHAR) AS image_url,
         language, published_timestamp, 'MarketAux' AS api_provider
  FROM entity_news
  UNION ALL
  SELECT * FROM (
    SELECT md5(title || strftime(published_timestamp, '%Y-%m-%d %H:%M:%S.%g +0000')) AS news_id,
           {rules_sql(WORD_RULES)} AS asset_ticker, 0.0::DOUBLE AS sentiment_score, title, description,
           content AS content_body, author, source_name AS news_source, image_url, 'en' AS language,
           published_timestamp, 'NewsAPI' AS api_provider
    FROM headlines) WHERE asset_ticker <> 'UNKNOWN_PORTFOLIO')"""


def all_news(spark, sf) -> DataFrame:
    return unified.news(staging.entity_news(inputs.entity_news_raw(spark, sf)),
                        staging.headlines(inputs.headlines_raw(spark, sf)), WORD_RULES)


@query("u2_union_filtered", f"WITH {NEWS_SQL} SELECT * FROM news")
def _(spark, sf):
    return plain(all_news(spark, sf), published_timestamp="timestamp_ntz")


# ------------------------------------------------------------ windows and baselines

@query("w6_trailing_stats", """
SELECT o_orderkey, o_orderpriority,
       round(avg(o_totalprice) OVER w, 6) AS sma_20, round(stddev_samp(o_totalprice) OVER w, 3) AS volatility_20
FROM orders
WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    rolled = rolling.trailing_stats(orders, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return rolled.select("o_orderkey", "o_orderpriority", F.round("mean", 6).alias("sma_20"),
                         F.round("deviation", 3).alias("volatility_20"))


BASELINES_SQL = f"""{BARS_SQL},
baselines AS (
  SELECT stock_ticker, close_price AS yesterday_close, avg(close_price) OVER w AS sma_20,
         stddev_samp(close_price) OVER w AS historical_volatility_20d
  FROM bars
  WINDOW w AS (PARTITION BY stock_ticker ORDER BY candle_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
  QUALIFY row_number() OVER (PARTITION BY stock_ticker ORDER BY candle_date DESC NULLS FIRST) = 1)"""


@query("w8_latest_baseline", f"""
WITH {BASELINES_SQL}
SELECT stock_ticker, yesterday_close, round(sma_20, 6) AS sma_20,
       round(historical_volatility_20d, 3) AS historical_volatility_20d FROM baselines""")
def _(spark, sf):
    base = marts.baselines(staging.bars(inputs.bars_raw(spark, sf)))
    return rounded(rounded(base, "sma_20"), "historical_volatility_20d", digits=3)


# ------------------------------------------------------------------ marts

FEATURES_OF_TICKS_SQL = """
features AS (
  SELECT md5(l.stock_ticker) AS asset_key, l.stock_ticker, l.event_timestamp, l.trade_price AS live_price,
         l.trade_volume AS live_volume, coalesce(h.yesterday_close, l.trade_price) AS baseline_close,
         coalesce(h.sma_20, l.trade_price) AS sma_20_baseline,
         coalesce(h.historical_volatility_20d, 0.0) AS rolling_volatility,
         (l.trade_price - coalesce(h.sma_20, l.trade_price))
           / nullif(coalesce(h.sma_20, l.trade_price), 0) * 100.0 AS price_deviation_pct
  FROM ticks l LEFT JOIN baselines h ON l.stock_ticker = h.stock_ticker)"""
FEATURES_SQL = f"{TICKS_SQL}, {BASELINES_SQL}, {FEATURES_OF_TICKS_SQL}"
FEATURE_ROWS_SQL = """
SELECT asset_key, stock_ticker, event_timestamp, live_price, live_volume, baseline_close,
       round(sma_20_baseline, 6) AS sma_20_baseline, round(rolling_volatility, 3) AS rolling_volatility,
       round(price_deviation_pct, 3) AS price_deviation_pct FROM features"""


def market_features(spark, sf) -> DataFrame:
    return marts.market_features(market_ticks(spark, sf), staging.bars(inputs.bars_raw(spark, sf)), AS_OF)


def feature_rows(features: DataFrame) -> DataFrame:
    kept = rounded(features.drop("dw_inserted_at"), "sma_20_baseline")
    return rounded(kept, "rolling_volatility", "price_deviation_pct", digits=3)


@query("m_market_features", f"WITH {FEATURES_SQL} {FEATURE_ROWS_SQL}")
def flagship(spark, sf):
    return feature_rows(market_features(spark, sf))


@query("j1_left_baseline", """
SELECT e.event_id, e.value, coalesce(c.c_acctbal, e.value) AS baseline
FROM events e LEFT JOIN customer c ON e.user_id * 20 = c.c_custkey""")
def _(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("number"), "c_acctbal")
    events = table(spark, sf, "events").withColumn("number", F.col("user_id") * 20)
    return lookup.lookup_join(events, base, ["number"]).select(
        "event_id", "value", F.coalesce("c_acctbal", "value").alias("baseline"))


@query("j1_left_baseline_shuffled", """
SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag, l.l_extendedprice, p.n AS flag_rows
FROM lineitem l LEFT JOIN (SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) p
  ON l.l_returnflag = p.l_returnflag""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    per_flag = (lines.filter("l_returnflag <> 'N'").groupBy("l_returnflag")
                .agg(F.count(F.lit(1)).alias("flag_rows")))
    return lookup.skew_join(lines, per_flag, ["l_returnflag"], min_rows=1000)


# Every third line item is a quote of one ticker, so that it has a third of all ticks.
@query("j1_asof_baseline", f"""
WITH {QUOTES_SQL}, {BARS_SQL},
ticks AS (
  SELECT CASE WHEN sequence_id % 3 = 0 THEN '7' ELSE asset_ticker END AS stock_ticker, event_timestamp,
         (best_bid_price + best_ask_price) / 2.0 AS trade_price, best_bid_volume + best_ask_volume AS trade_volume
  FROM quotes),
days AS (
  SELECT stock_ticker, candle_date, close_price AS yesterday_close, avg(close_price) OVER w AS sma_20,
         stddev_samp(close_price) OVER w AS historical_volatility_20d
  FROM bars
  WINDOW w AS (PARTITION BY stock_ticker ORDER BY candle_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
features AS (
  SELECT md5(l.stock_ticker) AS asset_key, l.stock_ticker, l.event_timestamp, l.trade_price AS live_price,
         l.trade_volume AS live_volume, coalesce(h.yesterday_close, l.trade_price) AS baseline_close,
         coalesce(h.sma_20, l.trade_price) AS sma_20_baseline,
         coalesce(h.historical_volatility_20d, 0.0) AS rolling_volatility,
         (l.trade_price - coalesce(h.sma_20, l.trade_price))
           / nullif(coalesce(h.sma_20, l.trade_price), 0) * 100.0 AS price_deviation_pct
  FROM ticks l ASOF LEFT JOIN days h
    ON l.stock_ticker = h.stock_ticker AND CAST(l.event_timestamp AS DATE) > h.candle_date)
{FEATURE_ROWS_SQL}""")
def _(spark, sf):
    quotes = staging.quotes(inputs.quotes_raw(spark, sf))
    ticker = F.when(F.pmod("sequence_id", F.lit(3)) == 0, F.lit("7")).otherwise(F.col("stock_ticker"))
    ticks = unified.quotes_as_ticks(quotes, ["sequence_id"]).withColumn("stock_ticker", ticker)
    return feature_rows(marts.market_features_as_of(ticks, staging.bars(inputs.bars_raw(spark, sf)), AS_OF))


@query("p16_deviation", """
SELECT event_id, (value - user_id) / nullif(user_id::DOUBLE, 0) * 100.0 AS deviation FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", pricing.deviation_pct(F.col("value"), F.col("user_id").cast("double")).alias("deviation"))


@query("m_daily_history", f"""
WITH {BARS_SQL}
SELECT md5(stock_ticker) AS asset_key, stock_ticker, CAST(candle_date AS VARCHAR) AS candle_date, open_price, high_price,
       low_price, close_price, trading_volume, high_price - low_price AS daily_price_range, api_refreshed_at FROM bars""")
def _(spark, sf):
    return plain(marts.daily_history(staging.bars(inputs.bars_raw(spark, sf))), candle_date="string")


@query("m_realtime_stream", f"""
WITH {TICKS_SQL}
SELECT md5(stock_ticker) AS asset_key, stock_ticker, event_timestamp, trade_price, trade_volume, price_source FROM ticks""")
def _(spark, sf):
    return marts.realtime_stream(market_ticks(spark, sf), AS_OF).drop("dw_inserted_at")


@query("s8_full_refresh", f"""
WITH {TICKS_SQL}
SELECT md5(stock_ticker) AS asset_key, stock_ticker, event_timestamp, trade_price, trade_volume, price_source FROM ticks""")
def _(spark, sf):
    tables = Tables(spark, scratch(spark, "models"))
    ticks = tables.replace(names.INT_TICKS, market_ticks(spark, sf))
    return tables.replace(names.FCT_STREAM, marts.realtime_stream(ticks, AS_OF)).drop("dw_inserted_at")


NEWS_INPUTS_SQL = f"""{NEWS_SQL},
news_inputs AS (
  SELECT md5(asset_ticker) AS asset_key, news_id, asset_ticker,
         trim(title || ' - ' || coalesce(description, content_body, ''), ' ') AS nlp_text_payload,
         sentiment_score AS baseline_sentiment, news_source, published_timestamp
  FROM news WHERE language = 'en' AND title IS NOT NULL AND asset_ticker <> 'UNKNOWN_PORTFOLIO')"""


@query("m_nlp_inputs", f"WITH {NEWS_INPUTS_SQL} SELECT * FROM news_inputs")
def _(spark, sf):
    return plain(marts.news_inputs(all_news(spark, sf), AS_OF).drop("dw_inserted_at"), published_timestamp="timestamp_ntz")


# Headlines point to tickers that have ticks, so that news are scored and predictions settled.
MARKET_RULES = tuple((word, symbol, ticker) for (word, symbol, _), ticker in zip(WORD_RULES, ("20", "40", "60", "80")))
DAY_SECONDS = 86400
WHOLE_REFRESH_SQL = f"""
WITH {FEATURES_SQL}, {NEWS_INPUTS_SQL.replace(rules_sql(WORD_RULES), rules_sql(MARKET_RULES))},
latest AS (
  SELECT * FROM features QUALIFY row_number() OVER (PARTITION BY stock_ticker ORDER BY event_timestamp DESC,
    live_price DESC NULLS LAST, live_volume DESC NULLS LAST, price_deviation_pct DESC NULLS LAST, rolling_volatility DESC) = 1),
made AS (
  SELECT row_number() OVER () AS prediction_id, m.stock_ticker, TIMESTAMP '2024-01-20 12:05:00' AS target_window,
         CAST(format('{{:.4f}}', m.live_price + m.price_deviation_pct / 100.0 * m.live_price + m.rolling_volatility * 0.1)
           AS DOUBLE) AS predicted_future_price
  FROM news_inputs n JOIN latest m ON n.asset_ticker = m.stock_ticker),
settled AS (
  SELECT m.prediction_id, t.trade_price AS actual_price
  FROM made m JOIN ticks t ON m.stock_ticker = t.stock_ticker AND t.trade_price IS NOT NULL
   AND abs(date_diff('second', t.event_timestamp, m.target_window)) <= {DAY_SECONDS}
  QUALIFY row_number() OVER (PARTITION BY m.prediction_id
    ORDER BY t.event_timestamp DESC, t.price_source DESC, t.trade_price DESC) = 1)
SELECT 'int_unified_market_ticks' AS model, count(*) AS rows, round(avg(trade_price), 3) AS mean FROM ticks
UNION ALL SELECT 'fct_realtime_market_stream', count(*), round(avg(trade_price), 3) FROM ticks
UNION ALL SELECT 'fct_market_ml_features', count(*), round(avg(sma_20_baseline), 3) FROM features
UNION ALL SELECT 'fct_daily_market_history', count(*), round(avg(close_price), 3) FROM bars
UNION ALL SELECT 'int_unified_news', count(*), round(avg(sentiment_score), 3) FROM news
UNION ALL SELECT 'fct_nlp_feature_inputs', count(*), round(avg(baseline_sentiment), 3) FROM news_inputs
UNION ALL SELECT 'dim_assets', {len(names.ASSETS)}, NULL
UNION ALL SELECT 'fct_model_predictions', count(*), round(avg(predicted_future_price), 2) FROM made
UNION ALL SELECT 'outcomes', count(*), round(avg(actual_price), 2) FROM settled"""


@query("s8_whole_refresh", WHOLE_REFRESH_SQL)
def _(spark, sf):
    """All seven models from the raw tables, then scores, then outcomes; replaced twice, as by two cycles."""
    tables, root = Tables(spark, scratch(spark, "models"), keep=1), scratch(spark, "bronze")
    for part in range(2):
        bronze.append_batch(inputs.all_messages(spark, sf, "2024-01-10", part), root, f"delivery-{part}")
        refresh.transform(tables, root, AS_OF, MARKET_RULES)
    refresh.score(tables, AS_OF)
    refresh.evaluate(tables, "2024-01-20 12:05:00", seconds=DAY_SECONDS)
    measured = {names.INT_TICKS: "trade_price", names.FCT_STREAM: "trade_price", names.FCT_FEATURES: "sma_20_baseline", names.FCT_HISTORY: "close_price",
                names.INT_NEWS: "sentiment_score", names.FCT_NEWS_INPUTS: "baseline_sentiment", names.DIM_ASSETS: "cast(null as double)"}
    rows = [(model, tables.read(model), value, 3) for model, value in measured.items()]
    rows += [(names.FCT_PREDICTIONS, tables.read(names.FCT_PREDICTIONS), "predicted_future_price", 2), ("outcomes", refresh.outcomes_table(tables), "actual_price", 2)]
    return reduce(DataFrame.unionByName, [df.agg(F.lit(model).alias("model"), F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.expr(value)), digits).alias("mean"))
                                          for model, df, value, digits in rows])


def refreshed_twice(spark, sf) -> Tables:
    """Models after two deliveries, of which either has messages of every day, each followed by a refresh."""
    tables, root = Tables(spark, scratch(spark, "models"), keep=1), scratch(spark, "bronze")
    for part, day in enumerate(("2024-01-10", "2024-01-11")):
        bronze.append_batch(inputs.all_messages(spark, sf, day, part), root, f"delivery-{part}")
        incremental.transform(tables, root, AS_OF, WORD_RULES, groups=2, block=1_000_000)
    return tables


@query("t2_incremental_refresh", f"WITH {FEATURES_SQL} {FEATURE_ROWS_SQL}")
def _(spark, sf):
    return feature_rows(refreshed_twice(spark, sf).read(names.FCT_FEATURES))


@query("t2_incremental_news", f"WITH {NEWS_INPUTS_SQL} SELECT * FROM news_inputs")
def _(spark, sf):
    news = refreshed_twice(spark, sf).read(names.FCT_NEWS_INPUTS)
    return plain(news.drop("dw_inserted_at"), published_timestamp="timestamp_ntz")


def tickered(spark, sf) -> DataFrame:
    docs = titled(spark, sf)
    return docs.select("doc_id", text.asset_key(text.ticker_by_rules(
        F.col("title"), F.col("description"))).alias("asset_key"))


DIM_SQL = "dim(asset_ticker, asset_name, asset_class, risk_profile) AS (VALUES " + ", ".join(
    "('" + "', '".join((row[0], row[1], row[2], row[5])) + "')" for row in names.ASSETS) + ")"


@query("j6_star_join", f"""
WITH {TITLED_SQL}, {DIM_SQL},
facts AS (SELECT doc_id, md5({rules_sql(names.TICKER_RULES)}) AS asset_key FROM titled)
SELECT f.doc_id, f.asset_key, d.asset_name, d.asset_class, d.risk_profile
FROM facts f LEFT JOIN dim d ON f.asset_key = md5(d.asset_ticker)""")
def _(spark, sf):
    return marts.with_asset(tickered(spark, sf), marts.assets(spark, AS_OF)).select(
        "doc_id", "asset_key", "asset_name", "asset_class", "risk_profile")


@query("j6_orphans", f"""
WITH {TITLED_SQL}, {DIM_SQL},
facts AS (SELECT doc_id, md5({rules_sql(names.TICKER_RULES)}) AS asset_key FROM titled)
SELECT doc_id, asset_key FROM facts WHERE asset_key NOT IN (SELECT md5(asset_ticker) FROM dim)""")
def _(spark, sf):
    return marts.orphans(tickered(spark, sf), marts.assets(spark, AS_OF)).select("doc_id", "asset_key")


# ------------------------------------------------------------- scoring

@query("d2_signed_score", """
SELECT event_id, CASE event_type WHEN 'click' THEN value WHEN 'view' THEN -value ELSE 0.0 END AS sentiment FROM events""")
def _(spark, sf):
    answers = table(spark, sf, "events").withColumn("answer", F.expr("""
        CASE event_type
          WHEN 'click' THEN to_json(array(array(named_struct('label', 'positive', 'score', value),
                                                named_struct('label', 'negative', 'score', 1 - value))))
          WHEN 'view' THEN to_json(array(array(named_struct('label', 'negative', 'score', value))))
          WHEN 'purchase' THEN to_json(array(array(named_struct('label', 'neutral', 'score', value))))
          WHEN 'signup' THEN '[]'
          ELSE to_json(named_struct('error', props)) END"""))
    return answers.select("event_id", text.score_of_response(F.col("answer")).alias("sentiment"))


def by_words(column):
    return text.word_sentiment(column, inputs.GOOD_WORDS, inputs.BAD_WORDS)


@query("d1_word_sentiment", f"SELECT doc_id, round({sentiment_sql('text')}, 6) AS sentiment FROM documents")
def _(spark, sf):
    scored = predictions.with_sentiment(table(spark, sf, "documents"), "text", expression=by_words)
    return rounded(scored.select("doc_id", "sentiment"), "sentiment")


def load_word_model():
    """A model in Python that counts the same words, for the plug-in path."""
    import re
    good, bad = frozenset(inputs.GOOD_WORDS), frozenset(inputs.BAD_WORDS)
    words = re.compile("[a-z]+")

    def score(texts):
        answers = []
        for body in texts:
            found = words.findall(body.lower())
            up, down = sum(w in good for w in found), sum(w in bad for w in found)
            label = "positive" if up > down else "negative" if up < down else "neutral"
            answers.append((label, abs(up - down) / (up + down) if up + down else 0.0))
        return answers

    return score


@query("d1_model_scoring", f"""
SELECT doc_id, round({sentiment_sql('text')}, 6) AS sentiment, 'ok' AS score_status FROM documents""")
def _(spark, sf):
    scored = predictions.with_sentiment(table(spark, sf, "documents"), "text", load_word_model)
    return rounded(scored.select("doc_id", "sentiment", "score_status"), "sentiment")


@query("d3_projection", """
SELECT event_id, CAST(format('{:.4f}', value + user_id / 100.0 * value + event_id * 0.1) AS DOUBLE) AS projected FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", pricing.projected_price(
        F.col("value"), F.col("user_id").cast("double"), F.col("event_id").cast("double")).alias("projected"))


@query("f15_rounding", """
SELECT o_orderkey, CAST(format('{:.4f}', o_totalprice / 1000) AS DOUBLE) AS rounded FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", pricing.rounded(F.col("o_totalprice") / 1000, 4).alias("rounded"))


def event_features(events: DataFrame) -> DataFrame:
    """Every event as a feature row of its type."""
    return events.select(
        F.col("event_type").alias("stock_ticker"), F.col("ts").alias("event_timestamp"),
        F.col("value").alias("live_price"), F.col("user_id").cast("double").alias("live_volume"),
        F.col("value").alias("sma_20_baseline"),
        (F.col("value") * 2).alias("price_deviation_pct"), (F.col("value") / 4).alias("rolling_volatility"))


LATEST_SQL = """
latest AS (
  SELECT event_type AS stock_ticker, value AS live_price, value * 2 AS price_deviation_pct, value / 4 AS rolling_volatility
  FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC, user_id DESC) = 1)"""


@query("a3_last_per_key", f"WITH {LATEST_SQL} SELECT * FROM latest")
def _(spark, sf):
    return predictions.latest_market(event_features(table(spark, sf, "events")))


def document_news(documents: DataFrame) -> DataFrame:
    """Every document as news; its language decides the ticker."""
    return documents.selectExpr(
        "md5(cast(lang as binary)) AS asset_key",
        "CASE lang WHEN 'en' THEN 'click' WHEN 'fr' THEN 'view' WHEN 'de' THEN 'purchase' ELSE 'no such' END AS asset_ticker",
        "cast(doc_id as string) AS news_id", "text AS nlp_text_payload",
        "timestamp_seconds(n_chars) AS published_timestamp")


DOCUMENT_NEWS_SQL = """
document_news AS (
  SELECT md5(lang) AS asset_key, CAST(doc_id AS VARCHAR) AS news_id, text AS nlp_text_payload, n_chars,
         CASE lang WHEN 'en' THEN 'click' WHEN 'fr' THEN 'view' WHEN 'de' THEN 'purchase' ELSE 'no such' END AS asset_ticker
  FROM documents)"""


@query("j2_lookup", f"""
WITH {LATEST_SQL}, {DOCUMENT_NEWS_SQL}
SELECT n.news_id, n.asset_ticker, m.live_price FROM document_news n JOIN latest m ON n.asset_ticker = m.stock_ticker""")
def _(spark, sf):
    rows = predictions.news_with_market(document_news(table(spark, sf, "documents")),
                                        event_features(table(spark, sf, "events")))
    return rows.select("news_id", "asset_ticker", "live_price")


PREDICTED_SQL = f"""
SELECT md5(coalesce(n.news_id, '') || '|' || n.asset_ticker || '|' || coalesce(n.nlp_text_payload, '') || '|' ||
           row_number() OVER (PARTITION BY n.news_id, n.asset_ticker, n.nlp_text_payload ORDER BY n.n_chars) ||
           '|2024-01-20 12:00:00') AS prediction_id, n.asset_key,
       n.asset_ticker AS stock_ticker, TIMESTAMP '2024-01-20 12:00:00' AS predicted_at,
       TIMESTAMP '2024-01-20 12:05:00' AS target_window,
       round({sentiment_sql('n.nlp_text_payload')}, 6) AS predicted_sentiment_score,
       CAST(format('{{:.4f}}', m.live_price + m.price_deviation_pct / 100.0 * m.live_price + m.rolling_volatility * 0.1)
         AS DOUBLE) AS predicted_future_price
FROM document_news n JOIN latest m ON n.asset_ticker = m.stock_ticker"""


def made_predictions(spark, sf, limit: int | None = None) -> DataFrame:
    made = predictions.predict(document_news(table(spark, sf, "documents")),
                               event_features(table(spark, sf, "events")), AS_OF, limit=limit, expression=by_words)
    return rounded(made, "predicted_sentiment_score")


@query("f16_prediction_ids", f"""
WITH {LATEST_SQL}, {DOCUMENT_NEWS_SQL}
SELECT count(*) AS predictions, count(*) AS ids FROM document_news n JOIN latest m ON n.asset_ticker = m.stock_ticker""")
def _(spark, sf):
    news = document_news(table(spark, sf, "documents")).withColumn("news_id", F.when(F.col("asset_ticker") != "click", F.col("news_id")))
    made = predictions.predict(news, event_features(table(spark, sf, "events")), AS_OF, expression=by_words)
    return made.agg(F.count(F.lit(1)).alias("predictions"), F.count_distinct("prediction_id").alias("ids"))


@query("m_predictions", f"WITH {LATEST_SQL}, {DOCUMENT_NEWS_SQL} {PREDICTED_SQL}")
def _(spark, sf):
    return made_predictions(spark, sf)


@query("l2_newest_scored", f"""
WITH {LATEST_SQL}, {DOCUMENT_NEWS_SQL}, newest AS (
  SELECT * FROM document_news ORDER BY n_chars DESC, news_id, asset_ticker LIMIT 10)
{PREDICTED_SQL.replace('document_news', 'newest')}""")
def _(spark, sf):
    return made_predictions(spark, sf, limit=10)


# ---------------------------------------------------------- evaluation

def event_outcomes(spark, sf) -> DataFrame:
    return evaluation.evaluate(inputs.predictions(spark, sf), inputs.realised(spark, sf), AS_OF,
                               seconds=inputs.MATCH_SECONDS)


@query("j3_tolerance_join", f"WITH {evaluated_sql()} SELECT prediction_id, actual_price FROM outcomes")
def _(spark, sf):
    return event_outcomes(spark, sf).select("prediction_id", "actual_price")


@query("j3_tolerance_join_10s", f"WITH {evaluated_sql(10)} SELECT prediction_id, actual_price FROM outcomes")
def _(spark, sf):
    rows = evaluation.evaluate(inputs.predictions(spark, sf), inputs.realised(spark, sf), AS_OF)
    return rows.select("prediction_id", "actual_price")


@query("p20_evaluate", f"""
WITH {evaluated_sql()}
SELECT prediction_id, actual_price, price_error_variance, is_prediction_correct FROM outcomes""")
def _(spark, sf):
    return event_outcomes(spark, sf).drop("dw_inserted_at")


@query("m_evaluated_predictions", f"""
WITH {LATEST_SQL}, {DOCUMENT_NEWS_SQL}, {PREDICTIONS_SQL.replace('predictions AS', 'event_predictions AS')},
made AS ({PREDICTED_SQL}),
matched AS (
  SELECT m.prediction_id, r.trade_price AS actual_price
  FROM made m JOIN realised r ON m.stock_ticker = r.stock_ticker
   AND abs(date_diff('second', r.event_timestamp, m.target_window)) <= 3600
  QUALIFY row_number() OVER (PARTITION BY m.prediction_id
    ORDER BY r.event_timestamp DESC, r.price_source DESC, r.trade_price DESC) = 1)
SELECT m.prediction_id, m.stock_ticker, m.target_window, m.predicted_future_price, x.actual_price,
       x.actual_price - m.predicted_future_price AS price_error_variance,
       abs(x.actual_price - m.predicted_future_price) / nullif(x.actual_price, 0) <= 0.01 AS is_prediction_correct
FROM made m LEFT JOIN matched x ON m.prediction_id = x.prediction_id""")
def _(spark, sf):
    made = made_predictions(spark, sf)
    due = evaluation.pending(made, None, "2024-01-20 12:05:00")
    done = evaluation.evaluate(due, inputs.realised(spark, sf), AS_OF, seconds=3600)
    return evaluation.merged(made, done).select(
        "prediction_id", "stock_ticker", "target_window", "predicted_future_price", "actual_price",
        "price_error_variance", "is_prediction_correct")


@query("a4_batch_counts", f"""
WITH {PREDICTIONS_SQL}
SELECT stock_ticker, count(*) AS made, count(*) FILTER (target_window <= TIMESTAMP '{AS_OF}') AS due
FROM predictions GROUP BY 1""")
def _(spark, sf):
    made = inputs.predictions(spark, sf)
    due = evaluation.pending(made, None, AS_OF).groupBy("stock_ticker").agg(F.count(F.lit(1)).alias("due"))
    counts = made.groupBy("stock_ticker").agg(F.count(F.lit(1)).alias("made"))
    return counts.join(due, "stock_ticker", "left").withColumn("due", F.coalesce("due", F.lit(0).cast("bigint")))


# Purchases have been evaluated before; the rest is pending once its moment has come.
EARLIER_SQL = """
earlier AS (SELECT prediction_id, predicted_future_price + 1 AS actual_price FROM predictions WHERE stock_ticker = 'purchase')"""


def earlier_outcomes(made: DataFrame) -> DataFrame:
    return made.filter("stock_ticker = 'purchase'").select(
        "prediction_id", (F.col("predicted_future_price") + 1).alias("actual_price"),
        F.lit(1.0).alias("price_error_variance"), F.lit(True).alias("is_prediction_correct"),
        F.lit(AS_OF).cast("timestamp").alias("dw_inserted_at"))


@query("p19_pending", f"""
WITH {PREDICTIONS_SQL}, {EARLIER_SQL}
SELECT prediction_id, stock_ticker, target_window FROM predictions
WHERE target_window <= TIMESTAMP '{AS_OF}' AND prediction_id NOT IN (SELECT prediction_id FROM earlier)""")
def _(spark, sf):
    made = inputs.predictions(spark, sf)
    return evaluation.pending(made, earlier_outcomes(made), AS_OF).select("prediction_id", "stock_ticker", "target_window")


@query("s13_merged_updates", f"""
WITH {PREDICTIONS_SQL}, {EARLIER_SQL}
SELECT p.prediction_id, p.stock_ticker, p.predicted_future_price, e.actual_price,
       CASE WHEN e.prediction_id IS NOT NULL THEN true END AS is_prediction_correct
FROM predictions p LEFT JOIN earlier e ON p.prediction_id = e.prediction_id""")
def _(spark, sf):
    made = inputs.predictions(spark, sf)
    return evaluation.merged(made, earlier_outcomes(made)).select(
        "prediction_id", "stock_ticker", "predicted_future_price", "actual_price", "is_prediction_correct")


@query("s12_append_once", f"""
WITH {PREDICTIONS_SQL} SELECT prediction_id, stock_ticker FROM predictions WHERE stock_ticker <> 'purchase'""")
def _(spark, sf):
    made = inputs.predictions(spark, sf)
    return predictions.not_yet_stored(made, made.filter("stock_ticker = 'purchase'")).select(
        "prediction_id", "stock_ticker")


def evaluated(spark, sf) -> DataFrame:
    made = inputs.predictions(spark, sf)
    return evaluation.merged(made, event_outcomes(spark, sf))


def totals(hit_rate: str, abs_error: str, error: str) -> list:
    """Means as sums: sums of cents have few digits, so no mean is cut at an exact half."""
    return [F.round(F.col(mean) * F.col("predictions"), 4).alias(name)
            for mean, name in ((hit_rate, "hits"), (abs_error, "abs_error"), (error, "error"))]


DAILY_SQL = f"""{evaluated_sql()},
daily AS (
  SELECT stock_ticker, CAST(target_window AS DATE) AS target_day, count(*) AS predictions,
         avg(is_prediction_correct::INT::DOUBLE) AS hit_rate, avg(abs(price_error_variance)) AS mean_abs_error,
         avg(price_error_variance) AS mean_error
  FROM outcomes GROUP BY 1, 2)"""


@query("a5_accuracy", f"""
WITH {DAILY_SQL}
SELECT stock_ticker, CAST(target_day AS VARCHAR) AS target_day, predictions, round(hit_rate * predictions, 4) AS hits,
       round(mean_abs_error * predictions, 4) AS abs_error, round(mean_error * predictions, 4) AS error,
       round(hit_rate - avg(hit_rate) OVER w, 7) AS hit_rate_drift,
       round(mean_abs_error - avg(mean_abs_error) OVER w, 7) AS abs_error_drift
FROM daily WINDOW w AS (PARTITION BY stock_ticker ORDER BY target_day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def _(spark, sf):
    days = evaluation.accuracy(evaluated(spark, sf))
    return days.select("stock_ticker", F.col("target_day").cast("string").alias("target_day"), "predictions",
                       *totals("hit_rate", "mean_abs_error", "mean_error"),
                       F.round("hit_rate_drift", 7).alias("hit_rate_drift"),
                       F.round("abs_error_drift", 7).alias("abs_error_drift"))


@query("a6_labelled_set", f"""
WITH {evaluated_sql()}
SELECT o.prediction_id, o.actual_price, f.live_price, f.rolling_volatility
FROM outcomes o LEFT JOIN (
  SELECT o.prediction_id, e.value AS live_price, e.value / 4 AS rolling_volatility
  FROM outcomes o JOIN events e ON o.stock_ticker = e.event_type
   AND e.ts BETWEEN o.predicted_at - INTERVAL 301 SECOND AND o.predicted_at + INTERVAL 1 SECOND
   AND date_diff('second', e.ts, o.predicted_at) BETWEEN 0 AND 300
  QUALIFY row_number() OVER (PARTITION BY o.prediction_id ORDER BY e.ts DESC, e.value DESC, e.user_id DESC) = 1) f
ON o.prediction_id = f.prediction_id""")
def _(spark, sf):
    rows = evaluation.labelled(evaluated(spark, sf), event_features(table(spark, sf, "events")))
    return rows.select("prediction_id", "actual_price", "live_price", "rolling_volatility")


# ---------------------------------------------------------------- streams

@query("t1_stream_to_bronze", BRONZE_SQL)
def _(spark, sf):
    root, log = scratch(spark, "bronze"), scratch(spark, "bronze-log")
    ingest.to_bronze(queue_records(inputs.stream(spark, sf, "events")), root, log).awaitTermination()
    return bronze_rows(spark.read.parquet(root))


@query("t2_repeated_trigger", BRONZE_SQL)
def _(spark, sf):
    root, log = scratch(spark, "bronze"), scratch(spark, "bronze-log")
    for _ in range(2):  # the second run finds nothing new
        ingest.to_bronze(queue_records(inputs.stream(spark, sf, "events")), root, log).awaitTermination()
    return bronze_rows(spark.read.parquet(root))


def in_two_starts(spark, rows, later, start) -> None:
    """Deliver ``rows`` in two starts of a stream on one checkpoint, the later ones first."""
    folder = scratch(spark, "delivered")
    for part in (rows.filter(later), rows.filter(~later)):
        part.write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


def logged_trades(spark, sf) -> str:
    root, log = scratch(spark, "trades"), scratch(spark, "trades-log")
    payloads = inputs.trade_payloads(table(spark, sf, "events")).withColumn("_late", F.xxhash64("raw_payload") % 2 == 0)
    in_two_starts(spark, payloads, F.col("_late"), lambda live: market.trade_log(live.drop("_late"), root, log))
    return root


@query("t3_stream_dedup_any", f"""
WITH {TRADES_SQL} SELECT stock_ticker, event_timestamp, trade_price, trade_volume FROM trades""")
def _(spark, sf):
    return market.logged_trades(spark, logged_trades(spark, sf)).drop("trade_conditions")


@query("t3_many_triggers", f"WITH {TRADES_SQL} SELECT * FROM trades")
def _(spark, sf):
    """Trades in sixteen triggers, whole rows."""
    root, log, folder = scratch(spark, "trades"), scratch(spark, "trades-log"), scratch(spark, "delivered")
    inputs.trade_payloads(table(spark, sf, "events")).repartition(16).write.parquet(folder)
    live = spark.readStream.schema("raw_payload string").option("maxFilesPerTrigger", 1).parquet(folder)
    market.trade_log(live, root, log).awaitTermination()
    return market.logged_trades(spark, root).withColumn("trade_conditions", F.array_join("trade_conditions", ","))


@query("t4_stream_keep_latest", f"WITH {QUOTES_SQL} SELECT * FROM quotes")
def _(spark, sf):
    root, log = scratch(spark, "quotes"), scratch(spark, "quotes-log")
    keys, order = ["asset_ticker", "sequence_id"], ["event_timestamp"]
    live = staging.parse_quotes(inputs.quote_payloads(inputs.stream(spark, sf, "lineitem")))
    stream_dedup.latest_log(live, keys, order, root, log).awaitTermination()
    return stream_dedup.current(spark, root, keys, order)


@query("t5_stream_enrich", f"""
WITH {QUOTES_SQL}, {BASELINES_SQL},
ticks AS (SELECT asset_ticker AS stock_ticker, event_timestamp, (best_bid_price + best_ask_price) / 2.0 AS trade_price,
                 best_bid_volume + best_ask_volume AS trade_volume FROM quote_messages),
{FEATURES_OF_TICKS_SQL} {FEATURE_ROWS_SQL}""")
def _(spark, sf):
    target, log = scratch(spark, "features"), scratch(spark, "features-log")
    live = unified.quotes_as_ticks(staging.parse_quotes(inputs.quote_payloads(inputs.stream(spark, sf, "lineitem"))))
    market.enrich(live, lambda: staging.bars(inputs.bars_raw(spark, sf)), target, log, AS_OF).awaitTermination()
    return feature_rows(spark.read.parquet(target).drop("batch"))


@query("t6_stream_union", f"""
WITH {QUOTES_SQL}, {TRADES_SQL}
SELECT asset_ticker AS stock_ticker, event_timestamp, (best_bid_price + best_ask_price) / 2.0 AS trade_price,
       best_bid_volume + best_ask_volume AS trade_volume, 'AllTick' AS price_source FROM quotes
UNION ALL
SELECT stock_ticker, event_timestamp, trade_price, trade_volume, 'Finnhub' FROM trades""")
def _(spark, sf):
    root, log = scratch(spark, "quotes"), scratch(spark, "quotes-log")
    market.quote_log(inputs.quote_payloads(inputs.stream(spark, sf, "lineitem")), root, log).awaitTermination()
    return market.logged_ticks(spark, root, logged_trades(spark, sf)).drop("trade_conditions")


@query("t7_stream_outcomes", f"""
WITH {evaluated_sql()}
SELECT prediction_id, actual_price, price_error_variance, is_prediction_correct FROM outcomes
WHERE target_window <= TIMESTAMP '{AS_OF}'""")
def _(spark, sf):
    """Ticks of some tickers come with each of three starts; purchases are settled by a scheduled run in between, and the last batch
    is delivered again, as after a failure before its commit."""
    tables, log, folder = Tables(spark, scratch(spark, "outcomes")), scratch(spark, "outcomes-log"), scratch(spark, "delivered")
    realised = inputs.realised(spark, sf)
    tables.append(names.FCT_PREDICTIONS, inputs.predictions(spark, sf))
    tables.replace(names.FCT_STREAM, realised.filter("stock_ticker = 'purchase'"))

    def start() -> None:
        outcomes.retry_pending(
            spark.readStream.schema(realised.schema).parquet(folder), lambda: tables.read(names.FCT_PREDICTIONS), lambda: spark.read.parquet(folder),
            lambda: refresh.outcomes_table(tables), tables.path(refresh.EVALUATIONS), log, AS_OF, seconds=inputs.MATCH_SECONDS).awaitTermination()

    for number, kinds in enumerate((("click", "signup"), ("view", "purchase"), ("error",))):
        realised.filter(F.col("stock_ticker").isin(*kinds)).write.mode("append").parquet(folder)
        start()
        if number == 0:
            refresh.evaluate(tables, AS_OF, seconds=inputs.MATCH_SECONDS)
    versions.Files(spark).delete(f"{log}/commits/2")
    start()
    return refresh.outcomes_table(tables).select(
        "prediction_id", "actual_price", "price_error_variance", "is_prediction_correct")


@query("t8_stream_accuracy", """
SELECT event_type AS stock_ticker, CAST(CAST(ts + INTERVAL 1 HOUR AS DATE) AS VARCHAR) AS target_day, count(*) AS predictions,
       round(avg((abs(value - user_id) / nullif(value, 0) <= 0.01)::INT) * count(*), 4) AS hits,
       round(sum(abs(value - user_id)), 4) AS abs_error, round(sum(value - user_id), 4) AS error
FROM events GROUP BY 1, 2""")
def _(spark, sf):
    target, log = scratch(spark, "accuracy"), scratch(spark, "accuracy-log")
    error = F.col("value") - F.col("user_id")
    settled = table(spark, sf, "events").select(
        F.col("event_type").alias("stock_ticker"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("target_window"),
        F.col("value").alias("actual_price"), error.alias("price_error_variance"),
        pricing.within_margin(error, F.col("value")).alias("is_prediction_correct"))
    later = F.xxhash64("target_window", "actual_price") % 2 == 0  # either start has outcomes of every day
    stored = {"rows": settled.filter(later)}

    def start(live):
        query = outcomes.daily_accuracy(live, lambda: stored["rows"], target, log)
        query.awaitTermination()
        stored["rows"] = settled
        return query

    in_two_starts(spark, settled, later, start)
    return spark.read.parquet(target).select(
        "stock_ticker", F.col("target_day").cast("string").alias("target_day"), "predictions",
        *totals("hit_rate", "mean_abs_error", "mean_error"))
