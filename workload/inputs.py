"""Market feeds made from the benchmark tables, whole table by whole table.

Each function gives raw JSON as the feed would deliver it, and the ``*_SQL`` text next to it
the rows that a correct parse of it yields.  Copies are made by repeating every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickerloom.names import BARS, ENTITY_NEWS, HEADLINES, QUOTES, TRADES, Feed
from tickerloom.session import utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Costly work on a table of fewer file splits than cores is spread over the cores first.

    A table with at least as many splits as cores is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files, spread like :func:`spread`."""
    stored = table(spark, sf_dir, name)
    live = spark.readStream.schema(stored.schema).parquet(f"{sf_dir}/{name}.parquet*")
    cores = spark.sparkContext.defaultParallelism
    return live if stored.rdd.getNumPartitions() >= cores else live.repartition(cores)


# --- trades: every event is a trade, delivered twice with different conditions -------------

def trade_payloads(events: DataFrame) -> DataFrame:
    return (events.withColumn("c", F.explode(F.array(F.array("event_type"), F.array("event_type", F.lit("late")))))
            .selectExpr("""to_json(named_struct(
                's', cast(user_id * 20 as string), 'p', value, 't', unix_millis(cast(ts as timestamp)),
                'v', cast(get_json_object(props, '$.k') as double), 'c', c)) AS raw_payload"""))


def trades_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_payloads(spread(table(spark, sf_dir, "events")))


TRADES_SQL = """
trades AS (
  SELECT CAST(user_id * 20 AS VARCHAR) AS stock_ticker, date_trunc('millisecond', ts) AS event_timestamp,
         value AS trade_price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS trade_volume,
         min(event_type) AS trade_conditions
  FROM events GROUP BY 1, 2, 3, 4)"""


# --- quotes: every line item, delivered twice, the later one with a moved price ------------

def quote_payloads(lines: DataFrame) -> DataFrame:
    return (lines.withColumn("late", F.explode(F.array(F.lit(0), F.lit(1000))))
            .selectExpr("""to_json(named_struct(
                'cmd_id', if(l_returnflag = 'A', 22000, 22999),
                'data', named_struct(
                    'code', cast(l_suppkey as string),
                    'seq', l_orderkey * 10 + l_linenumber,
                    'tick_time', unix_millis(cast(l_shipdate as timestamp)) + late,
                    'bids', array(named_struct('price', cast(l_extendedprice + late as string),
                                               'volume', cast(l_quantity as string))),
                    'asks', if(l_discount = 0, cast(array() as array<struct<price: string, volume: string>>),
                               array(named_struct('price', cast(l_extendedprice + late + l_tax as string),
                                                  'volume', cast(l_quantity + 1 as string))))
                ))) AS raw_payload"""))


def quotes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_payloads(spread(table(spark, sf_dir, "lineitem")))


QUOTES_SQL = """
quote_messages AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS asset_ticker,
         l_shipdate + to_milliseconds(late) AS event_timestamp,
         l_extendedprice + late AS best_bid_price, l_quantity AS best_bid_volume,
         CASE WHEN l_discount <> 0 THEN l_extendedprice + late + l_tax END AS best_ask_price,
         CASE WHEN l_discount <> 0 THEN l_quantity + 1 END AS best_ask_volume,
         l_orderkey * 10 + l_linenumber AS sequence_id
  FROM lineitem, (VALUES (0), (1000)) AS d(late)
  WHERE l_returnflag <> 'A'),
quotes AS (
  SELECT * FROM quote_messages
  QUALIFY row_number() OVER (PARTITION BY asset_ticker, sequence_id
    ORDER BY event_timestamp DESC NULLS FIRST, best_bid_price DESC NULLS FIRST, best_bid_volume DESC NULLS FIRST,
             best_ask_price DESC NULLS FIRST, best_ask_volume DESC NULLS FIRST) = 1)"""


# --- bars: every order describes two days of its customer's series --------------------------

def bar_payloads(orders: DataFrame) -> DataFrame:
    day = "date_format(o_orderdate + make_dt_interval({0}), 'yyyy-MM-dd')"
    bar = ("named_struct('open', cast(o_totalprice - 2 as string), 'high', cast(o_totalprice + 10 as string), "
           "'low', cast(o_totalprice - 10 as string), 'close', cast(o_totalprice + {0} as string), "
           "'volume', cast(o_orderkey as string))")
    return orders.selectExpr(f"""to_json(named_struct(
        'meta_data', map('2. Symbol', cast(o_custkey as string),
                         '3. Last Refreshed', date_format(o_orderdate, 'yyyy-MM-dd')),
        'time_series', map({day.format(0)}, {bar.format(0)}, {day.format(1)}, {bar.format(1)})
        )) AS raw_payload""")


def bars_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_payloads(spread(table(spark, sf_dir, "orders")))


BARS_SQL = """
bar_messages AS (
  SELECT CAST(o_custkey AS VARCHAR) AS stock_ticker, o_orderdate AS api_refreshed_at,
         CAST(o_orderdate + to_days(later) AS DATE) AS candle_date,
         o_totalprice - 2 AS open_price, o_totalprice + 10 AS high_price, o_totalprice - 10 AS low_price,
         o_totalprice + later AS close_price, o_orderkey AS trading_volume
  FROM orders, (VALUES (0), (1)) AS d(later)),
bars AS (
  SELECT * FROM bar_messages
  QUALIFY row_number() OVER (PARTITION BY stock_ticker, candle_date
    ORDER BY api_refreshed_at DESC NULLS FIRST, open_price DESC NULLS FIRST, high_price DESC NULLS FIRST,
             low_price DESC NULLS FIRST, close_price DESC NULLS FIRST, trading_volume DESC NULLS FIRST) = 1)"""


# --- news: every document is an article; its first line is the title, the rest the text ----

TITLE = "split(text, '\\n')[0]"
REST = "if(instr(text, '\\n') > 0, substring(text, instr(text, '\\n') + 1), null)"
TITLE_SQL = "split_part(text, chr(10), 1)"
REST_SQL = "CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) END"


def _iso(minutes: str) -> str:
    return (f"date_format(timestamp_seconds(unix_seconds(timestamp'2024-01-01 00:00:00') + {minutes} * 60), "
            "\"yyyy-MM-dd'T'HH:mm:ss'Z'\")")


def entity_news_payloads(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(f"""to_json(named_struct(
        'uuid', cast(doc_id as string), 'title', {TITLE}, 'description', {REST}, 'snippet', lang,
        'url', concat('http://news.example/', doc_id), 'image_url', cast(null as string), 'language', lang,
        'published_at', {_iso('doc_id')}, 'source', source,
        'entities', transform(split(text, '\\n'), x -> named_struct(
            'symbol', x, 'name', source, 'exchange', cast(null as string),
            'sentiment_score', if(length(x) = 0, null, length(x) / 100.0D)))
        ), map('ignoreNullFields', 'false')) AS raw_payload""")


def entity_news_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_news_payloads(spread(table(spark, sf_dir, "documents")))


ENTITY_NEWS_SQL = f"""
entity_news AS (
  SELECT DISTINCT CAST(doc_id AS VARCHAR) AS article_uuid, entity AS entity_ticker,
         CASE WHEN length(entity) > 0 THEN length(entity) / 100.0::DOUBLE END AS sentiment_score,
         {TITLE_SQL} AS title, {REST_SQL} AS description, lang AS snippet,
         'http://news.example/' || doc_id AS article_url, source AS news_source, lang AS language,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS published_timestamp, source AS entity_name
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS entity FROM documents))"""


def headline_payloads(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(f"""to_json(named_struct(
        'source', named_struct('id', cast(null as string), 'name', source), 'author', nullif(lang, 'de'),
        'title', {TITLE}, 'description', {REST}, 'url', 'http://news.example/', 'urlToImage', cast(null as string),
        'publishedAt', {_iso('n_chars')}, 'content', lang
        ), map('ignoreNullFields', 'false')) AS raw_payload""")


def headlines_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headline_payloads(spread(table(spark, sf_dir, "documents")))


HEADLINES_SQL = f"""
headline_messages AS (
  SELECT {TITLE_SQL} AS title, nullif(lang, 'de') AS author, {REST_SQL} AS description, lang AS content,
         CAST(NULL AS VARCHAR) AS source_id, source AS source_name, 'http://news.example/' AS article_url,
         CAST(NULL AS VARCHAR) AS image_url,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(n_chars) AS published_timestamp
  FROM documents),
headlines AS (
  SELECT * FROM headline_messages
  QUALIFY row_number() OVER (PARTITION BY title, published_timestamp
    ORDER BY author DESC NULLS FIRST, description DESC NULLS FIRST, content DESC NULLS FIRST,
             source_name DESC NULLS FIRST) = 1)"""

# --- the feeds as queue records ------------------------------------------------------------

def queue_records(payloads: DataFrame, feed: Feed, day: str) -> DataFrame:
    """Messages of a feed that all arrived on one day."""
    return payloads.select(
        F.lit(None).cast("string").alias("key"), F.col("raw_payload").alias("value"), F.lit(feed.topic).alias("topic"),
        F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), F.lit(day).cast("timestamp").alias("timestamp"))


def all_messages(spark: SparkSession, sf_dir: str, day: str, part: int | None = None) -> DataFrame:
    """All five feeds; of two parts each message is in one, so that copies come together or apart."""
    feeds = ((trades_raw, TRADES), (quotes_raw, QUOTES), (bars_raw, BARS), (entity_news_raw, ENTITY_NEWS), (headlines_raw, HEADLINES))
    both = None
    for raw, feed in feeds:
        payloads = raw(spark, sf_dir)
        if part is not None:
            payloads = payloads.filter(F.pmod(F.xxhash64("raw_payload"), F.lit(2)) == part)
        rows = queue_records(payloads, feed, day)
        both = rows if both is None else both.unionByName(rows)
    return both


# Rules and word lists that fit the language of the documents.
WORD_RULES = (("thther", "enst", "AAA"), ("eaux", "ouv", "BBB"), ("einge", "ung", "CCC"), ("cion", "ada", "DDD"))
GOOD_WORDS = ("the", "and", "la", "der")
BAD_WORDS = ("of", "to", "de", "en")


def rules_sql(rules, title: str = "title", description: str = "description") -> str:
    cases = " ".join(
        f"WHEN {title} ILIKE '%{w}%' OR {description} ILIKE '%{w}%' OR {title} ILIKE '%{s}%' THEN '{t}'"
        for w, s, t in rules)
    return f"CASE {cases} ELSE 'UNKNOWN_PORTFOLIO' END"


def sentiment_sql(text: str) -> str:
    """Signed share of good over bad words."""
    def hits(words):
        listed = ", ".join(f"'{w}'" for w in words)
        return f"len(list_filter(string_split_regex(lower({text}), '[^a-z]+'), lambda w: w IN ({listed})))"
    good, bad = hits(GOOD_WORDS), hits(BAD_WORDS)
    return f"coalesce(({good} - {bad})::DOUBLE / nullif({good} + {bad}, 0), 0.0)"


# --- predictions: every event is a prediction about the price of its type an hour later ----

def prediction_rows(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").cast("string").alias("prediction_id"),
        F.md5(F.col("event_type").cast("binary")).alias("asset_key"),
        F.col("event_type").alias("stock_ticker"),
        F.col("ts").alias("predicted_at"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("target_window"),
        F.lit(0.0).alias("predicted_sentiment_score"),
        (F.col("value") + 1).alias("predicted_future_price"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction_rows(table(spark, sf_dir, "events"))


def realised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a tick of its type; errors have no price."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stock_ticker"), F.col("ts").alias("event_timestamp"),
        F.when(F.col("user_id") > 0, F.col("value")).alias("trade_price"),
        F.get_json_object("props", "$.k").alias("price_source"))


PREDICTIONS_SQL = """
predictions AS (
  SELECT CAST(event_id AS VARCHAR) AS prediction_id, md5(event_type) AS asset_key, event_type AS stock_ticker,
         ts AS predicted_at, ts + INTERVAL 1 HOUR AS target_window, value + 1 AS predicted_future_price
  FROM events),
realised AS (
  SELECT event_type AS stock_ticker, ts AS event_timestamp, json_extract_string(props, '$.k') AS price_source,
         value AS trade_price
  FROM events WHERE user_id > 0)"""

MATCH_SECONDS = 600


def evaluated_sql(seconds: int = MATCH_SECONDS) -> str:
    """Predictions with the latest tick of their ticker within ``seconds``."""
    return PREDICTIONS_SQL + f""",
matched AS (
  SELECT p.*, r.trade_price AS actual_price
  FROM predictions p JOIN realised r ON p.stock_ticker = r.stock_ticker
   AND r.event_timestamp BETWEEN p.target_window - to_seconds({seconds + 1})
                             AND p.target_window + to_seconds({seconds + 1})
   AND abs(date_diff('second', r.event_timestamp, p.target_window)) <= {seconds}
  QUALIFY row_number() OVER (PARTITION BY p.prediction_id
    ORDER BY r.event_timestamp DESC, r.price_source DESC, r.trade_price DESC) = 1),
outcomes AS (
  SELECT *, actual_price - predicted_future_price AS price_error_variance,
         abs(actual_price - predicted_future_price) / nullif(actual_price, 0) <= 0.01 AS is_prediction_correct
  FROM matched)"""
