import pytest
from pyspark.sql import functions as F

from tests.helpers import raw, rows, ts
from tickerloom.plans import marts, staging, unified

AS_OF = "2025-01-10 12:00:00"


def test_trades_that_differ_only_in_conditions(spark):
    base = {"s": "AAA", "p": 10.5, "t": 1735689600123, "v": 1.0}
    got = staging.trades(raw(spark, {**base, "c": ["2"]}, {**base, "c": ["1"]}, base, {**base, "p": 11.0}, {"p": 1.0}))
    assert rows(got, "trade_price") == [
        ("AAA", ts("2025-01-01T00:00:00.123"), 10.5, 1.0, ["1"]), ("AAA", ts("2025-01-01T00:00:00.123"), 11.0, 1.0, None)]


def test_quotes_keep_the_latest(spark):
    def quote(seq, ms, price, code="X", cmd=22999, asks=({"price": "3", "volume": "4"},)):
        data = {"code": code, "seq": seq, "tick_time": ms, "bids": [{"price": price, "volume": "2"}]}
        return {"cmd_id": cmd, "data": {**data, "asks": list(asks)} if asks is not None else data}
    got = staging.quotes(raw(
        spark, quote(1, 1000, "1.0"), quote(1, 2000, "1.5"), quote(1, 2000, "1.4"), quote(1, 1500, "9.0"),
        quote(2, 1000, "5.0", asks=()), quote(3, 1000, "6.0", asks=None), quote(4, 1, "7", cmd=22000),
        quote(5, None, "8.0"), quote(5, 1000, "8.5")))
    picked = got.select("sequence_id", "event_timestamp", "best_bid_price", "best_ask_price")
    assert rows(picked, "sequence_id") == [
        (1, ts("1970-01-01T00:00:02"), 1.5, 3.0), (2, ts("1970-01-01T00:00:01"), 5.0, None),
        (3, ts("1970-01-01T00:00:01"), 6.0, None), (5, None, 8.0, 3.0)]


def bar_payload(ticker, refreshed, **days):
    return {"meta_data": {"2. Symbol": ticker, "3. Last Refreshed": refreshed},
            "time_series": {day.replace("_", "-").lstrip("d"): {
                "open": "1", "high": "3", "low": "0.5", "close": close, "volume": "10"} for day, close in days.items()}}


def test_bars_keep_the_last_refresh(spark):
    got = staging.bars(raw(spark, bar_payload("A", "2025-01-02", d2025_01_01="5", d2025_01_02="6"),
                           bar_payload("A", "2025-01-03 16:00:00", d2025_01_02="7")))
    picked = got.select(F.col("candle_date").cast("string"), "close_price", "trading_volume", "api_refreshed_at")
    assert rows(picked, "candle_date") == [("2025-01-01", 5.0, 10, ts("2025-01-02T00:00:00")),
                                           ("2025-01-02", 7.0, 10, ts("2025-01-03T16:00:00"))]
    history = marts.daily_history(got)
    assert history.columns == ["asset_key", "stock_ticker", "candle_date", "open_price", "high_price", "low_price",
                               "close_price", "trading_volume", "daily_price_range", "api_refreshed_at"]
    assert {r.daily_price_range for r in history.collect()} == {2.5}


def article(uuid="u", published="2025-01-01T00:00:00Z", entities=(), **more):
    return {"uuid": uuid, "title": "T", "description": "D", "snippet": "S", "url": "x", "language": "en", "source": "s",
            "published_at": published, "entities": list(entities), **more}


def test_entity_news(spark):
    a, b = {"symbol": "A", "name": "a", "sentiment_score": 0.5}, {"symbol": "B", "name": "b", "sentiment_score": None}
    got = staging.entity_news(raw(
        spark, article(entities=[a, b]), article(entities=[{**a, "sentiment_score": 0.7}], published="2025-01-02T02:00:00+02:00"),
        article("v"), article(None, entities=[a])))
    picked = got.select("article_uuid", "entity_ticker", "sentiment_score", "published_timestamp")
    assert rows(picked, "entity_ticker") == [("u", "A", 0.7, ts("2025-01-02T00:00:00")), ("u", "B", None, ts("2025-01-01T00:00:00"))]


def headline(title, description=None, **more):
    return {"source": {"id": None, "name": "n"}, "author": None, "title": title, "description": description, "url": "u",
            "urlToImage": None, "publishedAt": "2025-01-01T00:00:00Z", "content": "c", **more}


def test_headlines_and_rules(spark):
    got = staging.headlines(raw(spark, headline("Bitcoin rises"), headline("Bitcoin rises"), headline(None),
                                headline("New method", "x"), headline("Quiet day", "about NVIDIA"),
                                headline("btc and ethereum"), headline("GOOGL falls", None), headline("weather")))
    tagged = unified.headlines_as_news(got)
    assert rows(tagged.select("title", "asset_ticker"), "title") == [
        ("Bitcoin rises", "BTCUSDT"), ("GOOGL falls", "GOOGL"), ("New method", "ETHUSDT"), ("Quiet day", "NVDA"),
        ("btc and ethereum", "BTCUSDT"), ("weather", "UNKNOWN_PORTFOLIO")]
    import hashlib
    expected = hashlib.md5("Bitcoin rises2025-01-01 00:00:00.000 +0000".encode()).hexdigest()
    assert rows(tagged.filter("title = 'Bitcoin rises'").select("news_id")) == [(expected,)]


def test_news_and_inputs(spark):
    entity = [{"symbol": "UNKNOWN_PORTFOLIO", "name": "a", "sentiment_score": 1.0}, {"symbol": "A", "name": "a"}]
    news = unified.news(
        staging.entity_news(raw(spark, article(entities=entity), article("w", entities=[{"symbol": "A"}], language="de"),
                                article("e", entities=[{"symbol": "E"}], description=""),
                                article("s", entities=[{"symbol": "S"}], description=None),
                                article("z", entities=[{"symbol": "Z"}], description=None, snippet=None),
                                article("t", entities=[{"symbol": "T"}], title=None))),
        staging.headlines(raw(spark, headline("weather"), headline("ripple"))))
    assert news.columns == ["news_id", "asset_ticker", "sentiment_score", "title", "description", "content_body", "author",
                            "news_source", "image_url", "language", "published_timestamp", "api_provider"]
    # The filter on the unknown ticker holds for headlines only.
    assert news.filter("asset_ticker = 'UNKNOWN_PORTFOLIO'").count() == 1
    inputs = marts.news_inputs(news, AS_OF)
    assert rows(inputs.select("asset_ticker", "nlp_text_payload"), "asset_ticker") == [
        ("A", "T - D"), ("E", "T -"), ("S", "T - S"), ("XRPUSDT", "ripple - c"), ("Z", "T -")]
    assert inputs.columns == ["asset_key", "news_id", "asset_ticker", "nlp_text_payload", "baseline_sentiment",
                              "news_source", "published_timestamp", "dw_inserted_at"]


def bars_of(spark, ticker, closes, start="2025-01-01"):
    df = spark.createDataFrame([(ticker, i, float(c)) for i, c in enumerate(closes)], "stock_ticker string, i int, close_price double")
    return df.withColumn("candle_date", F.date_add(F.lit(start).cast("date"), F.col("i"))).drop("i")


@pytest.mark.parametrize("n", [1, 19, 20, 21])
def test_baselines(spark, n):
    import statistics
    closes = [i * i % 17 + 1 for i in range(n)]
    row = marts.baselines(bars_of(spark, "A", closes)).collect()[0]
    window = closes[-20:]
    assert row.yesterday_close == closes[-1]
    assert row.sma_20 == pytest.approx(sum(window) / len(window))
    if n == 1:
        assert row.historical_volatility_20d is None
    else:
        assert row.historical_volatility_20d == pytest.approx(statistics.stdev(window))


def test_features(spark):
    ticks = spark.createDataFrame(
        [("A", ts("2024-06-01T00:00:00"), 11.0, 1.0), ("NO", ts("2025-06-01T00:00:00"), 5.0, 2.0),
         ("ZERO", ts("2025-06-01T00:00:00"), 5.0, 2.0), ("A", ts("2025-06-01T00:00:00"), None, 2.0),
         ("NO", ts("2025-06-02T00:00:00"), 0.0, 2.0)],
        "stock_ticker string, event_timestamp timestamp_ntz, trade_price double, trade_volume double")
    bars = bars_of(spark, "A", [9, 11]).unionByName(bars_of(spark, "ZERO", [0]))
    got = marts.market_features(ticks, bars, AS_OF)
    assert got.columns == ["asset_key", "stock_ticker", "event_timestamp", "live_price", "live_volume", "baseline_close",
                           "sma_20_baseline", "rolling_volatility", "price_deviation_pct", "dw_inserted_at"]
    picked = got.select("stock_ticker", "live_price", "baseline_close", "sma_20_baseline",
                        F.round("rolling_volatility", 6), "price_deviation_pct")
    assert rows(picked, "stock_ticker", "event_timestamp") == [
        ("A", 11.0, 11.0, 10.0, 1.414214, 10.0), ("A", None, 11.0, 10.0, 1.414214, None),
        ("NO", 5.0, 5.0, 5.0, 0.0, 0.0), ("NO", 0.0, 0.0, 0.0, 0.0, None), ("ZERO", 5.0, 0.0, 0.0, 0.0, None)]


def test_ticks_and_stream(spark):
    quotes = spark.createDataFrame(
        [("X", ts("2025-01-01T00:00:00"), 1.0, 2.0, 2.0, 3.0, 1), ("Y", ts("2025-01-01T00:00:00"), 1.0, 2.0, None, None, 2)],
        "asset_ticker string, event_timestamp timestamp_ntz, best_bid_price double, best_bid_volume double, "
        "best_ask_price double, best_ask_volume double, sequence_id long")
    trades = spark.createDataFrame([("Z", ts("2025-01-01T00:00:00"), 7.0, 1.0, ["c"])],
                                   "stock_ticker string, event_timestamp timestamp_ntz, trade_price double, "
                                   "trade_volume double, trade_conditions array<string>")
    ticks = unified.market_ticks(quotes, trades)
    assert rows(ticks, "stock_ticker") == [
        ("X", ts("2025-01-01T00:00:00"), 1.5, 5.0, None, "AllTick"), ("Y", ts("2025-01-01T00:00:00"), None, None, None, "AllTick"),
        ("Z", ts("2025-01-01T00:00:00"), 7.0, 1.0, ["c"], "Finnhub")]
    assert marts.realtime_stream(ticks, AS_OF).columns == [
        "asset_key", "stock_ticker", "event_timestamp", "trade_price", "trade_volume", "price_source", "dw_inserted_at"]


def test_assets(spark):
    dim = marts.assets(spark, AS_OF)
    assert dim.columns == ["asset_key", "asset_ticker", "asset_name", "asset_class", "sector_theme", "trading_hours",
                           "risk_profile", "created_at"]
    assert dim.count() == 8
    keys = {r.asset_ticker: r.asset_key for r in dim.collect()}
    import hashlib
    assert keys["NVDA"] == hashlib.md5(b"NVDA").hexdigest()
    facts = spark.createDataFrame([(keys["NVDA"], 1), ("EURUSD", 2)], "asset_key string, n int")
    assert rows(marts.with_asset(facts, dim).select("n", "asset_name"), "n") == [(1, "Nvidia Corporation"), (2, None)]
    assert rows(marts.orphans(facts, dim).select("n")) == [(2,)]


def test_parts_are_unnested_without_their_message(spark, tmp_path):
    """Stored messages: the scan reads the paths, and what goes through the unnesting is typed columns."""
    feeds = {
        "news": (staging.parse_entity_news, {"uuid": "u", "title": "t", "entities": [{"symbol": "A", "sentiment_score": 0.5}, {"symbol": "B"}]}),
        "bars": (staging.parse_bars, {"meta_data": {"2. Symbol": "A", "3. Last Refreshed": "2024-01-01"},
                                      "time_series": {"2024-01-01": {"open": "1"}, "2024-01-02": {"open": "2"}}}),
    }
    for name, (parse, message) in feeds.items():
        folder = str(tmp_path / name)
        raw(spark, message).select(F.parse_json("raw_payload").alias("raw_payload")).write.parquet(folder)
        parsed = parse(spark.read.parquet(folder))
        above, below = parsed._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(")
        assert "payload" not in above and "payload" not in below.splitlines()[0]
        assert "try_variant_get" not in below  # every path is a column of the scan
        assert rows(parsed) == rows(parse(raw(spark, message))) and parsed.count() == 2
