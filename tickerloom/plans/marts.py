"""Dimension, facts and features."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickerloom import names
from tickerloom.functions.clock import now
from tickerloom.functions.pricing import day_range, deviation_pct
from tickerloom.functions.text import asset_key, news_payload
from tickerloom.operators.asof import latest_before
from tickerloom.operators.lookup import lookup_join
from tickerloom.operators.rolling import latest_trailing, trailing_stats

ASSET_COLUMNS = "asset_ticker string, asset_name string, asset_class string, sector_theme string, " \
                "trading_hours string, risk_profile string"


def assets(spark: SparkSession, as_of: datetime | str | None = None, rows=names.ASSETS) -> DataFrame:
    known = spark.createDataFrame(list(rows), ASSET_COLUMNS)
    return known.select(asset_key(F.col("asset_ticker")).alias("asset_key"), "*", now(as_of).alias("created_at"))


def daily_history(bars: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    return bars.select(
        asset_key(F.col("stock_ticker")).alias("asset_key"), "stock_ticker", "candle_date",
        "open_price", "high_price", "low_price", "close_price", "trading_volume",
        day_range(F.col("high_price"), F.col("low_price")).alias("daily_price_range"),
        "api_refreshed_at", *also)


def realtime_stream(ticks: DataFrame, as_of: datetime | str | None = None, also: Sequence[str] = ()) -> DataFrame:
    return ticks.select(
        asset_key(F.col("stock_ticker")).alias("asset_key"), "stock_ticker", "event_timestamp",
        "trade_price", "trade_volume", "price_source", now(as_of).alias("dw_inserted_at"), *also)


def baselines(bars: DataFrame, n: int = names.BASELINE_ROWS) -> DataFrame:
    """Per ticker the newest close with mean and sample deviation of the last ``n`` closes."""
    return latest_trailing(bars, "stock_ticker", "candle_date", "close_price", n).select(
        "stock_ticker", F.col("latest").alias("yesterday_close"), F.col("mean").alias("sma_20"),
        F.col("deviation").alias("historical_volatility_20d"))


def with_features(ticks_with_baseline: DataFrame, as_of: datetime | str | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Feature columns for ticks that carry the baseline columns, NULL where there is none."""
    price = F.col("trade_price")
    sma = F.coalesce("sma_20", "trade_price")
    return ticks_with_baseline.select(
        asset_key(F.col("stock_ticker")).alias("asset_key"), "stock_ticker", "event_timestamp",
        price.alias("live_price"),
        F.col("trade_volume").alias("live_volume"),
        F.coalesce("yesterday_close", "trade_price").alias("baseline_close"),
        sma.alias("sma_20_baseline"),
        F.coalesce("historical_volatility_20d", F.lit(0.0)).alias("rolling_volatility"),
        deviation_pct(price, sma).alias("price_deviation_pct"),
        now(as_of).alias("dw_inserted_at"), *also)


def market_features(ticks: DataFrame, bars: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Every tick against the newest baseline of its ticker.

    The baseline is the newest one whatever the time of the tick.  A ticker without bars is
    its own baseline, with zero volatility.
    """
    live = ticks.select("stock_ticker", "event_timestamp", "trade_price", "trade_volume")
    return with_features(lookup_join(live, baselines(bars), ["stock_ticker"], "left"), as_of)


def baselines_by_day(bars: DataFrame, n: int = names.BASELINE_ROWS) -> DataFrame:
    """Per ticker and day its close with mean and sample deviation of that and up to ``n - 1`` closes before."""
    days = bars.filter("stock_ticker IS NOT NULL AND candle_date IS NOT NULL").select("stock_ticker", "candle_date", "close_price")
    return trailing_stats(days, ["stock_ticker"], ["candle_date"], "close_price", n).select(
        "stock_ticker", "candle_date", F.col("close_price").alias("yesterday_close"), F.col("mean").alias("sma_20"),
        F.col("deviation").alias("historical_volatility_20d"))


def market_features_as_of(ticks: DataFrame, bars: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Every tick against the baseline that was known at its time: that of the newest bar before its day.

    A tick before its ticker's first bar, or without a time, is its own baseline, with zero volatility.
    """
    live = (ticks.select("stock_ticker", "event_timestamp", "trade_price", "trade_volume")
            .withColumn("_day", F.col("event_timestamp").cast("date")))
    carry = ["yesterday_close", "sma_20", "historical_volatility_20d"]
    return with_features(latest_before(live, baselines_by_day(bars), ["stock_ticker"], "_day", "candle_date", carry), as_of)


def news_inputs(news: DataFrame, as_of: datetime | str | None = None,
                language: str = names.HEADLINE_LANGUAGE, also: Sequence[str] = ()) -> DataFrame:
    wanted = news.filter((F.col("language") == language) & F.col("title").isNotNull()
                         & (F.col("asset_ticker") != names.UNKNOWN_TICKER))
    return wanted.select(
        asset_key(F.col("asset_ticker")).alias("asset_key"), "news_id", "asset_ticker",
        news_payload(F.col("title"), F.col("description"), F.col("content_body")).alias("nlp_text_payload"),
        F.col("sentiment_score").alias("baseline_sentiment"),
        "news_source", "published_timestamp", now(as_of).alias("dw_inserted_at"), *also)


def with_asset(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """Facts with the attributes of their asset, NULL for an asset we do not know."""
    return lookup_join(facts, dim.drop("created_at", "asset_ticker"), ["asset_key"], "left")


def orphans(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """Facts whose asset is not in the dimension."""
    return lookup_join(facts, dim.select("asset_key"), ["asset_key"], "left_anti")
