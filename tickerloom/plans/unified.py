"""The two tick feeds in one table, and the two news feeds in one table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from tickerloom import names
from tickerloom.functions.pricing import joint_volume, mid_price
from tickerloom.functions.text import headline_id, ticker_by_rules


def quotes_as_ticks(quotes: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Quotes priced at the middle of the book; without one side the price is NULL."""
    return quotes.select(
        F.col("asset_ticker").alias("stock_ticker"),
        "event_timestamp",
        mid_price(F.col("best_bid_price"), F.col("best_ask_price")).alias("trade_price"),
        joint_volume(F.col("best_bid_volume"), F.col("best_ask_volume")).alias("trade_volume"),
        F.lit(None).cast("array<string>").alias("trade_conditions"),
        F.lit(names.QUOTES_TAG).alias("price_source"), *also)


def trades_as_ticks(trades: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    return trades.select(
        "stock_ticker", "event_timestamp",
        F.col("trade_price").cast("double"), F.col("trade_volume").cast("double"),
        "trade_conditions",
        F.lit(names.TRADES_TAG).alias("price_source"), *also)


def market_ticks(quotes: DataFrame, trades: DataFrame) -> DataFrame:
    return quotes_as_ticks(quotes).unionByName(trades_as_ticks(trades))


def entity_news_as_news(entity_news: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    return entity_news.select(
        F.col("article_uuid").alias("news_id"),
        F.col("entity_ticker").alias("asset_ticker"),
        F.col("sentiment_score").cast("double"),
        "title", "description",
        F.col("snippet").alias("content_body"),
        F.lit(None).cast("string").alias("author"),
        "news_source",
        F.lit(None).cast("string").alias("image_url"),
        "language", "published_timestamp",
        F.lit(names.ENTITY_NEWS_TAG).alias("api_provider"), *also)


def headlines_as_news(headlines: DataFrame, rules: Iterable[tuple[str, str, str]] = names.TICKER_RULES,
                      also: Sequence[str] = ()) -> DataFrame:
    """Headlines with the ticker their words point to, neutral sentiment and a made id."""
    return headlines.select(
        headline_id(F.col("title"), F.col("published_timestamp")).alias("news_id"),
        ticker_by_rules(F.col("title"), F.col("description"), rules).alias("asset_ticker"),
        F.lit(0.0).alias("sentiment_score"),
        "title", "description",
        F.col("content").alias("content_body"),
        "author",
        F.col("source_name").alias("news_source"),
        "image_url",
        F.lit(names.HEADLINE_LANGUAGE).alias("language"),
        "published_timestamp",
        F.lit(names.HEADLINES_TAG).alias("api_provider"), *also)


def known_headlines(headlines: DataFrame, rules: Iterable[tuple[str, str, str]] = names.TICKER_RULES,
                    also: Sequence[str] = ()) -> DataFrame:
    """Headlines as news without those that point to no known ticker."""
    return headlines_as_news(headlines, rules, also).filter(F.col("asset_ticker") != names.UNKNOWN_TICKER)


def news(entity_news: DataFrame, headlines: DataFrame,
         rules: Iterable[tuple[str, str, str]] = names.TICKER_RULES) -> DataFrame:
    """Both feeds; headlines that point to no known ticker are left out."""
    return entity_news_as_news(entity_news).unionByName(known_headlines(headlines, rules))
