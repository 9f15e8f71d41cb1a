"""Live ticks: one stream of both feeds, enriched with the daily baselines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tickerloom.plans import marts, staging, unified
from tickerloom.session import stored
from tickerloom.streaming import dedup
from tickerloom.streaming.ingest import triggered


TRADE_KEYS = ["stock_ticker", "event_timestamp", "trade_price", "trade_volume"]
QUOTE_KEYS, QUOTE_ORDER = ["asset_ticker", "sequence_id"], ["event_timestamp"]


def trade_log(raw: DataFrame, root: str, checkpoint: str, run: str = "trades", continuous: bool = False) -> StreamingQuery:
    """Append the trades of each batch; late ones too."""
    return dedup.any_log(staging.parse_trades(raw), TRADE_KEYS, root, checkpoint, run, continuous)


def quote_log(raw: DataFrame, root: str, checkpoint: str, run: str = "quotes", continuous: bool = False) -> StreamingQuery:
    return dedup.latest_log(staging.parse_quotes(raw), QUOTE_KEYS, QUOTE_ORDER, root, checkpoint, run, continuous)


def logged_trades(spark: SparkSession, root: str) -> DataFrame:
    return dedup.current_any(spark, root, TRADE_KEYS)


def logged_ticks(spark: SparkSession, quote_root: str, trade_root: str) -> DataFrame:
    """Both feeds as far as they have come, equal to the unified table of the same messages."""
    return unified.market_ticks(dedup.current(spark, quote_root, QUOTE_KEYS, QUOTE_ORDER), logged_trades(spark, trade_root))


def live_trades(raw: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Trades as they arrive, without those that come later than ``delay``; :func:`trade_log` keeps all."""
    once = dedup.first_arrivals(staging.parse_trades(raw), TRADE_KEYS, "event_timestamp", delay)
    return once.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp_ntz"))


def live_ticks(raw_quotes: DataFrame, raw_trades: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Both feeds as they arrive.  Trades are deduplicated here; quotes, whose latest version
    must win, are to come from a log of latest rows or to be reduced after storing."""
    return unified.quotes_as_ticks(staging.parse_quotes(raw_quotes)).unionByName(
        unified.trades_as_ticks(live_trades(raw_trades, delay)))


def enrich(ticks: DataFrame, read_bars: Callable[[], DataFrame], target: str, checkpoint: str,
           as_of: str | None = None, run: str = "enrich", continuous: bool = False) -> StreamingQuery:
    """Append features of each batch, against the bars as they stand when it runs.

    Streams run without adaptive execution, so a join with many baselines counts the batch first: it is stored, not parsed again.
    """

    def append(batch: DataFrame, number: int) -> None:
        (marts.market_features(stored(batch), read_bars(), as_of).withColumn("batch", F.lit(f"{run}-{number}"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch").parquet(target))

    writer = ticks.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return triggered(writer, continuous).start()
