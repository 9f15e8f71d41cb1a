"""Comparing predictions with what happened.

Predictions and evaluations are two append-only tables; the table with both is a join.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from tickerloom import names, schemas
from tickerloom.functions.clock import epoch_second, now, now_utc
from tickerloom.functions.pricing import within_margin
from tickerloom.operators.tolerance import MIN_SPAN_SECONDS, latest_within


def merged(predictions: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Every prediction, with its outcome where it has one."""
    return predictions.join(evaluations, "prediction_id", "left").select(*schemas.PREDICTION_COLUMNS)


def pending(predictions: DataFrame, evaluations: DataFrame | None = None,
            as_of: datetime | str | None = None) -> DataFrame:
    """Predictions whose moment has come and that have no outcome yet."""
    due = predictions.filter(F.col("target_window") <= now_utc(as_of))
    if evaluations is None:
        return due
    return due.join(evaluations.select("prediction_id"), "prediction_id", "left_anti").select(*due.columns)


def near_ticks(due: DataFrame, ticks: DataFrame, seconds: int = names.MATCH_SECONDS) -> DataFrame:
    """The predictions that one of the ticks may settle: those of a ticker and span of time that a tick reaches.

    Only (ticker, span) of either side meet, so many ticks of a ticker count once per span.
    """
    span = max(2 * seconds + 1, MIN_SPAN_SECONDS)
    second = epoch_second(F.col("event_timestamp"))
    reach = F.array_distinct(F.array(F.floor((second - seconds) / span), F.floor((second + seconds) / span)))
    spans = (ticks.filter("trade_price IS NOT NULL AND event_timestamp IS NOT NULL")
             .select("stock_ticker", F.explode(reach).alias("_span")).distinct())
    placed = due.withColumn("_span", F.floor(epoch_second(F.col("target_window")) / span))
    return placed.join(spans, ["stock_ticker", "_span"], "left_semi").select(*due.columns)


def evaluate(due: DataFrame, stream: DataFrame, as_of: datetime | str | None = None,
             seconds: int = names.MATCH_SECONDS, margin: float = names.HIT_MARGIN) -> DataFrame:
    """Outcome rows for the predictions that have a priced tick near their moment.

    Predictions without one are left out, so they stay pending and are tried again.
    """
    priced = stream.filter("trade_price IS NOT NULL").select(
        "stock_ticker", "event_timestamp", "price_source", "trade_price")
    matched = latest_within(due, priced, ["stock_ticker"], "target_window", "event_timestamp",
                            ["trade_price"], seconds, seconds, prefer=["price_source"])
    error = F.col("trade_price") - F.col("predicted_future_price")
    return (matched.filter("trade_price IS NOT NULL")
            .select("prediction_id", F.col("trade_price").alias("actual_price"),
                    error.alias("price_error_variance"),
                    within_margin(error, F.col("trade_price"), margin).alias("is_prediction_correct"),
                    now(as_of).alias("dw_inserted_at")))


def daily_totals(evaluated: DataFrame) -> DataFrame:
    """Per ticker and day of the target: predictions with an outcome, hits and errors."""
    return (evaluated.filter("actual_price IS NOT NULL")
            .groupBy("stock_ticker", F.to_date("target_window").alias("target_day"))
            .agg(F.count(F.lit(1)).alias("predictions"),
                 F.avg(F.col("is_prediction_correct").cast("double")).alias("hit_rate"),
                 F.avg(F.abs("price_error_variance")).alias("mean_abs_error"),
                 F.avg("price_error_variance").alias("mean_error")))


def store(outcomes: DataFrame, path: str, batch: str) -> None:
    """Add outcomes to their table.

    Scheduled runs and streams both write through here, so that they can share one table.  Attempts of a batch lie beside each
    other: what an earlier one settled is no longer pending for the next, and :func:`one_outcome` tells copies apart.
    """
    outcomes.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(path)


def one_outcome(stored: DataFrame) -> DataFrame:
    """Stored outcomes with one per prediction, the earliest, whichever writers settled it."""
    rest = [c for c in stored.columns if c not in ("prediction_id", "batch", "dw_inserted_at")]
    first = F.min(F.struct("dw_inserted_at", *rest)).alias("_first")
    return (stored.groupBy("prediction_id").agg(first)
            .select("prediction_id", *[F.col("_first")[c].alias(c) for c in rest], F.col("_first.dw_inserted_at").alias("dw_inserted_at")))


def accuracy(evaluated: DataFrame, trailing_days: int = 7) -> DataFrame:
    """Per ticker and day: hits and errors, and their drift from the ``trailing_days`` calendar days before."""
    daily = daily_totals(evaluated)
    before = Window.partitionBy("stock_ticker").orderBy(F.unix_date("target_day")).rangeBetween(-trailing_days, -1)
    return daily.select("*",
                        (F.col("hit_rate") - F.avg("hit_rate").over(before)).alias("hit_rate_drift"),
                        (F.col("mean_abs_error") - F.avg("mean_abs_error").over(before)).alias("abs_error_drift"))


def labelled(evaluated: DataFrame, features: DataFrame, look_back: int = 60 * names.REFRESH_MINUTES) -> DataFrame:
    """Evaluated predictions with the features of the last tick before they were made."""
    known = evaluated.filter("actual_price IS NOT NULL")
    return latest_within(known, features, ["stock_ticker"], "predicted_at", "event_timestamp",
                         ["live_price", "live_volume", "sma_20_baseline", "rolling_volatility",
                          "price_deviation_pct"], look_back, 0)
