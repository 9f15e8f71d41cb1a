"""Scoring texts and projecting prices.

The text model is a plug-in: a loader, called once per task, that returns a function from a
batch of texts to ``(label, score)`` pairs.  Without one, a column expression scores: counted words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom import names
from tickerloom.functions.clock import now_utc, to_second
from tickerloom.functions.pricing import projected_price
from tickerloom.functions.text import signed_score, word_sentiment
from tickerloom.operators.lookup import lookup_join

TextModel = Callable[[Sequence[str]], Sequence[tuple[str, float]]]


def model_column(load_model: Callable[[], TextModel], text: Column) -> Column:
    """``struct<label, score, score_status>`` from a model, batch by batch.

    A batch that fails is tried again text by text; a text that fails scores as neutral with
    status ``failed``, so that failures stay visible.
    """

    @F.pandas_udf("label string, score double, score_status string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load_model()

        def one(text):
            try:
                label, value = model([text])[0]
                return label, float(value), "ok"
            except Exception:
                return "neutral", 0.0, "failed"

        for texts in batches:
            listed = texts.tolist()
            try:
                scored = [(label, float(value), "ok") for label, value in model(listed)]
                if len(scored) != len(listed):
                    raise ValueError("one answer per text expected")
            except Exception:
                scored = [one(text) for text in listed]
            yield pd.DataFrame(scored, columns=["label", "score", "score_status"])

    return score(text)


def with_sentiment(rows: DataFrame, text: str, load_model: Callable[[], TextModel] | None = None,
                   expression: Callable[[Column], Column] = word_sentiment) -> DataFrame:
    """``rows`` with ``sentiment`` from -1 to 1 and ``score_status``."""
    if load_model is None:
        answer, status = expression(F.col(text)), F.lit("ok")
    else:
        answer, status = model_column(load_model, F.col(text)), F.col("_answer.score_status")
    return (rows.withColumn("_answer", answer)
            .withColumn("sentiment", signed_score(F.col("_answer.label"), F.col("_answer.score")))
            .withColumn("score_status", status).drop("_answer"))


def latest_market(features: DataFrame) -> DataFrame:
    """One row per ticker: the latest event, ties by price and then volume."""
    kept = F.max(F.struct("event_timestamp", "live_price", "live_volume", "price_deviation_pct",
                          "rolling_volatility"))
    return features.groupBy("stock_ticker").agg(kept.alias("_last")).select(
        "stock_ticker", "_last.live_price", "_last.price_deviation_pct", "_last.rolling_volatility")


def news_with_market(news: DataFrame, features: DataFrame) -> DataFrame:
    """News of tickers that have a market row; other news is left out."""
    market = latest_market(features).withColumnRenamed("stock_ticker", "asset_ticker")
    return lookup_join(news, market, ["asset_ticker"], "inner")


def predict(news: DataFrame, features: DataFrame, as_of: datetime | str | None = None,
            load_model: Callable[[], TextModel] | None = None, limit: int | None = None,
            stable_ids: bool = True, keep_failed: bool = False, expression: Callable[[Column], Column] = word_sentiment) -> DataFrame:
    """One prediction per news row with a market row.

    With ``stable_ids`` a repeated run over the same moment makes the same ids, so it can be
    anti-joined before appending; otherwise ids are random.  ``limit`` scores only the
    newest news.  A text that the model fails on makes no prediction, so that a later run tries it again,
    unless ``keep_failed`` gives it the score 0.  News that agree in id, ticker and text are
    numbered, so that no two predictions of a run share an id, whether news have an id or not.
    """
    rows = news.select("asset_key", "asset_ticker", "news_id", "nlp_text_payload", "published_timestamp")
    if limit is not None:
        rows = rows.orderBy(F.col("published_timestamp").desc(), "news_id", "asset_ticker").limit(limit)
    scored = with_sentiment(news_with_market(rows, features), "nlp_text_payload", load_model, expression)
    if not keep_failed:
        scored = scored.filter("score_status = 'ok'")
    made = to_second(now_utc(as_of))
    if stable_ids:
        named = [F.coalesce("news_id", F.lit("")), F.col("asset_ticker"), F.coalesce("nlp_text_payload", F.lit(""))]
        alike = Window.partitionBy("news_id", "asset_ticker", "nlp_text_payload").orderBy("published_timestamp")
        scored = scored.withColumn("_copy", F.row_number().over(alike))
        made_id = F.md5(F.concat_ws("|", *named, F.col("_copy").cast("string"),
                                    F.date_format(made, "yyyy-MM-dd HH:mm:ss")).cast("binary"))
    else:
        made_id = F.uuid()
    return scored.select(
        made_id.alias("prediction_id"), "asset_key", F.col("asset_ticker").alias("stock_ticker"),
        made.alias("predicted_at"),
        (made + F.expr(f"INTERVAL {names.HORIZON_MINUTES} MINUTES")).alias("target_window"),
        F.col("sentiment").alias("predicted_sentiment_score"),
        projected_price(F.col("live_price"), F.col("price_deviation_pct"),
                        F.col("rolling_volatility")).alias("predicted_future_price"))


def not_yet_stored(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New predictions without those that an earlier run has appended."""
    return new.join(stored.select("prediction_id"), "prediction_id", "left_anti").select(*new.columns)
