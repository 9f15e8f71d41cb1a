import json
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows, ts
from tickerloom import schemas
from tickerloom.functions import pricing, text
from tickerloom.plans import evaluation, predictions

AS_OF = "2025-01-10 12:00:00.750"


def news(spark, *data):
    return spark.createDataFrame(
        [(t, n, p, ts(at)) for t, n, p, at in data],
        "asset_ticker string, news_id string, nlp_text_payload string, published_timestamp timestamp"
    ).withColumn("asset_key", F.md5("asset_ticker"))


def features(spark, *data):
    return spark.createDataFrame(
        [(t, ts(at), p, v, d, r) for t, at, p, v, d, r in data],
        "stock_ticker string, event_timestamp timestamp_ntz, live_price double, live_volume double, "
        "price_deviation_pct double, rolling_volatility double")


@pytest.mark.parametrize("answer,score", [
    ([[{"label": "positive", "score": 0.9}, {"label": "negative", "score": 0.1}]], 0.9),
    ([[{"label": "negative", "score": 0.8}]], -0.8), ([[{"label": "neutral", "score": 0.8}]], 0.0),
    ([[{"label": "other", "score": 0.8}]], 0.0), ([], 0.0), ([[]], 0.0), ({"error": "loading"}, 0.0), ("text", 0.0),
])
def test_score_of_response(spark, answer, score):
    body = answer if isinstance(answer, str) else json.dumps(answer)
    df = spark.createDataFrame([(body,)], "body string")
    assert df.select(text.score_of_response(F.col("body"))).first()[0] == score


def test_word_sentiment(spark):
    df = spark.createDataFrame([("Profits RISE, no loss",), ("crash",), ("quiet",), ("",)], "t string")
    got = [r.s for r in predictions.with_sentiment(df, "t").selectExpr("round(sentiment, 6) s").collect()]
    assert got == [round(1 / 3, 6), -1.0, 0.0, 0.0]


def test_model_failures_stay_visible(spark):
    def load():
        def model(texts):
            if any(t == "bad" for t in texts):
                raise RuntimeError("no")
            return [("negative", 0.25) for _ in texts]
        return model
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "n int, t string").coalesce(1)
    got = predictions.with_sentiment(df, "t", load).select("n", "sentiment", "score_status")
    assert rows(got, "n") == [(1, -0.25, "ok"), (2, 0.0, "failed"), (3, -0.25, "ok")]


def test_projection(spark):
    df = spark.createDataFrame([(100.0, 2.0, 5.0), (100.0, None, 5.0), (0.00004, 0.0, 0.0)], "p double, d double, v double")
    got = [r[0] for r in df.select(pricing.projected_price(F.col("p"), F.col("d"), F.col("v"))).collect()]
    assert got == [102.5, None, 0.0]


def test_rounding_is_that_of_the_stored_value(spark):
    rng = random.Random(5)
    values = [rng.randrange(10 ** 9) * 10 + 5 for _ in range(3000)]
    values = [v / 10 ** 5 for v in values] + [-v / 10 ** 5 for v in values[:500]] + [
        1.08345, 0.00005, 0.03125, 0.09375, -0.03125, 1e-9, 0.0, 123456789.00005, 1e16, 2.5e300] + [rng.random() for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", pricing.rounded(F.col("v"), 4).alias("r")).collect()
    assert all(r.r == round(r.v, 4) for r in got)
    assert spark.sql("SELECT double('infinity') v").select(pricing.rounded(F.col("v"), 4)).first()[0] == float("inf")


def test_predict(spark):
    market = features(spark, ("A", "2025-01-10T11:00:00", 50.0, 1.0, 0.0, 0.0), ("A", "2025-01-10T11:30:00", 100.0, 1.0, 2.0, 5.0),
                      ("A", "2025-01-10T11:30:00", 90.0, 1.0, 2.0, 5.0), ("B", "2025-01-10T11:30:00", 10.0, 1.0, None, 0.0))
    texts = news(spark, ("A", "n1", "strong growth", "2025-01-10T10:00:00"), ("B", "n1", "crash", "2025-01-10T10:00:00"),
                 ("C", "n2", "up", "2025-01-10T11:00:00"))
    made = predictions.predict(texts, market, AS_OF)
    assert made.columns == list(schemas.PREDICTION_COLUMNS[:7])
    assert rows(made.drop("prediction_id", "asset_key"), "stock_ticker") == [
        ("A", ts("2025-01-10T12:00:00"), ts("2025-01-10T12:05:00"), 1.0, 102.5),
        ("B", ts("2025-01-10T12:00:00"), ts("2025-01-10T12:05:00"), -1.0, None)]
    again = predictions.predict(texts, market, AS_OF)
    assert rows(made, "stock_ticker") == rows(again, "stock_ticker")
    assert predictions.not_yet_stored(again, made).count() == 0
    # The newest news is of a ticker without a market row.
    assert predictions.predict(texts, market, AS_OF, limit=1).count() == 0
    assert predictions.predict(texts, market, AS_OF, limit=2).count() == 1
    random_ids = predictions.predict(texts, market, AS_OF, stable_ids=False)
    assert random_ids.select("prediction_id").distinct().count() == 2


def prediction_rows(spark, *data):
    full = [(i, "k", t, ts("2025-01-10T00:00:00"), ts(at), 0.0, p) for i, t, at, p in data]
    return spark.createDataFrame(full, schemas.PREDICTIONS)


def stream(spark, *data):
    return spark.createDataFrame([("k", t, ts(at), p, 1.0, "s") for t, at, p in data],
                                 "asset_key string, stock_ticker string, event_timestamp timestamp_ntz, trade_price double, "
                                 "trade_volume double, price_source string")


def test_evaluate(spark):
    made = prediction_rows(spark, ("exact", "A", "2025-01-10T01:00:00", 99.0), ("over", "A", "2025-01-10T02:00:00", 98.9),
                           ("zero", "B", "2025-01-10T01:00:00", 1.0), ("negative", "C", "2025-01-10T01:00:00", 500.0),
                           ("none", "D", "2025-01-10T01:00:00", 1.0), ("unpriced", "E", "2025-01-10T01:00:00", 1.0),
                           ("no forecast", "A", "2025-01-10T01:00:00", None))
    ticks = stream(spark, ("A", "2025-01-10T01:00:10", 100.0), ("A", "2025-01-10T02:00:00", 100.0),
                   ("B", "2025-01-10T01:00:00", 0.0), ("C", "2025-01-10T01:00:00", -1.0), ("E", "2025-01-10T01:00:00", None))
    got = evaluation.evaluate(made, ticks, AS_OF)
    assert rows(got.select("prediction_id", "actual_price", F.round("price_error_variance", 6), "is_prediction_correct"),
                "prediction_id") == [
        ("exact", 100.0, 1.0, True), ("negative", -1.0, -501.0, True), ("no forecast", 100.0, None, None),
        ("over", 100.0, 1.1, False), ("zero", 0.0, -1.0, None)]
    merged = evaluation.merged(made, got)
    assert merged.columns == list(schemas.PREDICTION_COLUMNS) and merged.count() == 7
    assert evaluation.pending(made, got, AS_OF).select("prediction_id").orderBy("prediction_id").collect() == [("none",), ("unpriced",)]


def test_pending_waits_for_its_moment(spark):
    made = prediction_rows(spark, ("open", "A", "2025-01-10T12:00:01", 1.0), ("now", "A", "2025-01-10T12:00:00.75", 1.0),
                           ("past", "A", "2025-01-01T00:00:00", 1.0))
    assert rows(evaluation.pending(made, None, AS_OF).select("prediction_id"), "prediction_id") == [("now",), ("past",)]


def test_accuracy_and_labels(spark):
    made = prediction_rows(spark, ("a", "A", "2025-01-01T01:00:00", 99.0), ("b", "A", "2025-01-02T01:00:00", 50.0),
                           ("c", "A", "2025-01-02T02:00:00", 100.0), ("d", "A", "2025-01-03T02:00:00", 100.0))
    ticks = stream(spark, *[("A", at, 100.0) for at in ("2025-01-01T01:00:00", "2025-01-02T01:00:00", "2025-01-02T02:00:00")])
    merged = evaluation.merged(made, evaluation.evaluate(made, ticks, AS_OF))
    got = evaluation.accuracy(merged).select(F.col("target_day").cast("string"), "predictions", "hit_rate", "mean_abs_error",
                                             "hit_rate_drift", "abs_error_drift")
    assert rows(got, "target_day") == [("2025-01-01", 1, 1.0, 1.0, None, None), ("2025-01-02", 2, 0.5, 25.0, -0.5, 24.0)]
    known = spark.createDataFrame([("A", ts("2025-01-09T23:59:00"), 1.0, 2.0, 3.0, 4.0, 5.0), ("A", ts("2025-01-10T00:00:01"), 9.0, 9.0, 9.0, 9.0, 9.0)],
                                  "stock_ticker string, event_timestamp timestamp_ntz, live_price double, live_volume double, "
                                  "sma_20_baseline double, rolling_volatility double, price_deviation_pct double")
    labels = evaluation.labelled(merged, known)
    assert labels.count() == 3 and {r.live_price for r in labels.collect()} == {1.0}
