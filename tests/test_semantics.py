"""Missing values, zones and shared stores."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import clock, pricing
from tickerloom.operators.lookup import lookup_join
from tickerloom.operators.rolling import latest_trailing
from tickerloom.plans import evaluation, predictions
from tickerloom.session import shared_dir

NEWS = "asset_key string, asset_ticker string, news_id string, nlp_text_payload string, published_timestamp timestamp"
FEATURES = "stock_ticker string, event_timestamp timestamp_ntz, live_price double, live_volume double, price_deviation_pct double, rolling_volatility double"


def predicted(spark, news, **how):
    features = spark.createDataFrame([("A", datetime(2025, 1, 1), 1.0, 1.0, 0.0, 0.0)], FEATURES)
    return predictions.predict(spark.createDataFrame(news, NEWS), features, "2025-01-02 00:00:00", **how)


def test_prediction_ids_are_unique_without_news_ids(spark):
    news = [("k", "A", None, "x", None), ("k", "A", None, "x", None), ("k", "A", None, "y", None), ("k", "A", "n", "y", None)]
    made = predicted(spark, news)
    assert made.count() == made.select("prediction_id").distinct().count() == 4
    outcome = made.select("prediction_id", F.lit(1.0).alias("actual_price"), F.lit(0.0).alias("price_error_variance"), F.lit(True).alias("is_prediction_correct"), F.current_timestamp().alias("dw_inserted_at"))
    assert evaluation.merged(made, outcome).count() == 4
    again = predicted(spark, news)
    assert predictions.not_yet_stored(again, made).count() == 0


def test_failed_texts_are_left_for_a_later_run(spark):
    def load():
        def model(texts):
            raise RuntimeError("down")
        return model

    assert predicted(spark, [("k", "A", "n", "x", None)], load_model=load).count() == 0
    assert [r.predicted_sentiment_score for r in predicted(spark, [("k", "A", "n", "x", None)], load_model=load, keep_failed=True).collect()] == [0.0]


def test_row_without_a_date_is_the_newest(spark):
    bars = spark.createDataFrame([("T", date(2025, 1, 1), 10.0), ("T", date(2025, 1, 2), 11.0), ("T", None, 99.0), ("U", None, 5.0)], "t string, d date, v double")
    got = {r.t: (r.latest, r.mean) for r in latest_trailing(bars, "t", "d", "v", 2).collect()}
    assert got == {"T": (99.0, 55.0), "U": (5.0, 5.0)}


def test_another_zone_is_refused(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError):
            clock.from_epoch_ms(F.lit(0))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_drift_looks_back_days_not_rows(spark):
    rows = [("A", datetime(2025, 1, 1), 1.0, 2.0, True), ("A", datetime(2025, 6, 1), 1.0, 4.0, False), ("A", datetime(2025, 6, 3), 1.0, 1.0, True)]
    table = spark.createDataFrame(rows, "stock_ticker string, target_window timestamp_ntz, actual_price double, price_error_variance double, is_prediction_correct boolean")
    got = {str(r.target_day): r.abs_error_drift for r in evaluation.accuracy(table).collect()}
    assert got == {"2025-01-01": None, "2025-06-01": None, "2025-06-03": -3.0}


def test_two_writers_share_the_outcomes(spark, tmp_path):
    schema = "prediction_id string, actual_price double, price_error_variance double, is_prediction_correct boolean, dw_inserted_at timestamp"
    path = str(tmp_path / "outcomes")
    early, late = datetime(2025, 1, 1), datetime(2025, 1, 2)
    evaluation.store(spark.createDataFrame([("p1", 1.0, 0.0, True, early)], schema), path, "refresh-1")
    for _ in range(2):  # a repeated batch
        evaluation.store(spark.createDataFrame([("p2", 2.0, 0.0, True, early), ("p1", 9.0, 0.0, True, late)], schema), path, "stream-0")
    got = evaluation.one_outcome(spark.read.parquet(path))
    assert {(r.prediction_id, r.actual_price) for r in got.collect()} == {("p1", 1.0), ("p2", 2.0)}


def test_joins_that_keep_rows_of_the_lookup_alone_are_refused(spark):
    rows = spark.createDataFrame([(1,)], "k int")
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            lookup_join(rows, rows, ["k"], how)


def test_rounding_needs_the_decimals_it_is_exact_for(spark):
    with pytest.raises(ValueError):
        pricing.rounded(F.lit(1.0), 2)


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        shared_dir(Session())
