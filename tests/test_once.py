"""Costly inputs are computed once."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from tests.helpers import raw, rows
from tickerloom.functions.payload import computed_once
from tickerloom.operators import lookup
from tickerloom.operators.asof import latest_before
from tickerloom.plans import marts
from tickerloom.streaming import market


@pytest.fixture
def counted(spark):
    """A way to count the rows of a table each time they are computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(df):
        def pass_on(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        return df.mapInArrow(pass_on, df.schema)
    return seen, count


def test_facts_of_a_large_lookup(spark, counted):
    seen, count = counted
    facts = count(spark.range(1000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("k"), "id"))
    table = spark.createDataFrame([(0, "a"), (2, "c"), (None, "n")], "k long, name string")
    got = rows(lookup.lookup_join(facts, table, ["k"], "left", max_bytes=0), "id")
    assert got == [(i % 3 if i % 5 else None, i, {0: "a", 2: "c"}.get(i % 3) if i % 5 else None) for i in range(1000)]
    assert seen.value == 1000


def test_rows_of_an_as_of_join(spark, counted):
    seen, count = counted
    asked = count(spark.range(500).select((F.col("id") % 4).alias("k"), F.timestamp_seconds(F.col("id")).alias("at")))
    known = spark.createDataFrame([(0, 100, 1.0), (1, 300, 2.0)], "k long, s long, price double").select(
        "k", F.timestamp_seconds("s").alias("since"), "price")
    got = latest_before(asked, known, ["k"], "at", "since", ["price"])
    assert rows(got.groupBy("price").count(), "price") == [(None, 500 - 99 - 50), (1.0, 99), (2.0, 50)]
    assert seen.value == 500


def test_batches_of_a_stream_with_many_baselines(spark, counted, tmp_path, monkeypatch):
    seen, count = counted
    monkeypatch.setattr(marts, "lookup_join", partial(lookup.lookup_join, max_bytes=0))
    ticks = spark.range(300).selectExpr("cast(id % 3 as string) AS stock_ticker", "timestamp_ntz'2024-01-01 00:00:00' AS event_timestamp",
                                        "cast(id as double) AS trade_price", "1.0D AS trade_volume")
    ticks.write.parquet(str(tmp_path / "ticks"))
    bars = spark.createDataFrame([("1", 7.0)], "stock_ticker string, close_price double").withColumn("candle_date", F.to_date(F.lit("2023-12-31")))
    live = count(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks")))
    market.enrich(live, lambda: bars, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 300 and out.filter("baseline_close = 7.0 AND stock_ticker = '1'").count() == 100
    assert seen.value == 300


def test_a_costly_value_is_computed_below_the_unnesting(spark):
    once = computed_once(raw(spark, {"a": 1}, {"a": 2}), F.try_parse_json("raw_payload"), "payload").filter("payload IS NOT NULL")
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse") == 1 and all("parse" not in line for line in plan.splitlines() if "Generate" in line or "Filter" in line)
    assert once.columns == ["raw_payload", "payload"] and once.count() == 2
