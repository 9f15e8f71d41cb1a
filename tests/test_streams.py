import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows, ts
from tickerloom import names, schemas
from tickerloom.plans import evaluation, marts, refresh, staging, unified
from tickerloom.sources import bronze, queue
from tickerloom.sources.tables import Tables
from tickerloom.streaming import dedup, ingest, market, outcomes

AS_OF = "2025-01-02 00:00:00"
START = 1735689600000  # 2025-01-01 in milliseconds


def write_messages(folder, number, *messages):
    """One file of queue records; a message is a topic and a value."""
    folder.mkdir(exist_ok=True)
    lines = []
    for i, (topic, value) in enumerate(messages):
        text = value if isinstance(value, str) or value is None else json.dumps(value)
        lines.append(json.dumps({"key": "k", "value": text, "topic": topic, "partition": 0, "offset": number * 100 + i,
                                 "timestamp": "2025-01-01T00:00:00Z"}))
    (folder / f"{number}.json").write_text("\n".join(lines))


def trade(ticker, price, ms):
    return (names.TRADES.topic, {"s": ticker, "p": price, "t": START + ms, "v": 1.0, "c": []})


def quote(seq, ms, price, code="BTCUSDT"):
    level = [{"price": str(price), "volume": "1"}]
    return (names.QUOTES.topic, {"cmd_id": 22999, "data": {"code": code, "seq": seq, "tick_time": START + ms,
                                                           "bids": level, "asks": level}})


def bars(ticker, **closes):
    days = {f"2024-12-{d[1:]}": {"open": "1", "high": "2", "low": "1", "close": c, "volume": "1"} for d, c in closes.items()}
    return (names.BARS.topic, {"meta_data": {"2. Symbol": ticker, "3. Last Refreshed": "2024-12-31"}, "time_series": days})


def headline(title):
    return (names.HEADLINES.topic, {"source": {"id": None, "name": "n"}, "author": None, "title": title, "description": None,
                                    "url": "u", "urlToImage": None, "publishedAt": "2025-01-01T00:00:00Z", "content": "c"})


def entity(uuid, ticker):
    return (names.ENTITY_NEWS.topic, {"uuid": uuid, "title": "Strong growth", "description": "D", "snippet": "S", "url": "x",
                                      "image_url": None, "language": "en", "published_at": "2025-01-01T00:00:00Z",
                                      "source": "s", "entities": [{"symbol": ticker, "name": "a", "exchange": None,
                                                                   "sentiment_score": 0.5}]})


def land(spark, tmp_path, files=1):
    ingest.to_bronze(queue.landed_messages(spark, str(tmp_path / "in"), files), str(tmp_path / "bronze"),
                     str(tmp_path / "log")).awaitTermination()
    return str(tmp_path / "bronze")


def test_landing_routes_and_restarts(spark, tmp_path):
    write_messages(tmp_path / "in", 1, trade("A", 1.0, 0), ("foreign", {"x": 1}), (names.QUOTES.topic, "not json"),
                   (names.TRADES.topic, None))
    root = land(spark, tmp_path)
    write_messages(tmp_path / "in", 2, trade("A", 2.0, 5), trade("A", 1.0, 0))
    land(spark, tmp_path)
    land(spark, tmp_path)
    table = bronze.read(spark, root, names.TRADES.bronze)
    assert table.count() == 3
    assert rows(table.select("record_metadata.offset"), "offset") == [(100,), (200,), (201,)]
    assert rows(bronze.unreadable(spark, root).select("unreadable_text")) == [("not json",)]
    assert rows(staging.trades(table).select("trade_price"), "trade_price") == [(1.0,), (2.0,)]
    assert bronze.preview(table, 2).count() == 2


def test_repeated_batch_replaces_itself(spark, tmp_path):
    write_messages(tmp_path / "in", 1, trade("A", 1.0, 0), quote(1, 0, 5))
    batch = spark.read.schema(schemas.QUEUE_RECORD).json(str(tmp_path / "in"))
    for _ in range(2):
        bronze.append_batch(batch, str(tmp_path / "b"), "run-0")
    bronze.append_batch(batch, str(tmp_path / "b"), "run-1")
    assert bronze.read(spark, str(tmp_path / "b"), names.TRADES.bronze).count() == 2


def test_a_batch_makes_one_file_per_table_and_day(spark, tmp_path):
    day = "timestamp_seconds(1735689600 + 86400 * (id % 3))"
    batch = spark.range(3000, numPartitions=8).selectExpr(
        "cast(id as string) AS key", "if(id % 10 = 9, null, to_json(named_struct('p', id))) AS value",
        f"if(id % 2 = 0, '{names.TRADES.topic}', '{names.QUOTES.topic}') AS topic",
        "0 AS partition", "id AS offset", f"{day} AS timestamp")
    live_in, root = str(tmp_path / "in"), tmp_path / "bronze"
    batch.write.json(live_in)
    ingest.to_bronze(queue.landed_messages(spark, live_in), str(root), str(tmp_path / "log")).awaitTermination()
    bronze.append_batch(batch, str(tmp_path / "plain"), "run-0")
    for folder in (root, tmp_path / "plain"):
        files = [f.parent for f in folder.rglob("*.parquet")]
        assert len(files) == len(set(files)) == 6
        read = bronze.read(spark, str(folder), names.TRADES.bronze)
        assert read.count() == 1500 and dict(read.dtypes)["ingest_date"] == "date" and dict(read.dtypes)["batch"] == "string"


def test_a_raw_table_without_messages_has_no_rows(spark, tmp_path):
    assert bronze.read(spark, str(tmp_path / "none"), names.TRADES.bronze).collect() == []
    assert bronze.unreadable(spark, str(tmp_path / "none")).collect() == []


def test_stream_keep_latest_out_of_order(spark, tmp_path):
    write_messages(tmp_path / "in", 1, quote(1, 1000, 5), quote(2, 0, 7))
    write_messages(tmp_path / "in", 2, quote(1, 3000, 6), quote(1, 2000, 9))
    write_messages(tmp_path / "in", 3, quote(1, 500, 1), quote(2, 0, 7))
    keys, order = ["asset_ticker", "sequence_id"], ["event_timestamp"]

    def parsed():
        live = queue.landed_messages(spark, str(tmp_path / "in"), 1)
        return staging.parse_quotes(live.filter(F.col("topic") == names.QUOTES.topic).select(F.col("value").alias("raw_payload")))
    log = str(tmp_path / "quotes")
    dedup.latest_log(parsed(), keys, order, log, str(tmp_path / "cp")).awaitTermination()
    write_messages(tmp_path / "in", 4, quote(2, 9000, 8))
    dedup.latest_log(parsed(), keys, order, log, str(tmp_path / "cp")).awaitTermination()
    everything = spark.read.schema(schemas.QUEUE_RECORD).json(str(tmp_path / "in"))
    batch = staging.quotes(everything.select(F.col("value").alias("raw_payload")))
    now = dedup.current(spark, log, keys, order)
    assert rows(now, "sequence_id") == rows(batch, "sequence_id")
    assert rows(now.select("sequence_id", "best_bid_price"), "sequence_id") == [(1, 6.0), (2, 8.0)]
    dedup.compact(spark, log, keys, order, str(tmp_path / "compact"))
    assert rows(dedup.current(spark, str(tmp_path / "compact"), keys, order), "sequence_id") == rows(batch, "sequence_id")


def test_live_ticks_and_enrichment_equal_the_batch(spark, tmp_path):
    write_messages(tmp_path / "in", 1, trade("A", 11.0, 0), trade("A", 11.0, 0), quote(1, 0, 5))
    write_messages(tmp_path / "in", 2, trade("A", 11.0, 0), trade("B", 3.0, 10), quote(2, 10, 6))

    def raw_of(df, feed):
        return df.filter(F.col("topic") == feed.topic).select(F.col("value").alias("raw_payload"))
    live = queue.landed_messages(spark, str(tmp_path / "in"), 1)
    ticks = market.live_ticks(raw_of(live, names.QUOTES), raw_of(live, names.TRADES))
    history = spark.createDataFrame([("A", 9.0), ("A", 11.0)], "stock_ticker string, close_price double").withColumn(
        "candle_date", F.date_add(F.lit("2024-12-01").cast("date"), F.col("close_price").cast("int")))
    market.enrich(ticks, lambda: history, str(tmp_path / "out"), str(tmp_path / "cp"), AS_OF).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")

    everything = spark.read.schema(schemas.QUEUE_RECORD).json(str(tmp_path / "in"))
    batch = marts.market_features(unified.market_ticks(staging.quotes(raw_of(everything, names.QUOTES)),
                                                       staging.trades(raw_of(everything, names.TRADES))), history, AS_OF)
    assert rows(got, "stock_ticker", "event_timestamp") == rows(batch, "stock_ticker", "event_timestamp")
    assert got.filter("stock_ticker = 'A'").first().price_deviation_pct == pytest.approx(10.0)


def test_daily_accuracy_counts_late_outcomes(spark, tmp_path):
    schema = "stock_ticker string, target_window timestamp_ntz, actual_price double, price_error_variance double, is_prediction_correct boolean"
    first = [("A", ts("2025-01-01T01:00:00"), 1.0, 2.0, True), ("A", ts("2025-01-06T05:00:00"), 1.0, 1.0, True)]
    late = [("A", ts("2025-01-01T02:00:00"), 1.0, -4.0, False), ("A", ts("2025-01-02T03:00:00"), None, None, None)]
    for rows in (first, late):  # two starts on one checkpoint
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        outcomes.daily_accuracy(live, lambda: spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(str(r.target_day), r.predictions, r.hit_rate, r.mean_error) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("2025-01-01", 2, 0.5, -1.0), ("2025-01-06", 1, 1.0, 1.0)}


def test_any_log_keeps_late_rows(spark, tmp_path):
    schema = "k string, moment timestamp_ntz, v int"
    for rows in ([("a", ts("2025-01-09T00:00:00"), 2), ("a", ts("2025-01-09T00:00:00"), 1)], [("b", ts("2025-01-01T00:00:00"), 5), ("a", ts("2025-01-09T00:00:00"), 0)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        dedup.any_log(live, ["k", "moment"], str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.k, r.v) for r in dedup.current_any(spark, str(tmp_path / "log"), ["k", "moment"]).collect()} == {("a", 0), ("b", 5)}


def test_pending_is_retried_until_truth_arrives(spark, tmp_path):
    made = spark.createDataFrame([("p", "k", "A", ts("2025-01-01T00:00:00"), ts("2025-01-01T00:05:00"), 0.0, 1.0)], schemas.PREDICTIONS)
    schema = "stock_ticker string, event_timestamp timestamp_ntz, trade_price double, price_source string"
    target = str(tmp_path / "out")

    def ticks(at, price):
        spark.createDataFrame([("A", ts(at), price, "s")], schema).write.mode("append").parquet(str(tmp_path / "ticks"))

    def stored():
        try:
            return spark.read.parquet(target)
        except Exception:
            return spark.createDataFrame([], schemas.EVALUATIONS)

    def run():
        outcomes.retry_pending(spark.readStream.schema(schema).parquet(str(tmp_path / "ticks")), lambda: made,
                               lambda: spark.read.parquet(str(tmp_path / "ticks")), stored, target, str(tmp_path / "cp"),
                               AS_OF).awaitTermination()
        return [r.actual_price for r in stored().collect()]

    ticks("2025-01-01T00:00:00", 5.0)
    assert run() == []
    ticks("2025-01-01T00:05:03", 2.0)
    assert run() == [2.0]
    ticks("2025-01-01T00:05:04", 3.0)
    assert run() == [2.0]


def test_a_batch_asks_only_what_its_ticks_may_settle(spark, tmp_path, monkeypatch):
    moments = {"p1": "2025-01-01T00:05:00", "p2": "2025-01-01T09:00:00", "p3": "2025-01-01T09:00:05", "p4": "2025-01-03T00:00:00"}
    made = spark.createDataFrame([(p, "k", "A", ts("2025-01-01T00:00:00"), ts(at), 0.0, 1.0) for p, at in moments.items()], schemas.PREDICTIONS)
    schema = "stock_ticker string, event_timestamp timestamp_ntz, trade_price double, price_source string"
    target, folder, log = str(tmp_path / "out"), str(tmp_path / "ticks"), str(tmp_path / "cp")
    asked = []
    plain = evaluation.evaluate
    monkeypatch.setattr(evaluation, "evaluate", lambda due, *a, **how: asked.append({r[0] for r in due.select("prediction_id").collect()}) or plain(due, *a, **how))

    def stored():
        return evaluation.one_outcome(Tables(spark, str(tmp_path)).read_or_empty("out", schemas.EVALUATIONS))

    def run(*ticks, as_of=AS_OF):
        if ticks:
            spark.createDataFrame([(t, ts(at), price, "s") for t, at, price in ticks], schema).coalesce(1).write.mode("append").parquet(folder)
        outcomes.retry_pending(spark.readStream.schema(schema).parquet(folder), lambda: made, lambda: spark.read.parquet(folder),
                               stored, target, log, as_of).awaitTermination()
        return {r.prediction_id: r.actual_price for r in stored().collect()}

    assert run(("A", "2025-01-01T05:00:00", 1.0)) == {} and asked[-1] == {"p1", "p2", "p3"}  # the first look is at all that are due
    assert run(("A", "2025-01-01T09:00:03", 2.0), ("A", "2025-01-02T23:59:59", 4.0)) == {"p2": 2.0, "p3": 2.0} and asked[-1] == {"p2", "p3"}
    assert run(("B", "2025-01-01T00:05:00", 3.0), ("A", "2025-01-01T07:00:00", 3.0)).keys() == {"p2", "p3"} and asked[-1] == set()
    # Its tick has come before its moment; the batch that comes after looks at it.
    assert run(("A", "2025-01-02T12:00:00", 1.0), as_of="2025-01-03 00:00:30")["p4"] == 4.0 and asked[-1] == {"p4"}
    # The same batch again, as after a failure: nothing that it has settled is lost.
    (tmp_path / "cp" / "commits" / "3").unlink()
    (tmp_path / "cp" / "commits" / ".3.crc").unlink(missing_ok=True)
    assert run(as_of="2025-01-03 00:00:30") == {"p2": 2.0, "p3": 2.0, "p4": 4.0} and asked[-1] == set()


def test_full_refresh(spark, tmp_path):
    write_messages(tmp_path / "in", 1, trade("NVDA", 100.0, 0), trade("NVDA", 102.0, 60_000), quote(1, 0, 50),
                   bars("NVDA", d30="98", d31="102"), headline("Bitcoin rally"), headline("weather"), entity("u", "NVDA"))
    root = land(spark, tmp_path)
    tables = Tables(spark, str(tmp_path / "models"))
    first = refresh.refresh(tables, root, "2025-01-01 00:00:30")
    assert first.columns == list(schemas.PREDICTION_COLUMNS)
    picked = ["stock_ticker", "target_window", "predicted_sentiment_score", "predicted_future_price", "actual_price"]
    volatility = 8 ** 0.5
    nvda = round(102 + 2 / 100 * 102 + volatility * 0.1, 4)
    assert rows(first.select(*picked), "stock_ticker") == [
        ("BTCUSDT", ts("2025-01-01T00:05:30"), 1.0, 50.0, None), ("NVDA", ts("2025-01-01T00:05:30"), 1.0, nvda, None)]
    # The same cycle again adds nothing; when its moment has come a tick near it settles the prediction.
    assert refresh.refresh(tables, root, "2025-01-01 00:00:30").count() == 2
    write_messages(tmp_path / "in", 2, trade("NVDA", 104.0, 325_000), trade("NVDA", 90.0, 341_000))
    land(spark, tmp_path)
    refresh.transform(tables, root, "2025-01-01 00:06:00")
    refresh.evaluate(tables, "2025-01-01 00:06:00")
    refresh.evaluate(tables, "2025-01-01 00:07:00")
    settled = refresh.predictions_table(tables)
    assert rows(settled.select("stock_ticker", "actual_price", "is_prediction_correct"), "stock_ticker") == [
        ("BTCUSDT", None, None), ("NVDA", 104.0, True)]
    assert spark.table(names.STG_TRADES).count() == 4
    assert evaluation.pending(tables.read(names.FCT_PREDICTIONS), tables.read(refresh.EVALUATIONS), "2025-01-01 00:06:00").count() == 1
