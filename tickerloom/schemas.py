"""Message shapes at the edge and column types of the model tables.

The message shapes are Spark ``StructType`` objects.  ``nullable=False`` means the key
must be there with a value, ``nullable=True`` that it must be there but may be null, and
a ``default`` in the metadata that it may be left out.  ``alias`` is the key in the
provider's JSON where it differs from ours.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _field(name: str, dtype: T.DataType, nullable: bool = False, alias: str | None = None,
           may_be_missing: bool = False) -> T.StructField:
    meta = {}
    if alias:
        meta["alias"] = alias
    if may_be_missing:
        meta["default"] = "[]"
    return T.StructField(name, dtype, nullable, meta)


_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()

TRADE = T.StructType([
    _field("s", _S), _field("p", _D), _field("t", _L), _field("v", _D),
    _field("c", T.ArrayType(_S), may_be_missing=True),
])
TRADE_MESSAGE = T.StructType([_field("type", _S), _field("data", T.ArrayType(TRADE))])

BAR = T.StructType([
    _field("open", _S, alias="1. open"), _field("high", _S, alias="2. high"),
    _field("low", _S, alias="3. low"), _field("close", _S, alias="4. close"),
    _field("volume", _S, alias="5. volume"),
])
BAR_MESSAGE = T.StructType([
    _field("meta_data", T.MapType(_S, _S), alias="Meta Data"),
    _field("time_series", T.MapType(_S, BAR), alias="Time Series (Daily)"),
])

HEADLINE = T.StructType([
    _field("source", T.StructType([_field("id", _S, nullable=True), _field("name", _S)])),
    _field("author", _S, nullable=True), _field("title", _S), _field("description", _S, nullable=True),
    _field("url", _S), _field("urlToImage", _S, nullable=True), _field("publishedAt", _S),
    _field("content", _S, nullable=True),
])
HEADLINE_MESSAGE = T.StructType([
    _field("status", _S), _field("totalResults", _I), _field("articles", T.ArrayType(HEADLINE)),
])

ENTITY = T.StructType([
    _field("symbol", _S), _field("name", _S), _field("exchange", _S, nullable=True),
    _field("sentiment_score", _D, nullable=True),
])
ENTITY_ARTICLE = T.StructType([
    _field("uuid", _S), _field("title", _S), _field("description", _S, nullable=True),
    _field("snippet", _S, nullable=True), _field("url", _S), _field("image_url", _S, nullable=True),
    _field("language", _S), _field("published_at", _S), _field("source", _S),
    _field("entities", T.ArrayType(ENTITY)),
])
ENTITY_NEWS_MESSAGE = T.StructType([
    _field("meta", T.MapType(_S, T.VariantType())), _field("data", T.ArrayType(ENTITY_ARTICLE)),
])

DEPTH = T.StructType([_field("price", _S), _field("volume", _S)])
QUOTE_MESSAGE = T.StructType([
    _field("cmd_id", _I),
    _field("data", T.StructType([
        _field("code", _S), _field("seq", _L), _field("tick_time", _L),
        _field("bids", T.ArrayType(DEPTH), may_be_missing=True),
        _field("asks", T.ArrayType(DEPTH), may_be_missing=True),
    ])),
])

# A message as a queue delivers it, and the raw row it becomes.
QUEUE_RECORD = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"

PREDICTION_COLUMNS = (
    "prediction_id", "asset_key", "stock_ticker", "predicted_at", "target_window",
    "predicted_sentiment_score", "predicted_future_price", "actual_price",
    "price_error_variance", "is_prediction_correct", "dw_inserted_at",
)
PREDICTIONS = (
    "prediction_id string, asset_key string, stock_ticker string, predicted_at timestamp_ntz, "
    "target_window timestamp_ntz, predicted_sentiment_score double, predicted_future_price double"
)
EVALUATIONS = (
    "prediction_id string, actual_price double, price_error_variance double, "
    "is_prediction_correct boolean, dw_inserted_at timestamp"
)
