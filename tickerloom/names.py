"""Names and constants that other programs rely on.

Everything here is a fixed value: table and topic names, provider tags, rule lists
and thresholds are part of the data contract, so they are stated as they are.
"""

from __future__ import annotations

from typing import NamedTuple


class Feed(NamedTuple):
    """One message feed: its short name, its topic and the raw table it lands in."""

    name: str
    topic: str
    bronze: str


# Feeds, topics and raw tables.
TRADES = Feed("trades", "raw_finnhub_ticks", "bronze_finnhub_ticks")
QUOTES = Feed("quotes", "raw_alltick_ticks", "bronze_alltick_ticks")
BARS = Feed("bars", "raw_alphavantage_candles", "bronze_alphavantage_candles")
ENTITY_NEWS = Feed("entity_news", "raw_marketaux_news", "bronze_marketaux_news")
HEADLINES = Feed("headlines", "raw_newsapi_news", "bronze_newsapi_news")
FEEDS = (TRADES, QUOTES, BARS, ENTITY_NEWS, HEADLINES)

# Model tables.
STG_TRADES = "stg_finnhub_ticks"
STG_QUOTES = "stg_alltick_ticks"
STG_BARS = "stg_alphavantage_candles"
STG_ENTITY_NEWS = "stg_marketaux_news"
STG_HEADLINES = "stg_newsapi_news"
INT_TICKS = "int_unified_market_ticks"
INT_NEWS = "int_unified_news"
DIM_ASSETS = "dim_assets"
FCT_HISTORY = "fct_daily_market_history"
FCT_FEATURES = "fct_market_ml_features"
FCT_NEWS_INPUTS = "fct_nlp_feature_inputs"
FCT_STREAM = "fct_realtime_market_stream"
FCT_PREDICTIONS = "fct_model_predictions"

# Provider tags written into the lineage columns.
QUOTES_TAG = "AllTick"
TRADES_TAG = "Finnhub"
ENTITY_NEWS_TAG = "MarketAux"
HEADLINES_TAG = "NewsAPI"

# Message codes and notice keys.
TRADE_MESSAGE = "trade"
QUOTE_PUSH = 22999
BAR_NOTICE_KEYS = ("Note", "Information", "Error Message")
ENTITY_NEWS_ERROR_KEYS = ("error", "message")
HEADLINES_ERROR_STATUS = "error"

# Watch-lists and selections per feed.
WATCHED_TRADES = ("GOOGL", "MSFT", "AMZN", "NVDA")
WATCHED_QUOTES = ("BTCUSDT", "ETHUSDT", "EURUSD")
WATCHED_BARS = ("GOOGL", "MSFT", "AMZN", "NVDA")
WATCHED_ENTITIES = ("GOOGL", "MSFT", "AMZN", "NVDA", "CC:BTC", "CC:ETH")
HEADLINE_KEYWORDS = ("Google", "Microsoft", "Amazon", "Nvidia", "Bitcoin", "Ethereum")
HEADLINE_LANGUAGE = "en"
LOOK_BACK_DAYS = 7
ARTICLES_PER_POLL = 10

# Headline classifier, first match wins: (word, symbol, ticker).
# The word is looked for in title and description, the symbol in the title.
TICKER_RULES = (
    ("bitcoin", "btc", "BTCUSDT"),
    ("ethereum", "eth", "ETHUSDT"),
    ("solana", "sol", "SOLUSDT"),
    ("ripple", "xrp", "XRPUSDT"),
    ("nvidia", "nvda", "NVDA"),
    ("microsoft", "msft", "MSFT"),
    ("google", "googl", "GOOGL"),
    ("amazon", "amzn", "AMZN"),
)
UNKNOWN_TICKER = "UNKNOWN_PORTFOLIO"

# The asset dimension (ticker, name, class, theme, trading hours, risk).
ASSETS = (
    ("BTCUSDT", "Bitcoin", "Cryptocurrency", "Digital Gold / Layer 1", "24/7 Global", "High Volatility"),
    ("ETHUSDT", "Ethereum", "Cryptocurrency", "Smart Contracts / Layer 1", "24/7 Global", "High Volatility"),
    ("SOLUSDT", "Solana", "Cryptocurrency", "High-Speed Layer 1", "24/7 Global", "Extreme Volatility"),
    ("XRPUSDT", "Ripple", "Cryptocurrency", "Cross-Border Payments", "24/7 Global", "High Volatility"),
    ("NVDA", "Nvidia Corporation", "US Equity", "Semiconductors / AI Hardware", "NASDAQ (Mon-Fri)",
     "Growth / Moderate Volatility"),
    ("MSFT", "Microsoft Corporation", "US Equity", "Cloud Computing / Enterprise AI", "NASDAQ (Mon-Fri)",
     "Blue Chip / Stable"),
    ("GOOGL", "Alphabet Inc.", "US Equity", "Search / Cloud / AI Services", "NASDAQ (Mon-Fri)",
     "Blue Chip / Stable"),
    ("AMZN", "Amazon.com Inc.", "US Equity", "E-Commerce / Cloud Infrastructure", "NASDAQ (Mon-Fri)",
     "Blue Chip / Moderate Volatility"),
)

# Features, forecast and evaluation.
BASELINE_ROWS = 20
VOLATILITY_WEIGHT = 0.1
FORECAST_DECIMALS = 4
HORIZON_MINUTES = 5
MATCH_SECONDS = 10
HIT_MARGIN = 0.01
REFRESH_MINUTES = 5
