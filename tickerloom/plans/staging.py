"""Raw payloads to typed, deduplicated tables: one function per feed.

The raw column may be VARIANT or JSON text.  A value that does not cast is NULL here;
malformed messages are set aside earlier, by :mod:`tickerloom.sources.landing`.

What a message says about all its parts is read in a projection of its own, below the
unnesting, which otherwise would read it once per part and carry the message along.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom import names
from tickerloom.functions.clock import from_epoch_ms
from tickerloom.functions.payload import at, key_path, to_text, with_payload
from tickerloom.operators.dedup import KEY, keep_any, keep_latest, keep_latest_wide, split_copies
from tickerloom.operators.lookup import lookup_join, split_by


TRADE_KEYS = ["stock_ticker", "event_timestamp", "trade_price", "trade_volume"]
QUOTE_KEYS = ["asset_ticker", "sequence_id"]
BAR_KEYS = ["stock_ticker", "candle_date"]
ENTITY_KEYS = ["article_uuid", "entity_ticker"]
HEADLINE_KEYS = ["title", "published_timestamp"]


def one_trade(rows: DataFrame) -> DataFrame:
    return keep_any(rows, TRADE_KEYS)


def one_quote(rows: DataFrame) -> DataFrame:
    return keep_latest(rows, QUOTE_KEYS, ["event_timestamp"])


def one_bar(rows: DataFrame) -> DataFrame:
    return keep_latest(rows, BAR_KEYS, ["api_refreshed_at"])


def one_headline(rows: DataFrame) -> DataFrame:
    return keep_latest_wide(rows, HEADLINE_KEYS, [])


def _payload(raw: DataFrame) -> DataFrame:
    return with_payload(raw.select("raw_payload")).select("payload")


def parse_trades(raw: DataFrame) -> DataFrame:
    p = F.col("payload")
    return (_payload(raw)
            .select(at(p, "$.s").alias("stock_ticker"),
                    from_epoch_ms(at(p, "$.t", "bigint")).alias("event_timestamp"),
                    at(p, "$.p", "double").alias("trade_price"),
                    at(p, "$.v", "double").alias("trade_volume"),
                    at(p, "$.c", "array<string>").alias("trade_conditions"))
            .filter("stock_ticker IS NOT NULL"))


def trades(raw: DataFrame) -> DataFrame:
    return one_trade(parse_trades(raw))


def parse_quotes(raw: DataFrame) -> DataFrame:
    p = F.col("payload")
    return (_payload(raw)
            .filter(at(p, "$.cmd_id", "int") == names.QUOTE_PUSH)
            .select(at(p, "$.data.code").alias("asset_ticker"),
                    from_epoch_ms(at(p, "$.data.tick_time", "bigint")).alias("event_timestamp"),
                    at(p, "$.data.bids[0].price", "double").alias("best_bid_price"),
                    at(p, "$.data.bids[0].volume", "double").alias("best_bid_volume"),
                    at(p, "$.data.asks[0].price", "double").alias("best_ask_price"),
                    at(p, "$.data.asks[0].volume", "double").alias("best_ask_volume"),
                    at(p, "$.data.seq", "bigint").alias("sequence_id")))


def quotes(raw: DataFrame) -> DataFrame:
    return one_quote(parse_quotes(raw))


def parse_bars(raw: DataFrame) -> DataFrame:
    p, bar = F.col("payload"), F.col("bar")
    described = _payload(raw).select(
        at(p, "$.meta_data" + key_path("2. Symbol")[1:]).alias("stock_ticker"),
        at(p, "$.meta_data" + key_path("3. Last Refreshed")[1:]).try_cast("timestamp_ntz").alias("api_refreshed_at"),
        at(p, "$.time_series", "map<string,variant>").alias("days"))
    return described.select("stock_ticker", "api_refreshed_at", F.explode("days").alias("day", "bar")).select(
        "stock_ticker", "api_refreshed_at",
        F.col("day").try_cast("date").alias("candle_date"),
        at(bar, "$.open", "double").alias("open_price"),
        at(bar, "$.high", "double").alias("high_price"),
        at(bar, "$.low", "double").alias("low_price"),
        at(bar, "$.close", "double").alias("close_price"),
        at(bar, "$.volume", "bigint").alias("trading_volume"))


def bars(raw: DataFrame) -> DataFrame:
    return one_bar(parse_bars(raw))


ARTICLE_TEXTS = ["title", "description", "snippet", "article_url", "news_source", "language"]
VERSION = "_version"


def _articles(raw: DataFrame) -> DataFrame:
    """One row per message: what it says about the article, and its list of entities as it came."""
    p = F.col("payload")
    return _payload(raw).filter(at(p, "$.uuid").isNotNull()).select(
        at(p, "$.uuid").alias("article_uuid"),
        at(p, "$.title").alias("title"),
        at(p, "$.description").alias("description"),
        at(p, "$.snippet").alias("snippet"),
        at(p, "$.url").alias("article_url"),
        at(p, "$.source").alias("news_source"),
        at(p, "$.language").alias("language"),
        at(p, "$.published_at").try_cast("timestamp").alias("published_timestamp"),
        at(p, "$.entities", "array<variant>").alias("entities"))


def _entity(entity: Column) -> list[Column]:
    return [at(entity, "$.symbol").alias("entity_ticker"), at(entity, "$.sentiment_score", "double").alias("sentiment_score"),
            at(entity, "$.name").alias("entity_name")]


def parse_articles(raw: DataFrame) -> DataFrame:
    """One row per message, with typed entities and ``_version``, a digest of all it says about the article itself."""
    said = [*ARTICLE_TEXTS, F.unix_micros("published_timestamp").cast("string")]
    version = F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said]), 256)
    return (_articles(raw).withColumn("entities", F.transform("entities", lambda entity: F.struct(*_entity(entity))))
            .withColumn(VERSION, F.unhex(version)))


def one_article(articles: DataFrame) -> DataFrame:
    """The versions of each article without redelivered copies; one that lists other entities is kept besides."""
    copies, alone = split_copies(articles, ["article_uuid"])
    listed = copies.withColumn("_listed", F.sha2(to_text(F.struct("entities")), 256))
    kept = listed.dropDuplicates(["article_uuid", VERSION, "_listed"]).drop("_listed")
    return kept if alone is None else alone.unionByName(kept)


def listed_entities(articles: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """A row per article and entity, without the article's texts."""
    return articles.select("article_uuid", VERSION, "published_timestamp", *also, F.explode("entities").alias("_entity")).select(
        "article_uuid", VERSION, "published_timestamp", *also, "_entity.*")


def places(articles: DataFrame) -> DataFrame:
    """The order of an article's versions by their texts, for articles that have more than one."""
    number = F.xxhash64(VERSION)
    several = (articles.select("article_uuid", VERSION).groupBy("article_uuid").agg(F.min(number).alias("_low"), F.max(number).alias("_high"))
               .filter("_low <> _high").select("article_uuid"))
    texts = (lookup_join(articles.select("article_uuid", VERSION, *ARTICLE_TEXTS), several, ["article_uuid"], "left_semi")
             .dropDuplicates(["article_uuid", VERSION]))
    greatest = Window.partitionBy("article_uuid").orderBy(*[F.col(c).desc_nulls_first() for c in ARTICLE_TEXTS])
    return texts.select("article_uuid", VERSION, F.row_number().over(greatest).alias("_place"))


def _told_apart(articles: DataFrame, also: Sequence[str]) -> DataFrame:
    """One row per article and entity where an article may have several versions.

    Entities are reduced without their articles' texts, of which each version of an article is shuffled once, however many entities it lists.
    """
    entities = lookup_join(listed_entities(articles, also), places(articles), ["article_uuid", VERSION], "left")
    newest = Window.partitionBy(*ENTITY_KEYS).orderBy(
        F.col("published_timestamp").desc_nulls_first(), F.col("sentiment_score").desc_nulls_first(),
        F.col("_place").asc(), F.col("entity_name").desc_nulls_first())
    kept = entities.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", "_place")
    texts = articles.select(*also, "article_uuid", VERSION, *ARTICLE_TEXTS).dropDuplicates([*also, "article_uuid", VERSION])
    return kept.join(texts, [*also, "article_uuid", VERSION])


def _of_one_list(articles: DataFrame) -> DataFrame:
    """One row per article and entity where each article is one row: its list is reduced where it is."""
    def in_order(entity: Column) -> Column:
        fields = ["sentiment_score", "entity_name"]
        return F.struct(entity["entity_ticker"].alias("entity_ticker"),
                        *[x for f in fields for x in (entity[f].isNull().alias(f"{f}_missing"), entity[f].alias(f))])

    def first_of_ticker(entity: Column, i: Column) -> Column:
        return (i == 0) | ~entity["entity_ticker"].eqNullSafe(F.get("_greatest", i - 1)["entity_ticker"])

    greatest = articles.withColumn("_greatest", F.sort_array(F.transform("entities", in_order), asc=False))
    listed = greatest.withColumn("_entity", F.explode(F.filter("_greatest", first_of_ticker)))
    return listed.withColumns({f: F.col("_entity")[f] for f in ("entity_ticker", "sentiment_score", "entity_name")})


def one_entity(articles: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """One row per article and entity of :func:`parse_articles`: the newest, a missing time counting as newest.

    Rows of one time are told apart by their score, then the article's texts, then their name.  An article that came once is
    neither shuffled nor sorted with others; of one that came again without a change one copy is shuffled.  Only where
    versions differ are entities of an article compared across messages.  ``also`` names columns that follow from the article's id.
    """
    copies, alone = split_copies(articles, ["article_uuid"])
    said = F.xxhash64(VERSION, to_text(F.struct("entities")))
    numbered = copies.withColumn(KEY, F.xxhash64("article_uuid"))
    differing = (numbered.groupBy(KEY).agg(F.min(said).alias("_low"), F.max(said).alias("_high"))
                 .filter("_low <> _high").select(KEY))
    edited, repeated = split_by(numbered, differing, [KEY])
    lists = [repeated.drop(KEY).dropDuplicates(["article_uuid"]), *([] if alone is None else [alone])]
    rows = [_of_one_list(some) for some in lists] + [_told_apart(edited.drop(KEY), also)]
    columns = ["article_uuid", "entity_ticker", "sentiment_score", *ARTICLE_TEXTS, "published_timestamp", "entity_name", *also]
    return reduce(DataFrame.unionByName, [some.select(*columns) for some in rows])


def parse_entity_news(raw: DataFrame) -> DataFrame:
    ticker, score, name = _entity(F.col("entity"))
    return _articles(raw).select("*", F.explode("entities").alias("entity")).select(
        "article_uuid", ticker, score, *ARTICLE_TEXTS, "published_timestamp", name)


def entity_news(raw: DataFrame) -> DataFrame:
    return one_entity(parse_articles(raw))


def parse_headlines(raw: DataFrame) -> DataFrame:
    p = F.col("payload")
    return (_payload(raw)
            .select(at(p, "$.title").alias("title"),
                    at(p, "$.author").alias("author"),
                    at(p, "$.description").alias("description"),
                    at(p, "$.content").alias("content"),
                    at(p, "$.source.id").alias("source_id"),
                    at(p, "$.source.name").alias("source_name"),
                    at(p, "$.url").alias("article_url"),
                    at(p, "$.urlToImage").alias("image_url"),
                    at(p, "$.publishedAt").try_cast("timestamp").alias("published_timestamp"))
            .filter("title IS NOT NULL"))


def headlines(raw: DataFrame) -> DataFrame:
    return one_headline(parse_headlines(raw))
