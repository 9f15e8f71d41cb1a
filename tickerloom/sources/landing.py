"""From raw response bodies to keyed messages.

Input is a table with one response body per row in ``value``.  ``triage`` gives each row a
verdict: ``accepted``, ``dropped`` (heartbeats, notices and error bodies that carry no
data) or ``rejected`` (not JSON, or not of the feed's shape) with the reason.  ``messages``
turns accepted rows into ``key, value, topic`` rows, one per trade, article or envelope.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tickerloom import names, schemas
from tickerloom.functions.payload import at, computed_once, has_key, to_text, with_payload
from tickerloom.functions.text import mentions_any
from tickerloom.operators.conform import first_fault, shaped, wire_name
from tickerloom.operators.lookup import lookup_join

NOT_JSON = "not JSON"

SHAPES = {
    names.TRADES: schemas.TRADE_MESSAGE,
    names.QUOTES: schemas.QUOTE_MESSAGE,
    names.BARS: schemas.BAR_MESSAGE,
    names.ENTITY_NEWS: schemas.ENTITY_NEWS_MESSAGE,
    names.HEADLINES: schemas.HEADLINE_MESSAGE,
}


def _any_key(body: Column, keys: Iterable[str]) -> Column:
    found = F.lit(False)
    for key in keys:
        found = found | has_key(body, key)
    return found


def carries_data(body: Column, feed: names.Feed) -> Column:
    """Whether a parsed body is of the kind that carries data for the feed.  Never NULL."""
    if feed == names.TRADES:
        ok = at(body, "$.type") == names.TRADE_MESSAGE
    elif feed == names.QUOTES:
        as_number = F.schema_of_variant(F.try_variant_get(body, "$.cmd_id", "variant")) != "STRING"
        ok = as_number & (at(body, "$.cmd_id", "double") == names.QUOTE_PUSH)
    elif feed == names.BARS:
        ok = ~_any_key(body, names.BAR_NOTICE_KEYS)
    elif feed == names.ENTITY_NEWS:
        ok = ~_any_key(body, names.ENTITY_NEWS_ERROR_KEYS)
    else:
        ok = ~at(body, "$.status").eqNullSafe(names.HEADLINES_ERROR_STATUS)
    return F.coalesce(ok, F.lit(False))


def triage(raw: DataFrame, feed: names.Feed) -> DataFrame:
    """``raw`` with ``body`` (VARIANT), ``verdict`` and ``reason``; every row is kept."""
    body = F.col("body")
    wanted = carries_data(body, feed)
    fault = F.when(body.isNull(), NOT_JSON).when(wanted, first_fault(body, SHAPES[feed]))
    judged = computed_once(with_payload(raw, "value", "body"), F.struct(fault.alias("reason"), wanted.alias("wanted")),
                           "_judged")
    reason = F.col("_judged.reason")
    verdict = F.when(reason.isNotNull(), "rejected").when(F.col("_judged.wanted"), "accepted").otherwise("dropped")
    return judged.withColumns({"reason": reason, "verdict": verdict}).drop("_judged")


def tally(triaged: DataFrame) -> DataFrame:
    """How many bodies got which verdict, and why."""
    return triaged.groupBy("verdict", "reason").agg(F.count(F.lit(1)).alias("bodies"))


def verdicts(feed: names.Feed) -> list[tuple[str, str | None]]:
    """Every verdict with its reason that a body of the feed can get."""
    return [("accepted", None), ("dropped", None), ("rejected", NOT_JSON),
            *(("rejected", wire_name(field)) for field in SHAPES[feed])]


def counted(triaged: DataFrame, feed: names.Feed) -> tuple[DataFrame, Observation]:
    """``triaged``, which counts its verdicts while the first action on it runs, so that no second pass is needed.

    The action may not shuffle rows further on, as a stage that is repeated would count again.
    """
    seen = Observation()
    counts = [F.count_if((F.col("verdict") == verdict) & F.col("reason").eqNullSafe(F.lit(reason))).alias(f"n{k}")
              for k, (verdict, reason) in enumerate(verdicts(feed))]
    return triaged.observe(seen, *counts), seen


def observed_tally(spark: SparkSession, seen: Observation, feed: names.Feed) -> DataFrame:
    """What :func:`tally` gives, from the counts of an action that has run."""
    counts = seen.get
    rows = [(verdict, reason, counts[f"n{k}"]) for k, (verdict, reason) in enumerate(verdicts(feed)) if counts[f"n{k}"]]
    return spark.createDataFrame(rows, "verdict string, reason string, bodies long")


def shaped_bodies(triaged: DataFrame, feed: names.Feed) -> DataFrame:
    """Accepted bodies as one typed struct column ``message``."""
    return triaged.filter("verdict = 'accepted'").select(shaped(F.col("body"), SHAPES[feed]).alias("message"))


def elements(triaged: DataFrame, feed: names.Feed) -> DataFrame:
    """One typed row per trade or article, or per envelope for feeds without a list.

    Bars keep the symbol they were asked for, which is in the body's own description.
    """
    typed = shaped_bodies(triaged, feed)
    if feed in (names.TRADES, names.ENTITY_NEWS):
        return typed.select(F.inline("message.data"))
    if feed == names.HEADLINES:
        return typed.select(F.inline("message.articles"))
    return typed.select("message.*")


def message_key(feed: names.Feed) -> Column:
    if feed == names.TRADES:
        return F.col("s")
    if feed == names.QUOTES:
        return F.col("data.code")
    if feed == names.BARS:
        return F.col("meta_data")["2. Symbol"]
    return F.col("uuid") if feed == names.ENTITY_NEWS else F.col("title")


def messages(rows: DataFrame, feed: names.Feed) -> DataFrame:
    """Typed rows of :func:`elements` as queue messages with canonical JSON values."""
    return rows.select(message_key(feed).alias("key"), to_text(F.struct(*rows.columns)).alias("value"),
                       F.lit(feed.topic).alias("topic"))


def watched(rows: DataFrame, column: str, watch: Iterable[str] | DataFrame) -> DataFrame:
    """Rows whose ticker is on the watch-list, given as values or as a table of tickers."""
    if isinstance(watch, DataFrame):
        tickers = watch.select(F.col(watch.columns[0]).alias(column)).distinct()
        return lookup_join(rows, tickers, [column], "left_semi")
    return rows.filter(F.col(column).isin(*watch))


WATCHED = {
    names.TRADES: names.WATCHED_TRADES,
    names.QUOTES: names.WATCHED_QUOTES,
    names.BARS: names.WATCHED_BARS,
    names.ENTITY_NEWS: names.WATCHED_ENTITIES,
    names.HEADLINES: names.HEADLINE_KEYWORDS,
}


def subscribed(rows: DataFrame, feed: names.Feed, watch: Iterable[str] | None = None) -> DataFrame:
    """Rows of :func:`elements` that the feed's subscription asks for.

    Trades, quotes and bars go by ticker, entity news by any of its entities, headlines by
    keywords in title, description or content.
    """
    wanted = list(WATCHED[feed] if watch is None else watch)
    if feed == names.ENTITY_NEWS:
        return rows.filter(F.exists("entities", lambda entity: entity["symbol"].isin(wanted)))
    if feed == names.HEADLINES:
        found = F.lit(False)
        for column in ("title", "description", "content"):
            found = found | mentions_any(F.col(column), wanted)
        return rows.filter(found)
    return rows.filter(message_key(feed).isin(wanted))


def recent(rows: DataFrame, published: Column, today: date | str, days: int = names.LOOK_BACK_DAYS) -> DataFrame:
    """Rows published on or after the day ``days`` before ``today``."""
    start = F.date_sub(F.lit(today).cast("date"), days)
    return rows.filter(published >= start.cast("timestamp"))


def on_topic(rows: DataFrame, text: Column, language: Column,
             keywords: Iterable[str] = names.HEADLINE_KEYWORDS,
             wanted: str = names.HEADLINE_LANGUAGE) -> DataFrame:
    """Rows in the wanted language whose text has one of the keywords."""
    return rows.filter((language == wanted) & mentions_any(text, keywords))


def newest(rows: DataFrame, published: str, tie: str, n: int = names.ARTICLES_PER_POLL) -> DataFrame:
    """The ``n`` newest rows: the provider's cap per poll."""
    return rows.orderBy(F.col(published).desc(), F.col(tie)).limit(n)


def best_price(levels: Column, otherwise: str = "N/A") -> Column:
    """Price of the first level of a book side, or a text where the side is empty."""
    return F.coalesce(F.get(levels, F.lit(0))["price"], F.lit(otherwise))
