"""A refresh that rebuilds only what new messages touch.

Every stored model is dealt in parts, and a part of one model is made from the part of the same name of the one before it:
staging -> unified -> facts.  The part of a record follows from its key alone, so that all copies of it, however late they come, meet in
one.  A refresh reads the raw folders that it hasn't seen, reduces their rows together with those of the parts they fall
into, and puts these parts in the place of the old ones, model by model.  What isn't touched is neither read nor written.

Trades are dealt by ticker group and day, bars by ticker group and year, headlines by day.  A quote's copies may differ in time, not in
their sequence number, so quotes are dealt by ticker group and block of sequence numbers; entities of an article by a hash.
Articles are staged with their lists of entities, one row per version; rows per entity, which repeat the article's texts, are
made where they are stored and never shuffled.
Features depend on the newest bars of their ticker besides: these are kept apart, and where the baseline of a ticker
changes, the features of its group are made anew.

Which folders have been seen is noted last.  A refresh that breaks off is made good by the next, as reducing the same rows again
changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime
from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom import names
from tickerloom.operators.lookup import lookup_join
from tickerloom.plans import marts, staging, unified
from tickerloom.sources import bronze
from tickerloom.sources.tables import Tables
from tickerloom.sources.versions import PART

GROUPS = 16  # of tickers
BLOCK = 100_000  # sequence numbers
STATE = "refresh_state"
NEWEST_BARS = "newest_bars"


def group_of(ticker: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(ticker), F.lit(groups)).cast("string")


def named(letter: str, *values: Column) -> Column:
    """A part's name; a missing value is a part of its own."""
    return F.concat(F.lit(letter), F.concat_ws("-", *[F.coalesce(v.cast("string"), F.lit("none")) for v in values]))


@dataclass(frozen=True)
class Staged:
    """One staging model: how its feed is parsed, which of its copies stays, and the part it lies in."""

    model: str
    feed: names.Feed
    parse: Callable[[DataFrame], DataFrame]
    reduce: Callable[[DataFrame], DataFrame]
    part: Column


def staged(groups: int = GROUPS, block: int = BLOCK) -> dict[str, Staged]:
    day, year = "yyyy-MM-dd", "yyyy"
    return {
        "trades": Staged(names.STG_TRADES, names.TRADES, staging.parse_trades, staging.one_trade,
                         named("t", group_of("stock_ticker", groups), F.date_format("event_timestamp", day))),
        "quotes": Staged(names.STG_QUOTES, names.QUOTES, staging.parse_quotes, staging.one_quote,
                         named("q", group_of("asset_ticker", groups), F.floor(F.col("sequence_id") / block))),
        "bars": Staged(names.STG_BARS, names.BARS, staging.parse_bars, staging.one_bar,
                       named("b", group_of("stock_ticker", groups), F.date_format("candle_date", year))),
        "entities": Staged(names.STG_ENTITY_NEWS, names.ENTITY_NEWS, staging.parse_articles, staging.one_article,
                           named("e", group_of("article_uuid", groups))),
        "headlines": Staged(names.STG_HEADLINES, names.HEADLINES, staging.parse_headlines, staging.one_headline,
                            named("h", F.date_format("published_timestamp", day))),
    }


def merge(tables: Tables, raw: DataFrame, how: Staged) -> list[str]:
    """Bring raw rows into a staging model; the parts that they fall into.

    Raw rows are read once for the names of these parts and once to be reduced together with what is stored in them.
    """
    new = how.parse(raw)
    store = tables.versions(how.model)
    if not store.exists():
        return tables.replace_parts(how.model, how.reduce(new).withColumn(PART, how.part))
    parts = sorted(r[0] for r in new.select(how.part.alias(PART)).distinct().collect())
    if parts:
        both = new.unionByName(store.stored(parts).drop(PART))
        tables.replace_parts(how.model, how.reduce(both).withColumn(PART, how.part), parts)
    return parts


def newest_bars(bars: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("stock_ticker").orderBy(F.col("candle_date").desc_nulls_first())
    return bars.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def merge_baselines(tables: Tables, bars: DataFrame, groups: int, n: int = names.BASELINE_ROWS) -> set[str]:
    """Keep the newest bars of every ticker; the ticker groups in which a baseline is another than before.

    Bars are only added or replaced by later versions of themselves, so the newest ``n`` follow from
    those known and those touched.
    """
    group = group_of("stock_ticker", groups)
    store = tables.versions(NEWEST_BARS)
    if store.exists() and not bars.inputFiles():
        return set()
    touched = newest_bars(bars.drop(PART), n)
    within = sorted(r[0] for r in touched.select(group.alias("g")).distinct().collect())
    old = store.stored(within).drop(PART) if store.exists() else None
    both = touched if old is None else staging.one_bar(touched.unionByName(old))
    store.replace_parts(newest_bars(both, n).withColumn(PART, group), within)
    now = marts.baselines(store.stored(within), n)
    if old is None:
        return set(within)
    marked = now.withColumn("_side", F.lit(1)).unionByName(marts.baselines(old, n).withColumn("_side", F.lit(-1)))
    changed = marked.groupBy(*now.columns).agg(F.sum("_side").alias("_n")).filter("_n <> 0")
    groups_changed = {r[0] for r in changed.select(group.alias("g")).distinct().collect()}
    tables.tidy(NEWEST_BARS)
    return groups_changed


def features_of(tables: Tables, ticks: DataFrame, parts: Iterable[str], as_of: datetime | str | None) -> DataFrame:
    live = ticks.select("stock_ticker", "event_timestamp", "trade_price", "trade_volume", PART)
    baselines = marts.baselines(tables.versions(NEWEST_BARS).stored({p[1:].split("-")[0] for p in parts}))
    return marts.with_features(lookup_join(live, baselines, ["stock_ticker"], "left"), as_of, [PART])


def entities_as_news(articles: DataFrame) -> DataFrame:
    return unified.entity_news_as_news(staging.one_entity(articles, [PART]), [PART])


def transform(tables: Tables, bronze_root: str, as_of: datetime | str | None = None, rules=names.TICKER_RULES,
              groups: int = GROUPS, block: int = BLOCK) -> dict[str, list[str]]:
    """Bring all stored models up to the raw tables; the parts of each that were made anew.

    ``groups`` and ``block`` are to stay the same over the life of the tables.
    """
    spark = tables.spark
    state = tables.versions(STATE)
    seen = state.state()["notes"]
    touched, noted = {}, {}
    for name, how in staged(groups, block).items():
        present = bronze.folders(spark, bronze_root, how.feed.bronze)
        fresh = [folder for folder, at in present.items() if seen.get(name, {}).get(folder) != at]
        touched[name] = []
        if fresh or not tables.versions(how.model).exists():
            touched[name] = merge(tables, bronze.read_folders(spark, bronze_root, how.feed.bronze, fresh), how)
        noted[name] = present

    made: dict[str, list[str]] = {}

    def put(model: str, parts: list[str], *sources: tuple[Callable[[DataFrame], DataFrame], str, list[str]], gather: bool = False,
            each: tuple[Callable[[DataFrame], DataFrame], str, list[str]] | None = None) -> None:
        """Make parts of a model from parts of others; a model that isn't there yet is made even without any.

        Rows of a stored part lie together, and so do those made from them, unless they are to be gathered.  Parts of
        the source ``each`` are made one by one.
        """
        made[model] = parts
        if parts or not tables.versions(model).exists():
            first, *more = [make(tables.versions(source).stored(some)) for make, source, some in sources]
            make, source, some = each or (None, None, [])
            one_by_one = ((p, make(tables.versions(source).stored([p]))) for p in some)
            tables.replace_parts(model, first, parts, *more, gather=gather, each=one_by_one)

    ticks, news = touched["quotes"] + touched["trades"], touched["entities"] + touched["headlines"]
    put(names.INT_TICKS, ticks, (lambda df: unified.quotes_as_ticks(df, [PART]), names.STG_QUOTES, touched["quotes"]),
        (lambda df: unified.trades_as_ticks(df, [PART]), names.STG_TRADES, touched["trades"]))
    put(names.FCT_STREAM, ticks, (lambda df: marts.realtime_stream(df, as_of, [PART]), names.INT_TICKS, ticks))
    put(names.FCT_HISTORY, touched["bars"], (lambda df: marts.daily_history(df, [PART]), names.STG_BARS, touched["bars"]))
    changed = merge_baselines(tables, tables.versions(names.STG_BARS).stored(touched["bars"]), groups)
    known = tables.versions(names.INT_TICKS).state()["parts"]
    features = sorted({*ticks, *(p for p in known if p[1:].split("-")[0] in changed)})
    put(names.FCT_FEATURES, features, (lambda df: features_of(tables, df, features, as_of), names.INT_TICKS, features), gather=True)
    # No part has both entities and headlines.  Rows per entity repeat their article's texts, so they aren't sorted by part.
    entities, headlines = touched["entities"], touched["headlines"]
    put(names.INT_NEWS, news, (lambda df: unified.known_headlines(df, rules, [PART]), names.STG_HEADLINES, headlines),
        each=(entities_as_news, names.STG_ENTITY_NEWS, entities))
    inputs = partial(marts.news_inputs, as_of=as_of, also=[PART])
    put(names.FCT_NEWS_INPUTS, news, (inputs, names.INT_NEWS, headlines), each=(inputs, names.INT_NEWS, entities))
    if not tables.versions(names.DIM_ASSETS).exists():
        tables.replace(names.DIM_ASSETS, marts.assets(spark, as_of))
    state.note(**noted)
    return made
