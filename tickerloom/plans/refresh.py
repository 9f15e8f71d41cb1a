"""One refresh: rebuild the models from the raw tables, then score, then evaluate."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from tickerloom import names, schemas
from tickerloom.plans import evaluation, incremental, marts, predictions, staging, unified
from tickerloom.sources import bronze
from tickerloom.sources.tables import Tables

EVALUATIONS = names.FCT_PREDICTIONS + "_outcomes"

STAGING = (
    (names.STG_TRADES, names.TRADES, staging.trades),
    (names.STG_QUOTES, names.QUOTES, staging.quotes),
    (names.STG_BARS, names.BARS, staging.bars),
    (names.STG_ENTITY_NEWS, names.ENTITY_NEWS, staging.entity_news),
    (names.STG_HEADLINES, names.HEADLINES, staging.headlines),
)


def staged(tables: Tables, bronze_root: str) -> dict[str, DataFrame]:
    """The staging models as views over the raw tables."""
    return {name: tables.view(name, model(bronze.read(tables.spark, bronze_root, feed.bronze)))
            for name, feed, model in STAGING}


def transform(tables: Tables, bronze_root: str, as_of: datetime | str | None = None, rules=names.TICKER_RULES) -> dict[str, DataFrame]:
    """Rebuild all stored models.  Each is computed once and read back where others need it."""
    models = staged(tables, bronze_root)
    ticks = tables.replace(names.INT_TICKS, unified.market_ticks(models[names.STG_QUOTES], models[names.STG_TRADES]))
    news = tables.replace(names.INT_NEWS, unified.news(models[names.STG_ENTITY_NEWS], models[names.STG_HEADLINES], rules))
    history = tables.replace(names.FCT_HISTORY, marts.daily_history(models[names.STG_BARS]))
    models |= {
        names.INT_TICKS: ticks,
        names.INT_NEWS: news,
        names.FCT_HISTORY: history,
        names.DIM_ASSETS: tables.replace(names.DIM_ASSETS, marts.assets(tables.spark, as_of)),
        names.FCT_STREAM: tables.replace(names.FCT_STREAM, marts.realtime_stream(ticks, as_of)),
        names.FCT_FEATURES: tables.replace(names.FCT_FEATURES, marts.market_features(ticks, history, as_of)),
        names.FCT_NEWS_INPUTS: tables.replace(names.FCT_NEWS_INPUTS, marts.news_inputs(news, as_of)),
    }
    return models


def score(tables: Tables, as_of: datetime | str | None = None, limit: int | None = None,
          load_model: Callable[[], predictions.TextModel] | None = None, **how) -> None:
    """Append predictions for the current features; a repeated run appends nothing new.

    ``how`` is passed on to :func:`tickerloom.plans.predictions.predict`.
    """
    made = predictions.predict(tables.read(names.FCT_NEWS_INPUTS), tables.read(names.FCT_FEATURES), as_of,
                               load_model, limit, **how)
    stored = tables.read_or_empty(names.FCT_PREDICTIONS, schemas.PREDICTIONS)
    tables.append(names.FCT_PREDICTIONS, predictions.not_yet_stored(made, stored))


def evaluate(tables: Tables, as_of: datetime | str | None = None, **how) -> None:
    """Append outcomes for predictions whose moment has come; ``how`` is passed on to the evaluation."""
    made = tables.read_or_empty(names.FCT_PREDICTIONS, schemas.PREDICTIONS)
    due = evaluation.pending(made, outcomes_table(tables), as_of)
    batch = f"refresh-{as_of or datetime.now(timezone.utc).isoformat()}".replace(":", "").replace(" ", "T")
    evaluation.store(evaluation.evaluate(due, tables.read(names.FCT_STREAM), as_of, **how), tables.path(EVALUATIONS), f"{batch}-{uuid.uuid4().hex[:8]}")


def outcomes_table(tables: Tables) -> DataFrame:
    """The outcomes of scheduled runs and streams, one per prediction."""
    return evaluation.one_outcome(tables.read_or_empty(EVALUATIONS, schemas.EVALUATIONS))


def predictions_table(tables: Tables) -> DataFrame:
    """The prediction table with outcomes."""
    return evaluation.merged(tables.read_or_empty(names.FCT_PREDICTIONS, schemas.PREDICTIONS),
                             outcomes_table(tables))


def refresh(tables: Tables, bronze_root: str, as_of: datetime | str | None = None, limit: int | None = None,
            load_model: Callable[[], predictions.TextModel] | None = None, whole: bool = True) -> DataFrame:
    """One full cycle; returns the prediction table.

    Unless ``whole``, only what new messages touch is rebuilt (:mod:`tickerloom.plans.incremental`); one set of tables is to
    be refreshed in one of both ways.
    """
    (transform if whole else incremental.transform)(tables, bronze_root, as_of)
    score(tables, as_of, limit, load_model)
    evaluate(tables, as_of)
    return predictions_table(tables)
