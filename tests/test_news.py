"""Entities of articles: reduced without the articles' texts, as if whole rows were compared."""

import random

from tests.helpers import raw, rows
from tickerloom import names
from tickerloom.operators.dedup import keep_latest
from tickerloom.plans import incremental, staging
from tickerloom.sources import bronze
from tickerloom.sources.tables import Tables
from workload import inputs

COLUMNS = ["article_uuid", "entity_ticker", "sentiment_score", "title", "description", "snippet", "article_url",
           "news_source", "language", "published_timestamp", "entity_name"]


def messages(n):
    chance = random.Random(5)
    times = ["2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", None]
    for _ in range(n):
        entity = [{"symbol": chance.choice(["A", "B", "", None]), "name": chance.choice(["x", "y", None]), "sentiment_score": chance.choice([0.5, -1, None])}
                  for _ in range(chance.randint(0, 4))]
        yield {"uuid": chance.choice([f"u{chance.randint(0, 25)}", None]), "published_at": chance.choice(times), "entities": chance.choice([entity, None, entity]),
               **{k: chance.choice(["1", "2:", "", None]) for k in ("title", "description", "snippet", "language")}}


def test_entities_equal_the_latest_whole_rows(spark):
    sent = list(messages(400))
    given = raw(spark, *sent, *sent[:100]).repartition(5)
    expected = keep_latest(staging.parse_entity_news(given), staging.ENTITY_KEYS, ["published_timestamp"])
    got = staging.entity_news(given)
    assert got.columns == expected.columns == COLUMNS
    assert sorted(map(repr, rows(got))) == sorted(map(repr, rows(expected))) and got.count() > 60


def test_texts_are_not_carried_by_every_entity(spark):
    """The window that reduces the entities neither compares nor holds the texts of their articles."""
    given = raw(spark, {"uuid": "u", "title": "t", "description": "d" * 1000, "entities": [{"symbol": str(i)} for i in range(50)]})
    plan = staging.entity_news(given)._jdf.queryExecution().optimizedPlan().toString()
    reduced = [line for line in plan.splitlines() if "Window [row_number()" in line and "entity_ticker" in line]
    assert reduced and not any("description" in line for line in reduced)


def test_refreshes_of_parts_equal_the_whole(spark, tmp_path):
    """Redelivered, edited and late articles over three refreshes."""
    sent = list(messages(300))
    tables, root = Tables(spark, str(tmp_path / "models")), str(tmp_path / "bronze")
    for number in range(3):
        batch = inputs.queue_records(raw(spark, *sent[number * 80:number * 80 + 140]), names.ENTITY_NEWS, "2024-01-10")
        bronze.append_batch(batch, root, number)
        incremental.transform(tables, root, "2024-01-20 12:00:00", groups=3)
    whole = keep_latest(staging.parse_entity_news(raw(spark, *sent)), staging.ENTITY_KEYS, ["published_timestamp"])
    stored = tables.read(names.INT_NEWS)
    got = stored.select("news_id", "asset_ticker", "sentiment_score", "title", "description", "content_body", "language", "published_timestamp")
    expected = whole.select("article_uuid", "entity_ticker", "sentiment_score", "title", "description", "snippet", "language", "published_timestamp")
    assert sorted(map(repr, rows(got))) == sorted(map(repr, rows(expected)))
    assert tables.read(names.STG_ENTITY_NEWS).count() < 300  # a row per version, none per entity
