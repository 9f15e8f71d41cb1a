"""Wide rows whose key came once stay where they are."""

import random
import re

from tests.helpers import raw, rows
from tickerloom.operators.dedup import keep_latest, keep_latest_wide
from tickerloom.plans import staging
from tests.test_news import messages


def shuffled(df):
    """What the exchanges that ran with rows read; a branch that turned out to be empty reads nothing."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [below for below in re.split(r"Exchange|Sort ", plan)[1:] if re.match(r"(?s)((?!EmptyRelation|<empty>).)*Scan Exist", below)]


def articles(n):
    """Each id once, with entities that repeat a ticker within the list."""
    chance = random.Random(3)
    for i, message in enumerate(messages(n)):
        again = [{"symbol": chance.choice(["A", None]), "name": chance.choice(["x", "z", None]), "sentiment_score": chance.choice([0.5, 2, None])} for _ in range(3)]
        yield message | {"uuid": f"u{i}", "entities": (message["entities"] or []) + again}


def test_articles_that_came_once_are_not_shuffled(spark):
    given = raw(spark, *articles(60)).repartition(4).checkpoint()
    assert shuffled(staging.entity_news(given)) == []


def test_once_again_and_edited(spark):
    """Articles that came once, again without a change, and in several versions, against whole rows."""
    once, edited = list(articles(60)), list(messages(60))
    listed_again = [m | {"entities": m["entities"] + [{"symbol": "A", "name": "zz", "sentiment_score": 9}]} for m in once[:10]]
    moved = [m | {"entities": [{"symbol": None, "name": "A", "sentiment_score": None}], "uuid": "m"} for m in once[:1]]
    moved += [moved[0] | {"entities": [{"symbol": "A", "name": None, "sentiment_score": None}]}]
    given = raw(spark, *once, *once[5:30], *once[20:25], *listed_again, *edited, *moved).repartition(5).checkpoint()
    expected = rows(keep_latest(staging.parse_entity_news(given), staging.ENTITY_KEYS, ["published_timestamp"]))
    assert sorted(map(repr, rows(staging.entity_news(given)))) == sorted(map(repr, expected))
    assert {("m", None), ("m", "A")} <= {r[:2] for r in expected}


def headline_rows(n, others):
    chance = random.Random(7)
    for i in range(n):
        yield {"title": f"t{i}", "publishedAt": chance.choice(["2024-01-01T00:00:00Z", None]), "description": "d" * 50}
    for _ in range(others):
        yield {"title": chance.choice(["a", "b", "t1"]), "publishedAt": chance.choice(["2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", None]),
               "description": chance.choice(["x", "y", None]), "author": chance.choice(["p", None])}


def test_headlines_that_came_once_are_not_shuffled(spark):
    given = raw(spark, *headline_rows(60, 0)).repartition(4).checkpoint()
    assert shuffled(staging.headlines(given)) == []


def test_headlines_equal_the_latest_whole_rows(spark):
    """Also those without a time, and where too many keys have copies to tell them apart."""
    parsed = staging.parse_headlines(raw(spark, *headline_rows(40, 60)).repartition(4).checkpoint())
    expected = sorted(map(repr, rows(keep_latest(parsed, staging.HEADLINE_KEYS, []))))
    assert sorted(map(repr, rows(staging.one_headline(parsed)))) == expected and len(expected) > 45
    assert sorted(map(repr, rows(keep_latest_wide(parsed, staging.HEADLINE_KEYS, [], max_bytes=0)))) == expected
