"""Text expressions: ticker rules, payload, sentiment."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from tickerloom import names
from tickerloom.functions.clock import key_time

# The stand-in sentiment model: a word counts for or against.
POSITIVE_WORDS = (
    "beat", "beats", "gain", "gains", "growth", "high", "profit", "profits", "rally", "record",
    "rise", "rises", "strong", "surge", "surges", "up", "upgrade", "win",
)
NEGATIVE_WORDS = (
    "crash", "cut", "cuts", "decline", "down", "downgrade", "drop", "drops", "fall", "falls",
    "fraud", "lawsuit", "loss", "losses", "low", "miss", "misses", "weak",
)


def asset_key(ticker: Column) -> Column:
    return F.md5(ticker.cast("binary"))


def headline_id(title: Column, published: Column) -> Column:
    """A stable id for articles that come without one."""
    return F.md5(F.concat(title, key_time(published)).cast("binary"))


def ticker_by_rules(title: Column, description: Column,
                    rules: Iterable[tuple[str, str, str]] = names.TICKER_RULES,
                    otherwise: str = names.UNKNOWN_TICKER) -> Column:
    """Ticker of the first rule whose word or symbol occurs, whatever the case.

    Matching is by substring, so a symbol also matches inside a longer word.
    """
    picked = None
    for word, symbol, ticker in rules:
        hit = title.ilike(f"%{word}%") | description.ilike(f"%{word}%") | title.ilike(f"%{symbol}%")
        picked = F.when(hit, ticker) if picked is None else picked.when(hit, ticker)
    return F.lit(otherwise) if picked is None else picked.otherwise(otherwise)


def news_payload(title: Column, description: Column, body: Column) -> Column:
    """Title and description in one text; the body stands in for a missing description."""
    return F.trim(F.concat(title, F.lit(" - "), F.coalesce(description, body, F.lit(""))))


def mentions_any(text: Column, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.coalesce(text.ilike(f"%{word}%"), F.lit(False))
    return hit


def signed_score(label: Column, score: Column) -> Column:
    """A label with its confidence as one number from -1 to 1; anything unclear is 0."""
    signed = F.when(label == "positive", score).when(label == "negative", -score).otherwise(F.lit(0.0))
    return F.coalesce(signed.cast("double"), F.lit(0.0))


def score_of_response(body: Column) -> Column:
    """The signed score of a classifier's JSON answer ``[[{label, score}, ...]]``.

    The first entry counts as the top label.  An answer of any other shape scores 0.
    """
    parsed = F.try_parse_json(body)
    return signed_score(
        F.try_variant_get(parsed, "$[0][0].label", "string"),
        F.try_variant_get(parsed, "$[0][0].score", "double"),
    )


def word_sentiment(text: Column, positive: Iterable[str] = POSITIVE_WORDS,
                   negative: Iterable[str] = NEGATIVE_WORDS) -> Column:
    """Label and confidence from counted words, as ``struct<label, score>``."""
    words = F.split(F.lower(text), "[^a-z]+")
    good = F.size(F.filter(words, lambda w: w.isin(*positive)))
    bad = F.size(F.filter(words, lambda w: w.isin(*negative)))
    lead = good - bad
    label = F.when(lead > 0, "positive").when(lead < 0, "negative").otherwise("neutral")
    score = F.coalesce(F.try_divide(F.abs(lead).cast("double"), (good + bad).cast("double")), F.lit(0.0))
    return F.struct(label.alias("label"), score.alias("score"))
