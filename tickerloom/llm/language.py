"""Language of whole texts: scripts narrow the candidates, and Viterbi over the words labels spans.

A word's score for a language is the log probability of its byte trigrams.  Changing the language from one
word to the next costs a fixed penalty, so that single odd words don't break a span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.arrays import LOWER, blocks, edges, lists, text_bytes
from tickerloom.llm.store import documents

BUCKETS = 1 << 16
PENALTY = 8.0
LEAST_SHARE = 0.01
UNKNOWN = "und"
BLOCK = 3_000_000
# Where Unicode's larger scripts begin (what stands between two of them belongs to the earlier one).
SCRIPTS = {
    "latin": (0x41, 0xC0, 0x1E00), "greek": (0x370, 0x1F00), "cyrillic": (0x400, 0x1C80), "armenian": (0x530,), "hebrew": (0x590,), "arabic": (0x600, 0xFB50),
    "indic": (0x900,), "thai and lao": (0xE00,), "tibetan": (0xF00,), "burmese": (0x1000,), "georgian": (0x10A0,), "hangul": (0x1100, 0xAC00),
    "ethiopic": (0x1200,), "khmer": (0x1780,), "kana": (0x3040,), "han": (0x3400, 0xF900, 0x20000), "other": (0x2000, 0x2E80, 0xA000, 0xD800, 0xFE00),
}
STARTS, NUMBERS = (np.array(x) for x in zip(*sorted((start, i) for i, starts in enumerate(SCRIPTS.values()) for start in starts)))
INSIDE = np.isin(np.arange(256), [*range(0x61, 0x7B), *range(0x80, 0x100)])
SPACED = np.where(INSIDE, np.arange(256), 0x20).astype(np.uint32)


def trigrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each byte, begin and end of words, first word of each text, script of each word."""
    low = LOWER[raw]
    begin, end = edges(INSIDE[low], at)
    x = SPACED[low]
    before, after = np.full_like(x, 0x20), np.full_like(x, 0x20)
    before[1:], after[:-1] = x[:-1], x[1:]
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(x))]
    before[inner], after[inner - 1] = 0x20, 0x20
    bucket = (((before << np.uint32(16)) | (x << np.uint32(8)) | after) * np.uint32(2654435761)) >> np.uint32(16)
    return bucket, begin, end, np.searchsorted(begin, at), script_of(low, begin)


def script_of(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The script of the character that begins at each place."""
    padded = np.append(raw, [0, 0, 0]).astype(np.int64)
    lead, one, two, three = (padded[begin + k] for k in range(4))
    point = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 0x1F) << 6 | one & 0x3F, np.where(
        lead < 0xF0, (lead & 0xF) << 12 | (one & 0x3F) << 6 | two & 0x3F, (lead & 7) << 18 | (one & 0x3F) << 12 | (two & 0x3F) << 6 | three & 0x3F)))
    return NUMBERS[np.maximum(np.searchsorted(STARTS, point, "right") - 1, 0)]


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram and script counts of the documents of a task, by language."""
    counts: dict[str, np.ndarray] = {}
    for part in blocks(batches, "text", BLOCK):
        bucket, begin, end, first, script = trigrams(*text_bytes(part.column("text")))
        raw_at = text_bytes(part.column("text"))[1]
        inside = np.zeros(len(bucket) + 1, np.int64)
        inside[begin] += 1
        inside[end] -= 1
        inside = np.cumsum(inside)[:-1] > 0
        langs = part.column("lang").to_pylist()
        names = sorted(set(langs))
        of = np.array([names.index(x) for x in langs])
        by_byte = np.repeat(of, np.diff(raw_at))[inside].astype(np.int64)
        grams = np.bincount(by_byte * BUCKETS + bucket[inside], minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
        by_word = np.repeat(of, np.diff(first)).astype(np.int64)
        scripts = np.bincount(by_word * len(SCRIPTS) + script, minlength=len(names) * len(SCRIPTS)).reshape(len(names), -1)
        for name, a, b in zip(names, grams, scripts):
            counts[name] = counts.get(name, 0) + np.concatenate([a, b])
    for name, row in counts.items():
        some = np.flatnonzero(row)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(some), pa.string()), "bucket": pa.array(some.astype(np.int32)), "n": pa.array(row[some].astype(np.int64))})


@dataclass
class Profiles:
    """Log probabilities of trigrams, and which scripts each language is written in."""

    names: list[str]
    scores: np.ndarray
    allowed: np.ndarray


def learn(docs: DataFrame) -> Profiles:
    """Profiles from all rows of ``docs`` (text, lang) with a language: sums of fixed size, whatever the input.

    What reaches the driver is one table of ``BUCKETS`` counts per language.
    """
    counted = (documents(docs.where(F.col("lang").isNotNull()), "text", "lang").mapInArrow(count_trigrams, "lang string, bucket int, n long")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts")))
    rows = {r.lang: (np.array(r.buckets), np.array(r.counts, float)) for r in counted.toLocalIterator()}
    names = sorted(rows)
    table = np.zeros((len(names), BUCKETS + len(SCRIPTS)))
    for row, name in zip(table, names):
        row[rows[name][0]] = rows[name][1]
    grams, scripts = table[:, :BUCKETS] + 0.5, table[:, BUCKETS:]
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    allowed = share >= LEAST_SHARE
    allowed[:, ~allowed.any(axis=0)] = True
    return Profiles(names, np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32), allowed)


def word_scores(profiles: Profiles, bucket: np.ndarray, begin: np.ndarray, end: np.ndarray, script: np.ndarray) -> np.ndarray:
    """A row of scores for each word; languages not written in its script are out."""
    out = np.empty((len(begin), len(profiles.names)))
    for k, table in enumerate(profiles.scores):
        sums = np.concatenate([[0.0], np.cumsum(table[bucket], dtype=np.float64)])
        out[:, k] = sums[end] - sums[begin]
    out[~profiles.allowed.T[script]] = -1e9
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word.  All texts advance together; the longest ones go on alone."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    labels = np.zeros(len(scores), np.int16)
    if not len(scores):
        return labels
    states = scores.shape[1]
    came = np.zeros((len(scores), states), np.int16)
    every = np.arange(states, dtype=np.int16)
    active = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")  # texts that have a t-th word
    best = np.zeros((active[0], states))
    for t in range(n[0]):
        k = active[t]
        place = begin[:k] + t
        if t:
            best = best[:k]
            top = best.argmax(axis=1).astype(np.int16)
            jump = best[np.arange(k), top] - penalty
            stay = best >= jump[:, None]
            came[place] = np.where(stay, every, top[:, None])
            best = np.where(stay, best, jump[:, None])
        best = best + scores[place]
        ended = active[t + 1] if t + 1 < n[0] else 0
        labels[place[ended:]] = best[ended:].argmax(axis=1)
    for t in range(n[0] - 1, 0, -1):
        place = begin[:active[t]] + t
        labels[place - 1] = came[place, labels[place]]
    return labels


def predict(batches: Iterator[pa.RecordBatch], profiles: Profiles, penalty: float) -> Iterator[pa.RecordBatch]:
    names = profiles.names
    for part in blocks(batches, "text", BLOCK):
        texts = part.column("text")
        n = len(texts)
        raw, at = text_bytes(texts)
        bucket, begin, end, first, script = trigrams(raw, at)
        plain = np.add.reduceat(np.append(((LOWER[raw] >= 0x61) & (LOWER[raw] <= 0x7A)).astype(np.int64), 0), at[:-1]) * (np.diff(at) > 0) if n else np.zeros(0, np.int64)
        lettered = plain > 0
        for i in np.flatnonzero(~lettered & (np.diff(at) > 0)):
            lettered[i] = any(c.isalpha() for c in texts[int(i)].as_py())
        if names:
            labels = viterbi(word_scores(profiles, bucket, begin, end, script), first, penalty)
            doc = np.repeat(np.arange(n), np.diff(first))
            weight = np.bincount(doc * len(names) + labels, (end - begin).astype(float), n * len(names)).reshape(n, len(names))
            top = weight.argmax(axis=1)
            share = weight[np.arange(n), top] / np.maximum(weight.sum(axis=1), 1)
        else:
            labels, doc, top, share = np.zeros(len(begin), np.int16), np.repeat(np.arange(n), np.diff(first)), np.zeros(n, int), np.zeros(n)
            lettered[:] = False
        new = np.ones(len(labels), bool)
        new[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
        span = np.flatnonzero(new)
        spans_at = np.searchsorted(doc[span], np.arange(n + 1))
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id"), pa.array([names[k] if good else UNKNOWN for k, good in zip(top, lettered)], pa.string()), pa.array(np.where(lettered, share, 0.0)),
            lists(pa.array([names[k] for k in labels[span]] if names else [UNKNOWN] * len(span), pa.string()), spans_at), lists((begin[span] - at[doc[span]]).astype(np.int64), spans_at)],
            ["doc_id", "lang_pred", "score", "span_langs", "span_begins"])


def languages(docs: DataFrame, profiles: Profiles, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, span_langs, span_begins) for every row of ``docs`` (doc_id, text).

    Spans are runs of words in one language: its name, and the byte where it begins.  lang_pred has most
    bytes of words (the alphabetically first of equals), score is its share.  A missing text and one without a
    letter are ``und`` with score 0, as is every text if no language was learned.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return documents(docs, "doc_id", "text").mapInArrow(lambda it: predict(it, profiles, penalty), f"doc_id {kind}, lang_pred string, score double, span_langs array<string>, span_begins array<long>")
