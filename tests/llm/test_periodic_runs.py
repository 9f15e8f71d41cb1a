"""Runs of repeated words against a plain search."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tickerloom.llm import periodic_runs, queries
from tickerloom.llm.store import ready


@pytest.fixture(scope="module", autouse=True)
def found(spark):
    ready(spark)


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = j + 1 if j == i else j
    return sorted((s, length, q) for (s, length), q in found.items())


def of_words(words):
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    keys = periodic_runs.mix(np.array([ids[w] for w in words], np.uint64))
    return [tuple(map(int, r[1:])) for r in periodic_runs.find_runs(keys, np.array([0, len(words)]))]


def test_runs_equal_a_plain_search():
    chance = random.Random(3)
    for size in range(1, 6):
        for _ in range(400):
            words = [chance.randrange(size) for _ in range(chance.randint(0, 70))]
            for _ in range(chance.randint(0, 3)):
                unit = [chance.randrange(size) for _ in range(chance.randint(1, 12))]
                at = chance.randint(0, len(words))
                words[at:at] = (unit * 8)[:chance.randint(1, 8 * len(unit))]
            assert of_words(words) == plain_runs(words), words


def test_few_words_all_sequences():
    for n in range(13):
        for bits in range(2 ** n):
            words = [bits >> k & 1 for k in range(n)]
            assert of_words(words) == plain_runs(words)


def test_texts_in_one_block_keep_apart():
    keys = np.array([5] * 12, np.uint64)
    assert periodic_runs.find_runs(keys, np.array([0, 5, 12, 12])).tolist() == [[1, 0, 7, 1]]


def expected(doc_id, text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(), n)


def test_query_equals_a_plain_search(spark, tmp_path):
    chance = random.Random(5)
    texts = [None, "", " \n\t ", "a", "a a a a a a", "x y x y " * 9, "é 漢 \U0001f600 " * 7 + "é"]
    for _ in range(150):
        words = [chance.choice("abcdefg") * chance.randint(1, 2) for _ in range(chance.randint(0, 60))]
        words[len(words) // 2:len(words) // 2] = words[:chance.randint(0, 5)] * chance.randint(0, 9)
        texts.append("".join(w + chance.choice([" ", "\n", "\t ", "\x0b", "\r\n"]) for w in words))
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "b b b b b b b", "x", 1), (7, texts[10], "x", 1), (7, texts[10], "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words long").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected(i, t)) for i, t, *_ in rows)


def test_texts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "la la la la la la end"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert got[1].collapsed == "la end" and [tuple(r) for r in got[1].runs] == [(0, 6, 1)]
    assert got[2].collapsed == "" and got[2].runs == []
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_long_text(spark):
    chance = random.Random(1)
    words = [chance.choice(["the", "of", "and", "to", str(k % 997)]) for k in range(300_000)] + ["a", "b", "b"] * 50_000 + ["the"] * 100_000
    runs = [r for r in of_words(words) if r[1] > 1000]
    assert runs == [(300_000, 150_000, 3), (450_000, 100_000, 1)]
