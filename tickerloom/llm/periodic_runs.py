"""Stretches of words that repeat with a period, found online on sparse diagonals.

A diagonal (lag) lives as long as each word equals the word a lag before, and its match length grows with
every such word.  Keeping every earlier occurrence of every word alive costs the square of a common word's count,
so a lag q is followed where it is unmistakable only: on the blocks of L words, q <= L < 2 q, whose nearest
earlier occurrence lies q words back.  Inside a run of smallest period q, a block of at least q words meets
itself at multiples of q alone.  From the first whole block on, the nearest earlier occurrence is thus the diagonal
of the run, up to its last word; a diagonal of c such blocks that ends is a run of c + L + q - 1 words.  For a run
of at least four periods the diagonal isn't empty, and one that is long enough is a run with that
smallest period, so that nothing is lost and nothing needs a second look.  Blocks double from one word on, and only words whose
block occurs more than once stay in the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickerloom.llm.arrays import STEP, U64, WHITE, blocks, edges, mix, text_bytes, word_hashes
from tickerloom.llm.store import documents

LEAST_WORDS = 6
LEAST_PERIODS = 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "runs array<struct<start: bigint, length: bigint, period: bigint>>, n_words bigint"


def find_runs(keys: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, sorted, from the words' hashes and each text's first word, with the end at last.

    ``periods`` is 3 or more: below that a run has no whole block that meets itself.
    """
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(keys)) - first[:-1][text]
    block = mix(keys ^ mix(text.astype(U64) * STEP + STEP))
    alive, size, found = np.arange(len(keys)), 1, []
    while len(alive):
        order = np.argsort(block[alive], kind="stable")
        at, key = alive[order], block[alive][order]
        again = np.flatnonzero(key[1:] == key[:-1])
        lag = np.zeros(len(keys), np.int64)
        lag[at[again + 1]] = at[again + 1] - at[again]
        now = np.flatnonzero((lag > size // 2) & (lag <= size))
        if len(now):
            goes_on = (now[1:] == now[:-1] + 1) & (lag[now[1:]] == lag[now[:-1]])
            begin = now[np.concatenate([[True], ~goes_on])]
            end = now[np.concatenate([~goes_on, [True]])]
            period = lag[begin]
            length = end - begin + size + period
            enough = length >= np.maximum(least, periods * period)
            start = (begin - size + 1 - period)[enough]
            found.append(np.stack([text[start], place[start], length[enough], period[enough]], 1))
        twice = np.zeros(len(keys), bool)
        twice[at[again]] = twice[at[again + 1]] = True
        # A longer block needs room for three periods and both halves met again.
        alive = alive[(place[alive] >= 2 * size - 1) & twice[alive]]
        alive = alive[twice[alive - size]]
        wider = np.zeros(len(keys), U64)
        wider[alive] = mix(block[alive] + mix(block[alive - size] + STEP))
        block, size = wider, 2 * size
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def runs_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        raw, at = text_bytes(batch.column("text"))
        keys, _, _, first = word_hashes(raw, at, ~WHITE)
        rows = find_runs(keys, first)
        cuts = np.searchsorted(rows[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in (1, 2, 3)], fields=list(RUN))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.ListArray.from_arrays(pa.array(cuts), values), pa.array(np.diff(first))], [*batch.schema.names, "runs", "n_words"])


def kept_words(text: bytes, runs: list[dict]) -> Iterator[bytes]:
    """The text in pieces without the words that a run repeats, words joined by one space."""
    words = text.split()
    drop = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        drop[run["start"] + run["period"]] += 1
        drop[run["start"] + run["length"]] -= 1
    stay = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    joint = b""
    for cut in np.split(stay, np.flatnonzero(np.diff(stay) != 1) + 1):
        if len(cut):
            yield joint + b" ".join(words[cut[0]:cut[-1] + 1])
            joint = b" "


def collapse_batch(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist()):
            if digest:
                sha = hashlib.sha256()
                for piece in kept_words(text, runs):
                    sha.update(piece)
                out.append(sha.hexdigest())
            else:
                out.append(b"".join(kept_words(text, runs)).decode())
        columns = {c: batch.column(c) for c in batch.schema.names if c != "text"}
        yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(out, pa.string())], [*columns, "collapsed_sha256" if digest else "collapsed"])


def periodic_runs(docs: DataFrame, digest: bool = False, change: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """(doc_id, runs, n_words, collapsed) for every row of ``docs`` (doc_id, text).

    Words are stretches without white space (space, tab to carriage return), numbered from 0.  A run is a stretch of at least
    six words and four periods, in which words a period apart are equal, that no neighbour extends; its period is the
    smallest.  ``runs`` has (start, length, period) by start, then period.  ``collapsed`` is the text without the words that
    lie in a run after its first period, joined by one space; with ``digest`` its SHA-256 comes in its stead, as
    collapsed_sha256.  ``change`` rewrites batches of (doc_id, text) in the same task beforehand.

    A missing or empty text, or one of white space alone, has no words, no runs and an empty rest.  Every row is treated by itself:
    repeated rows and missing ids stay as they are, other columns are not read, an empty table gives an empty one.  Nothing is
    shuffled; a task holds one block of about 2 MB, or one longer text with some 100 bytes per word.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches):
        yield from collapse_batch(runs_of_batch(change(batches) if change else batches), digest)

    return documents(docs, "doc_id", "text").mapInArrow(work, f"doc_id {kind}, {SCHEMA}, {'collapsed_sha256' if digest else 'collapsed'} string")
