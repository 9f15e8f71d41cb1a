"""Fingerprints of documents from content-defined chunks, and how much of one document is in another.

A gear hash over the last few bytes decides where a chunk ends, so that an edit moves the cuts near it
only.  Cuts are normalised: rarer before the usual size and more frequent behind it.  A fingerprint is the
set of (digest, length) of the chunks; lengths weigh how much of it another one contains.  Every text has coarse
chunks and one that isn't long has fine ones besides; two texts are compared by the finest kind that both have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.llm.arrays import BYTE, STEP, U64, Prefixes, mix, text_bytes
from tickerloom.llm.store import documents

@dataclass(frozen=True)
class Sizes:
    """Bytes of a chunk, and the bits of the gear hash that must be zero before and behind the usual size."""

    least: int
    usual: int
    most: int
    strict: int
    loose: int


SHORT = 1024  # characters; a text of fewer is cut finely, too, as it has few coarse chunks or one
FINELY = U64(0x8000)  # marks a fine chunk in its length
FINE, COARSE = Sizes(4, 6, 24, 3, 1), Sizes(16, 32, 128, 7, 4)
GEAR = (mix(BYTE + STEP) >> U64(32)).astype(np.uint32)


def gear(raw: np.ndarray, window: int) -> np.ndarray:
    """The gear hash of the ``window`` bytes that end at each place."""
    h = GEAR[raw]
    back = 1
    while back < window:
        shifted = np.zeros_like(h)
        shifted[back:] = h[:-back] << np.uint32(back)
        h += shifted
        back *= 2
    return h


def chunks(raw: np.ndarray, at: np.ndarray, size: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, begin and end of every chunk; all texts advance together by a chunk."""
    h = gear(raw, size.least)
    far = np.iinfo(np.int64).max
    strict, loose = (np.append(np.flatnonzero(h >> np.uint32(32 - bits) == 0), far) for bits in (size.strict, size.loose))
    doc = np.flatnonzero(np.diff(at) > 0)
    begin, out = at[:-1][doc], [(doc[:0], at[:0], at[:0])]
    while len(doc):
        early = strict[np.searchsorted(strict, begin + size.least - 1)]
        late = loose[np.searchsorted(loose, begin + size.usual - 1)]
        last = np.where(early < begin + size.usual - 1, early, np.minimum(late, begin + size.most - 1))
        end = np.minimum(last + 1, at[doc + 1])
        out.append((doc, begin, end))
        more = end < at[doc + 1]
        doc, begin = doc[more], end[more]
    return tuple(np.concatenate(x) for x in zip(*out))


def chunk_sets(column: pa.Array) -> list[np.ndarray]:
    """For each text its sorted distinct chunks: 32 bits of digest, a mark of fine chunks, 15 bits of length."""
    short = pc.less(pc.utf8_length(column), SHORT).to_numpy(zero_copy_only=False)
    out: list[np.ndarray] = [np.zeros(0, U64)] * len(column)
    for size, mark, rows in ((COARSE, U64(0), np.arange(len(column))), (FINE, FINELY, np.flatnonzero(short))):
        if not len(rows):
            continue
        raw, at = text_bytes(column.take(pa.array(rows)))
        doc, begin, end = chunks(raw, at, size)
        value = (Prefixes(raw).of(begin, end) >> U64(32) << U64(16)) | (end - begin).astype(U64) | mark
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        for row, some in zip(rows, np.split(value[new], np.searchsorted(doc[new], np.arange(1, len(rows))))):
            out[row] = np.sort(np.concatenate([out[row], some])) if mark else some
    return out


def fingerprint(chunk_set: np.ndarray) -> str:
    """12 hexadecimal digits for each chunk."""
    return chunk_set.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def parse(text: str) -> np.ndarray:
    six = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, 6)
    return np.ascontiguousarray(np.pad(six, ((0, 0), (2, 0)))).view(">u8").reshape(-1).astype(U64)


def contained(one: np.ndarray, other: np.ndarray) -> float:
    """The share of the bytes of one fingerprint's chunks that the other has, too; 1 for two empty ones.

    Fine chunks count if both have some, or else the coarse ones, which every text has that isn't empty.
    """
    if not len(one):
        return float(not len(other))
    fine, other_fine = (one & FINELY) > 0, (other & FINELY) > 0
    both = fine.any() and other_fine.any()
    one, other = one[fine == both], other[other_fine == both]
    weight = (one & ~FINELY & U64(0xFFFF)).astype(np.int64)
    place = np.searchsorted(other, one)
    same = np.append(other, U64(0))[place] == one
    return float(weight[same].sum() / weight.sum())


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by as many from the beginning of the next text."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def compare(ids: pa.Array, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """The answer for each text and the one that comes after it."""
    changed = [edited(a, b) for a, b in zip(texts, following)]
    own = chunk_sets(pa.array(texts, pa.string()))
    after = chunk_sets(pa.array(changed, pa.string()))
    nexts = own[1:] + chunk_sets(pa.array(following[-1:], pa.string())) if texts[1:] == following[:-1] else chunk_sets(pa.array(following, pa.string()))
    return pa.RecordBatch.from_arrays([
        ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array([fingerprint(x) for x in own], pa.string()), pa.array([fingerprint(x) for x in after], pa.string()),
        pa.array([contained(a, b) for a, b in zip(own, after)], pa.float64()), pa.array([contained(a, b) for a, b in zip(own, nexts)], pa.float64())],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


ANSWER = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def walk(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Answers for every row that isn't a guest, from rows sorted by range; the row behind it has the next text."""
    ids, guests, held = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        column, guest = batch.column("doc_id"), batch.column("guest").to_pylist()
        _, at = text_bytes(batch.column("text"))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
            ids = column.slice(begin, end - begin) if ids is None else pa.concat_arrays([ids, column.slice(begin, end - begin)])
            guests += guest[begin:end]
            held += batch.column("text").slice(begin, end - begin).to_pylist()
            if len(held) > 1:
                yield compare(ids.slice(0, len(ids) - 1), held[:-1], held[1:]).filter(pa.array([not g for g in guests[:-1]]))
                ids, guests, held = ids.slice(len(ids) - 1), guests[-1:], held[-1:]
            begin = end


def range_of(key: Column, tops: list[Column], low: int, high: int) -> Column:
    """The number of the last of the descending ``tops`` that isn't below ``key``, by halving."""
    if high - low == 1:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(key > tops[middle], range_of(key, tops, low, middle)).otherwise(range_of(key, tops, middle, high))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text, and their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  The next document
    is the one with the next smaller id (after the last: the first); rows that repeat an id follow each
    other by a hash of their texts, rows without an id come last.  A missing text is empty: its fingerprint is
    empty, and like another empty one alone.  A single document is its own next one.  Likeness is the share of a
    document's chunks, by bytes, that the other has.  Ids and hashes alone are dealt into ranges first.  Then
    every text goes to its range, and the first one of each range also to the range before it, as a guest.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    rows = documents(docs, "doc_id", "text").withColumn("hash", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("doc_id"), F.desc("hash")]
    key = F.struct("doc_id", "hash")
    ranges = rows.select("doc_id", "hash").repartitionByRange(n, *order).groupBy(F.spark_partition_id()).agg(F.max(key).alias("top"))
    found = [r.top for r in ranges.orderBy(F.desc("top")).collect()]  # at most one row per partition
    if not found:
        return spark.createDataFrame([], f"doc_id {kind}, {ANSWER}")
    tops = [F.struct(F.lit(t.doc_id).cast(kind).alias("doc_id"), F.lit(t.hash).alias("hash")) for t in found]
    own = rows.withColumn("range", range_of(key, tops, 0, len(tops))).withColumn("guest", F.lit(False))
    first = rows.where(F.col("hash").isin([t.hash for t in found]))
    guests = (first.withColumn("range", range_of(key, tops, 0, len(tops))).where(key == F.element_at(F.array(*tops), F.col("range") + 1))
              .withColumn("range", F.pmod(F.col("range") - 1, F.lit(len(tops)))).withColumn("guest", F.lit(True)))
    dealt = own.unionByName(guests).repartitionById(n, F.col("range")).sortWithinPartitions("range", "guest", *order)
    return dealt.select("doc_id", "text", "guest").mapInArrow(walk, f"doc_id {kind}, {ANSWER}")
