"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.arrays import blocks, lists
from tickerloom.llm.store import documents, kept
from tickerloom.llm.wordbpe import encoder

CHUNK = 20_000
OVERLAP = 256
WIDEN = 16
BLANK = frozenset(" \t\n\r\x0b\x0c")


def count_rows(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for part in blocks(batches, "text"):
        n = np.array([len(ids) // 4 for ids in encode.ids(part.column("text").to_pylist())], np.int64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])


def stable(text: str, spans: tuple[np.ndarray, np.ndarray], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of ``text`` between ``low`` and ``high`` that every encoding shares, and the tokens before each.

    A cut is proven where a blank ends: white space never lies inside a token, so what stands
    left of it cannot change what stands right of it.  Offsets confirm it: no token may cross it.
    """
    begin, end = spans
    places = np.array([i for i in range(max(low, 1), min(high, len(text) - 1) + 1) if text[i - 1] in BLANK and text[i] not in BLANK], np.int64)
    before = np.searchsorted(begin, places)
    crossed = np.where(before > 0, end[np.maximum(before - 1, 0)] if len(end) else 0, 0) > places
    return places[~crossed], before[~crossed]


def cut(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """A row for each overlapping chunk of each text."""
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), (x.as_py() for x in batch.column("text"))):
            last = (len(text) - 1) // chunk
            for first in range(0, last + 1, 64):
                some = range(first, min(first + 64, last + 1))
                starts = [max(i * chunk - overlap, 0) for i in some]
                yield pa.RecordBatch.from_pydict({
                    "key": [key] * len(some), "i": pa.array(some, pa.int32()), "last": pa.array([last] * len(some), pa.int32()), "start": pa.array(starts, pa.int64()),
                    "chunk": [text[a:(i + 1) * chunk + overlap] for a, i in zip(starts, some)], "overlap": pa.array([overlap] * len(some), pa.int32())})


def encode_chunks(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    """For each chunk: its tokens, and the stable cuts in what it shares with the chunks around it."""
    encode = encoder(path)
    for part in blocks(batches, "chunk"):
        rows = part.to_pydict()
        names, out = ["key", "side", "n", "cuts", "before"], [[], [], [], [], []]
        for key, i, last, start, chunk, overlap, spans in zip(
                rows["key"], rows["i"], rows["last"], rows["start"], rows["chunk"], rows["overlap"], encode.spans(rows["chunk"])):
            shared = 2 * overlap
            total = len(spans[0])
            sides = []
            if i > 0:
                sides.append((i - 1, "right", *stable(chunk, spans, 0, shared)))
            if i < last:
                sides.append((i, "left", *stable(chunk, spans, len(chunk) - shared, len(chunk))))
            for k, (seam, side, cuts, before) in enumerate(sides or [(-1, "whole", np.zeros(0, np.int64), np.zeros(0, np.int64))]):
                for column, value in zip(out, (f"{key}/{seam}", side, total if k == 0 else 0, cuts + start, before if side == "right" else total - before)):
                    column.append(value)
        at = np.cumsum([0, *map(len, out[3])])
        flat = [lists(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64), at) for x in out[3:]]
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), *flat], names)


def count_long(long: DataFrame, path: str | None, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of ``long``, with n_tokens missing where two chunks share no stable cut.

    Chunk ``i`` covers ``chunk`` characters and ``overlap`` more on either side.  At each seam
    both sides report their stable cuts; at the first common one the text is spliced: tokens of the
    left chunk from there on and those of the right chunk before it are taken off the sum.
    """
    chunks = (long.mapInArrow(lambda it: cut(it, chunk, overlap), "key string, i int, last int, start long, chunk string, overlap int")
              .repartition("key", "i"))
    sides = chunks.mapInArrow(lambda it: encode_chunks(it, path), "key string, side string, n long, cuts array<long>, before array<long>")
    of = lambda side, what: F.max(F.when(F.col("side") == side, F.col(what)))
    seams = (sides.withColumnRenamed("key", "seam").groupBy("seam")
             .agg(F.sum("n").alias("n"), *[of(s, w).alias(f"{s}_{w}") for s in ("left", "right") for w in ("cuts", "before")], F.max(F.col("side") == "whole").alias("whole")))
    common = F.element_at(F.array_intersect("left_cuts", "right_cuts"), 1)
    taken = lambda s: F.element_at(f"{s}_before", F.array_position(f"{s}_cuts", common).cast("int"))
    spliced = F.when(F.col("whole"), F.lit(0)).when(F.size(F.array_intersect("left_cuts", "right_cuts")) > 0, taken("left") + taken("right"))
    return (seams.select(F.substring_index("seam", "/", 1).alias("key"), "n", spliced.alias("off"))
            .groupBy("key").agg(F.when(F.count("off") == F.count(F.lit(1)), F.sum("n") - F.sum("off")).alias("n_tokens")))


def token_counts(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs`` (doc_id, text).

    A missing text is empty and has no tokens.  Rows are told apart by id and digest of the text,
    so equal rows are each counted, and a repeated or missing id does no harm.  Texts over ``chunk``
    characters are encoded in overlapping chunks, each a row of its own; where two neighbours
    share no stable cut, the text is tried again with overlaps ``WIDEN`` times as wide, until one
    chunk is the whole text.
    """
    rows = documents(docs, "doc_id", "text")
    key = F.sha2("text", 256).alias("key")
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    counted = (rows.where(F.char_length("text") <= chunk).select("doc_id", "text", n_bytes)
               .mapInArrow(lambda it: count_rows(it, path), f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long"))
    long = kept(rows.where(F.char_length("text") > chunk).select("doc_id", "text", key, n_bytes, F.char_length("text").alias("n_chars")), "long-documents")
    found = None
    todo, width, wide = long.select("key", "text").dropDuplicates(["key"]), chunk, overlap
    longest = long.agg(F.max("n_chars")).first()[0]
    while longest is not None:
        got = kept(count_long(todo, path, width, wide), "token-counts")
        done = got.where(F.col("n_tokens").isNotNull())
        found = done if found is None else found.unionByName(done)
        failed = got.where(F.col("n_tokens").isNull())
        if width >= longest or failed.isEmpty():
            break
        wide = max(wide, 1) * WIDEN
        width = max(width, 4 * wide)
        todo = todo.join(failed.select("key"), "key", "left_semi")
    if found is None:
        return counted
    return counted.unionByName(long.select("doc_id", "key", "n_bytes").join(found, "key").select("doc_id", "n_bytes", "n_tokens"))
