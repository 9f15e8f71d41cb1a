"""Work on a batch of texts as one array of bytes, without a Python loop over documents or words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)
BASE = U64(0x2545F4914F6CDD1D)
BASE_INVERSE = U64(pow(int(BASE), -1, 2**64))
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of the public splitmix64 generator)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE = mix(np.arange(1, 257, dtype=U64) * STEP)


def salted(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) * STEP + U64(salt)) | U64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes one after another, and where each text begins, with the end at last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def blocks(batches: Iterable[pa.RecordBatch], text: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part has about ``most`` bytes of text, or one longer document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        _, at = text_bytes(column)
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def edges(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of ``inside``; runs don't go beyond a text's end."""
    n = len(inside)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[at[at < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[at[at > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for blocks of the usual size."""
    if len(_POWERS[0]) < n:
        made = []
        for base in (BASE, BASE_INVERSE):
            row = np.full(n, base, U64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        if n > 8_000_000:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


class Prefixes:
    """Hashes of any stretches of a sequence of small integers, from one pass over it."""

    def __init__(self, values: np.ndarray, table: np.ndarray | None = None):
        codes = (BYTE if table is None else table)[values] if table is not None or values.dtype == np.uint8 else mix(values.astype(U64) + STEP)
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * up[:-1], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(U64) * STEP)


def word_hashes(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of each word of lower-cased bytes, and the number of the first word of each text."""
    begin, end = edges(inside[raw], at)
    return Prefixes(raw).of(begin, end), begin, end, np.searchsorted(begin, at)


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after another."""
    counts = np.asarray(counts, np.int64)
    return np.arange(counts.sum(), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray | pa.Array, at: np.ndarray) -> pa.ListArray:
    """An Arrow column of lists from flat values and the place where each list begins."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))
