"""Benchmark passages in training documents, found by a positional inverted index.

The index is spread by document: each row holds a document's postings of test terms, and is
stored.  Postings that no window can use are left out: a window of w words needs w consecutive
words that all are terms of windows of that length.  Term frequencies over all stored postings
tell the rarest term of each window; its list is intersected, offset-adjusted, with those of the
next rarest terms until all agree.  The windows are the query set: they are
taken in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.arrays import LOWER, blocks, edges, lists, runs, signed, text_bytes, word_hashes
from tickerloom.llm.store import documents, kept

WIDTH = 10
BLOCK = 200_000
WORD = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signed word hashes of all texts, and the number of the first word of each: A-Z lower-cased, cut at all other ASCII but 0-9."""
    raw, at = text_bytes(column)
    words, _, _, first = word_hashes(LOWER[raw], at, WORD)
    return signed(words), first


def cut_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, "text"):
        words, first = words_of(part.column("text"))
        n = np.diff(first)
        count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        size = np.repeat(np.minimum(n, width), count)
        begin = np.repeat(first[:-1], count) + runs(count)
        row = np.repeat(np.arange(len(n)), count)
        flat = words[np.repeat(begin, size) + runs(size)]
        yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(row)), lists(flat, np.concatenate([[0], np.cumsum(size)]))], ["item_id", "terms"])


@dataclass
class Windows:
    """A block of distinct windows: places in a sorted vocabulary, and the items each belongs to."""

    vocabulary: np.ndarray
    terms: np.ndarray  # one row per window, -1 behind shorter ones
    sizes: np.ndarray
    items: np.ndarray
    item_at: np.ndarray

    @classmethod
    def of(cls, rows: list, width: int) -> "Windows":
        sizes = np.array([len(r.terms) for r in rows], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *[np.array(r.terms, np.int64) for r in rows]])
        vocabulary, place = np.unique(flat, return_inverse=True)
        terms = np.full((len(rows), width), -1, np.int64)
        terms[np.repeat(np.arange(len(rows)), sizes), runs(sizes)] = place
        return cls(vocabulary, terms, sizes, np.array([i for r in rows for i in r.items], np.int64), np.cumsum([0, *[len(r.items) for r in rows]]))

    def uses(self) -> dict[int, np.ndarray]:
        """For each window size the terms that windows of that size have."""
        out = {}
        for size in np.unique(self.sizes):
            out[int(size)] = np.zeros(len(self.vocabulary) + 1, bool)
            out[int(size)][self.terms[self.sizes == size][:, :size]] = True
        return out


def postings(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray, uses: dict[int, np.ndarray], everything: bool) -> Iterator[pa.RecordBatch]:
    """One row per document: its word count and its postings, sorted by term and position."""
    marks = np.zeros(1 << 16, bool)
    marks[vocabulary & 0xFFFF] = True
    for part in blocks(batches, "text"):
        words, first = words_of(part.column("text"))
        term = np.full(len(words), len(vocabulary), np.int64)
        maybe = np.flatnonzero(marks[words & 0xFFFF])
        place = np.searchsorted(vocabulary, words[maybe])
        same = vocabulary[np.minimum(place, len(vocabulary) - 1)] == words[maybe] if len(vocabulary) else np.zeros(0, bool)
        term[maybe[same]] = place[same]
        stay = term < len(vocabulary) if everything else np.zeros(len(words), bool)
        for size, used in uses.items():
            begin, end = edges(used[term], first)
            long = end - begin >= size
            change = np.zeros(len(words) + 1, np.int64)
            change[begin[long]] += 1
            change[end[long]] -= 1
            stay |= np.cumsum(change)[:-1] > 0
        at = np.flatnonzero(stay)
        doc = np.searchsorted(first, at, "right") - 1
        order = np.lexsort((at, term[at], doc))
        at, doc = at[order], doc[order]
        rows = np.searchsorted(doc, np.arange(len(first)))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("key"), pa.array(np.diff(first).astype(np.int64)), lists(term[at].astype(np.int32), rows), lists((at - first[doc]).astype(np.int32), rows)],
            ["doc_id", "key", "n_words", "terms", "positions"])


def flat_list(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[at[0]:at[-1]].astype(np.int64), at - at[0]


def expand(counts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each of ``counts`` entries, and the entry itself, counted from ``begins``."""
    return np.repeat(np.arange(len(counts)), counts), np.repeat(begins, counts) + runs(counts)


def search(batches: Iterator[pa.RecordBatch], windows: Windows, frequency: np.ndarray, near: int) -> Iterator[pa.RecordBatch]:
    """Items found in each document, the merged spans of words hit, and items found within ``near`` words."""
    width = windows.terms.shape[1]
    rank = np.where(windows.terms >= 0, frequency[windows.terms], np.iinfo(np.int64).max)
    order = np.argsort(rank, axis=1, kind="stable")
    possible = (rank > 0).all(axis=1)
    shift = 40
    few = 500 if near else 4000  # anchors of all common words of the windows are held at once
    for batch in (whole.slice(i, few) for whole in batches for i in range(0, whole.num_rows, few)):
        terms, at = flat_list(batch.column("terms"))
        places, _ = flat_list(batch.column("positions"))
        n_words = batch.column("n_words").to_numpy()
        gap = max(width, 2 * near + 1)
        base = np.cumsum(n_words + gap) - n_words
        place = places + np.repeat(base, np.diff(at))
        index = np.sort((terms << shift) | place)
        able = np.flatnonzero(possible)
        lead = windows.terms[able, order[able, 0]] << shift
        low, high = np.searchsorted(index, lead), np.searchsorted(index, lead + (1 << shift))
        row, entry = expand(high - low, low)
        window, anchor = able[row], index[entry] & ((1 << shift) - 1)
        start = anchor - order[window, 0]
        exact = np.arange(len(window))
        for k in range(1, width):
            offset = order[window[exact], k]
            term = windows.terms[window[exact], offset]
            key = (term << shift) | (start[exact] + offset)
            found = np.searchsorted(index, key)
            exact = exact[(term < 0) | (index[np.minimum(found, len(index) - 1)] == key)] if len(index) else exact[:0]
        doc = np.searchsorted(base, start[exact], "right") - 1
        hit_rows, hit_words = expand(windows.sizes[window[exact]], start[exact])
        hit = np.unique(hit_words)
        begin = hit[np.concatenate([[True], np.diff(hit) > 1])] if len(hit) else hit
        end = hit[np.concatenate([np.diff(hit) > 1, [True]])] + 1 if len(hit) else hit
        span_doc = np.searchsorted(base, begin, "right") - 1
        span_at = np.searchsorted(span_doc, np.arange(len(base) + 1))
        item_column, item_at = found_items(doc, window[exact], windows, len(base))
        close = np.arange(len(window)) if near else np.zeros(0, np.int64)
        for k in range(1, width if near else 0):
            term = windows.terms[window[close], order[window[close], k]]
            key = (term << shift) | np.maximum(anchor[close] - near, 0)
            found = np.searchsorted(index, key)
            close = close[(term < 0) | ((found < len(index)) & (index[np.minimum(found, len(index) - 1)] <= ((term << shift) | (anchor[close] + near))))]
        near_column, near_at = found_items(np.searchsorted(base, anchor[close], "right") - 1, window[close], windows, len(base))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), batch.column("n_words"), lists(item_column, item_at), lists((begin - base[span_doc]).astype(np.int64), span_at),
             lists((end - base[span_doc]).astype(np.int64), span_at), lists(near_column, near_at)],
            ["doc_id", "key", "n_words", "items", "begins", "ends", "near_items"])


def found_items(doc: np.ndarray, window: np.ndarray, windows: Windows, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct items of the windows found in each document."""
    seen = np.unique(np.stack([doc, window]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
    row, entry = expand(np.diff(windows.item_at)[seen[1]], windows.item_at[:-1][seen[1]])
    pairs = np.unique(np.stack([seen[0][row], windows.items[entry]]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
    return pairs[1], np.searchsorted(pairs[0], np.arange(docs + 1))


def merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        for i, (begins, ends) in enumerate(zip(rows["begins"], rows["ends"])):
            merged: list[list[int]] = []
            for a, b in sorted(zip(begins, ends)):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            rows["begins"][i], rows["ends"][i] = [a for a, _ in merged], [b for _, b in merged]
        yield pa.RecordBatch.from_pydict(rows, schema=batch.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, near: int = 0, block: int = BLOCK, keyed: bool = False) -> DataFrame:
    """(doc_id, n_words, items, begins, ends, near_items) for every row of ``docs`` (doc_id, text).

    ``benchmark`` has (item_id, text).  Its windows are ``width`` consecutive words, or all words of a
    shorter item that has any.  items are the item_ids with a window that occurs in the document, begins
    and ends the merged spans of words inside occurrences (numbered from 0, end exclusive).  With
    ``near`` > 0, near_items are those with a window of which every word stands within ``near`` words of
    its rarest one, in any order.  A missing text has no words; items without an id are left out, and rows that
    repeat an id count as one item.  Repeated documents are each answered; ``keyed`` adds a hash of the text as ``key``.  Item ids are whole numbers.
    """
    kind = dict(docs.dtypes)["doc_id"]
    windows = kept(documents(benchmark, "item_id", "text").where(F.col("item_id").isNotNull()).withColumn("item_id", F.col("item_id").cast("long"))
                   .mapInArrow(lambda it: cut_windows(it, width), "item_id long, terms array<long>").distinct(), "windows")
    parts = max(1, -(-windows.count() // block))
    rows = documents(docs, "doc_id", "text").withColumn("key", F.xxhash64("text") if keyed or parts > 1 else F.lit(0).cast("long"))
    fields = "items array<long>, begins array<long>, ends array<long>, near_items array<long>"
    found = None
    for part in range(parts):  # blocks of the query set, each of at most about ``block`` windows
        some = (windows.where(F.pmod(F.xxhash64("terms"), F.lit(parts)) == part).groupBy("terms").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
        asked = Windows.of(some.collect(), width)
        vocabulary, uses = asked.vocabulary, asked.uses()
        stored = kept(rows.mapInArrow(lambda it, v=vocabulary, u=uses: postings(it, v, u, near > 0), f"doc_id {kind}, key long, n_words long, terms array<int>, positions array<int>"), "postings")
        counts = stored.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # no more rows than the block has terms
        frequency = np.zeros(len(vocabulary) + 1, np.int64)
        for term, n in counts:
            frequency[term] = n
        got = stored.mapInArrow(lambda it, a=asked, f=frequency: search(it, a, f, near), f"doc_id {kind}, key long, n_words long, {fields}")
        found = got if found is None else found.unionByName(got)
    if parts > 1:
        every = lambda c: F.flatten(F.collect_list(c)).alias(c)
        found = (found.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), (F.count(F.lit(1)) / parts).cast("int").alias("copies"), *[every(c) for c in ("items", "begins", "ends", "near_items")])
                 .withColumns({c: F.array_sort(F.array_distinct(c)) for c in ("items", "near_items")})
                 .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies"))
        found = found.mapInArrow(merge_spans, found.schema)
    return found if keyed else found.drop("key")


def summary(found: DataFrame, *also: str) -> DataFrame:
    """Counts and a digest of the items of each document, and the columns named ``also``."""
    covered = F.aggregate(F.zip_with("ends", "begins", lambda e, b: e - b), F.lit(0).cast("long"), lambda a, x: a + x)
    named = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return (found.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"),
                         (covered > 0).alias("contaminated"), *also))
