"""Toxicity scores from the nearest labelled examples by exact cosine of TF-IDF vectors.

Terms are whole words and word beginnings of 4 to 6 bytes, as insults are inflected.  Every term of a text
weighs in: those of a bounded sample of labelled rows make the vocabulary, with document frequencies counted over
all documents, and a term that no example has counts in the length of a text's vector.  A weight grows with how
far the term leans towards label 1 in the sample, but no term is dropped.  The sample is the bank of examples, an
inverted index: lists of the commonest terms are stored in blocks with their largest weights, and a block that can't
hold a nearer example than those found is not read; the other lists are short and read whole.  In the blocks that are read the
lists that weigh most come first, and the others only for examples that can still be near by the length of what they leave.
The result is exact.  Neighbours
vote with weights that fall with their distance, and a monotone curve fitted by leaving each example out
turns votes into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.arrays import LOWER, STEP, Prefixes, blocks, edges, lists, mix, signed, text_bytes
from tickerloom.llm.store import documents, folder, kept, labelled_sample

SAMPLE = 12_000
SAMPLE_BYTES = 100_000
NEIGHBOURS = 15
DENSE = 2048
HEAVY = 768  # of those lists
ALIKE = 64
BLOCK = 64  # examples
FIRST = 2  # blocks that are read before the bounds decide
TOGETHER = 128
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6)
INSIDE = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct terms (signed hashes) of all texts, and (text, number of the term, times) of each term of a text, sorted.

    The beginnings of a word are looked up once, however often it stands there.
    """
    raw, at = text_bytes(column)
    low = LOWER[raw]
    begin, end = edges(INSIDE[low], at)
    table = Prefixes(low)
    doc = np.searchsorted(at, begin, "right") - 1
    words, word = np.unique(table.of(begin, end), return_inverse=True)
    some = np.empty(len(words), np.int64)
    some[word] = np.arange(len(word))
    begin, end = begin[some], end[some]
    hashes, owners = [words], [np.arange(len(words))]
    for n in BEGINNINGS:
        long = np.flatnonzero(end - begin > n)
        hashes.append(mix(table.of(begin[long], begin[long] + n) + STEP))
        owners.append(long)
    found, place = np.unique(signed(np.concatenate(hashes)), return_inverse=True)
    number = np.full((len(owners), len(words)), -1)
    for row, owner, some in zip(number, owners, np.split(place, np.cumsum([*map(len, owners)])[:-1])):
        row[owner] = some
    terms = number[:, word]
    cell, times = np.unique((doc * len(found) + terms)[terms >= 0], return_counts=True)
    return found, cell // max(len(found), 1), cell % max(len(found), 1), times


def label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each term of a task's texts: in how many texts it stands, by label."""
    for part in blocks(batches, "text", 4_000_000):
        found, doc, place, _ = term_counts(part.column("text"))
        label = part.column("label").to_numpy()[doc]
        yield pa.RecordBatch.from_pydict({"term": found, "ones": np.bincount(place, label == 1, len(found)).astype(np.int64), "zeros": np.bincount(place, label == 0, len(found)).astype(np.int64)})


def leaning(ones: np.ndarray, zeros: np.ndarray, rate: float) -> np.ndarray:
    """A factor of at least 1 for each term: 1 + its log-likelihood ratio against the common rate of label 1, and 1 for terms that lean to label 0."""
    n = ones + zeros
    if not 0 < rate < 1:
        return np.ones(len(n))
    ratio = 2 * sum(x * np.log(np.maximum(x, 1) / (n * r)) for x, r in ((ones, rate), (zeros, 1 - rate)))
    return np.where(ones > n * rate, 1 + np.maximum(ratio, 0), 1.0)


@dataclass
class Vocabulary:
    """Sorted term hashes, the factor of each, and that of a term that isn't there."""

    hashes: np.ndarray
    factor: np.ndarray
    other: float = 1.0

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term number, times) of every term, sorted by text; a term outside the vocabulary has the number -1."""
        found, doc, place, times = term_counts(column)
        number = np.searchsorted(self.hashes, found)
        known = np.append(self.hashes, 0)[number] == found
        known &= number < len(self.hashes)
        return doc, np.where(known, number, -1)[place], times

    def vectors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors without their unknown terms, which count in the norm: first entry of each text, term numbers, weights."""
        doc, term, times = self.find(column)
        weight = (1 + np.log(times)) * np.append(self.factor, self.other)[term]
        norm = np.sqrt(np.bincount(doc, weight**2, len(column)))
        known = term >= 0
        doc, term, weight = doc[known], term[known], weight[known]
        return np.searchsorted(doc, np.arange(len(column) + 1)), term, weight / norm[doc]


def stretches(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of stretches of an array, one stretch after another."""
    ends = np.cumsum(counts)
    places = np.repeat(begins - ends + counts, counts)
    places += np.arange(len(places))
    return places


def document_counts(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros(len(vocabulary.hashes) + 1, np.int64), 0
    for part in blocks(batches, "text"):
        _, term, _ = vocabulary.find(part.column("text"))
        counts += np.bincount(term + 1, minlength=len(counts))
        rows += part.num_rows
    some = np.flatnonzero(counts[1:])
    yield pa.RecordBatch.from_pydict({"term": np.append(some, -1).astype(np.int32), "n": np.append(counts[1:][some], rows).astype(np.int64)})


def cosines(weights: np.ndarray, rows: np.ndarray, columns: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Products of some rows with a query that has only some columns, each summed in the same order."""
    return (weights.ravel().take(rows[:, None] * weights.shape[1] + columns) * query).sum(1)


class Bank:
    """Labelled examples as an inverted index.

    Alike examples stand next to each other, in blocks of BLOCK.  The longest lists, those of the terms that stand in the most
    examples, have the largest weight of each block; of a block nothing is read when that bound, together with
    the other terms, can't reach the neighbours found so far.  Of the blocks that are read, the lists that weigh most (heavy) are read whole.
    Of the others (light) each example has the length of that part of its vector: by Cauchy and Schwarz it bounds what the light terms add, and they are
    read only for an example that can still be among the nearest.  Neither ids nor labels choose between equal cosines, but hashes of the texts.
    """

    def __init__(self, at: np.ndarray, term: np.ndarray, weight: np.ndarray, labels: np.ndarray, ids: np.ndarray, hashes: np.ndarray, n_terms: int, number: np.ndarray | None = None):
        self.n = n = len(labels)
        counts = np.bincount(term, minlength=n_terms)
        columns = np.argsort(-counts, kind="stable")[:DENSE]
        self.column = np.full(max(n_terms, 1), -1, np.int32)
        self.column[columns] = np.arange(len(columns))
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
        often = (self.column >= 0)[term]
        rare_term, rare_row, rare_weight = (x[~often] for x in (term, row, weight))
        term, row, weight = term[often], row[often], weight[often].astype(np.float32)
        # The commonest terms tell languages and kinds of text apart.
        most = self.column[term] < ALIKE
        rough = np.zeros((n, ALIKE), np.float32)
        rough[row[most], self.column[term[most]]] = weight[most]
        order = np.lexsort((labels, hashes, rough.argmax(1) if n else np.zeros(0)))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        self.labels, self.ids = labels[order], ids[order]
        self.place = {int(k): int(v) for k, v in zip(number, place)} if number is not None else {}
        self.groups = -(-n // BLOCK)
        mass = np.bincount(self.column[term], weight.astype(float) ** 2, len(columns))
        columns = columns[np.argsort(-mass, kind="stable")]
        self.column[columns] = np.arange(len(columns))
        there, column = place[row], self.column[term]
        self.largest = np.zeros((len(columns), self.groups), np.float32)
        np.maximum.at(self.largest, (column, there // BLOCK), weight)
        self.heavy, self.light = (np.zeros((self.groups * BLOCK, len(part)), np.float32) for part in np.split(columns, [HEAVY]))
        heavy = column < HEAVY
        self.heavy[there[heavy], column[heavy]] = weight[heavy]
        self.light[there[~heavy], column[~heavy] - HEAVY] = weight[~heavy]
        self.light_length = np.sqrt(np.bincount(there[~heavy], weight[~heavy].astype(float) ** 2, self.groups * BLOCK)).astype(np.float32)
        del term, row, weight, there, column, heavy, most, often, rough
        self.term_at = np.concatenate([[0], np.cumsum(np.bincount(rare_term, minlength=n_terms))])
        by_term = np.argsort(rare_term, kind="stable")
        del rare_term
        # An entry is a number and a weight side by side, so that a list is read once.
        self.entry = np.empty((len(by_term), 2), np.int32)
        self.entry[:, 0] = place[rare_row[by_term]]
        self.entry[:, 1] = rare_weight[by_term].astype(np.float32).view(np.int32)
        self.entry = self.entry.view(np.int64).ravel()
        self.read = self.bounded = 0

    def rest(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What the terms that have short lists add to the cosine with each example."""
        begins = self.term_at[term]
        counts = self.term_at[term + 1] - begins
        entry = self.entry[stretches(begins, counts)]
        factor = np.repeat(weight, counts)
        factor *= entry.view(np.float32)[1::2]
        return np.bincount(entry.view(np.int32)[0::2], factor, self.groups * BLOCK)

    def all_nearest(self, at: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of the texts the ``k`` examples with the largest cosine above 0, ties by their place in the bank."""
        heavy = self.heavy.shape[1]
        for first in range(0, len(at) - 1, TOGETHER):
            last = min(first + TOGETHER, len(at) - 1)
            if not self.n:
                yield from [(np.zeros(0, np.int64), np.zeros(0))] * (last - first)
                continue
            mine = slice(at[first], at[last])
            doc = np.repeat(np.arange(last - first), np.diff(at[first:last + 1]))
            here = self.column[term[mine]]
            often = here >= 0
            exact = np.zeros((last - first, len(self.largest)))
            exact[doc[often], here[often]] = weight[mine][often]
            query = exact.astype(np.float32)
            length = np.sqrt((query[:, heavy:] ** 2).sum(1))
            asked, factor, rare_at = term[mine][~often], weight[mine][~often], np.searchsorted(doc[~often], np.arange(last - first + 1))
            rest = np.array([self.rest(asked[a:b], factor[a:b]) for a, b in zip(rare_at[:-1], rare_at[1:])])
            bound = query[:, :heavy] @ self.largest[:heavy] + rest.reshape(last - first, self.groups, BLOCK).max(2)
            bound += np.minimum(query[:, heavy:] @ self.largest[heavy:], length[:, None] * self.light_length.reshape(self.groups, BLOCK).max(1))
            # Sums without the light terms, which are lower bounds.
            sums = np.full(rest.shape, -9.0, np.float32)
            front, others = np.ascontiguousarray(query[:, :heavy]), rest.astype(np.float32)
            least = np.zeros(last - first)
            open_blocks = np.zeros(bound.shape, bool)
            likely = np.argsort(-bound, axis=1)[:, :FIRST]
            np.put_along_axis(open_blocks, likely, True, 1)
            done = np.zeros(bound.shape, bool)
            for turn in range(2):
                for b in np.flatnonzero(open_blocks.any(0)):
                    asking = np.flatnonzero(open_blocks[:, b])
                    here_at = slice(b * BLOCK, (b + 1) * BLOCK)
                    sums[asking, here_at] = front[asking] @ self.heavy[here_at].T + others[asking, here_at]
                done |= open_blocks
                if without is not None:
                    sums[np.arange(last - first), without[first:last]] = -9.0
                if turn == 0:
                    seen = np.take_along_axis(sums.reshape(bound.shape + (BLOCK,)), likely[:, :, None], 1).reshape(last - first, -1)
                    least = np.maximum(np.partition(seen, max(seen.shape[1] - k, 0), axis=1)[:, max(seen.shape[1] - k, 0)], 0) if seen.shape[1] >= k else least
                    open_blocks = (bound >= least[:, None] - 1e-4) & (bound > 0) & ~done
            self.read += int(done.sum())
            self.bounded += done.size
            for i, mine in enumerate(sums):
                # Single precision chooses with some to spare, double precision decides.
                floor, above = least[i], mine[mine > least[i]]
                if len(above) > k:
                    floor = np.partition(above, len(above) - k)[len(above) - k]
                best = np.flatnonzero(mine + length[i] * self.light_length > max(floor - 1e-4, 0))
                own = heavy + np.flatnonzero(query[i, heavy:])
                light = cosines(self.light, best, own - heavy, exact[i, own])
                total = mine[best] + light
                near = total > 0
                if len(best) > k:
                    near &= total >= np.partition(total, len(best) - k)[len(best) - k] - 1e-4
                best = best[near]
                own = np.flatnonzero(query[i, :heavy])
                total = rest[i][best] + light[near] + cosines(self.heavy, best, own, exact[i, own])
                top = np.lexsort((best, -total))[:k]
                yield best[top], total[top]

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The same for one text."""
        return next(self.all_nearest(np.array([0, len(term)]), term, weight, k, None if without < 0 else np.array([without])))


_OPENED: dict[str, Bank] = {}


@dataclass
class Examples:
    """Where the examples' vectors are stored, and what their votes have taught."""

    path: str
    n_terms: int
    prior: float
    plain: float = 0.0
    curve: tuple = ((0.0, 1.0), (0.0, 1.0))

    def open(self) -> Bank:
        """The bank, made from the stored vectors once in a worker."""
        if self.path not in _OPENED:
            _OPENED.clear()
            where, root = pafs.FileSystem.from_uri(self.path)
            stored = pq.read_table(root, filesystem=where, columns=["doc_id", "label", "hash", "number", "terms", "weights"])
            sizes = pc.list_value_length(stored.column("terms")).to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            term, weight = (pc.list_flatten(stored.column(c)).to_numpy() for c in ("terms", "weights"))
            ids, label, hashes, number = (stored.column(c).fill_null(-1).to_numpy() for c in ("doc_id", "label", "hash", "number"))
            # The index is made from copies of what it needs, so the table's memory can go.
            del stored
            pa.default_memory_pool().release_unused()
            _OPENED[self.path] = Bank(at, term, weight, label.astype(float), ids, hashes, self.n_terms, number)
        return _OPENED[self.path]

    def vote(self, labels: np.ndarray, scores: np.ndarray) -> float:
        """Weighted share of label 1, with one vote of the prior; neighbours at an angle count less."""
        weight = 1 / (1.05 - np.minimum(scores, 1))
        return float((weight @ labels + self.prior) / (weight.sum() + 1))

    def calibrate(self, votes: np.ndarray, truth: np.ndarray) -> None:
        """Pool adjacent violators on votes for examples that were left out themselves."""
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # sum, size, lowest and highest vote
        for v, y in zip(votes[order], truth[order]):
            pools.append([float(y), 1.0, float(v), float(v)])
            while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
                y2, n2, _, high = pools.pop()
                pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2, pools[-1][2], high]
        xs = np.array([x for _, _, low, high in pools for x in (low, high)])
        ys = np.array([v for y, n, _, _ in pools for v in [(y + 0.5 * self.prior) / (n + 0.5)] * 2])
        self.curve = (xs, np.maximum.accumulate(ys))

    def score(self, vote: float) -> float:
        # A small part of the vote itself keeps the order inside flat stretches.
        return float(0.98 * np.interp(vote, *self.curve) + 0.02 * vote)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, k: int = NEIGHBOURS, sample_bytes: int = SAMPLE_BYTES) -> tuple[Vocabulary, Examples]:
    """Vocabulary and examples from at most ``sample`` documents of ``docs`` (doc_id, text) with a ``label`` (0/1) in ``labels``, of at most
    ``sample_bytes`` bytes each, and the statistics of all ``docs``.

    What reaches the driver are the sample's distinct terms and a vote per example.  The examples' vectors stay in the shared
    folder, from which the workers make the index.  Ids that aren't whole numbers are shown as missing in the evidence.
    """
    spark = docs.sparkSession
    chosen = labelled_sample(docs, labels, label, sample, sample_bytes).withColumn("doc_id", F.col("doc_id").try_cast("long"))
    bank_rows = kept(chosen.repartition(spark.sparkContext.defaultParallelism), "labelled")
    rate = bank_rows.agg(F.avg("label")).first()[0] or 0.0
    counted = (bank_rows.select("text", F.col("label").cast("long").alias("label")).mapInArrow(label_counts, "term long, ones long, zeros long")
               .groupBy("term").agg(F.sum("ones").cast("int").alias("ones"), F.sum("zeros").cast("int").alias("zeros")).toArrow())
    hashes, ones, zeros = (counted.column(c).to_numpy() for c in ("term", "ones", "zeros"))
    order = np.argsort(hashes)
    vocabulary = Vocabulary(hashes[order], np.ones(len(order)))
    counts = documents(docs, "text").mapInArrow(lambda it, v=vocabulary: document_counts(it, v), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    # The first place is that of the number -1, under which all rows are counted.
    frequency = np.zeros(len(order) + 1)
    frequency[counts.column("term").to_numpy() + 1] = counts.column("n").to_numpy()
    vocabulary.factor = (np.log((1 + frequency[0]) / (1 + frequency[1:])) + 1) * leaning(ones[order].astype(float), zeros[order].astype(float), rate)
    vocabulary.other = float(np.log((1 + frequency[0]) / 2) + 1)
    del counted, counts, hashes, ones, zeros, order, frequency
    numbered = bank_rows.select("doc_id", "text", "label", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("number"))
    path = folder(spark, "examples")
    fields = "doc_id long, label int, hash long, number long, terms array<int>, weights array<float>"
    numbered.mapInArrow(lambda it, v=vocabulary: example_vectors(it, v), fields).write.parquet(path)
    examples = Examples(path, len(vocabulary.hashes), float(rate))
    left_out = spark.read.schema(fields).parquet(path).mapInArrow(lambda it, e=examples: left_out_votes(it, e, k), "vote double, label double, clean boolean, bare boolean").toArrow()
    vote, truth, clean, bare = (left_out.column(c).to_numpy() for c in ("vote", "label", "clean", "bare"))
    voted = ~np.isnan(vote.astype(float))
    examples.plain = float(truth[bare].mean()) if bare.any() else float((truth[clean].sum() + examples.prior) / (clean.sum() + 1))
    if voted.any():
        examples.calibrate(vote[voted].astype(float), truth[voted])
    return vocabulary, examples


def left_out_votes(batches: Iterator[pa.RecordBatch], examples: Examples, k: int) -> Iterator[pa.RecordBatch]:
    """What the others' votes say of each example; whether its neighbours all have label 0, and whether it has no term."""
    bank = examples.open()
    for batch in batches:
        for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            sizes = pc.list_value_length(part.column("terms")).to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            term, weight = (pc.list_flatten(part.column(c)).to_numpy() for c in ("terms", "weights"))
            own = np.array([bank.place[n] for n in part.column("number").to_pylist()], np.int64)
            votes, clean = [], []
            for best, scores in bank.all_nearest(at, term, weight, k, own):
                votes.append(examples.vote(bank.labels[best], scores) if len(best) else np.nan)
                clean.append(bool(len(best)) and not bank.labels[best].any())
            yield pa.RecordBatch.from_pydict({"vote": np.array(votes, float), "label": part.column("label").to_numpy().astype(float), "clean": np.array(clean, bool), "bare": sizes == 0})


def example_vectors(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, "text"):
        at, term, weight = vocabulary.vectors(part.column("text"))
        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "label", "hash", "number")], lists(term.astype(np.int32), at), lists(weight.astype(np.float32), at)],
                                         ["doc_id", "label", "hash", "number", "terms", "weights"])


def vote_batches(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, examples: Examples, k: int) -> Iterator[pa.RecordBatch]:
    bank = examples.open()
    for part in blocks(batches, "text"):
        at, term, weight = vocabulary.vectors(part.column("text"))
        scores, evidence, cosines = np.full(part.num_rows, examples.plain), [], []
        for i, (best, near) in enumerate(bank.all_nearest(at, term, weight, k)):
            if len(best):
                scores[i] = examples.score(examples.vote(bank.labels[best], near))
            evidence.append(bank.ids[best])
            cosines.append(near)
        ends = np.cumsum([0, *map(len, evidence)])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.clip(scores, 0, 1)), lists(np.concatenate([np.zeros(0, np.int64), *evidence]), ends), lists(np.concatenate([np.zeros(0), *cosines]), ends)],
                                         ["doc_id", "score", "evidence", "cosines"])


def toxicity(docs: DataFrame, vocabulary: Vocabulary, examples: Examples, k: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, score, evidence, cosines) for every row of ``docs`` (doc_id, text).

    evidence are the doc_ids of the nearest examples, nearest first.  A term outside the vocabulary, which no
    example has, weighs in the length of a vector as one that a single document has.  A text with such terms alone, a missing
    or empty one among them, has no neighbour and gets the rate of label 1 among examples without a term, or else
    among those whose neighbours all have label 0.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return documents(docs, "doc_id", "text").mapInArrow(lambda it: vote_batches(it, vocabulary, examples, k), f"doc_id {kind}, score double, evidence array<long>, cosines array<double>")
