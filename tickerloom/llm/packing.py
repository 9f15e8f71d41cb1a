"""Packing of tokenised documents into sequences of bounded length by a grouping genetic algorithm.

Items are dealt by a hash into shards of bounded size.  Each shard is evolved on several islands,
rows of one table, so that islands run side by side; after each epoch the best solution of
every island moves on to the next island of its shard.  An individual is a set of bins; the first ones are
made by best fit in disturbed orders.  Crossover injects well-filled bins of one parent whole into the other and drops the bins
that now hold an item twice; their other items fill bins better in exchange for shorter ones, and what is left goes back by best
fit.  A shard's search ends at the least number of bins that its lengths allow, or after its generations.  Poorly filled bins of all shards are dealt again and
packed together, so that a shard's remainder isn't left alone.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.arrays import blocks, lists
from tickerloom.llm.store import documents, kept
from tickerloom.llm.wordbpe import encoder

CAPACITY = 4096
END = 1
SHARD = 2048
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 16
POPULATION = 4
FULL = 0.995
TASK_ISLANDS = 128
WIDE = 24  # displaced items, and items of a bin, that swaps try in pairs

Bins = list[list[int]]


def cut_pieces(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Tokenise each document, close it with the end id, and cut what is longer than a sequence."""
    encode, end = encoder(path), np.array([END], "<u4").tobytes()
    for part in blocks(batches, "text"):
        docs, piece, start, length, crc, ids = [], [], [], [], [], []
        for row, made in enumerate(encode.ids(part.column("text").to_pylist())):
            made += end
            for k, at in enumerate(range(0, len(made), 4 * capacity)):
                some = made[at:at + 4 * capacity]
                docs.append(row)
                piece.append(k)
                start.append(at // 4)
                length.append(len(some) // 4)
                crc.append(zlib.crc32(some))
                ids.append(some if with_ids else b"")
        columns = [part.column("doc_id").take(pa.array(docs)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            columns.append(lists(flat, np.cumsum([0, *length])))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): token pieces of every document, of at most ``capacity`` ids.

    A missing text is empty and gives the end id alone.  Repeated rows give their pieces again.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return documents(docs, "doc_id", "text").mapInArrow(lambda it: cut_pieces(it, path, capacity, with_ids), schema)


# One individual.  ``sizes`` holds the length of every item of the shard.

def best_fit(items: Iterable[int], sizes: np.ndarray, capacity: int, bins: Bins, ordered: bool = False) -> Bins:
    """Put each item, longest first or in the given order, into the fullest bin that has room for it."""
    bins, of = [list(b) for b in bins], sizes.tolist()
    room = sorted((capacity - sum([of[i] for i in b]), k) for k, b in enumerate(bins))
    for item in items if ordered else sorted(items, key=of.__getitem__, reverse=True):
        size = of[item]
        at = bisect.bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([item])
            bisect.insort(room, (capacity - size, len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(item)
            bisect.insort(room, (left - size, k))
    return bins


def fitness(bins: Bins, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then more uneven filling: nearly empty bins are nearly gone."""
    of = sizes.tolist()
    return -len(bins), sum((sum([of[i] for i in b]) / capacity) ** 2 for b in bins)


def swapped(bins: Bins, displaced: list[int], sizes: np.ndarray, capacity: int) -> tuple[Bins, list[int]]:
    """Fill bins better that are not well filled: one or two items against one or two displaced ones of more length that still fit."""
    out, loose = [], list(displaced)
    ones, twos = choices(loose, sizes)
    for b in bins:
        room = capacity - int(sizes[b].sum())
        if room > (1 - FULL) * capacity and loose:
            mine_one, mine_two = choices(b, sizes)
            mine = np.concatenate([mine_one[0], mine_two[0]])
            best = (0, None, None)
            for sums, who in (ones, twos):
                if len(sums):
                    at = np.searchsorted(sums, mine + room, side="right") - 1
                    gain = np.where(at >= 0, sums[at] - mine, 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (int(gain[k]), (mine_one[1] + mine_two[1])[k], who[int(at[k])])
            if best[0]:
                _, go, come = best
                b = [i for i in b if i not in go] + list(come)
                loose = [i for i in loose if i not in come] + list(go)
                ones, twos = choices(loose, sizes)
        out.append(b)
    return out, loose


def choices(items: list[int], sizes: np.ndarray) -> tuple[tuple[np.ndarray, list[tuple[int, ...]]], tuple[np.ndarray, list[tuple[int, ...]]]]:
    """Single items and pairs of the ``WIDE`` longest, each by rising length."""
    items = np.array(items, np.int64)
    items = items[np.argsort(sizes[items], kind="stable")]
    few = items[-WIDE:]
    a, b = np.triu_indices(len(few), 1)
    sums = sizes[few[a]] + sizes[few[b]]
    order = np.argsort(sums, kind="stable")
    return (sizes[items], [(i,) for i in items.tolist()]), (sums[order], list(zip(few[a][order].tolist(), few[b][order].tolist())))


def crossover(one: Bins, other: Bins, sizes: np.ndarray, capacity: int, chance: random.Random) -> tuple[Bins, list[int]]:
    """Inject well-filled bins of ``other`` into ``one`` and drop bins that repeat an item; what they held besides is displaced."""
    good = [b for b in other if sizes[b].sum() >= FULL * capacity] or other
    injected = chance.sample(good, max(1, len(good) // chance.randint(2, 4)))
    held = {i for b in injected for i in b}
    stay, displaced = [], []
    for b in one:
        if held.isdisjoint(b):
            stay.append(b)
        else:
            displaced += [i for i in b if i not in held]
    return injected + stay, displaced


def mutate(bins: Bins, displaced: list[int], sizes: np.ndarray, capacity: int, chance: random.Random) -> tuple[Bins, list[int]]:
    """Dissolve the emptiest bins and a few others."""
    order = sorted(range(len(bins)), key=lambda k: int(sizes[bins[k]].sum()))
    gone = set(order[:max(1, len(order) // 20)]) | set(chance.sample(order, min(2, len(order))))
    return [b for k, b in enumerate(bins) if k not in gone], displaced + [i for k in gone for i in bins[k]]


def child_of(one: Bins, other: Bins, sizes: np.ndarray, capacity: int, chance: random.Random) -> Bins:
    """Crossover, mutation, and best fit for what is displaced; where that doesn't reach the bound, swaps come before it."""
    bins, displaced = mutate(*crossover(one, other, sizes, capacity, chance), sizes, capacity, chance)
    fitted = best_fit(displaced, sizes, capacity, bins)
    if len(fitted) <= bound(sizes, capacity):
        return fitted
    bins, displaced = swapped(bins, displaced, sizes, capacity)
    return best_fit(displaced, sizes, capacity, bins)


def bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: all tokens, or the items of which no two fit together."""
    return max(-(-int(sizes.sum()) // capacity), int((sizes * 2 > capacity).sum()))


def evolve(population: list[Bins], sizes: np.ndarray, capacity: int, generations: int, chance: random.Random) -> tuple[list[Bins], int]:
    """One island, best individual first, and how many generations ran; it stops when no better one can exist."""
    score = lambda b: fitness(b, sizes, capacity)
    population = sorted(population, key=score, reverse=True)
    for ran in range(generations):
        if len(population[0]) <= bound(sizes, capacity):
            return population, ran
        one, other = chance.sample(population, 2) if len(population) > 1 else population * 2
        child = child_of(one, other, sizes, capacity, chance)
        population = sorted([*population, child], key=score, reverse=True)[:len(population)]
    return population, generations


def first(sizes: np.ndarray, capacity: int, count: int, chance: random.Random) -> list[Bins]:
    """Best fit of items that come in disturbed orders: by length, each length being off by up to a half."""
    made = []
    for _ in range(count):
        off = {i: int(sizes[i]) * chance.uniform(0.5, 1.5) for i in range(len(sizes))}
        made.append(best_fit(sorted(off, key=off.get, reverse=True), sizes, capacity, [], ordered=True))
    return made


def flat(bins: Bins) -> np.ndarray:
    of = np.zeros(sum(map(len, bins)), np.int32)
    for k, b in enumerate(bins):
        of[b] = k
    return of


def grouped(of: np.ndarray) -> Bins:
    order = np.argsort(of, kind="stable")
    return [list(map(int, x)) for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)] if len(of) else []


SEARCH = ("generations", "bins_first", "bins")  # what a shard's search tells
ISLAND = "shard long, island int, lengths array<int>, solutions array<array<int>>, generations int, bins_first int"


def island_epoch(frames: Iterator[pd.DataFrame], capacity: int, generations: int, count: int, epoch: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out, ran, started = [], [], []
        for row in frame.itertuples():
            sizes = np.asarray(row.lengths, np.int64)
            chance = random.Random(f"{row.shard}/{row.island}/{epoch}")
            population = [grouped(np.asarray(s)) for s in row.solutions] or first(sizes, capacity, count, chance)
            started.append(min(map(len, population)) if epoch == 0 else row.bins_first)
            population, some = evolve(population, sizes, capacity, generations, chance)
            out.append([flat(b) for b in population])
            ran.append(row.generations + some)
        yield frame.assign(solutions=out, generations=np.array(ran, np.int32), bins_first=np.array(started, np.int32))


def evolve_shards(shards: DataFrame, count_of: int, capacity: int, islands: int, epochs: int, generations: int, count: int) -> DataFrame:
    """(shard, best array<int>, generations, bins_first, bins) for ``count_of`` rows of (shard, lengths).

    ``best`` has the bin of every item in the best individual of all islands, ``generations`` how many ran on
    them together, ``bins_first`` the fewest bins of an individual before the first one.
    After each epoch the best individual of an island joins the next island of the ring.  The islands are dealt to a stated
    number of tasks: their rows are few and short, so adaptive execution would bring all of them into one.
    """
    tasks = max(1, min(count_of * islands, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-count_of * islands // TASK_ISLANDS))
    zero = F.lit(0).alias
    table = (shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths",
                           F.array().cast("array<array<int>>").alias("solutions"), zero("generations"), zero("bins_first")))
    for epoch in range(epochs):
        dealt = table.repartition(tasks, "shard", "island")
        table = kept(dealt.mapInPandas(lambda it, e=epoch: island_epoch(it, capacity, generations, count, e), ISLAND), "islands")
        if epoch + 1 < epochs:
            elite = table.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("solutions")[0].alias("elite"))
            table = (table.join(elite, ["shard", "island"])
                     .withColumn("solutions", F.array_distinct(F.concat(F.array("elite"), "solutions"))).drop("elite"))
    best = F.col("solutions")[0]
    filled = F.struct((-F.array_max(best)).alias("fewer"), (-F.col("island")).alias("island"), best.alias("best"))
    return (table.groupBy("shard").agg(F.max(filled).alias("top"), F.sum("generations").alias("generations"), F.min("bins_first").alias("bins_first"))
            .select("shard", "top.best", "generations", "bins_first", (1 - F.col("top.fewer")).alias("bins")))


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS,
         generations: int = GENERATIONS, count: int = POPULATION) -> DataFrame:
    """Every row of ``items`` (any columns, and ``length``) with its sequence_id and offset, and what the search of its shard did:
    ``generations`` run, the fewest ``bins_first`` that it started from, and its ``bins`` in the end.

    Items as long as a sequence are one alone.  The others are dealt to shards of about ``shard`` items
    by a hash of their place in the table, so that no id, source or repeated row gathers in one.  Bins under ``FULL`` are dissolved once
    and their items packed again, in shards of their own.  Equal rows are separate items.
    Items may not be longer than ``capacity``.
    """
    rows = kept(items, "items")
    names = rows.columns
    whole = rows.where(F.col("length") >= capacity)
    rest, placed = rows.where(F.col("length") < capacity), None
    for level in range(2):
        n = max(1, round(rest.count() / shard))
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64(F.lit(level), F.monotonically_increasing_id()), F.lit(n)) * 2 + level)
        ordered = F.array_sort(F.collect_list(F.struct("length", *[c for c in names if c != "length"])))
        shards = kept(dealt.groupBy("shard").agg(ordered.alias("items")), "shards")
        lengths = shards.select("shard", F.col("items.length").cast("array<int>").alias("lengths"))
        best = evolve_shards(lengths, shards.count(), capacity, islands, epochs, generations, count)
        bins = (shards.join(best, "shard").select("shard", *SEARCH, F.explode(F.arrays_zip("items", "best")).alias("x"))
                .groupBy("shard", F.col("x.best").alias("bin"))
                .agg(F.array_sort(F.collect_list("x.items")).alias("items"), *[F.first(c).alias(c) for c in SEARCH])
                .withColumn("filled", F.aggregate("items.length", F.lit(0).cast("long"), lambda a, x: a + x)))
        bins = kept(bins, "bins") if level == 0 else bins
        done = bins.where(F.col("filled") >= FULL * capacity) if level == 0 else bins
        placed = done if placed is None else placed.unionByName(done)
        if level == 0:
            rest = bins.where(F.col("filled") < FULL * capacity).select(F.explode("items").alias("x")).select(*[F.col("x")[c].alias(c) for c in names])
    ends = F.transform("items", lambda x, i: F.struct(x.alias("item"), F.aggregate(F.slice("items", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["length"]).alias("offset")))
    in_bins = (placed.select((F.col("shard") * 2**20 + F.col("bin")).alias("sequence_id"), *SEARCH, F.explode(ends).alias("x"))
               .select(*[F.col("x.item")[c].alias(c) for c in names], "sequence_id", F.col("x.offset").alias("offset"), *SEARCH))
    alone = whole.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                         F.lit(0).cast("long").alias("generations"), F.lit(1).alias("bins_first"), F.lit(1).alias("bins"))
    return in_bins.unionByName(alone)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
