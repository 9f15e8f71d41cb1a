"""Groups of near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

SuperMinHash gives every element the ranks of one random permutation of the slots, so that a
document's elements fill the slots evenly and its work ends as soon as no later rank can lower any slot.
Documents with equal sets of shingles are one class from the start.  Classes that share a band
are compared by their signatures; pairs whose signatures agree far too rarely cannot be links.  Every other
pair counts only after both full sets were intersected, each class's most alike partners first:
pairs that links already join by another way need no test, so a large group is not paired with
itself, and no pair that could still join two groups is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.arrays import LOWER, STEP, U64, WHITE, blocks, lists, mix, runs, salted, signed, text_bytes, word_hashes
from tickerloom.llm.components import components
from tickerloom.llm.store import documents, kept

SLOTS = 128
ROWS = 4
SMALL = 9
LARGE = 4096
LOAD = 2_000_000
FIRST_TURN = 4
EMPTY = np.uint64(2**64 - 1)


def shingles(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: words between ASCII white space, A-Z lower-cased."""
    raw, at = text_bytes(column)
    words, _, _, first = word_hashes(LOWER[raw], at, ~WHITE)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.repeat(first[:-1], count) + runs(count)
    end = np.repeat(first[1:], count)
    total = np.repeat(np.where(n < width, n, width), count).astype(U64) * STEP
    for j, factor in enumerate(salted(width, 3)):
        there = begin + j < end
        total[there] += words[begin[there] + j] * factor
    total = mix(total)
    ends = np.concatenate([[0], np.cumsum(count)])
    return [np.unique(total[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set, a row of ``slots`` values; the row of an empty set stays ``EMPTY``.

    In turn ``j`` every element places the value ``j + r`` into the j-th slot of its own random permutation.
    The permutation is followed back through the exchanges made so far instead of being stored.
    """
    table = np.full((len(sets), slots), EMPTY, U64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(doc):
        return table
    element = np.concatenate(sets)
    swaps: list[np.ndarray] = []
    for j in range(slots):
        x = mix(element + U64((j + 1) * int(STEP) % 2**64))
        picked = (j + (((x & U64(0xFFFFFFFF)) * U64(slots - j)) >> U64(32)).astype(np.int64)).astype(np.int16)
        slot = picked.copy()
        for t in range(j - 1, -1, -1):
            slot[slot == swaps[t]] = t
        swaps.append(picked)
        np.minimum.at(table.reshape(-1), doc * slots + slot, U64(j << 32) | (x >> U64(32)))
        open_docs = table.max(axis=1) >= U64((j + 1) << 32)
        stay = open_docs[doc]
        if not stay.any():
            break
        if not stay.all():
            doc, element, swaps = doc[stay], element[stay], [s[stay] for s in swaps]
    return table


def band_keys(table: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each group of ``rows`` slots, distinct between groups."""
    bands = table.shape[1] // rows
    cut = table[:, :bands * rows].reshape(len(table), bands, rows)
    return mix((cut * salted(rows, 5)).sum(axis=2, dtype=U64) + salted(bands, 6))


def node_of(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def sign(batches: Iterator[pa.RecordBatch], width: int, slots: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Size, class and band keys of each text."""
    for part in blocks(batches, "text", 1_000_000):
        sets = shingles(part.column("text"), width)
        keys = signed(band_keys(signatures(sets, slots), rows))
        n = np.array([len(s) for s in sets], np.int64)
        at = np.concatenate([[0], np.cumsum(np.where(n > 0, keys.shape[1], 0))])
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_key"), pa.array(n), pa.array([node_of(s) for s in sets], pa.int64()), lists(keys[n > 0].reshape(-1), at)],
            ["doc_id", "text_key", "n_shingles", "node", "bands"])


def full_sets(batches: Iterator[pa.RecordBatch], width: int, slots: int) -> Iterator[pa.RecordBatch]:
    """All elements and the signature, a byte per slot, of the classes asked for."""
    for part in blocks(batches, "text", 1_000_000):
        sets = shingles(part.column("text"), width)
        nodes = np.array([node_of(s) for s in sets], np.int64)
        same = np.flatnonzero(nodes == part.column("node").to_numpy())
        table = (mix(signatures([sets[i] for i in same], slots)) >> U64(56)).astype(np.uint8)
        at = np.cumsum([0, *[len(sets[i]) for i in same]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[same]), lists(signed(np.concatenate([np.zeros(0, U64), *[sets[i] for i in same]])), at), pa.array([row.tobytes() for row in table], pa.binary())],
            ["node", "elements", "signature"])


def distances(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, center, linked): the verdict on each pair, from both full sets."""
    one = sets.select("node", F.col("elements").alias("one"))
    other = sets.select(F.col("node").alias("center"), F.col("elements").alias("other"))
    both = F.size(F.array_intersect("one", "other")).cast("long")
    return (pairs.join(one, "node").join(other, "center")
            .select("node", "center", both.alias("both"), (F.size("one") + F.size("other") - both).alias("any"))
            .select("node", "center", (100 * F.col("both") >= percent * F.col("any")).alias("linked")))


def least_agreement(slots: int, percent: int) -> int:
    """Slots in which a link's signatures agree at least, six standard deviations below the mean."""
    share = percent / 100
    return int(slots * share - 6 * (slots * share * (1 - share)) ** 0.5)


def by_key(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Rows sorted by key as columns and a table of signatures, cut where a key ends; lists of elements stay lists."""
    held = None
    for whole in batches:
        for batch in (whole.slice(i, 20_000) for i in range(0, whole.num_rows, 20_000)):
            table = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            got = [batch.column(c).to_numpy(zero_copy_only=False) for c in names] + [table]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got)]
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield [c[:cut] for c in held]
                held = [c[cut:] for c in held]
    if held is not None:
        yield held


def apart(half: np.ndarray, one, other) -> np.ndarray:
    """Whether two rows of a group are to be compared: not within the same numbered part."""
    return (half[one] != half[other]) | (half[other] < 0)


def alike(batches: Iterator[pa.RecordBatch], least: int, most: int, few: int) -> Iterator[pa.RecordBatch]:
    """Pairs (node, center) under a common key that may be links, from rows sorted by key.

    Groups of up to ``few`` give all of them; of a larger one each node gives its ``most`` most alike partners.
    """
    for key, node, half, table in by_key(batches, ("key", "node", "half")):
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begin, len(key)))
        every, found = np.arange(len(key)), [(node[:0], node[:0])]
        for d in range(1, min(few, int(size.max()))):
            i = every[:-d][(key[d:] == key[:-d]) & apart(half, every[:-d], every[d:]) & np.repeat(size <= few, size)[d:]]
            for part in (i[k:k + 50_000] for k in range(0, len(i), 50_000)):
                good = part[(table[part] == table[part + d]).sum(axis=1) >= least]
                found.append((node[good], node[good + d]))
        for a, z in ((a, a + n) for a, n in zip(begin[size > few], size[size > few])):
            for b in range(a, z, 32):
                rows = every[b:min(b + 32, z)]
                agree = (table[rows, None, :] == table[None, a:z, :]).sum(axis=2, dtype=np.int16)
                agree[~apart(half, rows[:, None], every[None, a:z])] = -1
                agree[np.arange(len(rows)), rows - a] = -1
                top = np.argsort(-agree, axis=1, kind="stable")[:, :most]
                x, y = np.nonzero(np.take_along_axis(agree, top, axis=1) >= least)
                found.append((node[rows[x]], node[a + top[x, y]]))
        one, other = (np.concatenate(x) for x in zip(*found))
        pairs = np.unique(np.stack([np.minimum(one, other), np.maximum(one, other)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["node", "center"])


def joining_links(batches: Iterator[pa.RecordBatch], least: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join labels within a group, one for each join, from rows sorted by key that carry the full sets.

    Every two nodes of different labels are compared, by signature first and then by all elements, unless
    links found in the group have joined them.
    """
    for key, node, label, half, part, elements, table in by_key(batches, ("key", "node", "label", "half", "part", "elements")):
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out: list[tuple[int, int]] = []
        for a, z in zip(begin, np.append(begin[1:], len(key))):
            _, group = np.unique(label[a:z], return_inverse=True)
            sizes = np.array([len(e) for e in elements[a:z]], np.int64)
            bits, every = None, np.arange(z - a)
            for x in np.flatnonzero(group != np.bincount(group).argmax()):
                other = every[(group != group[x]) & apart(half[a:z], every, x) & apart(part[a:z], every, x)]
                other = other[(table[a + other] == table[a + x]).sum(axis=1) >= least]
                if len(other) and bits is None:
                    words, place = np.unique(np.concatenate(elements[a:z]), return_inverse=True)
                    bits = np.zeros((z - a, -(-len(words) // 64)), U64)
                    np.bitwise_or.at(bits, (np.repeat(every, sizes), place >> 6), U64(1) << (place & 63).astype(U64))
                for some in (other[k:k + 512] for k in range(0, len(other), 512)):
                    some = some[group[some] != group[x]]
                    both = np.bitwise_count(bits[some] & bits[x]).sum(axis=1, dtype=np.int64)
                    for y in some[100 * both >= percent * (sizes[some] + sizes[x] - both)]:
                        if group[y] != group[x]:
                            out.append((node[a + x], node[a + y]))
                            group[group == group[y]] = group[x]
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def split_large(members: DataFrame, bands: DataFrame, most: int) -> DataFrame:
    """(key, node, half): groups of more than ``most`` classes in parts that keep every possible link.

    A link shares more than one band, so a large band is first cut by each second band.  What is still
    large is dealt to parts of at most about ``most``, and every two parts make a group, in which ``half`` keeps
    a part from being compared with itself again.
    """
    bounded = members.where(F.col("n") <= most).select("key", "node", F.lit(-1).alias("half"))
    wide = members.where(F.col("n") > most)
    if wide.isEmpty():
        return bounded
    finer = wide.join(bands, "node").select("node", "key", F.explode("bands").alias("second")).where("key < second").select("node", F.xxhash64("key", "second").alias("key"))
    # The smaller of two common bands takes the larger one as its second; a band that isn't large compares its pairs itself.
    sizes = finer.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = finer.join(sizes, "key").select("key", "node", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    return bounded.unionByName(dealt_parts(parts).select("key", "node", F.col("part").alias("half")))


def dealt_parts(rows: DataFrame) -> DataFrame:
    """``rows`` (key, node, parts, ...) with groups of several parts dealt so that every two parts meet under a key of their own.

    ``part`` is -1 where all of a group is to be compared, and else the number of the part, which isn't
    compared with itself there.
    """
    several = (rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    keyed = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    return (several.withColumn("key", keyed).withColumn("part", F.when(F.col("part") == F.col("other"), F.lit(-1)).otherwise(F.col("part")))
            .drop("parts", "other"))


def connecting_links(members: DataFrame, sets: DataFrame, percent: int, slots: int, few: int, turn: int, load: int) -> DataFrame | None:
    """(node, label): components of the links among ``members`` (key, node, half), or nothing where there is none.

    The most alike partners come first, whose pairs are few.  Groups whose labels still differ then get
    the full sets, in parts of at most about ``load`` elements, and are searched for what joins them.
    """
    least = least_agreement(slots, percent)
    groups = kept(members.join(sets.select("node", "signature"), "node"), "groups")
    asked = groups.select("key", "node", "half", "signature").repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: alike(it, least, turn, few), "node long, center long").distinct()
    first = kept(distances(asked, sets, percent).where("linked").select(F.col("node").alias("a"), F.col("center").alias("b")), "links")
    if first.isEmpty():
        labels, known = None, first
        labelled = groups.withColumn("label", F.col("node"))
    else:
        labels = kept(components(first), "labels")
        known = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b")
        labelled = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    weighed = labelled.select("key", "node", "half", "label").join(sets.select("node", F.size("elements").alias("size")), "node")
    open_groups = (weighed.groupBy("key").agg((F.min("label") != F.max("label")).alias("open"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("load"))
                   .where(F.col("open") & (F.col("n") > few)).select("key", F.ceil(F.col("load") / load).cast("int").alias("parts")))
    dealt = kept(dealt_parts(weighed.join(open_groups, "key").select("key", "node", "half", "label", "parts")), "open-groups")
    if dealt.isEmpty():
        return labels
    later = (dealt.join(sets, "node").select("key", "node", "label", "half", "part", "elements", "signature").repartition("key").sortWithinPartitions("key")
             .mapInArrow(lambda it: joining_links(it, least, percent), "a long, b long").distinct())
    return components(known.unionByName(later))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, slots: int = SLOTS, rows: int = ROWS, large: int = LARGE, few: int = SMALL, turn: int = FIRST_TURN, load: int = LOAD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, group, text_key) for every row of ``docs`` (doc_id, text).

    Two documents are linked where 100 * intersection >= ``percent`` * union of their sets of
    ``width``-word shingles; a text of fewer words is one shingle, a missing or blank text has none and
    is linked with nothing.  component_id is the smallest doc_id that links lead to, kept marks the row
    that has it.  Rows without an id take no part: their component_id is missing and they are kept.  Rows that repeat
    an id are documents of their own with that id, so that different groups can have the same component_id; ``group`` tells them apart.
    text_key is a hash of the text.  Sets and classes are told apart by 64-bit hashes.
    With the default 32 bands of 4, a pair at the threshold of 0.8 is missed once in 20 million times.
    """
    plain = documents(docs, "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    signed_rows = kept(plain.withColumn("text_key", F.xxhash64("text")).mapInArrow(lambda it: sign(it, width, slots, rows), f"doc_id {kind}, text_key long, n_shingles long, node long, bands array<long>"), "signatures")
    some = signed_rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = kept(some.groupBy("node").agg(F.min("doc_id").alias("smallest"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    postings = classes.select("node", F.explode("bands").alias("key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = kept(postings.join(shared, "key"), "shared-bands")
    chosen = kept(members.select("node").distinct().join(classes.select("node", "smallest"), "node"), "candidates")
    texts = plain.join(chosen.select(F.col("smallest").alias("doc_id"), "node").hint("merge"), "doc_id").select("node", "text")
    sets = kept(texts.mapInArrow(lambda it: full_sets(it, width, slots), "node long, elements array<long>, signature binary"), "sets")
    labels = connecting_links(split_large(members, classes.select("node", "bands"), large), sets, percent, slots, few, turn, load)
    if labels is None:
        named = classes.select("node", F.col("smallest").alias("component_id"), F.col("node").alias("group"))
    else:
        labelled = classes.select("node", "smallest").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        lowest = labelled.groupBy("label").agg(F.min("smallest").alias("component_id"))
        named = labelled.join(lowest, "label").select("node", "component_id", F.col("label").alias("group"))
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    grouped = signed_rows.where(~alone).join(kept(named, "components"), "node").select("doc_id", "n_shingles", "component_id", "group", "text_key")
    single = signed_rows.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"), "text_key")
    return (grouped.unionByName(single)
            .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "group", "text_key"))


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with all its columns and one row of each group; ``how`` is passed on to :func:`near_duplicates`.

    The row with the smallest id stays; of rows that share that id, the one whose text has the smallest hash, and of equal ones any.  Rows
    without an id or without words all stay.
    """
    found = kept(near_duplicates(docs, **how).where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "group", "kept", "text_key"), "near-duplicates")
    # Several rows of a group can have its smallest id only where an id is repeated.
    several = kept(found.where("kept").groupBy("group").agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-ids")
    gone = found.where("NOT kept").select("doc_id", "text_key")
    more = found.where("kept").join(several.select("group", "first"), "group").where("text_key <> first").select("doc_id", "text_key")
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = {c: names[i] for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names).withColumns({"doc_id": F.col(place["doc_id"]), "text_key": F.xxhash64(F.coalesce(F.col(place["text"]), F.lit("")))})
    left = rows.join(gone.unionByName(more).distinct(), ["doc_id", "text_key"], "left_anti")
    if not several.isEmpty():
        first = several.select("doc_id", F.col("first").alias("text_key"))
        left = left.join(first, ["doc_id", "text_key"], "left_anti").unionByName(left.join(first, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"]))
    return left.select(*names).toDF(*docs.columns)
