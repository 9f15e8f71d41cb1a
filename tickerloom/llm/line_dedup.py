"""Near-equal lines across all documents by a segment-partition edit join, and texts without them.

A line of length l is cut into threshold + 1 even segments.  If another line is within the threshold,
one of these segments occurs in it unchanged, close to the same place; which places need to be
probed follows from both lengths.  Lines with a common segment stand in one group, in which they are checked by
a banded bit-parallel edit distance on their whole texts; a group tells of each line how many it is linked with and the first of
them, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tickerloom.llm.arrays import STEP, U64, Prefixes, mix, runs, signed
from tickerloom.llm.store import documents, kept

MOST_EDITS = 2
MIN_CHARS = 20  # from which lines are compared by edits; shorter ones are one where they are equal
HEAVY = 20_000  # rows under a key that are passed on instead of being looked through at once
GROUP = 2_000
GROUP_CHARS = 8_000_000
SEED = 42  # of the engine's own xxhash64


def line_hash(line: bytes, seed: int = SEED) -> int:
    x = xxhash.xxh64_intdigest(line, seed)
    return x - 2**64 if x >= 2**63 else x


def number_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line of every document with two hashes of it, its length and whether it is blank."""
    for batch in batches:
        rows, numbers, one, two, sizes, blank = [], [], [], [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            for i, line in enumerate(text.split("\n")):
                raw = line.encode()
                rows.append(row)
                numbers.append(i)
                one.append(line_hash(raw))
                two.append(line_hash(raw, 7))
                sizes.append(len(line))
                blank.append(not line or line.isspace())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sizes, pa.int32()), pa.array(blank, pa.bool_())],
            ["doc_id", "line_no", "line", "check", "n_chars", "blank"])


def codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines, and where each begins, with the end at last."""
    at = np.cumsum([0, *map(len, lines)])
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), at


def segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of segment ``i`` of a line of that length; the last ones are longer by one."""
    size, more = length // parts, length % parts
    return i * size + np.maximum(0, i - (parts - more)), size + (i >= parts - more)


def key_table(lines: list[str], most: int, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each line's segments and of its substrings to be probed (a row per line), which are there, which columns are probes, parity.

    A line probes lines as long as itself or up to ``most`` shorter.  Its own segments serve as the probe
    of the same place.  parity tells of 64 classes of characters whether their count is odd: one
    edit changes two of them at most.
    """
    points, at = codes(lines)
    begin, length = at[:-1], np.diff(at)
    parity = np.bitwise_xor.reduceat(U64(1) << (mix(points.astype(U64) + STEP) >> U64(58)), begin) if len(lines) else np.zeros(0, U64)
    table = Prefixes(points)
    parts, keys, there, probe = most + 1, [], [], []
    for shorter in range(most + 1):
        other = length - shorter
        for i in range(parts):
            place, size = segment(other, i, parts)
            for shift in range(max(-i, shorter - (most - i)), min(i, shorter + (most - i)) + 1):
                start = place + shift
                inside = (start >= 0) & (start + size <= length) & (other >= min_chars)
                a = np.where(inside, begin + start, 0)
                keys.append(mix(table.of(a, np.where(inside, a + size, 0)) + mix((other * parts + i).astype(U64) + STEP)))
                there.append(inside)
                probe.append(bool(shorter or shift))
    return np.stack(keys, 1), np.stack(there, 1), np.array(probe), parity


def emit_segments(batches: Iterator[pa.RecordBatch], most: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """Segment rows of the distinct lines of a task; what a task has sent it sends no more."""
    sent: set[int] = set()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for first in range(0, len(texts), 250):
            new: dict[int, str] = {}
            for text in texts[first:first + 250]:
                for line in text.split("\n"):
                    if len(line) >= min_chars and (h := line_hash(line.encode())) not in sent:
                        new[h] = line
            if len(sent) > 300_000:
                sent.clear()
            sent.update(new)
            if not new:
                continue
            keys, there, probe, parity = key_table(list(new.values()), most, min_chars)
            h = np.array(list(new), np.int64)
            line, column = np.nonzero(there)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(keys[there])), pa.array(h[line]), pa.array(signed(parity[line])), pa.array(probe[column])], ["key", "line", "parity", "probe"])


def close(one: np.ndarray, other: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(one ^ other) <= 2 * most


def with_partner(key, line, parity, probe, most: int) -> np.ndarray:
    """Which rows, sorted by key, have another line under their key that may be near; two probes don't meet."""
    out = np.zeros(len(key), bool)
    group = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(group, len(key)))
    small = np.repeat(size <= 9, size)
    for d in range(1, min(8, int(size.max()) - 1) + 1):
        met = (key[d:] == key[:-d]) & ~(probe[d:] & probe[:-d]) & (line[d:] != line[:-d]) & close(parity[d:], parity[:-d], most) & small[d:]
        out[d:] |= met
        out[:-d] |= met
    for a, n in zip(group[size > 9], size[size > 9]):
        mine = slice(a, a + n)
        held = np.flatnonzero(~probe[mine]) + a
        for part in (held[k:k + 500] for k in range(0, len(held), 500)):
            met = (line[part][:, None] != line[mine][None, :]) & close(parity[part][:, None], parity[mine][None, :], most)
            out[part] |= met.any(1)
            out[mine] |= met.any(0)
    return out


def match_keys(batches: Iterator[pa.RecordBatch], most: int, heavy: int) -> Iterator[pa.RecordBatch]:
    """The rows of lines that may have a near one under a common key, from rows sorted by key; a key with very many rows is passed on whole."""
    def out(key, line, parity, probe, passed=False):
        if not passed:
            good = with_partner(key, line, parity.view(U64), probe, most)
            key, line, probe = key[good], line[good], probe[good]
        rows = np.unique(np.stack([key, line, probe.astype(np.int64)]), axis=1) if len(key) else np.zeros((3, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2] == 1)], ["key", "line", "probe"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
    passing = None
    for batch in batches:
        got = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "line", "parity", "probe")]
        held = [np.concatenate(x) for x in zip(held, got)]
        if not len(held[0]):
            continue
        last = held[0][-1]
        if passing is not None:
            mine = held[0] == passing
            yield out(*[c[mine] for c in held], passed=True)
            held = [c[~mine] for c in held]
            if last != passing:
                passing = None
        if passing is None and len(held[0]):
            cut = int(np.searchsorted(held[0], last))
            if cut:
                yield out(*[c[:cut] for c in held])
                held = [c[cut:] for c in held]
            if len(held[0]) > heavy:
                yield out(*held, passed=True)
                held, passing = [c[:0] for c in held], last
    if len(held[0]):
        yield out(*held)


def within(one: list[str], other: list[str], most: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``most``.

    The band around the diagonal is one 64-bit word per pair, and all pairs advance together by a column.
    """
    swap = [len(a) > len(b) for a, b in zip(one, other)]
    a, a_at = codes([b if s else a for a, b, s in zip(one, other, swap)])
    b, b_at = codes([a if s else b for a, b, s in zip(one, other, swap)])
    m, n = np.diff(a_at), np.diff(b_at)
    a, b = np.append(a, 0), np.append(b, 0)
    live = np.flatnonzero((n - m <= most) & (m > most))
    verdict = np.zeros(len(one), bool)
    for k in np.flatnonzero((n - m <= most) & (m <= most)):
        verdict[k] = plain_distance(one[k], other[k]) <= most
    top, full = U64(63), U64(2**64 - 1)
    up = np.full(len(live), full << U64(63 - most), U64)
    down = np.zeros(len(live), U64)
    cost = np.full(len(live), most, np.int64)
    j = 0
    while len(live):
        j += 1
        mine, size = a_at[live], m[live]
        char = b[b_at[live] + j - 1]
        equal = np.zeros(len(live), U64)
        for k in range(2 * most + 1):
            row = j + most - k
            there = (row >= 1) & (row <= size)
            same = there & (a[np.where(there, mine + row - 1, 0)] == char)
            equal |= same.astype(U64) << U64(63 - k)
        flat = (((equal & up) + up) ^ up) | equal | down
        right, left = down | ~(flat | up), flat & up
        inside = j <= size - most
        bit = U64(63) - np.clip(j + most - size, 0, 63).astype(U64)
        cost += np.where(inside, 1 - (flat >> top).astype(np.int64), ((right >> bit) & U64(1)).astype(np.int64) - ((left >> bit) & U64(1)).astype(np.int64))
        moved = flat >> U64(1)
        up, down = left | ~(moved | right), moved & right
        over = j == n[live]
        verdict[live[over]] = cost[over] <= most
        stay = ~over & (cost <= 3 * most)
        if not stay.all():
            live, up, down, cost = live[stay], up[stay], down[stay], cost[stay]
    return verdict


def plain_distance(one: str, other: str) -> int:
    row = list(range(len(other) + 1))
    for i, x in enumerate(one, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(other, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def first_common(keys: np.ndarray, there: np.ndarray, probe: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest key that the lines of each pair share, at least one of them not as a probe."""
    best = np.full(len(a), U64(2**64 - 1))
    for one, other in ((a, b), (b, a)):
        for p in np.flatnonzero(~probe):
            mine, here = keys[one, p], there[one, p]
            for q in range(len(probe)):
                same = here & there[other, q] & (mine == keys[other, q])
                best = np.where(same & (mine < best), mine, best)
    return best


def meeting(group: np.ndarray, probe: np.ndarray, part: np.ndarray, crossed: np.ndarray, parity: np.ndarray, length: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same group that may be near, a part at a time; rows are sorted by group."""
    def may(a, b):
        return (~(probe[a] & probe[b]) & close(parity[a], parity[b], most) & (np.abs(length[a] - length[b]) <= most)
                & (~crossed[a] | (part[a] != part[b])))

    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    small = np.repeat(size <= 32, size)
    for d in range(1, int(size[size <= 32].max(initial=1))):
        a = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
        good = may(a, a + d)
        yield a[good], a[good] + d
    for at, n in zip(first[size > 32], size[size > 32]):
        step = max(1, 1_000_000 // n)
        for rows in (np.arange(k, min(k + step, at + n)) for k in range(at, at + n, step)):
            x, y = np.nonzero((rows[:, None] < np.arange(at, at + n)[None, :]) & may(rows[:, None], np.arange(at, at + n)[None, :]))
            yield rows[x], y + at


def links_within(lines: list[str], group: np.ndarray, key: np.ndarray, crossed: np.ndarray, probe: np.ndarray, part: np.ndarray, most: int, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """How many lines of its group each one is linked with, and the first row of them (or the number of rows).

    A pair counts under the smallest key that its lines share, so that it counts once in all groups.  Where a group is
    ``crossed``, only lines of different parts meet.
    """
    keys, there, probes, parity = key_table(lines, most, min_chars)
    length = np.array([len(x) for x in lines])
    count, first = np.zeros(len(lines), np.int64), np.full(len(lines), len(lines))
    for a, b in meeting(group, probe, part, crossed, parity, length, most):
        mine = first_common(keys, there, probes, a, b) == key[a]
        a, b = a[mine], b[mine]
        # Pairs of about the same length are compared together, few of long lines at a time.
        order = np.argsort(length[a], kind="stable")
        a, b = a[order], b[order]
        chars = np.cumsum(length[a] + length[b])
        at = 0
        while at < len(a):
            end = min(at + 4000, max(at + 1, int(np.searchsorted(chars, (chars[at - 1] if at else 0) + 4_000_000))))
            good = within([lines[i] for i in a[at:end]], [lines[i] for i in b[at:end]], most)
            x, y = a[at:end][good], b[at:end][good]
            count += np.bincount(x, minlength=len(lines)) + np.bincount(y, minlength=len(lines))
            np.minimum.at(first, x, y)
            np.minimum.at(first, y, x)
            at = end
    return count, first


def link_groups(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """(line, n, doc_id, line_no) per line of a group with links in it, from rows sorted by group; many small groups are looked at together."""
    def place(r):
        return r["doc_id"] is not None, r["line_no"] if r["doc_id"] is None else r["doc_id"], r["line_no"]

    def of(groups):
        rows = [r for g in groups for r in g]
        number = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        key = np.array([r["key"] for r in rows], np.int64).view(U64)
        count, first = links_within([r["words"] for r in rows], number, key, np.array([r["low"] != r["high"] for r in rows]),
                                    np.array([r["probe"] for r in rows]), np.array([r["part"] for r in rows]), most, min_chars)
        out = [{"line": rows[i]["line"], "n": int(count[i]), "doc_id": rows[first[i]]["doc_id"], "line_no": rows[first[i]]["line_no"]} for i in np.flatnonzero(count)]
        return [pa.RecordBatch.from_pylist(out, schema)] if out else []

    now, held, groups, chars = None, [], [], 0
    for batch in batches:
        for few in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
            for row in few.to_pylist():
                if (row["key"], row["low"], row["high"]) != now:
                    if len(held) > 1:
                        groups.append(sorted(held, key=place))
                        chars += sum(len(r["words"]) for r in held)
                    if chars > 2_000_000:
                        yield from of(groups)
                        groups, chars = [], 0
                    now, held = (row["key"], row["low"], row["high"]), []
                held.append(row)
    groups += [sorted(held, key=place)] if len(held) > 1 else []
    if groups:
        yield from of(groups)


def near_lines(docs: DataFrame, able: DataFrame, most: int, min_chars: int, heavy: int = HEAVY, group: int = GROUP) -> DataFrame:
    """(line, n_links, near): how many different lines are within ``most`` edits of a line that has any, and the first place of all those.

    Lines that may be near stand in groups, one per common key.  A group of more than ``group`` lines or GROUP_CHARS characters is dealt in
    parts, and each two parts meet in a task of their own.  Every group gives at most a row per line.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents(docs, "text").mapInArrow(lambda it: emit_segments(it, most, min_chars), "key long, line long, parity long, probe boolean")
    met = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: match_keys(it, most, heavy), "key long, line long, probe boolean")
    met = kept(met.groupBy("key", "line").agg(F.min("probe").alias("probe")), "common-segments")
    asked = kept(met.select("line").distinct(), "asked-lines")
    firsts = able.join(asked, "line").groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    firsts = kept(firsts, "asked-places")
    ids = firsts.select("first.doc_id").distinct()
    some = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select(F.explode(F.split("text", "\n")).alias("words"))
    lines = some.withColumn("line", F.xxhash64("words")).join(asked, "line", "left_semi").groupBy("line").agg(F.min("words").alias("words"))
    lines = kept(lines.join(firsts, "line").select("line", "words", "first.*"), "line-texts")
    sized = met.join(lines.select("line", F.char_length("words").alias("size")), "line").groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    parts = F.greatest(F.ceil(F.col("n") / group), F.least(F.col("n"), F.ceil(F.col("size") / GROUP_CHARS))).cast("int")
    large = kept(sized.select("key", parts.alias("parts")).where("parts > 1"), "large-groups")
    dealt = met.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.expr("cast(pmod(xxhash64(line, 3), parts) AS int)"))
    cells = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "key", "line", "probe", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    fields = f"line long, n long, doc_id {kind}, line_no int"
    schema = to_arrow_schema(StructType.fromDDL(fields))
    found = (cells.join(lines, "line").repartition(n, "key", "low", "high").sortWithinPartitions("key", "low", "high")
             .mapInArrow(lambda it: link_groups(it, schema, most, min_chars), fields))
    return found.groupBy("line").agg(F.sum("n").alias("n_links"), F.min(F.struct("doc_id", "line_no")).alias("near"))


def line_classes(docs: DataFrame, most: int = MOST_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, line, n_links, first_doc_id, first_line_no, kept) for every line of ``docs`` (doc_id, text).

    Lines end at a line feed; a missing or empty text is one empty line.  Equal lines that aren't blank are one.  Two different lines of
    at least ``min_chars`` characters are linked where they differ by at most ``most`` edits; in shorter ones so few edits make
    another word.  A line's first occurrence is the smallest (doc_id, line_no) among its copies and the lines
    linked with it; only that one is kept.  n_links counts the different texts it is linked with.  Blank lines are always kept.  A
    missing id comes before all others; rows that repeat an id count as one document.  ``line`` is a 64-bit
    hash of the line; copies must agree in a second one, too.
    """
    kind = dict(docs.dtypes)["doc_id"]
    found = kept(documents(docs, "doc_id", "text").mapInArrow(number_lines, f"doc_id {kind}, line_no int, line long, check long, n_chars int, blank boolean"), "lines")
    able = found.where("NOT blank")
    firsts = kept(able.groupBy("line", "check").agg(F.min(F.struct("doc_id", "line_no")).alias("first")), "first-lines")
    around = near_lines(docs, able.where(F.col("n_chars") >= min_chars), most, min_chars)
    classes = kept(firsts.join(around, "line", "left").select(
        "line", "check", F.least("first", F.coalesce("near", "first")).alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "line-classes")
    grouped = able.join(classes, ["line", "check"]).select("doc_id", "line_no", "line", "n_links", "class.*").toDF("doc_id", "line_no", "line", "n_links", "first_doc_id", "first_line_no")
    blank = found.where("blank").select("doc_id", "line_no", "line", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("first_doc_id"), F.col("line_no").alias("first_line_no"))
    return grouped.unionByName(blank).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("line_no") == F.col("first_line_no")))


def drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            if gone:
                gone = {(x["line_no"], x["line"]) for x in gone}
                left = [x for i, x in enumerate(text.split("\n")) if (i, line_hash(x.encode())) not in gone]
                text = "\n".join(left) if left else None
            texts.append(text)
        columns = {c: batch.column(c) for c in batch.schema.names if c != "gone"} | {"text": pa.array(texts, pa.string())}
        yield pa.RecordBatch.from_pydict(columns).filter(pa.array([t is not None or not g for t, g in zip(texts, batch.column("gone").to_pylist())]))


def without_repeated_lines(docs: DataFrame, most: int = MOST_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with all its columns, each text without the lines that are not kept.

    A document that loses every line goes; one without text stays as it is.
    """
    gone = line_classes(docs, most, min_chars).where(~F.col("kept")).groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "line")).alias("gone"))
    # Only documents that lose lines pass through Python.
    gone = gone.withColumnRenamed("doc_id", "loser")
    marked = docs.join(gone, docs["doc_id"].eqNullSafe(gone["loser"]), "left").select(*[docs[c] for c in docs.columns], "gone")
    schema = docs.schema
    return marked.where("gone IS NULL").drop("gone").unionByName(marked.where("gone IS NOT NULL").mapInArrow(drop_lines, schema))
