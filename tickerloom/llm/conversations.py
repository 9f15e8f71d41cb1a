"""Damaged conversations repaired by the cheapest edits of their turns, with what was found wrong.

Turns are brought in order by one range partitioning, so that a conversation of any length is spread over partitions.  One
that lies whole within a partition is repaired where it is.  One that is cut, or too large to hold, is dealt in
pieces: each gives the table of its cheapest crossings (4 x 4 numbers), from which the prices behind every piece follow; with
them a piece is solved by itself for every state it may be entered in; the states then follow from the first piece on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tickerloom.llm import repair_path
from tickerloom.llm.repair_path import CLOSING, ENDS, FINE, FORCED, PART, START, STATES, TRUNCATED
from tickerloom.llm.store import kept

WHITE = " \t\n\x0b\x0c\r"
MOST_ROWS = 4096  # of a conversation that a task holds whole
MOST_CHARS = 8_000_000
LEGAL = {"su", "ua", "au"}


def faults(turns: list[dict], again: set[int] | None = None) -> list[str]:
    """The first fault of each turn: blank, duplicate, truncated or none; ``again`` numbers the repeated ones, if known."""
    found, seen = [], set()
    for i, turn in enumerate(turns):
        text = turn["text"].strip(WHITE)
        key = (turn["role"], turn["text"])
        repeated = key in seen if again is None else i in again
        if again is None:
            seen.add(key)
        found.append("blank" if not text else "duplicate" if repeated else "" if text[-1] in ".!?" else "truncated")
    return found


def codes(turns: list[dict], found: list[str]) -> list[int]:
    level = {"": FINE, "truncated": TRUNCATED, "blank": FORCED, "duplicate": FORCED}
    return [repair_path.code(t["role"], level[f]) for t, f in zip(turns, found)]


def profile(turns: list[dict], found: list[str]) -> dict:
    """Counts of a piece, and what its ends add to those of its neighbours."""
    initials = [t["role"][:1] for t in turns]
    numbers = [t["turn"] for t in turns if t["turn"] is not None]
    return {"blank": found.count("blank"), "duplicate": found.count("duplicate"), "truncated": found.count("truncated"),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "first_initial": initials[0], "last_initial": initials[-1],
            "first_turn": numbers[0] if numbers else None, "last_turn": numbers[-1] if numbers else None, "n_turns": len(set(numbers))}


def piece_columns(kind: str, turn: str) -> str:
    return (f"conv_id {kind}, part int, seg long, whole boolean, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
            f"first_turn {turn}, last_turn {turn}, n_turns long, cost long, audit string, turns array<struct<turn: {turn}, role: string, text: string>>")


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most_rows: int, most_chars: int) -> Iterator[pa.RecordBatch]:
    """Repair the conversations that lie whole in this partition; the first and the last, and those too large, in raw pieces."""
    part, seg = TaskContext.get().partitionId(), 0
    ready: list[dict] = []

    def raw(conv, turns):
        nonlocal seg
        at = 0
        while at < len(turns):
            end, chars = at, 0
            while end < min(at + PART, len(turns)) and (end == at or chars < most_chars):
                chars += len(turns[end]["text"])
                end += 1
            seg += 1
            yield {"conv_id": conv, "part": part, "seg": seg, "whole": False, "turns": turns[at:end]}
            at = end

    def whole(conv, turns):
        nonlocal seg
        seg += 1
        found = faults(turns)
        cost, audit = repair_path.cheapest(codes(turns, found))
        closed = repair_path.rebuilt(turns, audit, START)
        return {"conv_id": conv, "part": part, "seg": seg, "whole": True, "cost": cost, "audit": audit, "turns": closed} | profile(turns, found)

    held, conv, first, large, chars, waiting = [], None, True, False, 0, 0
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        for i, turn in zip(ids, batch.select(["turn", "role", "text"]).to_pylist()):
            if held and i != conv:
                if first or large:
                    ready.extend(raw(conv, held))
                else:
                    ready.append(whole(conv, held))
                held, first, large, chars = [], False, False, 0
            conv = i
            held.append(turn)
            chars += len(turn["text"])
            waiting += len(turn["text"])
            if len(held) >= most_rows or chars >= most_chars:
                ready.extend(raw(conv, held[:-1]))
                held, large, chars = held[-1:], True, len(turn["text"])
            if len(ready) >= 500 or ready and waiting >= most_chars:
                yield batch_of(ready, schema)
                ready, waiting = [], 0
    ready.extend(raw(conv, held) if held else [])
    if ready:
        yield batch_of(ready, schema)


def per_row(schema: pa.Schema, work):
    """A function of batches that makes one row of each row."""
    def of(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch_of([work(row) for row in batch.to_pylist()], schema)
    return of


def by_conversation(schema: pa.Schema, step):
    """A function of batches in the order of conversations: ``step(rows)`` takes the iterator of one conversation's rows."""
    def of(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        row, out = next(rows, None), []

        def mine(conv):
            nonlocal row
            while row is not None and row["conv_id"] == conv:
                now, row = row, next(rows, None)
                yield now

        while row is not None:
            for made in step(mine(row["conv_id"])):
                out.append(made)
                if len(out) >= 500:
                    yield batch_of(out, schema)
                    out = []
        if out:
            yield batch_of(out, schema)
    return of


def price_backwards(rows):
    ends = list(ENDS)
    for row in rows:
        yield {"part": row["part"], "seg": row["seg"], "ends": ends}
        ends = repair_path.before(row["crossing"], ends)


def enter_forwards(rows):
    state, last = START, None
    for row in rows:
        if last:
            yield last
        last = {"part": row["part"], "seg": row["seg"], "entry": state, "closing": ""}
        state = row["exits"][state]
    yield last | {"closing": CLOSING[state]}


def crossing_of(row: dict) -> dict:
    found = faults(row["turns"], set(row["again"] or []))
    return {"conv_id": row["conv_id"], "part": row["part"], "seg": row["seg"], "crossing": repair_path.crossing(codes(row["turns"], found))}


def tried(row: dict) -> dict:
    found = faults(row["turns"], set(row["again"] or []))
    rows = codes(row["turns"], found)
    price = repair_path.auction(rows, row["ends"], STATES)
    ways = [repair_path.trace(rows, row["ends"], price, s) for s in STATES]
    return {"conv_id": row["conv_id"], "part": row["part"], "seg": row["seg"], "ways": [w for w, _ in ways], "exits": [e for _, e in ways]}


def settled(row: dict) -> dict:
    found = faults(row["turns"], set(row["again"] or []))
    initials = row["ways"][row["entry"]] + row["closing"]
    cost = repair_path.cost_of(initials, codes(row["turns"], found))
    turns = repair_path.rebuilt(row["turns"], initials, row["entry"])
    return {"conv_id": row["conv_id"], "part": row["part"], "seg": row["seg"], "whole": False, "cost": cost, "audit": initials, "turns": turns} | profile(row["turns"], found)


def repeated(pieces: DataFrame) -> DataFrame:
    """(part, seg, again): places of the turns whose role and text stand earlier in their conversation."""
    turns = pieces.select("conv_id", "part", "seg", F.posexplode("turns").alias("pos", "t"))
    same = F.sha2(F.concat(F.char_length("t.role").cast("string"), F.lit(":"), "t.role", "t.text"), 256)
    in_piece = turns.groupBy("conv_id", "part", "seg", same.alias("same")).agg(F.sort_array(F.collect_list("pos")).alias("places"))
    first = in_piece.groupBy("conv_id", "same").agg(F.min(F.struct("part", "seg")).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select(F.col("conv_id").alias("conv"), F.col("same").alias("text"), "first")
    met = in_piece.join(first, in_piece["conv_id"].eqNullSafe(first["conv"]) & (in_piece["same"] == first["text"]), "left")
    here = F.col("first").isNull() | (F.struct("part", "seg") == F.col("first"))
    later = met.select("part", "seg", F.explode(F.when(here, F.slice("places", 2, PART)).otherwise(F.col("places"))).alias("pos"))
    return later.groupBy("part", "seg").agg(F.collect_list("pos").alias("again"))


def in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """Small rows of a conversation one after another in one task, which reads them as a stream."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "conv_id").sortWithinPartitions("conv_id", *order)


def repair(conversations: DataFrame, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS) -> DataFrame:
    """Pieces of the repaired conversations, for ``conversations`` (conv_id, turn, role, text).

    (conv_id, part, seg, whole, blank, duplicate, truncated, illegal, first_initial, last_initial, first_turn, last_turn,
    n_turns, cost, audit, turns): a conversation is its pieces by (part, seg), one if ``whole``.  The counts are the piece's; what
    two pieces have in common is left to ``report``.  ``turns`` are the turns after the edits, ``audit`` the edits' initials.

    Turns are taken by their number, missing ones first, then by role and text, so that repeated rows stand together.  A missing
    role or text is one space.  A missing conv_id is a conversation, too.  Blank turns (white space alone) and those whose role
    and text stood earlier must go; a turn that doesn't end a sentence costs 5 unless it goes; Delete costs 2, Rerole 1, an
    inserted empty turn 5.  The cheapest edits leave the initials of the roles as (s?(ua)+)?, of equal ones the first by ASCII.
    An empty table gives an empty one; other columns are not read.  A task holds at most ``most_rows`` turns or
    ``most_chars`` characters of a conversation, and one turn more.
    """
    spark = conversations.sparkSession
    types = dict(conversations.dtypes)
    kind, turn = types["conv_id"], types["turn"]
    ddl = piece_columns(kind, turn)
    schema = arrow(ddl)
    texts = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", "turn", *texts)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    found = kept(ordered.mapInArrow(lambda it: cut(it, schema, most_rows, most_chars), ddl), "conversations")
    pieces = found.where("NOT whole").select("conv_id", "part", "seg", "turns")
    key = ["part", "seg"]
    marked = kept(pieces.join(repeated(pieces), key, "left").select("conv_id", *key, "turns", "again"), "conversation-pieces")

    def step(df, fields, work):
        made = arrow(fields)
        return df.mapInArrow(per_row(made, work), fields)

    def scan(df, order, fields, work):
        made = arrow(fields)
        return in_order(df, order).mapInArrow(by_conversation(made, work), fields)

    table = step(marked, f"conv_id {kind}, part int, seg long, crossing array<long>", crossing_of)
    ends = scan(table, [F.desc("part"), F.desc("seg")], "part int, seg long, ends array<long>", price_backwards)
    ways = kept(step(marked.join(ends, key), f"conv_id {kind}, part int, seg long, ways array<string>, exits array<int>", tried), "conversation-ways")
    entries = scan(ways.select("conv_id", *key, "exits"), [F.col("part"), F.col("seg")], "part int, seg long, entry int, closing string", enter_forwards)
    done = step(marked.join(ways.select(*key, "ways"), key).join(entries, key), ddl, settled)
    return found.where("whole").unionByName(done)


def folded(rows):
    """One report from the pieces of a conversation in order; the repaired text only passes through."""
    sha, total, audit, empty, before, numbers = hashlib.sha256(), {}, [], True, None, []
    for row in rows:
        for turn in row["turns"]:
            sha.update(("" if empty else "\n").encode() + f"{turn['role']}:{turn['text']}".encode())
            empty = False
        audit.append(row["audit"])
        for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
            total[c] = total.get(c, 0) + row[c]
        total["illegal"] += before is not None and before + row["first_initial"] not in LEGAL
        before = row["last_initial"]
        if row["n_turns"]:
            fresh = row["n_turns"] - (bool(numbers) and numbers[1] == row["first_turn"])
            numbers = [numbers[0] if numbers else row["first_turn"], row["last_turn"], (numbers[2] if numbers else 0) + fresh]
    gaps = numbers[1] - numbers[0] + 1 - numbers[2] if numbers else 0
    yield {"conv_id": row["conv_id"], "gaps": gaps, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()} | total


def report(pieces: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every row of ``conv_ids``.

    gaps: numbers missing between the first and the last turn.  illegal: neighbours whose initials aren't su, ua or au.  The digest is over
    ``role:text`` of the repaired turns, joined by line feeds.  A conversation without turns has zeros and empty texts.
    """
    kind = dict(pieces.dtypes)["conv_id"]
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    fields = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    one = pieces.where("whole").select("conv_id", gaps.alias("gaps"), *counts, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    schema = arrow(fields)
    many = in_order(pieces.where("NOT whole"), [F.col("part"), F.col("seg")]).mapInArrow(by_conversation(schema, folded), fields)
    every = one.unionByName(many).withColumnRenamed("conv_id", "known")
    ids = conv_ids.select("conv_id").distinct()
    joined = ids.join(every, ids["conv_id"].eqNullSafe(every["known"]), "left")
    return joined.select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ["gaps", *counts]],
                         F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
