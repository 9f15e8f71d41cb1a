"""Repaired conversations against a plain search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tickerloom.llm import conversations, queries, repair_path
from tickerloom.llm.store import ready

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.fixture(scope="module", autouse=True)
def found(spark):
    ready(spark)


def plain_edits(rows):
    """(cost, audit, kept turns) from (role, text, fault): every sequence of edits, by the rules as stated."""
    n = len(rows)
    wanted = {"": "u", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, last, inserts):
        ways = [(0, "", ())] if i == n and last in ("", "a") else []

        def add(cost, initial, turn, j, now, more=0):
            rest = best(j, now, more)
            if rest:
                ways.append((cost + rest[0], initial + rest[1], (turn, *rest[2]) if turn else rest[2]))

        if inserts < 3:
            add(5, "I", ("user" if wanted[last] == "u" else "assistant", ""), i, wanted[last], inserts + 1)
        if i < n:
            role, text, fault = rows[i]
            add(2, "D", None, i + 1, last)
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                for new in ("user", "assistant"):
                    if wanted[last] == new[0]:
                        add(1 + late, "R", (new, text), i + 1, new[0])
                if role[:1] == wanted[last] or role[:1] == "s" and last == "":
                    add(late, "K", (role, text), i + 1, role[:1])
        return min(ways) if ways else None

    return best(0, "", 0)


def plain_report(conv, turns):
    """From (turn, role, text) in order."""
    seen, rows = set(), []
    for _, role, text in turns:
        last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        rows.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""))
        seen.add((role, text))
    numbers = {t for t, _, _ in turns if t is not None}
    cost, audit, out = plain_edits(tuple(rows))
    count = [sum(f == kind for _, _, f in rows) for kind in ("blank", "duplicate", "truncated")]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *count, illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def in_order(rows):
    return sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_auction_equals_a_plain_search(monkeypatch):
    chance = random.Random(1)
    for part in (64, 3, 1):
        monkeypatch.setattr(repair_path, "PART", part)
        for _ in range(1500):
            rows = [(chance.choice(["user", "assistant", "system", "tool", "user", "assistant"]), str(k), chance.choice(["", "", "", "truncated", "blank"])) for k in range(chance.randint(0, 10))]
            turns = [{"turn": k, "role": r, "text": t} for k, (r, t, _) in enumerate(rows)]
            coded = conversations.codes(turns, [f for _, _, f in rows])
            cost, audit, out = plain_edits(tuple(rows))
            assert repair_path.cheapest(coded) == (cost, audit)
            assert [(t["role"], t["text"]) for t in repair_path.rebuilt(turns, audit, repair_path.START)] == list(out)
            assert repair_path.cost_of(audit, coded) == cost
            ends = list(repair_path.ENDS)
            for at in range(len(rows) - 1 - (len(rows) - 1) % 4, -1, -4):
                ends = repair_path.before(repair_path.crossing(coded[at:at + 4]), ends)
            assert ends[repair_path.START] == cost


def test_prices_never_exceed_arcs():
    chance = random.Random(2)
    rows = [chance.randrange(12) for _ in range(60)]
    price = repair_path.auction(rows, repair_path.ENDS, repair_path.STATES)
    for i, row in enumerate(rows):
        for state in repair_path.STATES:
            for _, cost, step in repair_path.ARCS[row][state]:
                assert price[4 * i + state] <= cost + price[4 * i + state + step]


def conversation_rows(seed, convs, most):
    chance = random.Random(seed)
    rows = []
    for conv in convs:
        for turn in range(chance.randint(1, most)):
            text = chance.choice(["Yes. ", "No!", "Why?\n", "but", " ", "", "Well. x", "Ça va.", None])
            role = chance.choice(["user", "assistant"] * 4 + ["system", "tool", None, "ubuntu", ""])
            rows.append((conv, chance.choice([turn] * 6 + [None, turn + 2]), role, text))
    return rows + rows[:7] + rows[:3]


def test_query_equals_a_plain_search(spark, tmp_path):
    rows = conversation_rows(4, [*range(120), None], 9)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, seg int")
    df.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path))
    assert got.columns == COLUMNS
    expected = [plain_report(conv, in_order(turns)) for conv, turns in plain_damage(rows).items()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def test_large_conversations_are_dealt_in_pieces(spark):
    rows = conversation_rows(6, [1, 2, 3, None], 40) + [(9, k, "assistant" if k % 3 else "user", f"{k % 50}.") for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = conversations.repair(df, most_rows=5)
    assert pieces.agg(F.max(F.size("turns"))).first()[0] <= 2 * repair_path.PART + 10
    got = {r.conv_id: tuple(r) for r in conversations.report(pieces, df).collect()}
    whole = {r.conv_id: tuple(r) for r in conversations.report(conversations.repair(df), df).collect()}
    assert got == whole
    by_conv = {}
    for conv, *turn in rows:
        by_conv.setdefault(conv, []).append(tuple(turn))
    for conv in (1, 2, 3, None):
        assert got[conv] == plain_report(conv, in_order(by_conv[conv]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.report(conversations.repair(df), df).collect() == []
