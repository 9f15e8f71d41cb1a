"""Personal data against the patterns as stated, and what the trees add on texts with known spans."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import boosting, personal_data, queries
from tickerloom.llm.store import ready

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


@pytest.fixture(scope="module", autouse=True)
def found(spark):
    ready(spark)


def plain_luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def plain_spans(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    checks = {"email": (EMAIL, lambda m: True), "ip": (IP, lambda m: all(int(p) <= 255 for p in m.group().split("."))),
              "card": (CARD, lambda m: 16 <= len(digits(m)) <= 19 and plain_luhn(digits(m))), "phone": (PHONE, lambda m: 8 <= len(digits(m)) <= 15)}
    return [(kind, m.start(), m.end()) for kind, (pattern, good) in checks.items() for m in re.finditer(pattern, text) if good(m)]


def card(chance):
    digits = "".join(chance.choice("0123456789") for _ in range(15))
    return next(digits + d for d in "0123456789" if plain_luhn(digits + d))


def pieces(chance):
    return chance.choice([
        lambda: f"{chance.choice(['ann', 'b.c', '_x%', 'é'])}@{chance.choice(['a.b', 'mail.example.com', 'host', '-.-', 'x..y', 'a.b.'])}",
        lambda: ".".join(str(chance.choice([0, 7, 99, 255, 256, "007", "0300"])) for _ in range(chance.randint(2, 6))),
        lambda: chance.choice(["", " ", "-"]).join(re.findall("....", card(chance))), lambda: card(chance) + chance.choice(["", "0", " 12", "-"]),
        lambda: "+" + "".join(chance.choice("0123456789 ().-") for _ in range(chance.randint(1, 22))),
        lambda: chance.choice(["word", "@", "+", ".", "3", "12 ", "漢字", "\U0001f600", " ", "\n"])])()


def test_base_equals_the_patterns():
    chance = random.Random(2)
    for _ in range(8000):
        text = "".join(pieces(chance) + chance.choice(["", " ", ", "]) for _ in range(chance.randint(0, 6)))
        assert personal_data.base_spans(text) == plain_spans(text), text


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + " (" * 150_000, "a@" * 100_000, "f:" * 150_000, "-" * 300_000, "1 " * 150_000, "x at y dot " * 30_000):
        personal_data.base_spans(text)
        assert personal_data.candidates(text) is not None


def texts_with_spans(chance, n):
    """Texts and the spans beyond the patterns that a reader would mark."""
    for i in range(n):
        words = ["".join(chance.choice("aeinrst") for _ in range(chance.randint(2, 8))) for _ in range(30)]
        hidden, kind = None, i % 5
        number = f"{chance.randint(200, 999)}{chance.randint(200, 999)}{chance.randint(1000, 9999)}"
        if kind == 0:
            hidden = "email", f"{words[0]}.{words[1]} (at) {words[2]}xy (dot) org"
        elif kind == 1:
            hidden = "phone", f"({number[:3]}) {number[3:6]}-{number[6:]}"
        elif kind == 2:
            hidden = "card", ".".join(re.findall("....", card(chance)))
        elif kind == 3:
            words[9] = chance.choice(["2019-05-11 10:20:30", "version 3.2.1", "1990-2004", "at noon.", "978-3-16-148410-0", "12:30:59", "page 1234567890123"])
        else:
            words[4] = f"{words[5]}.{i}@mail{i % 9}.example.com"
            words[14] = ".".join(str(chance.randint(0, 255)) for _ in range(4))
            words[20] = card(chance)
            words[25] = f"+1 ({number[:3]}) 555-{number[6:]}"
        if hidden:
            words[9] = hidden[1]
        text = " ".join(words)
        yield i, text, hidden and (hidden[0], text.index(hidden[1]), text.index(hidden[1]) + len(hidden[1]))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t) for i, t, _ in texts_with_spans(random.Random(1), 1500)]
    return personal_data.learn(spark.createDataFrame(rows, "doc_id long, text string"))


def test_added_spans(model):
    caught = missed = wrong = 0
    for _, text, hidden in texts_with_spans(random.Random(77), 1000):
        added = [(s["kind"], s["start"], s["end"]) for s in personal_data.spans(text, model) if not s["base"]]
        caught += hidden in added
        missed += hidden is not None and hidden not in added
        wrong += sum(a != hidden for a in added)
    assert caught >= 0.8 * (caught + missed) and wrong <= 0.02 * caught


def test_query_equals_the_patterns(spark, tmp_path):
    chance = random.Random(9)
    rows = [(i, t, "x", "x") for i, t, _ in texts_with_spans(chance, 300)]
    rows += [(1000 + i, "".join(pieces(chance) for _ in range(8)), "x", "x") for i in range(200)] + [(None, "a@b.c", "x", "x"), (5, None, "x", "x"), (5, "", "x", "x"), (5, "", "x", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, kind string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op11_personal_data"](spark, str(tmp_path)).collect()

    def expected(doc_id, text):
        base = plain_spans(text or "")
        return (doc_id, *[sum(k == kind for k, _, _ in base) for kind in personal_data.KINDS],
                hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())

    assert sorted(map(repr, [tuple(r)[:6] for r in got])) == sorted(repr(expected(i, t)) for i, t, *_ in rows)
    texts = {i: t or "" for i, t, *_ in rows if i != 5}
    for r in (r for r in got if r.doc_id in texts):
        listed = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(plain_spans(texts[r.doc_id])) <= set(listed)
        assert listed == sorted(listed, key=lambda s: (personal_data.KINDS.index(s[0]), s[1], s[2])) and len(r.scores) == len(listed)


def test_redacted(spark, model):
    docs = spark.createDataFrame([(1, "write a.b@c.de or +1 (415) 555-2671.", "x"), (2, None, "x")], "doc_id long, text string, spans string")
    got = {r.doc_id: r.text for r in personal_data.redacted(docs, model).collect()}
    assert got == {1: "write [EMAIL] or [PHONE].", 2: None}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    empty = personal_data.learn(docs)
    assert empty.trees is None and personal_data.personal_spans(docs, empty).collect() == []
    assert [s["kind"] for s in personal_data.spans("a@b.c and x (at) y (dot) z", empty)] == ["email"]


def test_trees_and_calibration():
    chance = np.random.default_rng(1)
    x = chance.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    scores = boosting.Trees(x[:1000], y[:1000]).scores(x[1000:])
    assert ((scores > 0.5) == y[1000:]).mean() > 0.97
    least, share = boosting.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 0, 1]))
    assert least.tolist() == [0.1, 0.2, 0.4] and share.tolist() == [0, 1 / 3, 1]
    assert boosting.calibrated(np.array([0.05, 0.25, 0.9]), (least, share)).tolist() == [0, 1 / 3, 1]


def test_all_documents_teach(spark):
    """The documents with the 4,000 smallest hashes have no personal data, so they alone would teach nothing."""
    ids = [r.id for r in spark.range(4600).orderBy(F.xxhash64("id", F.lit(11)), "id").collect()]
    made = [t for _, t, _ in texts_with_spans(random.Random(3), 600)]
    rows = [(i, "no data here") for i in ids[:4000]] + list(zip(ids[4000:], made))
    judge = personal_data.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    seeds = [zlib.crc32(str(i).encode()) for i in ids[4000:]]
    assert judge.lessons == sum(len(list(personal_data.lessons(t, s))) for t, s in zip(made, seeds)) and set(judge.least) == set(personal_data.KINDS)


def test_all_spans_of_a_text_teach():
    one, text = "write to ann@example.com. ", "write to ann@example.com. " * 300
    own = [x for x in personal_data.lessons(text, 1)]
    assert len(own) > 250 * len(list(personal_data.lessons(one, 1))) // 2


def test_trees_over_parts_are_the_trees_over_all():
    chance = np.random.default_rng(2)
    x = chance.integers(0, 9, (900, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] > 8).astype(float)
    whole = boosting.Trees(x, y)
    codes = whole.codes(x)
    order = chance.permutation(900)
    parts = [order[:100], order[100:110], order[110:]]
    again = boosting.Trees.over(whole.edges, y.mean(), lambda trees, splits: sum(trees.sums(codes[p], y[p], np.ones(len(p)), splits) for p in parts))
    assert (whole.scores(x) == again.scores(x)).all()
    assert all(np.array_equal(e, np.unique(np.quantile(c, np.linspace(0, 1, boosting.BINS + 1)[1:-1]))) for e, c in zip(whole.edges, x.T))


def test_searched_patterns_equal_plain_ones():
    chance = random.Random(8)
    for _ in range(4000):
        text = "".join(chance.choice([" at ", "(at)", "[AT] ", "a", "t", " dot ", ".", "b", "(", "+", "1", "23", "4567", " ", "-", ":", "c0"]) for _ in range(chance.randint(1, 16)))
        for pattern, begin in ((personal_data.IP, personal_data.RUN), (personal_data.DOTTED, personal_data.RUN), (personal_data.DIGITS, personal_data.RUN_OR_SIGN)):
            assert [m.span() for m in personal_data.begun(pattern, begin, text)] == [m.span() for m in pattern.finditer(text)], text
        assert [m.span() for m in personal_data.spelled(text)] == [m.span() for m in personal_data.SPELLED.finditer(text)], text
