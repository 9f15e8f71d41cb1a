"""Personal data in texts: exact patterns, and candidates of loose patterns that boosted trees judge by form and context.

The patterns proper (base) always count.  Loose generators propose more, overlapping each other: addresses spelled out or with
letters beyond ASCII, version 6 addresses, phone numbers without a country's sign, cards with other separators.  No table
labels personal data, so the trees learn from the patterns: candidates that hold a base span are right, those whose form rules
them out (check digit, parts over 255, dates, a domain without a dot) are wrong, the rest are no examples; base spans written in other ways are right, and dates, versions, prices and numbers with a
changed digit put in their places are wrong.  Every document teaches: its examples stay in tables, which Spark counts and groups, and the
trees are fitted to sums over these tables.  Scores are calibrated on the third of the documents kept out of the fit, per kind; a kind's
threshold is the least score from which the calibrated share of right ones reaches PRECISION.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.arrays import blocks
from tickerloom.llm.boosting import Trees, bin_edges, calibrated, isotonic
from tickerloom.llm.store import documents, kept

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
GRID = 4  # decimals of a score that is calibrated
AROUND = 24

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOOSE_DOMAIN = re.compile(r"[\w-]++(?:\.[\w-]++)*+")
LOOSE_LOCAL = re.compile(r"[\w.%+-]")
SPELLED = re.compile(r"(?:\s?[\[({]\s?at\s?[\])}]\s?|\sat\s)(?=[\w-]++(?:\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s|\.)[\w-])", re.I)
SPELLED_DOMAIN = re.compile(r"[\w-]++(?:(?:\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s|\.)[\w-]++)++", re.I)
DOTTED = re.compile(r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}+")
COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
DIGITS = re.compile(r"(?<![0-9])(?:\+\s?)?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+")
DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]|[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}")
# Where a pattern may begin: searching for these is faster than trying it at each character.
RUN = re.compile("[0-9]+")
RUN_OR_SIGN = re.compile(r"[0-9]+|[+(]")
AT = re.compile(r"[aA][tT][\s\])}]")
CUES = (re.compile(r"mail|contact|kontakt|correo|courriel|@", re.I), re.compile(r"\bip|host|server|addr|from", re.I),
        re.compile(r"card|visa|karte|carte|tarjeta|credit", re.I), re.compile(r"phone|tel|call|fax|mobil|ruf", re.I),
        re.compile(r"version|licen|isbn|order|invoice|no\.|nr\.|token|key|v\.?\s?$|[$€£]", re.I))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def small_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def begun(pattern: re.Pattern, begin: re.Pattern, text: str) -> Iterator[re.Match]:
    """``pattern.finditer(text)``, for a pattern that begins where ``begin`` does and within a run of digits only at its first."""
    at = 0
    while place := begin.search(text, at):
        found = pattern.match(text, place.start())
        if found:
            yield found
        at = (found or place).end()


def spelled(text: str) -> Iterator[re.Match]:
    """``SPELLED.finditer(text)``: the 'at' has at most a bracket and two blanks before it."""
    end = 0
    for place in AT.finditer(text):
        at = place.start()
        if at > end and (text[at - 1] in "[({" or text[at - 1].isspace()):
            for start in range(max(end, at - 3), at):
                if (found := SPELLED.match(text, start)) and found.end() > at:
                    yield found
                    end = found.end()
                    break


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns proper, by kind, then start."""
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", m.start(), m.end()) for m in begun(IP, RUN, text) if small_parts(m.group())]
    found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Loose matches of all kinds; they may overlap."""
    found = []
    at = text.find("@")
    while at >= 0:
        start = at
        while start and LOOSE_LOCAL.match(text[start - 1]):
            start -= 1
        domain = LOOSE_DOMAIN.match(text, at + 1)
        if start < at and domain:
            found.append(("email", start, domain.end()))
        at = text.find("@", at + 1)
    for m in spelled(text):
        start = m.start()
        while start and LOOSE_LOCAL.match(text[start - 1]):
            start -= 1
        if start < m.start():
            found.append(("email", start, SPELLED_DOMAIN.match(text, m.end()).end()))
    found += [("ip", m.start(), m.end()) for m in begun(DOTTED, RUN, text)]
    if text.count(":") > 1:
        found += [("ip", m.start(), m.end()) for m in COLONS.finditer(text) if len(m.group().replace(":", "")) >= 2]
    for m in begun(DIGITS, RUN_OR_SIGN, text):
        start, n = m.start(), len(digits_of(m.group()))
        found += [("card", start, m.end())] * (12 <= n <= 19) + [("phone", start, m.end())] * (n <= 15)
    return found


def side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else 3 if c in ".,;:!?" else 4


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - AROUND):start], text[end:end + AROUND]
    digits = digits_of(span)
    groups = re.findall("[0-9]+", span)
    labels = re.split(r"[@.\s]+|\(dot\)|\[dot\]|\{dot\}", span.lower())
    last = labels[-1] if labels else ""
    return [
        KINDS.index(kind), len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.count(" "), span.count("-"), span.count("."), span.count("(") + span.count("/"), span.count(":"), span.startswith("+"),
        luhn(digits) if len(digits) > 11 else -1, small_parts(".".join(groups)) if groups else -1, "@" in span, span.lower().count("dot"),
        len(last) if last.isalpha() else -1, sum(c.isalpha() for c in span), sum(c > "\x7f" for c in span), len(set(digits)),
        bool(DATE.search(span)), bool(re.search("[a-fA-F]", span)), side(text[start - 1:start]), side(text[end:end + 1]),
        len(digits_of(before)) + len(digits_of(after)), *[bool(c.search(before)) for c in CUES],
    ]


def name(chance: random.Random, least: int = 3, most: int = 9) -> str:
    return "".join(chance.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(chance.randint(least, most)))


def rewritten(kind: str, span: str, chance: random.Random) -> list[tuple[str, bool]]:
    """Other ways to write a base span, and things that look like it but aren't."""
    digits = digits_of(span)
    wrong = [chance.choice([
        f"{chance.randint(1950, 2030)}-{chance.randint(1, 12):02}-{chance.randint(1, 28):02} {chance.randint(0, 23):02}:{chance.randint(0, 59):02}",
        f"{chance.randint(1, 28)}.{chance.randint(1, 12)}.{chance.randint(1950, 2030)}",
        f"{chance.randint(1, 30)}.{chance.randint(0, 99)}.{chance.randint(0, 99)}",
        f"{chance.randint(1950, 2030)}-{chance.randint(1950, 2030)}",
        f"978-{chance.randint(0, 9)}-{chance.randint(10, 99)}-{chance.randint(100000, 999999)}-{chance.randint(0, 9)}",
        f"{chance.randint(0, 99)}.{chance.randint(10 ** 7, 10 ** 9)}", f"{chance.randint(1, 23):02}:{chance.randint(0, 59):02}:{chance.randint(0, 59):02}",
        f"{chance.getrandbits(160):040x}", str(chance.randint(10 ** 8, 10 ** 11))])]
    if kind == "email":
        local, _, domain = span.partition("@")
        other, host = name(chance) + chance.choice(["", ".", "_"]) + name(chance), f"{name(chance)}.{chance.choice(['', name(chance) + '.'])}{name(chance, 2, 4)}"
        at = chance.randint(0, len(other))
        right = [other[:at] + chance.choice("üéñжç漢") + other[at:] + "@" + host, chance.choice("üéñжç漢") + span]
        for local, domain in ((local, domain), (other, host)):
            at, dot = chance.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" {at} ", "."), (" [at] ", " [dot] ")])
            right.append(local + at + domain.replace(".", dot))
        wrong += [f"{name(chance)}@{name(chance)}", f"{name(chance, 2)} at {name(chance)}.{name(chance).capitalize()} ", f"{name(chance)} at {name(chance)}. "]
    elif kind == "ip":
        right = [":".join(f"{chance.getrandbits(16):x}" for _ in range(8)), f"{chance.getrandbits(16):x}:{chance.getrandbits(16):x}::{chance.getrandbits(16):x}"]
        parts = span.split(".")
        wrong += [".".join([*parts[:2], str(int(parts[2]) + 256), parts[3]]), ".".join([*parts, str(chance.randint(0, 99))])]
    elif kind == "card":
        sign = chance.choice([".", "/", " - "[:2]])
        right = [sign.join(digits[i:i + 4] for i in range(0, len(digits), 4))]
        other = digits[:-1] + str((int(digits[-1]) + chance.randint(1, 9)) % 10)
        wrong += [other, sign.join(other[i:i + 4] for i in range(0, len(other), 4)), other[:chance.randint(12, 15)]]
    else:
        sign, tail = chance.choice("-. "), digits[-10:]
        right = [f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", sign.join((tail[:3], tail[3:6], tail[6:])), f"0{tail[:3]}/{tail[3:]}"]
        wrong += [f"{tail[:3]}{tail[3:]}{chance.randint(0, 9)}", f"{tail[0]},{tail[1:4]},{tail[4:7]}.{tail[7:9]}"]
    return [(x, True) for x in right] + [(x, False) for x in wrong]


def ruled_out(kind: str, span: str) -> bool:
    """Whether the form alone tells that it isn't of that kind."""
    digits = digits_of(span)
    if kind == "email":
        return "@" in span and "." not in span.partition("@")[2].strip(".")
    if kind == "ip":
        return ":" not in span and not (span.count(".") == 3 and small_parts(span))
    return bool(DATE.search(span)) or kind == "card" and not (len(digits) >= 16 and luhn(digits))


def lessons(text: str, seed: int) -> Iterator[tuple[str, list[float], bool]]:
    """(kind, features, right) of the text's own candidates and of those made from its base spans."""
    base = base_spans(text)
    held = {kind: [(a, b) for k, a, b in base if k == kind] for kind in KINDS}
    for kind, start, end in candidates(text):
        inside, mine = bisect_left(held[kind], (start, 0)), False
        while not mine and inside < len(held[kind]) and held[kind][inside][0] < end:
            a, b = held[kind][inside]
            mine = b <= end and 2 * (b - a) >= end - start
            inside += 1
        if mine or ruled_out(kind, text[start:end]):
            yield kind, features(text, kind, start, end), mine
    chance = random.Random(seed)
    for kind, start, end in base:
        left, right = text[max(0, start - AROUND):start], text[end:end + AROUND]
        for span, good in rewritten(kind, text[start:end], chance):
            made = left + span + right
            for k, a, b in candidates(made):
                if a < len(left) + len(span) and b > len(left):
                    whole = a <= len(left) + 1 and b >= len(left) + len(span) - 1 and b - a <= len(span) + 2
                    yield k, features(made, k, a, b), good and k == kind and whole


LESSON = "part int, kind string, features array<double>, right boolean"
CODED = "part int, kind string, codes binary, right boolean"


def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            seed = zlib.crc32((text if doc_id is None else str(doc_id)).encode())
            rows += [{"part": seed % 3, "kind": k, "features": [float(v) for v in f], "right": r} for k, f, r in lessons(text, seed)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("kind", pa.string()), ("features", pa.list_(pa.float64())), ("right", pa.bool_())]))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)


def value_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for f, column in enumerate(matrix(batch).T if batch.num_rows else ()):
            value, n = np.unique(column, return_counts=True)
            yield pa.RecordBatch.from_pydict({"feature": np.full(len(value), f, np.int32), "value": value, "n": n.astype(np.int64)})


def encode(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            codes = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, matrix(batch).T)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "kind": batch.column("kind"), "codes": [row.tobytes() for row in codes], "right": batch.column("right")})


def decoded(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def part_sums(batches: Iterator[pa.RecordBatch], trees: Trees, splits: list) -> Iterator[pa.RecordBatch]:
    """One row: what the task's examples add to the sums of a tree's next level."""
    parts = (trees.sums(decoded(b), b.column("right").to_numpy(zero_copy_only=False).astype(float), b.column("n").to_numpy().astype(float), splits) for b in batches if b.num_rows)
    if isinstance(total := sum(parts), np.ndarray):
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})


def score_counts(batches: Iterator[pa.RecordBatch], trees: Trees) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_pydict({"kind": batch.column("kind"), "score": trees.coded_scores(decoded(batch)).round(GRID), "right": batch.column("right"), "n": batch.column("n")})


class Judge:
    """Trees, and per kind the calibration of their scores and the threshold; ``lessons`` is how many examples taught them."""

    def __init__(self, trees: Trees | None = None, steps: dict[str, tuple[np.ndarray, np.ndarray]] | None = None, precision: float = PRECISION, lessons: int = 0):
        self.trees, self.steps, self.least, self.lessons = trees, {}, {}, lessons
        for name, step in (steps or {}).items():
            enough = step[1] >= precision
            if enough.any():
                self.steps[name], self.least[name] = step, float(step[1][enough][0])

    def judge(self, found: list[tuple[str, int, int]], x: list[list[float]]) -> list[float]:
        """Calibrated score of each candidate, or -1 where its kind's threshold isn't reached."""
        if self.trees is None or not found:
            return [-1.0] * len(found)
        raw, kinds, out = self.trees.scores(np.array(x, float)).round(GRID), np.array([k for k, _, _ in found]), np.full(len(found), -1.0)
        for kind, steps in self.steps.items():
            mine = kinds == kind
            share = calibrated(raw[mine], steps)
            out[mine] = np.where(share >= self.least[kind], share, -1.0)
        return out.tolist()


def learn(docs: DataFrame) -> Judge:
    """Fit and calibrate on the candidates of all ``docs`` (doc_id, text).

    The driver gets how often each feature has each value, a row of sums a task for each level of a tree, and
    how many candidates of a kind have a score of ``GRID`` decimals; the examples themselves stay in tables.  Equal ones are one row with a number.
    """
    spark = docs.sparkSession
    taught = kept(documents(docs, "doc_id", "text").mapInArrow(teach, LESSON), "lessons")
    fit = taught.where("part > 0")
    counts = fit.mapInArrow(value_counts, "feature int, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n")).orderBy("feature", "value").toArrow()
    feature, value, n = (counts.column(c).to_numpy() for c in ("feature", "value", "n"))
    edges = [bin_edges(value[feature == f], n[feature == f]) for f in np.unique(feature)]
    right = dict(fit.groupBy("right").count().collect())
    if len(right) < 2:
        return Judge()
    coded = taught.mapInArrow(lambda it: encode(it, edges), CODED).groupBy((F.col("part") > 0).alias("fit"), "kind", "codes", "right").agg(F.count("*").alias("n"))
    coded = kept(coded.repartition(spark.sparkContext.defaultParallelism), "coded")
    examples, others = coded.where("fit").select("codes", "right", "n"), coded.where("NOT fit").select("kind", "codes", "right", "n")

    def sums(trees: Trees, splits: list) -> np.ndarray:
        rows = examples.mapInArrow(lambda it: part_sums(it, trees, splits), "sums binary").toArrow().column("sums").to_pylist()
        return sum(np.frombuffer(r) for r in rows).reshape(2, 2 ** len(splits), len(edges), -1)

    trees = Trees.over(edges, right[True] / sum(right.values()), sums)
    levels = (others.mapInArrow(lambda it: score_counts(it, trees), "kind string, score double, right boolean, n long").groupBy("kind", "score")
              .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)).alias("yes")).toArrow())
    kind, score, n, yes = (levels.column(c).to_numpy() for c in ("kind", "score", "n", "yes"))
    steps = {k: isotonic(score[kind == k], yes[kind == k], n[kind == k]) for k in KINDS if yes[kind == k].any()}
    return Judge(trees, steps, lessons=int(sum(right.values()) + n.sum()))


def spans(text: str, model: Judge) -> list[dict]:
    """Base spans and the candidates that the model accepts, by kind, then start."""
    return all_spans([text], model)[0]


def all_spans(texts: list[str], model: Judge) -> list[list[dict]]:
    """The same for many texts, whose candidates are judged together."""
    proposed = []
    for text in texts:
        base = base_spans(text)
        known = set(base)
        found = [c for c in dict.fromkeys(candidates(text)) if c not in known]
        proposed.append((base, found, [features(text, *c) for c in found] if model.trees else []))
    scores = iter(model.judge([c for _, found, _ in proposed for c in found], [x for _, _, rows in proposed for x in rows]))
    return [chosen(base, found, [next(scores) for _ in found]) for base, found, _ in proposed]


def chosen(base: list[tuple[str, int, int]], found: list[tuple[str, int, int]], scores: list[float]) -> list[dict]:
    """Base spans and those of the candidates found that fit, best score first."""
    out = [{"kind": k, "start": a, "end": b, "score": 1.0, "base": True} for k, a, b in base]
    taken = sorted((a, b, k, False) for k, a, b in base)
    for score, (kind, start, end) in sorted(zip(scores, found), key=lambda x: (-x[0], x[1][1] - x[1][2], x[1][1], x[1][0])):
        if score >= 0 and fits(taken, kind, start, end):
            taken.insert(place(taken, start), (start, end, kind, True))
            out.append({"kind": kind, "start": start, "end": end, "score": score, "base": False})
    return sorted(out, key=lambda s: (KINDS.index(s["kind"]), s["start"], s["end"]))


def place(taken: list[tuple], start: int) -> int:
    low, high = 0, len(taken)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if taken[mid][0] < start else (low, mid)
    return low


def fits(taken: list[tuple], kind: str, start: int, end: int) -> bool:
    """Whether a span overlaps nothing chosen, but for base spans of its own kind that it extends."""
    at = place(taken, start)
    near = taken[max(0, at - 8):at]
    while at < len(taken) and taken[at][0] < end:
        near.append(taken[at])
        at += 1
    return all(b <= start or a >= end or k == kind and not added and start <= a and b <= end for a, b, k, added in near)


def mark(batches: Iterator[pa.RecordBatch], model: Judge) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
    for batch in blocks(batches, "text"):
        found = all_spans(batch.column("text").to_pylist(), model)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])


def personal_spans(docs: DataFrame, model: Judge) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text); spans are (kind, start, end, score, base) by kind, then start.

    Places are code points, the end exclusive.  base tells the patterns proper, whose score is 1, from what the model adds.
    Base spans of different kinds may overlap; an added one overlaps nothing but base spans of its kind that it extends, and of
    overlapping ones the best score stays, then the longer, then the first.  A missing or empty text has none.  Rows are
    treated one by one, repeated ids and missing ones included; other columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return documents(docs, "doc_id", "text").mapInArrow(
        lambda it: mark(it, model), f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, score: double, base: boolean>>")


def redact(batches: Iterator[pa.RecordBatch], model: Judge) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        out = []
        for text in batch.column("text").to_pylist():
            pieces, at = [], 0
            for s in sorted(spans(text or "", model), key=lambda s: (s["start"], -s["end"])):
                if s["end"] > at:
                    pieces.append(text[at:s["start"]] if s["start"] >= at else "")
                    pieces.append(f"[{s['kind'].upper()}]" if s["start"] >= at else "")
                    at = s["end"]
            out.append("".join([*pieces, text[at:]]) if text is not None else None)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names], batch.schema.names)


def redacted(docs: DataFrame, model: Judge) -> DataFrame:
    """``docs`` with all its columns, each text with its spans replaced by their kind in brackets; a missing text stays missing."""
    return docs.mapInArrow(lambda it: redact(it, model), docs.schema)
