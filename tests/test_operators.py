import random
from datetime import timedelta

import pytest
from pyspark.sql import Window, functions as F

from tests.helpers import rows, ts
from tickerloom.operators import dedup, lookup, rolling
from tickerloom.operators.asof import latest_before
from tickerloom.operators.tolerance import latest_within


def ticks(spark, data):
    return spark.createDataFrame(data, "ticker string, at timestamp_ntz, source string, price double")


def test_keep_latest_is_stable(spark):
    data = [(random.Random(i).randrange(20), random.Random(-i).choice([None, 1, 2, 3]), i % 7) for i in range(400)]
    df = spark.createDataFrame(data, "k int, o int, v int")
    once = dedup.keep_latest(df, ["k"], ["o"])
    assert once.count() == len({k for k, _, _ in data})
    expected = {}
    for k, o, v in data:
        rank = (float("inf") if o is None else o, v)
        expected[k] = max(expected.get(k, (-1, -1)), rank)
    assert {r.k: (float("inf") if r.o is None else r.o, r.v) for r in once.collect()} == expected
    assert rows(dedup.keep_latest(once, ["k"], ["o"]), "k") == rows(once, "k")
    assert rows(dedup.keep_latest(df.union(df), ["k"], ["o"]), "k") == rows(once, "k")


def test_dedup_reduces_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = dedup.keep_latest(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_keep_any(spark):
    df = spark.createDataFrame([(1, ["b"]), (1, ["a"]), (2, None), (None, ["x"]), (None, ["x"])], "k int, c array<string>")
    assert rows(dedup.keep_any(df, ["k"]), "k") == [(None, ["x"]), (1, ["a"]), (2, None)]
    assert rows(dedup.keep_any(df.select("k"), ["k"]), "k") == [(None,), (1,), (2,)]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_both_ways_of_a_lookup_agree(spark, how):
    rng = random.Random(3)
    facts = spark.createDataFrame([(rng.choice([1, 1, 1, 1, 2, 3, None]), i) for i in range(2000)], "k int, v int")
    table = spark.createDataFrame([(1, "a"), (3, "c"), (4, "d"), (None, "n")], "k int, name string")
    plain = rows(facts.join(table, ["k"], how), "v")
    assert rows(lookup.lookup_join(facts, table, ["k"], how), "v") == plain
    assert rows(lookup.lookup_join(facts, table, ["k"], how, max_bytes=0), "v") == plain
    assert rows(lookup.skew_join(facts, table, ["k"], how, pieces=50, min_rows=1), "v") == plain


def test_large_key_is_cut_into_pieces(spark):
    facts = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)))
    copies = facts.unionByName(spark.range(3000, numPartitions=6).select(F.lit(7).alias("id"), F.lit(-2).alias("k")))
    table = spark.createDataFrame([(-1, "hot"), (-2, "copies")], "k long, name string")
    joined = lookup.skew_join(copies, table, ["k"], "left", pieces=20, min_rows=1)
    assert joined.groupBy("name").count().collect() is not None
    assert {r["name"]: r["count"] for r in joined.groupBy("name").count().collect()} == {"hot": 2000, "copies": 3000, None: 1000}


def match(spark, targets, records, **how):
    left = spark.createDataFrame([(i, t, ts(at)) for i, (t, at) in enumerate(targets)], "id int, ticker string, target timestamp_ntz")
    got = latest_within(left, ticks(spark, [(t, ts(at), s, p) for t, at, s, p in records]), ["ticker"], "target", "at",
                        ["price"], **{"before": 10, "after": 10, "prefer": ["source"], **how})
    return [r.price for r in got.orderBy("id").collect()]


def test_tolerance_edges(spark):
    target = [("A", "2025-01-01T00:01:00")]
    for at, hit in [("00:01:10", True), ("00:00:50", True), ("00:01:10.999", True), ("00:01:11", False),
                    ("00:00:49.999", False), ("00:01:00", True)]:
        assert match(spark, target, [("A", f"2025-01-01T{at}", "s", 5.0)]) == [5.0 if hit else None]
    assert match(spark, target, [("B", "2025-01-01T00:01:00", "s", 5.0)]) == [None]
    assert match(spark, target, []) == [None]


def test_tolerance_picks(spark):
    target = [("A", "2025-01-01T00:01:00"), ("A", "2025-01-01T00:01:00"), (None, "2025-01-01T00:01:00")]
    two = [("A", "2025-01-01T00:01:05", "s", 5.0), ("A", "2025-01-01T00:01:05.5", "r", 4.0), ("A", "2025-01-01T00:00:59", "s", 9.0)]
    assert match(spark, target, two) == [4.0, 4.0, None]
    tie = [("A", "2025-01-01T00:01:05", "r", 8.0), ("A", "2025-01-01T00:01:05", "s", 5.0), ("A", "2025-01-01T00:01:05", "s", 6.0)]
    assert match(spark, target, tie) == [6.0, 6.0, None]
    assert match(spark, target[:1], [("A", "2025-01-01T00:01:05", "s", 5.0), ("A", "2025-01-01T00:00:58", "s", 3.0)],
                 after=0) == [3.0]


@pytest.mark.parametrize("before,after,spread", [(10, 10, 2000), (700, 50, 20000), (0, 0, 300), (5, 0, 500)])
def test_tolerance_equals_plain_join(spark, before, after, spread):
    rng = random.Random(before + after)
    base = ts("2025-01-01T00:00:00")

    def moment():
        return base + timedelta(milliseconds=rng.randrange(spread * 1000))

    left = spark.createDataFrame([(i, rng.choice("AAAB"), moment()) for i in range(300)], "id int, ticker string, target timestamp_ntz")
    right = ticks(spark, [(rng.choice("AAAC"), moment(), rng.choice("xy"), float(rng.randrange(50))) for _ in range(400)])
    got = latest_within(left, right, ["ticker"], "target", "at", ["price"], before, after, prefer=["source"])
    second = "unix_seconds(cast({} as timestamp))".format
    newest = Window.partitionBy("id").orderBy(F.col("at").desc(), F.col("source").desc(), F.col("price").desc())
    plain = (left.join(right, "ticker", "left")
             .withColumn("gap", F.expr(f"{second('at')} - {second('target')}"))
             .filter(f"gap BETWEEN -{before} AND {after}")
             .withColumn("r", F.row_number().over(newest)).filter("r = 1"))
    expected = {r.id: r.price for r in plain.collect()}
    assert {r.id: r.price for r in got.collect() if r.price is not None} == expected
    assert got.count() == 300


def test_positions_and_trailing_stats(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot", "hot", "hot", "cold", None]), i, rng.random() * 100) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, i int, v double").repartition(5)
    placed = rolling.with_position(df, ["k"], ["i"])
    ranks = Window.partitionBy("k").orderBy("i")
    assert placed.withColumn("r", F.row_number().over(ranks) - 1).filter("r <> _pos OR _pos IS NULL").count() == 0

    frame = ranks.rowsBetween(-19, 0)
    plain = df.withColumn("mean", F.avg("v").over(frame)).withColumn("deviation", F.stddev_samp("v").over(frame))
    got = rolling.trailing_stats(df, ["k"], ["i"], "v", block_rows=64)
    joined = got.join(plain.select("i", F.col("mean").alias("m"), F.col("deviation").alias("d")), "i")
    off = joined.filter("abs(mean - m) > 1e-9 OR abs(coalesce(deviation, -1) - coalesce(d, -1)) > 1e-9")
    assert joined.count() == 3000 and off.count() == 0


def test_latest_trailing_equals_frames(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice("ABC"), i, rng.random()) for i in range(200)], "k string, i int, v double")
    frame = Window.partitionBy("k").orderBy("i").rowsBetween(-19, 0)
    last = Window.partitionBy("k").orderBy(F.col("i").desc())
    plain = (df.select("*", F.avg("v").over(frame).alias("m"), F.stddev("v").over(frame).alias("d"))
             .withColumn("r", F.row_number().over(last)).filter("r = 1"))
    got = {r.k: (r.latest, round(r.mean, 9), round(r.deviation, 9)) for r in rolling.latest_trailing(df, "k", "i", "v").collect()}
    assert got == {r.k: (r.v, round(r.m, 9), round(r.d, 9)) for r in plain.collect()}


@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("span", [7, 400, 10_000_000])
def test_latest_before_looks_back_without_bound(spark, same, span):
    rng = random.Random(span)
    start = ts("2024-01-01 00:00:00")

    def some(n, prices):
        return [(rng.choice(["hot", "hot", "a", "b", None]),
                 rng.choice([None, *[start + timedelta(milliseconds=500 * rng.randrange(4000))] * 9]),
                 rng.choice(["x", "y"]), rng.choice(prices)) for _ in range(n)]

    records, questions = some(150, [1.0, 2.0, None]), some(400, [0.0])
    questions += questions[:20] + [("never", start, "x", 0.0), ("hot", start - timedelta(days=9000), "x", 0.0)]
    wanted = []
    for key, at, source, _ in questions:
        # the newest record, of equal times the greatest values; a missing one is least
        fit = [(t, p is not None, p or 0.0, s) for k, t, s, p in records
               if None not in (k, t, at) and k == key and (t < at or (same and t == at))]
        best = max(fit, default=None)
        wanted.append((key, at, source, best and (best[2] if best[1] else None), best and best[3]))
    got = latest_before(ticks(spark, questions).drop("price"), ticks(spark, records).withColumnsRenamed({"at": "since", "source": "by"}),
                        ["ticker"], "at", "since", ["price", "by"], same, span)
    assert got.columns == ["ticker", "at", "source", "price", "by"]
    assert sorted(rows(got), key=repr) == sorted(wanted, key=repr)
    none = ticks(spark, []).withColumnsRenamed({"at": "since", "source": "by"})
    assert latest_before(ticks(spark, questions).drop("price"), none, ["ticker"], "at", "since", ["by"]).filter("by IS NOT NULL").count() == 0
    assert latest_before(ticks(spark, []).drop("price"), none, ["ticker"], "at", "since", ["by"]).count() == 0


def test_latest_before_asks_equal_questions_once(spark):
    asked = ticks(spark, [("hot", ts("2024-01-02 00:00:00"), "x", 1.0)] * 3000).drop("price")
    records = ticks(spark, [("hot", ts("2024-01-01 00:00:00"), "y", 2.0)] * 3000).withColumnsRenamed({"at": "since", "source": "by"})
    answered = latest_before(asked, records, ["ticker"], "at", "since", ["price"])
    assert rows(answered.groupBy("price").count()) == [(2.0, 3000)]
    plan = answered._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "Cross" not in plan
