"""Versioned tables, levelled stores, and refreshes of touched parts alone."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tests.test_streams import bars, entity, headline, quote, trade, write_messages
from tickerloom import names, schemas
from tickerloom.operators.dedup import keep_latest
from tickerloom.plans import incremental, refresh
from tickerloom.sources import bronze
from tickerloom.sources.tables import Tables
from tickerloom.sources.versions import Conflict, Levels, Versions

AS_OF = "2025-01-02 00:00:00"


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n int")


def test_a_replace_that_fails_leaves_the_old_rows(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    tables.replace("t", numbers(spark, 1, 2))
    reader = tables.read("t")

    @F.udf("int")
    def broken(n):
        if n == 4:
            raise ValueError("killed half way")
        return n

    with pytest.raises(Exception, match="killed half way"):
        tables.replace("t", numbers(spark, 3, 4).repartition(2).select(broken("n").alias("n")))
    assert rows(tables.read("t"), "n") == [(1,), (2,)]
    tables.replace("t", tables.read("t").union(numbers(spark, 5)))  # a table may be made from itself
    assert rows(tables.read("t"), "n") == [(1,), (2,), (5,)]
    assert rows(reader, "n") == [(1,), (2,)]  # a reader keeps the version it began with
    assert rows(tables.read_or_empty("t", "n int"), "n") == [(1,), (2,), (5,)]
    assert rows(tables.read_or_empty("none", "n int")) == []


def test_of_two_writers_the_later_one_fails(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))
    table.replace(numbers(spark, 1))
    state = table.state()
    table.replace(numbers(spark, 2))
    with pytest.raises(Conflict):
        table.commit(state)
    assert rows(table.read()) == [(2,)]
    commit = tmp_path / "t" / "commits" / f"{3:020}"
    commit.write_text('{"sche')  # a writer that has not finished
    assert rows(table.read()) == [(2,)]
    with pytest.raises(Conflict):
        table.replace(numbers(spark, 3))


def test_parts_are_replaced_and_old_data_goes(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"))

    def put(parts, *pairs):
        table.replace_parts(spark.createDataFrame(pairs, "n int, _part string"), parts)

    put(["a", "b"], (1, "a"), (2, "b"))
    put(["b", "c"], (3, "c"))
    assert rows(table.read(), "n") == [(1,), (3,)] and rows(table.stored(["c", "none"]), "n") == [(3, "c")]
    put(["a"], (4, "a"))
    before = {p.parent for p in tmp_path.rglob("*.parquet")}
    table.vacuum(keep=1)
    assert rows(table.read(), "n") == [(3,), (4,)]
    assert len({p.parent for p in tmp_path.rglob("*.parquet")}) == 2 < len(before)


def test_levels_hold_few_folders_and_the_latest_rows(spark, tmp_path):
    def reduce(df):
        return keep_latest(df, ["k"], ["at"])

    store = Levels(spark, str(tmp_path / "s"), reduce, F.pmod(F.col("k"), F.lit(3)).cast("string"), fan=3)
    expected = {}
    for number in range(20):
        batch = [(k, (number * 7 + k) % 11, number) for k in range(number % 5, 12, 1 + number % 3)]
        for k, at, v in batch:
            expected[k] = max(expected.get(k, (-1, -1)), (at, v))
        df = spark.createDataFrame(batch, "k int, at int, v int")
        store.add(df, "run", number)
        if number % 6 == 0:
            store.add(df, "run", number)  # delivered again
        state = store.state()["parts"]
        assert all(sum(x == level for x, _ in entries) < 3 for entries in state.values() for level, _ in entries)
    assert {r.k: (r.at, r.v) for r in store.current().collect()} == expected
    assert max(len(entries) for entries in state.values()) <= 2 * 3


MODELS = (names.INT_TICKS, names.FCT_STREAM, names.FCT_FEATURES, names.FCT_HISTORY, names.INT_NEWS, names.FCT_NEWS_INPUTS, names.DIM_ASSETS)


def deliver(spark, tmp_path, number, *messages):
    write_messages(tmp_path / f"in{number}", number, *messages)
    batch = spark.read.schema(schemas.QUEUE_RECORD).json(str(tmp_path / f"in{number}"))
    bronze.append_batch(batch, str(tmp_path / "bronze"), f"batch-{number}")


def same_as_whole(spark, tmp_path, tables):
    whole = Tables(spark, str(tmp_path / "whole"))
    refresh.transform(whole, str(tmp_path / "bronze"), AS_OF)
    for model in MODELS:
        ours, theirs = (t.read(model).drop("dw_inserted_at", "created_at") for t in (tables, whole))
        assert ours.dtypes == theirs.dtypes
        assert sorted(map(repr, rows(ours))) == sorted(map(repr, rows(theirs))), model


def test_incremental_refresh_equals_a_whole_one(spark, tmp_path):
    tables, root = Tables(spark, str(tmp_path / "models")), str(tmp_path / "bronze")
    day = 86_400_000
    assert not any(incremental.transform(tables, root, AS_OF).values())  # nothing has arrived
    deliver(spark, tmp_path, 1, trade("NVDA", 100.0, 0), trade("MSFT", 7.0, day), quote(1, 0, 50), quote(200_000, 5, 51), bars("NVDA", d30="98", d31="102"),
            headline("Bitcoin rally"), headline("weather"), entity("u", "NVDA"))
    incremental.transform(tables, root, AS_OF)
    same_as_whole(spark, tmp_path, tables)
    # Late copies, a correction a day later, a redelivered batch, and tickers without bars.
    deliver(spark, tmp_path, 2, trade("NVDA", 100.0, 0), trade("AMZN", 5.0, 3 * day), quote(1, day, 60))
    deliver(spark, tmp_path, 1, trade("NVDA", 100.0, 0), trade("MSFT", 7.0, day), quote(1, 0, 50), quote(200_000, 5, 51), bars("NVDA", d30="98", d31="102"),
            headline("Bitcoin rally"), headline("weather"), entity("u", "NVDA"))
    incremental.transform(tables, root, AS_OF)
    same_as_whole(spark, tmp_path, tables)
    # A bar that changes a baseline makes all features of its tickers' group anew, and nothing else.
    deliver(spark, tmp_path, 3, bars("NVDA", d31="110"), (names.BARS.topic, {"meta_data": {"2. Symbol": "MSFT", "3. Last Refreshed": "2025-01-01"}, "time_series": {"2024-12-31": {"open": "1", "high": "2", "low": "1", "close": "9", "volume": "1"}}}))
    made = incremental.transform(tables, root, AS_OF)
    same_as_whole(spark, tmp_path, tables)
    assert made[names.INT_TICKS] == [] and made[names.FCT_FEATURES] and made[names.INT_NEWS] == []
    assert not any(incremental.transform(tables, root, AS_OF).values())


def test_only_touched_folders_and_parts_are_read(spark, tmp_path, monkeypatch):
    tables, root = Tables(spark, str(tmp_path / "models")), str(tmp_path / "bronze")
    day = 86_400_000
    deliver(spark, tmp_path, 1, *[trade("NVDA", 100.0 + k, k * day) for k in range(5)], *[quote(k * 100_000, k, 50) for k in range(5)])
    incremental.transform(tables, root, AS_OF)
    deliver(spark, tmp_path, 2, trade("NVDA", 200.0, 2 * day))
    before = {f for p in tables.versions(names.FCT_FEATURES).state()["parts"].values() for _, f in p}
    read = []
    plain = Versions.stored
    monkeypatch.setattr(Versions, "stored", lambda self, parts=None, state=None: read.append(plain(self, parts, state)) or read[-1])
    folders = []
    monkeypatch.setattr(bronze, "read_folders", lambda s, r, t, some, f=bronze.read_folders: folders.extend(some) or f(s, r, t, some))
    made = incremental.transform(tables, root, AS_OF)
    monkeypatch.undo()
    assert folders == ["ingest_date=2025-01-01/batch=batch-2"]
    assert len(made[names.FCT_FEATURES]) == len(made[names.INT_TICKS]) == 1
    # The plans' scans name the files of one part each.
    read = [df for df in read if df.inputFiles()]
    assert read and all(len({f.rsplit("/", 1)[0] for f in df.inputFiles()}) == 1 for df in read)
    after = {f for p in tables.versions(names.FCT_FEATURES).state()["parts"].values() for _, f in p}
    assert len(after - before) == 1 and len(before - after) == 1
    same_as_whole(spark, tmp_path, tables)


def test_incremental_refresh_is_a_whole_cycle(spark, tmp_path):
    deliver(spark, tmp_path, 1, trade("NVDA", 100.0, 0), bars("NVDA", d30="98", d31="102"), entity("u", "NVDA"))
    made = refresh.refresh(Tables(spark, str(tmp_path / "models")), str(tmp_path / "bronze"), "2025-01-01 00:00:30", whole=False)
    assert [r.stock_ticker for r in made.collect()] == ["NVDA"]
