"""What refreshes leave on disk."""

import os
import random

from pyspark.sql import functions as F

from tests.helpers import raw, rows
from tickerloom import names
from tickerloom.plans import incremental, staging
from tickerloom.session import shared_dir
from tickerloom.sources import bronze
from tickerloom.sources.tables import Tables
from workload import inputs


def size(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(folder.removeprefix("file:")) for f in files)


def articles(n, letters, entities):
    chance = random.Random(9)
    return [{"uuid": f"u{i}", "title": "t", "description": "%0*x" % (letters, chance.getrandbits(4 * letters)), "language": "en",
             "published_at": "2024-01-01T00:00:00Z", "entities": [{"symbol": str(k)} for k in range(entities)]} for i in range(n)]


def test_a_stored_table_leaves_no_shuffle_files(spark, tmp_path):
    def blocks():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if "shuffle" in found.apply(i).getName()}

    before = blocks()
    Tables(spark, str(tmp_path)).replace("t", spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert blocks() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_only_the_versions_to_keep_stay(spark, tmp_path):
    tables, data = Tables(spark, str(tmp_path), keep=1), tmp_path / "t" / "data"
    tables.replace("t", spark.range(5))
    again = tables.replace("t", tables.read("t").unionByName(spark.range(5, 7)))
    assert rows(again, "id") == [(i,) for i in range(7)] and len(list(data.iterdir())) == 1
    (data / "of-another-writer").mkdir()
    tables.replace("t", spark.range(3))
    assert tables.read("t").count() == 3 and len(list(data.iterdir())) == 2


def test_texts_that_rows_per_entity_repeat_are_stored_about_once(spark, tmp_path):
    given = raw(spark, *articles(40, 40_000, 20)).repartition(2).checkpoint()
    assert Tables(spark, str(tmp_path)).replace("news", staging.entity_news(given)).count() == 800
    assert size(str(tmp_path)) < 2 * 40 * 40_000


def test_merges_keep_no_copy_of_the_raw_rows(spark, tmp_path):
    tables, root, sent = Tables(spark, str(tmp_path / "models"), keep=1), str(tmp_path / "bronze"), articles(200, 3000, 3)
    shared_dir(spark)
    held = size(spark.sparkContext.getCheckpointDir())
    for day, some in (("2024-01-10", sent[:150]), ("2024-01-11", sent[100:])):
        bronze.append_batch(inputs.queue_records(raw(spark, *some), names.ENTITY_NEWS, day), root, day)
        incremental.transform(tables, root, "2024-01-20 12:00:00", groups=2)
    assert tables.read(names.INT_NEWS).count() == tables.read(names.FCT_NEWS_INPUTS).count() == 600
    assert size(spark.sparkContext.getCheckpointDir()) - held < 200 * 3000 / 4
    assert size(str(tmp_path / "models")) < 4 * 200 * 3000
