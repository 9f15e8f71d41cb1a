"""Evaluation and accuracy as streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tickerloom import names
from tickerloom.plans import evaluation
from tickerloom.sources.versions import Versions
from tickerloom.streaming.ingest import triggered


def retry_pending(new_ticks: DataFrame, read_predictions: Callable[[], DataFrame],
                  read_stream: Callable[[], DataFrame], read_outcomes: Callable[[], DataFrame],
                  target: str, checkpoint: str, as_of: str | None = None, keep_days: int | None = None,
                  run: str = "outcomes", continuous: bool = False, **how) -> StreamingQuery:
    """Settle pending predictions as ticks arrive.

    A batch looks at the predictions that one of its ticks may settle, and at those whose moment has come since the batch
    before: their ticks may have come earlier.  So the questions, and with them the scan of ``read_stream``, reach
    no further back than the batch's own ticks.  Predictions that are stored only after their moment and that no new tick is near
    to are left to the scheduled evaluation, which looks at all.  Until when batches have looked is noted next to the checkpoint; a
    repeated batch begins where its first attempt did, and finds what that settled no longer pending.

    Pending predictions never expire unless ``keep_days`` says so.  ``how`` is passed on to
    :func:`tickerloom.plans.evaluation.evaluate`.
    """
    looks = Versions(new_ticks.sparkSession, f"{checkpoint.rstrip('/')}-looks")

    def append(ticks: DataFrame, number: int) -> None:
        noted = looks.state()["notes"]
        since = noted.get("since") if noted.get("batch") == number else noted.get("until")
        until = str(as_of or datetime.now(timezone.utc).replace(tzinfo=None))
        looks.note(batch=number, since=since, until=until)
        due = evaluation.pending(read_predictions(), read_outcomes(), until)
        if keep_days is not None:
            newest = evaluation.now_utc(until) - F.expr(f"INTERVAL {keep_days} DAYS")
            due = due.filter(F.col("target_window") >= newest)
        if since is not None:
            fresh = F.col("target_window") > F.lit(since).cast("timestamp_ntz")
            due = due.filter(fresh).unionByName(evaluation.near_ticks(due.filter(~fresh), ticks, how.get("seconds", names.MATCH_SECONDS)))
        evaluation.store(evaluation.evaluate(due, read_stream(), as_of, **how), target, f"{run}-{number}")

    writer = new_ticks.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return triggered(writer, continuous).start()


def daily_accuracy(new_outcomes: DataFrame, read_evaluated: Callable[[], DataFrame], target: str, checkpoint: str,
                   continuous: bool = False) -> StreamingQuery:
    """Keep hits and errors per ticker and day equal to the stored outcomes, however late one comes.

    Each batch makes the days that it touches anew; ``target`` is partitioned by day.
    """

    def replace(batch: DataFrame, _: int) -> None:
        days = batch.filter("actual_price IS NOT NULL").select(F.to_date("target_window").alias("target_day")).distinct()
        stored = read_evaluated().withColumn("target_day", F.to_date("target_window"))
        (evaluation.daily_totals(stored.join(days, "target_day", "left_semi").drop("target_day"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target_day").parquet(target))

    writer = new_outcomes.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint)
    return triggered(writer, continuous).start()
