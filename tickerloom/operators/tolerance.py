"""Matching each row with the latest record near a moment in time.

Whether a record is near depends only on the second it falls into, so per key and second
one record can win: the latest.  Reducing to that first bounds every later step.  The
latest record in ``[t - before, t + after]`` is the last one up to ``t + after``, provided
it is not older than ``t - before``.  Time is cut into spans at least as long as the window,
so that last record lies in the span of ``t + after`` or is the last of the span before.
No pairs are formed: the cost is linear in both inputs, and a key with many records is
spread over its spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.functions.clock import epoch_second
from tickerloom.operators.lookup import lookup_join
from tickerloom.session import settle

MIN_SPAN_SECONDS = 600


def latest_within(rows: DataFrame, records: DataFrame, on: Sequence[str], row_time: str, record_time: str,
                  carry: Sequence[str], before: int, after: int,
                  prefer: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``carry`` columns of the latest matching record, NULL where none matches.

    Distances are in seconds and both ends count.  Records with equal times are told apart
    by ``prefer`` and then by the carried values; the greatest wins.
    """
    on = list(on)
    rows = rows.withColumn("_until", epoch_second(F.col(row_time)) + after)
    asked = settle(rows.select(*on, "_until").filter(F.col("_until").isNotNull()).distinct())

    # Only records near some row matter: the ends of the questions reach the scan as filters.
    first, last = asked.agg(F.min("_until"), F.max("_until")).first()
    reach = before + after
    if first is None:
        first = last = 0  # no questions, so no record will be an answer
    stored_as = dict(records.dtypes)[record_time]

    def moment(second: int) -> Column:
        return F.timestamp_seconds(F.lit(second)).cast(stored_as)

    near = records.filter((F.col(record_time) >= moment(first - reach)) & (F.col(record_time) < moment(last + 1)))

    best = F.max(F.struct(record_time, *prefer, *[c for c in carry if c not in prefer and c != record_time]))
    winners = (near.groupBy(*on, epoch_second(F.col(record_time)).alias("_second"))
               .agg(best.alias("_best")))

    span = max(reach, MIN_SPAN_SECONDS)
    by_span = winners.withColumn("_span", F.floor(F.col("_second") / span))
    last_of_span = (by_span.groupBy(*on, "_span")
                    .agg(F.max(F.struct("_second", "_best")).alias("_last"))
                    .select(*on, F.col("_last._second").alias("_second"),
                            F.col("_last._best").alias("_best"), (F.col("_span") + 1).alias("_span")))
    questions = asked.select(*on, F.col("_until").alias("_second"),
                             F.lit(None).cast(winners.schema["_best"].dataType).alias("_best"),
                             F.floor(F.col("_until") / span).alias("_span"), F.lit(1).alias("_asks"))
    known = by_span.unionByName(last_of_span).withColumn("_asks", F.lit(0))

    so_far = (Window.partitionBy(*on, "_span").orderBy("_second", "_asks")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    answers = (known.unionByName(questions)
               .withColumn("_best", F.last("_best", ignorenulls=True).over(so_far))
               .filter("_asks = 1")
               .filter(epoch_second(F.col("_best." + record_time)) >= F.col("_second") - reach)
               .select(*on, F.col("_second").alias("_until"),
                       *[F.col("_best." + c).alias(c) for c in carry]))
    return lookup_join(rows, answers, [*on, "_until"], "left").drop("_until")
