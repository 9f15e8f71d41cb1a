"""Each row with the newest record before its time, however far back that lies.

Equal questions are asked once, and of the records with one key and time the greatest counts.
Time is cut into spans.  The answer lies in the span of the question or is the last record of
an earlier one: the last record of every span is carried on, span by span, to the spans that
hold questions.  A window thus sorts one span of a key, or one row per span of a key, never
all rows of a key, and no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.functions.clock import epoch_second
from tickerloom.operators.lookup import lookup_join
from tickerloom.session import settle, stored

SPAN_SECONDS = 30 * 86_400


def latest_before(rows: DataFrame, records: DataFrame, on: Sequence[str], row_time: str, record_time: str,
                  carry: Sequence[str], same: bool = False, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """``rows`` with the ``carry`` columns of the newest record before ``row_time``, NULL where there is none.

    A record of the very time counts only with ``same``.  Rows without a key or time get NULL, records
    without one are never found.  Of records with equal key and time the greatest ``carry`` counts, a
    missing value being the least.  ``carry`` may not hold maps.  Both times must be of one type.
    ``rows`` are read twice, for their questions and for the answers, so they are stored first.
    """
    rows = stored(rows)
    on, carry = list(on), list(carry)
    known_key = F.lit(True)
    for c in on:
        known_key = known_key & F.col(c).isNotNull()

    def span(moment: Column) -> Column:
        return F.floor(epoch_second(moment) / span_seconds).alias("_span")

    asked = settle(rows.filter(known_key & F.col(row_time).isNotNull()).select(*on, F.col(row_time).alias("_time")).distinct())
    known = (records.filter(known_key & F.col(record_time).isNotNull())
             .groupBy(*on, F.col(record_time).alias("_time")).agg(F.max(F.struct(*carry)).alias("_best"))
             .withColumn("_span", span(F.col("_time"))))
    questions = asked.withColumn("_span", span(F.col("_time"))).withColumn("_best", F.lit(None).cast(known.schema["_best"].dataType))

    # What each span with questions takes over: its row stands before the last record of the same span.
    lasts = known.groupBy(*on, "_span").agg(F.max_by("_best", "_time").alias("_best")).withColumn("_asks", F.lit(0))
    openings = questions.select(*on, "_span", "_best").distinct().withColumn("_asks", F.lit(1))
    earlier = (Window.partitionBy(*on).orderBy("_span", F.col("_asks").desc())
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = (lasts.unionByName(openings)
             .withColumn("_best", F.last("_best", ignorenulls=True).over(earlier))
             .filter("_asks = 1 AND _best IS NOT NULL")
             .select(*on, "_span", "_best", F.lit(None).cast(asked.schema["_time"].dataType).alias("_time")))

    turn = F.col("_asks") if same else -F.col("_asks")
    so_far = (Window.partitionBy(*on, "_span").orderBy(F.col("_time").asc_nulls_first(), turn)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    answers = (known.unionByName(taken).withColumn("_asks", F.lit(0))
               .unionByName(questions.withColumn("_asks", F.lit(1)))
               .withColumn("_best", F.last("_best", ignorenulls=True).over(so_far))
               .filter("_asks = 1 AND _best IS NOT NULL")
               .select(*on, F.col("_time").alias(row_time), *[F.col("_best")[c].alias(c) for c in carry]))
    return lookup_join(rows, answers, [*on, row_time], "left")
