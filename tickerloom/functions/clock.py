"""Time helpers: everything is UTC, stored without zone, compared in whole seconds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, SparkSession, functions as F

UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")

# Fixed value: how a publishing time is spelled inside a hashed key.
KEY_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
KEY_TIME_ZONE = " +0000"


def in_utc() -> None:
    """Refuse a session of another zone, in which casts between the two kinds of timestamp would shift."""
    spark = SparkSession.getActiveSession()
    zone = spark.conf.get("spark.sql.session.timeZone") if spark else "UTC"
    if zone not in UTC_NAMES:
        raise ValueError(f"all times are UTC: set spark.sql.session.timeZone to UTC, not {zone}")


def from_epoch_ms(ms: Column) -> Column:
    """Epoch milliseconds to a timestamp without zone."""
    in_utc()
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def epoch_second(ts: Column) -> Column:
    """Number of the second that ``ts`` falls into.

    Differences of this count second boundaries, not elapsed time: from .999 to
    11.000 are 11 seconds, not 10.
    """
    in_utc()
    return F.unix_seconds(ts.cast("timestamp"))


def to_second(ts: Column) -> Column:
    """Drop the fraction of a second, keep a timestamp without zone."""
    in_utc()
    return F.date_trunc("second", ts.cast("timestamp")).cast("timestamp_ntz")


def key_time(ts: Column) -> Column:
    """The text of a timestamp as it enters a hashed key."""
    in_utc()
    return F.concat(F.date_format(ts, KEY_TIME_FORMAT), F.lit(KEY_TIME_ZONE))


def now(as_of: datetime | str | None = None) -> Column:
    """The audit clock: the given moment, or the time of the query."""
    if as_of is None:
        return F.current_timestamp()
    return F.lit(as_of).cast("timestamp")


def now_utc(as_of: datetime | str | None = None) -> Column:
    in_utc()
    return now(as_of).cast("timestamp_ntz")
