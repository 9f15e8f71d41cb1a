"""Continuous landing of queue messages in the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tickerloom import names
from tickerloom.sources import bronze


def triggered(writer: DataStreamWriter, continuous: bool) -> DataStreamWriter:
    """Run on the refresh cadence, or work off what is there and stop."""
    if continuous:
        return writer.trigger(processingTime=f"{names.REFRESH_MINUTES} minutes")
    return writer.trigger(availableNow=True)


def to_bronze(messages: DataFrame, root: str, checkpoint: str, run: str = "ingest",
              continuous: bool = False) -> StreamingQuery:
    """Append every message to its raw table, each exactly once.

    A batch that is repeated after a failure replaces itself.  ``run`` names the checkpoint:
    give a new name when starting over with a new one.
    """

    def land(batch: DataFrame, number: int) -> None:
        bronze.append_batch(batch, root, f"{run}-{number}")

    writer = messages.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return triggered(writer, continuous).start()
