"""Message queue source and sink.

The Kafka connector is not part of Spark's own jars, so these two functions need it on
the cluster; tests and local runs use ``landed_messages``, which reads files of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tickerloom import names, schemas

MAX_MESSAGES = 5_000_000


def topic_stream(spark: SparkSession, servers: str, topics: tuple[str, ...] = tuple(f.topic for f in names.FEEDS),
                 max_messages: int | None = MAX_MESSAGES) -> DataFrame:
    """All topics from their earliest offset, as text keys and values.

    A trigger takes at most ``max_messages``, so that a long backlog comes in several batches; none is left out.
    """
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest"))
    if max_messages:
        reader = reader.option("maxOffsetsPerTrigger", max_messages)
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"),
                                "topic", "partition", "offset", "timestamp")


def landed_messages(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of JSON-lines files with the columns of a queue record."""
    reader = spark.readStream.schema(schemas.QUEUE_RECORD)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def publish(messages: DataFrame, servers: str) -> None:
    """Write ``key, value, topic`` rows to the queue."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def publish_stream(messages: DataFrame, servers: str, checkpoint: str) -> DataStreamWriter:
    return (messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("checkpointLocation", checkpoint))
