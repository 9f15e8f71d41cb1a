"""Intermediate tables in the shared folder, and how the tasks find this package."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickerloom.session import shared_dir
from tickerloom.sources.versions import Files


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it isn't installed (one machine, or a shared folder)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


OPEN: list[list[str]] = []  # the lists of the blocks of ``cleared`` that are open


@contextmanager
def cleared(spark: SparkSession) -> Iterator[list[str]]:
    """Remove the tables that were kept inside, but those that are taken out of the list."""
    made: list[str] = []
    OPEN.append(made)
    try:
        yield made
    finally:
        OPEN.remove(made)
        files = Files(spark)
        for path in made:
            files.delete(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder once and go on from it.

    Its size is then known, so that joins choose their way by it, and a lost executor
    costs no more than reading it again.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    for made in OPEN:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, with a missing text as an empty one."""
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "text" else F.col(c) for c in columns])


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, label): at most ``sample`` rows of ``docs`` whose id has a label, for fitting a model on the driver.

    ``labels`` has doc_id and ``label``; an id that is labelled more than once has the larger one, and rows without
    id or label are left out.  Only texts of at most ``most_bytes`` bytes count, if that is given.  Of the ids that have
    such a text those with the smallest hashes are taken, so that what is broadcast and
    what comes out are bounded by ``sample``, whatever the input.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    fits = F.lit(True) if most_bytes is None else F.octet_length("text") <= most_bytes
    texts = documents(docs, "doc_id", "text").where(fits)
    if most_bytes is not None:
        marks = marks.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = marks.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(sample)
    return texts.join(F.broadcast(chosen), "doc_id").limit(sample)
