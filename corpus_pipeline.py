"""From raw documents to packed training sequences, in stages that each read what the one before has written.

quality (10) drops documents scored as bad; line_dedup (8) takes repeated and nearly equal lines out;
near_duplicates (3) leaves one document of each group; decontamination (7) drops documents with
passages of the benchmark; packing (5) returns the pieces of the sequences.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickerloom.llm import contamination, line_dedup, near_duplicates, packing, quality
from tickerloom.llm.queries import table
from tickerloom.llm.store import cleared, kept, ready, remainder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the lines' chain takes for good, learned from the labels outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    chain = quality.learn(docs, labels)
    return quality.scored(docs, chain, "quality_score").where(F.col("quality_score") >= quality.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line once: its first occurrence stays.  Documents of which nothing is left go; n_chars follows the text."""
    ready(spark)
    left = line_dedup.without_repeated_lines(docs)
    return left.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 0.8 of their 5-word shingles; rows without an id stay."""
    ready(spark)
    return near_duplicates.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no 10-word window of the benchmark occurs."""
    found = contamination.contamination(docs, table(spark, sf_dir, "benchmark"), keyed=True)
    gone = kept(found.where(F.size("items") > 0).select("doc_id", "key").distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["key"])
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    ready(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [("quality", keep_good), ("line_dedup", drop_repeated_lines), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]
ORACLE_SQL = None  # SQL expresses neither the chain's scores nor the packing; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each result written and read again; what a stage has kept besides goes with it."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with cleared(spark) as made:
            docs = kept(stage(spark, docs, sf_dir), name)
            last = made.pop()
            made += before
        before = [last]
    return STAGES[-1][1](spark, docs, sf_dir)
