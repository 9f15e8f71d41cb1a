"""The registered queries: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickerloom.llm import contamination, conversations, fingerprints, language, line_dedup, near_duplicates, packing, periodic_runs, personal_data, quality, token_counts, toxicity, warc
from tickerloom.llm.store import ready, remainder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held_out = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 4) == 2
    model = toxicity.learn(documents, table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.toxicity(documents, *model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence", "cosines")


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    read = warc.records(warc.read_archives(*warc.write_archives(pages), with_data=False))
    kind = dict(pages.dtypes)["page_id"]
    return read.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


ORACLE["op6_warc"] = """
WITH payloads AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
firsts AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM payloads)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM firsts"""

NEAR_WORDS = 20


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=NEAR_WORDS)
    return contamination.summary(found, "near_items")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents")).drop("line")


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held_out = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 4) == 2
    found = language.languages(documents, language.learn(documents.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held_out = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 0
    chain = quality.learn(documents, table(spark, sf_dir, "labels").where(~held_out))
    return quality.scored(documents.select("doc_id", "text"), chain).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = personal_data.personal_spans(documents, personal_data.learn(documents))

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"size(filter(spans, s -> s.base AND s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
                        F.transform("spans", lambda s: s["score"]).alias("scores"))


def damaged(rows: DataFrame) -> DataFrame:
    """A quarter of the turns, chosen by their ids, dropped, emptied, robbed of their sentence ends, repeated or given to the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.select("conv_id", "turn", "role", "text", (F.crc32(key.cast("binary")) % 20).alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(F.coalesce("text", F.lit(" ")), "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.repair(damaged(rows)), rows)


def repeat_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tenth of the documents, chosen by their ids, end in words repeated with a period; the rest stay."""
    for batch in batches:
        texts = batch.column("text")
        change = {}
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
            if h % 10 == 0 and (words := texts[i].as_py().encode().split()):
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                change[i] = b" ".join(words[:a] + [words[a + k % p] for k in range(n - a)]).decode()
        if change:
            texts = pa.array([change.get(i, t) for i, t in enumerate(texts.to_pylist())], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), digest=True, change=repeat_words)
    longest = F.reduce("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"),
                       lambda best, run: F.when(best.isNull() | (run["length"] > best["length"]), run).otherwise(best))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period",
        F.expr("longest.length * 1000 div longest.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), "collapsed_sha256", "n_words")
