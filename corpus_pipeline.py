"""Corpus preparation in stages, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.llm import decontam, exact, langid, near, packing
from wellspring.llm.queries import tokenizer_path
from wellspring.llm.tables import stored, table

LEAST_SCORE = 0.5


def _kept(docs: DataFrame, found: DataFrame, digest: Column, key: str) -> DataFrame:
    """The rows of ``docs`` that ``found`` keeps, known by doc_id and a digest of the text; of repeated rows one."""
    rows = found.groupBy("doc_id", key).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    rows = stored(rows.where("kept").select(F.col("doc_id").alias("kept_id"), F.col(key).alias("kept_key"), "copies"))
    marked = docs.withColumn("_key", digest)
    met = marked["doc_id"].eqNullSafe(F.col("kept_id")) & (marked["_key"] == F.col("kept_key"))
    once = marked.join(rows.where("copies = 1"), met, "left_semi").drop("_key")
    again = rows.where("copies > 1")
    if again.isEmpty():
        return once
    return once.unionByName(marked.join(again, met, "left_semi").dropDuplicates(["doc_id", "_key"]).drop("_key"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language covers at least half of the letters."""
    labelled = table(spark, sf_dir, "documents").where(~langid.held_out())
    found = langid.identify(docs, langid.train(labelled), whole=True)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("document.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id; of repeated rows one."""
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return _kept(docs, exact.exact_duplicates(docs), digest, "text_sha256")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id; of repeated rows one."""
    return _kept(docs, near.near_duplicates(docs), F.xxhash64(F.coalesce("text", F.lit(""))), "text_hash")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id")
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path(), with_ids=False).drop("ids")


STAGES = [
    ("language", known_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs)
    return docs
