"""The corpus pipeline: STAGES over documents; each stage's rows are written as Parquet and read again.

1. toxicity: documents that the classifier calls toxic go.
2. line_dedup: later repeated runs of lines are cut out of the texts; a document of which nothing is left goes.
3. ngram_dedup: one document of each group of near duplicates (five words, similarity 0.8 or more) stays.
4. decontamination: documents with a benchmark window of ten words go.
5. packing: the rest is tokenised and packed; one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stockflow.llm.decontam import drop_contaminated
from stockflow.llm.frames import bounded_batches, stored, table
from stockflow.llm.line_dedup import drop_repeated_lines
from stockflow.llm.ngram_join import ngram_dedupe
from stockflow.llm.packing import pack_documents
from stockflow.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return ngram_dedupe(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_dedup", ngram_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: no stage but the fourth can be said in SQL; tests hold the pipeline against its stages and brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
