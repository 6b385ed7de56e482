"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that its predecessor kept. What a stage returns is written as
Parquet to the shared folder and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlquilt.llm import decontam, jaccard, linededup, packing, quality
from crawlquilt.llm.common import table, unused, written

#: Near duplicates share 80 of 100 shingles of five words.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Repeated line runs of so many words lose their later copies, boilerplate lines too.
LINE_WORDS = 5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing is left."""
    # Whether anything is left follows from counts: a condition on the new text would move
    # below the join and work out the text again, lines split anew for each line.
    (filled,) = unused(docs.columns, "filled")
    whole = F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) != "")
    out = linededup.dedup_lines(docs.withColumn(filled, F.size(whole)), LINE_WORDS).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col(filled)))
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, in one row."""
    return jaccard.without_repeats(written(jaccard.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: Tokenisation, resampling and the packing's dynamic programming aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
