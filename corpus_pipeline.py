"""The corpus pipeline: stages over documents, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliospark.llm import line_dedup, packing, quality_classifier, simhash_sets, source_mixing, tokens
from foliospark.llm.shared import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates are texts whose sets of five-word shingles are as similar as this.
SHINGLE, SIMILARITY = 5, 0.8


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their duplicate lines; those that lost all their words go."""
    out = line_dedup.dedup_lines(docs).where("n_lines = 0 OR n_lines > n_equal + n_near")
    return out.withColumn("n_chars", F.when(F.col("n_equal") + F.col("n_near") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group of near-duplicates by SimHash candidates and whole shingle sets; null ids come last."""
    return simhash_sets.first_of_each(docs.select(*COLUMNS), SHINGLE, SIMILARITY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in numbers that meet the target weights: some go, and those of rare categories come several times."""
    return source_mixing.repeated(source_mixing.mix(docs)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids."""
    return packing.pack_documents(docs, tokens.vocabulary(), 4096, end=1)


STAGES = [("classify", classify), ("dedup_lines", dedup_lines), ("dedup_documents", dedup_documents), ("mix", mix), ("pack", pack)]

#: The classifier is trained and the tokenizer isn't SQL's; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
