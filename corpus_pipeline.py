"""The corpus pipeline: five stages over ``documents``, each writing Parquet that the next one reads.

Toxic documents go, then those that a quality rule rejects; repeated lines keep one occurrence, and a document that is left
without any word by that goes too; of near duplicates one document stays; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm import line_dedup, near_dup, packing, quality, toxicity
from maskwell.llm._common import cut
from maskwell.llm.queries import read, tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def with_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.quality_filter(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere already; n_chars follows the text. Only a document that
    loses lines and is left without a word goes: nothing of it remains to keep."""
    out = line_dedup.dedup_lines(docs, exact_words=1)
    out = out.filter((F.col("_n_removed") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return near_dup.drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("quality rules", with_quality),
    ("line dedup", without_repeated_lines),
    ("near duplicates", without_near_duplicates),
    ("packing", packed),
]

#: A learned model, sketches and packing can't be said in SQL. Each stage is one operator, tested by itself: against SQL, all pairs or
#: its library, and toxicity on planted words.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs
