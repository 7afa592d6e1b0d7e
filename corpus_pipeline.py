"""The corpus pipeline: from ``documents`` to packed sequences, a stage at a time.

Every stage is written as Parquet into the folder of ``spark.checkpoint.dir`` and read again as the next one's input, so a
lost executor costs no more than the stage at hand. All stages but the last return the columns of ``documents``. They
take null and empty texts, repeated rows, null ids and extra columns as the operators define them, and an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curadrift.llm import jaccard, language, packing, repeats, surrogates, vocab
from curadrift.llm.common import release, stored, table

ARROW_ROWS = "2000"


def _small_batches(spark: SparkSession) -> None:
    """Rows hold whole texts: fewer of them in an Arrow batch keep Python workers small beside a full heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a language go."""
    _small_batches(spark)
    return language.in_a_language(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the least ``doc_id``."""
    _small_batches(spark)
    return jaccard.one_of_each(docs)


def repeated_passages_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that stand in two places are cut from the texts; documents of which nothing is left stay, empty."""
    _small_batches(spark)
    return repeats.without_repeats(docs, None, repeats.PASSAGE)


def private_data_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Addresses, numbers, secrets and names are replaced by surrogates."""
    return surrogates.without_private_data(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, a row each."""
    _small_batches(spark)
    return packing.packed(docs, vocab.vocabulary_path("byte_bpe_50k.tiktoken"), with_ids=False).drop("row_no")


STAGES = [
    ("language_id", in_a_language),
    ("jaccard_join", one_of_near_copies),
    ("suffix_dedup", repeated_passages_cut),
    ("surrogates", private_data_replaced),
    ("packing", packed),
]

#: Learned languages, MinHash, suffix order and token ids have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return docs
