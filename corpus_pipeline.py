"""The corpus pipeline: five stages from raw documents to packed token sequences.

Every stage reads all that the one before it kept; ``run`` writes each stage's rows as Parquet and reads them again. A stage
may also be called by itself or composed with others without writing: its intermediate tables stay until the process ends.
``run`` owns those of its own stages and deletes them, and the rows of the stage before, once a stage's rows are written.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and columns of any further name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixmine.llm import decontaminate, line_dedup, near_dedup, packing, quality, store


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier accepts; null, empty and wordless texts are rejected, equal rows fare alike."""
    return quality.accepted(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others hold too; a column n_chars follows the text.

    Of documents with one line the largest doc_id keeps it (a null doc_id is the smallest); rows with equal doc_id and
    text count as one document. A null text stays null.
    """
    out = line_dedup.drop_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies; of rows equal in doc_id and text one stays.

    Rows without a doc_id stay, as do texts without words, which resemble nothing.
    """
    return near_dedup.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; null and empty texts and items match nothing, equal rows fare alike."""
    return decontaminate.clean(docs, store.read(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences; every row is packed, a null or empty text as its end token alone."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: No SQL: tokenisation and the trained classifier are beyond it; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; the result stays until the process ends."""
    docs = store.read(spark, sf_dir, "documents")
    folder = store.fresh_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        with store.owner():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            store.delete(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
