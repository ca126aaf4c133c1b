"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents; n_chars follows the text.

All stages: an empty table gives an empty one; rows are documents of their own, so null and repeated ids lose nothing
unless a stage says so; columns other than doc_id, text and n_chars pass through untouched, whatever they're called, except
names that begin with two underscores, which the stages use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerwright.llm import line_dedup, minhash, packing, pii, quality
from ledgerwright.llm.queries import PSEUDONYM_KEY
from ledgerwright.llm.scratch import staged


def _columns(docs: DataFrame, result: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        result = result.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return result.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts fail them; repeated rows are judged alike.

    Labels without a document, and labelled documents without text, add nothing to the trusted counts.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_documents(docs, labels).where("kept").select(*docs.columns)


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that lie in a window seen before; a document that loses all its lines goes.

    Rows with one id and one text count as one and keep the same lines; the next stage drops all but one of them. Another id with
    the same text is a later occurrence and loses its windows. Null and empty texts hold no window and stay as they are.
    """
    shorter = line_dedup.dedup_lines(docs)
    return _columns(docs, shorter.where("NOT (n_removed_lines > 0 AND text = '')"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8; that with the smallest id stays.

    Repeated rows are a group; a repeated id with unlike texts keeps both; null and empty texts resemble nothing and stay.
    """
    return minhash.drop_near_duplicates(docs).select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by pseudonyms; null texts stay null, empty ones empty, every row stays."""
    return _columns(docs, pii.pseudonymise(docs, PSEUDONYM_KEY))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences; a null or empty text is one piece with the end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_windows),
    ("near_duplicates", near_duplicates),
    ("pii", pseudonyms),
    ("packing", best_fit_packing),
]

#: Tokenizer ids and keyed permutations cannot be expressed in SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
