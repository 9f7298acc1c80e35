"""From raw documents to packed training sequences, in four stages.

quality    documents that the classifier scores below its threshold go
near_dups  of documents whose five-word shingles are 80 % alike one stays
secrets    secrets in the texts are replaced by a mark
packing    what is left is cut into sequences of at most 2048 tokens

Every stage but the last returns the columns that it was given, those of documents.
Between stages the documents are a durable table, so each stage starts from what is on
disk.

Defined cases: of a group of near copies the row with the least id stays, of equal ids
the one with the least text hash, of rows repeated in full one; null ids come last, and
rows are told apart by id and text, so null or repeated ids hide no copy. Null and
empty texts pass every stage that does not reject them by score, and rows without
words are never copies. Texts of any length are read whole. Other columns of documents
pass through all stages but the last, whatever their names; lang, source and n_chars may
be missing. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import ngram_join, quality, queries, secret_scan
from clausewright.llm.durable import durable

def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs.select("text", F.struct("*").alias("_row")), queries.quality_model(docs, labels))
    return scored.filter("predicted = 1").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return ngram_join.first_of_each_group(docs, size=5, share=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; n_chars follows the text."""
    length = "n_chars" if "n_chars" in docs.columns else None
    return secret_scan.redact_secrets(docs, length_col=length)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return queries.packed(docs)


STAGES = [("quality", keep_good), ("near_dups", drop_near_duplicates), ("secrets", redact_secrets), ("packing", pack)]

#: No stage but the last could be put in SQL, and that one only without its tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
