"""Corpus pipeline: toxicity, line deduplication, near-duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared folder and
rereads it as the next stage's input.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm import line_templates, nb_linear, secret_ledger, simhash_anchors
from windrow.llm.common import stored, table
from windrow.llm.queries import pack_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects (probability 0.5 or more) go; the others keep all columns as they are."""
    model = nb_linear.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return model.score(docs.select(*COLUMNS)).where("score < 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later lines of templates or exact lines that recur across documents go; every document stays, if need be with an empty text."""
    return _documents(line_templates.drop_repeated_lines(docs.select(*COLUMNS), exact=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingle similarity 0.8 or more stays: its smallest id."""
    return simhash_anchors.drop_near_copies(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return _documents(secret_ledger.redact(docs.select(*COLUMNS), secret_ledger.BlobLedger.open(spark)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: a trained classifier, XXH64 and a tokenizer stand between the table and the result: SQL cannot express them, tests/llm does
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
