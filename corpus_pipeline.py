"""A corpus pipeline of five operators: STAGES in order, run() for all of them.

Each stage takes and returns the columns of documents; the last adds the token ids and drops the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, decontamination, frames, ngram_join, quality, queries, secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with docs' own columns.

    Null, empty and very short texts go; texts of any length are judged whole; repeated rows are judged alike; an
    empty table stays empty; columns named like the rules' own figures are handed on as they are.
    """
    figures = {c: f"__quality_{c}" for c in quality.FIELDS}
    return quality.quality_rules(docs, fields=figures).where(F.col(figures["kept"])).drop(*figures.values())


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id, null ones last. Five words, 0.8.

    Texts without words (nulls too) are no copies of others and stay. Of rows with one doc_id the one whose text has
    the least hash stays, if they are near copies of each other; rows with one doc_id and one text are one.
    Texts of any length are compared whole; an empty table stays empty; other columns, whatever their names, stay.
    """
    return ngram_join.one_of_each(docs, rule=ngram_join.JoinRule(n=5, percent=80))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates, with docs' own columns.

    Null and empty texts have no words and stay; long ones are searched whole; repeated rows are judged alike; an
    empty table stays empty; columns named like the operator's figures are handed on as they are.
    """
    return decontamination.decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars following.

    Null and empty texts stay as they are; long ones are scanned whole; repeated rows are masked alike; finds that
    overlap are one mask; an empty table stays empty; other columns, whatever their names, stay.
    """
    return secrets.masked(docs, queries.SECRET_VOCABULARY, queries.PATTERN)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts (token_ids, n_tokens), with the other columns; columns of docs with these names are replaced.

    A null text has no ids; texts of any length are encoded whole; repeated rows are encoded alike; an empty table
    stays empty.
    """
    out = bpe.encoded(docs, queries.BYTE_VOCABULARY, queries.PATTERN).withColumn("n_tokens", F.size("token_ids").cast("long"))
    return out.drop("text")


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("encoding", encoding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = frames.settled(docs, "stage")
    return docs
