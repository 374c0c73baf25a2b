"""The stages of the corpus clean-up.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and, but for the
last, returns the columns of docs, whatever others there are besides doc_id and text.
Null texts count as empty, repeated rows are rows like others (but for near
duplicates, where they are one), and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.llm import packing, quality, secret_scan, simhash, toxicity
from hitweave.session import cut, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from docs and their labels.

    A score that ties with the limit keeps its document. Without labels all are kept.
    """
    both, model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, both, model, "__hw_score").where(F.col("__hw_score") >= quality.LEAST).drop("__hw_score")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; it learns from docs and their labels.

    The limit is 0.5 for every language: those fitted by language catch more, and
    reject more clean documents (see the README). A score that ties with it rejects.
    Without toxic labels nothing is rejected.
    """
    model, _ = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "__hw_score").where(F.col("__hw_score") < 0.5).drop("__hw_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id; rows without an id come last."""
    return simhash.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of secrets, and n_chars, if it is there, of the new text; null texts stay null."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Classifiers, hashing and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each read from what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
