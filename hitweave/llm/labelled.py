"""Labelled rows for the classifiers: which may be learnt from, and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no classifier may learn from: a fifth, by their id's checksum. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from.

    Rows with a null id or label are left out and an id labelled both ways counts once, as 1.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    return rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def training_rows(labels: DataFrame, label: str, each: int) -> DataFrame:
    """(doc_id, label): up to `each` learnable rows of either class, chosen by a hash of the id."""
    rows = learnable(labels, label)
    chosen = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(each) for k in (0, 1)]
    return chosen[0].unionByName(chosen[1])
