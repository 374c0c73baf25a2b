"""Dealing rows over parts, equal ones too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.session import cut


def dealt(records: DataFrame, size: Column, seed: int, most: int) -> DataFrame:
    """Adds __hw_tie, which deals rows over parts: a hash of all columns and, where equal rows have more than `most` of `size` together, their number.

    Such rows are counted before the shuffle, kept once and made again with numbers,
    so the dealing is the same in every run. Columns of maps are not taken.
    """
    plain = [F.col(f"`{c}`") for c in records.columns]
    tied = records.withColumn("__hw_tie", F.xxhash64(*plain, F.lit(seed)))
    heavy = tied.groupBy("__hw_tie").agg(F.count("*").alias("n"), F.max(size).alias("size")).where((F.col("n") > 1) & (F.col("n") * F.col("size") > most))
    heavy = cut(heavy.select("__hw_tie"))  # one row for each `most` of size at most
    if heavy.isEmpty():
        return tied
    light = tied.join(heavy, "__hw_tie", "left_anti")
    again = tied.join(heavy, "__hw_tie", "left_semi").groupBy(*plain, "__hw_tie").agg(F.count("*").alias("__hw_n"))
    again = again.withColumn("__hw_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__hw_n")))).withColumn("__hw_tie", F.xxhash64("__hw_tie", "__hw_i"))
    return light.select(*plain, "__hw_tie").unionByName(again.select(*plain, "__hw_tie"))
