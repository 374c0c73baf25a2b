"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.session import cut

#: Bits of monotonically_increasing_id that number the rows of a partition.
_PLACE = (1 << 33) - 1


def row_numbers(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds `name`, a long from 0 in each group of equal keys, in the given total order.

    A window would hold each group in one task. Here rows are range-partitioned by
    keys and order and written, so that a large group lies in several partitions; a
    row's number is its place in the partition, less where its group starts there, plus
    what earlier partitions have of the group. Only those counts go through a window.
    """
    placed = cut(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order))
    at = F.monotonically_increasing_id()
    placed = placed.select("*", F.shiftright(at, 33).cast("int").alias("__part"), at.bitwiseAND(F.lit(_PLACE)).alias("__at"))
    same = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    parts = placed.groupBy(*same, F.col("__part").alias("__p")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*(f"__k{i}" for i in range(len(keys)))).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    match = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(parts, match).select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).cast("long").alias(name))
