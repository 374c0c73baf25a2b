"""What the two vector searches share: valid vectors, matrices, ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_EVERY = 20


def valid_vectors(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", zero: bool = True, double: bool = True) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part; v is array<double>, or as it was unless `double`.

    Rows with a null id, a null vector or a null or non-finite component do not, nor,
    unless `zero`, do zero vectors. Vectors of all lengths stay: an inner product needs
    two of one length, so a search compares a vector with those of its own `dim`.
    """
    own = F.col(f"`{embedding}`")
    v = F.transform(own, lambda x: x.cast("double")) if double else own
    rows = embeddings.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"), F.size(own).alias("dim"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL").where(finite)
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def query_vectors(vectors: DataFrame, every: int = QUERY_EVERY) -> DataFrame:
    """The query set: one row for each id that is divisible by `every`; of an id's several vectors the least one."""
    rows = vectors.where(F.col("vec_id") % every == 0)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """[rows, dimension] of a list column whose lists are of one length."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def codes(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """[rows, dim] unsigned bytes of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), dim)


def by_dimension(batch: pa.RecordBatch):
    """(dimension, row numbers) of the vectors in a batch."""
    dims = batch.column("dim").to_numpy()
    return [(int(d), np.flatnonzero(dims == d)) for d in np.unique(dims)]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: highest score, then smallest vec_id, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
