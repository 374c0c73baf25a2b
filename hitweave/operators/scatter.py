"""Aggregation of edge vectors at nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scatter(nodes: DataFrame, edges: DataFrame, columns: list[str], by: str = "dst", how: str = "sum", prefix: str = "") -> DataFrame:
    """Adds the sum (or mean) of the edges' columns at their `by` end; 0 for nodes without edges.

    Partial sums are made before the shuffle.
    """
    merge = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]
    sums = edges.groupBy("event_id", F.col(by).alias("hit_id")).agg(*(merge(c).alias(prefix + c) for c in columns))
    return nodes.join(sums, ["event_id", "hit_id"], "left").fillna(0.0, [prefix + c for c in columns])


def in_out(nodes: DataFrame, edges: DataFrame, columns: list[str], how: str = "sum", concat: bool = True) -> DataFrame:
    """Messages at both ends: in_ and out_ columns, or their sums if not `concat`."""
    both = scatter(scatter(nodes, edges, columns, "dst", how, "in_"), edges, columns, "src", how, "out_")
    if concat:
        return both
    return both.withColumns({c: F.col("in_" + c) + F.col("out_" + c) for c in columns}).drop(*(p + c for p in ("in_", "out_") for c in columns))


def batch_norm(rows: DataFrame, columns: list[str], eps: float = 1e-5, within: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Zero mean and unit (biased) variance of each column over the rows of an event.

    Moments are aggregated and joined back; a window would gather each event in one task.
    """
    moments = rows.groupBy(*within).agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.var_pop(c).alias(f"__v_{c}") for c in columns))
    out = rows.join(moments, list(within))
    return out.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.sqrt(F.col(f"__v_{c}") + eps) for c in columns}).select(*rows.columns)
