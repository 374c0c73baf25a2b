"""Predicted edges against true ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.operators.numbering import row_numbers

KEYS = ["event_id", "src", "dst"]


def _matchable(edges: DataFrame, index: str, is_undirected: bool) -> DataFrame:
    """(event_id, a, b, index): one row for each edge, in either direction if undirected, with its least (undirected: largest) index."""
    ends = (F.least("src", "dst"), F.greatest("src", "dst")) if is_undirected else (F.col("src"), F.col("dst"))
    rows = edges.select("event_id", ends[0].alias("__a"), ends[1].alias("__b"), F.col(index).alias("__i"))
    return rows.groupBy("event_id", "__a", "__b").agg((F.max if is_undirected else F.min)("__i").alias(index))


def _matched(edges: DataFrame, others: DataFrame, index: str, is_undirected: bool) -> DataFrame:
    ends = (F.least("src", "dst"), F.greatest("src", "dst")) if is_undirected else (F.col("src"), F.col("dst"))
    found = edges.withColumns({"__a": ends[0], "__b": ends[1]}).join(_matchable(others, index, is_undirected), ["event_id", "__a", "__b"], "left").drop("__a", "__b")
    return found.withColumns({"y": F.col(index).isNotNull(), index: F.coalesce(index, F.lit(-1).cast("long"))})


def graph_intersection(pred: DataFrame, truth: DataFrame, is_undirected: bool = False, unique: bool = True) -> DataFrame:
    """Predicted edges with `y`, whether they are true, and `truth_id`, the index of the matching true edge or -1.

    `truth` has a column truth_id. Of repeated true edges the least index counts.
    Undirected, an edge matches either way round, and the largest index counts.
    Unless the predicted edges are `unique`, repeats of them are dropped first.
    """
    return _matched(pred if unique else pred.dropDuplicates(KEYS), truth, "truth_id", is_undirected)


def truth_to_pred(pred: DataFrame, truth: DataFrame, is_undirected: bool = False, unique: bool = True) -> DataFrame:
    """True edges with `y`, whether they were predicted, and `pred_id`, the index of the predicted edge or -1.

    `pred` has a column pred_id; otherwise as graph_intersection, the other way round.
    """
    return _matched(truth if unique else truth.dropDuplicates(KEYS), pred, "pred_id", is_undirected)


def truth_found(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """True edges with `y`, whether they were predicted."""
    hit = pred.select(*KEYS).distinct().withColumn("y", F.lit(True))
    return truth.join(hit, KEYS, "left").withColumn("y", F.coalesce("y", F.lit(False)))


def efficiency_purity(pred: DataFrame, truth: DataFrame, signal: str | None = None) -> DataFrame:
    """One row: total_eff, total_pur and f1, and with a Boolean `signal` column of truth also signal_eff and signal_pur."""
    both = truth_found(pred, truth)
    signal_col = F.col(signal) if signal else F.lit(True)
    t = both.agg(F.count("*").alias("n_true"), F.count_if("y").alias("hit"), F.count_if(signal_col).alias("n_signal"), F.count_if(F.col("y") & signal_col).alias("hit_signal"))
    p = pred.select(*KEYS).distinct().agg(F.count("*").alias("n_pred"))
    rows = t.crossJoin(p)  # one row each
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = rows.select(part("hit", "n_true").alias("total_eff"), part("hit_signal", "n_signal").alias("signal_eff"), part("hit", "n_pred").alias("total_pur"), part("hit_signal", "n_pred").alias("signal_pur"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("signal_eff") * F.col("total_pur"), F.col("signal_eff") + F.col("total_pur")), F.lit(0.0)))


def hinge_loss(edges: DataFrame, margin: float) -> DataFrame:
    """One row, `loss`: weighted hinge over edges (d2, y, weight).

    False edges with a weight, and those of negative weight, lose what they lack to
    the squared margin; true ones of positive weight lose their distance.
    """
    w, d = F.col("weight"), F.col("d2")
    negative = F.avg(F.when((~F.col("y") & (w != 0)) | (w < 0), F.greatest(F.lit(0.0), margin * margin - d) * F.abs(w)))
    positive = F.avg(F.when(F.col("y") & (w > 0), d * F.abs(w)))
    return edges.agg((F.coalesce(negative, F.lit(0.0)) + F.coalesce(positive, F.lit(0.0))).alias("loss"))


def evaluation(near: DataFrame, truth: DataFrame, margin: float, weight: float = 1.0) -> DataFrame:
    """One row: the hinge loss of the near pairs (event_id, src, dst, d2) and their efficiency and purity against the true edges."""
    marked = graph_intersection(near, truth).withColumn("weight", F.lit(float(weight)))
    loss, found = hinge_loss(marked, margin), efficiency_purity(near, truth)
    return loss.crossJoin(found)  # one row each


def draw(*parts) -> Column:
    """A whole number from 0 to 2**32 - 1, the digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def sampled_queries(nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n nodes of each event, the same in every run; each task keeps n of an event before the shuffle."""
    order = Window.partitionBy("event_id").orderBy(draw("event_id", "hit_id", F.lit(seed)), "hit_id")
    return nodes.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def random_pairs(queries: DataFrame, nodes: DataFrame, each: int, seed: int = 42) -> DataFrame:
    """`each` pseudo-random partners in the event for every query, found by position."""
    placed = row_numbers(nodes.select("event_id", F.col("hit_id").alias("dst")), ["event_id"], ["dst"], "place")
    sizes = nodes.groupBy("event_id").agg(F.count("*").alias("n"))
    draws = queries.join(sizes, "event_id").select("event_id", F.col("hit_id").alias("src"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(each)), lambda k: F.pmod(draw("event_id", "hit_id", k, F.lit(seed)), F.col("n")))).alias("place"))
    return draws.join(placed, ["event_id", "place"]).select(*KEYS)
