"""Edge lists (event_id, src, dst, ...): orientation, cuts, features, degrees, cuts by maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.functions.scalars import edge_features
from hitweave.operators.numbering import row_numbers

KEYS = ["event_id", "src", "dst"]


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def oriented(edges: DataFrame, nodes: DataFrame, radius: str = "rr", break_ties: bool = True) -> DataFrame:
    """Edges from the smaller radius to the larger one; equal radii by id if ties are broken."""
    s, d = (nodes.select("event_id", F.col("hit_id").alias(end), F.col(radius).alias(f"__{end}")) for end in ("src", "dst"))
    flip: Column = F.col("__src") > F.col("__dst")
    if break_ties:
        flip = flip | ((F.col("__src") == F.col("__dst")) & (F.col("src") > F.col("dst")))
    joined = edges.join(s, ["event_id", "src"]).join(d, ["event_id", "dst"])
    rest = [c for c in edges.columns if c not in KEYS]
    return joined.select("event_id", F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst"), *rest)


def oriented_by_id(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in KEYS]
    return edges.select("event_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest)


def randomly_flipped(edges: DataFrame, seed: int = 42) -> DataFrame:
    """Each edge turned round with probability one half, by a seeded digest."""
    flip = F.ascii(F.md5(F.concat_ws(":", "event_id", "src", "dst", F.lit(seed)))) % 2 == 1
    rest = [c for c in edges.columns if c not in KEYS]
    return edges.select("event_id", F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst"), *rest)


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select(*KEYS).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge both ways."""
    return edges.select(*KEYS).union(edges.select("event_id", "dst", "src"))


def large_enough(edges: DataFrame, least: int = 2) -> DataFrame:
    """Edges of the events that have at least so many."""
    kept = edges.groupBy("event_id").count().where(F.col("count") >= least).select("event_id")
    return edges.join(kept, "event_id", "left_semi")


def score_cut(edges: DataFrame, cut: float, score: str = "score", strict: bool = False) -> DataFrame:
    return edges.where(F.col(score) > cut if strict else F.col(score) >= cut)


def with_order(edges: DataFrame) -> DataFrame:
    """edge_ord from 0 in each event by (dst, src): the order that settles all ties."""
    return row_numbers(edges, ["event_id"], ["dst", "src"], "edge_ord")


def gathered(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Adds s_<column> and d_<column> of both ends."""
    for end, prefix in (("src", "s_"), ("dst", "d_")):
        edges = edges.join(nodes.select("event_id", F.col("hit_id").alias(end), *(F.col(c).alias(prefix + c) for c in columns)), ["event_id", end])
    return edges


def with_features(edges: DataFrame, scaled_nodes: DataFrame) -> DataFrame:
    """Adds the six edge features from scaled r, phi, z and eta of both ends."""
    columns = ["r", "phi", "z", "eta"]
    rest = [c for c in edges.columns if c not in KEYS]
    return gathered(edges, scaled_nodes, columns).select(*KEYS, *rest, *(c.alias(n) for n, c in edge_features().items()))


def ends(edges: DataFrame) -> DataFrame:
    """(event_id, hit_id) of the nodes that have an edge."""
    return edges.select("event_id", F.explode(F.array("src", "dst")).alias("hit_id")).distinct()


def without_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(ends(edges), ["event_id", "hit_id"], "left_semi")


def node_induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select("event_id", F.col("hit_id").alias(end)), ["event_id", end], "left_semi")
    return edges.select(*KEYS, *(c for c in edges.columns if c not in KEYS))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """in_degree and out_degree of every node, 0 where it has none."""
    counts = edges.select("event_id", F.explode(F.array(F.struct(F.col("src").alias("hit_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("hit_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    counts = counts.groupBy("event_id", "x.hit_id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    return nodes.join(counts, ["event_id", "hit_id"], "left").fillna(0, ["in_degree", "out_degree"])


def best_edge(edges: DataFrame, by: str, score: str = "score") -> DataFrame:
    """(event_id, by, best_score, best_other): each node's edge with the highest score, ties to the smaller other end."""
    other = "dst" if by == "src" else "src"
    top = F.max(F.struct(F.col(score).alias("s"), (-F.col(other)).alias("o"))).alias("top")
    return edges.groupBy("event_id", by).agg(top).select("event_id", by, F.col("top.s").alias("best_score"), (-F.col("top.o")).alias("best_other"))


def _best(by: str, score: str) -> Column:
    other = "dst" if by == "src" else "src"
    return F.row_number().over(Window.partitionBy("event_id", by).orderBy(F.desc(score), other))


def max_add_cut(edges: DataFrame, th_min: float = 0.1, th_add: float = 0.6, look_at_incoming: bool = False, score: str = "score") -> DataFrame:
    """Edges that are their source's best with th_min or more, or above th_add.

    With `look_at_incoming` they have to be, besides, an edge whose source has an
    incoming edge itself or their target's best one, both in the uncut graph.
    """
    out = F.max(score).over(Window.partitionBy("event_id", "src"))
    marked = edges.withColumn("__rank", _best("src", score)).withColumn("__max", out)
    keep = ((F.col("__rank") == 1) & (F.col("__max") >= th_min)) | (F.col(score) > th_add)
    if look_at_incoming:
        inner = edges.select("event_id", F.col("dst").alias("src")).distinct().withColumn("__inner", F.lit(True))
        marked = marked.withColumn("__in", _best("dst", score)).join(inner, ["event_id", "src"], "left")
        keep = keep & (F.coalesce("__inner", F.lit(False)) | (F.col("__in") == 1))
    return marked.where(keep).select(*edges.columns)


def dp_max_add_cut(edges: DataFrame, th_min: float = 0.1, th_add: float = 0.6, score: str = "score") -> DataFrame:
    """Edges that are best, with th_min or more, or above th_add, seen from both ends."""
    marked = edges.withColumn("__out", _best("src", score)).withColumn("__in", _best("dst", score))
    side = lambda rank: ((F.col(rank) == 1) & (F.col(score) >= th_min)) | (F.col(score) > th_add)
    return marked.where(side("__out") & side("__in")).select(*edges.columns)
