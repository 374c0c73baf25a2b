"""Contracting the chains of a directed graph, by pointer doubling.

A link is an edge that is the only one out of its source and the only one into its
target; chains are the paths of links. A walk that enters a chain takes all of it, so it
only has to know its length. Each round doubles how far every node of a chain can see
back, so rounds are logarithmic in the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.session import discard, stored

KEYS = ["event_id", "component"]


def links_of(edges: DataFrame) -> DataFrame:
    """The edges that are the only one out of their source and the only one into their target."""
    one = lambda end, other: edges.groupBy("event_id", end).agg(F.count("*").alias("n"), F.max(other).alias(other)).where("n = 1").select("event_id", "src", "dst")
    return edges.join(one("src", "dst"), ["event_id", "src", "dst"], "left_semi").join(one("dst", "src"), ["event_id", "src", "dst"], "left_semi").select(*edges.columns)


def chain_places(links: DataFrame) -> DataFrame:
    """(event_id, node, head, pos, inner): of each node that a link leads to, the first node of its chain, how many links lie between and the sum of their scores.

    Nodes of cycles of links have no first node and are not there.
    """
    state = stored(links.select("event_id", F.col("dst").alias("node"), F.col("src").alias("head"), F.lit(1).cast("long").alias("pos"), F.col("score").alias("inner"), F.lit(True).alias("on")))
    sight, most = 1, state.count()
    while sight <= 2 * most:
        back = state.select("event_id", F.col("node").alias("head"), F.col("head").alias("__head"), F.col("pos").alias("__pos"), F.col("inner").alias("__inner"))
        both = state.join(back, ["event_id", "head"], "left")
        before, state = state, stored(both.select("event_id", "node", F.coalesce("__head", "head").alias("head"), (F.col("pos") + F.coalesce("__pos", F.lit(0))).alias("pos"), (F.col("inner") + F.coalesce("__inner", F.lit(0.0))).alias("inner"), F.col("__head").isNotNull().alias("on")))
        discard(before)
        if state.where("on").isEmpty():
            break
        sight *= 2
    return state.where("NOT on").drop("on")


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and members of the graph whose nodes are the chains of `edges`, named by their first node.

    `edges` are (event_id, component, src, dst, score) without repeats. Nodes are
    (event_id, component, node, length, second, inner), edges as before, from chain to
    chain, members (event_id, node, head, pos) of chains of two nodes or more. Nodes on
    cycles of links are left out.
    """
    links = stored(links_of(edges))
    places = stored(chain_places(links))
    chains = places.groupBy("event_id", F.col("head").alias("node")).agg(F.max("pos").alias("last"), F.min_by("node", "pos").alias("second"), F.max_by("inner", "pos").alias("inner"))
    nodes = edges.select(*KEYS, F.explode(F.array("src", "dst")).alias("node")).distinct()
    first = nodes.join(links.select("event_id", F.col("dst").alias("node")), ["event_id", "node"], "left_anti")
    heads = first.join(chains, ["event_id", "node"], "left").select(*KEYS, "node", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("length"), "second", F.coalesce("inner", F.lit(0.0)).alias("inner"))
    others = edges.join(links, ["event_id", "src", "dst"], "left_anti").join(places.select("event_id", F.col("node").alias("src"), "head"), ["event_id", "src"], "left")
    return heads, others.select(*KEYS, F.coalesce("head", "src").alias("src"), "dst", "score"), places.select("event_id", "node", "head", "pos")


def expanded(paths: DataFrame, members: DataFrame) -> DataFrame:
    """`paths` (event_id, component, ord, hits, score) with the members of each chain in place of its first node."""
    steps = paths.select(*KEYS, "ord", "score", F.posexplode("hits").alias("step", "head"))
    own = steps.select(*KEYS, "ord", "score", "step", F.lit(0).cast("long").alias("pos"), F.col("head").alias("node"))
    more = steps.join(members, ["event_id", "head"]).select(*KEYS, "ord", "score", "step", "pos", "node")
    hits = F.array_sort(F.collect_list(F.struct("step", "pos", "node")))
    return own.unionByName(more).groupBy(*KEYS, "ord").agg(F.transform(hits, lambda x: x["node"]).alias("hits"), F.first("score").alias("score"))
