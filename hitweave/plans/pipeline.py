"""From hits to label streams, many events at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.functions.scalars import radius2
from hitweave.operators import blocks as B
from hitweave.operators import edges as E
from hitweave.operators import hits as H
from hitweave.operators import nn, tracks
from hitweave.operators.neighbours import radius_join
from hitweave.schema import PipelineConfig
from hitweave.session import cut, discard, stored


def build_tracks(edges: DataFrame, nodes: DataFrame, config: PipelineConfig) -> DataFrame:
    """(event_id, kind, component, ord, hits) from oriented, scored edges: simple components and walks."""
    live = E.score_cut(edges, config.cc_cut, strict=True)
    live = cut(live.select("event_id", "src", "dst", "score"))
    labels = cut(tracks.components(live))
    kinds = tracks.classified(live, labels)
    simple = tracks.simple_tracks(labels, kinds).select("event_id", F.lit(0).alias("kind"), "component", F.lit(0).alias("ord"), "hits")
    rest = tracks.complex_edges(live, labels, kinds)
    if config.walk == "dp":
        rest = E.dp_max_add_cut(rest, config.walk_min, config.walk_max)
    elif config.walk != "road":
        rest = E.max_add_cut(rest, config.walk_min, config.walk_max, config.walk == "lookback")
    walks = tracks.walk_components(rest, labels, config.walk, config.walk_min, config.walk_max, config.allow_node_reuse)
    found = simple.unionByName(walks.select("event_id", F.lit(1).alias("kind"), "component", "ord", "hits"))
    return tracks.sorted_by_radius(found, nodes) if config.sort_tracks else found


def _of_large_events(edges: DataFrame, least: int = 2) -> DataFrame:
    """`E.large_enough` of a stored table; where no event is too small, as in most batches, the edges go through no join."""
    return edges if edges.groupBy("event_id").count().where(F.col("count") < least).isEmpty() else E.large_enough(edges, least)


def label_streams(edges: DataFrame, nodes: DataFrame, config: PipelineConfig) -> DataFrame:
    """(event_id, labels) for every event of `nodes`."""
    return tracks.encoded(build_tracks(edges, nodes, config), nodes, ("kind", "component", "ord"))


def run(hits: DataFrame, weights: dict, config: PipelineConfig) -> DataFrame:
    """(event_id, labels) of a batch of events.

    `hits` is (event_id, hit_id, feature columns). `weights` holds layer lists, as nn
    takes them: embedding (or trunk, source and target), filter, the graph layers
    filter_gnn that come before it, and rounds, edge_encoder, node_encoder, decoder,
    size, aggregate, in_out_diff and concat of the interaction network. Events that are too
    small or have too few edges give [-1].
    """
    columns = list(dict.fromkeys([*config.embedding.features, *([] if config.cluster_gnn else config.gnn.features)]))
    source = H.clean(hits, columns) if config.clean else hits
    r, z = F.col("r"), F.col("z")
    if config.scaled_radius:
        scale = dict(zip(config.embedding.features, config.embedding.scales, strict=True))
        r, z = r / scale["r"], z / scale["z"]
    source = cut(source.withColumn("rr", radius2(r.cast("double"), z.cast("double"))))
    large = H.large_enough(source)
    inputs = H.stage_input(large, config.embedding)
    features = list(config.embedding.features)
    if config.two_embeddings:
        points = cut(nn.embed_both(inputs, features, weights["trunk"], weights["source"], weights["target"]))
        query, database = (points.select("event_id", "hit_id", F.col(c).alias("v")) for c in ("src_emb", "tgt_emb"))
    else:
        query = database = cut(nn.embed(inputs, features, weights["embedding"]).select("event_id", "hit_id", "v"))
    near = radius_join(query, database.select("*"), config.r_max, config.k_max)
    pairs = stored(near.select("event_id", "src", "dst"))
    edges, parts = B.oriented_distinct(pairs, source, "rr", config.break_ties)
    edges = stored(edges)
    discard(pairs)
    kept = _of_large_events(edges)
    nodes = inputs.select("event_id", "hit_id", F.array(*(F.col(c) for c in features)).alias("x"))
    filtered = E.score_cut(B.gnn_filter(nodes, kept, parts, weights.get("filter_gnn", []), weights["filter"]), config.filter_cut, strict=config.strict_filter)
    filtered = stored(filtered.drop("score"))
    kept = _of_large_events(filtered)
    if "rounds" in weights:
        gnn = H.pixel_gnn_input(large) if config.cluster_gnn else H.stage_input(large, config.gnn)
        x = nn.mlp(gnn.withColumn("__x", F.array(*(F.col(c) for c in config.gnn.features))), "__x", weights["node_encoder"], "x0")
        if "eta" in config.gnn.features:
            first, x = B.edge_features, x.select("event_id", "hit_id", "x0", F.array(*(F.col(c).cast("double") for c in ("r", "phi", "z", "eta"))).alias("f"))
        else:  # without edge features, the encoded ends stand in
            first, x = B.encoded_ends, x.select("event_id", "hit_id", "x0")
        scored = B.interaction_gnn(x, kept, parts, first, weights["edge_encoder"], weights["rounds"], weights["decoder"], weights["size"], weights.get("aggregate", "sum"), weights.get("in_out_diff", True), weights.get("concat", False))
    else:
        scored = B.gnn_filter(nodes, kept, parts, weights.get("filter_gnn", []), weights["filter"])
    return label_streams(scored, source, config)
