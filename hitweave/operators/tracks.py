"""Components of edges, tracks made of them, and label streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.functions.scalars import bound
from hitweave.operators.components import connected_components
from hitweave.operators.edges import degrees, ends
from hitweave.operators.walks import walk_components  # noqa: F401

MIN_SIZE = 3


def components(edges: DataFrame) -> DataFrame:
    """(event_id, node, component): weakly connected components, named by their smallest node."""
    return connected_components(edges, "src", "dst", ("event_id",))


def classified(edges: DataFrame, labels: DataFrame, least: int = MIN_SIZE) -> DataFrame:
    """(event_id, component, size, kind): small, simple (no node has two edges in or out) or complex."""
    nodes = degrees(ends(edges), edges).join(labels.select("event_id", F.col("node").alias("hit_id"), "component"), ["event_id", "hit_id"])
    stats = nodes.groupBy("event_id", "component").agg(F.count("*").alias("size"), F.max("in_degree").alias("i"), F.max("out_degree").alias("o"))
    kind = F.when(F.col("size") < least, "small").when((F.col("i") <= 1) & (F.col("o") <= 1), "simple").otherwise("complex")
    return stats.select("event_id", "component", "size", kind.alias("kind"))


def simple_tracks(labels: DataFrame, kinds: DataFrame) -> DataFrame:
    """(event_id, component, hits): the nodes of each simple component, by id."""
    simple = kinds.where("kind = 'simple'").select("event_id", "component")
    return labels.join(simple, ["event_id", "component"]).groupBy("event_id", "component").agg(F.array_sort(F.collect_list("node")).alias("hits"))


def complex_edges(edges: DataFrame, labels: DataFrame, kinds: DataFrame) -> DataFrame:
    """Edges of the complex components."""
    there = labels.join(kinds.where("kind = 'complex'").select("event_id", "component"), ["event_id", "component"], "left_semi")
    return edges.join(there.select("event_id", F.col("node").alias("src")), ["event_id", "src"], "left_semi")


def sorted_by_radius(tracks: DataFrame, nodes: DataFrame, radius: str = "rr") -> DataFrame:
    """Each track's hits by radius, then id."""
    keys = [c for c in tracks.columns if c != "hits"]
    long = tracks.select(*keys, F.explode("hits").alias("hit_id")).join(nodes.select("event_id", "hit_id", radius), ["event_id", "hit_id"])
    ordered = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(radius, "hit_id"))).alias("x"))
    return ordered.select(*keys, F.transform("x", lambda h: h["hit_id"]).alias("hits"))


def resolved(tracks: DataFrame, most: int, keys: tuple[str, ...] = ("event_id", "component", "ord")) -> DataFrame:
    """Tracks whose hits are each in `most` tracks of the event at the most: the longer ones keep them, then those with smaller keys.

    A hit stays in the first tracks that have it, whatever becomes of other hits, so
    hits are ranked one by one. Repeats of a hit in a track count once. Hits keep their
    order; a track that loses all of them is empty.
    """
    rows = tracks.select(*keys, F.size("hits").alias("__size"), F.posexplode(F.array_distinct("hits")).alias("__pos", "__hit"))
    first = Window.partitionBy(keys[0], "__hit").orderBy(F.desc("__size"), *keys[1:])
    kept = rows.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= most)
    lists = kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__hit"))), lambda h: h["__hit"]).alias("hits"))
    return tracks.drop("hits").join(lists, list(keys), "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<bigint>")))


def encoded(tracks: DataFrame, events: DataFrame, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(event_id, labels): an event's tracks one after the other, each ended by -1; [-1] if it has none."""
    lists = tracks.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(*order, "hits"))).alias("t"))
    flat = F.flatten(F.transform("t", lambda t: F.concat(t["hits"], F.array(F.lit(-1).cast("long")))))
    return events.select("event_id").distinct().join(lists, "event_id", "left").select("event_id", F.coalesce(flat, F.array(F.lit(-1).cast("long"))).alias("labels"))


def decoded(streams: DataFrame) -> DataFrame:
    """(event_id, ord, hits) of label streams. [-1] is one empty track; an unended run is dropped. Each stream is cut where it lies."""
    labels = F.col("labels")
    ends = F.filter(F.transform(labels, lambda x, i: F.when(x == -1, i)), lambda i: i.isNotNull())
    begin = lambda at, k: F.when(k == 0, F.lit(0)).otherwise(F.get(at, k - 1) + 1)
    run = lambda at, end, k: F.filter(F.slice(labels, begin(at, k) + 1, end - begin(at, k)), lambda x: x != -1)
    runs = bound(ends, lambda at: F.transform(at, lambda end, k: run(at, end, k)))
    return streams.select("event_id", F.posexplode(runs).alias("ord", "hits"))


def track_count(streams: DataFrame) -> DataFrame:
    """(event_id, tracks): ends counted."""
    return streams.select("event_id", F.size(F.filter("labels", lambda x: x == -1)).cast("long").alias("tracks"))
