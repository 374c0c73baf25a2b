"""Connected components: in a task for groups of bounded size, by repeated contraction beyond."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.session import cut, discard, stored

#: Different edges of a group that one task takes, some 100 MB, and edges of all groups of a task.
BOUND, SHARE = 500_000, 250_000
#: Edges that a task thins out together.
TOGETHER = 1 << 20


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", within: tuple[str, ...] = (), bound: int = BOUND) -> DataFrame:
    """Weakly connected components of an edge list.

    Returns one row per node that has an edge: the `within` columns, `node`, and
    `component`, the smallest node of the component. Nodes only meet inside equal
    `within` values (for example an event id), never where one of those is null. Self
    loops give a component of their own node. Rows with a null end are ignored.

    Each task first replaces the edges it reads by fewer that join the same nodes, so
    what is shuffled grows with nodes. A group of equal `within` values that then has up
    to `bound` different edges is labelled in one task. In larger ones each round draws a new order of the nodes by a seeded
    hash, points every node at the first of itself and its neighbours, replaces both
    ends of every edge by those and drops what has become a loop; what is left within
    the bound is labelled in a task. Whatever the ids and the shape, at most three
    quarters of the nodes are expected to be left after a round, so rounds are
    logarithmic; there is no bound on them. The maps are composed from the last, the
    smallest, to the first, and the smallest node of each class is taken at the end.
    Minima are combined before the shuffle, and what has many rows for one node is a
    materialised table when it is joined, so that adaptive execution can split it. The
    edges of a round are written, as sizes estimated over many rounds would grow without end.
    """
    keys = list(within)
    start = edges.select(*keys, F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    start = stored(_tidy(_thinned(start, keys), keys))
    most, total = _sizes(start, keys)
    if most <= bound:
        return _labelled(start, keys, total)
    sizes = stored(start.groupBy(*keys).agg((F.count("*") > bound).alias("large"))) if keys else None
    pick = lambda large: start.join(sizes.where("large" if large else "NOT large"), keys, "left_semi") if keys else start
    named = _contracted(pick(True), keys, bound)
    return named.unionByName(_labelled(start.join(sizes.where("large"), keys, "left_anti"), keys, total)) if keys else named


def _thinned(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (keys, a, b) with the same components, of those that a task has read together one for each node at the most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= TOGETHER:
                waiting = thin(waiting).to_batches()
                n = sum(x.num_rows for x in waiting)
                if n > TOGETHER // 2:
                    yield from waiting
                    waiting, n = [], 0
        if waiting:
            yield from thin(waiting).to_batches()

    def thin(waiting: list[pa.RecordBatch]) -> pa.Table:
        rows = pa.Table.from_batches(waiting).combine_chunks()
        named = np.ones(rows.num_rows, bool)
        for k in keys:
            named &= pc.is_valid(rows[k]).to_numpy()
        rest, rows = rows.filter(pa.array(~named)), rows.filter(pa.array(named)).combine_chunks()
        if not rows.num_rows:
            return rest
        group = np.zeros(rows.num_rows, np.int64)
        for k in keys:
            values = rows[k].combine_chunks().dictionary_encode()
            group = group * len(values.dictionary) + values.indices.to_numpy()
            group = np.unique(group, return_inverse=True)[1]
        ends = pa.concat_arrays([rows[c].combine_chunks() for c in ("a", "b")]).dictionary_encode()
        most, place = len(ends.dictionary), ends.indices.to_numpy()
        node, first = first_of_each(group * most + place[: rows.num_rows], group * most + place[rows.num_rows :])
        apart = node != first
        apart |= ~np.isin(node, first[apart])  # a node that only leads to itself
        node, first = node[apart], first[apart]
        at = np.unique(group, return_index=True)[1]
        own = [rows[k].take(pa.array(at[node // most])) for k in keys]
        return pa.concat_tables([pa.table([*own, *(ends.dictionary.take(pa.array(x % most)) for x in (node, first))], schema=rows.schema), rest])

    return edges.mapInArrow(run, edges.schema)


def _contracted(start: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """Components by rounds of contraction, until what is left of each group is within the bound."""
    nodes = start.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct()
    live = stored(start.where("a <> b"))
    maps = []
    while True:
        most, total = _sizes(live, keys)
        if most <= bound:
            break
        draw = lambda c, k=len(maps): F.xxhash64(c, F.lit(k))
        both = live.select(*keys, F.col("a").alias("node"), F.col("b").alias("to")).union(live.select(*keys, F.col("b"), F.col("a")))
        first = both.groupBy(*keys, "node").agg(F.min_by("to", draw("to")).alias("to"))
        parent = cut(first.select(*keys, "node", F.when(draw("to") < draw("node"), F.col("to")).otherwise(F.col("node")).alias("to")))
        maps.append(parent)
        up_a = parent.select(*keys, F.col("node").alias("a"), F.col("to").alias("pa"))
        up_b = parent.select(*keys, F.col("node").alias("b"), F.col("to").alias("pb"))
        step = live.join(up_a, [*keys, "a"]).select(*keys, F.col("pa").alias("a"), "b")
        step = step.distinct().join(up_b, [*keys, "b"]).select(*keys, "a", F.col("pb").alias("b"))
        before, live = live, stored(_tidy(step.where("a <> b"), keys))
        discard(before)

    root = cut(_labelled(live, keys, total).withColumnRenamed("component", "to"))
    for parent in reversed(maps):
        root = cut(_follow(parent, root, keys))
    least = cut(root.groupBy(*keys, "to").agg(F.min("node").alias("component")))
    named = root.join(least, [*keys, "to"]).select(*keys, "node", "component")
    return nodes.join(named, [*keys, "node"], "left").select(*keys, "node", F.coalesce("component", "node").alias("component"))


def _sizes(edges: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Most edges of a group, and all edges."""
    row = edges.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return row[0] or 0, row[1] or 0


def first_of_each(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different nodes of the edges (a, b), sorted, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(parent[x], parent[y]), np.maximum(parent[x], parent[y])
        apart = low != high
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(parent, high, low)
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    return nodes, nodes[parent]


def _labelled(edges: DataFrame, keys: list[str], total: int) -> DataFrame:
    """(keys, node, component) of groups that each fit in a task; different groups may share one."""
    types = [f.dataType.simpleString() for f in edges.select(*keys, "a").schema]
    names = [*keys, "node", "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        group: tuple = ()
        for batch in batches:
            own = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True)) or [()] * batch.num_rows
            cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if at == end:
                    continue
                if waiting and own[at] != group:
                    yield made(waiting)
                    waiting = []
                waiting.append(batch.slice(at, end - at))
                group = own[at]
        if waiting:
            yield made(waiting)

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        a, b = (rows.column(c).to_numpy() for c in ("a", "b"))
        nodes, first = first_of_each(a, b)
        if any(rows.column(k)[0].as_py() is None for k in keys):
            first = nodes
        own = [rows.column(k).combine_chunks().take(pa.array(np.zeros(len(nodes), np.int64))) for k in keys]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(x, rows.column("a").type) for x in (nodes, first))], names=names)

    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, [*types, types[-1]], strict=True))
    if keys:
        parts = max(1, -(-total // SHARE), edges.sparkSession.sparkContext.defaultParallelism)
        edges = edges.repartition(parts, *keys).sortWithinPartitions(*keys)
    else:
        edges = edges.repartition(1)
    return edges.mapInArrow(run, schema)


def _follow(parent: DataFrame, later: DataFrame, keys: list[str]) -> DataFrame:
    """`parent` with each `to` replaced by what the later rounds made of it."""
    up = later.select(*keys, F.col("node").alias("to"), F.col("to").alias("__root"))
    return parent.join(up, [*keys, "to"], "left").select(*keys, "node", F.coalesce("__root", "to").alias("to"))


def _tidy(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Larger end first, without repeats."""
    return edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
