"""The walks as rounds of joins, for components that are too large for one task.

A walk takes one start after the other, but a start only depends on earlier ones that
share a node with what it can reach. So every round takes all starts that come first
wherever they reach, in all components at once: ranks of the starts spread along the
edges, the least one wins at each node, and a start is ready if it has won everywhere.
The choice of a path is made from tables of best continuations, which grow from the
ends by one step a join. Edges are (event_id, component, src, dst, score).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.operators.components import SHARE
from hitweave.session import cut, discard, stored

#: Edges of an event that are settled in one task, some 200 MB.
BOUND = 500_000

NODE = ["event_id", "node"]


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select("event_id", "component", F.explode(F.array("src", "dst")).alias("node")).distinct()


def _at(edges: DataFrame, end: str) -> DataFrame:
    """Edges with one end named node, the other one to."""
    return edges.select("event_id", F.col(end).alias("node"), F.col("dst" if end == "src" else "src").alias("to"), "score")


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    for end in ("src", "dst"):
        edges = edges.join(nodes.select("event_id", F.col("node").alias(end)), ["event_id", end], "left_anti")
    return edges


def start_order(edges: DataFrame, by_id: bool = False) -> DataFrame:
    """(event_id, component, node, rank): the order in which nodes are settled once all that point at them are, first come first served.

    A rank is (depth, place): nodes of one depth are settled one after the other, by the
    place of the last node that pointed at them, then by their own id. Nodes that
    nothing points at come by the first of their targets, or `by_id`. Nodes on cycles or
    behind them are not there. A round only touches nodes that have been pointed at;
    those still waiting are carried on, and each settled node is written once.
    """
    waiting = edges.groupBy("event_id", F.col("dst").alias("node")).agg(F.count("*").alias("waiting"))
    first = edges.groupBy("event_id", F.col("src").alias("node")).agg(F.min("dst").alias("told"))
    ways = cut(edges.select("event_id", "component", F.col("src").alias("from"), F.col("dst").alias("node")).join(waiting, NODE))
    place = F.row_number().over(Window.partitionBy("event_id", "component").orderBy("told", "node"))
    settle = lambda df, depth: stored(df.select("event_id", "component", "node", F.struct(F.lit(depth).alias("depth"), place.alias("place")).alias("rank")))
    sources = _nodes(edges).join(waiting, NODE, "left_anti").join(first, NODE)
    new = settle(sources.withColumn("told", F.lit(0)) if by_id else sources, 0)
    paths, open_nodes, depth = [], None, 0
    while not new.isEmpty():
        paths.append(new.stored_at)
        depth += 1
        told = ways.join(new.select("event_id", F.col("node").alias("from"), F.col("rank.place").alias("told")), ["event_id", "from"])
        told = told.select("event_id", "component", "node", "waiting", F.lit(1).cast("long").alias("n"), "told")
        if open_nodes is not None:  # what was told in earlier rounds came from nodes that are settled earlier
            told = told.unionByName(open_nodes.withColumn("told", F.lit(0)))
        state = stored(told.groupBy("event_id", "component", "node", "waiting").agg(F.sum("n").alias("n"), F.max("told").alias("told")))
        if open_nodes is not None:
            discard(before)
        before, open_nodes = state, state.where("n < waiting").drop("told")
        new = settle(state.where("n = waiting"), depth)
    return edges.sparkSession.read.schema(new.schema).parquet(*(paths or [new.stored_at]))


def spread(values: DataFrame, edges: DataFrame, end: str = "src") -> DataFrame:
    """(event_id, node, value): the least value of all nodes from which a node can be reached (or, from `dst`, that it can reach).

    Only nodes whose value has just fallen pass it on.
    """
    state = front = cut(values.select("event_id", "node", "value"))
    before = None
    while True:
        told = front.join(_at(edges, end), NODE).select("event_id", F.col("to").alias("node"), F.col("value").alias("new")).groupBy(*NODE).agg(F.min("new").alias("new"))
        both = stored(state.join(told, NODE, "full"))
        if before is not None:
            discard(before)
        before = both
        state = both.select("event_id", "node", F.least("value", "new").alias("value"))
        front = both.where("new IS NOT NULL AND (value IS NULL OR new < value)").select("event_id", "node", F.col("new").alias("value"))
        if front.isEmpty():
            return state


def _ready(starts: DataFrame, edges: DataFrame, alone: bool = False) -> DataFrame:
    """The starts (event_id, component, node, rank) that come first wherever they reach; with `alone`, at themselves."""
    won = spread(starts.select("event_id", "node", F.col("rank").alias("value")), edges)
    if not alone:
        won = spread(won, edges, "dst")
    return cut(starts.join(won, NODE).where("rank = value").drop("value"))


def _continuations(edges: DataFrame, ends: DataFrame, branching: bool) -> DataFrame:
    """(event_id, node, length, scores, to): for each node and length the best path to an end, by its branching scores, then the first."""
    degree = edges.groupBy("event_id", F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    ways = cut(_at(edges, "src").join(degree, NODE))
    none = F.array().cast("array<double>")
    level = cut(ends.select("event_id", "node", F.lit(0).alias("length"), none.alias("scores"), F.lit(None).cast("long").alias("to")))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        behind = level.select("event_id", F.col("node").alias("to"), "length", F.col("scores").alias("rest"))
        own = F.when(F.col("degree") > 1, F.array("score")).otherwise(none) if branching else none
        longer = ways.join(behind, ["event_id", "to"]).select("event_id", "node", "length", F.struct(F.concat(own, "rest").alias("scores"), (-F.col("to")).alias("to")).alias("way"))
        longer = longer.groupBy("event_id", "node", "length").agg(F.max("way").alias("way"))
        level = stored(longer.select("event_id", "node", (F.col("length") + 1).alias("length"), "way.scores", (-F.col("way.to")).alias("to")))
    out = level
    for part in levels:
        out = out.unionByName(part)
    return cut(out)


def _followed(starts: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """Adds hits: the nodes from each start on, along steps (event_id, node, ..., to); length counts down where it is a key."""
    rest = [c for c in starts.columns if c not in ("at", "left", "hits")]
    going = starts.withColumns({"at": F.col("node"), "hits": F.array("node"), "left": F.col("length") if "length" in starts.columns else F.lit(1)})
    done = []
    by = [F.col(k).alias(f"__{k}") for k in keys]
    table = steps.where("to IS NOT NULL").select(F.col("event_id").alias("__event"), *by, F.col("to").alias("__to"))
    while True:
        match = (F.col("event_id") == F.col("__event")) & (F.col("at") == F.col("__node"))
        if "length" in keys:
            match = match & (F.col("left") == F.col("__length"))
        moved = stored(going.join(table, match, "left").select(*rest, F.col("__to").alias("at"), "hits", F.col("left")))
        done.append(moved.where("at IS NULL").select(*rest, "hits"))
        going = moved.where("at IS NOT NULL").withColumns({"hits": F.concat("hits", F.array("at")), "left": F.col("left") - 1 if "length" in keys else F.col("left")})
        if going.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _greedy_paths(ready: DataFrame, edges: DataFrame, choice: str, ends: DataFrame) -> DataFrame:
    """`ready` with hits: the path that the choice picks for each start; an empty list where there is none."""
    table = _continuations(edges, ends, choice == "lookback")
    mine = ready.join(table, NODE)
    top = mine.groupBy(*NODE).agg(F.max(F.struct("length", "scores")).alias("top"))
    if choice == "lookback":
        near = table.select("event_id", "node", (F.col("length") + 1).alias("above"), F.col("scores").alias("other"))
        top = top.join(near, (top.event_id == near.event_id) & (top.node == near.node) & (F.col("top.length") == F.col("above")), "left").select(top.event_id, top.node, F.when(F.col("other") > F.col("top.scores"), F.col("top.length") - 1).otherwise(F.col("top.length")).alias("length"))
    else:
        top = top.select("event_id", "node", F.col("top.length").alias("length"))
    found = _followed(cut(ready.join(top, NODE)), table, ["node", "length"])
    return ready.join(found.select("event_id", "node", "hits"), NODE, "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<bigint>")))


def _roads(ready: DataFrame, edges: DataFrame, th_min: float, th_add: float) -> DataFrame:
    """`ready` with hits: the road from each start."""
    going = ready.withColumns({"hits": F.array("node"), "at": F.col("node")})
    done = []
    while True:
        ways = going.join(_at(edges, "src").withColumnRenamed("node", "at"), ["event_id", "at"]).where(~F.array_contains("hits", F.col("to")))
        ways = ways.groupBy(*NODE).agg(F.max("score").alias("top"), F.array_sort(F.collect_list(F.when(F.col("score") > th_add, F.col("to")))).alias("adds"), F.max(F.struct("score", (-F.col("to")).alias("to"))).alias("best"))
        moved = stored(going.join(ways.where(F.col("top") > th_min), NODE, "left"))
        done.append(moved.where("top IS NULL").select(*ready.columns, "hits"))
        going = moved.where("top IS NOT NULL").withColumn("hits", F.concat("hits", F.when(F.size("adds") > 0, F.col("adds")).otherwise(F.array(-F.col("best.to")))))
        going = going.withColumn("at", F.element_at("hits", -1)).select(*ready.columns, "hits", "at")
        if going.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def best_sums(edges: DataFrame, most: int = BOUND) -> DataFrame:
    """(event_id, node, best, to): the largest sum of scores of a path from each node, and its next node; ties to the smaller one.

    From the ends on, a node is settled once all its targets are; only those still
    waiting are looked at again. Nodes on a cycle, or from which one can be reached,
    are never settled and are left out. An event of up to `most` edges is settled in one
    task; larger ones by rounds of joins.
    """
    edges = stored(edges.select("event_id", "src", "dst", "score"))
    sizes = stored(edges.groupBy("event_id").agg(F.count("*").alias("n")))
    large, total = sizes.agg(F.coalesce(F.max("n") > most, F.lit(False)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not large:
        return _settled(edges, total)
    pick = sizes.where(F.col("n") > most).select("event_id")
    small = _settled(edges.join(pick, "event_id", "left_anti"), total)
    return small.unionByName(_sums_by_rounds(edges.join(pick, "event_id", "left_semi")))


def _settled(edges: DataFrame, total: int) -> DataFrame:
    """The best sums of events that each fit in a task."""
    names = ["event_id", "node", "best", "to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            event = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(event[1:] != event[:-1]) + 1), len(event)]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if waiting and waiting[0].column(0)[0].as_py() != event[at]:
                    yield made(waiting)
                    waiting = []
                waiting.append(batch.slice(at, end - at))
        if waiting:
            yield made(waiting)

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        src, dst, score = (rows.column(c).to_numpy() for c in ("src", "dst", "score"))
        nodes, at = np.unique(np.r_[src, dst], return_inverse=True)
        out = _best_of(at[: len(src)], at[len(src) :], score, len(nodes))
        best, to, done = (np.array(x) for x in out)
        last = pa.array(nodes[np.maximum(to, 0)[done]], pa.int64(), mask=to[done] < 0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(done.sum()), rows.column(0)[0].as_py()), pa.int64()), pa.array(nodes[done], pa.int64()), pa.array(best[done], pa.float64()), last], names=names)

    parts = max(1, -(-total // SHARE), edges.sparkSession.sparkContext.defaultParallelism)
    edges = edges.dropna().repartition(parts, "event_id").sortWithinPartitions("event_id")
    return edges.mapInArrow(run, "event_id long, node long, best double, to long")


def _best_of(src: np.ndarray, dst: np.ndarray, score: np.ndarray, n: int) -> tuple[list[float], list[int], list[bool]]:
    """For nodes from 0 to n - 1: best sum, next node or -1, and whether it is settled; of equal sums the smaller next node."""
    order = np.argsort(dst, kind="stable")
    begin = np.searchsorted(dst[order], np.arange(n + 1)).tolist()
    source, value = src[order].tolist(), score[order].tolist()
    left = np.bincount(src, minlength=n).tolist()
    best, to, done = [0.0] * n, [-1] * n, [False] * n
    ready = [i for i in range(n) if not left[i]]
    while ready:
        i = ready.pop()
        done[i] = True
        for e in range(begin[i], begin[i + 1]):
            s, total = source[e], value[e] + best[i]
            if to[s] < 0 or total > best[s] or (total == best[s] and i < to[s]):
                best[s], to[s] = total, i
            left[s] -= 1
            if not left[s]:
                ready.append(s)
    return best, to, done


def _sums_by_rounds(edges: DataFrame) -> DataFrame:
    waiting = edges.groupBy("event_id", F.col("src").alias("node")).agg(F.count("*").alias("waiting"))
    both = edges.select("event_id", F.explode(F.array("src", "dst")).alias("node")).distinct().join(waiting, NODE, "left")
    way = F.struct(F.lit(0.0).alias("best"), F.lit(None).cast("long").alias("to"))
    left = stored(both.select("event_id", "node", F.coalesce("waiting", F.lit(0)).alias("waiting"), F.when(F.col("waiting").isNull(), way).alias("way")))
    settled = []
    while True:
        new = left.where("waiting = 0").select("event_id", "node", "way")
        if new.isEmpty():
            break
        settled.append(new)
        told = new.join(_at(edges, "dst"), NODE).select("event_id", F.col("to").alias("node"), F.struct((F.col("score") + F.col("way.best")).alias("best"), (-F.col("node")).alias("to")).alias("told"))
        told = told.groupBy(*NODE).agg(F.count("*").alias("n"), F.max("told").alias("told"))
        left = stored(left.where("waiting > 0").join(told, NODE, "left").select("event_id", "node", (F.col("waiting") - F.coalesce("n", F.lit(0))).alias("waiting"), F.greatest("way", "told").alias("way")))
    out = left.limit(0).select("event_id", "node", "way")
    for part in settled:
        out = out.unionByName(part)
    return cut(out.select("event_id", "node", "way.best", (-F.col("way.to")).alias("to")))


def _best_walk(edges: DataFrame) -> list[DataFrame]:
    """Best paths from sources, taken out while any has a score above 0."""
    found = []
    while True:
        table = best_sums(edges)
        sources = edges.select("event_id", "component", F.col("src").alias("node")).distinct().join(edges.select("event_id", F.col("dst").alias("node")), NODE, "left_anti")
        starts = cut(sources.join(table.where("best > 0"), NODE).select("event_id", "component", "node", F.struct((-F.col("best")).alias("a"), F.col("node").alias("b")).alias("rank")))
        if starts.isEmpty():
            return found
        paths = cut(_followed(_ready(starts, edges), table, ["node"]))
        found.append(paths.withColumn("score", -F.col("rank.a")))
        edges = stored(_without(edges, paths.select("event_id", F.explode("hits").alias("node"))))


def walk(edges: DataFrame, choice: str, th_min: float = 0.1, th_add: float = 0.6, allow_node_reuse: bool = False) -> DataFrame:
    """(event_id, component, ord, hits, score) of the tracks; `choice` is longest, level, lookback, road or dp.

    The same tracks as the walks of one task, in as many rounds as the longest chain of
    starts that wait for each other, each of as many joins as its paths are long.
    """
    edges = cut(edges.groupBy("event_id", "component", "src", "dst").agg(F.max("score").alias("score")))
    order = start_order(edges, choice == "road")
    inside = edges
    for end in ("src", "dst"):
        inside = inside.join(order.select("event_id", F.col("node").alias(end)), ["event_id", end], "left_semi")
    inside = cut(inside.select(*edges.columns))
    if choice == "dp":
        found = _best_walk(inside)
    else:
        live, starts, found = edges if choice == "road" else inside, order, []
        outless = order.select(*NODE).join(edges.select("event_id", F.col("src").alias("node")), NODE, "left_anti")
        while not starts.isEmpty():
            ready = _ready(starts, live, allow_node_reuse)
            if choice == "road":
                paths = _roads(ready, live, th_min, th_add)
            else:
                alive = _nodes(live).select(*NODE).union(starts.select(*NODE)).distinct()
                ends = outless if choice == "longest" else alive.join(live.select("event_id", F.col("src").alias("node")), NODE, "left_anti")
                paths = _greedy_paths(ready, live, choice, ends.join(alive, NODE, "left_semi"))
            paths = cut(paths)
            kept = F.size("hits") >= (3 if choice == "road" else 2)
            found.append(paths.where(kept).withColumn("score", F.lit(None).cast("double")))
            used = paths.where(kept).select("event_id", F.explode("hits").alias("node"))
            if choice == "road":
                used = used.union(paths.where(~kept).select(*NODE))
            used = cut(used.distinct())
            starts = stored(starts.join(ready.select(*NODE).union(used), NODE, "left_anti"))
            if not allow_node_reuse:
                live = stored(_without(live, used))
    spark = edges.sparkSession
    if not found:
        return spark.createDataFrame([], "event_id long, component long, ord int, hits array<long>, score double")
    tracks = found[0]
    for part in found[1:]:
        tracks = tracks.unionByName(part)
    tracks = cut(tracks)
    place = (F.row_number().over(Window.partitionBy("event_id", "component").orderBy("rank")) - 1).cast("int")
    numbers = tracks.select("event_id", "component", "node", "rank").select("event_id", "node", place.alias("ord"))
    return tracks.join(numbers, NODE).select("event_id", "component", "ord", "hits", "score")
