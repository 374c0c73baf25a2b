"""Walks over the components of oriented, scored edges.

Each walk only looks at one component, so components are the unit of work. Those of
bounded size are dealt out over tasks, which read them one after the other; of larger
ones chains are contracted first, and what is too large even then is walked by rounds
of joins, in `waves`. Within a component the order of edges, by
(dst, src), settles all ties. Nodes on a cycle, which oriented edges have only where
equal radii were not told apart, are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.operators import dense, waves
from hitweave.operators.chains import contracted, expanded
from hitweave.session import stored

Neighbours = dict[int, dict[int, float]]
#: Edges of a component that one task takes, on arrays, and edges of all components of a task.
BOUND, SHARE = 10_000_000, 100_000
#: Edges from which a component is walked on arrays, and the most that are taken as Python objects, some 400 MB.
DENSE, LISTED = 10_000, 1_000_000
#: Comparisons of lists that are remembered.
COMPARED = 500_000
SCHEMA = "event_id long, component long, ord int, hits array<long>, score double"


def adjacency(edges: list[tuple[int, int, float]]) -> Neighbours:
    """Out-neighbours in edge order; of repeated edges the last score counts."""
    out: Neighbours = {}
    for s, d, w in edges:
        out.setdefault(s, {})[d] = w
    return out


def topological(out: Neighbours, nodes: list[int] | None = None) -> list[int]:
    """Nodes such that edges point forward, first come first served, from `nodes` or by first appearance."""
    waiting: dict[int, int] = dict.fromkeys(nodes or [], 0)
    for s, targets in out.items():
        waiting.setdefault(s, 0)
        for d in targets:
            waiting[d] = waiting.get(d, 0) + 1
    order = [n for n, k in waiting.items() if k == 0]
    for n in order:
        for d in out.get(n, ()):
            waiting[d] -= 1
            if waiting[d] == 0:
                order.append(d)
    return order


def topological_chains(out: Neighbours, chains: dict[int, Chain]) -> list[int]:
    """The order of `topological` for the first nodes of chains, where each node of `out` stands for a chain.

    Time is counted in waves, as the nodes of a chain come one a wave; between two
    waves in which a chain ends nothing but time passes.
    """
    waiting = dict.fromkeys(chains, 0)
    for targets in out.values():
        for d in targets:
            waiting[d] += 1
    first = {n: min([c.second] if c.second is not None else out.get(n, ()), default=n) for n, c in chains.items()}
    order = sorted((n for n, k in waiting.items() if k == 0), key=lambda n: (first[n], n))
    wave, time = [(n, chains[n].length) for n in order], 1  # each with the time at which it ends
    while wave:
        time = max(time, min(end for _, end in wave))
        coming: list[tuple[int, int]] = []
        for n, end in wave:
            if end > time:
                coming.append((n, end))
                continue
            for d in out.get(n, ()):
                waiting[d] -= 1
                if waiting[d] == 0:
                    order.append(d)
                    coming.append((d, time + chains[d].length))
        wave, time = coming, time + 1
    return order


class Chain(NamedTuple):
    """What a walk has to know of a chain: nodes that only lead to the next one, which only they lead to."""

    length: int = 1
    second: int | None = None
    inner: float = 0.0  # sum of the scores along it


class Lists:
    """Lists of scores that share their ends; equal lists have equal numbers, the empty one 0."""

    def __init__(self):
        self.numbers: dict[tuple[float, int], int] = {}
        self.heads, self.tails = [0.0], [0]
        self.compared: dict[tuple[int, int], int] = {}

    def put(self, score: float, tail: int) -> int:
        number = self.numbers.setdefault((score, tail), len(self.heads))
        if number == len(self.heads):
            self.heads.append(score)
            self.tails.append(tail)
        return number

    def compare(self, a: int, b: int) -> int:
        """-1, 0 or 1, as lists compare in Python. What two ends have been found to be is not looked at again."""
        trail = []
        while True:
            if a == b or not a or not b:
                found = (a != 0) - (b != 0) if a != b else 0
            elif self.heads[a] != self.heads[b]:
                found = 1 if self.heads[a] > self.heads[b] else -1
            else:
                found = self.compared.get((a, b))
            if found is not None:
                break
            trail.append((a, b))
            a, b = self.tails[a], self.tails[b]
        if len(self.compared) > COMPARED:
            self.compared.clear()
        for pair in trail:
            self.compared[pair] = found
        return found


class _Choice:
    """What is best from each node, by what is best from the next ones; the first part of a value is what others depend on."""

    def __init__(self, out: Neighbours, chains: dict[int, Chain]):
        self.out, self.chains = out, chains
        self.values: dict[int, tuple] = {}

    def length(self, n: int) -> int:
        return self.chains[n].length if n in self.chains else 1


class _Depth(_Choice):
    """Longest path from a start; of equally long ones the first in edge order.

    A path ends at a node without out-edges or, if `dead_ends`, also where all
    neighbours are used. What the level-by-level search would list is not needed: the
    first of its last level always steps to the first neighbour that is deep enough.
    """

    dead_ends = False

    def value(self, n: int, ways: list[int]) -> tuple:
        if not ways:
            return self.length(n) if self.dead_ends or not self.out.get(n) else None, None
        best, to = None, None
        for d in ways:
            deep = self.values[d][0]
            if deep is not None and (best is None or deep > best):
                best, to = deep, d
        return (None, None) if best is None else (self.length(n) + best, to)

    def path(self, start: int) -> list[int]:
        path, at = [], start if self.values[start][0] is not None else None
        while at is not None:
            path.append(at)
            at = self.values[at][1]
        return path


class _Level(_Depth):
    dead_ends = True


class _Lookback(_Choice):
    """Among the paths of the two longest lengths, the one with the largest list of branching scores.

    A score is noted wherever there is more than one way on. Lists compare as in
    Python; of equal ones the longer path, then the earlier in edge order, wins. What is
    left of such a path from a node on its way is as long as can be from there or one
    less, so two lists a node are enough; each is one score and a reference.
    """

    def __init__(self, out: Neighbours, chains: dict[int, Chain]):
        super().__init__(out, chains)
        self.lists = Lists()

    def value(self, n: int, ways: list[int]) -> tuple:
        """((length, list, list of the paths one shorter), ways on along both)."""
        if not ways:
            return (self.length(n), 0, None), None, None
        deep = max(self.values[d][0][0] for d in ways)
        found = []
        for less in (0, 1):
            best = None
            for d in ways:
                longest, own, shorter = self.values[d][0]
                which = less - (deep - longest)
                tail = own if which == 0 else shorter if which == 1 else None
                if tail is None:
                    continue
                score = self.out[n][d] if len(ways) > 1 else 0.0
                if best is None or score > best[0] or score == best[0] and self.lists.compare(tail, best[1]) > 0:
                    best = score, tail, (d, which)
            found.append((best[1] if len(ways) == 1 else self.lists.put(*best[:2]), best[2]) if best else (None, None))
        (first, to), (other, aside) = found
        return (self.length(n) + deep, first, other), to, aside

    def path(self, start: int) -> list[int]:
        _, first, other = self.values[start][0]
        path, at = [], (start, int(other is not None and self.lists.compare(other, first) > 0))
        while at is not None:
            path.append(at[0])
            at = self.values[at[0]][1 + at[1]]
        return path


class _Sum(_Choice):
    """Largest sum of scores of a path from each node."""

    def value(self, n: int, ways: list[int]) -> tuple:
        best, to = 0.0, None
        for d in ways:
            total = self.out[n][d] + self.values[d][0]
            if to is None or total > best:
                best, to = total, d
        return (self.chains[n].inner if n in self.chains else 0.0) + best, to

    path = _Depth.path


CHOICES: dict[str, type[_Choice]] = {"longest": _Depth, "level": _Level, "lookback": _Lookback}


class Live:
    """The choice at each node that is not taken out yet; taking out nodes looks again only at those that led to them."""

    def __init__(self, choice: type[_Choice], out: Neighbours, order: list[int], chains: dict[int, Chain]):
        self.out, self.order = out, order
        self.place = {n: i for i, n in enumerate(order)}
        self.choice = choice(out, chains)
        self.into: dict[int, list[int]] = {}
        self.gone: set[int] = set()
        for n in reversed(order):
            ways = self.ways(n)
            for d in ways:
                self.into.setdefault(d, []).append(n)
            self.choice.values[n] = self.choice.value(n, ways)

    def ways(self, n: int) -> list[int]:
        return [d for d in self.out.get(n, ()) if d in self.place and d not in self.gone]

    def remove(self, nodes: list[int]) -> list[int]:
        """Takes out `nodes`; gives those whose best has changed."""
        self.gone.update(nodes)
        heap = [-self.place[p] for n in nodes for p in self.into.get(n, ()) if p not in self.gone]
        heapq.heapify(heap)
        changed, values = [], self.choice.values
        last = None
        while heap:
            at = heapq.heappop(heap)
            if at == last:
                continue
            last, n = at, self.order[-at]
            before, values[n] = values[n][0], self.choice.value(n, self.ways(n))
            if values[n][0] != before:
                changed.append(n)
                for p in self.into.get(n, ()):
                    if p not in self.gone:
                        heapq.heappush(heap, -self.place[p])
        return changed


def greedy_walk(edges: list[tuple[int, int, float]], choice: str, allow_node_reuse: bool = False, chains: dict[int, Chain] | None = None) -> list[list[int]]:
    """Starts from each unused node in topological order and keeps what the choice picks, if two hits or more.

    With `chains`, nodes stand for chains, which a path always takes as a whole.
    """
    out = adjacency(edges)
    order, used, tracks = topological(out) if chains is None else topological_chains(out, chains), set(), []
    live = Live(CHOICES[choice], out, order, chains or {})
    for start in order:
        if start in used:
            continue
        path = live.choice.path(start)
        if len(path) > 1 or path and live.choice.length(start) > 1:
            tracks.append(path)
            used.update(path)
            if not allow_node_reuse:
                live.remove(path)
    return tracks


def road_walk(edges: list[tuple[int, int, float]], th_min: float, th_add: float, nodes: list[int] | None = None) -> list[list[int]]:
    """One road from each unused start: all good next hits are put on it, and it goes on from the last.

    Next hits are the unused ones above th_add, or else the best one if above th_min.
    Roads of three hits or more are kept; a shorter one uses up its start only.
    """
    out = adjacency(edges)
    used: set[int] = set()
    tracks = []
    for start in topological(out, sorted(nodes or {n for e in edges for n in e[:2]})):
        if start in used:
            continue
        road = [start]
        while True:
            ways = [(d, w) for d, w in out.get(road[-1], {}).items() if d not in used and d not in road]
            top = max(ways, key=lambda x: x[1], default=None)
            if top is None or top[1] <= th_min:
                break
            road += [d for d, w in ways if w > th_add] or [top[0]]
        if len(road) < 3:
            used.add(start)
        else:
            tracks.append(road)
            used.update(road)
    return tracks


def best_scores(edges: list[tuple[int, int, float]]) -> dict[int, tuple[float, int | None]]:
    """Largest sum of scores of a path from each node, and its next node."""
    out = adjacency(edges)
    return Live(_Sum, out, topological(out), {}).choice.values


def dp_walk(edges: list[tuple[int, int, float]], chains: dict[int, Chain] | None = None) -> list[tuple[list[int], float]]:
    """Takes out the best path from a source, again and again, until none has a score above 0; ties to the smaller source."""
    out = adjacency(edges)
    order = topological(out) if chains is None else topological_chains(out, chains)
    live = Live(_Sum, out, order, chains or {})
    values = live.choice.values
    coming: dict[int, int] = {}  # edges that still lead to a node, from nodes on cycles too
    for targets in out.values():
        for d in targets:
            coming[d] = coming.get(d, 0) + 1
    heap = [(-values[n][0], n) for n in order if not coming.get(n)]
    heapq.heapify(heap)
    tracks = []
    while heap and heap[0][0] < 0:
        score, start = heapq.heappop(heap)
        if start in live.gone or -score != values[start][0]:
            continue
        path = live.choice.path(start)
        tracks.append((path, -score))
        changed = live.remove(path)
        for n in path:
            for d in out.get(n, ()):
                coming[d] -= 1
                if not coming[d] and d not in live.gone and d in live.place:
                    changed.append(d)
        for n in changed:
            if not coming.get(n):
                heapq.heappush(heap, (-values[n][0], n))
    return tracks


def _by_component(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(event_id, component, the other columns of its edges) of rows that come sorted by them; a component may span batches."""
    key, waiting = None, []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        first = np.flatnonzero(np.r_[True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])]).tolist()
        for begin, end in zip(first, [*first[1:], batch.num_rows], strict=True):
            if key != (now := (int(columns[0][begin]), int(columns[1][begin]))):
                if waiting:
                    yield *key, _joined(waiting)
                key = now
            waiting.append([c[begin:end] for c in columns[2:]])
    if waiting:
        yield *key, _joined(waiting)


def _joined(pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The pieces of each column as one; `pieces` is empty afterwards."""
    columns = [np.concatenate(x) for x in zip(*pieces, strict=True)]
    pieces.clear()
    return columns


def walk_components(edges: DataFrame, components: DataFrame, walk: str = "lookback", th_min: float = 0.1, th_add: float = 0.6, allow_node_reuse: bool = False, bound: int = BOUND) -> DataFrame:
    """(event_id, component, ord, hits, score) of each component's tracks; score only for the dp walk.

    `components` is (event_id, node, component), as connected_components gives it.
    Cuts have to be made before; the road walk makes its own. Components of up to
    `bound` edges are each walked in one task, which holds one of them at a time, those
    of many edges on arrays (`dense`). Of
    larger ones chains are contracted first (chains.contracted); those then within it, and
    within LISTED, are walked in a task, where a chain is one node, the others by joins
    (waves.walk). All give the same tracks, but for the dp walk's sums, whose rounding
    depends on the order of adding. Roads may end inside a chain and are not contracted.
    Of repeated edges the largest score counts.
    """

    def tracks(columns: list[np.ndarray], inside: dict[int, Chain] | None) -> list[tuple[list[int], float | None]]:
        if len(columns[0]) >= DENSE and inside is None and not np.isnan(columns[2]).any():
            if walk == "road":
                return [(p, None) for p in dense.road_walk(*columns, th_min, th_add)]
            if walk == "dp":
                return dense.dp_walk(*columns)
            return [(p, None) for p in dense.greedy_walk(*columns, walk, allow_node_reuse)]
        listed = list(zip(*(c.tolist() for c in columns), strict=True))
        if walk == "road":
            return [(p, None) for p in road_walk(listed, th_min, th_add)]
        if walk == "dp":
            return dp_walk(listed, inside)
        return [(p, None) for p in greedy_walk(listed, walk, allow_node_reuse, inside)]

    types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.float64())

    def walked(with_chains: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["event_id", "component", "ord", "hits", "score"])
            for event, component, columns in _by_component(batches):
                inside = None
                if with_chains:  # rows of nodes have a length
                    node = columns[3] > 0
                    inside = {s: Chain(length, d if length > 1 else None, w) for s, d, w, length in zip(*(c[node].tolist() for c in columns), strict=True)}
                    columns = [c[~node] for c in columns[:3]]
                out += [(event, component, i, path, score) for i, (path, score) in enumerate(tracks(columns, inside))]
                if len(out) >= 1000:
                    yield made()
                    out.clear()
            if out:
                yield made()

        return run

    keys = ["event_id", "component"]
    labelled = edges.join(components.select("event_id", F.col("node").alias("src"), "component"), ["event_id", "src"])
    labelled = stored(labelled.select(*keys, "src", "dst", F.col("score").cast("double").alias("score")))
    counts = labelled.groupBy(*keys).agg(F.count("*").alias("n"))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    large = None
    small = labelled
    if size["most"] > bound:
        large = stored(counts.where(F.col("n") > bound).select(*keys))
        small = labelled.join(large, keys, "left_anti").select(*labelled.columns)
    # a given number of partitions: adaptive execution would put what is few bytes but much work into one task
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-size["all"] // SHARE))
    found = small.repartition(tasks, *keys).sortWithinPartitions(*keys, "dst", "src", "score").mapInArrow(walked(False), SCHEMA)
    if large is None:
        return found
    rest = labelled.join(large, keys, "left_semi").groupBy(*keys, "src", "dst").agg(F.max("score").alias("score"))
    if walk != "road":
        rest = stored(rest)
        nodes, links, members = contracted(rest)
        rows = stored(nodes.select(*keys, F.col("node").alias("src"), F.col("second").alias("dst"), F.col("inner").alias("score"), "length").unionByName(links.withColumn("length", F.lit(0))))
        sizes = rows.groupBy(*keys).agg(F.count_if(F.col("length") == 0).alias("n"))
        fits = stored(sizes.where(F.col("n") <= min(bound, LISTED)).select(*keys))
        short = rows.join(fits, keys, "left_semi").select(*rows.columns)
        paths = short.repartition(tasks, *keys).sortWithinPartitions(*keys, "dst", "src", "score").mapInArrow(walked(True), SCHEMA)
        found = found.unionByName(expanded(paths, members))
        rest = rest.join(fits, keys, "left_anti").select(*rest.columns)
        if rest.isEmpty():
            return found
    return found.unionByName(waves.walk(rest, walk, th_min, th_add, allow_node_reuse))
