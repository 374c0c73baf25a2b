"""The walks of `walks` on arrays, for components of many edges: the same tracks in the same order.

Nodes are numbered in topological order, so edges lead from smaller to larger numbers.
The look-back walk keeps no lists here: of each node it holds how long the longest path
is and whether there is one that is one shorter, which seldom change when other nodes are
taken out, and it finds the list of a start when it comes to it, score by score.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Lengths of what cannot be taken: a node that is gone, or from which no path ends where paths may end.
NEVER = -(1 << 30)


class Graph:
    """Nodes by their ids, out-edges in edge order; `src`, `dst` and `score` are sorted by (dst, src), and of repeated edges the last score counts."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, score: np.ndarray):
        last = np.r_[(src[1:] != src[:-1]) | (dst[1:] != dst[:-1]), True]
        self.ids = np.union1d(src, dst)
        self.src, self.dst = (np.searchsorted(self.ids, x[last]).astype(np.int32) for x in (src, dst))
        self.score = score[last]
        self._index(len(self.ids))

    def _index(self, n: int) -> None:
        order = np.argsort(self.src, kind="stable")
        self.to, self.weight = self.dst[order], self.score[order]
        self.begin = np.r_[0, np.cumsum(np.bincount(self.src, minlength=n))]

    def topological(self, by_id: bool) -> np.ndarray:
        """As `walks.topological`; nodes that nothing points at come by id or by their first edge."""
        waiting = np.bincount(self.dst, minlength=len(self.ids))
        first, seen = np.unique(self.src, return_index=True)
        free = waiting[first] == 0
        order = (first[free] if by_id else first[free][np.argsort(seen[free])]).tolist()
        for n in order:
            ways = self.to[self.begin[n] : self.begin[n + 1]]
            waiting[ways] -= 1
            order.extend(ways[waiting[ways] == 0].tolist())
        return np.array(order, np.int64)

    def ordered(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers the nodes anew by `topological`, without those on cycles; how many edges led into and out of each before."""
        order = self.topological(False)
        into, out = (np.bincount(x, minlength=len(self.ids))[order] for x in (self.dst, self.src))
        place = np.full(len(self.ids), -1, np.int32)
        place[order] = np.arange(len(order))
        there = (place[self.src] >= 0) & (place[self.dst] >= 0)
        self.src, self.dst, self.score = place[self.src[there]], place[self.dst[there]], self.score[there]
        self.ids = self.ids[order]
        self._index(len(order))
        back = np.argsort(self.dst, kind="stable")
        self.source, self.into = self.src[back], np.r_[0, np.cumsum(np.bincount(self.dst, minlength=len(order)))]
        self.back_weight = self.score[back]
        return into, out

    def ways(self, n: int) -> slice:
        return slice(self.begin[n], self.begin[n + 1])


def _rows(begin: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the edges of `nodes`, where each node's begin among those, and how many each has."""
    many = begin[nodes + 1] - begin[nodes]
    first = np.cumsum(many) - many
    return np.arange(many.sum()) + np.repeat(begin[nodes] - first, many), first, many


class _Falling:
    """What holds for nodes by what holds for those they lead to; taking out nodes looks again where it may matter.

    Nodes of one level do not lead to each other and are settled together, lower levels first.
    """

    def __init__(self, graph: Graph):
        n = len(graph.ids)
        self.graph, self.gone, self.waiting = graph, np.zeros(n, bool), np.zeros(n, bool)
        self.levels: dict[int, list[np.ndarray]] = {}
        self.depth = np.zeros(n, np.int32)
        left, ready, depth = np.diff(graph.begin), np.flatnonzero(np.diff(graph.begin) == 0), 0
        while len(ready):
            self.depth[ready] = depth
            self.settle(ready)
            sources = graph.source[_rows(graph.into, ready)[0]]
            left -= np.bincount(sources, minlength=n)
            ready, depth = (sources := np.unique(sources))[left[sources] == 0], depth + 1

    def remove(self, path: list[int]) -> list[int]:
        """Takes out the nodes of `path`; gives those for which something else holds now."""
        nodes, changed, heap = np.array(path), [], []
        self.gone[nodes] = True
        self._tell(nodes, self.taken(nodes), heap)
        while heap:
            nodes = np.concatenate(self.levels.pop(heapq.heappop(heap)))
            self.waiting[nodes] = False
            moved, before = self.settle(nodes)
            changed += moved.tolist()
            self._tell(moved, before, heap)
        return changed

    def _tell(self, nodes: np.ndarray, before: np.ndarray, heap: list[int]) -> None:
        at, _, many = _rows(self.graph.into, nodes)
        sources = self.graph.source[at]
        sources = sources[self.concerned(np.repeat(nodes, many), np.repeat(before, many), sources, at) & ~self.gone[sources] & ~self.waiting[sources]]
        if not len(sources):
            return
        sources = np.unique(sources)
        self.waiting[sources] = True
        level = self.level()[sources]
        order = np.argsort(level, kind="stable")
        sources, level = sources[order], level[order]
        cuts = np.flatnonzero(np.r_[True, level[1:] != level[:-1]])
        for k, some in zip(level[cuts].tolist(), np.split(sources, cuts[1:]), strict=True):
            if k not in self.levels:
                heapq.heappush(heap, k)
            self.levels.setdefault(k, []).append(some)


class Lengths(_Falling):
    """`length` of the longest path from each node and, for the look-back walk, whether there is one of a node `less`."""

    def __init__(self, graph: Graph, choice: str, out: np.ndarray):
        n = len(graph.ids)
        self.look, self.ends = choice == "lookback", (out == 0) | (choice != "longest")
        self.length, self.less = np.full(n, NEVER, np.int32), np.zeros(n, bool)
        super().__init__(graph)

    def level(self) -> np.ndarray:
        return self.length

    def settle(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes for which that has changed, and their lengths before."""
        at, first, many = _rows(self.graph.begin, nodes)
        ways = self.graph.to[at]
        lengths, some = self.length[ways], many > 0
        deep, less = np.full(len(nodes), NEVER, np.int32), np.zeros(len(nodes), bool)
        if len(at):
            deep[some] = np.maximum.reduceat(lengths, first[some])
            if self.look:
                most = np.repeat(deep, many)
                less[some] = np.logical_or.reduceat((lengths == most - 1) | ((lengths == most) & self.less[ways]), first[some])
        open_ = deep > 0
        length = np.where(open_, deep + 1, np.where(self.ends[nodes], 1, NEVER)).astype(np.int32)
        less &= open_
        before = self.length[nodes]
        moved = (before != length) | (self.less[nodes] != less)
        self.length[nodes], self.less[nodes] = length, less
        return nodes[moved], before[moved]

    def taken(self, nodes: np.ndarray) -> np.ndarray:
        before = self.length[nodes]
        self.length[nodes], self.less[nodes] = NEVER, False
        return before

    def concerned(self, nodes: np.ndarray, before: np.ndarray, sources: np.ndarray, at: np.ndarray) -> np.ndarray:
        apart = self.length[sources] - 1 - before
        return (before > 0) & (apart >= 0) & (apart <= self.look)

    def path(self, start: int) -> list[int]:
        if self.length[start] < 0:
            return []
        return self._branching(start) if self.look else self._first(start)

    def _first(self, start: int) -> list[int]:
        path = [start]
        while len(ways := self.graph.to[self.graph.ways(path[-1])]):
            lengths = self.length[ways]
            if lengths[at := int(lengths.argmax())] < 0:
                break
            path.append(int(ways[at]))
        return path

    def _live(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = self.graph.ways(n)
        ways, scores = self.graph.to[at], self.graph.weight[at]
        lengths = self.length[ways]
        live = lengths > 0
        return (ways, scores, lengths) if live.all() else (ways[live], scores[live], lengths[live])

    def _branching(self, start: int) -> list[int]:
        """The path with the largest list; all paths of the largest list so far go on together, the one that wins ties first."""
        states = [(start, 0, (start, None))] + [(start, 1, (start, None))] * bool(self.less[start])
        while True:
            ended, open_, seen = [], [], set()
            for n, less, trail in states:
                while len((found := self._live(n))[0]) == 1:  # notes no score
                    n = int(found[0][0])
                    trail = n, trail
                if (n, less) not in seen:
                    seen.add((n, less))
                    (open_ if len(found[0]) else ended).append((less, trail, found))
            if not open_:
                path, at = [], ended[0][1]
                while at is not None:
                    path.append(at[0])
                    at = at[1]
                return path[::-1]
            best, states = None, []
            for less, trail, (ways, scores, lengths) in open_:
                deep = lengths.max()
                may = lengths == deep
                if less:
                    may = (may & self.less[ways]) | (lengths == deep - 1)
                top = scores[may].max()
                if best is None or top > best:
                    best, states, seen = top, [], set()
                if top == best:
                    for at in np.flatnonzero(may & (scores == top)).tolist():
                        state = int(ways[at]), int(less and lengths[at] == deep)
                        if state not in seen:
                            seen.add(state)
                            states.append((*state, (state[0], trail)))


class Sums(_Falling):
    """Largest sum of scores of a path from each node, and its next node or -1."""

    def __init__(self, graph: Graph):
        n = len(graph.ids)
        self.best, self.to = np.zeros(n), np.full(n, -1, np.int32)
        super().__init__(graph)

    def level(self) -> np.ndarray:
        return self.depth

    def settle(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, first, many = _rows(self.graph.begin, nodes)
        ways, some = self.graph.to[at], many > 0
        best, to = np.zeros(len(nodes)), np.full(len(nodes), -1, np.int32)
        if len(at):
            sums = np.where(self.gone[ways], -np.inf, self.graph.weight[at] + self.best[ways])
            most = np.full(len(nodes), -np.inf)
            most[some] = np.maximum.reduceat(sums, first[some])
            place = np.where(sums == np.repeat(most, many), np.arange(len(at)), len(at))
            found = most > -np.inf
            best[found] = most[found]
            chosen = np.zeros(len(nodes), np.int64)
            chosen[some] = np.minimum.reduceat(place, first[some])
            to[found] = ways[chosen[found]]
        moved = best != self.best[nodes]
        self.best[nodes], self.to[nodes] = best, to
        return nodes[moved], nodes[moved]

    def taken(self, nodes: np.ndarray) -> np.ndarray:
        return nodes

    def concerned(self, nodes: np.ndarray, before: np.ndarray, sources: np.ndarray, at: np.ndarray) -> np.ndarray:
        # a sum can rise as well, where what is left is better than a negative one
        return (self.to[sources] == nodes) | (~self.gone[nodes] & (self.graph.back_weight[at] + self.best[nodes] >= self.best[sources]))

    def path(self, start: int) -> list[int]:
        path = [start]
        while (to := int(self.to[path[-1]])) >= 0:
            path.append(to)
        return path


def greedy_walk(src: np.ndarray, dst: np.ndarray, score: np.ndarray, choice: str, allow_node_reuse: bool = False) -> list[list[int]]:
    """As `walks.greedy_walk`."""
    graph = Graph(src, dst, score)
    _, out = graph.ordered()
    live, used, tracks = Lengths(graph, choice, out), np.zeros(len(graph.ids), bool), []
    for start in range(len(graph.ids)):
        if used[start]:
            continue
        path = live.path(start)
        if len(path) > 1:
            tracks.append(graph.ids[path].tolist())
            used[path] = True
            if not allow_node_reuse:
                live.remove(path)
    return tracks


def dp_walk(src: np.ndarray, dst: np.ndarray, score: np.ndarray) -> list[tuple[list[int], float]]:
    """As `walks.dp_walk`."""
    graph = Graph(src, dst, score)
    coming, _ = graph.ordered()
    live, ids = Sums(graph), graph.ids
    heap = [(-float(live.best[n]), int(ids[n]), n) for n in np.flatnonzero(coming == 0).tolist()]
    heapq.heapify(heap)
    tracks = []
    while heap and heap[0][0] < 0:
        total, _, start = heapq.heappop(heap)
        if live.gone[start] or -total != live.best[start]:
            continue
        path = live.path(start)
        tracks.append((ids[path].tolist(), -total))
        changed = live.remove(path)
        for n in path:
            ways = graph.to[graph.ways(n)]
            coming[ways] -= 1
            changed += ways[(coming[ways] == 0) & ~live.gone[ways]].tolist()
        for n in changed:
            if not coming[n]:
                heapq.heappush(heap, (-float(live.best[n]), int(ids[n]), n))
    return tracks


def road_walk(src: np.ndarray, dst: np.ndarray, score: np.ndarray, th_min: float, th_add: float) -> list[list[int]]:
    """As `walks.road_walk`."""
    graph = Graph(src, dst, score)
    used, tracks = np.zeros(len(graph.ids), bool), []
    for start in graph.topological(True).tolist():
        if used[start]:
            continue
        road, on = [start], used.copy()
        on[start] = True
        while True:
            at = graph.ways(road[-1])
            ways, scores = graph.to[at], graph.weight[at]
            free = ~on[ways]
            ways, scores = ways[free], scores[free]
            if not len(ways) or scores[top := int(scores.argmax())] <= th_min:
                break
            more = ways[scores > th_add] if scores[top] > th_add else ways[top : top + 1]
            on[more] = True
            road += more.tolist()
        if len(road) < 3:
            used[start] = True
        else:
            tracks.append(graph.ids[road].tolist())
            used = on
    return tracks
