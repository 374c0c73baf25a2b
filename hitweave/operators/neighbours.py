"""Fixed-radius nearest-neighbour joins, exact, by pivots and blocks.

A small event is one cell. A larger one has pivots, database points chosen by a hash, as
many as twice the root of its size, and every point belongs to the cell of its nearest
pivot. Points near a query point can only lie in a cell whose ball is within r_max of
it, and only if the plane half-way between the cell's pivot and the query's own is, as
beyond it that pivot would not be the nearest. So a query goes to those cells alone.
Points and queries meet the pivots in blocks, each of which gets them once. Cells with
many points are dealt out in blocks of bounded size, their queries in parts, and a pair
of block and part is one matrix product. Where only the nearest points are asked for, a
query first meets the cells of its nearest pivots; how far its k-th point there is
bounds how far it has to look in the others.

Cells are no help where a query reaches many of them, as with directions in a space of
dozens of dimensions: a row for each query and cell would be more than all points. Such
events, and small ones, are scanned: a task holds a block of queries, the points of the
event go past it, and of each query it keeps the nearest. Those are all pairs of the
event; what a task holds is a block and a batch, and what is sent grows with the points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.session import stored

#: Database points of an event or a cell, and queries of a cell, that meet in one product; points that meet the pivots together.
ROWS, QUERIES, TOGETHER = 4096, 4096, 16384
#: Cells that a query meets before its k-th distance is taken as a bound.
FIRST = 3
_CHUNK = 256
#: Cells that a query may reach on average before its event is scanned; queries of an event that are asked for that.
WORTH, ASKED = 16, 512
#: A scan: blocks of queries in a large event, the most queries of a block, nearest points that a block keeps, and points that go past a block before it is dealt to several tasks.
BLOCKS, MOST, KEPT, PAST = 32, 1 << 15, 1 << 21, 1 << 16
#: Pairs that are handed on together, and partitions of a scan at most.
PAIRS, PARTITIONS = 1 << 17, 2000


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """[rows, dimension] of a list column whose lists are of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def within(queries: np.ndarray, rows: np.ndarray, reach: np.ndarray, k_max: int | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of the pairs within reach, the k_max nearest rows of each query if asked.

    `reach` is a squared radius for each query, inclusive. The product only proposes pairs, with room for its rounding; distances that decide
    are sums of squared differences.
    """
    found = list(_by_chunk(queries, rows, reach, k_max, ids))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _first_of(q: np.ndarray, d2: np.ndarray, ids: np.ndarray, k_max: int) -> np.ndarray:
    """Places of the k_max nearest of each query, by query, distance and id."""
    order = np.lexsort((ids, d2, q))
    own = q[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k_max]


def _by_chunk(queries: np.ndarray, rows: np.ndarray, reach: np.ndarray, k_max: int | None, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of `within`, a chunk of queries at a time.

    Squared distances less the reach are one product of longer vectors, in single
    precision where its rounding is small beside the reach.
    """
    if not len(rows) or not len(queries):
        return
    square, size = (rows * rows).sum(axis=1), rows.shape[1] + 8
    longest = square.max() + (queries * queries).sum(axis=1).max()
    kind = np.float32 if 1e-3 * reach.max() > 5e-7 * size * longest and longest < 1e30 else np.float64
    right = np.hstack([rows, np.ones((len(rows), 1)), square[:, None]]).astype(kind).T
    for at in range(0, len(queries), _CHUNK):
        part = queries[at : at + _CHUNK]
        own, near = (part * part).sum(axis=1), reach[at : at + _CHUNK]
        room = (5e-7 if kind is np.float32 else 1e-12) * size * (own.max() + square.max() + near.max() + (kind is np.float64))
        left = np.hstack([-2 * part, (own - near)[:, None], np.ones((len(part), 1))]).astype(kind)
        over = left @ right
        there = over <= room
        if k_max is not None and np.count_nonzero(there) > 4 * k_max * len(part):  # no farther than the k-th can be
            there = over <= np.minimum(np.partition(over, k_max - 1, axis=1)[:, k_max - 1 : k_max] + 2 * room, room)
        q, r = np.divmod(np.flatnonzero(there), len(rows))
        d2 = np.zeros(len(q))
        for begin in range(0, len(q), 1 << 17):
            piece = slice(begin, begin + (1 << 17))
            gap = part[q[piece]] - rows[r[piece]]
            d2[piece] = np.add.accumulate(gap * gap, axis=1)[:, -1] if gap.shape[1] else 0.0
        inside = d2 <= near[q]
        q, r, d2 = q[inside], r[inside], d2[inside]
        if k_max is not None and len(q):
            first = _first_of(q, d2, ids[r], k_max)
            q, r, d2 = q[first], r[first], d2[first]
        if len(q):
            yield q + at, r, d2


def _squares(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances, but for rounding."""
    d2 = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (points @ pivots.T)
    return np.maximum(d2, 0.0)


def _slack(points: np.ndarray, pivots: np.ndarray) -> float:
    """More than the rounding of `_squares` can be."""
    return 1e-12 * (points.shape[1] + 8) * ((points * points).sum(axis=1).max(initial=0.0) + (pivots * pivots).sum(axis=1).max(initial=0.0) + 1)


def _celled(points: pa.Table, pivots: pa.Table) -> pa.Table:
    """Each point with its cell and no less than its distance to the pivot."""
    v, at, numbers = matrix(points["v"]), matrix(pivots["p"]), pivots["cell"].to_numpy()
    cell, far = np.zeros(len(v), np.int64), np.zeros(len(v))
    for begin in range(0, len(v), _CHUNK):
        d2 = _squares(v[begin : begin + _CHUNK], at)
        k = d2.argmin(axis=1)
        cell[begin : begin + _CHUNK] = numbers[k]
        far[begin : begin + _CHUNK] = np.sqrt(d2[np.arange(len(k)), k] + _slack(v, at))
    return pa.table({"event_id": points["event_id"], "dst": points["dst"], "w": points["v"], "cell": pa.array(cell), "far": pa.array(far)})


def _reachable(points: pa.Table, pivots: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For chunks of the points: where they begin, the squared distances to the pivots, and which cells may hold points within reach."""
    v, at, far, radius = matrix(points["v"]), matrix(pivots["p"]), pivots["far"].to_numpy(), np.sqrt(points["reach"].to_numpy())
    for begin in range(0, len(v) if len(at) else 0, _CHUNK):
        own, r = v[begin : begin + _CHUNK], radius[begin : begin + _CHUNK, None]
        d2, slack = _squares(own, at), _slack(v, at)
        near = d2.argmin(axis=1)
        apart = np.sqrt(_squares(at[near], at) + slack)
        ball = d2 <= (r + far) ** 2 * (1 + 1e-9) + slack
        plane = d2 - d2[np.arange(len(near)), near][:, None] <= 2 * r * apart * (1 + 1e-9) + 4 * slack
        yield begin, d2, ball & plane


def _first(points: pa.Table, pivots: pa.Table) -> pa.Table:
    """The points with `cells`, those of their nearest pivots that they can reach."""
    numbers, cells = pivots["cell"].to_numpy(), []
    for _, d2, reached in _reachable(points, pivots):
        d2 = np.where(reached, d2, np.inf)
        best = np.argpartition(d2, FIRST - 1, axis=1)[:, :FIRST] if d2.shape[1] > FIRST else np.broadcast_to(np.arange(d2.shape[1]), d2.shape)
        cells += [numbers[b[np.isfinite(d)]] for b, d in zip(best, np.take_along_axis(d2, best, axis=1), strict=True)]
    cells = cells or [[]] * points.num_rows
    return points.select(["event_id", "src", "v", "reach"]).append_column("cells", pa.array(cells, pa.list_(pa.int64())))


def _routed(points: pa.Table, pivots: pa.Table) -> pa.Table:
    """The queries with `to`, the cells, but for their `cells`, that may hold points near them."""
    numbers = pivots["cell"].to_numpy()
    order = np.argsort(numbers)
    lists = points["cells"].combine_chunks()
    many, met = pc.list_value_length(lists).to_numpy(), order[np.searchsorted(numbers[order], lists.flatten().to_numpy())] if len(order) else np.zeros(0, np.int64)
    ends = np.r_[0, np.cumsum(many)]
    found: list[np.ndarray] = []
    each: list[np.ndarray] = []
    for begin, _, reached in _reachable(points, pivots):
        own = many[begin : begin + len(reached)]
        reached[np.repeat(np.arange(len(own)), own), met[ends[begin] : ends[begin + len(own)]]] = False
        found.append(numbers[np.nonzero(reached)[1]])
        each.append(reached.sum(axis=1))
    places = np.r_[0, np.cumsum(np.concatenate(each) if each else np.zeros(points.num_rows, np.int64))]
    to = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64()))
    return points.select(["event_id", "src", "v", "reach"]).append_column("to", to)


def _spread(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))


def _cells(query: DataFrame, database: DataFrame, sizes: DataFrame, r_max: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of events with pivots: queries and cells by the blocks in which they meet, and points by cell; `sizes` is (event_id, n).

    Queries are (event_id, block, src, v, reach, cells), reach a squared radius and cells
    those that need not be met; cells are (event_id, block, cell, p, far), and points
    (event_id, cell, dst, w).
    """
    sizes = sizes.select("event_id", F.ceil(2 * F.sqrt("n")).alias("slots"), F.ceil(F.col("n") / TOGETHER).alias("blocks"))
    draw = F.xxhash64("event_id", "hit_id")
    rows = database.join(sizes, "event_id")
    pivots = rows.groupBy("event_id", "blocks", F.pmod(draw, F.col("slots")).alias("cell")).agg(F.min(F.struct(draw.alias("draw"), "v")).alias("first"))
    pivots = stored(pivots.select("event_id", "blocks", "cell", F.col("first.v").alias("p")))
    points = rows.select("event_id", F.pmod(F.xxhash64("hit_id", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.col("hit_id").alias("dst"), "v")
    keys = ("event_id", "block")
    celled = points.groupBy(*keys).cogroup(pivots.withColumn("block", _spread("blocks")).select(*keys, "cell", "p").groupBy(*keys))
    celled = stored(celled.applyInArrow(_celled, "event_id long, dst long, w array<double>, cell long, far double"))
    balls = celled.groupBy("event_id", "cell").agg(F.max("far").alias("far"))
    asked = query.join(sizes.select("event_id"), "event_id")
    parts = asked.groupBy("event_id").agg(F.ceil(F.count("*") / TOGETHER).alias("blocks"))
    asked = asked.join(parts, "event_id").select("event_id", F.pmod(F.xxhash64("hit_id", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.col("hit_id").alias("src"), "v")
    asked = asked.withColumns({"reach": F.lit(float(r_max) * float(r_max)), "cells": F.array().cast("array<bigint>")})
    near = pivots.drop("blocks").join(balls, ["event_id", "cell"]).join(parts, "event_id").withColumn("block", _spread("blocks")).select(*keys, "cell", "p", "far")
    return asked, near, celled.drop("far")


def _routes(asked: DataFrame, near: DataFrame) -> DataFrame:
    """Query rows (event_id, src, v, reach, cell)."""
    keys = ("event_id", "block")
    lists = asked.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(_routed, "event_id long, src long, v array<double>, reach double, to array<long>")
    return lists.select("event_id", "src", "v", "reach", F.explode("to").alias("cell"))


def _crowded(asked: DataFrame, near: DataFrame) -> DataFrame:
    """(event_id) of the events whose queries reach more than WORTH cells on average; some ASKED queries of an event tell.

    Either way gives the same pairs; this only settles how they are found.
    """
    keys = ("event_id", "block")
    sizes = asked.groupBy("event_id").agg(F.ceil(F.count("*") / ASKED).alias("one_of"))
    some = asked.join(sizes, "event_id").where(F.pmod(F.xxhash64("src", F.lit(7)), F.col("one_of")) == 0).drop("one_of")

    def reached(points: pa.Table, pivots: pa.Table) -> pa.Table:
        cells = sum(int(x.sum()) for _, _, x in _reachable(points, pivots))
        event = (points if points.num_rows else pivots)["event_id"][0].as_py()
        return pa.table({"event_id": pa.array([event], pa.int64()), "n": pa.array([points.num_rows], pa.int64()), "cells": pa.array([cells], pa.int64())})

    told = some.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(reached, "event_id long, n long, cells long")
    return told.groupBy("event_id").agg(F.sum("n").alias("n"), F.sum("cells").alias("cells")).where(F.col("cells") > WORTH * F.col("n")).select("event_id")


def _first_wave(asked: DataFrame, near: DataFrame, celled: DataFrame, k_max: int) -> tuple[DataFrame, DataFrame]:
    """The queries with the cells they have met and no more than their k-th distance there as reach, and the pairs found."""
    keys = ("event_id", "block")
    first = asked.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(_first, "event_id long, src long, v array<double>, reach double, cells array<long>")
    first = stored(first.withColumn("block", F.lit(0)))
    found = stored(_nearest(_met(first.select("event_id", "src", "v", "reach", F.explode("cells").alias("cell")), celled, k_max), k_max))
    bounds = found.groupBy("event_id", "src").agg(F.count("*").alias("n"), F.max("d2").alias("bound")).where(F.col("n") >= k_max)
    rest = first.drop("block").join(bounds.drop("n"), ["event_id", "src"], "left").withColumn("reach", F.coalesce("bound", "reach")).drop("bound")
    blocks = near.groupBy("event_id").agg((F.max("block") + 1).alias("blocks"))
    return rest.join(blocks, "event_id").withColumn("block", F.pmod(F.xxhash64("src", F.lit(1)), F.col("blocks")).cast("int")).drop("blocks"), found


def _celled_events(query: DataFrame, database: DataFrame, sizes: DataFrame, r_max: float, k_max: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Query rows, database rows (event_id, cell, dst, w) and, with k_max, the pairs of a first wave, which the query rows do not meet again."""
    asked, near, celled = _cells(query, database, sizes, r_max)
    found = None
    if k_max is not None:
        asked, found = _first_wave(asked, near, celled, k_max)
    return _routes(asked, near), celled, found


def _scanned(left: DataFrame, right: DataFrame, k_max: int | None) -> DataFrame:
    """(event_id, src, dst, d2) of the queries (event_id, src, v, reach) and all points (event_id, dst, w) of their events.

    A partition is sorted so that the queries of a block come before the points that go
    past them; the block keeps the k_max nearest of each query, or hands on all pairs.
    All points of an event of up to PAST go past one block of it, whose nearest are
    the nearest of all; only what several tasks have found is ranked again.
    """
    most = min(MOST, max(_CHUNK, KEPT // k_max)) if k_max else MOST
    sizes = left.groupBy("event_id").agg(F.count("*").alias("q")).join(right.groupBy("event_id").agg(F.count("*").alias("n")), "event_id")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("q") / F.least(F.greatest(F.lit(QUERIES), F.ceil(F.col("q") / BLOCKS)), F.lit(most))))
    sizes = stored(sizes.select("event_id", "blocks", F.least(F.ceil(BLOCKS / F.col("blocks")), F.ceil(F.col("n") / PAST)).alias("splits")))
    tasks, splits = sizes.agg(F.sum(F.col("blocks") * F.col("splits")), F.max("splits")).first()
    parts = min(tasks or 1, PARTITIONS)
    dealt = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.col(n)).cast("int")
    asked = left.join(sizes, "event_id").withColumn("block", dealt("src", "blocks", 5)).withColumn("split", _spread("splits"))
    points = right.join(sizes, "event_id").withColumn("split", dealt("dst", "splits", 6)).withColumn("block", _spread("blocks"))
    keys = ("event_id", "block", "split")
    slot = F.pmod(F.xxhash64("event_id") % PARTITIONS + F.col("block") * F.col("splits") + F.col("split"), F.lit(parts)).cast("int").alias("slot")
    rows = asked.select(slot, *keys, F.lit(0).alias("side"), F.col("src").alias("id"), "v", "reach").unionByName(points.select(slot, *keys, F.lit(1).alias("side"), F.col("dst").alias("id"), F.col("w").alias("v"), F.lit(0.0).alias("reach")))
    rows = rows.repartitionById(parts, F.col("slot")).drop("slot").sortWithinPartitions(*keys, "side")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, block = None, [], None
        for batch in batches:
            own = np.array([batch.column(i).to_numpy() for i in range(4)], np.int64)
            cuts = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if at == end:
                    continue
                if (now := tuple(own[:3, at])) != group:
                    if block is not None:
                        yield from block.rest()
                    group, waiting, block = now, [], None
                rows = pa.Table.from_batches([batch.slice(at, end - at)])
                if own[3, at] == 0:
                    waiting.append(rows)
                elif waiting:
                    block = block or _Block(int(now[0]), pa.concat_tables(waiting), k_max)
                    yield from block.past(rows["id"].to_numpy(), matrix(rows["v"]))
        if block is not None:
            yield from block.rest()

    found = rows.mapInArrow(met, "event_id long, src long, dst long, d2 double")
    return _nearest(found, k_max) if k_max is not None and (splits or 1) > 1 else found


class _Block:
    """Queries that points go past."""

    def __init__(self, event: int, queries: pa.Table, k_max: int | None):
        self.event, self.k_max = event, k_max
        self.ids, self.v, self.reach = queries["id"].to_numpy(), matrix(queries["v"]), queries["reach"].to_numpy().copy()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.many = self.kept = 0

    def past(self, ids: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for q, r, d2 in _by_chunk(self.v, rows, self.reach, self.k_max, ids):
            self.found.append((q, ids[r], d2))
            self.many += len(q)
            if self.k_max is None and self.many >= PAIRS:
                yield from self.rest()
        if self.k_max is not None and self.many >= max(2 * self.kept, PAIRS):
            self._settle()

    def _settle(self) -> None:
        """Keeps the nearest; from now on a query that has all of them looks no farther than the last."""
        q, dst, d2 = (np.concatenate(x) for x in zip(*self.found, strict=True))
        first = _first_of(q, d2, dst, self.k_max)
        q, dst, d2 = q[first], dst[first], d2[first]
        last = np.flatnonzero(np.r_[q[1:] != q[:-1], True])
        full = last[np.diff(np.r_[-1, last]) == self.k_max]
        self.reach[q[full]] = d2[full]
        self.found, self.many = [(q, dst, d2)], len(q)
        self.kept = len(q)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.found and self.k_max is not None:
            self._settle()
            own, same = np.unique(self.ids, return_inverse=True)
            if len(own) < len(self.ids):  # the rows of an id count as one query
                q, dst, d2 = self.found[0]
                first = _first_of(same[q], d2, dst, self.k_max)
                self.found = [(q[first], dst[first], d2[first])]
        found, self.found, self.many = self.found, [], 0
        for q, dst, d2 in found:
            for at in range(0, len(q), PAIRS):
                own = q[at : at + PAIRS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), self.event), pa.int64()), pa.array(self.ids[own], pa.int64()), pa.array(dst[at : at + PAIRS], pa.int64()), pa.array(d2[at : at + PAIRS], pa.float64())], names=["event_id", "src", "dst", "d2"])


def _nearest(found: DataFrame, k_max: int) -> DataFrame:
    nearest = Window.partitionBy("event_id", "src").orderBy("d2", "dst")
    return found.withColumn("__k", F.row_number().over(nearest)).where(F.col("__k") <= k_max).drop("__k")


def _met(left: DataFrame, right: DataFrame, k_max: int | None) -> DataFrame:
    """(event_id, src, dst, d2) of the queries (event_id, cell, src, v, reach) and the points (event_id, cell, dst, w) of the same cells."""
    # as many parts as queries and points together ask for; a part of one side meets every part of the other
    counted = lambda df, most, name: df.groupBy("event_id", "cell").agg(F.ceil(F.count("*") / most).alias(name))
    cells = counted(left, QUERIES, "parts").join(counted(right, ROWS, "blocks"), ["event_id", "cell"])
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = left.join(cells, ["event_id", "cell"]).withColumn("part", place("src", "parts")).withColumn("block", _spread("blocks"))
    right = right.join(cells, ["event_id", "cell"]).withColumn("block", place("dst", "blocks")).withColumn("part", _spread("parts"))
    keys = ("event_id", "cell", "block", "part")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        src, dst = (t[c].to_numpy() if t.num_rows else np.zeros(0, np.int64) for t, c in ((a, "src"), (b, "dst")))
        q, r, d2 = within(matrix(a["v"]), matrix(b["w"]), a["reach"].to_numpy(), k_max, dst) if len(src) and len(dst) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        event = (a if a.num_rows else b)["event_id"][0].as_py()
        return pa.table({"event_id": pa.array(np.full(len(q), event), pa.int64()), "src": pa.array(src[q], pa.int64()), "dst": pa.array(dst[r], pa.int64()), "d2": pa.array(d2, pa.float64())})

    return left.select(*keys, "src", "v", "reach").groupBy(*keys).cogroup(right.select(*keys, "dst", "w").groupBy(*keys)).applyInArrow(meet, "event_id long, src long, dst long, d2 double")


def radius_join(query: DataFrame, database: DataFrame, r_max: float, k_max: int | None = None, loops: bool = False) -> DataFrame:
    """(event_id, src, dst, d2): for each query point the k_max nearest database points within r_max.

    Both sides are (event_id, hit_id, v array<double>), the vectors of an event of one
    length. The boundary counts as inside, ties go to the smaller hit_id, and, as in
    the original, a point itself takes one of the k_max places before loops are
    dropped. Rows with a null in any of the three columns take no part. What one task
    holds is bounded by ROWS, QUERIES, TOGETHER, MOST and KEPT, and the pivots of an
    event, twice the root of its size; nothing that grows with an event is broadcast or
    sent to the driver. A scanned event costs a comparison for all its pairs.
    """
    query, database = (df.select(F.col("event_id").cast("long").alias("event_id"), F.col("hit_id").cast("long").alias("hit_id"), F.col("v").cast("array<double>").alias("v")).dropna() for df in (query, database))
    sizes = database.groupBy("event_id").agg(F.count("*").alias("n"))
    left = query.select("event_id", F.col("hit_id").alias("src"), "v", F.lit(float(r_max) * float(r_max)).alias("reach"))
    right = database.select("event_id", F.col("hit_id").alias("dst"), F.col("v").alias("w"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= ROWS:
        found = _scanned(left, right, k_max)
    else:
        sizes = stored(sizes)
        asked, near, celled = _cells(query, database, sizes.where(F.col("n") > ROWS), r_max)
        first = None
        if k_max is not None:
            asked, first = _first_wave(asked, near, celled, k_max)
        asked = stored(asked)
        crowded = stored(_crowded(asked, near))
        sparse = stored(sizes.where(F.col("n") > ROWS).join(crowded, "event_id", "left_anti").select("event_id"))
        rest = sizes.select("event_id").join(sparse, "event_id", "left_anti")
        found = None
        if not rest.isEmpty():
            bounded = asked.join(crowded, "event_id").select(*left.columns).unionByName(left.join(sizes.where(F.col("n") <= ROWS).select("event_id"), "event_id").select(*left.columns))
            found = _scanned(bounded, right.join(rest, "event_id").select(*right.columns), k_max)
        if not sparse.isEmpty():
            routed = stored(_routes(asked.join(sparse, "event_id", "left_semi"), near))
            celled = _met(routed, celled, k_max)
            if first is not None:
                celled = _nearest(celled.unionByName(first.join(sparse, "event_id", "left_semi").select(*celled.columns)), k_max)
            found = celled if found is None else found.unionByName(celled)
    return found if loops else found.where("src <> dst")


def remapped(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Local query indices to global ids: `ids` is (event_id, local, global)."""
    return edges.join(ids.select("event_id", F.col("local").alias("src"), "global"), ["event_id", "src"]).select("event_id", F.col("global").alias("src"), "dst", *(c for c in edges.columns if c not in ("event_id", "src", "dst")))
