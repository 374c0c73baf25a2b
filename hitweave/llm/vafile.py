"""Exact top-k search by vector-approximation files.

The file holds a cell number of one byte for each component. Cells are equally wide
where nearly all values of a bounded sample of the vectors lie; the two outer ones hold
the rest, up to the smallest and the largest value there is, so that a few values far
out leave the others' cells narrow. The file is made once, an eighth of the size of the vectors, and scanned in pairs of blocks, rows
by queries, of bounded size; the cells give a lower and an upper bound of every score,
and only rows whose upper bound reaches the k-th lower bound leave a block. Then exact
vectors are read by a join, in the order of the bounds and in two waves: the k rows
with the highest bounds of each query first, which makes its k-th score so far known,
and then the rows whose bound is not below that score. After these the k-th result is
certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.vectors import QUERY_EVERY, by_dimension, codes, matrix, query_vectors, valid_vectors
from hitweave.session import cut

K = 20
SCALE = 64
CELLS = 256
#: Rows that the inner cells are fitted on, at most, and the share of values that they leave out at either end.
SAMPLE, TAIL = 4096, 0.002
#: Rows and queries of a pair of blocks.
ROWS, QUERIES = 1 << 15, 1 << 12
_CHUNK = 128


def extent(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The smallest and largest value of each component, by dimension; tasks send one row for each dimension they saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, at in by_dimension(batch):
                x = matrix(batch.column("v").take(pa.array(at)))
                low, high = seen.get(dim, (np.full(dim, np.inf), np.full(dim, -np.inf)))
                seen[dim] = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        rows = [(d, i, low[i], high[i]) for d, (low, high) in seen.items() for i in range(d)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["dim", "i", "low", "high"])

    bounds = vectors.select("v", "dim").mapInArrow(run, "dim int, i int, low double, high double")
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.zeros(0), np.zeros(0))}
    for r in bounds.groupBy("dim", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # a row for each component
        low, high = out.setdefault(r["dim"], (np.zeros(r["dim"]), np.zeros(r["dim"])))
        low[r["i"]], high[r["i"]] = r["low"], r["high"]
    return out


def grids(vectors: DataFrame) -> dict[int, Grid]:
    """The cells for each dimension, from exact extremes and a sample of SAMPLE rows by a hash of their number."""
    chosen = vectors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("dim", "v").toArrow().combine_chunks()
    sample = {d: matrix(chosen["v"].take(pa.array(at))).astype(float) for batch in chosen.to_batches() for d, at in by_dimension(batch)}
    return {d: Grid(low, high, sample.get(d, np.zeros((0, d)))) for d, (low, high) in extent(vectors).items()}


class Grid:
    """The cells of vectors of one dimension."""

    def __init__(self, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        """`low` and `high` are the extremes, `sample` [n, d] some of the vectors."""
        a, b = np.quantile(sample, [TAIL, 1 - TAIL], axis=0) if len(sample) else (low, high)
        self.start = np.maximum(a - (b - a) / 4, low)
        end = np.minimum(b + (b - a) / 4, high)
        self.width = np.where(end > self.start, (end - self.start) / (CELLS - 2), 1.0)
        inner = self.start[:, None] + self.width[:, None] * (np.arange(1, CELLS - 1) - 0.5)
        rest = self.start + self.width * (CELLS - 2)
        below, above = np.minimum(low, self.start), np.maximum(high, rest)
        #: [d, cells] middle of each cell, and how far values can be from it, with room for the rounding of borders
        self.middle = np.column_stack([(below + self.start) / 2, inner, (rest + above) / 2])
        half = np.column_stack([(self.start - below) / 2, np.repeat(self.width[:, None] / 2, CELLS - 2, axis=1), (above - rest) / 2])
        room = np.maximum(np.abs(below), np.abs(above))[:, None] * 2.0**-50
        self.half = half * (1 + 1e-6) + np.where(np.arange(CELLS) % (CELLS - 1) == 0, room, 1e-14 * (np.abs(self.start) + CELLS * self.width)[:, None])

    def numbers(self, x: np.ndarray) -> np.ndarray:
        """[n, d] bytes: the cell that each component is in."""
        return np.clip(np.floor((x - self.start) / self.width) + 1, 0, CELLS - 1).astype(np.uint8)


def bounds_of(queries: np.ndarray, cells: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """[queries, rows] scores of the cells' middles, and how far the exact scores can be from them.

    The slack covers half a cell for each component and the rounding of the product in
    single precision. Rows with inner cells alone share the slack of a query; the few
    others have their own.
    """
    d = queries.shape[1]
    place = np.arange(d)
    rounding = (d + 4) * 2.0**-22
    size = np.abs(queries)
    middle = (queries.astype(np.float32) @ grid.middle.astype(np.float32)[place, cells].T).astype(np.float64)
    inner = grid.half[:, 1:-1].max(axis=1) + np.abs(grid.middle[:, 1:-1]).max(axis=1) * rounding if d else np.zeros(0)
    slack = np.repeat((size @ inner + 1e-30)[:, None], len(cells), axis=1)
    outer = np.flatnonzero(((cells == 0) | (cells == CELLS - 1)).any(axis=1))
    if len(outer):
        own = (grid.half + np.abs(grid.middle) * rounding)[place, cells[outer]]
        slack[:, outer] = size @ own.T + 1e-30
    return middle, slack


def scan(queries: np.ndarray, query_ids: np.ndarray, cells: np.ndarray, row_ids: np.ndarray, grid: Grid, k: int):
    """(query id, row place, upper bound, lower bound) of what may be among the k best rows of a block."""
    out = []
    for at in range(0, len(queries), _CHUNK):
        ids = query_ids[at : at + _CHUNK]
        middle, slack = bounds_of(queries[at : at + _CHUNK], cells, grid)
        lower, upper = middle - slack, middle + slack
        lower[ids[:, None] == row_ids[None, :]] = -np.inf
        sure = np.partition(lower, -k, axis=1)[:, -k] if len(cells) > k else np.full(len(ids), -np.inf)
        q, r = np.nonzero((upper >= sure[:, None]) & (lower > -np.inf))
        out.append((ids[q], r, upper[q, r], lower[q, r]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _exact(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, vec_id, row, score) of pairs, their exact vectors read by a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows, batch.column("v").type.value_type.to_pandas_dtype())
            for _, at in by_dimension(batch):
                score[at] = np.einsum("ij,ij->i", *(matrix(batch.column(c).take(pa.array(at))) for c in ("q", "v")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query_id", "vec_id", "row")), pa.array(score)], names=["query_id", "vec_id", "row", "score"])

    kind = vectors.schema["v"].dataType.elementType.simpleString()
    both = pairs.join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").join(vectors.select("row", "v", "dim"), "row")
    return both.select("query_id", "vec_id", "row", "q", "v", "dim").mapInArrow(run, f"query_id long, vec_id long, row long, score {kind}")


def _few_copies(vectors: DataFrame, k: int) -> DataFrame:
    """Of rows with equal vectors, whose scores are equal, those that can be among the first k: the smallest k + 1 ids, k rows of each.

    Only hashes are counted; where some repeat, the rows that have them are compared.
    Each task keeps as many before the shuffle, so a very common vector is a few rows.
    """
    hashed = vectors.select("row", F.xxhash64("v").alias("h"))
    common = cut(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    if common.isEmpty():
        return vectors
    repeated = cut(hashed.join(common, "h", "left_semi").select("row"))
    same = Window.partitionBy("v", "vec_id").orderBy("row")
    rows = vectors.join(repeated, "row", "left_semi").withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k)
    few = rows.withColumn("copy", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("copy") <= k + 1)
    return vectors.join(repeated, "row", "left_anti").select(*vectors.columns).unionByName(few.select(*vectors.columns))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, rows: int = ROWS, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` with the highest inner product for each row of `queries`.

    Both are (vec_id, v, dim), as `valid_vectors` and `query_vectors` make them; v is
    an array of long, whose scores are exact as long as they fit a long, or of double.
    A query meets the rows of its own dimension. Ties go to the smaller vec_id; a row
    is never its own neighbour; where there are fewer rows than k, all are returned. A
    vec_id that occurs twice is two candidates, also where its rows are equal. Empty
    tables give an empty table.
    """
    vectors = cut(vectors.withColumn("row", F.monotonically_increasing_id()))  # numbers of a written table: the same whenever it is read
    few = _few_copies(vectors, k)
    vectors = vectors if few is vectors else cut(few)
    queries = cut(queries)
    grid = grids(vectors)
    counts = vectors.agg(F.count("*").alias("n")).first()["n"], queries.count()
    row_blocks, query_blocks = max(1, -(-counts[0] // rows)), max(1, -(-counts[1] // query_rows))

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [b""] * batch.num_rows
            for dim, at in by_dimension(batch):
                numbers = grid[dim].numbers(matrix(batch.column("v").take(pa.array(at))))
                for i, row in zip(at.tolist(), numbers, strict=True):
                    cells[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "dim")), pa.array(cells, pa.binary())], names=["row", "vec_id", "dim", "cells"])

    file = cut(vectors.select("row", "vec_id", "dim", "v").mapInArrow(approximate, "row long, vec_id long, dim int, cells binary"))
    copies = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    left = file.select("row", "vec_id", "dim", "cells", F.pmod(F.xxhash64("row"), F.lit(row_blocks)).cast("int").alias("row_block"), copies(query_blocks, "query_block"))
    right = queries.select("vec_id", "dim", F.transform("v", lambda x: x.cast("double")).alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("query_block"), copies(row_blocks, "row_block"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        row = vec = np.zeros(0, np.int64)
        if a.num_rows and b.num_rows:
            dim, row, vec = a["dim"][0].as_py(), a["row"].to_numpy(), a["vec_id"].to_numpy()
            found = scan(matrix(b["v"]), b["vec_id"].to_numpy(), codes(a["cells"], dim), vec, grid[dim], k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(vec[found[1]], pa.int64()), "row": pa.array(row[found[1]], pa.int64()), "upper": pa.array(found[2]), "lower": pa.array(found[3])})

    keys = ("dim", "query_block", "row_block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, row long, upper double, lower double")
    by = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "row"))
    sure = F.max(F.when(F.col("low_place") == k, F.col("lower"))).over(Window.partitionBy("query_id"))
    bounded = found.withColumn("low_place", by("lower")).withColumn("sure", sure).where("sure IS NULL OR upper >= sure")
    bounded = cut(bounded.withColumn("place", by("upper")).select("query_id", "vec_id", "row", "upper", "place"))
    first = cut(_exact(bounded.where(F.col("place") <= k), queries, vectors))
    kth = first.groupBy("query_id").agg(F.min("score").alias("kth"))
    second = bounded.where(F.col("place") > k).join(kth, "query_id").where(F.col("upper") >= F.col("kth").cast("double"))  # the slack covers this rounding too
    both = first.unionByName(_exact(second, queries, vectors))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(embeddings: DataFrame) -> DataFrame:
    """Each 20th row's 20 best rows by the integer inner product of floor(64 x).

    An id's several vectors are as many candidates; as a query it is the least of them.
    Vectors are compared with those of their own length.
    """
    vectors = valid_vectors(embeddings).withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE)))
    found = top_k(vectors, query_vectors(vectors, QUERY_EVERY))
    return found.withColumn("score", F.col("score").cast("long"))


OP6_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS u FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), q AS (SELECT vec_id, min(u) AS u FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
p AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.u, c.u)::BIGINT AS score
    FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.u) = len(c.u)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
