"""Approximate nearest neighbours on several shifted Hilbert curves.

Each curve orders the vectors by the Hilbert index of a random projection of its own,
shifted by a random step, and its order is cut into ranges of about equal size. On
every curve a query is compared with its own range and the neighbouring ones, by codes
of one byte a component. The windows' lists are merged, and the best of them are
ranked anew by exact scores. Ranges are dealt out in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.vectors import QUERY_EVERY, by_dimension, codes, matrix, query_vectors, ranked, valid_vectors
from hitweave.session import cut

K = 20
CURVES, DIMENSIONS, BITS, SEED = 24, 6, 5, 11
#: Ranges of a curve, neighbours on either side, fewest rows of a range, and bounds of what one task compares.
RANGES, BESIDE, LEAST_ROWS, ROWS, QUERIES = 75, 1, 32, 8192, 4096
#: Rows beyond k that a window hands on, as codes may order the last ones wrongly.
SPARE = 10


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points [n, p] with `bits` bits a coordinate.

    After J. Skilling, Programming the Hilbert curve (2004): undo the rotations from
    the top bit down, then Gray-decode, then interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        bit = 1 << level
        low = bit - 1
        for row in x:
            flip = (row & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ row) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            row ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    index = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for row in x:
            index = index << 1 | row >> level & 1
    return index


def curve_keys(x: np.ndarray, scale: float, curves: int, dimensions: int, bits: int, seed: int) -> np.ndarray:
    """[n, curves] Hilbert indices; `scale` is the spread of a component."""
    rng = np.random.default_rng([seed, x.shape[1]])
    keys = np.empty((len(x), curves), dtype=np.int64)
    for c in range(curves):
        basis = np.linalg.qr(rng.normal(size=(x.shape[1], min(dimensions, x.shape[1]))))[0]
        shift = rng.uniform(-0.5, 0.5, size=basis.shape[1])
        even = 1 / (1 + np.exp(-1.702 * (x @ basis / scale + shift)))  # about uniform for a normal spread
        keys[:, c] = hilbert_index(np.minimum((even * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)
    return keys


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[n, d] signed bytes and the number that each row of them is to be multiplied by."""
    scale = np.abs(x).max(axis=1, initial=0.0) / 127
    return np.rint(x / np.where(scale > 0, scale, 1.0)[:, None]).astype(np.int8), scale


def nearest(queries: np.ndarray, query_scale: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_scale: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows with the largest product of codes for each query, ties to the smaller id.

    Products of codes are whole numbers that single precision holds exactly (up to a
    thousand components; then double precision is taken), so a pair has the same score
    wherever it meets.
    """
    order = np.argsort(row_ids, kind="stable")
    kind = np.float32 if rows.shape[1] <= 1000 else np.float64
    ids, table, scale = row_ids[order], rows[order].astype(kind).T, row_scale[order]
    out = []
    for at in range(0, len(queries), 256):
        own = query_ids[at : at + 256]
        scores = (queries[at : at + 256].astype(kind) @ table).astype(np.float64) * query_scale[at : at + 256, None] * scale
        scores[own[:, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            over = scores > edge
            level = scores == edge
            keep = over | level & (np.cumsum(level, axis=1) <= k - over.sum(axis=1, keepdims=True))
        else:
            keep = np.ones(scores.shape, bool)
        q, r = np.nonzero(keep & (scores > -np.inf))
        out.append((own[q], ids[r], scores[q, r]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keyed(vectors: DataFrame, spread: dict[int, float], curves: int, seed: int) -> DataFrame:
    """(vec_id, dim, code, scale, keys): codes and the place on each curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, scale, code = np.zeros((batch.num_rows, curves), np.int64), np.zeros(batch.num_rows), [b""] * batch.num_rows
            for dim, at in by_dimension(batch):
                x = matrix(batch.column("v").take(pa.array(at))).astype(np.float64)
                keys[at] = curve_keys(x, spread.get(dim, 1.0), curves, DIMENSIONS, BITS, seed)
                numbers, scale[at] = coded(x)
                for i, row in zip(at.tolist(), numbers, strict=True):
                    code[i] = row.tobytes()
            lists = pa.FixedSizeListArray.from_arrays(keys.ravel(), curves).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("dim"), pa.array(code, pa.binary()), pa.array(scale), lists], names=["vec_id", "dim", "code", "scale", "keys"])

    return vectors.select("vec_id", "v", "dim").mapInArrow(run, "vec_id long, dim int, code binary, scale double, keys array<long>")


def _placed(keyed: DataFrame, edges: dict[int, list[np.ndarray]]) -> DataFrame:
    """A row for each curve: (vec_id, dim, code, scale, curve, range)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = matrix(batch.column("keys"))
            for dim, at in by_dimension(batch):
                for curve, edge in enumerate(edges[dim]):
                    where = pa.array(np.searchsorted(edge, keys[at, curve], side="right").astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in ("vec_id", "dim", "code", "scale")), pa.array(np.full(len(at), curve, np.int32)), where], names=["vec_id", "dim", "code", "scale", "curve", "range"])

    return keyed.mapInArrow(run, "vec_id long, dim int, code binary, scale double, curve int, range int")


def neighbours(vectors: DataFrame, query_every: int = QUERY_EVERY, k: int = K, curves: int = CURVES, ranges: int = RANGES, beside: int = BESIDE, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id that is divisible by `query_every`, the k nearest found.

    `vectors` is (vec_id, v, dim), as `valid_vectors` makes it; every row is indexed,
    and met by queries of its own dimension. On each curve a query sees 2 * beside + 1
    of the ranges; a range has LEAST_ROWS rows at least. Scores are inner products in
    double precision of the vectors as they are; ties go to the smaller vec_id, a row
    is never its own neighbour. An id that has several vectors is one candidate, scored
    by the best of them, and asks with the least of them. Empty tables give an empty table.
    """
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = {r["dim"]: r for r in vectors.groupBy("dim").agg(F.count("*").alias("n"), F.avg(square).alias("square")).collect()}  # a row for each dimension
    spread = {d: float(np.sqrt((r["square"] or 1.0) / max(d, 1))) or 1.0 for d, r in sizes.items()}
    pieces = {d: max(1, min(ranges, r["n"] // LEAST_ROWS)) for d, r in sizes.items()}
    queries = cut(query_vectors(vectors, query_every))
    keyed = cut(_keyed(vectors, spread, curves, seed))
    parts = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    found = keyed.groupBy("dim").agg(*(F.percentile_approx(F.col("keys")[c], parts, 2000).alias(str(c)) for c in range(curves))).collect() if ranges > 1 else []
    edges = {d: [np.zeros(0, np.int64)] * curves for d in sizes}
    for r in found:
        wanted = [round(i * ranges / pieces[r["dim"]]) - 1 for i in range(1, pieces[r["dim"]])]
        edges[r["dim"]] = [np.array([r[str(c)][i] for i in wanted], dtype=np.int64) for c in range(curves)]

    rows = _placed(keyed, edges)
    last = F.element_at(F.map_from_arrays(F.array(*map(F.lit, pieces)), F.array(*(F.lit(n - 1) for n in pieces.values()))), F.col("dim")) if pieces else F.lit(0)
    first = F.greatest(F.lit(0), F.least(F.col("range") - beside, last - 2 * beside))
    asked = _placed(_keyed(queries, spread, curves, seed), edges).withColumn("range", F.explode(F.sequence(first, F.least(last, first + 2 * beside))))
    place = ["dim", "curve", "range"]
    counts = rows.select(*place, F.lit(1).alias("r"), F.lit(0).alias("q")).unionAll(asked.select(*place, F.lit(0), F.lit(1))).groupBy(*place).agg(F.sum("r").alias("r"), F.sum("q").alias("q"))
    counts = cut(counts.where("r > 0 AND q > 0").select(*place, F.ceil(F.col("r") / ROWS).cast("int").alias("chunks"), F.ceil(F.col("q") / QUERIES).cast("int").alias("parts")))
    spread_over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(counts, place).withColumn("chunk", F.pmod(F.xxhash64("vec_id", "code"), F.col("chunks")).cast("int")).withColumn("part", spread_over("parts"))
    right = asked.join(counts, place).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("chunk", spread_over("chunks"))
    keys = (*place, "chunk", "part")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        got: tuple = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        if a.num_rows and b.num_rows:
            dim = a["dim"][0].as_py()
            (rc, rs, ri), (qc, qs, qi) = ((codes(t["code"], dim).view(np.int8), t["scale"].to_numpy(), t["vec_id"].to_numpy()) for t in (a, b))
            got = nearest(qc, qs, qi, rc, rs, ri, k + SPARE)
        return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "rough": pa.array(got[2], pa.float64())})

    columns = (*keys, "vec_id", "code", "scale")
    met = left.select(*columns).groupBy(*keys).cogroup(right.select(*columns).groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, rough double")
    # a pair that meets on several curves has one score, so equal ranks; each task keeps its best before the shuffle
    best = Window.partitionBy("query_id").orderBy(F.desc("rough"), "vec_id")
    merged = met.withColumn("place", F.dense_rank().over(best)).where(F.col("place") <= 2 * k).select("query_id", "vec_id").distinct()
    exact = merged.join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim"), "query_id").join(vectors, ["vec_id", "dim"])
    score = F.aggregate(F.zip_with("q", "v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return ranked(exact.groupBy("query_id", "vec_id").agg(F.max(score).alias("score")), k)


def op9_ann(embeddings: DataFrame) -> DataFrame:
    """Each 20th row's 20 nearest rows found."""
    return neighbours(valid_vectors(embeddings, zero=False, double=False))
