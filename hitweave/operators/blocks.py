"""Networks over the edges of events whose edges are many times their nodes.

The nodes of an event are dealt into parts, its edges into blocks, one for each pair of
parts, and a node goes to the blocks of its part. So a block has edges of bounded number
and the nodes of two parts, and what an edge gathers from its ends exists in a task
only: it is neither shuffled nor written. Edge vectors are worked out again from the node
vectors of all rounds so far wherever they are needed; what leaves a block are edges,
scores, sums for nodes and moments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.operators import nn
from hitweave.operators.neighbours import matrix
from hitweave.session import discard, stored

#: Edges of a block on average, how many times as many where an event has more than MANY blocks, and edges whose vectors are worked out together.
BLOCK, FULLER, MANY, CHUNK = 1 << 19, 4, 64, 1 << 15
BLOCK_KEYS = ("event_id", "part")

#: Node columns by name, and the places of both ends of some edges.
Inputs = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def dealt(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges with their `part`, a pair of the parts of nodes, both directions in one, and (event_id, parts); `edges` are read twice.

    A node and its sums go through as many blocks as there are parts, so large events have fuller blocks.
    """
    n = F.count("*")
    blocks = F.ceil(n / F.least(F.greatest(n / MANY, F.lit(BLOCK)), F.lit(FULLER * BLOCK)))
    parts = stored(edges.groupBy("event_id").agg(F.ceil((F.sqrt(8 * blocks + 1) - 1) / 2).cast("int").alias("parts")))
    part = _pair(_part("src"), _part("dst")).alias("part")
    return edges.join(parts, "event_id").select("event_id", part, *(c for c in edges.columns if c != "event_id")), parts


def _part(node: str) -> Column:
    return F.pmod(F.xxhash64(F.col(node).cast("long"), F.lit(9)), F.col("parts")).cast("int")


def _pair(a: Column, b: Column) -> Column:
    return F.least(a, b) * F.col("parts") + F.greatest(a, b)


def met(edges: DataFrame, nodes: DataFrame, parts: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`run` of each block's edges and the nodes of its two parts."""
    there = nodes.join(parts, "event_id").withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: _pair(_part("hit_id"), other)))).drop("parts")
    return edges.groupBy(*BLOCK_KEYS).cogroup(there.groupBy(*BLOCK_KEYS)).applyInArrow(run, schema)


def placed(edges: pa.Table, nodes: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The edges that have both ends among the nodes, and the places of their ends there."""
    ids = nodes["hit_id"].to_numpy()
    if not len(ids) or not edges.num_rows:
        return edges.slice(0, 0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    at = [order[np.minimum(np.searchsorted(ids[order], edges[end].to_numpy()), len(ids) - 1)] for end in ("src", "dst")]
    there = (ids[at[0]] == edges["src"].to_numpy()) & (ids[at[1]] == edges["dst"].to_numpy())
    return (edges, *at) if there.all() else (edges.filter(pa.array(there)), *(x[there] for x in at))


def _vectors(nodes: pa.Table) -> dict[str, np.ndarray]:
    """The array columns as matrices. A null array or one with a null component is all NaN, and `null` marks its node."""
    out: dict[str, np.ndarray] = {"null": np.zeros(nodes.num_rows, bool)}
    for name in nodes.column_names:
        column = nodes[name].combine_chunks()
        if not pa.types.is_list(column.type):
            continue
        whole = pc.is_valid(column).to_numpy(zero_copy_only=False)
        lists = column if whole.all() else column.filter(pa.array(whole))
        x = matrix(lists)
        holes = pc.is_null(lists.flatten()).to_numpy(zero_copy_only=False).reshape(x.shape).any(axis=1) if len(x) else np.zeros(0, bool)
        full = np.full((nodes.num_rows, x.shape[1]), np.nan)
        full[whole] = x
        out[name] = full
        out["null"][~whole] = True
        out["null"][np.flatnonzero(whole)[holes]] = True
    return out


def oriented_distinct(near: DataFrame, nodes: DataFrame, radius: str, break_ties: bool) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (event_id, part, src, dst) from the smaller radius to the larger one, and (event_id, parts); see `edges.oriented`."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, s, d = placed(a, b)
        ids, known = b["hit_id"].to_numpy(), pc.is_valid(b["r"].combine_chunks()).to_numpy(zero_copy_only=False)
        r = b["r"].to_numpy()
        nan = np.isnan(r)
        flip = (r[s] > r[d]) | (nan[s] & ~nan[d])  # as in Spark, NaN is above all numbers
        if break_ties:
            flip |= ((r[s] == r[d]) | (nan[s] & nan[d])) & (ids[s] > ids[d])
        flip &= known[s] & known[d]
        code = np.unique(np.where(flip, d, s) * len(ids) + np.where(flip, s, d)) if len(s) else np.zeros(0, np.int64)
        first, second = np.divmod(code, max(len(ids), 1))
        fixed = [pa.array(np.full(len(code), a[k][0].as_py() if len(code) else 0), t) for k, t in (("event_id", pa.int64()), ("part", pa.int32()))]
        return pa.table({"event_id": fixed[0], "part": fixed[1], "src": pa.array(ids[first]), "dst": pa.array(ids[second])})

    pairs, parts = dealt(near)
    rows = nodes.select("event_id", "hit_id", F.col(radius).cast("double").alias("r"))
    return met(pairs, rows, parts, run, "event_id long, part int, src long, dst long"), parts


def _chunks(n: int) -> Iterator[slice]:
    return (slice(at, at + CHUNK) for at in range(0, n, CHUNK))


def _settled(layers: list[dict], c: dict[str, np.ndarray], tag: str) -> list[dict]:
    """The layers with the moments of this event, which its nodes bring along."""
    return [{**x, "batch_norm": {**x["batch_norm"], "mean": c[f"mean_{tag}_{k}"][0], "var": c[f"var_{tag}_{k}"][0]}} if _open(x) else x for k, x in enumerate(layers)]


def _open(layer: dict) -> bool:
    return layer.get("batch_norm") is not None and "mean" not in layer["batch_norm"]


def with_moments(edges: DataFrame, nodes: DataFrame, parts: DataFrame, inputs: Inputs, layers: list[dict], tag: str) -> DataFrame:
    """The nodes with mean and variance, over the edges of their event, for each batch norm of the layers that has none of its own."""
    for k, layer in enumerate(layers):
        if not _open(layer):
            continue
        head = [*layers[:k], {**layer, "batch_norm": None, "activation": None}]

        def part(a: pa.Table, b: pa.Table) -> pa.Table:
            a, s, d = placed(a, b)
            c = _vectors(b)
            keep = ~(c["null"][s] | c["null"][d])
            s, d = s[keep], d[keep]
            n, mean, spread = 0, 0.0, 0.0
            for at in _chunks(len(s)):
                y = nn.applied(inputs(c, s[at], d[at]), _settled(head, c, tag))
                own, gap = y.mean(axis=0), len(y) / (n + len(y))
                spread = spread + ((y - own) ** 2).sum(axis=0) + (own - mean) ** 2 * n * gap
                mean = mean + (own - mean) * gap
                n += len(y)
            rows = [(a["event_id"][0].as_py(), n, list(mean), list(spread))] if n else []
            return _table(rows, (("event_id", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("spread", pa.list_(pa.float64()))))

        def whole(rows: pa.Table) -> pa.Table:
            n, mean, spread = rows["n"].to_numpy(), matrix(rows["mean"]), matrix(rows["spread"])
            middle = (n[:, None] * mean).sum(axis=0) / n.sum()
            var = (spread + n[:, None] * (mean - middle) ** 2).sum(axis=0) / n.sum()
            return _table([(rows["event_id"][0].as_py(), list(middle), list(var))], (("event_id", pa.int64()), ("mean", pa.list_(pa.float64())), ("var", pa.list_(pa.float64()))))

        moments = met(edges, nodes, parts, part, "event_id long, n long, mean array<double>, spread array<double>")
        moments = moments.groupBy("event_id").applyInArrow(whole, "event_id long, mean array<double>, var array<double>")
        nodes = stored(nodes.join(moments.select("event_id", F.col("mean").alias(f"mean_{tag}_{k}"), F.col("var").alias(f"var_{tag}_{k}")), "event_id"))
    return nodes


def _table(rows: list[tuple], fields: tuple) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(fields)})


def scored(edges: DataFrame, nodes: DataFrame, parts: DataFrame, inputs: Inputs, layers: list[dict], tag: str = "y") -> DataFrame:
    """(event_id, part, src, dst, score): sigmoid of the layers applied to what `inputs` gives for each edge; null where an end has a null."""
    nodes = with_moments(edges, nodes, parts, inputs, layers, tag)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, s, d = placed(a, b)
        c = _vectors(b)
        net = _settled(layers, c, tag) if len(s) else layers
        y = [nn.applied(inputs(c, s[at], d[at]), net)[:, 0] for at in _chunks(len(s))]
        with np.errstate(over="ignore"):
            score = 1 / (1 + np.exp(-np.concatenate(y))) if y else np.zeros(0)
        return a.select(["event_id", "part", "src", "dst"]).append_column("score", pa.array(score, pa.float64(), mask=c["null"][s] | c["null"][d]))

    return met(edges, nodes, parts, run, "event_id long, part int, src long, dst long, score double")


def _sums(edges: DataFrame, nodes: DataFrame, parts: DataFrame, vectors: Inputs, both: bool, size: int) -> DataFrame:
    """(event_id, hit_id, m): sums of the edges' vectors into a node, with `both` out of it too, and then how many those were.

    Where the edges have vectors `e` of their own, `vectors` gets them as well.
    """

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, s, d = placed(a, b)
        c = _vectors(b)
        keep = ~(c["null"][s] | c["null"][d]) if both else np.ones(len(s), bool)
        s, d = s[keep], d[keep]
        own = (matrix(a["e"].filter(pa.array(keep))),) if "e" in a.column_names else ()
        ends = (d, s) if both else (d,)
        total = np.zeros((len(ends) * (size + 1), b.num_rows))
        for at in _chunks(len(s)):
            e = vectors(c, s[at], d[at], *(x[at] for x in own))
            for i, end in enumerate(ends):
                for k in range(size):
                    total[i * size + k] += np.bincount(end[at], weights=e[:, k], minlength=b.num_rows)
                total[len(ends) * size + i] += np.bincount(end[at], minlength=b.num_rows)
        there = np.flatnonzero(total[len(ends) * size :].any(axis=0))
        m = total[:, there].T
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
        event = a["event_id"][0].as_py() if len(there) else 0
        return pa.table({"event_id": pa.array(np.full(len(there), event), pa.int64()), "hit_id": b["hit_id"].take(pa.array(there)), "m": lists})

    sums = met(edges, nodes, parts, run, "event_id long, hit_id long, m array<double>")
    return nn.vector_sum(sums, ["event_id", "hit_id"], "m", (1 + both) * (size + 1))


def _both_ends(c: dict[str, np.ndarray], s: np.ndarray, d: np.ndarray, name: str = "x") -> np.ndarray:
    return np.hstack([c[name][s], c[name][d]])


def encoded_ends(c: dict[str, np.ndarray], s: np.ndarray, d: np.ndarray) -> np.ndarray:
    return _both_ends(c, s, d, "x0")


def gnn_filter(nodes: DataFrame, edges: DataFrame, parts: DataFrame, layers: list[dict], net: list[dict]) -> DataFrame:
    """`nn.gnn_filter` of nodes (event_id, hit_id, x) and edges in blocks."""
    for layer in layers:
        if "neighbour" not in layer:
            nodes = nn.mlp(nodes, "x", [layer], "x")
            continue
        size = len(layer["neighbour"][0])
        sums = _sums(edges, nodes, parts, lambda c, s, d: c["x"][s], False, size)
        mean = F.transform(F.slice("m", 1, size), lambda v: v / F.get("m", F.lit(size)))
        nodes = stored(nn.sage_combined(nodes, sums.withColumn("m", mean), "x", size, layer))
    return scored(edges, nodes, parts, _both_ends, net)


def interaction_gnn(nodes: DataFrame, edges: DataFrame, parts: DataFrame, first: Callable, encoder: list[dict], rounds: list, decoder: list[dict], size: int, aggregate: str = "sum", in_out_diff: bool = True, concat: bool = False) -> DataFrame:
    """Edge scores as those of `nn.interaction_gnn`; `first` gives what the encoder makes the first edge vectors of.

    `nodes` are (event_id, hit_id, x0, ...). A round works the edge vectors of the rounds
    before out again, from the node vectors of each, so the nets of few rounds run more
    than once, but no vector of an edge is written.
    """

    def entering(number: int) -> Inputs:
        """What the edge net of a round gets; the encoder is number 0, and the decoder follows the last round."""

        def inputs(c: dict[str, np.ndarray], s: np.ndarray, d: np.ndarray) -> np.ndarray:
            if number == 0:
                return first(c, s, d)
            start = e = nn.applied(first(c, s, d), _settled(encoder, c, "e0"))
            for k, (edge_net, _) in enumerate(rounds[: number - 1], 1):
                e = nn.applied(joined(c, s, d, e, start, k), _settled(edge_net, c, f"e{k}"))
            return joined(c, s, d, e, start, number) if number <= len(rounds) else e

        return inputs

    def joined(c, s, d, e, start, number) -> np.ndarray:
        x, x0 = c[f"x{number - 1}"], c["x0"]
        return np.hstack([e, start, x[s], x0[s], x[d], x0[d]] if concat else [e, x[s], x[d]])

    nodes = with_moments(edges, stored(nodes), parts, entering(0), encoder, "e0")
    for number, (edge_net, node_net) in enumerate(rounds, 1):
        nodes = with_moments(edges, nodes, parts, entering(number), edge_net, f"e{number}")
        if number == len(rounds):
            break
        inputs = entering(number)
        vectors = lambda c, s, d, i=inputs, t=f"e{number}", net=edge_net: nn.applied(i(c, s, d), _settled(net, c, t))
        sums = _sums(edges, nodes, parts, vectors, True, size)
        own = F.concat(f"x{number - 1}", "x0") if concat else F.col(f"x{number - 1}")
        before, nodes = nodes, stored(_node_round(nodes, sums, own, node_net, f"x{number}", size, aggregate, in_out_diff))
        discard(before)
    return scored(edges, nodes, parts, entering(len(rounds) + 1), decoder)


def _node_round(nodes: DataFrame, sums: DataFrame, own: Column, net: list[dict], out: str, size: int, aggregate: str, in_out_diff: bool) -> DataFrame:
    """The nodes with `out`, the net applied to their messages, sums or means, and their own vectors."""
    means = lambda at, n: F.when(F.get("m", F.lit(n)) > 0, F.transform(F.slice("m", at, size), lambda v: v / F.get("m", F.lit(n))) if aggregate == "mean" else F.slice("m", at, size))
    sums = sums.select("event_id", "hit_id", means(1, 2 * size).alias("__in"), means(size + 1, 2 * size + 1).alias("__out"))
    zero = F.array_repeat(F.lit(0.0), size)
    df = nodes.join(sums, ["event_id", "hit_id"], "left").withColumns({n: F.coalesce(n, zero) for n in ("__in", "__out")})
    message = F.concat("__in", "__out") if in_out_diff else F.zip_with("__in", "__out", lambda a, b: a + b)
    return nn.mlp(df.withColumn("__x", F.concat(message, own)), "__x", net, out).drop("__in", "__out", "__x")


def interaction_round(nodes: DataFrame, edges: DataFrame, parts: DataFrame, edge_net: list[dict], node_net: list[dict], size: int, aggregate: str = "sum", in_out_diff: bool = True) -> DataFrame:
    """The nodes of `nn.interaction_round`, from nodes (event_id, hit_id, x) and edges in blocks.

    The edges have vectors `e` of `size`, or of one component that stands for as many.
    """

    def vectors(c: dict[str, np.ndarray], s: np.ndarray, d: np.ndarray, e: np.ndarray) -> np.ndarray:
        return nn.applied(np.hstack([np.broadcast_to(e, (len(e), size)), c["x"][s], c["x"][d]]), edge_net)

    return _node_round(nodes, _sums(edges, nodes, parts, vectors, True, size), F.col("x"), node_net, "x", size, aggregate, in_out_diff)


def edge_features(c: dict[str, np.ndarray], s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The six features of `scalars.edge_features` from `f`, the scaled r, phi, z and eta of the nodes."""
    a, b = c["f"][s], c["f"][d]
    with np.errstate(all="ignore"):
        dr, turn = b[:, 0] - a[:, 0], (b[:, 1] - a[:, 1]) * np.pi
        dphi = np.where(turn > np.pi, turn - 2 * np.pi, np.where(turn < -np.pi, turn + 2 * np.pi, turn)) / np.pi
        flat = np.where((dphi > 0) | np.isnan(dphi), 100.0, np.where(dphi < 0, -100.0, 0.0))
        steep = np.where(dr == 0, flat, np.maximum(-100.0, np.fmin(100.0, dphi / np.where(dr == 0, 1.0, dr))))
        rphi = (b[:, 0] + a[:, 0]) / 2 * steep
    return np.column_stack([dr, dphi, b[:, 2] - a[:, 2], b[:, 3] - a[:, 3], steep, np.where(np.isnan(rphi), 0.0, rphi)])
