"""Neural operators on injected weights.

A layer is a dict: weight (rows of outputs), bias, activation, and layer_norm. Vectors
are array<double> columns. Small layers become SQL expressions, which stay in the JVM;
large ones run as Arrow-batched matrix products. Weights are model files of fixed size.
Expressions are written as one text a layer: a call to the JVM for each weight took as
long as the jobs of a small event.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.functions.scalars import l2_normalised, layer_norm
from hitweave.operators.edges import gathered
from hitweave.operators.neighbours import matrix
from hitweave.session import discard, stored

def _erf(x, exp, absolute, sign):
    """The error function to 1.5e-7 (Abramowitz and Stegun, 7.1.26)."""
    t = 1 / (1 + 0.3275911 * absolute(x))
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return sign(x) * (1 - series * exp(-x * x))


ACTIVATIONS = {
    None: lambda x: x,
    "ReLU": lambda x: np.maximum(x, 0),
    "Tanh": np.tanh,
    "Sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    "GELU": lambda x: 0.5 * x * (1 + _erf(x * 2**-0.5, np.exp, np.abs, np.sign)),
    "SiLU": lambda x: x / (1 + np.exp(-x)),
}
COLUMN_ACTIVATIONS = {
    None: lambda x: x,
    "ReLU": lambda x: F.greatest(x, F.lit(0.0)),
    "Tanh": F.tanh,
    "Sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "GELU": lambda x: 0.5 * x * (1 + _erf(x * 2**-0.5, F.exp, F.abs, F.signum)),
    "SiLU": lambda x: x / (1 + F.exp(-x)),
}
#: Layers with so many weights, and sums with so many components, are written as expressions; larger ones run in Arrow.
SMALL, WIDE = 256, 32
#: Added to the variance by batch normalisation.
BATCH_EPS = 6e-5


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _double(x) -> str:
    """A literal that reads back as the same double."""
    return f"{float(x)!r}D" if np.isfinite(x) else f"double('{float(x)}')"


def linear(column: str, weight, bias) -> Column:
    """weight @ v + bias for the vectors v of a column, as an array of expressions."""
    v = _quoted(column)
    outputs = (" + ".join([_double(b), *(f"{_double(w)} * get({v}, {i})" for i, w in enumerate(row))]) for row, b in zip(weight, bias, strict=True))
    return F.expr(f"array({', '.join(outputs)})")


def _numbers(values) -> Column:
    return F.expr(f"array({', '.join(map(_double, values))})")


def _merged(how: str, column: str, size: int) -> Column:
    """An array of the aggregates of each component."""
    return F.expr(f"array({', '.join(f'{how}(get({_quoted(column)}, {i}))' for i in range(size))})")


def _affine(norm: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array(norm.get("gamma", [1.0] * size), float), np.array(norm.get("beta", [0.0] * size), float)


def _with_layer(df: DataFrame, column: str, layer: dict) -> DataFrame:
    if "weight" in layer:
        df = df.withColumn(column, linear(column, layer["weight"], layer["bias"]))
    if layer.get("layer_norm"):
        df = df.withColumn(column, layer_norm(F.col(column)))
    if norm := layer.get("batch_norm"):  # statistics that were kept: the same for every row
        gamma, beta = _affine(norm, len(norm["mean"]))
        scale = gamma / np.sqrt(np.array(norm["var"], float) + norm.get("eps", BATCH_EPS))
        scaled = F.zip_with(column, _numbers(scale), lambda x, g: x * g)
        df = df.withColumn(column, F.zip_with(scaled, _numbers(beta - scale * np.array(norm["mean"], float)), lambda x, b: x + b))
    act = COLUMN_ACTIVATIONS[layer.get("activation")]
    return df.withColumn(column, F.transform(column, act)) if layer.get("activation") else df


def applied(x: np.ndarray, layers: list[dict]) -> np.ndarray:
    """Layers that look at one row at a time, on a matrix of rows."""
    for layer in layers:
        if "weight" in layer:
            x = x @ np.array(layer["weight"]).T + np.array(layer["bias"])
        if layer.get("layer_norm"):
            x = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5)
        if norm := layer.get("batch_norm"):
            gamma, beta = _affine(norm, x.shape[1])
            x = (x - np.array(norm["mean"])) / np.sqrt(np.array(norm["var"]) + norm.get("eps", BATCH_EPS)) * gamma + beta
        x = ACTIVATIONS[layer.get("activation")](x)
    return x


def _rowwise(df: DataFrame, column: str, layers: list[dict]) -> DataFrame:
    """Layers that look at one row at a time."""
    if all("weight" not in x or len(x["weight"]) * len(x["weight"][0]) <= SMALL for x in layers):
        for layer in layers:
            df = _with_layer(df, column, layer)
        return df

    @F.arrow_udf("array<double>")
    def apply(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in parts:
            there = pc.is_valid(lists)
            x = matrix(lists.filter(there))
            y = applied(x, layers) if len(x) else x
            ends = np.r_[0, np.cumsum(np.where(there.to_numpy(zero_copy_only=False), y.shape[1], 0))]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(y.ravel(), pa.float64()), mask=pc.invert(there))

    return df.withColumn(column, apply(column))


def batch_normed(df: DataFrame, column: str, size: int, norm: dict, within: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Each component to zero mean and unit (biased) variance over the rows of an event, then gamma and beta."""
    df = stored(df)
    moments = df.groupBy(*within).agg(_merged("avg", column, size).alias("__mean"), _merged("var_pop", column, size).alias("__var"))
    gamma, beta = _affine(norm, size)
    unit = F.zip_with(F.zip_with(column, "__mean", lambda x, m: x - m), "__var", lambda x, v: x / F.sqrt(v + norm.get("eps", BATCH_EPS)))
    shifted = F.zip_with(F.zip_with(unit, _numbers(gamma), lambda x, g: x * g), _numbers(beta), lambda x, b: x + b)
    return df.join(moments, list(within)).withColumn(column, shifted).drop("__mean", "__var")


def mlp(df: DataFrame, column: str, layers: list[dict], out: str) -> DataFrame:
    """Adds `out`: the layers applied to the vectors in `column`. Null vectors stay null.

    In a layer, layer norm comes before batch norm and that before the activation. A
    `batch_norm` is a dict with eps, gamma and beta, all optional; with the mean and var
    that training kept it is a number for each row, without them it uses those of the
    rows of an event, which costs a pass.
    """
    df = df.withColumn(out, F.col(column))
    waiting: list[dict] = []
    for layer in layers:
        norm = layer.get("batch_norm")
        if norm is None or "mean" in norm:
            waiting.append(layer)
            continue
        df = _rowwise(df, out, [*waiting, {**layer, "batch_norm": None, "activation": None}])
        df = batch_normed(df, out, len(layer["bias"]), norm)
        waiting = [{"activation": layer.get("activation")}]
    return _rowwise(df, out, waiting)


def embed(hits: DataFrame, features: list[str], layers: list[dict], out: str = "v") -> DataFrame:
    """Metric-learning embedding: layers, then unit length."""
    df = mlp(hits.withColumn("__x", F.array(*(F.col(c).cast("double") for c in features))), "__x", layers, out)
    return df.withColumn(out, l2_normalised(F.col(out))).drop("__x")


def embed_both(hits: DataFrame, features: list[str], trunk: list[dict], source: list[dict], target: list[dict]) -> DataFrame:
    """A shared trunk and two decoders: src_emb and tgt_emb, each of unit length."""
    df = mlp(hits.withColumn("__x", F.array(*(F.col(c).cast("double") for c in features))), "__x", trunk, "__t")
    for out, layers in (("src_emb", source), ("tgt_emb", target)):
        df = mlp(df, "__t", layers, out)
        df = df.withColumn(out, l2_normalised(F.col(out)))
    return df.drop("__x", "__t")


def _segments(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, and where in it each of their combinations begins."""
    order = np.lexsort(keys[::-1])
    sorted_keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def _wide_sum(rows: DataFrame, keys: list[str], column: str, mean: bool) -> DataFrame:
    """Sums of long vectors: segments of sorted keys are added up in each batch before the shuffle, and once more after it."""
    count = len(keys)
    names = [*keys, column, "__n"]

    def added(keys: list[np.ndarray], x: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        order, first = _segments(keys)
        return [k[order][first] for k in keys], np.add.reduceat(x[order], first, axis=0), np.add.reduceat(n[order], first)

    def made(keys: list[np.ndarray], x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))
        return pa.RecordBatch.from_arrays([*map(pa.array, keys), lists, pa.array(n)], names=names)

    def own(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(count)]

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield made(*added(own(batch), matrix(batch.column(count)), np.ones(batch.num_rows, np.int64)))

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None  # the last segment may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            now = own(batch), matrix(batch.column(count)), batch.column(count + 1).to_numpy()
            if rest is not None:
                now = [np.concatenate(k) for k in zip(rest[0], now[0], strict=True)], np.concatenate([rest[1], now[1]]), np.concatenate([rest[2], now[2]])
            k, x, n = added(*now)
            rest = [c[-1:] for c in k], x[-1:], n[-1:]
            if len(n) > 1:
                yield finished([c[:-1] for c in k], x[:-1], n[:-1])
        if rest is not None:
            yield finished(*rest)

    def finished(keys: list[np.ndarray], x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return made(keys, x / n[:, None] if mean else x, n)

    source = rows.select(*(F.col(k).cast("long").alias(k) for k in keys), column).dropna()
    schema = ", ".join(f"`{k}` long" for k in keys) + f", `{column}` array<double>, __n long"
    partial = source.mapInArrow(before, schema).repartition(*keys).sortWithinPartitions(*keys)
    return partial.mapInArrow(after, schema).drop("__n")


def vector_sum(rows: DataFrame, keys: list[str], column: str, size: int, mean: bool = False) -> DataFrame:
    """Sums (or means) of vectors by key.

    Short vectors are added component by component in an aggregate. Longer ones than
    WIDE, for which that plan would be too long, are added as segments in Arrow; their
    keys are long, and rows with a null in any column are left out.
    """
    if size > WIDE:
        return _wide_sum(rows, keys, column, mean)
    return rows.groupBy(*keys).agg(_merged("avg" if mean else "sum", column, size).alias(column))


def sage_layer(nodes: DataFrame, edges: DataFrame, column: str, size: int, neighbour: list, root: list, bias: list, activation: str | None = None) -> DataFrame:
    """neighbour @ mean of the in-neighbours + root @ own + bias."""
    sent = edges.join(nodes.select("event_id", F.col("hit_id").alias("src"), F.col(column).alias("m")), ["event_id", "src"])
    means = vector_sum(sent.select("event_id", F.col("dst").alias("hit_id"), "m"), ["event_id", "hit_id"], "m", size, True)
    return sage_combined(nodes, means, column, size, {"neighbour": neighbour, "root": root, "bias": bias, "activation": activation})


def sage_combined(nodes: DataFrame, means: DataFrame, column: str, size: int, layer: dict) -> DataFrame:
    """The second half of `sage_layer`: `means` is (event_id, hit_id, m) of the nodes that have in-neighbours."""
    neighbour, root, bias, activation = layer["neighbour"], layer["root"], layer["bias"], layer.get("activation")
    df = nodes.join(means, ["event_id", "hit_id"], "left").withColumn("m", F.coalesce("m", F.array_repeat(F.lit(0.0), size)))
    if size > WIDE:
        both = {"weight": np.hstack([np.array(neighbour, float), np.array(root, float)]).tolist(), "bias": bias, "activation": activation}
        return mlp(df.withColumn("__x", F.concat("m", column)), "__x", [both], column).drop("m", "__x")
    df = df.withColumn("__n", linear("m", neighbour, [0.0] * len(bias))).withColumn("__r", linear(column, root, bias))
    return df.withColumn(column, F.transform(F.zip_with("__n", "__r", lambda a, b: a + b), COLUMN_ACTIVATIONS[activation])).drop("m", "__n", "__r")


def gnn_encoded(nodes: DataFrame, edges: DataFrame, column: str, layers: list[dict]) -> DataFrame:
    """Node vectors after a list of layers: those with `neighbour` weights get messages from their in-neighbours, others look at one row."""
    for layer in layers:
        if "neighbour" in layer:
            nodes = sage_layer(nodes, edges, column, len(layer["neighbour"][0]), layer["neighbour"], layer["root"], layer["bias"], layer.get("activation"))
            nodes = stored(nodes)
        else:
            nodes = mlp(nodes, column, [layer], column)
    return nodes


def gnn_filter(nodes: DataFrame, edges: DataFrame, column: str, layers: list[dict], net: list[dict]) -> DataFrame:
    """Edges with `score`: node vectors after the graph layers, then the net on both ends."""
    return edge_scores(gnn_encoded(nodes, edges, column, layers), edges, column, net)


def edge_scores(nodes: DataFrame, edges: DataFrame, column: str, layers: list[dict], extra: str | None = None, out: str = "score") -> DataFrame:
    """Sigmoid of the layers applied to source, target and (if given) the edge's own vector."""
    joined = gathered(edges, nodes, [column])
    parts = [F.col("s_" + column), F.col("d_" + column), *([F.col(extra)] if extra else [])]
    df = mlp(joined.withColumn("__x", F.concat(*parts)), "__x", layers, "__y")
    return df.withColumn(out, 1 / (1 + F.exp(-F.get("__y", F.lit(0))))).select(*edges.columns, out)


def _edge_round(nodes: DataFrame, edges: DataFrame, net: list[dict]) -> DataFrame:
    joined = gathered(edges, nodes, ["x"])
    rest = [c for c in edges.columns if c != "e"]
    return mlp(joined.withColumn("__x", F.concat("e", "s_x", "d_x")), "__x", net, "__e").select(*rest, F.col("__e").alias("e"))


def _messages(edges: DataFrame, size: int, mean: bool) -> list[DataFrame]:
    """Tables by (event_id, hit_id) of __in and __out, the sums or means of e over the edges into and out of a node.

    Short vectors take one pass over the edges, and one join for both.
    """
    if 2 * size > WIDE:
        ends = (("dst", "__in"), ("src", "__out"))
        return [vector_sum(edges.select("event_id", F.col(end).alias("hit_id"), F.col("e").alias(name)), ["event_id", "hit_id"], name, size, mean) for end, name in ends]
    ends = edges.select("event_id", "e", F.expr("explode(array(struct(dst AS hit_id, true AS into), struct(src AS hit_id, false AS into))) AS end"))
    how = "avg" if mean else "sum"
    sums = {name: ", ".join(f"coalesce({how}(get(e, {i})) FILTER (WHERE {side}), 0.0D)" for i in range(size)) for name, side in (("__in", "end.into"), ("__out", "NOT end.into"))}
    return [ends.groupBy("event_id", "end.hit_id").agg(*(F.expr(f"array({parts}) AS {name}") for name, parts in sums.items()))]


def _node_round(nodes: DataFrame, edges: DataFrame, net: list[dict], size: int, aggregate: str, in_out_diff: bool) -> DataFrame:
    df, zero = nodes, F.array_repeat(F.lit(0.0), size)
    for sums in _messages(edges, size, aggregate == "mean"):
        df = df.join(sums, ["event_id", "hit_id"], "left")
    df = df.withColumns({c: F.coalesce(c, zero) for c in ("__in", "__out")})
    message = F.concat("__in", "__out") if in_out_diff else F.zip_with("__in", "__out", lambda a, b: a + b)
    rest = [c for c in nodes.columns if c != "x"]
    return mlp(df.withColumn("__x", F.concat(message, "x")), "__x", net, "__y").select(*rest, F.col("__y").alias("x"))


def interaction_round(nodes: DataFrame, edges: DataFrame, edge_net: list[dict], node_net: list[dict], size: int, aggregate: str = "sum", in_out_diff: bool = True) -> tuple[DataFrame, DataFrame]:
    """One round: e = edge_net(e, x_src, x_dst); x = node_net(messages in, messages out, x).

    `nodes` hold x and `edges` hold e, vectors of `size`. Without `in_out_diff` the
    two messages are added instead of put side by side.
    """
    edges = _edge_round(nodes, edges, edge_net)
    return _node_round(nodes, edges, node_net, size, aggregate, in_out_diff), edges


def interaction_gnn(nodes: DataFrame, edges: DataFrame, rounds: list[tuple[list[dict], list[dict]]], decoder: list[dict], size: int, aggregate: str = "sum", in_out_diff: bool = True, concat: bool = False) -> DataFrame:
    """Edge scores after the rounds. One pair of nets repeated is the recurrent form, different ones the chained form.

    With `concat`, each round sees the first encodings besides those of the round
    before, of nodes and of edges. The edges of each round are written before its nodes,
    which are made of them, so that a lost executor costs one round and no net runs
    twice; the nodes of the last round, which no score depends on, are not made.
    """
    if concat:
        nodes, edges = nodes.withColumn("x0", F.col("x")), edges.withColumn("e0", F.col("e"))
    before: tuple[DataFrame, ...] = ()
    for number, (edge_net, node_net) in enumerate(rounds, 1):
        if concat:
            nodes, edges = nodes.withColumn("x", F.concat("x", "x0")), edges.withColumn("e", F.concat("e", "e0"))
        edges = stored(_edge_round(nodes, edges, edge_net))
        if number < len(rounds):
            nodes = stored(_node_round(nodes, edges, node_net, size, aggregate, in_out_diff))
        discard(*before)
        before = nodes, edges
    logits = mlp(edges, "e", decoder, "__y")
    return logits.withColumn("score", 1 / (1 + F.exp(-F.get("__y", F.lit(0))))).drop("__y", "e", *(["e0"] if concat else []))
