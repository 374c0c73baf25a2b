"""Weights of networks as a table, and the contract that they have to keep.

A row is (model, layer, kind, i, j, value, text): component (i, j) of what `kind` names
in a layer, or one of a layer's or model's settings, whose words are in `text`. Rounds are
models of their own, `rounds/0/edge` and `rounds/0/node`.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from hitweave.operators.nn import ACTIVATIONS
from hitweave.schema import PipelineConfig

SCHEMA = "model string, layer int, kind string, i int, j int, value double, text string"
#: What a layer holds as numbers; other entries are settings.
NUMBERS = ("weight", "bias", "neighbour", "root")
SETTINGS = "settings"


def _models(weights: dict) -> dict[str, list[dict]]:
    models = {k: v for k, v in weights.items() if isinstance(v, list) and k != "rounds"}
    for n, (edge, node) in enumerate(weights.get("rounds", [])):
        models |= {f"rounds/{n}/edge": edge, f"rounds/{n}/node": node}
    return models


def weights_table(spark: SparkSession, weights: dict) -> DataFrame:
    """The table of layer lists and settings, as `pipeline.run` takes them."""
    rows: list[tuple] = []
    for model, layers in _models(weights).items():
        rows.append((model, -1, "layers", 0, 0, float(len(layers)), None))
        for n, layer in enumerate(layers):
            for kind, value in layer.items():
                if kind in NUMBERS:
                    array = np.array(value, float)
                    rows += [(model, n, kind, *(at if len(at) == 2 else (at[0], -1)), float(x), None) for at, x in np.ndenumerate(array)]
                else:
                    rows.append((model, n, kind, 0, 0, None, json.dumps(value)))
    rows += [(SETTINGS, -1, k, 0, 0, None, json.dumps(v)) for k, v in weights.items() if not isinstance(v, list)]
    return spark.createDataFrame(rows, SCHEMA)


def write_weights(spark: SparkSession, weights: dict, path: str, mode: str = "error") -> None:
    weights_table(spark, weights).write.mode(mode).parquet(path)


def read_weights(spark: SparkSession, path: str, config: PipelineConfig | None = None, skip: tuple[str, ...] = ("src_network", "tgt_network")) -> dict:
    """Layer lists and settings from a table that `write_weights` wrote, held against the contract of `config` if it is given.

    Models whose name contains one of `skip` are left out. A model file has a fixed
    size, whatever the events, and is read by the driver.
    """
    rows = spark.read.schema(SCHEMA).parquet(path).toArrow().to_pylist()
    models: dict[str, list[dict]] = {}
    parts: dict[tuple, list[tuple]] = {}
    weights: dict = {}
    for r in rows:
        if any(s in r["model"] for s in skip):
            continue
        if r["model"] == SETTINGS:
            weights[r["kind"]] = json.loads(r["text"])
        elif r["kind"] == "layers":
            models[r["model"]] = [{} for _ in range(int(r["value"]))]
        else:
            parts.setdefault((r["model"], r["layer"], r["kind"]), []).append((r["i"], r["j"], r["value"], r["text"]))
    for (model, n, kind), cells in parts.items():
        if kind not in NUMBERS:
            models[model][n][kind] = json.loads(cells[0][3])
            continue
        shape = [max(c[k] for c in cells) + 1 for k in (0, 1)]
        array = np.full([x for x in shape if x], np.nan)
        for i, j, value, _ in cells:
            array[(i, j) if shape[1] else i] = value
        if np.isnan(array).any() or len(cells) != array.size:
            raise ValueError(f"{kind} of layer {n} of {model} has gaps or repeats")
        models[model][n][kind] = array.tolist()
    rounds = sorted({int(m.split("/")[1]) for m in models if m.startswith("rounds/")})
    weights |= {m: layers for m, layers in models.items() if not m.startswith("rounds/")}
    if rounds:
        weights["rounds"] = [(models[f"rounds/{n}/edge"], models[f"rounds/{n}/node"]) for n in rounds]
    if config is not None:
        check_weights(weights, config)
    return weights


def _width(name: str, layers: list[dict], inputs: int, outputs: int | None = None) -> int:
    """The width that `layers` give for `inputs`; every width on the way has to fit."""
    width = inputs
    for n, layer in enumerate(layers):
        where = f"layer {n} of {name}"
        if (act := layer.get("activation")) not in ACTIVATIONS:
            raise ValueError(f"{where}: no activation {act}")
        for kind in ("neighbour", "root") if "neighbour" in layer else ("weight",) if "weight" in layer else ():
            sizes = {len(row) for row in layer[kind]}
            if sizes != {width}:
                raise ValueError(f"{where}: {kind} takes {sorted(sizes)} components and gets {width}")
            if len(layer[kind]) != len(layer["bias"]):
                raise ValueError(f"{where}: {len(layer[kind])} outputs and a bias of {len(layer['bias'])}")
        width = len(layer["bias"]) if "bias" in layer else width
        for kind, values in (layer.get("batch_norm") or {}).items():
            if kind != "eps" and len(values) != width:
                raise ValueError(f"{where}: {kind} of batch norm has {len(values)} components, not {width}")
    if outputs is not None and width != outputs:
        raise ValueError(f"{name} gives {width} components, not {outputs}")
    return width


def check_weights(weights: dict, config: PipelineConfig) -> None:
    """Raises unless every network fits what it gets and what takes its output.

    The embedding (or both decoders behind the trunk) starts from the stage's features
    and both decoders end alike; the filter takes both ends as the graph layers leave
    them and gives one number; encoders give `size`; a round's networks take the ends,
    edges and messages, twice as wide with `concat`, two messages side by side with
    `in_out_diff`, and give `size`; `recurrent` rounds are one and the same; the decoder
    gives one number, and `aggregate` is sum or mean.
    """
    features = len(config.embedding.features)
    needed = ["trunk", "source", "target"] if config.two_embeddings else ["embedding"]
    if missing := [k for k in [*needed, "filter"] if k not in weights]:
        raise ValueError(f"no weights of {missing}")
    if config.two_embeddings:
        trunk = _width("trunk", weights["trunk"], features)
        _width("target", weights["target"], trunk, _width("source", weights["source"], trunk))
    else:
        _width("embedding", weights["embedding"], features)
    ends = _width("filter_gnn", weights.get("filter_gnn", []), features)
    _width("filter", weights["filter"], 2 * ends, 1)
    if "rounds" not in weights:
        return
    if missing := [k for k in ("node_encoder", "edge_encoder", "decoder", "size") if k not in weights]:
        raise ValueError(f"no weights of {missing}")
    size = weights["size"]
    if weights.get("aggregate", "sum") not in ("sum", "mean"):
        raise ValueError(f"no aggregate {weights['aggregate']}")
    _width("node_encoder", weights["node_encoder"], 12 if config.cluster_gnn else len(config.gnn.features), size)
    _width("edge_encoder", weights["edge_encoder"], 6 if "eta" in config.gnn.features else 2 * size, size)
    wide = 2 * size if weights.get("concat", False) else size
    messages = 2 * size if weights.get("in_out_diff", True) else size
    for n, (edge, node) in enumerate(weights["rounds"]):
        _width(f"rounds/{n}/edge", edge, 3 * wide, size)
        _width(f"rounds/{n}/node", node, messages + wide, size)
    if weights.get("recurrent") and any(r != weights["rounds"][0] for r in weights["rounds"]):
        raise ValueError("the rounds are recurrent but differ")
    _width("decoder", weights["decoder"], size, 1)
