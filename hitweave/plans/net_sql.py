"""DuckDB SQL of networks and of the pipelines that they are in, for the demo weights."""

from __future__ import annotations

from hitweave.plans import walk_sql as W
from hitweave.schema import PipelineConfig


def linear(w, b, v: str) -> str:
    """A list of dot products."""
    return "[" + ", ".join(f"{c} + " + " + ".join(f"({x}) * {v}[{j + 1}]" for j, x in enumerate(row)) for row, c in zip(w, b, strict=True)) + "]"


ACTIVATIONS = {None: "a", "ReLU": "greatest(a, 0.0)", "Tanh": "tanh(a)", "Sigmoid": "1 / (1 + exp(-a))"}


def activated(v: str, name: str | None) -> str:
    return f"list_transform({v}, lambda a: {ACTIVATIONS[name]})" if name else v


LAYER_NORM = "list_transform(x, lambda a: (a - list_avg(x)) / sqrt(list_sum(list_transform(x, lambda b: (b - list_avg(x)) * (b - list_avg(x)))) / len(x) + 1e-5))"


def layers(name: str, source: str, keys: str, stack: list[dict]) -> list[str]:
    """CTEs that end in `name`(keys, x): the layers applied to x of `source`."""
    out, at = [], source

    def add(columns: str, rows: str) -> None:
        nonlocal at
        out.append(f"{name}_{len(out)} AS (SELECT {keys}, {columns} AS x FROM {rows})")
        at = f"{name}_{len(out) - 1}"

    for layer in stack:
        add(linear(layer["weight"], layer["bias"], "x"), at)
        if layer.get("layer_norm"):
            add(LAYER_NORM, at)
        if (norm := layer.get("batch_norm")) is not None:
            n = len(layer["bias"])
            gamma, beta = norm.get("gamma", [1.0] * n), norm.get("beta", [0.0] * n)
            moments = f"(SELECT event_id, {', '.join(f'avg(x[{i}]) AS m{i}, var_pop(x[{i}]) AS v{i}' for i in range(1, n + 1))} FROM {at} GROUP BY 1)"
            add("[" + ", ".join(f"(x[{i}] - m{i}) / sqrt(v{i} + {norm.get('eps', 6e-5)}) * {gamma[i - 1]} + {beta[i - 1]}" for i in range(1, n + 1)) + "]", f"{at} JOIN {moments} USING (event_id)")
        if layer.get("activation"):
            add(activated("x", layer["activation"]), at)
    return [*out, f"{name} AS (SELECT {keys}, x FROM {at})"]


def sage(name: str, nodes: str, edges: str, layer: dict) -> list[str]:
    n = len(layer["neighbour"][0])
    means = f"SELECT e.event_id, e.dst AS hit_id, [{', '.join(f'avg(s.x[{i}])' for i in range(1, n + 1))}] AS m FROM {edges} e JOIN {nodes} s ON s.event_id = e.event_id AND s.hit_id = e.src GROUP BY 1, 2"
    both = f"SELECT p.event_id, p.hit_id, p.x, coalesce(q.m, [{', '.join(['0.0'] * n)}]) AS m FROM {nodes} p LEFT JOIN ({means}) q USING (event_id, hit_id)"
    k = len(layer["bias"])
    sums = f"SELECT event_id, hit_id, {linear(layer['neighbour'], [0.0] * k, 'm')} AS a, {linear(layer['root'], layer['bias'], 'x')} AS b FROM ({both})"
    total = "[" + ", ".join(f"a[{i}] + b[{i}]" for i in range(1, k + 1)) + "]"
    return [f"{name} AS (SELECT event_id, hit_id, {activated(total, layer.get('activation'))} AS x FROM ({sums}))"]


ENDS = "{0} e JOIN {1} s ON s.event_id = e.event_id AND s.hit_id = e.src JOIN {1} d ON d.event_id = e.event_id AND d.hit_id = e.dst"
PAIR = "event_id, src, dst"
UNIT = "list_transform(x, lambda a: a / greatest(sqrt(list_sum(list_transform(x, lambda b: b * b))), 1e-12))"
FINITE = "CASE WHEN {0} IS NULL OR isnan({0}) OR isinf({0}) THEN 0 ELSE {0} END"


def pipeline(hits: str, weights: dict, config: PipelineConfig) -> list[str]:
    """CTEs up to streams(event_id, labels), from hits(event_id, hit_id, features)."""
    features, scales = config.embedding.features, config.embedding.scales
    names = list(dict.fromkeys([*features, *config.gnn.features])) if not config.cluster_gnn else list(features)
    cleaned = ", ".join(f"{FINITE.format(c) if config.clean else c} AS {c}" for c in names)
    r, z = ((f"{c}::DOUBLE / {scales[features.index(c)]}" if config.scaled_radius else f"{c}::DOUBLE") for c in ("r", "z"))
    out = [
        f"source AS (SELECT *, ({r}) * ({r}) + ({z}) * ({z}) AS rr FROM (SELECT event_id, hit_id, {cleaned} FROM {hits}))",
        "large AS (SELECT * FROM source WHERE event_id IN (SELECT event_id FROM source GROUP BY 1 HAVING count(*) >= 3))",
        f"inputs AS (SELECT event_id, hit_id, [{', '.join(f'{f}::DOUBLE / {float(s)}' for f, s in zip(features, scales, strict=True))}] AS x FROM large)",
    ]
    keys = "event_id, hit_id"
    if config.two_embeddings:
        out += [*layers("trunk", "inputs", keys, weights["trunk"]), *layers("sources", "trunk", keys, weights["source"]), *layers("targets", "trunk", keys, weights["target"])]
        query, database = "sources", "targets"
    else:
        out += layers("points", "inputs", keys, weights["embedding"])
        query = database = "points"
    out += [f"unit_q AS (SELECT {keys}, {UNIT} AS v FROM {query})", f"unit_d AS (SELECT {keys}, {UNIT} AS v FROM {database})"]
    out.append(f"""near_p AS (SELECT event_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY event_id, src ORDER BY d2, dst) AS k FROM (
    SELECT a.event_id, a.hit_id AS src, b.hit_id AS dst, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS d2 FROM unit_q a JOIN unit_d b USING (event_id))
    WHERE d2 <= {config.r_max} * {config.r_max}) WHERE k <= {config.k_max} AND src <> dst)""")
    flip = "s.rr > d.rr" + (" OR (s.rr = d.rr AND e.src > e.dst)" if config.break_ties else "")
    out.append(f"turned AS (SELECT DISTINCT e.event_id, CASE WHEN {flip} THEN e.dst ELSE e.src END AS src, CASE WHEN {flip} THEN e.src ELSE e.dst END AS dst FROM {ENDS.format('near_p', 'source')})")
    guard = "SELECT event_id, src, dst FROM {0} WHERE event_id IN (SELECT event_id FROM {0} GROUP BY 1 HAVING count(*) >= 2)"
    out.append(f"edges_p AS ({guard.format('turned')})")
    nodes = "inputs"
    for i, layer in enumerate(weights.get("filter_gnn", [])):
        out += sage(f"gcn{i}", nodes, "edges_p", layer) if "neighbour" in layer else layers(f"gcn{i}", nodes, keys, [layer])
        nodes = f"gcn{i}"
    out.append(f"pair_in AS (SELECT e.event_id, e.src, e.dst, list_concat(s.x, d.x) AS x FROM {ENDS.format('edges_p', nodes)})")
    out += layers("filtered", "pair_in", PAIR, weights["filter"])
    cut = ">" if config.strict_filter else ">="
    out += [f"passed AS (SELECT * FROM filtered WHERE 1 / (1 + exp(-x[1])) {cut} {config.filter_cut})", f"kept AS ({guard.format('passed')})"]
    if config.cluster_gnn:
        eta = "CASE WHEN {0} = 0 THEN CASE WHEN {1} < 0 THEN '-Infinity'::DOUBLE ELSE 'Infinity'::DOUBLE END ELSE -ln(tan(atan2({0}, {1}) / 2)) END"
        radius = "sqrt(cluster_x_1::DOUBLE * cluster_x_1::DOUBLE + cluster_y_1::DOUBLE * cluster_y_1::DOUBLE)"
        cluster = f"{radius}, atan2(cluster_y_1::DOUBLE, cluster_x_1::DOUBLE), cluster_z_1::DOUBLE, {eta.format(radius, 'cluster_z_1::DOUBLE')}"
        gnn = f"r::DOUBLE / 1000.0, phi::DOUBLE / 3.15, z::DOUBLE / 1000.0, {eta.format('r::DOUBLE', 'z::DOUBLE')}, {cluster}, {cluster}"
    else:
        gnn = ", ".join(f"{f}::DOUBLE / {float(s)}" for f, s in zip(config.gnn.features, config.gnn.scales, strict=True))
    out.append(f"gnn_in AS (SELECT {keys}, [{gnn}] AS x FROM large)")
    out += layers("n0", "gnn_in", keys, weights["node_encoder"])
    if "eta" in config.gnn.features:
        at = {c: config.gnn.features.index(c) + 1 for c in ("r", "phi", "z", "eta")}
        turn = "(dphi) * pi()"
        out.append(f"deltas AS (SELECT e.event_id, e.src, e.dst, d.x[{at['r']}] - s.x[{at['r']}] AS dr, d.x[{at['phi']}] - s.x[{at['phi']}] AS dphi, d.x[{at['z']}] - s.x[{at['z']}] AS dz, d.x[{at['eta']}] - s.x[{at['eta']}] AS deta, (d.x[{at['r']}] + s.x[{at['r']}]) / 2 AS mid FROM {ENDS.format('kept', 'gnn_in')})")
        out.append(f"wrapped AS (SELECT * REPLACE (CASE WHEN {turn} > pi() THEN {turn} - 2 * pi() WHEN {turn} < -pi() THEN {turn} + 2 * pi() ELSE {turn} END / pi() AS dphi) FROM deltas)")
        out.append("slopes AS (SELECT *, CASE WHEN dr = 0 THEN (CASE WHEN dphi > 0 THEN 100 WHEN dphi < 0 THEN -100 ELSE 0 END) ELSE greatest(-100, least(100, dphi / dr)) END AS phislope FROM wrapped)")
        out.append("edge_in AS (SELECT event_id, src, dst, [dr, dphi, dz, deta, phislope, mid * phislope] AS x FROM slopes)")
    else:
        out.append(f"edge_in AS (SELECT e.event_id, e.src, e.dst, list_concat(s.x, d.x) AS x FROM {ENDS.format('kept', 'n0')})")
    out += layers("e0", "edge_in", PAIR, weights["edge_encoder"])
    n, size = len(weights["rounds"]), weights["size"]
    sums = "[" + ", ".join(f"sum(x[{i}])" for i in range(1, size + 1)) + "]"
    zero = "[" + ", ".join(["0.0"] * size) + "]"
    for k, (edge_net, node_net) in enumerate(weights["rounds"]):
        x, e = f"n{k}", f"e{k}"
        if weights.get("concat"):
            out += [f"cn{k} AS (SELECT a.event_id, a.hit_id, list_concat(a.x, b.x) AS x FROM {x} a JOIN n0 b USING (event_id, hit_id))", f"ce{k} AS (SELECT a.event_id, a.src, a.dst, list_concat(a.x, b.x) AS x FROM {e} a JOIN e0 b USING (event_id, src, dst))"]
            x, e = f"cn{k}", f"ce{k}"
        out.append(f"ei{k} AS (SELECT e.event_id, e.src, e.dst, list_concat(e.x, list_concat(s.x, d.x)) AS x FROM {ENDS.format(e, x)})")
        out += layers(f"e{k + 1}", f"ei{k}", PAIR, edge_net)
        side = f"(SELECT event_id, {{0}} AS hit_id, {sums} AS m FROM e{k + 1} GROUP BY 1, 2)"
        out.append(f"ni{k} AS (SELECT p.event_id, p.hit_id, list_concat(coalesce(i.m, {zero}), list_concat(coalesce(o.m, {zero}), p.x)) AS x FROM {x} p LEFT JOIN {side.format('dst')} i USING (event_id, hit_id) LEFT JOIN {side.format('src')} o USING (event_id, hit_id))")
        out += layers(f"n{k + 1}", f"ni{k}", keys, node_net)
    out += layers("decoded", f"e{n}", PAIR, weights["decoder"])
    out.append(f"live_p AS (SELECT * FROM (SELECT event_id, src, dst, 1 / (1 + exp(-x[1])) AS score FROM decoded) WHERE score > {config.cc_cut})")
    return [*out, W.walked("live_p", config.walk, config.allow_node_reuse), W.streams("source", "rr" if config.sort_tracks else None)]
