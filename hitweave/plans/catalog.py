"""Registered queries over the driver's tables, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitweave.functions import scalars as S
from hitweave.operators import edges as E
from hitweave.operators import hits as H
from hitweave.operators import blocks, nn, scatter, tracks, truth, waves
from hitweave.operators.neighbours import radius_join, remapped
from hitweave.operators.walks import walk_components
from hitweave.plans import fixtures as X
from hitweave.plans import net_sql as N
from hitweave.plans import pipeline
from hitweave.plans import walk_sql as W
from hitweave.schema import PRESETS, PipelineConfig, StageSpec
from hitweave.session import cut, stored, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str, recursive: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' * recursive}{', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


# projections and scalar expressions

ODD = "CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 11 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 13 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE value END"


@query(f"SELECT event_id AS hit_id, round(CASE WHEN isnan(v) OR isinf(v) THEN 0 ELSE v END / 3.14, 6) AS v FROM (SELECT event_id, {ODD} AS v FROM events)")
def clean_scale(spark, sf_dir):
    odd = table(spark, sf_dir, "events").select(F.col("user_id"), F.col("event_id").alias("hit_id"), F.expr(ODD).alias("v"))
    return odd.select("hit_id", F.round(S.scaled(S.finite(F.col("v")), 3.14), 6).alias("v"))


@query("SELECT hit_id, round(r, 6) AS r, round(phi, 6) AS phi, round(-ln(tan(atan2(r, z) / 2)), 6) AS eta, round(rr, 3) AS radius2 FROM hits_e", X.HITS_E)
def cyl_coords(spark, sf_dir):
    hits = X.hits_e(spark, sf_dir)
    parts = S.cylindrical(*(F.col(c) for c in "xyz"))
    return hits.select("hit_id", F.round(parts["r"], 6).alias("r"), F.round(parts["phi"], 6).alias("phi"), F.round(parts["eta"], 6).alias("eta"), F.round(S.radius2(F.col("r"), F.col("z")), 3).alias("radius2"))


@query("SELECT hit_id, a, b FROM (SELECT hit_id, round(x, 6) AS a, round(y, 6) AS b FROM hits_e) WHERE hit_id >= 0", "hits_e AS (SELECT vec_id AS hit_id, embedding[1]::DOUBLE / 1000.0 AS x, embedding[2]::DOUBLE / -2.0 AS y FROM embeddings)")
def stage_input(spark, sf_dir):
    hits = X.hits_e(spark, sf_dir).select("event_id", "hit_id", (F.col("x") / 1000).alias("x"), (F.col("y") / 1000).alias("y"))
    return H.stage_input(hits, StageSpec.parse("x, y", "1000, -2")).select("hit_id", F.round("x", 6).alias("a"), F.round("y", 6).alias("b"))


@query("SELECT hit_id, CASE WHEN a > pi() THEN round(a - 2 * pi(), 9) WHEN a < -pi() THEN round(a + 2 * pi(), 9) ELSE round(a, 9) END AS a FROM (SELECT event_id AS hit_id, (event_id % 1000) / 100.0 - 5 AS a FROM events)")
def wrap_angle(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("hit_id"), F.round(S.wrapped((F.col("event_id") % 1000) / 100.0 - 5), 9).alias("a"))


@query("SELECT hit_id, round(v[1] / greatest(n, 1e-12), 6) AS first, round(n, 6) AS norm FROM (SELECT hit_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id AS hit_id, list_transform(embedding, lambda x: 3 * x::DOUBLE) AS v FROM embeddings))")
def l2_normalize(spark, sf_dir):
    hits = X.hits_e(spark, sf_dir).select("hit_id", F.transform("v", lambda x: x * 3).alias("v"))
    return hits.select("hit_id", F.round(F.get(S.l2_normalised(F.col("v")), F.lit(0)), 6).alias("first"), F.round(S.norm(F.col("v")), 6).alias("norm"))


@query("SELECT src, dst, round(d2, 6) AS d2 FROM pairs_e WHERE dst = src + 1", X.HITS_E, X.NEAR_E)
def pair_sq_distance(spark, sf_dir):
    a = X.hits_e(spark, sf_dir).select(F.col("hit_id").alias("src"), F.col("v").alias("a"), (F.col("hit_id") + 1).alias("dst"))
    b = X.hits_e(spark, sf_dir).select(F.col("hit_id").alias("dst"), F.col("v").alias("b"))
    return a.join(b, "dst").select("src", "dst", F.round(S.squared_distance(F.col("a"), F.col("b")), 6).alias("d2"))


@query("SELECT hit_id, " + ", ".join(f"CASE WHEN hit_id % 8 IN (2, 6) THEN hit_id * 100 + {i % 4} ELSE hit_id * 100 + {i} END AS c{i}" for i in range(12)) + " FROM (SELECT vec_id AS hit_id FROM embeddings)")
def region_override(spark, sf_dir):
    columns = [f"c{i}" for i in range(12)]
    hits = X.hits_e(spark, sf_dir).select("hit_id", (F.col("hit_id") % 8).alias("region"), *((F.col("hit_id") * 100 + i).alias(c) for i, c in enumerate(columns)))
    return H.region_override(hits, columns).drop("region")


@query("SELECT user_id AS event_id, event_id AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS hit_id FROM events")
def row_number_ids(spark, sf_dir):
    hits = X.hits_u(spark, sf_dir).select("event_id", F.col("hit_id").alias("hit"), "ts")
    return H.numbered(hits, "ts", "hit").select("event_id", "hit", "hit_id")


@query("SELECT hit_id, list_transform(v, lambda x: round((x - m) / sqrt(s + 1e-5), 6))[1:4] AS n FROM (SELECT hit_id, v, list_avg(v) AS m, list_sum(list_transform(v, lambda x: (x - list_avg(v)) * (x - list_avg(v)))) / len(v) AS s FROM hits_e)", X.HITS_E)
def layer_norm(spark, sf_dir):
    return X.hits_e(spark, sf_dir).select("hit_id", F.transform(F.slice(S.layer_norm(F.col("v")), 1, 4), lambda x: F.round(x, 6)).alias("n"))


@query("SELECT e.user_id AS event_id, e.event_id AS hit_id, round((value - m) / sqrt(s + 6e-5), 6) AS value FROM events e JOIN (SELECT user_id, avg(value) AS m, var_pop(value) AS s FROM events GROUP BY 1) USING (user_id)")
def batch_norm(spark, sf_dir):
    hits = X.hits_u(spark, sf_dir).select("event_id", "hit_id", "value")
    return scatter.batch_norm(hits, ["value"], 6e-5).withColumn("value", F.round("value", 6))


# joins

@query("SELECT src, dst, round(d2, 6) AS d2 FROM near_e", X.HITS_E, X.NEAR_E)
def radius_join_all(spark, sf_dir):
    return X.near_e(spark, sf_dir).select("src", "dst", F.round("d2", 6).alias("d2"))


@query("SELECT src, dst, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY event_id, src ORDER BY d2, dst) AS k FROM pairs_e WHERE d2 <= 1.2 * 1.2) WHERE k <= 4 AND src <> dst", X.HITS_E, X.NEAR_E)
def radius_join_topk(spark, sf_dir):
    return X.near_e(spark, sf_dir, 4, 1.2).select("src", "dst", F.round("d2", 6).alias("d2"))


@query("SELECT src, dst, round(d2, 6) AS d2 FROM (SELECT a.hit_id AS src, b.hit_id AS dst, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.w[i]) * (a.v[i] - b.w[i]))) AS d2 FROM hits_e a, (SELECT hit_id, list_reverse(v) AS w FROM hits_e) b) WHERE d2 <= 1.15 * 1.15 AND src <> dst", X.HITS_E)
def radius_bijoin(spark, sf_dir):
    hits = X.hits_e(spark, sf_dir)
    found = radius_join(hits.select("event_id", "hit_id", "v"), X.hits_e(spark, sf_dir).select("event_id", "hit_id", F.reverse("v").alias("v")), 1.15)
    return found.select("src", "dst", F.round("d2", 6).alias("d2"))


FEATURES = """scaled AS (SELECT hit_id, r / 1000.0 AS r, phi / 3.14159265359 AS phi, z / 1000.0 AS z, eta FROM hits_e),
deltas AS (
    SELECT e.src, e.dst, d.r - s.r AS dr, d.z - s.z AS dz, d.eta - s.eta AS deta, (d.r + s.r) / 2 AS mid,
        CASE WHEN (d.phi - s.phi) * pi() > pi() THEN (d.phi - s.phi) * pi() - 2 * pi() WHEN (d.phi - s.phi) * pi() < -pi() THEN (d.phi - s.phi) * pi() + 2 * pi() ELSE (d.phi - s.phi) * pi() END / pi() AS dphi
    FROM edges_e e JOIN scaled s ON s.hit_id = e.src JOIN scaled d ON d.hit_id = e.dst),
slopes AS (SELECT *, CASE WHEN dr = 0 THEN (CASE WHEN dphi > 0 THEN 100 WHEN dphi < 0 THEN -100 ELSE 0 END) ELSE greatest(-100, least(100, dphi / dr)) END AS phislope FROM deltas)"""


@query("SELECT src, dst, round(dr, 6) AS dr, round(dphi, 6) AS dphi, round(dz, 6) AS dz, round(deta, 6) AS deta, round(phislope, 5) AS phislope, round(mid * phislope, 5) AS rphislope FROM slopes", X.HITS_E, X.NEAR_E, X.EDGES_E, FEATURES)
def edge_features(spark, sf_dir):
    nodes = X.hits_e(spark, sf_dir).select("event_id", "hit_id", (F.col("r") / 1000.0).alias("r"), (F.col("phi") / 3.14159265359).alias("phi"), (F.col("z") / 1000.0).alias("z"), "eta")
    out = E.with_features(X.edges_e(spark, sf_dir), nodes)
    return out.select("src", "dst", *(F.round(c, 5 if "slope" in c else 6).alias(c) for c in ("dr", "dphi", "dz", "deta", "phislope", "rphislope")))


# orientation, set operations, cuts

@query("SELECT src, dst, score FROM edges_e", X.HITS_E, X.NEAR_E, X.EDGES_E)
def orient_by_radius(spark, sf_dir):
    return X.edges_e(spark, sf_dir).select("src", "dst", "score")


@query("SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM near_e", X.HITS_E, X.NEAR_E)
def orient_by_id(spark, sf_dir):
    return E.distinct_edges(E.oriented_by_id(X.near_e(spark, sf_dir))).select("src", "dst")


@query("SELECT CASE WHEN flip THEN dst ELSE src END AS src, CASE WHEN flip THEN src ELSE dst END AS dst, score FROM (SELECT *, ascii(md5(concat_ws(':', event_id, src, dst, 42))) % 2 = 1 AS flip FROM edges_e)", X.HITS_E, X.NEAR_E, X.EDGES_E)
def random_flip(spark, sf_dir):
    return E.randomly_flipped(X.edges_e(spark, sf_dir)).select("src", "dst", "score")


@query("SELECT DISTINCT src, dst FROM bip WHERE src <> dst", X.BIP)
def dedup_edges(spark, sf_dir):
    return E.distinct_edges(E.without_loops(X.bip(spark, sf_dir))).select("src", "dst")


@query("SELECT event_id, src, dst FROM live_u UNION ALL SELECT event_id, dst, src FROM live_u", X.EDGES_U)
def make_undirected(spark, sf_dir):
    return E.undirected(X.live_u(spark, sf_dir))


@query("SELECT event_id, src, dst, row_number() OVER (PARTITION BY event_id ORDER BY dst, src) - 1 AS edge_ord FROM live_u", X.EDGES_U)
def edge_sort(spark, sf_dir):
    return E.with_order(X.live_u(spark, sf_dir)).select("event_id", "src", "dst", "edge_ord")


@query("SELECT event_id, src, dst, score FROM edges_u WHERE score >= 0.2", X.EDGES_U)
def filter_cut(spark, sf_dir):
    return E.score_cut(X.edges_u(spark, sf_dir), 0.2)


@query("SELECT event_id, src, dst, score FROM live_u", X.EDGES_U)
def cc_cut(spark, sf_dir):
    return X.live_u(spark, sf_dir)


@query("SELECT user_id AS event_id, event_id AS hit_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 70)")
def min_size_guard(spark, sf_dir):
    return H.large_enough(X.hits_u(spark, sf_dir), 70).select("event_id", "hit_id")


@query("SELECT event_id, src, dst FROM live_u WHERE event_id IN (SELECT event_id FROM live_u GROUP BY 1 HAVING count(*) >= 30)", X.EDGES_U)
def min_edge_guard(spark, sf_dir):
    return E.large_enough(X.live_u(spark, sf_dir), 30).select("event_id", "src", "dst")


@query("SELECT user_id AS event_id, event_id AS hit_id FROM events WHERE event_id IN (SELECT src FROM live_u UNION SELECT dst FROM live_u)", X.EDGES_U)
def drop_isolated(spark, sf_dir):
    return E.without_isolated(X.hits_u(spark, sf_dir).select("event_id", "hit_id"), X.live_u(spark, sf_dir))


@query("SELECT event_id, src, dst, score FROM live_u WHERE src IN (SELECT event_id FROM events WHERE value > 20) AND dst IN (SELECT event_id FROM events WHERE value > 20)", X.EDGES_U)
def induced_subgraph(spark, sf_dir):
    return E.node_induced(X.live_u(spark, sf_dir), X.hits_u(spark, sf_dir).where("value > 20"))


MARKED = W.marked("live_u")


@query("SELECT event_id, src, dst, score FROM marked WHERE (o = 1 AND top >= 0.1) OR score > 0.6", X.EDGES_U, MARKED)
def max_add_cut_v2(spark, sf_dir):
    return E.max_add_cut(X.live_u(spark, sf_dir))


@query("SELECT event_id, src, dst, score FROM marked WHERE ((o = 1 AND top >= 0.1) OR score > 0.6) AND (inner_ OR i = 1)", X.EDGES_U, MARKED)
def max_add_cut_v4(spark, sf_dir):
    return E.max_add_cut(cut(X.live_u(spark, sf_dir)), look_at_incoming=True)


DP_CUT = "dp_cut AS (SELECT event_id, src, dst, score FROM marked WHERE ((o = 1 AND score >= 0.1) OR score > 0.6) AND ((i = 1 AND score >= 0.1) OR score > 0.6))"


@query("SELECT * FROM dp_cut", X.EDGES_U, MARKED, DP_CUT)
def max_add_cut_dp(spark, sf_dir):
    return E.dp_max_add_cut(X.live_u(spark, sf_dir))


# aggregation

@query("SELECT hit_id, round(coalesce(q, 0), 4) AS q, round(coalesce(w, 0), 4) AS w FROM (SELECT DISTINCT l_partkey + 1000000 AS hit_id FROM lineitem) LEFT JOIN (SELECT dst AS hit_id, sum(q) AS q, sum(w) AS w FROM bip GROUP BY 1) USING (hit_id)", X.BIP)
def scatter_sum(spark, sf_dir):
    edges = X.bip(spark, sf_dir)
    nodes = edges.select("event_id", F.col("dst").alias("hit_id")).distinct()
    return scatter.scatter(nodes, edges, ["q", "w"]).select("hit_id", F.round("q", 4).alias("q"), F.round("w", 4).alias("w"))


@query("SELECT src AS hit_id, round(avg(q), 6) AS q, round(avg(w), 6) AS w FROM bip GROUP BY 1", X.BIP)
def scatter_mean(spark, sf_dir):
    edges = X.bip(spark, sf_dir)
    nodes = edges.select("event_id", F.col("src").alias("hit_id")).distinct()
    return scatter.scatter(nodes, edges, ["q", "w"], "src", "mean").select("hit_id", F.round("q", 6).alias("q"), F.round("w", 6).alias("w"))


@query("SELECT e.event_id AS hit_id, round(coalesce(i.s, 0), 6) AS in_score, round(coalesce(o.s, 0), 6) AS out_score FROM events e LEFT JOIN (SELECT dst, sum(score) AS s FROM live_u GROUP BY 1) i ON i.dst = e.event_id LEFT JOIN (SELECT src, sum(score) AS s FROM live_u GROUP BY 1) o ON o.src = e.event_id", X.EDGES_U)
def in_out_aggregate(spark, sf_dir):
    nodes = X.hits_u(spark, sf_dir).select("event_id", "hit_id")
    return scatter.in_out(nodes, cut(X.live_u(spark, sf_dir)), ["score"]).select("hit_id", F.round("in_score", 6).alias("in_score"), F.round("out_score", 6).alias("out_score"))


@query("SELECT src, w AS best_score, dst AS best_other FROM (SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM bip) WHERE k = 1", X.BIP)
def scatter_argmax(spark, sf_dir):
    return E.best_edge(X.bip(spark, sf_dir), "src", "w").drop("event_id")


@query("SELECT e.event_id AS hit_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM events e LEFT JOIN (SELECT dst, count(*) AS n FROM live_u GROUP BY 1) i ON i.dst = e.event_id LEFT JOIN (SELECT src, count(*) AS n FROM live_u GROUP BY 1) o ON o.src = e.event_id", X.EDGES_U)
def degrees(spark, sf_dir):
    return E.degrees(X.hits_u(spark, sf_dir).select("event_id", "hit_id"), X.live_u(spark, sf_dir)).drop("event_id")


# neural operators on literal weights

def weight(rows: int, columns: int, salt: int = 0) -> list[list[float]]:
    """Deterministic small weights."""
    return [[((i * 7 + j * 3 + salt * 5) % 11 - 5) / 10 for j in range(columns)] for i in range(rows)]


def bias(n: int, salt: int = 0) -> list[float]:
    return [((i * 5 + salt * 3) % 7 - 3) / 10 for i in range(n)]


def layer(outputs: int, inputs: int, salt: int = 0, activation: str | None = None, layer_norm: bool = False) -> dict:
    return {"weight": weight(outputs, inputs, salt), "bias": bias(outputs, salt), "activation": activation, "layer_norm": layer_norm}


def _relu(v: str) -> str:
    return f"list_transform({v}, lambda x: greatest(x, 0.0))"


def _rounded(v: str) -> str:
    return f"list_transform({v}, lambda x: round(x, 6))"


POINTS = "points AS (SELECT hit_id, v[1:3] AS x FROM hits_e)"
HIDDEN = _relu(N.linear(weight(4, 3), bias(4), "x"))


def _points(spark, sf_dir):
    return X.hits_e(spark, sf_dir).select("event_id", "hit_id", F.slice("v", 1, 3).alias("x"))


@query(f"SELECT hit_id, {_rounded(N.linear(weight(2, 4, 1), bias(2, 1), 'h'))} AS y FROM (SELECT hit_id, {HIDDEN} AS h FROM points)", X.HITS_E, POINTS)
def mlp_layer(spark, sf_dir):
    out = nn.mlp(_points(spark, sf_dir), "x", [layer(4, 3, activation="ReLU"), layer(2, 4, 1)], "y")
    return out.select("hit_id", F.transform("y", lambda x: F.round(x, 6)).alias("y"))


@query(f"SELECT hit_id, {_rounded('list_transform(y, lambda a: a / greatest(sqrt(list_sum(list_transform(y, lambda b: b * b))), 1e-12))')} AS v FROM (SELECT hit_id, {N.linear(weight(2, 3, 2), bias(2, 2), 'x')} AS y FROM points)", X.HITS_E, POINTS)
def metric_embedding(spark, sf_dir):
    hits = X.hits_e(spark, sf_dir).select("hit_id", *((F.col(c) / 1000).alias(c) for c in "xyz"))
    return nn.embed(hits, list("xyz"), [layer(2, 3, 2)]).select("hit_id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query(
    f"""SELECT hit_id, {_rounded('list_transform(range(1, 3), lambda i: n[i] + o[i])')} AS x FROM (
    SELECT hit_id, {N.linear(weight(2, 3, 3), [0.0, 0.0], 'm')} AS n, {N.linear(weight(2, 3, 4), bias(2, 4), 'x')} AS o FROM (
        SELECT p.hit_id, p.x, coalesce(q.m, [0.0, 0.0, 0.0]) AS m FROM points p LEFT JOIN (
            SELECT e.dst AS hit_id, [avg(s.x[1]), avg(s.x[2]), avg(s.x[3])] AS m FROM edges_e e JOIN points s ON s.hit_id = e.src GROUP BY 1) q USING (hit_id)))""",
    X.HITS_E, X.NEAR_E, X.EDGES_E, POINTS,
)
def sage_layer(spark, sf_dir):
    out = nn.sage_layer(_points(spark, sf_dir), X.edges_e(spark, sf_dir), "x", 3, weight(2, 3, 3), weight(2, 3, 4), bias(2, 4))
    return out.select("hit_id", F.transform("x", lambda x: F.round(x, 6)).alias("x"))


@query(f"SELECT e.src, e.dst, round(1 / (1 + exp(-({N.linear(weight(1, 6, 5), bias(1, 5), 'list_concat(s.x, d.x)')})[1])), 6) AS score FROM edges_e e JOIN points s ON s.hit_id = e.src JOIN points d ON d.hit_id = e.dst", X.HITS_E, X.NEAR_E, X.EDGES_E, POINTS)
def edge_classifier(spark, sf_dir):
    edges = X.edges_e(spark, sf_dir).select("event_id", "src", "dst")
    return nn.edge_scores(_points(spark, sf_dir), edges, "x", [layer(1, 6, 5)]).select("src", "dst", F.round("score", 6).alias("score"))


EDGE_NET = _relu(N.linear(weight(3, 9, 6), bias(3, 6), "list_concat([e.score, e.score, e.score], list_concat(s.x, d.x))"))
SUMS = "[sum(m[1]), sum(m[2]), sum(m[3])]"


@query(
    f"""SELECT hit_id, {_rounded(N.linear(weight(3, 9, 7), bias(3, 7), 'z'))} AS x FROM (
    SELECT p.hit_id, list_concat(coalesce(i.m, [0.0, 0.0, 0.0]), list_concat(coalesce(o.m, [0.0, 0.0, 0.0]), p.x)) AS z FROM points p
    LEFT JOIN (SELECT dst AS hit_id, {SUMS} AS m FROM messages GROUP BY 1) i USING (hit_id) LEFT JOIN (SELECT src AS hit_id, {SUMS} AS m FROM messages GROUP BY 1) o USING (hit_id))""",
    X.HITS_E, X.NEAR_E, X.EDGES_E, POINTS, f"messages AS (SELECT e.src, e.dst, {EDGE_NET} AS m FROM edges_e e JOIN points s ON s.hit_id = e.src JOIN points d ON d.hit_id = e.dst)",
)
def gnn_round(spark, sf_dir):
    edges, parts = blocks.dealt(stored(X.edges_e(spark, sf_dir).select("event_id", "src", "dst", F.array("score").alias("e"))))
    nodes = blocks.interaction_round(_points(spark, sf_dir), edges, parts, [layer(3, 9, 6, "ReLU")], [layer(3, 9, 7)], 3)
    return nodes.select("hit_id", F.transform("x", lambda x: F.round(x, 6)).alias("x"))


WIDTH = 64  # components of the embeddings


def _wide(outputs: int, inputs: int, salt: int, v: str) -> str:
    """The linear part of `layer` with its weights as a formula."""
    product = f"(((i * 7 + j * 3 + {salt * 5}) % 11 - 5) / 10) * {v}[j + 1]"
    return f"list_transform(range({outputs}), lambda i: ((i * 5 + {salt * 3}) % 7 - 3) / 10 + list_sum(list_transform(range({inputs}), lambda j: {product})))"


def _wide_sums(end: str) -> str:
    return f"SELECT {end} AS hit_id, list(s ORDER BY i) AS m FROM (SELECT {end}, i, sum(m[i]) AS s FROM messages, range(1, {WIDTH + 1}) AS t(i) GROUP BY ALL) GROUP BY 1"


@query(
    f"""SELECT hit_id, list_transform({_wide(WIDTH, 3 * WIDTH, 7, 'z')}, lambda x: round(x, 3) + 0.0) AS x FROM (
    SELECT p.hit_id, list_concat(coalesce(i.m, list_transform(range({WIDTH}), lambda k: 0.0::DOUBLE)), list_concat(coalesce(o.m, list_transform(range({WIDTH}), lambda k: 0.0::DOUBLE)), p.v)) AS z FROM hits_e p
    LEFT JOIN ({_wide_sums('dst')}) i USING (hit_id) LEFT JOIN ({_wide_sums('src')}) o USING (hit_id))""",
    X.HITS_E, X.NEAR_E, X.EDGES_E, f"""messages AS (SELECT src, dst, {_relu(_wide(WIDTH, 3 * WIDTH, 6, 'z'))} AS m FROM (
        SELECT e.src, e.dst, list_concat(list_transform(range({WIDTH}), lambda k: e.score), list_concat(s.v, d.v)) AS z FROM edges_e e JOIN hits_e s ON s.hit_id = e.src JOIN hits_e d ON d.hit_id = e.dst))""",
)
def gnn_wide(spark, sf_dir):
    """A round on vectors of 64 components, the whole embedding. The SQL adds 0.0, as its rounding may give -0.0."""
    nodes = X.hits_e(spark, sf_dir).select("event_id", "hit_id", F.col("v").alias("x"))
    edges, parts = blocks.dealt(stored(X.edges_e(spark, sf_dir).select("event_id", "src", "dst", F.array("score").alias("e"))))
    nodes = blocks.interaction_round(nodes, edges, parts, [layer(WIDTH, 3 * WIDTH, 6, "ReLU")], [layer(WIDTH, 3 * WIDTH, 7)], WIDTH)
    return nodes.select("hit_id", F.transform("x", lambda x: F.round(x, 3)).alias("x"))


# components, paths, walks

REACH = W.reach("live_u")
KINDS = W.kinds("live_u")


@query("SELECT node, component FROM comp", X.HITS_E, X.NEAR_E, X.EDGES_E, W.reach("edges_e"), recursive=True)
def components_e(spark, sf_dir):
    return tracks.components(X.edges_e(spark, sf_dir)).select("node", "component")


@query("SELECT event_id, node, component FROM comp", X.EDGES_U, REACH, recursive=True)
def components_u(spark, sf_dir):
    return tracks.components(X.live_u(spark, sf_dir)).select("event_id", "node", "component")


def _parts(spark, sf_dir):
    live = cut(X.live_u(spark, sf_dir))
    labels = cut(tracks.components(live))
    return live, labels, cut(tracks.classified(live, labels))


@query("SELECT event_id, component, size, kind FROM kinds", X.EDGES_U, REACH, KINDS, recursive=True)
def component_stats(spark, sf_dir):
    return _parts(spark, sf_dir)[2]


@query("SELECT event_id, component, list(node ORDER BY node) AS hits FROM comp JOIN kinds USING (event_id, component) WHERE kind = 'simple' GROUP BY 1, 2", X.EDGES_U, REACH, KINDS, recursive=True)
def simple_paths(spark, sf_dir):
    _, labels, kinds = _parts(spark, sf_dir)
    return tracks.simple_tracks(labels, kinds)


@query(
    "SELECT src AS hit_id, round(max(s), 6) AS best_score FROM paths GROUP BY 1", X.EDGES_U, MARKED, DP_CUT,
    "paths(src, dst, s) AS (SELECT src, dst, score FROM dp_cut UNION ALL SELECT p.src, e.dst, p.s + e.score FROM paths p JOIN dp_cut e ON e.src = p.dst)", recursive=True,
)
def dp_best_score(spark, sf_dir):
    edges = E.dp_max_add_cut(X.live_u(spark, sf_dir))
    return waves.best_sums(edges).where("to IS NOT NULL").select(F.col("node").alias("hit_id"), F.round("best", 6).alias("best_score"))


def _walk(name: str, walk: str, reuse: bool = False) -> None:
    def run(spark, sf_dir):
        live, labels, kinds = _parts(spark, sf_dir)
        rest = tracks.complex_edges(live, labels, kinds)
        if walk == "dp":
            rest = E.dp_max_add_cut(rest)
        elif walk != "road":
            rest = E.max_add_cut(rest, look_at_incoming=walk == "lookback")
        return walk_components(rest, labels, walk, allow_node_reuse=reuse)

    run.__name__ = name
    query("SELECT event_id, component, ord, hits, score FROM walked", X.EDGES_U, W.walked("live_u", walk, reuse), recursive=True)(run)


for _name, _kind, _reuse in (("walk_longest", "longest", False), ("walk_longest_reuse", "longest", True), ("walk_level", "level", False), ("walk_lookback", "lookback", False), ("road_walk", "road", False), ("dp_tracks", "dp", False)):
    _walk(_name, _kind, _reuse)


# label streams

LISTS = "lists AS (SELECT src AS event_id, dst AS ord, list(q ORDER BY q) AS hits FROM (SELECT DISTINCT src, dst, q::BIGINT AS q FROM bip) GROUP BY 1, 2)"
STREAMS = "streams AS (SELECT event_id, flatten(list(list_append(hits, -1) ORDER BY ord)) AS labels FROM lists GROUP BY 1)"


def _streams(spark, sf_dir):
    rows = X.bip(spark, sf_dir).select(F.col("src").alias("event_id"), F.col("dst").alias("ord"), F.col("q").cast("long").alias("q")).distinct()
    lists = rows.groupBy("event_id", "ord").agg(F.array_sort(F.collect_list("q")).alias("hits"))
    return tracks.encoded(lists, rows.select("event_id").distinct())


@query("SELECT * FROM streams", X.BIP, LISTS, STREAMS)
def encode_labels(spark, sf_dir):
    return _streams(spark, sf_dir)


@query("SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY ord) - 1)::INTEGER AS ord, hits FROM lists", X.BIP, LISTS)
def decode_labels(spark, sf_dir):
    return tracks.decoded(_streams(spark, sf_dir))


@query("SELECT event_id, count(*) AS tracks FROM lists GROUP BY 1", X.BIP, LISTS)
def track_count(spark, sf_dir):
    return tracks.track_count(_streams(spark, sf_dir))


@query("SELECT event_id, component, list(node ORDER BY value, node) AS hits FROM comp JOIN (SELECT event_id AS node, value FROM events) USING (node) GROUP BY 1, 2", X.EDGES_U, REACH, recursive=True)
def sort_tracks(spark, sf_dir):
    labels = tracks.components(X.live_u(spark, sf_dir))
    groups = labels.groupBy("event_id", "component").agg(F.collect_list("node").alias("hits"))
    return tracks.sorted_by_radius(groups, X.hits_u(spark, sf_dir), "value")


# truth

@query("SELECT p.src, p.dst, t.truth_id IS NOT NULL AS y, coalesce(t.truth_id, -1) AS truth_id FROM pred p LEFT JOIN truth t USING (src, dst)", X.MATCHES)
def graph_intersection(spark, sf_dir):
    return truth.graph_intersection(*X.matches(spark, sf_dir)).select("src", "dst", "y", "truth_id")


@query("SELECT t.src, t.dst, p.src IS NOT NULL AS y FROM truth t LEFT JOIN pred p USING (src, dst)".replace("p.src IS NOT NULL", "p.event_id IS NOT NULL"), X.MATCHES)
def truth_found(spark, sf_dir):
    return truth.truth_found(*X.matches(spark, sf_dir)).select("src", "dst", "y")


@query(
    """SELECT round(hit / n_true, 9) AS total_eff, round(hs / ns, 9) AS signal_eff, round(hit / n_pred, 9) AS total_pur, round(hs / n_pred, 9) AS signal_pur,
    round(2 * (hs / ns) * (hit / n_pred) / (hs / ns + hit / n_pred), 9) AS f1 FROM (
    SELECT count(*)::DOUBLE AS n_true, count(*) FILTER (p.event_id IS NOT NULL)::DOUBLE AS hit, count(*) FILTER (signal)::DOUBLE AS ns,
        count(*) FILTER (signal AND p.event_id IS NOT NULL)::DOUBLE AS hs, (SELECT count(*) FROM pred)::DOUBLE AS n_pred FROM truth t LEFT JOIN pred p USING (src, dst))""",
    X.MATCHES,
)
def eff_purity(spark, sf_dir):
    out = truth.efficiency_purity(*X.matches(spark, sf_dir), "signal")
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


LOSSES = "rows AS (SELECT l_discount * 10 AS d2, l_returnflag = 'R' AS y, CASE WHEN l_quantity > 40 THEN -1.0 WHEN l_quantity < 5 THEN 0.0 ELSE l_quantity / 10 END AS w FROM lineitem)"


@query("SELECT round(avg(CASE WHEN (NOT y AND w <> 0) OR w < 0 THEN greatest(0, 0.25 - d2) * abs(w) END) + avg(CASE WHEN y AND w > 0 THEN d2 * abs(w) END), 6) AS loss FROM rows", LOSSES)
def hinge_loss(spark, sf_dir):
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("d2"), (F.col("l_returnflag") == "R").alias("y"), F.when(q > 40, -1.0).when(q < 5, 0.0).otherwise(q / 10).alias("weight"))
    return truth.hinge_loss(rows, 0.5).withColumn("loss", F.round("loss", 6))


@query(
    """SELECT p.src, p.dst, t.src IS NOT NULL AS y FROM pairs p LEFT JOIN edges_e t USING (src, dst)""", X.HITS_E, X.NEAR_E, X.EDGES_E,
    """placed AS (SELECT hit_id, row_number() OVER (ORDER BY hit_id) - 1 AS place FROM hits_e),
queries AS (SELECT hit_id FROM hits_e ORDER BY ('0x' || md5(concat_ws(':', event_id, hit_id, 42))[:8])::BIGINT, hit_id LIMIT 50),
hard AS (SELECT src, dst FROM (SELECT p.*, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS k FROM pairs_e p JOIN queries q ON q.hit_id = p.src WHERE d2 <= 1.2 * 1.2) WHERE k <= 20 AND src <> dst),
random_ AS (SELECT q.hit_id AS src, l.hit_id AS dst FROM queries q, range(1, 3) d(k) JOIN placed l ON l.place = ('0x' || md5(concat_ws(':', 0, q.hit_id, d.k, 42))[:8])::BIGINT % (SELECT count(*) FROM hits_e)),
found AS (SELECT src, dst FROM hard UNION ALL SELECT src, dst FROM random_ UNION ALL SELECT src, dst FROM edges_e),
pairs AS (SELECT DISTINCT CASE WHEN s.rr > d.rr OR (s.rr = d.rr AND f.src > f.dst) THEN f.dst ELSE f.src END AS src, CASE WHEN s.rr > d.rr OR (s.rr = d.rr AND f.src > f.dst) THEN f.src ELSE f.dst END AS dst
    FROM found f JOIN hits_e s ON s.hit_id = f.src JOIN hits_e d ON d.hit_id = f.dst)""",
)
def training_pairs(spark, sf_dir):
    """Near pairs of sampled hits, random pairs and known edges, put together and marked."""
    hits = X.hits_e(spark, sf_dir).select("event_id", "hit_id", "v")
    queries = cut(truth.sampled_queries(hits, 50))
    near = radius_join(queries, X.hits_e(spark, sf_dir).select("event_id", "hit_id", "v"), 1.2, 20).select("event_id", "src", "dst")
    random = truth.random_pairs(queries, hits, 2)
    known = X.edges_e(spark, sf_dir).select("event_id", "src", "dst")
    pairs = E.distinct_edges(E.oriented(near.union(random).union(known), X.hits_e(spark, sf_dir)))
    return truth.graph_intersection(pairs, known.withColumn("truth_id", F.col("src")), True).select("src", "dst", "y")


@query("SELECT t.src, t.dst, p.pred_id IS NOT NULL AS y, coalesce(p.pred_id, -1) AS pred_id FROM truth t LEFT JOIN (SELECT src, dst, src * 1000000 + dst AS pred_id FROM pred) p USING (src, dst)", X.MATCHES)
def truth_to_pred(spark, sf_dir):
    pred, true = X.matches(spark, sf_dir)
    return truth.truth_to_pred(pred.withColumn("pred_id", F.col("src") * 1000000 + F.col("dst")), true).select("src", "dst", "y", "pred_id")


@query(
    """SELECT p.src, p.dst, t.truth_id IS NOT NULL AS y, coalesce(t.truth_id, -1) AS truth_id FROM (SELECT DISTINCT l_suppkey AS src, l_partkey % 20 AS dst FROM lineitem WHERE l_returnflag = 'R') p
    LEFT JOIN (SELECT least(a, b) AS a, greatest(a, b) AS b, max(i) AS truth_id FROM (SELECT l_partkey % 20 AS a, l_suppkey AS b, l_orderkey AS i FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1, 2) t ON t.a = least(p.src, p.dst) AND t.b = greatest(p.src, p.dst)"""
)
def undirected_intersection(spark, sf_dir):
    lines, event = table(spark, sf_dir, "lineitem"), F.lit(0).cast("long").alias("event_id")
    pred = lines.where("l_returnflag = 'R'").select(event, F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 20).alias("dst"))
    true = lines.where("l_linestatus = 'F'").select(event, (F.col("l_partkey") % 20).alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_orderkey").alias("truth_id"))
    return truth.graph_intersection(pred, true, True, unique=False).select("src", "dst", "y", "truth_id")


@query(
    """SELECT round((SELECT avg(greatest(0, 1.21 - d2)) FROM near_t WHERE NOT y) + (SELECT avg(d2) FROM near_t WHERE y), 6) AS loss, round(hit / n, 9) AS total_eff, round(hit / n, 9) AS signal_eff,
    round(hit / m, 9) AS total_pur, round(hit / m, 9) AS signal_pur, round(2 * hit / (n + m), 9) AS f1
    FROM (SELECT count(*)::DOUBLE AS n FROM track) a, (SELECT count(*)::DOUBLE AS m, count(*) FILTER (y)::DOUBLE AS hit FROM near_t) b""",
    X.HITS_E, X.NEAR_E,
    "track AS (SELECT * FROM (SELECT vec_id AS src, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS dst FROM embeddings) WHERE dst IS NOT NULL)",
    "near_t AS (SELECT p.src, p.dst, d2, t.src IS NOT NULL AS y FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS k FROM pairs_e WHERE d2 <= 1.3 * 1.3) p LEFT JOIN track t USING (src, dst) WHERE k <= 100 AND p.src <> p.dst)",
)
def evaluation(spark, sf_dir):
    """Near pairs of all hits against the chain of hits of each label."""
    after = Window.partitionBy("label").orderBy("vec_id")
    known = table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("event_id"), F.col("vec_id").alias("src"), F.lead("vec_id").over(after).alias("dst")).where("dst IS NOT NULL")
    out = truth.evaluation(cut(X.near_e(spark, sf_dir, 100, 1.3)), known.withColumn("truth_id", F.col("src")), 1.1)
    return out.select(*(F.round(c, 6 if c == "loss" else 9).alias(c) for c in out.columns))


@query(
    """SELECT event_id, ord, coalesce(k.hits, []::BIGINT[]) AS hits FROM lists LEFT JOIN (
    SELECT event_id, ord, list(hit ORDER BY hit) AS hits FROM (
        SELECT event_id, ord, hit, row_number() OVER (PARTITION BY event_id, hit ORDER BY n DESC, ord) AS k FROM (SELECT event_id, ord, len(hits) AS n, unnest(hits) AS hit FROM lists)) WHERE k <= 2 GROUP BY 1, 2) k USING (event_id, ord)""",
    X.BIP, "lists AS (SELECT src AS event_id, dst AS ord, list(q ORDER BY q) AS hits FROM (SELECT DISTINCT src, dst, q::BIGINT AS q FROM bip) GROUP BY 1, 2)",
)
def resolve_ambiguities(spark, sf_dir):
    rows = X.bip(spark, sf_dir).select(F.col("src").alias("event_id"), F.col("dst").alias("ord"), F.col("q").cast("long").alias("q")).distinct()
    lists = rows.groupBy("event_id", "ord").agg(F.array_sort(F.collect_list("q")).alias("hits"))
    return tracks.resolved(lists, 2, ("event_id", "ord"))


@query("SELECT src, l_partkey AS dst FROM (SELECT l_suppkey * 7 AS src, l_partkey FROM lineitem)")
def remap_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.lit(0).cast("long").alias("event_id"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    ids = table(spark, sf_dir, "supplier").select(F.lit(0).cast("long").alias("event_id"), F.col("s_suppkey").alias("local"), (F.col("s_suppkey") * 7).alias("global"))
    return remapped(lines, ids).select("src", "dst")


@query(
    """SELECT hit_id, round(cr, 6) AS cluster_r_1, round(atan2(y, x), 6) AS cluster_phi_1, round(-ln(tan(atan2(cr, z) / 2)), 6) AS cluster_eta_1 FROM (
    SELECT *, sqrt(x * x + y * y) AS cr FROM (SELECT vec_id AS hit_id, 300 * embedding[1]::DOUBLE AS x, 300 * embedding[2]::DOUBLE AS y, 3000 * embedding[3]::DOUBLE AS z FROM embeddings))"""
)
def cluster_coordinates(spark, sf_dir):
    hits = X.hits_e(spark, sf_dir).select("hit_id", *(F.get("v", F.lit(i)).alias(f"cluster_{c}_1") for i, c in enumerate("xyz")))
    out = H.cluster_coordinates(hits, {"cluster_x_1": 300, "cluster_y_1": 300, "cluster_z_1": 3000})
    return out.select("hit_id", *(F.round(c, 6).alias(c) for c in ("cluster_r_1", "cluster_phi_1", "cluster_eta_1")))


GRAPH = [{"neighbour": weight(4, 3, 1), "root": weight(4, 3, 2), "bias": bias(4, 1), "activation": "ReLU"}, layer(3, 4, 3, "Tanh")]
NET = [layer(4, 6, 4, "Tanh", True) | {"batch_norm": {"gamma": [1.0, 0.5, 2.0, 1.5]}}, layer(1, 4, 5)]
POINTS_0 = "points AS (SELECT event_id, hit_id, v[1:3] AS x FROM hits_e)"


@query(
    "SELECT src, dst, round(1 / (1 + exp(-x[1])), 6) AS score FROM scored", X.HITS_E, X.NEAR_E, X.EDGES_E, POINTS_0, *N.sage("g0", "points", "edges_e", GRAPH[0]), *N.layers("g1", "g0", "event_id, hit_id", [GRAPH[1]]),
    f"ends_ AS (SELECT e.event_id, e.src, e.dst, list_concat(s.x, d.x) AS x FROM {N.ENDS.format('edges_e', 'g1')})", *N.layers("scored", "ends_", N.PAIR, NET),
)
def gnn_filter(spark, sf_dir):
    edges = stored(X.edges_e(spark, sf_dir).select("event_id", "src", "dst"))
    edges, parts = blocks.dealt(edges)
    return blocks.gnn_filter(_points(spark, sf_dir), edges, parts, GRAPH, NET).select("src", "dst", F.round("score", 6).alias("score"))


@query(
    f"SELECT hit_id, {_rounded(N.UNIT.replace('x,', 's.x,').replace('(x,', '(s.x,'))} AS src_emb, {_rounded(N.UNIT.replace('x,', 't.x,').replace('(x,', '(t.x,'))} AS tgt_emb FROM s JOIN t USING (hit_id)",
    X.HITS_E, POINTS, *N.layers("trunk", "points", "hit_id", [layer(4, 3, 1, "Tanh")]), *N.layers("s", "trunk", "hit_id", [layer(2, 4, 2)]), *N.layers("t", "trunk", "hit_id", [layer(2, 4, 3)]),
)
def double_embedding(spark, sf_dir):
    hits = X.hits_e(spark, sf_dir).select("hit_id", *((F.col(c) / 1000).alias(c) for c in "xyz"))
    out = nn.embed_both(hits, list("xyz"), [layer(4, 3, 1, "Tanh")], [layer(2, 4, 2)], [layer(2, 4, 3)])
    return out.select("hit_id", *(F.transform(c, lambda x: F.round(x, 6)).alias(c) for c in ("src_emb", "tgt_emb")))


# whole pipelines

@query("SELECT event_id, labels FROM streams", X.HITS_E, X.NEAR_E, X.EDGES_E, "live_e AS (SELECT * FROM edges_e WHERE score > 0.01)", W.walked("live_e", "lookback"), W.streams("hits_e", "rr"), recursive=True)
def pipeline_tracks(spark, sf_dir):
    """Radius join, orientation, distinct edges, scores, cuts, components, walks and label streams, over embeddings."""
    return pipeline.label_streams(X.edges_e(spark, sf_dir), X.hits_e(spark, sf_dir), PRESETS["metric_v4"])


@query("SELECT event_id, labels FROM streams", X.EDGES_U, "hits_u AS (SELECT user_id AS event_id, event_id AS hit_id, ts FROM events)", W.walked("live_u", "dp"), W.streams("hits_u", "ts"), recursive=True)
def pipeline_events(spark, sf_dir):
    """The same from edges on, over many events at once."""
    return pipeline.label_streams(X.edges_u(spark, sf_dir), X.hits_u(spark, sf_dir), PRESETS["double_v3_dp"])


def demo_weights(config: PipelineConfig, size: int = 4) -> dict:
    """Deterministic weights of the right shapes, for tests and queries."""
    n, g = len(config.embedding.features), 12 if config.cluster_gnn else len(config.gnn.features)
    served = config.embedding.features == PipelineConfig.embedding.features  # all but the pixel pipelines have graph layers before the filter
    graph = [{"neighbour": weight(6, n, 9), "root": weight(6, n, 10), "bias": bias(6, 9), "activation": "Tanh"}, layer(4, 6, 11, "Tanh")]
    wide = 2 if served else 1  # rounds that see the first encodings take vectors of twice the size
    return {
        "embedding": [layer(8, n, activation="Tanh", layer_norm=True), layer(4, 8, 1)],
        "trunk": [layer(8, n, activation="Tanh")],
        "source": [layer(4, 8, 1)],
        "target": [layer(4, 8, 1)],
        "filter_gnn": graph if served else [],
        "filter": [layer(4, 8 if served else 2 * n, 2, "Tanh") | ({"batch_norm": {"gamma": [0.5, 1.0, 1.5, 2.0], "beta": [0.1, 0.0, -0.1, 0.2]}} if served else {}), layer(1, 4, 3)],
        "node_encoder": [layer(size, g, 4, "Tanh") | ({"batch_norm": {}} if served else {})],
        "edge_encoder": [layer(size, 6 if "eta" in config.gnn.features else 2 * size, 5, "Tanh")],
        "rounds": [([layer(size, 3 * wide * size, 6, "Tanh")], [layer(size, (2 + wide) * size, 7, "Tanh")])] * 2,
        "decoder": [layer(size, size, 12, "ReLU"), layer(1, size, 8)],
        "size": size,
        "concat": served,
    }


def _preset(name: str, preset: str) -> None:
    config = replace(PRESETS[preset], r_max=0.6, filter_cut=0.01)  # untrained weights put few hits close together
    columns = list(dict.fromkeys([*config.embedding.features, *([] if config.cluster_gnn else config.gnn.features)]))

    def run(spark, sf_dir):
        """Hits in events of about ten, features by their place in the embedding."""
        base = X.hits_e(spark, sf_dir)
        part = lambda i, c: F.abs(F.get("v", F.lit(i % 64))) if c == "r" else F.get("v", F.lit(i % 64))
        made = [(part(i, c) * (1 + i // 64)).cast("float").alias(c) for i, c in enumerate(columns)]
        hits = base.select(F.pmod("hit_id", F.lit(50)).cast("long").alias("event_id"), F.col("hit_id"), *made)
        return pipeline.run(hits, demo_weights(config), config)

    run.__name__ = name
    made = ", ".join(f"({'abs' if c == 'r' else ''}(embedding[{i % 64 + 1}]::DOUBLE) * {1 + i // 64})::FLOAT AS {c}" for i, c in enumerate(columns))
    hits = f"hits AS (SELECT vec_id % 50 AS event_id, vec_id AS hit_id, {made} FROM embeddings)"
    query("SELECT event_id, labels FROM streams", hits, *N.pipeline("hits", demo_weights(config), config), recursive=True)(run)


for _name, _kind in (("pipeline_metric", "metric_v4"), ("pipeline_double", "double_v3"), ("pipeline_pixel", "pixel"), ("pipeline_pixel_v2", "pixel_v2")):
    _preset(_name, _kind)
for _kind in ("metric_v1", "metric_v2", "metric_v3", "double_v1", "double_v3_dp", "pixel_v1"):
    _preset(f"pipeline_{_kind}", _kind)
