"""Networks on edges in blocks against those on joined edges."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave import session
from hitweave.functions import scalars as S
from hitweave.operators import blocks as B
from hitweave.operators import edges as E
from hitweave.operators import nn
from hitweave.plans import pipeline
from hitweave.plans.catalog import bias, demo_weights, layer, weight
from hitweave.schema import PRESETS


@pytest.fixture
def graph(spark, monkeypatch):
    """Two events of 40 hits with pairs both ways, in blocks of some 60."""
    monkeypatch.setattr(B, "BLOCK", 60)
    monkeypatch.setattr(B, "CHUNK", 17)
    rng = np.random.default_rng(4)
    hits = spark.createDataFrame([(e, 100 * e + i, float(rng.integers(5)), rng.normal(size=4).tolist()) for e in (1, 2) for i in range(40)], "event_id long, hit_id long, rr double, x array<double>").cache()
    pairs = {(e, 100 * e + int(a), 100 * e + int(b)) for e in (1, 2) for a, b in rng.integers(40, size=(300, 2)) if a != b}
    return hits, spark.createDataFrame(sorted(pairs), "event_id long, src long, dst long").cache()


def rows(df):
    return {tuple(r[:3]): r[3] for r in df.select("event_id", "src", "dst", "score").collect()}


@pytest.mark.parametrize("ties", [True, False])
def test_oriented_distinct(graph, ties):
    hits, pairs = graph
    edges, parts = B.oriented_distinct(pairs, hits, "rr", ties)
    assert parts.agg(F.min("parts")).first()[0] > 1
    assert sorted(edges.select("event_id", "src", "dst").collect()) == sorted(E.distinct_edges(E.oriented(pairs, hits, "rr", ties)).collect())


def test_filter_and_rounds(graph):
    hits, pairs = graph
    nodes = hits.select("event_id", "hit_id", "x")
    edges, parts = B.oriented_distinct(pairs, hits, "rr", True)
    edges = session.stored(edges)
    plain = edges.drop("part")
    layers = [{"neighbour": weight(4, 4, 1), "root": weight(4, 4, 2), "bias": bias(4, 1), "activation": "ReLU"}, layer(4, 4, 3, "Tanh")]
    net = [layer(4, 8, 4, "Tanh", True) | {"batch_norm": {"gamma": [1.0, 0.5, 2.0, 1.5]}}, layer(1, 4, 5)]
    a, b = rows(B.gnn_filter(nodes, edges, parts, layers, net)), rows(nn.gnn_filter(nodes, plain, "x", layers, net))
    assert a.keys() == b.keys() and a == pytest.approx(b, abs=1e-12)

    encoder, decoder = [layer(4, 8, 5, "Tanh") | {"batch_norm": {}}], [layer(1, 4, 8)]
    for how, diff, concat in (("sum", True, True), ("mean", False, False), ("mean", True, True)):
        wide = 2 if concat else 1
        rounds = [([layer(4, 12 * wide, 6, "Tanh")], [layer(4, 4 * (1 + diff + wide), 7, "Tanh")])] * 3
        e = nn.mlp(E.gathered(plain, nodes, ["x"]).withColumn("__e", F.concat("s_x", "d_x")), "__e", encoder, "e").select("event_id", "src", "dst", "e")
        b = rows(nn.interaction_gnn(nodes, e, rounds, decoder, 4, how, diff, concat))
        a = rows(B.interaction_gnn(nodes.withColumnRenamed("x", "x0"), edges, parts, B.encoded_ends, encoder, rounds, decoder, 4, how, diff, concat))
        assert a.keys() == b.keys() and a == pytest.approx(b, abs=1e-10)


def test_edge_features(graph):
    hits, pairs = graph
    scaled = hits.select("event_id", "hit_id", F.col("rr").alias("r"), *(F.get("x", F.lit(i)).alias(c) for i, c in enumerate(("phi", "z", "eta"))))
    names = list(S.edge_features())
    want = {tuple(r[:3]): list(r[3:]) for r in E.with_features(pairs, scaled).select("event_id", "src", "dst", *names).collect()}
    local = scaled.toPandas()
    place = {h: i for i, h in enumerate(local["hit_id"])}
    keys = list(want)
    s, d = (np.array([place[k[i]] for k in keys]) for i in (1, 2))
    assert np.allclose(B.edge_features({"f": local[["r", "phi", "z", "eta"]].to_numpy()}, s, d), [want[k] for k in keys])


def test_no_vector_of_an_edge_is_written(spark, monkeypatch):
    config = replace(PRESETS["double_v3"], r_max=2.0, filter_cut=0.0)
    rng = np.random.default_rng(6)
    columns = list(dict.fromkeys([*config.embedding.features, *config.gnn.features]))
    hits = spark.createDataFrame([(i % 3, i, *rng.normal(size=len(columns)).tolist()) for i in range(60)], f"event_id long, hit_id long, {', '.join(f'{c} double' for c in columns)}")
    written = []

    def noted(f):
        def run(df):
            out = f(df)
            written.append((any(t.startswith("array") for _, t in df.dtypes), out.count()))
            return out

        return run

    for module in (nn, pipeline, B):
        for name in ("stored", "cut"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, noted(getattr(module, name)))
    assert pipeline.run(hits, demo_weights(config), config).count() == 3
    assert max(n for vectors, n in written if not vectors) > 300  # edges
    assert max(n for vectors, n in written if vectors) <= 60


@pytest.mark.parametrize("size", [4, 40])
def test_round_equals_that_of_joined_edges(graph, size):
    hits, pairs = graph
    nodes = hits.select("event_id", "hit_id", F.flatten(F.array_repeat("x", size // 4)).alias("x"))
    plain = pairs.withColumn("score", F.round(F.pmod("src", F.lit(7)) / 7.0, 3))
    edges, parts = B.dealt(plain.withColumn("e", F.array("score")).drop("score"))
    nets = [layer(size, 3 * size, 6, "ReLU")], [layer(size, 3 * size, 7)]
    by_node = lambda df: {tuple(r[:2]): r[2] for r in df.select("event_id", "hit_id", "x").collect()}
    want = by_node(nn.interaction_round(nodes, plain.withColumn("e", F.array_repeat("score", size)).drop("score"), *nets, size)[0])
    got = by_node(B.interaction_round(nodes, edges, parts, *nets, size))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_a_block_has_the_nodes_of_two_parts(graph):
    hits, pairs = graph
    edges, parts = B.dealt(pairs)
    met = B.met(edges, hits.select("event_id", "hit_id"), parts, lambda a, b: a.select(["event_id"]).slice(0, 1).append_column("n", [[b.num_rows] if a.num_rows else []]), "event_id long, n long")
    assert parts.agg(F.min("parts")).first()[0] >= 3
    assert met.agg(F.max("n")).first()[0] < 40  # of 40 nodes in an event
