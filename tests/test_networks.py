"""Long vectors: segment sums and products in Arrow equal the expressions of the short form."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hitweave.operators import nn
from hitweave.plans.catalog import layer


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(2)
    nodes = [(e, i, rng.integers(-8, 9, 40).astype(float).tolist()) for e in (0, 1) for i in range(60)]
    edges = [(int(rng.integers(2)), int(rng.integers(50)), int(rng.integers(50)), rng.integers(-8, 9, 40).astype(float).tolist()) for _ in range(400)]
    return spark.createDataFrame(nodes, "event_id long, hit_id long, x array<double>"), spark.createDataFrame(edges, "event_id long, src long, dst long, e array<double>").repartition(5)


@pytest.mark.parametrize("mean", [False, True])
def test_wide_sums(spark, graph, mean, monkeypatch):
    _, edges = graph
    rows = edges.select("event_id", F.col("dst").alias("hit_id"), "e")
    key = lambda df: sorted((r["event_id"], r["hit_id"], tuple(np.round(r["e"], 9))) for r in df.collect())
    wide = key(nn.vector_sum(rows, ["event_id", "hit_id"], "e", 40, mean))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # segments go on from batch to batch
    many = key(nn.vector_sum(rows, ["event_id", "hit_id"], "e", 40, mean))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    monkeypatch.setattr(nn, "WIDE", 1000)
    assert wide == many == key(nn.vector_sum(rows, ["event_id", "hit_id"], "e", 40, mean)) and len(wide) > 50
    assert nn._wide_sum(rows.limit(0), ["event_id", "hit_id"], "e", mean).count() == 0


def test_wide_layers(graph, monkeypatch):
    nodes, edges = graph
    sage = {"neighbour": layer(40, 40, 3)["weight"], "root": layer(40, 40, 4)["weight"], "bias": layer(40, 40, 4)["bias"], "activation": "Tanh"}
    rounds = [([layer(40, 120, 6, "ReLU", True)], [layer(40, 120, 7, "Tanh")])]

    def both():
        encoded = nn.gnn_encoded(nodes, edges, "x", [sage, layer(5, 40, 8, "SiLU")])
        scores = nn.interaction_gnn(nodes, edges.dropDuplicates(["event_id", "src", "dst"]), rounds, [layer(1, 40, 9)], 40)
        return sorted((r["event_id"], r["hit_id"], tuple(np.round(r["x"], 6))) for r in encoded.collect()), sorted((r["event_id"], r["src"], r["dst"], round(r["score"], 6)) for r in scores.select("event_id", "src", "dst", "score").collect())

    first = nodes.collect()
    assert len(first) == 120
    edges = edges.groupBy("event_id", "src", "dst").agg(F.max("e").alias("e"))
    got = both()
    monkeypatch.setattr(nn, "WIDE", 1000)
    assert got == both()


def test_null_vectors_stay_null_in_large_layers(spark):
    df = spark.createDataFrame([(1, [1.0] * 40), (2, None), (3, [2.0] * 40)], "i long, v array<double>")
    rows = {r["i"]: r["y"] for r in nn.mlp(df, "v", [layer(20, 40, 1)], "y").collect()}
    assert rows[2] is None and len(rows[1]) == len(rows[3]) == 20
    assert nn.mlp(df.where("v IS NULL"), "v", [layer(20, 40, 1)], "y").first()["y"] is None


def test_a_million_edges_of_128_components(spark, tmp_path):
    n, size = 1_000_000, 128
    rng = np.random.default_rng(1)
    ends = rng.integers(0, 50_000, n)
    pq.write_table(pa.table({"event_id": np.zeros(n, np.int64), "hit_id": ends, "w": rng.integers(0, 100, n)}), tmp_path / "edges.parquet")
    edges = spark.read.parquet(str(tmp_path / "edges.parquet"))
    vectors = edges.select("event_id", "hit_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.col("w") + i).cast("double")).alias("e"))
    sums = nn.vector_sum(vectors, ["event_id", "hit_id"], "e", size)
    total = sums.select(F.col("hit_id"), F.get("e", F.lit(0)).alias("a"), F.get("e", F.lit(size - 1)).alias("b")).toPandas()
    own = np.bincount(ends, weights=pq.read_table(tmp_path / "edges.parquet")["w"].to_numpy(), minlength=50_000)
    many = np.bincount(ends, minlength=50_000)
    assert len(total) == (many > 0).sum()
    assert np.array_equal(total["a"], own[total["hit_id"]]) and np.array_equal(total["b"], (own + many * (size - 1))[total["hit_id"]])
