"""Readers, writers and the stream of requests, on files of a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from hitweave import session
from hitweave.plans import catalog, pipeline
from hitweave.schema import HIT_COLUMNS, PIXEL_COLUMNS, PRESETS, StageSpec, hits_schema
from hitweave.sources import readers
from hitweave.sources import weights as W
from hitweave.streaming import requests


def test_random_hits_and_reader(spark, tmp_path):
    hits = readers.random_hits(spark, 20)
    assert [f.name for f in hits.schema] == ["event_id", "hit_id", *HIT_COLUMNS] and hits.count() == 20
    assert hits.collect() == readers.random_hits(spark, 20).repartition(3).orderBy("hit_id").collect()
    assert all(0 <= r[c] < 1 for r in hits.collect() for c in HIT_COLUMNS)
    path = str(tmp_path / "hits")
    hits.withColumn("more", F.lit(1)).withColumn("region", F.lit(2)).write.parquet(path)
    back = readers.read_hits(spark, path, PIXEL_COLUMNS)
    assert back.columns == ["event_id", "hit_id", *PIXEL_COLUMNS, "region"]
    assert "more" not in back._jdf.queryExecution().executedPlan().toString()  # only what is asked for is read
    with pytest.raises(ValueError, match="none_such"):
        readers.read_hits(spark, path, ["r", "none_such"])


def test_weights_module_maps_and_splits(spark, tmp_path):
    (tmp_path / "weights.json").write_text(json.dumps({"filter": [catalog.layer(1, 2)], "src_network.x": []}))
    assert readers.read_weights(spark, str(tmp_path / "weights.json")) == {"filter": [catalog.layer(1, 2)]}
    spark.createDataFrame([(1, 2, 3, 4)], "a long, b long, c long, occurence long").write.parquet(str(tmp_path / "map"))
    names = {"a": "mid_1", "b": "mid_2", "c": "mid_3"}
    assert [tuple(r) for r in readers.read_module_map(spark, str(tmp_path / "map"), names).collect()] == [(1, 2, 3, 4)]
    events = spark.range(500).withColumnRenamed("id", "event_id")
    parts = [readers.split(events, k, {"train": 0.8, "test": 0.2}) for k in ("train", "test")]
    assert parts[0].union(parts[1]).distinct().count() == 500 and 350 < parts[0].count() < 450
    with pytest.raises(ValueError, match="no split"):
        readers.split(events, "other", {"train": 1.0})


def test_sinks(spark, tmp_path):
    path = str(tmp_path)
    df = spark.createDataFrame([(0, 1, 2, 0.5, "train"), (0, 2, 3, 0.25, "train"), (1, 1, 2, 0.125, "test")], "event_id long, src long, dst long, score double, datatype string")
    for _ in range(2):
        assert readers.snapshot(df, path, "gnn").count() == 3
    readers.captured(df, path + "/in", 0)
    readers.captured(df.limit(1), path + "/in", 1)
    readers.captured(df.limit(2), path + "/in", 1)
    assert {r["request"]: r["count"] for r in spark.read.parquet(path + "/in").groupBy("request").count().collect()} == {0: 3, 1: 2}
    for n in (3, 1):
        readers.captured(df.limit(n), path + "/last", n, keep_all=False)
    assert spark.read.parquet(path + "/last/request").count() == 1
    readers.write_training_graphs(df, path + "/graphs")
    assert spark.read.parquet(path + "/graphs/datatype=train").count() == 2
    readers.graphviz(df.where("event_id = 0"), path + "/dot")
    lines = sorted(r[0] for r in spark.read.text(path + "/dot").collect())
    assert lines == ['  "0_1" -> "0_2" [label="0.500"];', '  "0_2" -> "0_3" [label="0.250"];']
    streams = spark.createDataFrame([(0, [1, 2, -1])], "event_id long, labels array<long>")
    readers.write_labels(streams, path + "/labels")
    with pytest.raises(Exception, match="already exists"):
        readers.write_labels(streams, path + "/labels")


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    config = PRESETS["pixel"]
    weights = catalog.demo_weights(config)
    hits = readers.random_hits(spark, 30, PIXEL_COLUMNS).withColumn("event_id", F.col("hit_id") % 3)
    hits = hits.select("event_id", "hit_id", *PIXEL_COLUMNS)
    for event in range(3):
        hits.where(f"event_id = {event}").coalesce(1).write.parquet(str(tmp_path / f"in{event}"))
    stream = requests.hits_stream(spark, str(tmp_path / "in*"), PIXEL_COLUMNS, files_at_once=2)
    assert stream.isStreaming and stream.schema == hits_schema(PIXEL_COLUMNS)
    run = lambda df: pipeline.run(df, weights, config)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # a second start finds nothing new
        requests.serve(stream, run, out, state).awaitTermination()
    got = {r["event_id"]: list(r["labels"]) for r in spark.read.parquet(out).collect()}
    assert got == {r["event_id"]: list(r["labels"]) for r in run(hits).collect()} and set(got) == {0, 1, 2}


def test_specs():
    assert StageSpec.parse("r, z", "2, -3") == StageSpec(("r", "z"), (2.0, -3.0))
    for names, scales in (("r", "1, 2"), ("r", "0")):
        with pytest.raises(ValueError):
            StageSpec.parse(names, scales)


def test_a_cluster_has_to_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


@pytest.mark.parametrize("preset", ["pixel", "pixel_v2", "metric_v4", "double_v3"])
def test_weights_table_comes_back(spark, tmp_path, preset):
    config = PRESETS[preset]
    weights = catalog.demo_weights(config)
    W.write_weights(spark, weights | {"src_network.x": [catalog.layer(1, 2)], "aggregate": "mean", "recurrent": True}, str(tmp_path / "weights"))
    back = W.read_weights(spark, str(tmp_path / "weights"), config)
    plain = lambda x: json.loads(json.dumps(x))
    assert plain(back) == plain(weights | {"aggregate": "mean", "recurrent": True})


def test_weights_that_do_not_fit_are_told(spark, tmp_path):
    config = PRESETS["metric_v4"]
    good = catalog.demo_weights(config)
    W.check_weights(good, config)
    layer = catalog.layer
    wrong = [
        ({"embedding": [layer(8, 36), layer(4, 8)]}, "takes .36. components and gets 37"),
        ({"embedding": [layer(8, 37), layer(4, 9)]}, "layer 1 of embedding"),
        ({"embedding": [layer(8, 37, activation="Swish")]}, "no activation Swish"),
        ({"filter": [layer(4, 8), layer(2, 4)]}, "gives 2 components, not 1"),
        ({"filter": [layer(4, 2 * 37), layer(1, 4)]}, "layer 0 of filter"),
        ({"filter": [layer(4, 8) | {"batch_norm": {"gamma": [1.0]}}, layer(1, 4)]}, "gamma of batch norm"),
        ({"filter": [layer(4, 8) | {"bias": [0.0]}, layer(1, 4)]}, "a bias of 1"),
        ({"node_encoder": [layer(5, 12)]}, "node_encoder gives 5"),
        ({"edge_encoder": [layer(4, 7)]}, "edge_encoder"),
        ({"concat": False}, "rounds/0/edge"),
        ({"in_out_diff": False}, "rounds/0/node"),
        ({"size": 5}, "node_encoder gives 4"),
        ({"aggregate": "max"}, "no aggregate max"),
        ({"recurrent": True, "rounds": [good["rounds"][0], ([layer(4, 24, 1)], [layer(4, 16, 1)])]}, "recurrent but differ"),
        ({"decoder": [layer(1, 5)]}, "decoder"),
    ]
    for change, words in wrong:
        with pytest.raises(ValueError, match=words):
            W.check_weights(good | change, config)
    with pytest.raises(ValueError, match="no weights"):
        W.check_weights({k: v for k, v in good.items() if k != "filter"}, config)
    W.weights_table(spark, good).where("NOT (model = 'filter' AND kind = 'weight' AND i = 1 AND j = 2)").write.parquet(str(tmp_path / "gaps"))
    with pytest.raises(ValueError, match="gaps"):
        W.read_weights(spark, str(tmp_path / "gaps"))


def test_events_over_several_files(spark, tmp_path):
    hits = readers.random_hits(spark, 36, PIXEL_COLUMNS).withColumn("event_id", F.col("hit_id") % 3).select("event_id", "hit_id", *PIXEL_COLUMNS)
    run = lambda df: df.groupBy("event_id").agg(F.sort_array(F.collect_list(F.round(F.col("r") * 1000 + F.col("hit_id")).cast("long"))).alias("labels"))
    parts = hits.withColumn("n_hits", F.lit(12).cast("long"))
    out, state, source = str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "in")

    def arrives(name, condition):
        parts.where(condition).coalesce(1).write.parquet(f"{source}/{name}")
        stream = requests.whole_events(requests.hits_stream(spark, f"{source}/*", PIXEL_COLUMNS, announced=True), patience)
        requests.serve(stream, run, out, state).awaitTermination()
        return sorted((r["event_id"], list(r["labels"])) for r in spark.read.parquet(out).collect())

    patience = 600_000
    want = {r["event_id"]: list(r["labels"]) for r in run(hits).collect()}
    answers = lambda *events: [(e, want[e]) for e in events]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert arrives("a", "hit_id < 12") == []
    assert arrives("b", "hit_id < 12 AND event_id < 2 OR hit_id BETWEEN 12 AND 23") == []  # some rows come again
    assert arrives("c", "hit_id >= 24 AND event_id = 1") == answers(1)
    assert arrives("d", "event_id = 1 OR hit_id >= 24 AND event_id = 0") == answers(0, 1)  # all of event 1 comes again
    patience = 1
    assert arrives("e", "event_id = 2 AND hit_id = 2") == answers(0, 1)
    got = arrives("f", "event_id = 0 AND hit_id = 0")
    assert got == [*answers(0, 1), (2, [-1])]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
