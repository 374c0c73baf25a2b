"""What networks over many edges shuffle: each pair once, and each node to no more blocks than need be."""

import math

from hitweave.operators import blocks as B
from hitweave.operators import edges as E
from hitweave.plans import fixtures as X


def test_a_pair_is_oriented_once(spark, monkeypatch):
    rows = [(i, [float(i % 7) / 9, float(i % 5) / 9, float(i % 3) / 9]) for i in range(40)] + [(3, [0.1, 0.2, 0.9])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(X, "table", lambda *_: base)
    pairs = []
    monkeypatch.setattr(E, "oriented", lambda near, nodes, keep=E.oriented: pairs.append(near.count()) or keep(near, nodes))
    got = sorted(map(tuple, X.edges_e(spark, "").collect()))
    near = X.near_e(spark, "")
    turned = E.oriented(near, X.hits_e(spark, ""))
    assert pairs[0] * 2 == pairs[1] == near.count()
    want = {}
    for event, src, dst, d2 in map(tuple, turned.select("event_id", "src", "dst", "d2").collect()):
        want[event, src, dst] = max(want.get((event, src, dst), 0.0), 1 / (1 + math.exp(-40 * (1.10 - math.sqrt(d2)))))
    assert [x[:3] for x in got] == sorted(want) and all(abs(x[3] - want[x[:3]]) < 1e-6 for x in got)


def test_large_events_have_fuller_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 10)
    edges = spark.range(4100).selectExpr("IF(id < 4000, 0, 1) AS event_id", "id % 90 AS src", "100 + id % 77 AS dst")
    assert dict(map(tuple, B.dealt(edges)[1].select("event_id", "parts").collect())) == {0: 14, 1: 4}
