"""Components against union-find, walks against worked micro-graphs and exhaustive search."""

import random
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hitweave.functions import scalars as S
from hitweave.operators import edges as E
from hitweave.operators import neighbours, tracks, truth, walks, waves
from hitweave.operators.components import connected_components
from hitweave.operators.numbering import row_numbers


def union_find(edges):
    parent = {}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in parent}


@pytest.mark.parametrize("bound", [0, 15, 500_000])
@pytest.mark.parametrize("kind", ["path", "random", "star", "tree"])
def test_components(spark, kind, bound):
    rng = random.Random(4)
    if kind == "path":
        ids = rng.sample(range(1000), 60)
        edges = list(pairwise(ids))
    elif kind == "random":
        edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    elif kind == "star":
        edges = [(7, i) for i in range(100)] + [(500, i) for i in range(101, 200)] + [(150, 300), (300, 50), (9, 9), (999, 999)]
    else:
        ids = rng.sample(range(1000), 100)
        edges = [(ids[i], ids[rng.randrange(i)]) for i in range(1, 100)]
    df = spark.createDataFrame(edges + edges[:3] + [(None, 1)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df, bound=bound).collect()}
    assert got == union_find(edges)


@pytest.mark.parametrize("kind", ["path", "band"])
def test_components_of_rising_ids(spark, kind):
    width = 1 if kind == "path" else 10
    edges = [(i, i + k) for i in range(3000) for k in range(1, width + 1) if i + k < 3000]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), bound=50).collect()}
    assert got == dict.fromkeys(range(3000), 0)


def test_components_stay_within_events(spark):
    df = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (2, 3, 4)], "event_id long, src long, dst long")
    got = {(r["event_id"], r["node"], r["component"]) for r in tracks.components(df).collect()}
    assert got == {(1, 1, 1), (1, 2, 1), (2, 2, 2), (2, 3, 2), (2, 4, 2)}
    assert tracks.components(df.limit(0)).count() == 0
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, 3, 3, 3, None]), f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(120)]
    want = {(e, n, c) for e in (1, 2, 3) for n, c in union_find([r[1:] for r in rows if r[0] == e]).items()}
    want |= {(None, n, n) for r in rows if r[0] is None for n in r[1:]}
    for bound in (0, 20, 500_000):
        found = connected_components(spark.createDataFrame(rows, "e int, src string, dst string").repartition(3), within=("e",), bound=bound)
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


GRAPHS = {
    3: [(10, 11, 0.9), (10, 12, 0.7), (11, 13, 0.8), (12, 13, 0.65), (13, 14, 0.95)],
    4: [(20, 21, 0.95), (21, 22, 0.7), (20, 23, 0.62), (23, 24, 0.9), (24, 25, 0.9)],
    5: [(30, 31, 0.5), (30, 32, 0.3), (31, 33, 0.05), (32, 33, 0.4), (33, 34, 0.2)],
    6: [(40, 42, 0.9), (41, 42, 0.7), (42, 43, 0.8), (42, 44, 0.55)],
    7: [(50, 51, 0.9), (51, 52, 0.8), (52, 53, 0.7), (54, 52, 0.95), (54, 55, 0.65), (56, 51, 0.3)],
}
REMOVED = {
    "v2": {5: {(30, 32), (31, 33)}, 6: {(42, 44)}},
    "v4": {5: {(30, 32), (31, 33)}, 6: {(42, 44), (41, 42)}, 7: {(56, 51)}},
    "dp": {5: {(30, 32), (31, 33)}, 6: {(42, 44)}, 7: {(56, 51)}},
}
TRACKS = {
    "longest": {3: [[10, 11, 13, 14]], 4: [[20, 23, 24, 25], [21, 22]], 5: [[30, 31], [32, 33, 34]], 6: [[40, 42, 43]], 7: [[50, 51, 52, 53], [54, 55]]},
    "reuse": {3: [[10, 11, 13, 14], [12, 13, 14]], 4: [[20, 23, 24, 25], [21, 22]], 5: [[30, 31], [32, 33, 34]], 6: [[40, 42, 43], [41, 42, 43]], 7: [[50, 51, 52, 53], [56, 51, 52, 53], [54, 52, 53]]},
    "level": {3: [[10, 11, 13, 14]], 4: [[20, 23, 24, 25], [21, 22]], 5: [[30, 31], [32, 33, 34]], 6: [[40, 42, 43]], 7: [[50, 51, 52, 53], [54, 55]]},
    "lookback": {3: [[10, 11, 13, 14]], 4: [[20, 21, 22], [23, 24, 25]], 5: [[30, 31], [32, 33, 34]], 6: [[40, 42, 43]], 7: [[50, 51, 52, 53], [54, 55]]},
    "road": {3: [[10, 11, 12, 13, 14]], 4: [[20, 21, 23, 24, 25]], 5: [[32, 33, 34]], 6: [[40, 42, 43]], 7: [[50, 51, 52, 53]]},
    "dp": {3: [[10, 11, 13, 14]], 4: [[20, 23, 24, 25], [21, 22]], 5: [[30, 31], [32, 33, 34]], 6: [[40, 42, 43]], 7: [[50, 51, 52, 53], [54, 55]]},
}


def by_target(edges):
    return sorted(edges, key=lambda e: (e[1], e[0]))


def after(cut, number):
    return by_target([e for e in GRAPHS[number] if e[:2] not in REMOVED[cut].get(number, set())])


@pytest.mark.parametrize("cut", list(REMOVED))
def test_cuts(spark, cut):
    rows = [(n, *e) for n, g in GRAPHS.items() for e in g]
    df = spark.createDataFrame(rows, "event_id long, src long, dst long, score double")
    out = E.dp_max_add_cut(df) if cut == "dp" else E.max_add_cut(df, look_at_incoming=cut == "v4")
    gone = {}
    for r in df.exceptAll(out).collect():
        gone.setdefault(r["event_id"], set()).add((r["src"], r["dst"]))
    assert gone == REMOVED[cut]


@pytest.mark.parametrize("number", list(GRAPHS))
def test_walks_on_micro_graphs(number):
    assert sorted(walks.greedy_walk(after("v2", number), "longest")) == sorted(TRACKS["longest"][number])
    assert sorted(walks.greedy_walk(after("v2", number), "longest", True)) == sorted(TRACKS["reuse"][number])
    assert sorted(walks.greedy_walk(after("v2", number), "level")) == sorted(TRACKS["level"][number])
    assert sorted(walks.greedy_walk(after("v4", number), "lookback")) == sorted(TRACKS["lookback"][number])
    assert sorted(walks.road_walk(by_target(GRAPHS[number]), 0.1, 0.6)) == sorted(TRACKS["road"][number])
    assert sorted(p for p, _ in walks.dp_walk(after("dp", number))) == sorted(TRACKS["dp"][number])


def all_paths(start, out, used, dead_ends):
    """Complete paths by level, listed one by one."""
    levels, paths = [], [([start], [0.0])]
    while paths:
        done, longer = [], []
        for path, scores in paths:
            ways = [d for d in out.get(path[-1], ()) if d not in used]
            if not out.get(path[-1]) or (dead_ends and not ways):
                done.append((path, scores))
            for d in ways:
                longer.append((path + [d], scores + ([out[path[-1]][d]] if len(ways) > 1 else [])))
        levels.append(done)
        paths = longer
    return levels


@pytest.mark.parametrize("choice", ["longest", "level", "lookback"])
def test_walks_equal_exhaustive_search(choice):
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randrange(3, 11)
        edges = by_target([(a, b, rng.choice([0.2, 0.5, 0.7, rng.random()])) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4])
        out, used, want = walks.adjacency(edges), set(), []
        for start in walks.topological(out):
            if start in used:
                continue
            levels = all_paths(start, out, used, choice != "longest")
            if choice == "longest":
                flat = [p for level in levels for p, _ in level]
                best = max(flat, key=len, default=[])
            elif choice == "level":
                best = levels[-1][0][0]
            else:
                pool = levels[-1] + (levels[-2] if len(levels) > 1 else [])
                best = max(pool, key=lambda x: x[1])[0]
            if len(best) > 1:
                want.append(best)
                used.update(best)
        assert walks.greedy_walk(edges, choice) == want


def test_dp_scores_equal_exhaustive_search():
    rng = random.Random(9)
    for _ in range(50):
        edges = by_target([(a, b, rng.random()) for a in range(8) for b in range(a + 1, 8) if rng.random() < 0.4])
        out = walks.adjacency(edges)
        best = walks.best_scores(edges)
        for n in best:
            sums = [sum(out[a][b] for a, b in pairwise(p)) for level in all_paths(n, out, set(), False) for p, _ in level]
            assert abs(best[n][0] - max(sums, default=0.0)) < 1e-9


def test_walks_do_not_depend_on_partitions(spark):
    rows = [(n, *e) for n, g in GRAPHS.items() for e in g]
    results = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "event_id long, src long, dst long, score double").repartition(parts)
        labels = tracks.components(df)
        found = walks.walk_components(E.max_add_cut(df, look_at_incoming=True), labels, "lookback")
        results.append(sorted((r["event_id"], r["ord"], tuple(r["hits"])) for r in found.collect()))
    assert results[0] == results[1] == sorted((n, i, tuple(t)) for n, ts in TRACKS["lookback"].items() for i, t in enumerate(ts))


def test_label_streams(spark):
    df = spark.createDataFrame([(1, [5, 6, -1, 7, -1]), (2, [-1]), (3, [5, -1, 6])], "event_id long, labels array<long>")
    got = {}
    for r in tracks.decoded(df).orderBy("event_id", "ord").collect():
        got.setdefault(r["event_id"], []).append(list(r["hits"]))
    assert got == {1: [[5, 6], [7]], 2: [[]], 3: [[5]]}
    assert {r["event_id"]: r["tracks"] for r in tracks.track_count(df).collect()} == {1: 2, 2: 1, 3: 1}


def test_undirected_intersection(spark):
    pred = spark.createDataFrame([(0, 1, 2), (0, 3, 2), (0, 4, 5)], "event_id long, src long, dst long")
    true = spark.createDataFrame([(0, 2, 1, 7), (0, 3, 2, 8)], "event_id long, src long, dst long, truth_id long")
    key = lambda df: {(r["src"], r["dst"]): (r["y"], r["truth_id"]) for r in df.collect()}
    assert key(truth.graph_intersection(pred, true)) == {(1, 2): (False, -1), (3, 2): (True, 8), (4, 5): (False, -1)}
    assert key(truth.graph_intersection(pred, true, True)) == {(1, 2): (True, 7), (3, 2): (True, 8), (4, 5): (False, -1)}


def test_ambiguities(spark):
    df = spark.createDataFrame([(0, 0, 0, [1, 2]), (0, 0, 1, [2, 3, 4]), (0, 0, 2, [2, 5]), (0, 0, 3, [2]), (1, 0, 0, [2])], "event_id long, component long, ord int, hits array<long>")
    got = {(r["event_id"], r["ord"]): list(r["hits"]) for r in tracks.resolved(df, 1).collect()}
    assert got == {(0, 0): [1], (0, 1): [2, 3, 4], (0, 2): [5], (0, 3): [], (1, 0): [2]}
    rng = random.Random(2)
    rows = [(0, 0, i, rng.sample(range(12), rng.randrange(1, 6))) for i in range(30)]
    for most in (1, 3):
        count, want = {}, {}
        for r in sorted(rows, key=lambda r: (-len(r[3]), r[2])):
            want[r[2]] = [h for h in r[3] if count.get(h, 0) < most]
            for h in want[r[2]]:
                count[h] = count.get(h, 0) + 1
        found = tracks.resolved(spark.createDataFrame(rows, df.schema), most).collect()
        assert {r["ord"]: list(r["hits"]) for r in found} == want


@pytest.mark.parametrize("kind", ["longest", "reuse", "level", "lookback", "road", "dp"])
def test_walks_by_joins_equal_walks_in_a_task(spark, kind):
    """Components above the bound, here all with more than two edges, some with cycles."""
    rng, rows = random.Random(3), []
    for part in range(5):
        ids = [part * 100 + i for i in range(rng.randrange(5, 10))]
        rows += [(part % 2, a, b, round(rng.choice([0.2, 0.5, 0.7, rng.random()]), 3)) for a in ids for b in ids if (a < b and rng.random() < 0.35) or (part == 3 and a > b and rng.random() < 0.06)]
    df = spark.createDataFrame(rows, "event_id long, src long, dst long, score double")
    labels = tracks.components(df)
    choice, reuse = ("longest", True) if kind == "reuse" else (kind, False)
    key = lambda f: sorted((r["event_id"], r["component"], r["ord"], tuple(r["hits"]), None if r["score"] is None else round(r["score"], 9)) for r in f.collect())
    want = key(walks.walk_components(df, labels, choice, allow_node_reuse=reuse))
    assert key(walks.walk_components(df, labels, choice, allow_node_reuse=reuse, bound=2)) == want and len(want) > 3


def test_best_sums_end_on_cycles(spark):
    df = spark.createDataFrame([(0, 1, 2, 0.5), (0, 2, 3, 0.5), (0, 3, 2, 0.9), (0, 7, 8, 0.25), (0, 8, 9, 0.5), (0, 7, 9, 0.75)], "event_id long, src long, dst long, score double")
    got = {r["node"]: (r["best"], r["to"]) for r in waves.best_sums(df).collect()}
    assert got == {9: (0.0, None), 8: (0.5, 9), 7: (0.75, 8)}


def test_row_numbers_of_a_large_group(spark):
    rows = [(k, v) for k in (1, None) for v in range(3000)] + [(2, 5), (3, 1), (3, 0)]
    random.Random(1).shuffle(rows)
    got = row_numbers(spark.createDataFrame(rows, "k long, v long").repartition(5), ["k"], ["v"], "n").collect()
    assert {(r["k"], r["v"]): r["n"] for r in got} == {**{(k, v): v for k in (1, None) for v in range(3000)}, (2, 5): 0, (3, 0): 0, (3, 1): 1}


@pytest.mark.parametrize("k_max,small", [(None, 20), (3, 20), (3, 4096)])
def test_radius_join_equals_brute_force(spark, k_max, small, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", small)
    monkeypatch.setattr(neighbours, "QUERIES", 30)
    monkeypatch.setattr(neighbours, "TOGETHER", 40)
    rng = random.Random(6)
    rows = [(e, i, [rng.randrange(-8, 9) / 4 for _ in range(3)]) for e, n in ((0, 150), (1, 40), (2, 1)) for i in range(n)]
    asked = [r for r in rows if r[1] % 2 == 0] + [(3, 0, [0.0, 0.0, 0.0]), (0, 999, None)]
    schema = "event_id long, hit_id long, v array<double>"
    got = neighbours.radius_join(spark.createDataFrame(asked, schema), spark.createDataFrame(rows, schema), 1.0, k_max, loops=True).collect()
    want = set()
    for e, i, v in asked:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for f, j, w in rows if f == e and v is not None) if v else []
        want |= {(e, i, j, d) for d, j in [x for x in near if x[0] <= 1.0][:k_max]}
    assert {(r["event_id"], r["src"], r["dst"], r["d2"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("past", [1 << 16, 15])
def test_nearest_pairs_of_a_scan_are_ranked_once(spark, past, monkeypatch):
    """One block has seen all points of its event, so nothing is shuffled and ranked after it; only several tasks' pairs are. Rows of one id are one query."""
    monkeypatch.setattr(neighbours, "PAST", past)
    rng = random.Random(8)
    rows = [(e, i, [rng.randrange(-8, 9) / 4 for _ in range(3)]) for e, n in ((0, 60), (1, 25)) for i in range(n)]
    asked = [(e, i % 20, v) for e, i, v in rows]
    schema = "event_id long, hit_id long, v array<double>"
    found = neighbours.radius_join(spark.createDataFrame(asked, schema), spark.createDataFrame(rows, schema), 2.0, 4, loops=True)
    assert ("Window" in found._jdf.queryExecution().optimizedPlan().toString()) == (past == 15)
    near = {}
    for e, i, v in asked:
        near.setdefault((e, i), []).extend((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for f, j, w in rows if f == e)
    want = sorted((*key, j, d) for key, x in near.items() for d, j in sorted(p for p in x if p[0] <= 4.0)[:4])
    assert sorted((r["event_id"], r["src"], r["dst"], r["d2"]) for r in found.collect()) == want


def embedded(n, seed=0):
    """Points like embedded hits: near a surface of four dimensions in a space of eight, ten to a track."""
    rng = np.random.default_rng(seed)
    places, turn, bend = rng.random((n // 10, 4)), rng.normal(size=(4, 8)) * 1.5, rng.normal(size=(8, 8)) * 0.3
    return np.repeat(np.tanh(places @ turn) + np.sin(3 * places @ turn) @ bend, 10, axis=0) + rng.normal(scale=0.02, size=(n // 10 * 10, 8))


def test_radius_join_of_a_large_event(spark, tmp_path):
    n, r = 20_000, 0.12
    v = embedded(n)
    pq.write_table(pa.table({"event_id": np.zeros(n, np.int64), "hit_id": np.arange(n), "v": list(v)}), tmp_path / "hits.parquet")
    hits = spark.read.parquet(str(tmp_path / "hits.parquet"))
    routed, celled, _ = neighbours._celled_events(hits, hits, hits.groupBy("event_id").agg(F.count("*").alias("n")), r)
    pairs = routed.groupBy("cell").count().join(celled.groupBy("cell").agg(F.count("*").alias("m")), "cell").agg(F.sum(F.col("count") * F.col("m"))).first()[0]
    assert pairs < n**1.7
    got = neighbours.radius_join(hits, hits, r).select("src", "dst").toArrow()
    got = np.sort(got["src"].to_numpy() * n + got["dst"].to_numpy())
    want = [np.flatnonzero(((v - v[i]) ** 2).sum(axis=1) <= r * r) + i * n for i in range(n)]
    want = np.concatenate(want)
    assert (got == want[want // n != want % n]).all()
    k = 10  # two waves: hardly more rows than asked for come to the final window
    routed, celled, first = neighbours._celled_events(hits, hits, hits.groupBy("event_id").agg(F.count("*").alias("n")), r * 3, k)
    assert neighbours._met(routed, celled, k).count() + first.count() <= 2 * k * n
    got = neighbours.radius_join(hits, hits, r * 3, k, loops=True).select("src", "dst").toArrow()
    got = np.sort(got["src"].to_numpy() * n + got["dst"].to_numpy())
    want = []
    for i in range(n):
        d2 = np.add.accumulate((v - v[i]) ** 2, axis=1)[:, -1]
        near = np.flatnonzero(d2 <= r * r * 9)
        want.append(np.sort(near[np.lexsort((near, d2[near]))[:k]]) + i * n)
    assert (got == np.concatenate(want)).all()


@pytest.mark.parametrize("k_max", [None, 30])
def test_radius_join_of_directions_sends_no_row_for_each_cell(spark, tmp_path, monkeypatch, k_max):
    n, r = 5000, 1.2
    v = np.random.default_rng(3).normal(size=(n, 64))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    pq.write_table(pa.table({"event_id": np.zeros(n, np.int64), "hit_id": np.arange(n), "v": list(v)}), tmp_path / "hits.parquet")
    hits = spark.read.parquet(str(tmp_path / "hits.parquet"))
    monkeypatch.setattr(neighbours, "_routes", lambda *_: pytest.fail("a row for each query and cell"))
    monkeypatch.setattr(neighbours, "PAST", 2000)
    got = neighbours.radius_join(hits, hits, r, k_max, loops=True).select("src", "dst").toArrow()
    want = []
    for i in range(n):
        d2 = np.add.accumulate((v - v[i]) ** 2, axis=1)[:, -1]
        near = np.flatnonzero(d2 <= r * r)
        want.append(np.sort(near[np.lexsort((near, d2[near]))[:k_max]]) + i * n)
    assert (np.sort(got["src"].to_numpy() * n + got["dst"].to_numpy()) == np.concatenate(want)).all()


def test_routed_queries_hold_their_cells_in_a_list():
    v = [[float(i), 0.0] for i in range(50)]
    points = pa.table({"event_id": [0] * 50, "src": range(50), "v": v, "reach": [1e4] * 50, "cells": pa.array([[i % 7] for i in range(50)], pa.list_(pa.int64()))})
    pivots = pa.table({"event_id": [0] * 7, "cell": range(7), "p": v[:7], "far": [1e3] * 7})
    got = neighbours._routed(points, pivots)
    assert got["to"].to_pylist() == [[c for c in range(7) if c != i % 7] for i in range(50)]


def test_best_sums_of_events_in_a_task_equal_those_by_rounds(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(e, *rng.sample(range(n), 2), rng.randrange(1, 5) / 4) for e, n in ((0, 12), (1, 30), (2, 8)) for _ in range(n)]
    rows += [(3, i, j, 0.25) for i in range(6) for j in range(i + 1, 6)]
    df = spark.createDataFrame(rows, "event_id long, src long, dst long, score double")
    want = {tuple(r) for r in waves._sums_by_rounds(df).select("event_id", "node", "best", "to").collect()}
    some = {tuple(r) for r in waves.best_sums(df, 20).select("event_id", "node", "best", "to").collect()}
    monkeypatch.setattr(waves, "_sums_by_rounds", lambda *_: pytest.fail("rounds of joins"))
    got = waves.best_sums(df).select("event_id", "node", "best", "to").collect()
    assert {tuple(r) for r in got} == want == some and len(got) == len(want)


def test_decoding_deals_no_rows_anew(spark, capsys):
    df = spark.createDataFrame([(0, [1, 2, -1, 3, -1]), (1, [-1]), (2, [4, 5]), (3, []), (4, None), (5, [-1, 7, None, -1, 8])], "event_id long, labels array<long>")
    got = {(r["event_id"], r["ord"]): r["hits"] for r in tracks.decoded(df).collect()}
    assert got == {(0, 0): [1, 2], (0, 1): [3], (1, 0): [], (5, 0): [], (5, 1): [7]}
    tracks.decoded(df).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_layer_norm_works_its_mean_out_once(spark, capsys):
    df = spark.createDataFrame([([3.0, 4.0],), (None,), ([],)], "v array<double>")
    assert [r[0] for r in df.select(S.l2_normalised(F.col("v"))).collect()] == [[0.6, 0.8], None, []]
    got = [r[0] for r in df.select(S.layer_norm(F.col("v"))).collect()]
    assert got[0] == pytest.approx([-0.99998, 0.99998]) and got[1:] == [None, []]
    for f, most in ((S.layer_norm, 2), (S.l2_normalised, 1)):
        df.select(f(F.col("v")).alias("x")).explain()
        plan = capsys.readouterr().out
        assert plan.count("aggregate(") <= most
