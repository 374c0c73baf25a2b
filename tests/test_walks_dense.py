"""Walks on arrays: the tracks of the walks on lists, for components of many edges as well."""

import random
import time

import numpy as np
import pytest

from hitweave.operators import dense, tracks, walks
from tests.test_graphs import by_target

SCHEMA = "event_id long, src long, dst long, score double"


def columns(edges):
    return [np.array(c, t) for c, t in zip(zip(*edges, strict=True), (np.int64, np.int64, float), strict=True)]


def test_arrays_give_the_tracks_of_lists():
    rng = random.Random(1)
    for k in range(600):
        n, share, scores = rng.randrange(3, 16), rng.choice([0.2, 0.4, 0.8]), rng.choice([[0.5], [0.25, 0.5, 0.75], [i / 64 for i in range(1, 64)], [-0.25, 0.25, 0.5, 0.0]])
        ids = rng.sample(range(100), n)
        edges = [(ids[a], ids[b], rng.choice(scores)) for a in range(n) for b in range(n) if (a < b and rng.random() < share) or (k % 3 == 0 and a > b and rng.random() < 0.03)]
        edges = sorted(edges + [(s, d, rng.choice(scores)) for s, d, _ in edges if rng.random() < 0.1], key=lambda e: (e[1], e[0], e[2])) or [(1, 2, 0.5)]
        for choice in ("longest", "level", "lookback"):
            for reuse in (False, True):
                assert dense.greedy_walk(*columns(edges), choice, reuse) == walks.greedy_walk(edges, choice, reuse)
        assert dense.dp_walk(*columns(edges)) == walks.dp_walk(edges)
        assert dense.road_walk(*columns(edges), 0.1, 0.6) == walks.road_walk(edges, 0.1, 0.6)


@pytest.mark.parametrize("choice", ["longest", "level", "lookback", "dp", "road"])
def test_a_component_beyond_a_million_edges(choice):
    n, rng = 1600, np.random.default_rng(2)
    a, b = np.triu_indices(n, 1)
    score = rng.random(len(a))
    assert len(a) > 1_200_000
    own = choice if choice in ("road", "dp") else "greedy"
    order = np.lexsort((a, b))
    args = [x[order] for x in (a, b, score)]
    began = time.time()
    found = getattr(dense, f"{own}_walk")(*args, *((0.1, 0.6) if own == "road" else (choice,) if own == "greedy" else ()))
    assert time.time() - began < 60
    nodes = [x for t in found for x in (t[0] if own == "dp" else t)]
    assert len(nodes) == len(set(nodes)) and len(nodes) > n // 2
    assert len(found[0][0] if own == "dp" else found[0]) > 20


def test_large_components_are_walked_in_a_task(spark):
    rng = random.Random(3)
    rows = [(0, a, b, rng.choice([0.25, 0.5, 0.75])) for a in range(160) for b in range(a + 1, 160)] + [(1, 1, 2, 0.5), (1, 2, 3, 0.5)]
    assert len(rows) > walks.DENSE
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    labels = tracks.components(df)
    got = walks.walk_components(df, labels, "lookback").collect()
    for event in (0, 1):
        want = walks.greedy_walk(by_target([x[1:] for x in rows if x[0] == event]), "lookback")
        assert [list(r["hits"]) for r in sorted((r for r in got if r["event_id"] == event), key=lambda r: r["ord"])] == want
