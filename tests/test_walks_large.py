"""Walks of large and chain-like components: bounded memory, logarithmic rounds, the same tracks."""

import random
import time
import tracemalloc

import pytest

from hitweave.operators import chains, tracks, walks
from hitweave.session import stored
from tests.test_graphs import by_target

SCHEMA = "event_id long, src long, dst long, score double"
KINDS = ["longest", "reuse", "level", "lookback", "dp"]


def subdivided(rng, nodes, share, scores, first=0, lengths=(0, 0, 1, 2, 5)):
    """A random graph with chains in place of some of its edges."""
    edges, new = [], first + 1000
    for a in range(nodes):
        for b in range(a + 1, nodes):
            if rng.random() < share:
                path = [first + a, *(new + rng.randrange(10_000) * 100 + i for i in range(rng.choice(lengths))), first + b]
                edges += [(x, y, rng.choice(scores)) for x, y in zip(path, path[1:])]
    return by_target(set(edges))


def contracted_by_hand(edges):
    out, into = {}, {}
    for s, d, w in edges:
        out.setdefault(s, {})[d] = w
        into.setdefault(d, []).append(s)
    link = {s: d for s, t in out.items() for d in t if len(t) == 1 and len(into[d]) == 1}
    heads = [n for n in {*out, *into} if n not in link.values()]
    inside, of = {}, {}
    for h in heads:
        path = [h]
        while path[-1] in link:
            path.append(link[path[-1]])
        inside[h] = path
        of.update(dict.fromkeys(path, h))
    rest = [(of[s], d, w) for s, d, w in edges if link.get(s) != d and s in of]
    told = {h: walks.Chain(len(p), p[1] if len(p) > 1 else None, sum(out[a][b] for a, b in zip(p, p[1:]))) for h, p in inside.items()}
    return by_target(rest), told, inside


@pytest.mark.parametrize("kind", KINDS)
def test_chains_give_the_same_tracks(kind):
    rng = random.Random(11)
    for _ in range(150):
        edges = subdivided(rng, rng.randrange(3, 9), 0.45, [0.25, 0.5, 0.75, 1.0, 0.125])
        rest, told, inside = contracted_by_hand(edges)
        order = walks.topological(walks.adjacency(edges))
        assert walks.topological_chains(walks.adjacency(rest), told) == [n for n in order if n in inside]
        if kind == "dp":
            want, got = walks.dp_walk(edges), walks.dp_walk(rest, told)
            got = [([m for h in p for m in inside[h]], s) for p, s in got]
        else:
            choice, reuse = ("longest", True) if kind == "reuse" else (kind, False)
            want = walks.greedy_walk(edges, choice, reuse)
            got = [[m for h in p for m in inside[h]] for p in walks.greedy_walk(rest, choice, reuse, told)]
        assert got == want


@pytest.mark.parametrize("kind", KINDS)
def test_contracted_components_in_a_task(spark, kind, monkeypatch):
    rng = random.Random(5)
    rows = [(e, *x) for e in (0, 1) for k in range(3) for x in subdivided(rng, 8, 0.35, [0.25, 0.5, 0.75, 1.0], k * 100, (0, 3, 8))]
    rows += [(0, 70_001, 70_002, 0.5), (0, 70_002, 70_003, 0.5), (0, 70_003, 70_001, 0.5), (1, 80_001, 80_002, 0.5), (1, 80_001, 80_002, 0.75), (1, 80_002, 80_003, 0.5), (1, 80_003, 80_004, 0.5)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = tracks.components(df)
    choice, reuse = ("longest", True) if kind == "reuse" else (kind, False)
    key = lambda f: sorted((r["event_id"], r["component"], r["ord"], tuple(r["hits"]), r["score"]) for r in f.collect())
    want = key(walks.walk_components(df, labels, choice, allow_node_reuse=reuse))
    monkeypatch.setattr(walks.waves, "walk", None)  # not needed: contracted, all are within the bound
    event = [by_target({x[1:] for x in rows if x[0] == e}) for e in (0, 1)]
    bound = max(len(contracted_by_hand([x for x in edges if x[0] // 10_000 < 7])[0]) for edges in event)
    assert any(r[1] > bound for r in df.distinct().join(labels.withColumnRenamed("node", "src"), ["event_id", "src"]).groupBy("event_id", "component").count().select("event_id", "count").collect())
    got = key(walks.walk_components(df, labels, choice, allow_node_reuse=reuse, bound=bound))
    assert got == want and len(got) > 6


def test_long_paths_in_logarithmic_rounds(spark, monkeypatch):
    n = 5000
    rows = [(0, i, i + 1, 0.5) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    rounds = []
    monkeypatch.setattr(chains, "stored", lambda x: rounds.append(1) or stored(x))
    labels = spark.createDataFrame([(0, i, 0) for i in range(n + 1)], "event_id long, node long, component long")
    began = time.time()
    got = walks.walk_components(df, labels, "lookback", bound=2).collect()
    assert [list(r["hits"]) for r in got] == [list(range(n + 1))]
    assert len(rounds) <= 2 * n.bit_length() + 10 and time.time() - began < 120


@pytest.mark.parametrize("scores", ["random", "equal", "two"])
def test_lookback_on_a_band(scores):
    rng = random.Random(3)
    draw = {"random": rng.random, "equal": lambda: 0.5, "two": lambda: rng.choice([0.2, 0.8])}[scores]
    edges = by_target([(i, i + k, draw()) for i in range(4000) for k in range(1, 6) if i + k <= 4000])
    assert len(edges) > 19_900
    tracemalloc.start()
    began = time.time()
    found = walks.greedy_walk(edges, "lookback")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.time() - began < 60 and peak < 500e6
    assert len(found[0]) in (4000, 4001)


def test_many_tracks_of_a_large_component():
    rng = random.Random(4)
    edges = by_target({(a, b): (a, b, rng.randrange(1, 256) / 256) for a, b in ((lay * 10_000 + rng.randrange(10_000), (lay + 1) * 10_000 + rng.randrange(10_000)) for lay in range(10) for _ in range(10_000))}.values())
    assert len(edges) > 99_000
    began = time.time()
    found = walks.dp_walk(edges)
    assert time.time() - began < 60
    nodes = [n for path, _ in found for n in path]
    assert len(nodes) == len(set(nodes)) and len(found) > 8_000
    assert all(a[1] >= b[1] for a, b in zip(found, found[1:]))
    began = time.time()
    assert len(walks.greedy_walk(edges, "lookback")) > 8_000 and time.time() - began < 60
    assert len(walks.greedy_walk(edges, "longest", True)) > 8_000 and time.time() - began < 90


def test_dp_equals_scoring_all_anew():
    rng = random.Random(7)
    for _ in range(100):
        edges = by_target([(a, b, rng.randrange(-3, 9) / 8) for a in range(12) for b in range(12) if (a < b and rng.random() < 0.3) or (a > b and rng.random() < 0.02)])
        want, left = [], edges
        while left:
            best, inner = walks.best_scores(left), {d for _, d, _ in left}
            sources = [(best[n][0], -n) for n in best if n not in inner and best[n][0] > 0]
            if not sources:
                break
            score, at = max(sources)
            path, node = [], -at
            while node is not None:
                path.append(node)
                node = best[node][1]
            want.append((path, score))
            left = [e for e in left if e[0] not in path and e[1] not in path]
        assert walks.dp_walk(edges) == want
