import numpy as np
from test_vectors_and_shards import brute, frame, good, lists, ragged, vectors

from hitweave.llm import hilbert_ann


def test_curve_visits_neighbouring_cells():
    for p, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * p, indexing="ij"), -1).reshape(-1, p)
        index = hilbert_ann.hilbert_index(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_scores_are_exact_and_ties_go_to_smaller_ids(spark):
    rows = vectors(700)
    got, want = lists(hilbert_ann.op9_ann(frame(spark, rows))), brute(good(rows, False), once=True)
    assert set(got) == set(want)
    x = dict(good(rows, False))
    for q, found in got.items():
        assert len(found) == 20 and len({i for i, _ in found}) == 20 and q not in {i for i, _ in found}
        assert all(abs(s - x[i] @ x[q]) < 1e-12 for i, s in found)
        assert [(i, s) for i, s in found] == sorted(found, key=lambda p: (-p[1], p[0]))
    assert np.mean([np.mean([s >= want[q][-1][1] - 1e-12 for _, s in got[q]]) for q in want]) >= 0.9
    assert hilbert_ann.op9_ann(frame(spark, rows).limit(0)).count() == 0


def test_ragged_rows_and_repeated_ids(spark):
    """So few rows are one range each curve, so all are found."""
    want = brute(good(ragged(), False), once=True)
    got = lists(hilbert_ann.op9_ann(frame(spark, ragged())))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items() if x}


def test_small_chunks_change_nothing(spark, monkeypatch):
    rows = vectors(700)
    whole = lists(hilbert_ann.op9_ann(frame(spark, rows)))
    monkeypatch.setattr(hilbert_ann, "ROWS", 50)
    monkeypatch.setattr(hilbert_ann, "QUERIES", 3)
    assert lists(hilbert_ann.op9_ann(frame(spark, rows))) == whole


def test_recall(spark):
    rows = vectors(3200, 64, 3)
    got, want = lists(hilbert_ann.op9_ann(frame(spark, rows))), brute(good(rows, False), once=True)
    assert all(len(v) == 20 for v in got.values()) and set(got) == set(want)
    recall = np.mean([np.mean([s >= want[q][-1][1] - 1e-12 for _, s in got[q]]) for q in want])
    assert recall >= 0.9, recall
