"""Components of dense groups: what is shuffled grows with nodes, not with edges."""

import random

import pytest

from hitweave.operators import components as C


def test_dense_groups_are_thinned_out_where_they_lie(spark, monkeypatch):
    rows = [(e, a, b) for e in range(3) for a in range(120) for b in range(a + 1, 120) if (a < 60) == (b < 60)]
    df = spark.createDataFrame(rows, "event_id long, src long, dst long").repartition(4)
    written = []
    monkeypatch.setattr(C, "stored", lambda x, keep=C.stored: written.append(keep(x)) or written[-1])
    got = {tuple(r) for r in C.connected_components(df, within=("event_id",)).collect()}
    assert got == {(e, n, 0 if n < 60 else 60) for e in range(3) for n in range(120)}
    assert len(rows) > 10_000 and written[0].count() <= 4 * 3 * 120


@pytest.mark.parametrize("together", [4, 1 << 20])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_thinning_keeps_components(spark, monkeypatch, together, kind):
    monkeypatch.setattr(C, "TOGETHER", together)
    rng = random.Random(8)
    rows = [(rng.choice([0, 1, None]), rng.choice(["x", "y"]), rng.randrange(30), rng.randrange(30)) for _ in range(60)] + [(2, "x", 5, 5), (2, None, 1, 2), (0, "x", None, 3)]
    df = spark.createDataFrame(rows, "e long, f string, src long, dst long").selectExpr("e", "f", f"cast(src AS {kind}) src", f"cast(dst AS {kind}) dst")
    thin = C._thinned(df.dropna(subset=["src", "dst"]).selectExpr("e", "f", "src a", "dst b"), ["e", "f"])
    as_rows = lambda f: sorted(map(tuple, f.collect()), key=repr)
    want = {}
    of = str if kind == "string" else int
    for e, f, a, b in rows:
        if a is not None and b is not None:
            own = want.setdefault((e, f), {})
            for n in (a, b):
                own.setdefault(of(n), {of(n)})
            if e is not None and f is not None and own[of(a)] is not own[of(b)]:
                both = own[of(a)] | own[of(b)]
                for n in both:
                    own[n] = both
    expected = sorted(((e, f, n, min(c)) for (e, f), own in want.items() for n, c in own.items()), key=repr)
    assert as_rows(C.connected_components(df, within=("e", "f"))) == expected
    assert as_rows(C.connected_components(thin, "a", "b", within=("e", "f"))) == expected
