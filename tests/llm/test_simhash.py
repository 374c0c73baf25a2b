import random
import re

import numpy as np
import xxhash

from hitweave.llm import simhash
from hitweave.operators.components import connected_components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (f"{fps[i]:016x}", root(i)) for i in ids}


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdeÉÀz") for _ in range(rng.randrange(1, 6)))
    docs = [None, "", "  \n", "One two", "one  TWO", "a b c d", "A\tb\x0bc d", "x\x1cy z w q r"]
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(30, 300))]
        docs.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    return docs + docs[8:12]


def test_classes_equal_brute_force(spark):
    rows = list(enumerate(corpus(random.Random(3))))
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op3_simhash(df).collect()}
    assert got == brute_components(rows)


def test_hot_keys_lose_no_links(spark):
    rng = np.random.default_rng(1)
    start = rng.integers(0, 1 << 63, dtype=np.uint64)
    flips = [int(start) ^ sum(1 << int(b) for b in rng.choice(20, k, replace=False)) for k in rng.integers(0, 7, 400)]
    flips = sorted({x - (1 << 64) if x >= 1 << 63 else x for x in flips})
    df = spark.createDataFrame([(x,) for x in flips], "fp long")
    def classes(hot):
        rows = connected_components(simhash.near_links(df, hot=hot), "a", "b").collect()
        return {(r["node"], r["component"]) for r in rows}

    near = {(a, b) for a in flips for b in flips if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    label = {x: x for x in flips}
    for _ in range(20):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    want = {(x, label[x]) for x in flips if any(x in p for p in near)}
    assert classes(4096) == want
    assert classes(16) == want


def test_bit_sliced_counts():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64) & rng.integers(0, 1 << 63, 1000, dtype=np.uint64) & rng.integers(0, 1 << 63, 1000, dtype=np.uint64) & rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for radius in range(8):
        assert (simhash.near_pairs(x, radius) == (np.bitwise_count(x) <= radius)).all()
    q, lane = simhash.near_lanes(x[:50], simhash.planes_of(x), 1000, 4)
    want = np.argwhere(np.bitwise_count(x[:50, None] ^ x[None]) <= 4)
    assert (np.c_[q, lane] == want).all() or {*map(tuple, np.c_[q, lane].tolist())} == {*map(tuple, want.tolist())}


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e", 1), (None, None, 2), (7, "a b c d e", 3), (7, "a b c d e", 3)], "doc_id long, text string, fp int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.op3_simhash(df).collect()), key=str)
    assert got == sorted([(None, 7), (None, None), (7, 7), (7, 7)], key=str)
    assert simhash.op3_simhash(df.limit(0)).count() == 0


def test_keep_first_drops_rows_not_ids(spark):
    a, b, c = "one two three four five six", "quite another text of seven words here", "a third one that nothing else is like"
    rows = [(1, a, 1.0), (5, a, 2.0), (5, b, 3.0), (None, b, 4.0), (None, c, 5.0), (None, c, 5.0), (7, None, 6.0), (3, "", 7.0), (8, a, 8.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `x.y` double")
    got = sorted(((r[0], r[1]) for r in simhash.keep_first(df).collect()), key=str)
    assert got == sorted([(1, a), (5, b), (None, c), (3, "")], key=str)
    assert simhash.keep_first(df).columns == df.columns
    assert simhash.keep_first(df.limit(0)).count() == 0


def test_keep_first_equals_brute_force(spark):
    rng = random.Random(12)
    texts = [t for t in corpus(rng) if t]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts)) for _ in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    named = dict(enumerate(sorted({t for _, t in rows})))
    label = {named[i]: c for i, (_, c) in brute_components(list(named.items())).items()}
    least = {}
    for key, text in rows:
        order = (key is None, key or 0)
        least[label[text]] = min(least.get(label[text], order), order)
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_first(df).collect()]
    assert len(got) == len({label[t] for _, t in got}) == len(least)
    assert {label[t]: (k is None, k or 0) for k, t in got} == least
    assert set(got) <= set(rows)


def test_chain_of_rising_fingerprints(spark):
    """Fingerprints that differ in four bits from the next one only: one class, however long the chain."""
    values, x = [], 0
    for i in range(1500):
        x ^= 15 << (4 * (i % 16)) if i % 17 else 0x0101010100000000
        values.append(x)
    values = sorted({v - (1 << 64) if v >= 1 << 63 else v for v in values})
    found = connected_components(simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long")), "a", "b").collect()
    parent = {v: v for v in values}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 4:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    assert {(r["node"], r["component"]) for r in found} == {(v, root(v)) for v in values if sum(root(w) == root(v) for w in values) > 1}


def test_fingerprint_of_a_very_long_text():
    rng = random.Random(8)
    text = " ".join(rng.choice(["Ab", "cd", "é", "f1", "g"]) + str(rng.randrange(50)) for _ in range(70_000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)
