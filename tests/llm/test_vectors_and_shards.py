import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hitweave.llm import sharding, vafile


def vectors(n, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2 : n // 2 + n // 5] = x[n // 2]  # one very common vector
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    return rows + [(n, None), (n + 20, [None] * d), (n + 1, [float("nan")] * d), (n + 2, [float("inf")] * d), (None, [0.5] * d), (n + 3, [0.1]), (2 * n // 20 * 20 + 20, [0.0] * d)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")


def good(rows, zero):
    """(id, vector) of the rows that take part."""
    return [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and (zero or any(v))]


def brute(rows, k=20, once=False):
    """For each query id its k best rows of the same length; with `once` an id counts once, by its best row."""
    want = {}
    queries = {}
    for i, v in rows:
        if i % 20 == 0 and (i not in queries or v.tolist() < queries[i].tolist()):
            queries[i] = v
    for q, u in queries.items():
        scores = [(-(v * u).sum(), i) for i, v in rows if i != q and len(v) == len(u)]
        if once:
            best = {}
            for s, i in scores:
                best[i] = min(s, best.get(i, s))
            scores = [(s, i) for i, s in best.items()]
        want[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return want


def lists(found):
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def ragged():
    """Vectors of three lengths, ids with several vectors, equal rows."""
    rng = np.random.default_rng(5)
    rows = [(i, ((rng.normal(size=2) * 64).round() / 64).tolist()) for i in range(41)] + [(20, [1.0, 2.0, 3.0]), (41, [3.0, 2.0, 1.0]), (42, [1.0, 1.0, 1.0])]
    return rows + [(0, [0.5, -0.25]), (0, [0.25, 3.0]), (7, [2.0, 2.0]), (7, [2.0, 2.0]), (7, [-2.0, 1.0]), (60, [])]


def test_exact_top_k(spark):
    rows = vectors(700)
    want = {q: [(i, int(s)) for i, s in x] for q, x in brute([(i, np.floor(64 * v)) for i, v in good(rows, True)]).items()}
    assert lists(vafile.op6_topk(frame(spark, rows))) == {q: x for q, x in want.items() if x}
    prepared = vafile.valid_vectors(frame(spark, rows)).withColumn("v", F.transform("v", lambda x: F.floor(x * 64)))
    small = vafile.top_k(prepared, vafile.query_vectors(prepared), rows=100, query_rows=10)
    assert lists(small) == {q: x for q, x in want.items() if x}
    few = frame(spark, rows[:5])
    assert vafile.op6_topk(few).count() == 4
    assert vafile.op6_topk(few.limit(0)).count() == 0


def test_exact_top_k_of_ragged_rows_and_repeated_ids(spark):
    want = {q: [(i, int(s)) for i, s in x] for q, x in brute([(i, np.floor(64 * v)) for i, v in good(ragged(), True)]).items()}
    got = lists(vafile.op6_topk(frame(spark, ragged())))
    assert got == {q: x for q, x in want.items() if x} and {0, 20, 40} <= set(got)


@pytest.mark.parametrize("whole", [False, True])
def test_cells_bound_scores(whole):
    rng = np.random.default_rng(3)
    rows, queries = rng.normal(size=(500, 9)) * 50, rng.normal(size=(40, 9)) * 1e4
    rows[7], rows[8, 3], rows[:, 5] = 1e7, -1e9, 2.5
    if whole:
        rows, queries = np.floor(rows), np.floor(queries)
    for sample in (rows[:100], rows[20:400], rows[:0], rows[7:9]):
        grid = vafile.Grid(rows.min(axis=0), rows.max(axis=0), sample)
        middle, slack = vafile.bounds_of(queries, grid.numbers(rows), grid)
        assert (np.abs(queries @ rows.T - middle) <= slack).all()


def test_values_far_out_leave_the_others_apart(spark):
    rows = [r for r in vectors(1000, 32, seed=2) if r[0] is not None and r[0] < 1000]
    rows = [(i, v if not 500 <= i < 700 else (np.random.default_rng(i).normal(size=32) / 6).tolist()) for i, v in rows] + [(1001, [1000.0] * 32), (1002, [-1e6] + [0.0] * 31)]
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float32).astype(float))
    ids = np.array([i for i, _ in rows])
    grid = vafile.Grid(x.min(axis=0), x.max(axis=0), x[::2])
    asked = ids % 20 == 0
    left = vafile.scan(x[asked], ids[asked], grid.numbers(x), ids, grid, 20)
    assert len(left[0]) <= 0.05 * asked.sum() * len(x)
    want = {q: [(i, int(s)) for i, s in found] for q, found in brute(list(zip(ids.tolist(), x, strict=True))).items()}
    assert lists(vafile.op6_topk(frame(spark, rows))) == want


def test_shards(spark):
    texts = [None, "", "é"] + [f"text {i % 50}" for i in range(3000)]
    df = spark.createDataFrame([(i if i != 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, slot int")
    rows = sharding.op8_sharding(df).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in df.collect())
    for r in rows:
        data = ((texts[r["doc_id"]] if r["doc_id"] is not None else texts[7]) or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(slots) == 40
    assert 20 < sum(r["grown_shard"] == 40 for r in rows) < 150
    assert sharding.op8_sharding(df.limit(0)).count() == 0


def test_shards_and_slots_equal_brute_force(spark):
    """Every shard and slot computed anew from the law: highest draw, bucket by hash, Fisher-Yates of the sorted bucket."""
    rows = [(i % 700 if i % 50 else None, f"text {i % 90}" * (i % 7) or None) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = df.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(7)).alias("tie"), F.xxhash64("doc_id", F.lit(7)).alias("key"), *(F.xxhash64("doc_id", F.lit(s), F.lit(7)).alias(f"d{s}") for s in range(3))).collect()
    size = sum(len((r["text"] or "").encode()) + 16 for r in hashes)
    buckets = -(-size // (3 * 2000))
    groups = {}
    for r in hashes:
        shard = max(range(3), key=lambda s: (r[f"d{s}"], s))
        groups.setdefault((shard, r["tie"] % buckets), []).append((r["key"], r["tie"], r["doc_id"], r["text"]))
    want, place = [], [0, 0, 0]
    for (shard, bucket), group in sorted(groups.items()):
        group.sort(key=lambda g: g[:2])
        for j in np.random.default_rng([7, shard, bucket]).permutation(len(group)):
            want.append((shard, place[shard], bucket, *group[j][2:]))
            place[shard] += 1
    got = sharding.external_shuffle(df, shards=3, bucket_bytes=2000)
    assert sorted((r["shard"], r["slot"], r["bucket"], r["doc_id"], r["text"]) for r in got.collect()) == sorted(want)


def test_equal_rows_are_dealt_over_buckets(spark):
    df = spark.createDataFrame([(5, "same")] * 3000 + [(i, "other") for i in range(100)], "doc_id long, text string")
    rows = sharding.external_shuffle(df, shards=2, bucket_bytes=2000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in df.collect())
    groups = Counter((r["shard"], r["bucket"]) for r in rows)
    assert max(groups.values()) < 300 and len({s for s, _ in groups}) == 2
    for shard in (0, 1):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_shuffle_is_repeatable_mixes_and_keeps_columns(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", i % 3) for i in range(2000)], "doc_id long, text string, bucket int").withColumnRenamed("bucket", "ke.pt")
    one = sharding.external_shuffle(df, shards=2, bucket_bytes=4000)
    other = sharding.external_shuffle(df.repartition(3), shards=2, bucket_bytes=4000)
    key = lambda f: sorted((r["shard"], r["slot"], r["doc_id"], r["ke.pt"]) for r in f.collect())
    rows = key(one)
    assert rows == key(other)
    assert max(r["bucket"] for r in one.collect()) > 1
    order = [r[2] for r in rows if r[0] == 0]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.15
    sharding.write_shards(one, str(tmp_path / "shards"))
    assert key(sharding.read_shards(spark, str(tmp_path / "shards"), one.schema)) == rows
    for file in (tmp_path / "shards").rglob("*.parquet"):
        buckets = {}
        for r in pq.read_table(file, columns=["bucket", "slot"], partitioning=None).to_pylist():
            buckets.setdefault(r["bucket"], []).append(r["slot"])
        assert list(buckets) == sorted(buckets)
        assert all(slots == list(range(slots[0], slots[0] + len(slots))) for slots in buckets.values())
    assert len([f for f in (tmp_path / "shards").rglob("*") if f.is_dir()]) == 2
    listed = sharding.contents(sharding.read_shards(spark, str(tmp_path / "shards"), one.schema)).collect()
    assert Counter({s: n for s, n in Counter(r[0] for r in rows).items()}) == sum((Counter({r["shard"]: r["rows"]}) for r in listed), Counter())


def test_a_text_larger_than_a_bucket(spark):
    df = spark.createDataFrame([(i, "x" * (50_000 if i == 3 else 10)) for i in range(200)], "doc_id long, text string")
    rows = sharding.external_shuffle(df, shards=2, bucket_bytes=1000).collect()
    assert sorted((r["doc_id"], len(r["text"])) for r in rows) == sorted((r["doc_id"], len(r["text"])) for r in df.collect())
    for shard in (0, 1):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
