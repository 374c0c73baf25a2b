import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from hitweave.llm import phrases

SCHEMA = "doc_id long, text string, lang string, left string, a int"


def corpus(n=120):
    rng = random.Random(3)
    vocabulary = ["The", "of", "AND", "in", "to", "größe", "état", *(f"w{i}" for i in range(40))]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " ;"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", None, "de"]), "x", 1))
    passage = "one two three four five six seven. one one one one one one"
    rows += [(n + i, passage, "en", "x", 1) for i in range(7)]
    return rows + [(None, None, "en", "x", 1), (5, "", None, "x", 1), (6, " \t\n", "fr", "x", 1), (7, "lonely", "fr", "x", 1)]


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        folded = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for m in range(1, 6):
                    if i + m <= len(words):
                        f[lang or "und", tuple(words[i : i + m])] += 1
    found = {}
    for (lang, words), a in f.items():
        m = len(words)
        if m < 2 or a < least:
            continue
        if any(g >= a and k == lang and len(w) > m and any(w[i : i + m] == words for i in range(len(w))) for (k, w), g in f.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, m))
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, best in found.items() for i, (s, a, p, left, right) in enumerate(sorted(best)[:top]))


@pytest.mark.parametrize("least,top,hot", [(4, 1000, 10_000), (3, 25, 12), (6, 1000, 0), (3, 1000, 30)])
def test_equals_brute_force(spark, least, top, hot):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = phrases.collocations(docs, least=least, top=top, hot=hot).collect()
    want = brute(rows, least, top)
    assert len(want) > 20
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("hot", [0, 12])
def test_rare_pivots_far_into_a_long_text(spark, hot):
    rows = [(0, " ".join(text or "" for _, text, lang, *_ in corpus(200) if lang == "en"), "en", "x", 1)]
    assert len(rows[0][1].split()) > 1000
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=4, top=1000, hot=hot).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 1000)


def test_frequent_pivots_in_several_buckets(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(phrases, "OF_PIVOT", 7)  # read on the driver
    monkeypatch.setattr(phrases, "OF_BUCKET", 50)
    got = phrases.collocations(docs, least=4, top=1000).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 1000)


def test_equals_sql_and_odd_tables(spark):
    rows = corpus() * 30
    docs = spark.createDataFrame(rows, SCHEMA)
    got = phrases.op12_phrases(docs)
    con = duckdb.connect()
    documents = docs.toArrow()  # noqa: F841
    want = con.execute(phrases.OP12_SQL)
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert phrases.op12_phrases(docs.limit(0)).count() == 0
    assert phrases.op12_phrases(docs.where("text IS NULL")).count() == 0


def test_large_products_stay_exact(spark):
    whole = lambda *xs: " * ".join(f"CAST({x} AS DECIMAL(38, 0))" for x in xs)
    a, n, left, right = 10**12, 2 * 10**13 + 7, 10**12 + 1, 10**12 + 3
    got = spark.sql(f"SELECT CAST(({whole(1000, a, n)}) div ({whole(left, right)}) AS LONG)").first()[0]
    assert got == 1000 * a * n // (left * right)


def test_fragments_come_back():
    ids = np.random.default_rng(0).integers(-1, 90_000, 500).astype(np.int32)
    left, right = phrases.reach(ids)
    at = np.flatnonzero(left + right > 0)
    flat = np.concatenate([ids[i - left[i] : i + right[i] + 1] for i in at])
    around = phrases._unpacked(phrases._packed(flat, left[at], right[at]))
    for row, i in zip(around, at, strict=True):
        assert row[4] == ids[i] and row[4 - left[i] : 5 + right[i]].tolist() == ids[i - left[i] : i + right[i] + 1].tolist()
        assert (row >= 0).sum() == left[i] + right[i] + 1
