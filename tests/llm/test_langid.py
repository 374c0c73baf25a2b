import random
import zlib
from collections import Counter

import pytest

from hitweave.llm import langid

PARTS = {"aa": "an er th in on re ed nd ha at", "bb": "ein sch ung lich keit über ver ge", "cc": "ción mente ado ñar los que para", "dd": "дом при ста ова нно"}


def grams(text):
    signs = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    out = Counter()
    for i in range(len(signs)):
        for m in (1, 2, 3):
            g = signs[i : i + m]
            if len(g) == m and (m == 1 and g != " " or m == 2 and g != "  " or m == 3 and g[1] != " "):
                out[g] += 1
    return out


def number(g):
    out = 0
    for c in g:
        out = out << 21 | ord(c)
    return out


def top(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))[:size]]


def corpus(n=260):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        words = ["".join(rng.choices(PARTS[lang].split(), k=rng.randrange(1, 4))) for _ in range(rng.randrange(8, 60))]
        rows.append((i, rng.choice([" ", ", ", "\n", " 12 "]).join(words).title(), None if rng.random() < 0.05 else lang, "y", 0.5))
    odd = [None, "", "123 !?", "  ", "a", "ΣΑΣ ΣΑΣ", "İI", "日本語", "²½Ⅷ", "ein " * 900]
    return rows + [(None if i == 4 else n + i, t, None, "y", 0.5) for i, t in enumerate(odd)] + [rows[0]]


@pytest.mark.parametrize("size", [400, 20])
def test_equals_brute_force(spark, size):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rank string, score double").repartition(3)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    learned = {}
    for i, text, lang, *_ in rows:
        if lang is not None and not held(i):
            learned.setdefault(lang, Counter()).update(grams(text))
    ranks = {k: {g: r for r, g in enumerate(top(v, size))} for k, v in learned.items()}
    profiles = langid.profiles(docs.where(~langid.held_out()), size=size)
    assert {(r["lang"], r["gram"], r["rank"], r["n"]) for r in profiles.collect()} == {(k, number(g), r, learned[k][g]) for k, v in ranks.items() for g, r in v.items()}
    want = []
    for i, text, *_ in rows:
        best = top(grams(text), size)
        if not best:
            want.append((i, "und", 0.0))
            continue
        far = {k: sum(abs(r - v[g]) if g in v else size for r, g in enumerate(best)) for k, v in ranks.items()}
        k = min(sorted(far), key=far.get)
        want.append((i, k, 1 - far[k] / (size * len(best))))
    got = langid.predict(docs, profiles, size=size).collect()
    plain = lambda xs: sorted((str(a), b, round(c, 9)) for a, b, c in xs)
    assert plain(map(tuple, got)) == plain(want)


def test_query(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rank string, score double")
    got = langid.op13_langid(docs).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    hits = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"] and truth[r["doc_id"]]]
    assert len(hits) > 30 and sum(hits) == len(hits)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert langid.op13_langid(docs.limit(0)).count() == 0
    nothing = langid.op13_langid(docs.where("lang IS NULL")).collect()
    assert nothing and all(r["lang_pred"] == "und" and r["score"] == 0 for r in nothing)


@pytest.mark.parametrize("stretch", [1, 2, 7])
def test_stretches_give_the_whole(monkeypatch, stretch):
    monkeypatch.setattr(langid, "STRETCH", stretch)
    for text in [None, "", "a", "ab, cd  ef1gh", "ΣΑΣ ΣΑΣ", "  x "]:
        keys, n = langid.Grams()(text)
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == {number(g): c for g, c in grams(text).items()}


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, rank string, score double")
    with pytest.raises(ValueError):
        langid.predict(docs, langid.profiles(docs))
