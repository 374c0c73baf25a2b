import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave.llm import quality, toxicity

SYLLABLES = "an er th in on re ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def corpus(n=700):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 120))]
        toxic, good = rng.random() < 0.2, rng.random() < 0.8
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = "grobl" + rng.choice(SYLLABLES)
        if not good:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + rng.choice(["###", "$$$"]) for w in words] if kind == 1 else [words[0]] * len(words)
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), "s"))
        labels.append((i, int(good), int(toxic)))
    rows += [(n, None, "en", "s"), (n + 1, "", None, "s"), (None, "an er", "en", "s"), (0, rows[0][1], "en", "s")]
    labels += [(n + 5, None, None), (None, 1, 1)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("which", ["toxic", "quality"])
def test_held_out_accuracy(spark, tables, which):
    op = toxicity.op4_toxicity if which == "toxic" else quality.op5_quality
    docs, labels = tables
    got = op(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    truth = {r["doc_id"]: r[which] for r in labels.collect()}
    hits = []
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= (0.5 if which == "toxic" else 0.3))
        if r["held_out"] and truth.get(r["doc_id"]) is not None:
            hits.append(r["predicted"] == truth[r["doc_id"]])
    assert len(hits) > 80 and np.mean(hits) > 0.93
    assert op(docs.limit(0), labels).count() == 0
    assert op(docs.limit(3), labels.limit(0)).count() == 3


def test_long_texts_score_like_their_parts():
    rng = np.random.default_rng(0)
    model = toxicity.train(["a b c", "d e f"] * 20, np.array([0.0, 1.0] * 20), epochs=2)
    text = " ".join(rng.choice(["a", "b", "c", "d", "e"], 3000))
    whole = toxicity.Scorer(model).scores([text, None, ""])
    old = toxicity.STRETCH
    try:
        toxicity.STRETCH = 100
        assert np.allclose(toxicity.Scorer(model).scores([text, None, ""]), whole)
        old_words, toxicity.MAX_WORDS = toxicity.MAX_WORDS, 3
        assert np.allclose(toxicity.Scorer(model).scores([text, None, ""]), whole)
        toxicity.MAX_WORDS = old_words
    finally:
        toxicity.STRETCH = old
    assert whole[1] == whole[2]


def test_context_sums_equal_brute_force():
    rng, index = np.random.default_rng(0), quality.index_vectors()
    ids = rng.integers(0, 50, 1000).astype(np.uint16)
    want = np.zeros((quality.BUCKETS, quality.SIZE))
    for t in range(1000):
        for o in (-2, -1, 1, 2):
            if 0 <= t + o < 1000:
                want[ids[t]] += index[ids[t + o]]
    for stretch in (10_000, 77):
        quality.STRETCH, old = stretch, quality.STRETCH
        got = np.zeros_like(want)
        quality._add_contexts(got, index, ids)
        quality.STRETCH = old
        assert np.allclose(got, want)


def test_contexts_do_not_cross_texts(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 40, n)) for n in rng.integers(1, 7, 200)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string")
    tokens, index = quality.Tokens(), quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.SIZE))
    for ids in map(tokens, texts):
        for t in range(len(ids)):
            for o in (-2, -1, 1, 2):
                if 0 <= t + o < len(ids):
                    want[ids[t]] += index[ids[t + o]]
    want = (want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    assert (quality.context_vectors(df.coalesce(1)) == want).all()
    assert (quality.context_vectors(df.orderBy("text").repartition(7)) == want).all()


def test_toxicity_looks_a_beginning_up_once_and_scores_short_texts_together(monkeypatch):
    model = toxicity.train(["a b c", "d e f"] * 20, np.array([0.0, 1.0] * 20), epochs=2)
    texts = [f"grobe{i} a_grobe{i} b {'erin ' * (i % 7)}" if i % 10 else None for i in range(500)]
    alone = np.concatenate([toxicity.Scorer(model).scores([t]) for t in texts])
    hashed, crc32 = [], zlib.crc32
    monkeypatch.setattr(toxicity.zlib, "crc32", lambda key: hashed.append(key) or crc32(key))
    assert np.allclose(toxicity.Scorer(model).scores(texts), alone)
    assert len(hashed) < 500  # three for each of 453 different words before
    assert np.allclose(toxicity.Scorer(model).scores(texts[::-1]), alone[::-1])


def test_toxicity_scores_equal_a_naive_forward_pass():
    """Sums of hashed vectors, every filter at every place with zero padding, maximum, logistic layer: written out."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [None, "", "one", "One, two; ÉTÉ_x"]
    model = toxicity.train(texts, np.arange(len(texts)) % 2 * 1.0, epochs=1)
    pad = max(toxicity.WIDTHS) - 1

    def naive(text):
        words = toxicity.re.findall(r"[^\W_]+", (text or "").lower())
        vectors = [sum(model["table"][zlib.crc32(k.encode()) % toxicity.BUCKETS + i * toxicity.BUCKETS].astype(float) for i, k in enumerate([w, f"4:{w[:4]}", f"5:{w[:5]}"])) for w in words]
        vectors += [np.zeros(toxicity.SIZE)] * (pad if words else pad + 1)
        total = float(model["base"][0])
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                places = [model["bias"][k, f] + sum(vectors[at + j] @ model[f"filter{width}"][j][:, f] for j in range(width)) for at in range(len(vectors) - width + 1)]
                total += model["out"][k * toxicity.FILTERS + f] * max(0.0, max(places))
        return 1 / (1 + np.exp(-total))

    assert np.allclose(toxicity.Scorer(model).scores(texts), [naive(t) for t in texts], atol=1e-4)


def test_quality_scores_equal_a_naive_forward_pass():
    rng = np.random.default_rng(6)
    both = np.hstack([quality.index_vectors(), rng.normal(size=(quality.BUCKETS, quality.SIZE)).astype(np.float32)])
    texts = [" ".join(rng.choice(["an", "er", "THE", "!!", "x1", "été"], n)) for n in rng.integers(0, 40, 120)]
    n = quality.SIZE

    def pooled(text):
        words = quality.re.findall(r"[^\W_]+|[^\w\s]+|_+", text)
        ids = [zlib.crc32((w if len(w) > 1 and w.isupper() else w.lower()).encode()) % quality.BUCKETS for w in words]
        if not ids:
            return [0.0] * (2 * n + 4)
        mean = [sum(float(both[i][j]) for i in ids) / len(ids) for j in range(2 * n)]
        same = sum(a == b for a, b in zip(ids, ids[1:])) / (len(ids) - 1) if len(ids) > 1 else 0.0
        return [*mean, sum(m * m for m in mean[:n]) / quality.ONES, same, sum(m * m for m in mean[n:]), np.log1p(len(ids)) / 10]

    x = np.array([quality.features(quality.Tokens()(t), both) for t in texts])
    assert np.allclose(x, [pooled(t) for t in texts], atol=1e-6)
    y = rng.integers(0, 2, len(x)).astype(float)
    model = quality.train(x, y, 0.8, epochs=3)

    def naive(row):
        z = [(v - m) / s for v, m, s in zip(row, model["mean"], model["spread"], strict=True)]
        hidden = [max(0.0, sum(z[i] * model["w1"][i][j] for i in range(len(z))) + model["b1"][j]) for j in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, model["w2"], strict=True)) + model["b2"][0]
        return 1 / (1 + np.exp(-(logit + model["offset"]) / model["temperature"]))

    assert np.allclose(quality.probabilities(model, x), [naive(r) for r in x])
    # the temperature is the one on the grid with the least weighted loss on the rows kept back, a fifth
    kept = np.arange(len(x)) % 5 == 0
    rate, losses = y[~kept].mean(), []
    for t in np.geomspace(1, 8, 60):
        p = 1 / (1 + np.exp(-(quality.logits(model, x[kept]) + model["offset"]) / t))
        w = np.where(y[kept] == 1, 0.8 / rate, 0.2 / (1 - rate))
        losses.append((-w * np.log(np.where(y[kept] == 1, p, 1 - p))).sum())
    assert np.isclose(model["temperature"], np.geomspace(1, 8, 60)[int(np.argmin(losses))])


@pytest.mark.parametrize("which", ["toxic", "quality"])
def test_odd_columns(spark, tables, which):
    """Names with dots, no language, ids of text, ids with several texts, labels of one class or none."""
    docs, labels = tables
    if which == "toxic":
        model, _ = toxicity.fit(docs, labels)
        score = lambda df: toxicity.score(df, model, "s.core")
    else:
        both, model = quality.fit(docs, labels)
        score = lambda df: quality.score(df, both, model, "s.core")
    odd = docs.limit(20).withColumnRenamed("lang", "la.ng").withColumnRenamed("score", "__hw_x")
    got = score(odd)
    assert got.columns == ["doc_id", "text", "la.ng", "__hw_x", "s.core"] and got.count() == 20
    op = toxicity.op4_toxicity if which == "toxic" else quality.op5_quality
    again = docs.select("doc_id", "text").limit(50)
    one_class = labels.where("doc_id < 100").withColumn("toxic", labels.toxic * 0).withColumn("quality", labels.quality * 0)
    rows = op(again.union(again.limit(5)), one_class).collect()
    assert len(rows) == 55
    if which == "toxic":
        assert len({r["score"] for r in rows}) == 1 and len({r["score"] for r in op(again, labels.limit(0)).collect()}) == 1
    text_ids = again.selectExpr("concat('d', doc_id) doc_id", "text")
    assert op(text_ids, labels.selectExpr("concat('d', doc_id) doc_id", "quality", "toxic")).count() == 50


def test_thresholds_weigh_rows_by_the_true_share():
    rng = np.random.default_rng(0)
    labels = np.array([0.0, 1.0] * 300)
    scores = np.clip(rng.normal(0.2 + 0.25 * labels, 0.12), 0, 1)
    langs = ["en", "en", "de", "de"] * 150 + []
    for share in (0.5, 0.1, 0.01):
        got = toxicity.thresholds_by_language(scores, labels, langs, share)
        for lang in ("en", "de"):
            mine = np.array([x == lang for x in langs])
            s, y = scores[mine], labels[mine]
            w = np.where(y == 1, 2 * share, 2 * (1 - share))
            f1 = lambda t: 2 * w[(s >= t) & (y == 1)].sum() / (w[s >= t].sum() + w[y == 1].sum())  # noqa: B023, E731
            assert f1(got[lang]) >= max(f1(t) for t in np.linspace(0.05, 0.95, 19)) - 1e-9
    low, high = (toxicity.thresholds_by_language(scores, labels, langs, share) for share in (0.5, 0.01))
    assert all(high[k] > low[k] for k in low)
    assert toxicity.thresholds_by_language(scores[::2], labels[::2], langs[::2], 0.1) == {"en": 0.5, "de": 0.5}


def test_flagged_follows_thresholds(spark, tables):
    docs, labels = tables
    model, limits = toxicity.fit(docs, labels)
    got = toxicity.op4_toxicity(docs, labels).join(docs.select("doc_id", "lang").distinct(), "doc_id").collect()
    assert got and all(r["flagged"] == int(r["score"] >= limits.get(r["lang"], 0.5)) for r in got)


def test_long_labelled_texts_are_learnt_in_windows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_SIGNS", 40)
    rows = [(i, ("grob " if i % 2 else "fein ") * 30 + str(i)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = toxicity.op4_toxicity(docs, labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got) and len({round(r["score"], 3) for r in got}) > 1


def test_quality_without_labels_keeps_all(spark, tables):
    docs, labels = tables
    for none in (labels.limit(0), labels.withColumn("quality", F.lit(None).cast("int"))):
        assert all(r["predicted"] == 1 for r in quality.op5_quality(docs, none).collect())
    assert all(r["predicted"] == 0 for r in quality.op5_quality(docs, labels.withColumn("quality", F.lit(0))).collect())


def test_all_labelled_rows_are_learnt_from(spark, monkeypatch):
    """Each word that marks a toxic text is in one text of 4,000; one group of rows does not show them all."""
    monkeypatch.setattr(toxicity, "GROUP", 700)
    rng = random.Random(2)
    plain = [rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(12)) + (f" grob{i}" if i % 2 else "")) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, toxic int")
    learnt = {r["doc_id"] for r in toxicity.labelled_rows(docs, labels).collect()}
    assert learnt == {i for i in range(4000) if zlib.crc32(str(i).encode()) % 5}
    training = toxicity.labelled_rows(docs, labels)
    assert toxicity._counted(training)[1].max() == training.where("label = 1").count()  # all of them have the beginning grob
    model, limits = toxicity.fit(docs, labels)
    again, same = toxicity.fit(docs.repartition(3), labels.repartition(2))
    assert limits == same and all((model[k] == again[k]).all() for k in model)
    assert (toxicity.Scorer(model).scores(["grob", "grob7 erin", "erin"]) >= 0.5).tolist() == [True, True, False]
