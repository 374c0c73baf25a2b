import random

import corpus_pipeline
from test_classifiers import corpus
from test_simhash import brute_components

from hitweave.llm import packing, quality, secret_scan, stages, toxicity

from hitweave.session import cut, table


def test_stages_take_effect(spark, tmp_path):
    rows, labels = corpus(400)
    long = " ".join(f"an{i}er" for i in range(300))
    rows += [(900, long, "en", "s"), (901, long + " end", "en", "s"), (902, long.upper().lower(), "en", "s"), (903, "of the an er token = abcdefghijklmnop1 " + " ".join(["an er on"] * 10), "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    truth = {i: (q, t) for i, q, t in labels if i is not None}
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    wrong = lambda before, after, k, bad: [i for i in truth if i in before and truth[i][k] is not None and (i not in after) != (truth[i][k] == bad)]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(cut(stage(spark, frames[-1], sf)))
        assert frames[-1].columns == docs.columns
    everything, good, clean, single, redacted = map(ids, frames)
    assert len(wrong(everything, good, 0, 0)) < 0.05 * len(truth) and len(wrong(good, clean, 1, 1)) < 0.05 * len(truth)
    assert sum(i in good and i in clean for i in (900, 901, 902)) == 3
    assert 900 in single and 902 not in single and len(single) < len(clean)
    assert sorted(single, key=str) == sorted(redacted, key=str)
    texts = {r["doc_id"]: r for r in frames[-1].collect()}
    assert "[SECRET:assign]" in texts[903]["text"] and texts[903]["n_chars"] == len(texts[903]["text"])
    packed = stages.pack_sequences(spark, frames[-1], sf).collect()
    assert {r["doc_id"] for r in packed} == set(redacted)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "secrets", "packing"]


def test_stages_decide_as_their_operators_by_brute_force(spark, tmp_path):
    """Each stage's rows worked out by hand from its operator's parts, on its own input; then run() as a whole."""
    rows, labels = corpus(150)
    rng = random.Random(9)
    rows += [(i, rng.choice(rows)[1], "en", "s") for i in range(200, 230)] + [(None, None, None, None), rows[5], (5, rows[7][1], "de", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, docs = str(tmp_path), table(spark, str(tmp_path), "documents")
    out = [docs]
    for _, stage in stages.STAGES[:-1]:
        out.append(cut(stage(spark, out[-1], sf)))
    every, good, clean, single, redacted = ([tuple(r) for r in df.collect()] for df in out)
    assert all(df.columns == docs.columns for df in out)
    order = lambda x: sorted(x, key=str)

    both, model = quality.fit(docs, table(spark, sf, "labels"))
    tokens = quality.Tokens()
    scored = [quality.probabilities(model, quality.features(tokens(r[1]), both)[None])[0] for r in every]
    assert order(good) == order(r for r, s in zip(every, scored, strict=True) if s >= 0.3)
    net, _ = toxicity.fit(out[1], table(spark, sf, "labels"))
    assert order(clean) == order(r for r, s in zip(good, toxicity.Scorer(net).scores([r[1] for r in good]), strict=True) if s < 0.5)
    texts = sorted({r[1] or "" for r in clean})
    label = {texts[i]: c for i, (_, c) in brute_components(list(enumerate(texts))).items()}
    least = {}
    for r in clean:
        key = (r[0] is None, r[0] or 0)
        least[label[r[1] or ""]] = min(least.get(label[r[1] or ""], key), key)
    assert len(single) == len(least) and set(single) <= set(clean)
    assert {label[r[1] or ""]: (r[0] is None, r[0] or 0) for r in single} == least
    spans = {r["a.b"]: r["secrets"] for r in secret_scan.find_secrets(out[3]).collect()}
    for before, after in zip(order(single), order(redacted), strict=True):
        text = before[1]
        for s in reversed(spans[before[5]]):
            text = text[: s["start"]] + f"[SECRET:{s['kind']}]" + text[s["end"] :]
        assert after == (before[0], text, *before[2:4], before[4] if text is None else len(text), before[5])
    packed = corpus_pipeline.run(spark, sf).collect()
    tokenizer = packing.WordTokenizer(open(packing.public_tokenizers.path("word_bpe_49k.json"), "rb").read(), False)
    assert order((r["doc_id"], r["length"]) for r in packed) == order((r[0], len(tokenizer(r[1] or "")) // 4 + 1) for r in redacted)
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in places.values():
        found.sort()
        assert [p[0] for p in found] == [sum(p[1] for p in found[:i]) for i in range(len(found))] and sum(p[1] for p in found) <= 4096
