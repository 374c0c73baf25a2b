import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hitweave.llm import packing, ties


def first_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        for i, g in enumerate(gaps):
            if g >= n:
                gaps[i] -= n
                break
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_plans_are_valid_and_tight():
    rng = random.Random(0)
    for trial in range(60):
        capacity = rng.choice([10, 64, 100])
        lengths = [rng.randrange(1, capacity + 1 if trial % 2 else capacity // 2) for _ in range(rng.randrange(1, 400))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        places, number = packing.plan(counts, capacity)
        used = {}
        for n, first, count, seq, each, offset in places:
            for j in range(count):
                used.setdefault(seq + j // each, []).append((offset + j % each * n, n))
        assert sorted(n for x in used.values() for _, n in x) == sorted(lengths)
        assert sorted(used) == list(range(number))
        for x in used.values():
            at = 0
            for offset, n in sorted(x):
                assert offset == at
                at += n
            assert at <= capacity
        assert number <= 1.02 * first_fit_decreasing(lengths, capacity) + 1


def test_words_equal_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = packing.WordTokenizer(open(path, "rb").read())
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rng = random.Random(1)
    alphabet = "abcXYZ 0123 '  \n\tst.,!?éÀßñ\x1c\x85\xa0ſŉıĲµ²½ª<|>İ中Ωσе́ﬁ"
    for text in ["", "<|endoftext|> a", "it's We'LL", "É" * 3] + ["".join(rng.choice(alphabet[: 48 if i % 2 else None]) for _ in range(rng.randrange(50))) for i in range(4000)]:
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_documents(spark):
    rng = random.Random(2)
    texts = [None, "", "one", "one", "word " * 9000, "x y " * 1024 + "z z z"[:5]] + [" ".join("ab" for _ in range(rng.randrange(1, 3000))) for _ in range(150)] + ["same text here"] * 500
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packing.op10_packing(df).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["length"] for r in parts] == [len(ids[a : a + 4096]) for a in range(0, len(ids), 4096)]
        for k, r in enumerate(parts):
            assert (r["piece"], r["start"]) == (k, 4096 * k)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[4096 * k : 4096 * (k + 1)], dtype="<u4").tobytes())
    for x in by_seq.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(by_seq) <= first_fit_decreasing([r["length"] for r in rows], 4096) + 1
    assert packing.op10_packing(df.limit(0)).count() == 0
    assert sum(len(r["ids"]) for r in packing.sequences(df.where("doc_id < 40")).collect()) == sum(r["length"] for r in rows if r["doc_id"] < 40)


def test_special_tokens_in_documents(spark):
    texts = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|><|endoftext|>Y", "<|ENDOFTEXT|> a", "中 <|startoftext|> É", "<|endoftext |> no"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert 49407 in want[0] and 49406 in want[1]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in packing.pieces_of(df, ids=True).collect()}
    assert [list(got[i]["ids"]) for i in range(len(texts))] == want
    crcs = {r["doc_id"]: (r["start"], r["length"], r["ids_crc32"]) for r in packing.op10_packing(df).collect()}
    assert crcs == {i: (0, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for i, ids in enumerate(want)}


def test_equal_pieces_are_dealt_by_number(spark):
    rows = [(5, 0, 300)] * 3000 + [(i, 0, 300) for i in range(400)] + [(None, None, 4096)] * 3
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    dealt = ties.dealt(pieces, F.lit(1), 0, packing.RANKED)
    assert dealt.count() == len(rows) and max(r["count"] for r in dealt.groupBy("__hw_tie").count().collect()) < 5
    for order in (("doc_id", "piece"), ()):
        placed = packing.pack(pieces, order=order).collect()
        assert sorted(map(repr, ((r["doc_id"], r["piece"], r["length"]) for r in placed))) == sorted(map(repr, rows))
        by_seq = {}
        for r in placed:
            by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert all([o for o, _ in sorted(x)] == [300 * i for i in range(len(x))] or x == [(0, 4096)] for x in by_seq.values())
        assert len(by_seq) == -(-3400 // 13) + 3
