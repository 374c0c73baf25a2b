"""The transducer against the tiktoken library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from hitweave.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(bpe.rank_file()))


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.transducer.ranks, special_tokens={})


ALPHABET = "abcdeABC  \n\t'.,!?0123éßñ中文字\u3000\U0001f600\xa0\x1c\u0107\u0130²½ªΩдж"


def samples():
    rng = random.Random(1)
    yield from ("", " ", "\n\n  a", "it's we'll 'S", "<|endoftext|>", "a" * 5000 + "ab" * 3000, "x" * 70 + "é" * 70)
    for _ in range(3000):
        yield "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60)))


def test_ids_equal_library(codec, reference):
    for text in samples():
        assert codec.encode(text).tolist() == reference.encode_ordinary(text), repr(text)


def test_token_borders(codec, reference):
    rng, tokens = random.Random(2), list(codec.transducer.ranks)
    for _ in range(5000):
        try:
            text = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 6))).decode()
        except UnicodeDecodeError:
            continue
        assert codec.encode(text).tolist() == reference.encode_ordinary(text), repr(text)


def test_streaming_decode_in_any_parts(codec):
    for text in samples():
        ids = codec.encode(text)
        for part in (1, 3):
            if len(ids) < 500:
                assert "".join(codec.decode(ids, part)) == text
    broken = bpe.StreamingDecoder({0: b"\xe4\xb8", 1: b"\xad", 2: b"\xff", 3: b"\xf0\x9f", 4: b"a"})
    assert [broken.feed([0]), broken.feed([1]), broken.feed([2]), broken.feed([3]), broken.feed([4]), broken.finish()] == ["", "中", "�", "", "�a", ""]


def test_automaton_equals_decode():
    rng = random.Random(7)
    for _ in range(20000):
        data = bytes(rng.choice([rng.randrange(256), *b"a\x80\xbf\xc2\xe0\xe4\xed\xf0\xf4\x90\x9f\xa0"]) for _ in range(rng.randrange(9)))
        state, text = bpe.Utf8.run(bpe.Utf8.START, data)
        assert text + "\ufffd" * (state != bpe.Utf8.START) == data.decode("utf-8", "replace"), data
    for c in [*range(0, 0xD800, 7), *range(0xE000, 0x110000, 13)]:
        assert bpe.Utf8.run(bpe.Utf8.START, chr(c).encode()) == (bpe.Utf8.START, chr(c))


def test_tokens_leave_after_a_bounded_lookahead(codec):
    """In words whose tokens could always go on, no more than LOOKAHEAD bytes and some tokens are held back."""
    transducer, rng = codec.transducer, random.Random(6)
    for unit in (b"a", b"ab", b"the", b"=", b"-=", b"\xc3\xa9", b"abcdefgh", b"xX"):
        word = unit * 3000 + bytes(rng.choice(unit) for _ in range(3000))
        read = gone = held = 0

        def fed(word=word):
            nonlocal read
            for byte in word:
                read += 1
                yield byte

        parts = []
        for part in transducer.stream(fed()):
            held = max(held, read - gone)
            gone += sum(len(transducer.words[t]) for t in part)
            parts += part
        assert parts == transducer.encode(word) and gone == len(word)
        assert held <= bpe.LOOKAHEAD + 300, (unit, held)


def test_small_cache_bounds_change_nothing(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_WORDS", 10)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 20)
    monkeypatch.setattr(bpe, "MAX_PIECES", 5)
    small = bpe.Codec(codec.transducer.ranks)
    for text in list(samples())[:500]:
        assert small.encode(text).tolist() == reference.encode_ordinary(text)
        assert "".join(small.decode(small.encode(text))) == text


def test_query_and_tables(spark, reference):
    texts = [None, "", "a b", "été \U0001f600", "a b"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r for r in bpe.op2_bpe(df).collect()}
    for i, text in enumerate(texts):
        ids = np.array(reference.encode_ordinary(text or ""), dtype="<u4")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.op2_bpe(df.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(df)).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == [t or "" for t in texts]
