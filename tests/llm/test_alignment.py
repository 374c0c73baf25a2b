import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from hitweave.llm import alignment

WORDS = ["the", "of", "Strauß", "naïve", "don't", "1234567", "日本語", "foo,bar", "x=1;", "<s>", "<|endoftext|>", "<0x41>", "\n", "\t", "a\nb", "é", "🙂", "...", "http://ab.cd/e?f=1", "\x00", "\x85", "　", "ﬁ", "\x1f"]


def texts(n=60):
    rng = random.Random(5)
    made = [rng.choice([" ", " ", " ", "  ", "\n", " \n ", ""]).join(rng.choice(WORDS) for _ in range(rng.randrange(1, 40))) for _ in range(n)]
    return made + [None, "", " ", "  ", "\n", " a", "a ", "a  ", " a b ", "a▁b", "a ▁ b", "same text", "same text", "x" * 3000, "word " * 500]


class Brute:
    """Whole texts by the libraries, every pair of tokens compared."""

    def __init__(self, rows):
        a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        unbyte = alignment._unbyte()
        self.docs, self.n = [], Counter()
        for text in rows:
            whole = (" " + (text or "")).encode()
            ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
            ids_b = b.encode(text) if text else []
            bytes_a = [bytes(unbyte[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
                ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
            spans = []
            for side in (bytes_a, bytes_b):
                at, out = 0, []
                for x in side:
                    out.append((at, at + len(x)))
                    at += len(x)
                spans.append(out)
            links = [(i, j) for i, j, (s, e), (t, f) in ((i, j, p, q) for i, p in enumerate(spans[0]) for j, q in enumerate(spans[1]) if q[1] > p[0] and p[1] > q[0])]
            common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
            groups, last = [], 0
            for end in common:
                groups.append(",".join(str(t) for t, s in zip(ids_a, spans[0]) if last < s[1] <= end) + "|" + ",".join(str(t) for t, s in zip(ids_b, spans[1]) if last < s[1] <= end))
                last = end
            pairs = [(ids_a[i], ids_b[j]) for i, j in links]
            self.n.update(set(pairs))
            self.docs.append((len(ids_a), len(ids_b), len(groups), pairs, ";".join(groups)))
        best = defaultdict(int)
        for (x, _), n in self.n.items():
            best[x] = max(best[x], n)
        self.rows = [(a, b, g, len(p), sum(self.n[x] == best[x[0]] for x in p), sum(self.n[x] for x in p), hashlib.sha256(t.encode()).hexdigest() if t else "", t) for a, b, g, p, t in self.docs]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


@pytest.mark.parametrize("together,hot", [(1 << 21, 1 << 20), (40, 30), (100, 0)])
def test_equals_brute_force(spark, together, hot):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "other", 3) for i, t in enumerate(rows)], "doc_id long, text string, groups string, n int").repartition(3)
    got = alignment.align(docs, hot=hot, together=together)
    want = Brute(rows).rows
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()}
    assert len(found) == len(rows)
    for i, row in enumerate(want):
        assert found[i] == row, rows[i]


@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


@pytest.mark.parametrize("together,known", [(1 << 21, 300_000), (30, 300_000), (100, 5)])
def test_stretches_and_windows(monkeypatch, files, together, known):
    monkeypatch.setattr(alignment, "KNOWN", known)
    rows, brute = texts(), Brute(texts())
    found = list(alignment.aligned_texts(alignment.Aligner(*files), iter(rows), together=together))
    assert len(found) == len(rows)
    for got, doc, row in zip(found, brute.docs, brute.rows, strict=True):
        assert (got[:5], got[7]) == ((*row[:4], row[6]), row[7])
        assert dict(zip(got[5].tolist(), got[6].tolist(), strict=True)) == Counter(a << 20 | b for a, b in doc[3])


def test_vocabularies_allow_the_cuts_and_the_faster_library(files):
    a = Tokenizer.from_str(files[0].decode())
    b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    pieces = [b.id_to_piece(i) for i in range(b.vocab_size()) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i))]
    assert not any(c != "▁" and d == "▁" for p in pieces for c, d in zip(p, p[1:]))
    unbyte = alignment._unbyte()
    tokens = [t for t in (bytes(unbyte[c] for c in x).decode(errors="ignore") for x in a.get_vocab() if not x.startswith("<|")) if t]
    encode = alignment._encoder(files[0])
    assert encode(tokens) == [x.ids for x in a.encode_batch_fast(tokens, add_special_tokens=False)]


def test_pair_counts_and_odd_tables(spark):
    rows = texts(20)
    docs = spark.createDataFrame([(t, 1) for t in rows], "`a.text` string, id long")
    got = {(r["a"], r["b"]): r["n"] for r in alignment.pair_counts(alignment.aligned(docs, "id", "a.text")).collect()}
    assert got == dict(Brute(rows).n)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.op11_alignment(empty).count() == 0
    few = alignment.op11_alignment(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["n_links"]) for r in few) == [(False, 0), (True, 2), (True, 2)]
    assert all(r["n_best"] == r["n_links"] and r["count_sum"] == 2 * r["n_links"] for r in few if r["n_links"])
