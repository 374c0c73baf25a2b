"""Aligning the tokens of two tokenizers over the same bytes.

The ends of both token sequences, merged and without repeats, cut a text into
elementary intervals. The owner of an interval on either side is the first token that
does not end before it, so each interval is one overlap of two tokens, and an interval
that ends where both owners end closes a group.

Neither tokenizer joins anything across a single space between two other signs: the
first splits there before it merges, and no piece of the second goes on behind a space.
So texts are cut there, and each different stretch is tokenized and aligned once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hitweave.llm.heavy import most_frequent, summed
from hitweave.session import stored

#: Id pairs whose counts are broadcast, 16 bytes each; the counts of the others are joined.
HOT_PAIRS = 1 << 20
#: Stretches that a worker remembers, and their signs.
KNOWN, SIGNS = 500_000, 10_000_000
#: Signs of the texts that are taken together, and of a window of a longer one.
TOGETHER = 1 << 21
#: Links that are handed on together.
LINKS = 1 << 21
_SIDE = 20  # bits of an id in a pair
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s | \s")


def _unbyte() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, then from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _encoder(file: bytes) -> Callable[[list[str]], list[list[int]]]:
    """Encodes texts as the byte-level BPE of a tokenizer file does, special tokens as plain text.

    Where the vocabulary is ordered by merges, ids are ranks and the faster library for
    ranks gives the same ids; else the file's own library is asked.
    """
    model = json.loads(file)["model"]
    unbyte, vocab = _unbyte(), model["vocab"]
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids, made = [vocab[m] for m in merges], set(merges)
    ranks = {bytes(map(unbyte.__getitem__, t)): i for t, i in vocab.items() if all(c in unbyte for c in t) and (len(t) == 1 or t in made)}
    if ids == sorted(set(ids)) and sum(len(t) == 1 for t in ranks) == 256 and max(i for t, i in ranks.items() if len(t) == 1) < min(ids, default=256):
        ordinary = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: list(map(ordinary, texts))
    own = Tokenizer.from_str(file.decode())
    own.encode_special_tokens = True
    return lambda texts: [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)]


class Aligner:
    """Aligned stretches of text, by number; the numbers hold until more are asked for."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = _encoder(a_file)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        unbyte, vocab = _unbyte(), json.loads(a_file)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in unbyte for c in token):
                self.a_bytes[i] = bytes(map(unbyte.__getitem__, token))
        pieces = map(self.b.id_to_piece, range(self.b.vocab_size()))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        self.signed = {c: np.array([f"{i}{c}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))], object) for c in ",|;"}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.signs = 0
        self.groups: list[str] = []
        #: tokens of either side, groups, links, faults
        self.sums = np.zeros((0, 5), np.int64)
        self.pairs, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def numbers(self, stretches: list[str]) -> np.ndarray:
        new = set(stretches).difference(self.known)
        if new:
            if len(self.known) + len(new) > KNOWN or self.signs > SIGNS:
                self.clear()
                new = set(stretches)
            self._add(list(new))
        return np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))

    def _add(self, new: list[str]) -> None:
        spaced = [" " + s for s in new]
        a, b = self.a(spaced), self.b.encode(new)
        whole = [s.encode() for s in spaced]
        good = np.ones(len(new), bool)
        flat = lambda side: list(chain.from_iterable(side))
        told = lambda ids, side: b"".join(map(side.__getitem__, ids))
        n_a, n_b, ids_a, ids_b = self._flat(a, b)
        size = np.fromiter(map(len, whole), np.int64, len(new))
        sums = [np.bincount(np.repeat(np.arange(len(new)), n), sizes[ids], len(new)) for n, ids, sizes in ((n_a, ids_a, self.a_sizes), (n_b, ids_b, self.b_sizes))]
        everything = b"".join(whole)
        if not (all((x == size).all() for x in sums) and told(flat(a), self.a_bytes) == everything == told(flat(b), self.b_bytes)):
            for i, text in enumerate(whole):
                good[i] = told(a[i], self.a_bytes) == text == told(b[i], self.b_bytes)
                if not good[i]:
                    a[i], b[i] = [], []
            n_a, n_b, ids_a, ids_b = self._flat(a, b)
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        ends = np.union1d(ends_a, ends_b)
        own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        closed = (ends_a[own_a] == ends) & (ends_b[own_b] == ends) if len(ends) else np.zeros(0, bool)
        of = np.repeat(np.arange(len(new)), n_a)[own_a]
        rows = np.zeros((len(new), 5), np.int64)
        rows[:, 0], rows[:, 1], rows[:, 4] = n_a, n_b, ~good
        rows[:, 2], rows[:, 3] = np.bincount(of[closed], minlength=len(new)), np.bincount(of, minlength=len(new))
        shut = ends[closed]
        in_a, in_b = np.searchsorted(shut, ends_a), np.searchsorted(shut, ends_b)
        parts = np.empty(len(ids_a) + len(ids_b), object)
        before_a, before_b = np.bincount(in_a, minlength=len(shut)), np.bincount(in_b, minlength=len(shut))
        last_a, last_b = (np.r_[np.diff(x) != 0, True][: len(x)] for x in (in_a, in_b))
        parts[np.arange(len(ids_a)) + (np.cumsum(before_b) - before_b)[in_a]] = np.where(last_a, self.signed["|"][ids_a], self.signed[","][ids_a])
        parts[np.arange(len(ids_b)) + np.cumsum(before_a)[in_b]] = np.where(last_b, self.signed[";"][ids_b], self.signed[","][ids_b])
        parts, to = parts.tolist(), np.cumsum(n_a + n_b).tolist()
        self.groups += ["".join(parts[i:j])[:-1] for i, j in zip([0, *to], to, strict=False)]
        self.signs += sum(map(len, new))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.sums = np.concatenate([self.sums, rows])
        self.pairs = np.concatenate([self.pairs, ids_a[own_a] << _SIDE | ids_b[own_b]])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(rows[:, 3])])

    @staticmethod
    def _flat(a: list[list[int]], b: list[list[int]]) -> tuple[np.ndarray, ...]:
        n = [np.fromiter(map(len, side), np.int64, len(side)) for side in (a, b)]
        return *n, *(np.fromiter(chain.from_iterable(side), np.int64, k.sum()) for side, k in zip((a, b), n, strict=True))

    def pairs_of(self, numbers: np.ndarray) -> np.ndarray:
        """All pairs of the stretches, one after the other."""
        sizes = self.at[numbers + 1] - self.at[numbers]
        return self.pairs[np.repeat(self.at[numbers] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


_aligners: dict[bytes, Aligner] = {}


def _aligner(files: list[bytes]) -> Aligner:
    """One for each pair of files; it outlives a task, with what it remembers."""
    key = hashlib.sha256(b"".join(files)).digest()
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*files)
    return _aligners[key]


def stretches_of(text: str) -> list[str]:
    """`text` cut at single spaces between two signs that are none; joined by spaces they give it again."""
    return _CUT.split(text) if text[0] == " " or text[-1] == " " or _ODD.search(text) else text.split(" ")


def _portions(texts: Iterator[str | None], together: int = TOGETHER) -> Iterator[tuple[list[list[str]], bool, bool]]:
    """(stretches of each text, first, last): portions of whole texts, or windows of one long text."""
    waiting, size = [], 0
    for text in texts:
        text = text or ""
        if size + len(text) > together and waiting:
            yield waiting, True, True
            waiting, size = [], 0
        if len(text) <= together:
            waiting.append(stretches_of(text) if text else [])
            size += len(text)
            continue
        at, first = 0, True
        while at < len(text):
            cut = _CUT.search(text, at + together)
            end = cut.start() if cut else len(text)
            last = cut is None
            yield [stretches_of(text[at:end])], first, last
            at, first = end + 1, False
    if waiting:
        yield waiting, True, True


def aligned(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None, groups: bool = False, together: int = TOGETHER) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times and, if asked, groups) of each row.

    `pairs` are the different linked pairs of ids, a << 20 | b, and `times` how many
    links each has. `row` tells rows apart in a stored result.
    """
    files = []
    for path in (a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")):
        with open(path, "rb") as file:
            files.append(file.read())
    shared = documents.sparkSession.sparkContext.broadcast(files)
    kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), *([pa.string()] if groups else [])]
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *(["groups"] if groups else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        for batch in batches:
            rows, done, links = [], 0, 0
            for row in aligned_texts(aligner, (t.as_py() for t in batch.column(2)), groups, together):
                rows.append(row)
                links += row[3]
                if links > LINKS:
                    yield made(batch, done, rows)
                    rows, done, links = [], done + len(rows), 0
            yield made(batch, done, rows)

    def made(batch: pa.RecordBatch, done: int, rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([*(batch.column(i).slice(done, len(rows)) for i in (0, 1)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["row", "doc_id", *names])

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return rows.mapInArrow(run, schema + ", groups string" * groups)


def aligned_texts(aligner: Aligner, texts: Iterator[str | None], groups: bool = True, together: int = TOGETHER) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times and, if asked, groups) of each text."""
    sums, digest, said, parts = np.zeros(5, np.int64), hashlib.sha256(), [], []
    for portion, first, last in _portions(texts, together):
        numbers = aligner.numbers([s for stretches in portion for s in stretches])
        at = 0
        for stretches in portion:
            mine = numbers[at : at + len(stretches)]
            at += len(stretches)
            if first:
                sums, digest, said, parts = np.zeros(5, np.int64), hashlib.sha256(), [], []
            sums = sums + aligner.sums[mine].sum(axis=0)
            some = ";".join(map(aligner.groups.__getitem__, mine.tolist()))
            digest.update(some.encode() if first else b";" + some.encode())
            said += [some] * groups
            parts.append(np.unique(aligner.pairs_of(mine), return_counts=True))
            if not last:
                continue
            pairs, times = parts[0] if len(parts) == 1 else summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            if sums[4] or not sums[0]:
                yield 0, 0, 0, 0, "", pairs[:0], times[:0], *([""] * groups)
            else:
                yield *sums[:4].tolist(), digest.hexdigest(), pairs, times, *([";".join(said)] * groups)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, a, b, n): how many of the rows of `aligned` hold each pair."""
    ids = F.shiftright("pair", _SIDE).alias("a"), F.col("pair").bitwiseAND((1 << _SIDE) - 1).alias("b")
    return found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).select("pair", *ids, "n")


def align(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None, groups: bool = True, hot: int = HOT_PAIRS, together: int = TOGETHER) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked, groups) of each row.

    `groups` holds the ids of both sides, "a1,a2|b1;a3|b2,b3". A link is an overlap of
    two tokens, its count the number of documents that have its pair of ids; n_best are
    the links whose count is the highest of their a. Null and empty texts, and those that
    either tokenizer does not give back whole, have no tokens: zeros and ''. Repeated
    rows and null ids stay and count each. An empty table gives an empty table.

    The counts of the `hot` most frequent pairs are broadcast, with a mark on the best of
    each a; links of other pairs are joined with the counts.
    """
    found = stored(aligned(documents, doc_id, text, a_path, b_path, groups, together))
    counts = stored(pair_counts(found))
    highest = counts.groupBy("a").agg(F.max("n").alias("best"))
    counts = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("best")).alias("best"))
    table = most_frequent(counts, hot).toArrow()
    keys, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(keys)
    told = documents.sparkSession.sparkContext.broadcast((keys[order], n[order], best[order].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = told.value
        for batch in batches:
            lists = batch.column(1)
            pairs, times, sizes = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            at, own, row_hit = at[hit], times[hit], row[hit]
            ends = np.r_[0, np.cumsum(np.bincount(row_hit, minlength=len(sizes)))]
            added = lambda x: np.diff(np.r_[0, np.cumsum(x)][ends])
            rest = np.bincount(row[~hit], minlength=len(sizes))
            cold = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rest)], pa.int32()), pa.array(x[~hit])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(added(best[at] * own)), pa.array(added(n[at] * own)), *cold], names=["row", "n_best", "count_sum", "pairs", "times"])

    sums = stored(found.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long, pairs array<long>, times array<long>"))
    rest = sums.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    rest = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    sums = sums.select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = found.drop("pairs", "times").join(sums, "row")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else []))


def op11_alignment(documents: DataFrame) -> DataFrame:
    """Every document's aligned tokens in figures."""
    return align(documents, groups=False)
