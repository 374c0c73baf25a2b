"""Packing documents into sequences of bounded length: large-item matching, then best fit.

How many pieces have each length is all that a plan needs, and there are at most
`capacity` lengths; so the plan is made over counts, in runs of sequences that are
filled alike, and pieces find their place by their rank among those of equal length.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hitweave.llm import ties
from hitweave.session import cut

CAPACITY = 4096
END = 1
#: Pieces of equal length that are ranked together.
RANKED = 200
MAX_WORDS = 500_000
_SIMPLE = 0x180


class WordTokenizer:
    """Ids of whole texts by a tokenizer whose words do not depend on each other.

    Texts of Latin letters are split here, and the tokenizer is asked once for each
    different word; others, and those that hold an added token's literal, go to the
    tokenizer whole. Special tokens in a text are ordinary text with `special_as_text`,
    else, as the library has it by default, their own ids.
    """

    def __init__(self, data: bytes, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = special_as_text
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")
        kind = lambda k: "".join(f"\\u{c:04x}" for c in range(_SIMPLE) if unicodedata.category(chr(c))[0] == k)
        letters, numbers, space = kind("L"), kind("N"), "\\t-\\r \\x85\\xa0"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")
        self.other = re.compile(f"[^\\x00-{chr(_SIMPLE - 1)}]|İ")
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.added.search(text) or not text.isascii() and self.other.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = self.words.findall(text.lower())
        known = self.known
        if new := set(words).difference(known):
            if len(known) + len(new) > MAX_WORDS:
                known.clear()
                new = set(words)
            new = list(new)
            for word, coded in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                ids = coded.ids
                known[word] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, words))


_tokenizers: dict[bytes, WordTokenizer] = {}


def _tokenizer(data: bytes) -> WordTokenizer:
    key = hashlib.sha256(data).digest()
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordTokenizer(data, special_as_text=False)
    return _tokenizers[key]


def pieces_of(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if asked, ids): each document's tokens with the end token, cut at `capacity`.

    Null counts as empty: one piece with the end token alone. The tokenizer file, of
    fixed size, is broadcast.
    """
    with open(path or public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())
    end, wide = np.array([END], dtype="<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        for batch in batches:
            rows = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = tokenizer(t.as_py() or "") + end
                for piece, at in enumerate(range(0, len(data), wide)):
                    part = data[at : at + wide]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if ids else [])))
            columns = list(zip(*rows, strict=True)) or [[]] * (5 + ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places for counts[length] pieces of each length, and the number of sequences.

    A place (length, first rank, number, first sequence, per sequence, offset)
    holds pieces ranked first rank to first rank + number - 1 of that length,
    `per sequence` of them one after the other in each sequence from `offset` on.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths have to be between 1 and the capacity")
    rank = dict.fromkeys(left, 0)
    places: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted sizes of gaps
    runs: dict[int, list[tuple[int, int]]] = {}  # gap to runs of (first sequence, number)
    sequences = 0

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, number))

    def place(n: int, number: int, first: int, each: int, offset: int) -> None:
        places.append((n, rank[n], number, first, each, offset))
        rank[n] += number
        left[n] -= number

    # at most two pieces above a third share a sequence: match each, the largest first, with the largest that fits
    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect.bisect_right(large, capacity - a)
            while at and not left[large[at - 1]]:
                at -= 1
            b = large[at - 1] if at else 0
            if not b:
                number = left[a]
                place(a, number, sequences, 1, 0)
                leave(capacity - a, sequences, number)
            elif a == b:
                number = -(-left[a] // 2)
                odd = left[a] % 2
                place(a, left[a], sequences, 2, 0)
                leave(capacity - 2 * a, sequences, number - odd)
                leave(capacity - a, sequences + number - 1, odd)
            else:
                number = min(left[a], left[b])
                place(a, number, sequences, 1, 0)
                place(b, number, sequences, 1, a)
                leave(capacity - a - b, sequences, number)
            sequences += number
    # the others, the largest first, go where they fit best
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(gaps, n)
            gap = gaps[at] if at < len(gaps) else capacity
            each = min(gap // n, left[n])
            number = left[n] // each
            if at < len(gaps):
                first, there = runs[gap].pop()
                number = min(number, there)
                leave(gap, first + number, there - number)
                if not runs[gap]:
                    del runs[gap]
                    gaps.pop(bisect.bisect_left(gaps, gap))
            else:
                first, sequences = sequences, sequences + number
            place(n, number * each, first, each, capacity - gap)
            leave(gap - each * n, first, number)
    return places, sequences


def pack(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = (), capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset: the pieces of a sequence lie in it without gaps or overlaps.

    `order` names columns that, with the length, tell pieces apart; with it the result
    is the same in every run. Without it, and where pieces are alike in it, all columns
    tell them apart; equal pieces may change places, and many of them are dealt over
    parts by number. Lengths have to be from 1 to capacity. Only the counts by length come to the driver, capacity
    rows at most, and only tables bounded by them are broadcast. Columns named with the
    prefix `__hw_` are reserved. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    places, _ = plan(counts, capacity)
    sizes = spark.createDataFrame([(n, -(-c // RANKED)) for n, c in counts.items()], f"`{length}` long, __hw_parts int")
    dealt = ties.dealt(pieces, F.lit(1), 0, RANKED).join(F.broadcast(sizes), length)
    dealt = dealt.withColumn("__hw_part", F.pmod("__hw_tie", F.col("__hw_parts"))).drop("__hw_parts")
    before = Window.partitionBy(length).orderBy("__hw_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy(length, "__hw_part").count().select(length, "__hw_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__hw_first"))
    ranked = dealt.withColumn("__hw_rank", F.row_number().over(Window.partitionBy(length, "__hw_part").orderBy(*order, "__hw_tie")) - 1)
    ranked = ranked.join(firsts, [length, "__hw_part"]).withColumn("__hw_rank", F.col("__hw_rank") + F.col("__hw_first"))
    table = spark.createDataFrame(places or [(0, 0, 0, 0, 1, 0)], f"`{length}` long, __hw_from long, __hw_number long, __hw_seq long, __hw_each long, __hw_offset long")
    table = table.groupBy(length).agg(F.sort_array(F.collect_list(F.struct("__hw_from", "__hw_number", "__hw_seq", "__hw_each", "__hw_offset"))).alias("__hw_places"))
    found = ranked.join(F.broadcast(table), length)
    at = F.filter("__hw_places", lambda p: (p["__hw_from"] <= F.col("__hw_rank")) & (F.col("__hw_rank") < p["__hw_from"] + p["__hw_number"]))[0]
    found = found.withColumn("__hw_place", at).withColumn("__hw_in", F.col("__hw_rank") - F.col("__hw_place.__hw_from"))
    each = F.col("__hw_place.__hw_each")
    return found.select(
        *(F.col(f"`{c}`") for c in pieces.columns),
        (F.col("__hw_place.__hw_seq") + F.floor(F.col("__hw_in") / each)).cast("long").alias("sequence_id"),
        (F.col("__hw_place.__hw_offset") + (F.col("__hw_in") % each) * F.col(length)).cast("long").alias("offset"),
    )


def pack_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs whole documents: one row for each piece with its place.

    Null texts count as empty and take one token, the end. Repeated rows are packed as
    often as they occur, a null doc_id is kept, other columns are not read. An empty
    table gives an empty table.
    """
    pieces = cut(pieces_of(documents, doc_id, text, path, capacity))
    return pack(pieces, "length", ("doc_id", "piece", "ids_crc32"), capacity)


def sequences(documents: DataFrame, **options) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, each at most the capacity long.

    Null texts are the end token alone, repeated rows are packed as often as they occur,
    an empty table gives an empty table.
    """
    capacity = options.get("capacity", CAPACITY)
    pieces = cut(pieces_of(documents, ids=True, **options))
    placed = pack(pieces, "length", ("doc_id", "piece", "ids_crc32"), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op10_packing(documents: DataFrame) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return pack_documents(documents)
