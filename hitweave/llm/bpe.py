"""Byte-level BPE as a transducer, and streaming decoding.

A prefix of a word has one encoding, and it ends in the one token that may follow what
stands before it; so reading a byte extends the encodings of the prefixes that still
matter, those whose rest could still become a longer token. The transducer's state is
that set: for each live prefix its last token and the place of its rest in the token
trie. States are numbered and their transitions compiled when first met. Reading a byte
gives the token that ends there. Whatever follows, the encoding goes through one of the
live prefixes; so after every LOOKAHEAD bytes the tokens that all of their encodings
begin with are emitted, and what is held back stays short however long the word is.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States, words and pairs that are kept before a cache starts anew.
MAX_STATES, MAX_WORDS, MAX_PAIRS = 400_000, 300_000, 500_000
#: Bytes after which the settled tokens are emitted within a word.
LOOKAHEAD = 64
#: Decoded pieces of (state, token) that are kept.
MAX_PIECES = 500_000
_SIMPLE = 0x250


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def _char_class(*kinds: str) -> str:
    """Code points below _SIMPLE of the given Unicode categories, for a bracket expression."""
    return "".join(f"\\u{c:04x}" for c in range(_SIMPLE) if unicodedata.category(chr(c))[0] in kinds)


def simple_pattern() -> re.Pattern:
    """PATTERN for texts whose code points are all below _SIMPLE; `re` is faster than `regex`."""
    letters, numbers = _char_class("L"), _char_class("N")
    space = r"\t-\r \u0085 "
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


class Splitter:
    """Splits a text as the tokenizer's pattern does."""

    def __init__(self, pattern: str = public_tokenizers.PATTERN):
        self.full, self.fast, self.other = regex.compile(pattern), simple_pattern(), re.compile(f"[^\\x00-{chr(_SIMPLE - 1)}]")
        if pattern != public_tokenizers.PATTERN:
            self.fast = self.full

    def __call__(self, text: str) -> list[str]:
        return (self.fast if text.isascii() or not self.other.search(text) else self.full).findall(text)


class Transducer:
    """Encodes words by a rank table; `encode` takes bytes and returns token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.words = ranks, {i: t for t, i in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for the bytes {missing}")
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        for token, rank in ranks.items():
            if len(token) == 1 or self._half(rank):
                self._insert(token, rank)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._clear()

    def _insert(self, token: bytes, rank: int) -> None:
        node = 0
        for byte in token:
            if byte not in self.trie[node]:
                self.trie[node][byte] = len(self.trie)
                self.trie.append({})
                self.token_at.append(-1)
                self.depth.append(self.depth[node] + 1)
            node = self.trie[node][byte]
        self.token_at[node] = rank

    def _half(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if merging never ends in it."""
        if rank not in self.halves:
            token, ranks = self.words[rank], self.ranks
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best, at = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
                if best >= rank:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[rank] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[rank]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of both gives both.

        Goes back in time over the merges at the border: if the two tokens that stand
        there at some moment merge with a rank that comes before the one that ends the
        moment, the border does not last. Of equal ranks the left merge comes first.
        """
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._lasts(left, right)
        return known

    def _lasts(self, left: int, right: int) -> bool:
        words, ranks = self.words, self.ranks
        made = lambda t: -1 if len(words[t]) == 1 else t  # noqa: E731  when it came to be; bytes are there from the start
        until = 1 << 60  # the border merge has to come before this
        while True:
            merged = ranks.get(words[left] + words[right])
            if merged is not None and merged < until:
                return False
            if made(left) < 0 and made(right) < 0:
                return True
            if made(left) > made(right):
                until = left
                left = self.halves[left][1]
            else:
                until = right + 1
                right = self.halves[right][0]

    def _clear(self) -> None:
        #: a state is ((last token, trie node of the rest), ...) of its live prefixes, oldest first
        self._states: list[tuple] = [((-1, 0),)]
        self._numbers: dict[tuple, int] = {self._states[0]: 0}
        #: for each state: byte to (next state, token that ends here)
        self._moves: list[dict[int, tuple[int, int]]] = [{}]

    def _compile(self, number: int, byte: int) -> tuple[int, int]:
        alive, ended = [], -1
        for last, node in self._states[number]:
            child = self.trie[node].get(byte)
            if child is None:
                continue
            token = self.token_at[child]
            if token >= 0 and ended < 0 and (last < 0 or self.may_follow(last, token)):
                ended = token
            if self.trie[child]:
                alive.append((last, child))
        alive.append((ended, 0))
        state = tuple(alive)
        to = self._numbers.get(state)
        if to is None:
            to = self._numbers[state] = len(self._states)
            self._states.append(state)
            self._moves.append({})
        move = self._moves[number][byte] = (to, ended)
        return move

    def _emit(self, ended: list[int]) -> list[int]:
        """The tokens of a stretch, from those that end at each of its bytes."""
        out, at, words = [], len(ended), self.words
        while at:
            token = ended[at - 1]
            out.append(token)
            at -= len(words[token])
        out.reverse()
        return out

    def _settled(self, state: int, ended: list[int]) -> int:
        """Up to where the encodings of all live prefixes are the same.

        Each prefix goes back token by token; the one that is furthest takes the next
        step, until all have met.
        """
        at = {len(ended) - self.depth[node] for _, node in self._states[state]}
        while len(at) > 1:
            top = max(at)
            at.remove(top)
            at.add(top - len(self.words[ended[top - 1]]))
        return at.pop()

    def stream(self, word: Iterable[int]) -> Iterator[list[int]]:
        """Tokens of a word of bytes as soon as they are settled, in parts."""
        ended: list[int] = []
        state, moves, due = 0, self._moves, LOOKAHEAD
        for byte in word:
            state, token = moves[state].get(byte) or self._compile(state, byte)
            ended.append(token)
            if len(ended) >= due:
                settled = self._settled(state, ended)
                if settled:
                    yield self._emit(ended[:settled])
                    del ended[:settled]
                due = len(ended) + LOOKAHEAD
        yield self._emit(ended)

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one word. A word that is itself a token is that token."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(self._states) >= MAX_STATES:
            self._clear()
        return [token for part in self.stream(word) for token in part]


class Utf8:
    """UTF-8 as a byte automaton (Unicode, table 3-7).

    A state is (bytes still due, least and greatest next byte, value so far); START
    waits for a character. A byte that cannot follow ends what was begun, which becomes
    one U+FFFD, and is read anew from START.
    """

    START = (0, 0, 0, 0)
    #: First bytes (from, to), bytes due after them, bounds of the next byte, and the bits of the value.
    FIRST = (
        (0xC2, 0xDF, 1, 0x80, 0xBF, 0x1F),
        (0xE0, 0xE0, 2, 0xA0, 0xBF, 0x0F),
        (0xE1, 0xEC, 2, 0x80, 0xBF, 0x0F),
        (0xED, 0xED, 2, 0x80, 0x9F, 0x0F),
        (0xEE, 0xEF, 2, 0x80, 0xBF, 0x0F),
        (0xF0, 0xF0, 3, 0x90, 0xBF, 0x07),
        (0xF1, 0xF3, 3, 0x80, 0xBF, 0x07),
        (0xF4, 0xF4, 3, 0x80, 0x8F, 0x07),
    )

    @classmethod
    def step(cls, state: tuple[int, int, int, int], byte: int) -> tuple[tuple[int, int, int, int], str]:
        """The next state and the text that the byte completes."""
        due, low, high, value = state
        if due:
            if low <= byte <= high:
                value = value << 6 | byte & 0x3F
                return (cls.START, chr(value)) if due == 1 else ((due - 1, 0x80, 0xBF, value), "")
            after, text = cls.step(cls.START, byte)
            return after, "\ufffd" + text
        if byte < 0x80:
            return cls.START, chr(byte)
        for first, last, more, low, high, bits in cls.FIRST:
            if first <= byte <= last:
                return (more, low, high, byte & bits), ""
        return cls.START, "\ufffd"

    @classmethod
    def run(cls, state: tuple[int, int, int, int], data: bytes) -> tuple[tuple[int, int, int, int], str]:
        out = []
        for byte in data:
            state, text = cls.step(state, byte)
            out.append(text)
        return state, "".join(out)


class Pieces(dict):
    """What tokens do: state to token to (next state, text); starts anew after MAX_PIECES."""

    def __init__(self, words: dict[int, bytes]):
        self.words, self.number = words, 0

    def compile(self, state: tuple[int, int, int, int], token: int) -> tuple[tuple[int, int, int, int], str]:
        if self.number >= MAX_PIECES:
            self.clear()
            self.number = 0
        self.number += 1
        piece = self.setdefault(state, {})[token] = Utf8.run(state, self.words[token])
        return piece


class StreamingDecoder:
    """Token ids to text, part by part, by the UTF-8 automaton.

    What a token does in a state, the text it gives and the state it leads to, is worked
    out byte by byte when first met and kept in Pieces, which decoders may share.
    Bytes that no valid text has become U+FFFD, as soon as that is certain.
    """

    def __init__(self, words: dict[int, bytes], pieces: Pieces | None = None):
        self.pieces, self.state = Pieces(words) if pieces is None else pieces, Utf8.START

    def feed(self, ids: Iterable[int]) -> str:
        state, pieces, out = self.state, self.pieces, []
        moves = pieces.get(state, {})
        for token in ids:
            piece = moves.get(token)
            if piece is None:
                piece = pieces.compile(state, token)
                moves = pieces[state]
            after, text = piece
            out.append(text)
            if after is not state:
                state = after
                moves = pieces.get(state, {})
        self.state = state
        return "".join(out)

    def finish(self) -> str:
        """What is left at the end: U+FFFD for an unfinished character."""
        rest, self.state = "\ufffd" * (self.state != Utf8.START), Utf8.START
        return rest


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.transducer, self.split = Transducer(ranks), Splitter(pattern)
        self.pieces = Pieces(self.transducer.words)
        codec = self

        class Known(dict):  # word to its ids, packed
            def __missing__(self, word: str) -> bytes:
                if len(self) >= MAX_WORDS:
                    self.clear()
                ids = codec.transducer.encode(word.encode("utf-8", "surrogatepass"))
                packed = self[word] = struct.pack(f"<{len(ids)}I", *ids)
                return packed

        self.known = Known()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.split(text))), dtype="<u4")

    def decode(self, ids: np.ndarray, part: int = 8192) -> Iterator[str]:
        stream = StreamingDecoder(self.transducer.words, self.pieces)
        for at in range(0, len(ids), part):
            yield stream.feed(ids[at : at + part].tolist())
        yield stream.finish()


_codecs: dict[tuple, Codec] = {}


def _codec(data: bytes, pattern: str) -> Codec:
    """One codec for a Python worker, kept between its tasks."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(data), pattern)
    return _codecs[key]


def _mapped(df: DataFrame, schema: str, data: bytes, pattern: str, columns: Callable[[Codec, pa.Array], list[pa.Array]]) -> DataFrame:
    """(key, x) to (key, columns made of x). The rank file, a fixed-size table, is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            made = columns(codec, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[str(i) for i in range(len(made) + 1)])

    return df.mapInArrow(run, schema)


def rank_file(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return file.read()


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text, without special tokens.

    Null counts as empty; an empty text has no ids. Repeated rows stay repeated, other
    columns are not read, an empty table gives an empty table.
    """

    def columns(codec: Codec, texts: pa.Array) -> list[pa.Array]:
        return [pa.array([codec.encode(t.as_py() or "").astype(np.int32) for t in texts], pa.list_(pa.int32()))]

    return _mapped(documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), "doc_id long, ids array<int>", rank_file(path), pattern, columns)


def decode(tokens: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) of each row's ids; null ids count as none. Broken UTF-8 gives U+FFFD."""

    def columns(codec: Codec, lists: pa.Array) -> list[pa.Array]:
        return [pa.array(["".join(codec.decode(np.asarray(x.as_py() or [], dtype="<u4"))) for x in lists], pa.string())]

    return _mapped(tokens.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{ids}`").alias("ids")), "doc_id long, text string", rank_file(path), public_tokenizers.PATTERN, columns)


def round_trip(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of encoding and of decoding those ids again.

    As `encode` then `decode`, without moving the ids out of the Python worker.
    """

    def columns(codec: Codec, texts: pa.Array) -> list[pa.Array]:
        n, coded, decoded = [], [], []
        for t in texts:
            ids = codec.encode(t.as_py() or "")
            digest = hashlib.sha256()
            for part in codec.decode(ids):
                digest.update(part.encode())
            n.append(len(ids))
            coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
            decoded.append(digest.hexdigest())
        return [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), schema, rank_file(path), pattern, columns)


def op2_bpe(documents: DataFrame) -> DataFrame:
    """Per document the digests of its ids and of the text decoded from them."""
    return round_trip(documents)
