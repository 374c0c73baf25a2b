"""Collocations: frequent phrases of adjacent words, mined by pivot.

The pivot of a phrase is its rarest word, so every phrase is counted at one place only.
Texts are rewritten as ranks of their frequent words; around each word goes a fragment
of those neighbours that are not rarer, as far as a phrase with that pivot can reach,
to the bucket of the pivot. There the phrases that hold the pivot are counted, longer
ones only where the shorter one inside is frequent. Frequent pivots are dealt over
several buckets, whose counts are added up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.heavy import most_frequent
from hitweave.session import stored

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words that are broadcast with their ranks, and the bytes that such a word may have.
HOT_WORDS, WORD_BYTES = 300_000, 64
#: Fragments of one pivot that go to one bucket, all fragments of a bucket, and those that a task hands on together.
OF_PIVOT, OF_BUCKET, TOGETHER = 250_000, 500_000, 1_000_000
#: Different words that a task adds up before it hands them on; bytes of text that are cut at once.
PARTIAL, STRETCH = 500_000, 1 << 22
UND = "und"
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(10 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_REACH = LONGEST - 1


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of `text` with line feeds between pieces and empty strings, stretch by stretch, cut at ends of words."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        end = at + STRETCH
        end = len(text) if end >= len(text) or text.find(b" ", end) < 0 else text.find(b" ", end)
        yield text[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


def word_counts(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n): occurrences of each word; where word is null, of all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for of, t in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                mine = counts.setdefault(of.as_py(), Counter())
                for words in _words(t.as_py()):
                    mine.update(words)
                if len(mine) > PARTIAL:
                    yield row(counts)
                    counts = {}
            if sum(map(len, counts.values())) > PARTIAL:
                yield row(counts)
                counts = {}
        yield row(counts)

    def row(counts: dict[str, Counter]) -> pa.RecordBatch:
        of: list[str] = []
        words: list[bytes | None] = []
        n: list[int] = []
        for k, mine in counts.items():
            del mine[b""], mine[b"\n"]
            of += [k] * (len(mine) + 1)
            words += [*mine, None]
            n += [*mine.values(), sum(mine.values())]
        return pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    parts = _texts(documents, text, lang).mapInArrow(run, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n")).where("n > 0")


def _texts(documents: DataFrame, text: str, lang: str) -> DataFrame:
    return documents.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UND)).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def reach(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far to the left and to the right of each place phrases reach whose pivot it is.

    The pivot is the first of the largest numbers; negative numbers end pieces.
    """
    wide = np.concatenate([np.full(_REACH, -1), ids, np.full(_REACH, -1)])
    at = lambda j: wide[_REACH + j : len(wide) - _REACH + j]
    sides = []
    for step in (-1, 1):
        going, far = ids >= 0, np.zeros(len(ids), np.int8)
        for j in range(1, LONGEST):
            other = at(step * j)
            going = going & (other >= 0) & ((other < ids) if step < 0 else (other <= ids))
            far += going
        sides.append(far)
    return sides[0], sides[1]


def _packed(flat: np.ndarray, left: np.ndarray, right: np.ndarray) -> bytes:
    """Fragments as bytes: how far each reaches, then its words in planes of two bytes and one."""
    return np.int64([len(left), len(flat)]).tobytes() + (left << 4 | right).astype(np.uint8).tobytes() + (flat & 0xFFFF).astype("<u2").tobytes() + (flat >> 16).astype(np.uint8).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    """[fragments, 2 * reach + 1]: words around the pivot in the middle, -1 where there is none."""
    n, words = np.frombuffer(blob, np.int64, 2)
    far = np.frombuffer(blob, np.uint8, n, 16)
    flat = np.frombuffer(blob, "<u2", words, 16 + n).astype(np.int32) | np.frombuffer(blob, np.uint8, words, 16 + n + 2 * words).astype(np.int32) << 16
    place = np.arange(-_REACH, LONGEST)
    out = np.full((n, 2 * _REACH + 1), -1, np.int32)
    out[(place >= -(far >> 4).astype(np.int8)[:, None]) & (place <= (far & 15).astype(np.int8)[:, None])] = flat
    return out


def mined(around: np.ndarray, alone: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """([phrases, length] word numbers, counts) of the phrases with the pivot in the middle of `around`.

    Where the pivot is `alone` (all its fragments are here), phrases below `least` are
    left out and never grow longer. No phrase comes twice: where its pivot stands in it
    is given by its words.
    """
    alone = alone[around[:, _REACH]]
    rows = np.arange(len(around))
    states = {(0, 0): (rows, around[:, _REACH].astype(np.int64))}
    for size in range(2, LONGEST + 1):
        longer = {}
        for first in range(-size + 1, 1):
            last = first + size - 1
            before, own = ((first, last - 1), last) if last > 0 else ((first + 1, 0), first)
            if before not in states:
                continue
            rows, code = states[before]
            word = around[rows, _REACH + own]
            there = word >= 0
            rows, keys = rows[there], code[there] << 32 | word[there]
            if not len(rows):
                continue
            _, example, code, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            keep = (n >= least) | ~alone[rows[example]]
            if not keep.any():
                continue
            yield around[rows[example[keep]], _REACH + first : _REACH + last + 1], n[keep]
            longer[first, last] = rows[keep[code]], code[keep[code]]
        states = longer


def _fragments(documents: DataFrame, ranks, parts: np.ndarray, buckets: int, text: str, lang: str) -> DataFrame:
    """(bucket, blob): fragments of known words, many in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: {**words, b"\n": -1, b"": -2} for k, words in ranks.value.items()}
        nothing = {b"": -2}
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            ids, many = [], 0
            for of, t in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                get = known.get(of.as_py(), nothing).get
                for words in _words(t.as_py()):
                    ids.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
                    many += len(words)
                ids.append(np.int32([-1]))
                if many >= TOGETHER:
                    waiting.append(cut(ids))
                    size, ids, many = size + len(waiting[-1][1]), [], 0
                if size >= TOGETHER:
                    yield dealt(waiting)
                    waiting, size = [], 0
            if ids:
                waiting.append(cut(ids))
                size += len(waiting[-1][1])
            if size >= TOGETHER:
                yield dealt(waiting)
                waiting, size = [], 0
        if size:
            yield dealt(waiting)

    def cut(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.concatenate(ids)
        row = row[row != -2]
        left, right = reach(row)
        at = np.flatnonzero(left + right > 0)
        left, right = left[at], right[at]
        sizes = left.astype(np.int64) + right + 1
        flat = row[np.repeat(at - left - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        return flat, left, right

    def dealt(waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        flat, left, right = (np.concatenate(x) for x in zip(*waiting, strict=True))
        sizes = left.astype(np.int64) + right + 1
        starts = np.cumsum(sizes) - sizes
        pivot = flat[starts + left].astype(np.int64)
        part = np.arange(len(pivot)) % parts[pivot]
        bucket = (pivot * 0x9E3779B1 + part * 0x85EBCA77 >> 7) % buckets
        order = np.argsort(bucket, kind="stable")
        flat = flat[np.repeat(starts[order] - np.cumsum(sizes[order]) + sizes[order], sizes[order]) + np.arange(len(flat))]
        left, right, bucket = left[order], right[order], bucket[order]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        upto = [*first[1:].tolist(), len(bucket)]
        words = np.r_[0, np.cumsum(sizes[order])]
        blobs = [_packed(flat[words[i] : words[j]], left[i:j], right[i:j]) for i, j in zip(first.tolist(), upto, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return _texts(documents, text, lang).mapInArrow(run, "bucket int, blob binary")


def _counted(fragments: DataFrame, names, parts: np.ndarray, buckets: int, least: int) -> DataFrame:
    """(lang, phrase, m, n): counts of each bucket's phrases, whole where the pivot is in one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [_unpacked(b.as_py()) for batch in batches for b in batch.column(1)]
        if not blobs:
            return
        words, langs = names.value
        for phrases, n in mined(np.concatenate(blobs), parts == 1, least):
            for at in range(0, len(n), 50_000):
                some = phrases[at : at + 50_000].tolist()
                columns = [pa.array([langs[p[0]] for p in some], pa.string()), pa.array([b" ".join([words[i] for i in p]) for p in some], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([phrases.shape[1]] * len(some), pa.int32()), pa.array(n[at : at + 50_000])], names=["lang", "phrase", "m", "n"])

    return fragments.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "lang string, phrase string, m int, n long")


def _of_rare_pivots(documents: DataFrame, ranks, rare: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, phrase, m, n) of phrases whose pivot is not broadcast, for vocabularies beyond the bound.

    Such words count as rarer than those that are, and are ordered by their bytes; their
    fragments are rows, and those around words that are not in `rare` go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: {**words, b"\n": -1} for k, words in ranks.value.items()}
        for batch in batches:
            of, pivots, fragments, befores = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                mine = known.get(k, {b"\n": -1})
                words = [w for part in _words(t.as_py()) for w in part if w]
                most = 1 << 24  # above all ranks
                new = {w: most + i for i, w in enumerate(sorted(set(words).difference(mine)))}
                ids = np.fromiter((mine[w] if w in mine else new[w] for w in words), np.int64, len(words))
                left, right = reach(ids)
                at = np.flatnonzero((left + right > 0) & (ids >= most))
                for i, before, after in zip(at.tolist(), left[at].tolist(), right[at].tolist(), strict=True):
                    of.append(k)
                    pivots.append(words[i])
                    fragments.append(words[i - before : i + after + 1])
                    befores.append(before)
            text_of = lambda x: pa.array(x, pa.binary()).cast(pa.string())
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, fragments)]).astype(np.int32), text_of([w for f in fragments for w in f]))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), text_of(pivots), lists, pa.array(befores, pa.int32())], names=["lang", "word", "words", "before"])

    rows = _texts(documents, text, lang).mapInArrow(run, "lang string, word string, words array<string>, before int")
    rows = rows.join(rare.select("lang", "word"), ["lang", "word"], "left_semi")
    inside = F.expr(f"""flatten(transform(sequence(0, before), s -> transform(
        filter(sequence(2, {LONGEST}), m -> s + m > before AND s + m <= size(words)), m -> struct(array_join(slice(words, s + 1, m), ' ') AS phrase, m))))""")
    return rows.select("lang", F.explode(inside).alias("x")).groupBy("lang", "x.phrase", F.col("x.m").alias("m")).agg(F.count("*").alias("n"))


def frequent_phrases(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, hot: int = HOT_WORDS, counts: DataFrame | None = None) -> DataFrame:
    """(lang, phrase, m, n): the phrases of 2 to 5 words that occur at least `least` times within pieces, overlaps included.

    The `hot` most frequent words are broadcast as ranks; phrases with others are mined
    from rows, so the result is whole for any vocabulary.
    """
    spark = documents.sparkSession
    counts = stored(word_counts(documents, text, lang).where(f"word IS NULL OR n >= {int(least)}")) if counts is None else counts
    words = counts.where(f"word IS NOT NULL AND n >= {int(least)}")
    short = most_frequent(words.where(F.octet_length("word") <= WORD_BYTES), hot)
    rows = sorted((tuple(r) for r in short.select("n", "lang", "word").toArrow().to_pandas().itertuples(index=False)), key=lambda r: (-r[0], r[1], r[2]))
    ranks: dict[str, dict[bytes, int]] = {}
    for i, (_, of, word) in enumerate(rows):
        ranks.setdefault(of, {})[word.encode()] = i
    size = counts.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    parts = np.array([-(-n // OF_PIVOT) for n, _, _ in rows] or [1], np.int64)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // OF_BUCKET))
    known = spark.sparkContext.broadcast(ranks)
    names = spark.sparkContext.broadcast(([r[2].encode() for r in rows], [r[1] for r in rows]))
    found = _counted(_fragments(documents, known, parts, buckets, text, lang), names, parts, buckets, least)
    if words.count() > len(rows):
        rare = words.join(spark.createDataFrame([(r[1], r[2]) for r in rows], "lang string, word string"), ["lang", "word"], "left_anti")
        found = found.unionByName(_of_rare_pivots(documents, known, rare, text, lang))
    return found.groupBy("lang", "phrase", "m").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, hot: int = HOT_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases.

    A phrase that occurs a times is cut where score = floor(1000 * a * n / (l * r)) is
    lowest, the first such place; l and r are the counts of both parts, n that of all
    words of the language. Phrases inside a longer one with the same count go (one word
    longer is enough to look at: counts only fall). Null texts are empty, a null
    language is `und`, repeated rows count as often as they occur, an empty table gives
    an empty table.
    """
    counts = stored(word_counts(documents, text, lang).where(f"word IS NULL OR n >= {int(least)}"))
    phrases = stored(frequent_phrases(documents, text, lang, least, hot, counts).withColumnRenamed("n", "a"))
    known = phrases.select("lang", "phrase", "a").unionByName(counts.where("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), F.col("n").alias("a")))
    cuts = phrases.select("lang", "phrase", "m", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - m)")})
    for side in ("left", "right"):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("a").alias(side[0])), ["lang", side])
    totals = counts.where("word IS NULL").select("lang", "n")
    whole = lambda *xs: " * ".join(f"CAST({x} AS DECIMAL(38, 0))" for x in xs)
    scored = cuts.join(totals, "lang").withColumn("score", F.expr(f"CAST(({whole('1000', 'a', 'n')}) div ({whole('l', 'r')}) AS LONG)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("x"))
    inner = phrases.where("m > 2")
    within = [inner.select("lang", x.alias("phrase"), "a") for x in (F.expr("substring_index(phrase, ' ', m - 1)"), F.expr("substring_index(phrase, ' ', 1 - m)"))]
    kept = best.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score").join(within[0].unionByName(within[1]), ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "rank", "phrase", *(F.col(c).cast("long") for c in ("a", "l", "r", "n", "score")))


def op12_phrases(documents: DataFrame) -> DataFrame:
    """The best collocations of each language."""
    out = collocations(documents)
    return out.withColumn("rank", F.col("rank").cast("long"))


OP12_SQL = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE m > 1 AND a >= 100),
cuts AS (
    SELECT lang, phrase, m, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS rp
    FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM cand)),
scored AS (
    SELECT c.lang, c.phrase, c.m, c.a, c.k, x.a AS l, y.a AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT DISTINCT lang, array_to_string(string_split(phrase, ' ')[i:i + s - 1], ' ') AS phrase, a
    FROM (SELECT *, unnest(generate_series(1, m - s + 1)) AS i FROM (SELECT *, unnest(generate_series(2, m - 1)) AS s FROM cand WHERE m > 2))),
kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
