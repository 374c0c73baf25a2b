"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams of letters, of one to three signs,
by rank. A document is ranked in the same way, and its distance to a profile is the sum
of how far each of its n-grams is out of place; one that the profile lacks is as far
out as can be.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.llm.heavy import summed
from hitweave.llm.labelled import held_out

#: N-grams of a profile, and languages that profiles are held for at most (living languages are some 7,000).
SIZE, LANGUAGES = 400, 8192
#: Signs of a text that are counted at once, and n-grams that a task adds up before it hands them on.
STRETCH, PARTIAL = 1 << 20, 1 << 20
UND = "und"
_BITS = 21


def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Grams:
    """Counts the n-grams of texts; an n-gram is a number of 21 bits a sign."""

    def __init__(self):
        self.letter = _letters()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Different n-grams, sorted, and their counts.

        Letters are lower-cased, runs of others are one space, which may begin or end an
        n-gram but is none by itself and is never inside one.
        """
        low = (text or "").lower()
        parts = [self._stretch(low, at) for at in range(0, len(low) + 1, STRETCH)]
        return parts[0] if len(parts) == 1 else summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def _stretch(self, text: str, at: int) -> tuple[np.ndarray, np.ndarray]:
        """N-grams that begin from `at` on, counted from a space before the text."""
        n = min(STRETCH, len(text) + 1 - at)
        signs = np.concatenate([np.full(int(at == 0), 32), self._signs(text[max(0, at - 1) : at + STRETCH + 1]), [32, 32]])
        a, b, c = signs[:n], signs[1 : n + 1], signs[2 : n + 2]
        first, second = a != 32, b != 32
        grams = [a[first], (a << _BITS | b)[first | second], (a << 2 * _BITS | b << _BITS | c)[second]]
        return np.unique(np.concatenate(grams), return_counts=True)

    def _signs(self, text: str) -> np.ndarray:
        signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        return np.where(self.letter[signs], signs, 32)


def ranked(keys: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent n-grams, the first first; of equally frequent ones the smaller number."""
    if len(n) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        keys, n = keys[n >= least], n[n >= least]
    return keys[np.argsort(-n, kind="stable")[:size]]


def profiles(documents: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> DataFrame:
    """(lang, gram, n, rank): each language's most frequent n-grams over all rows, ranked from 0.

    Rows with a null language or text are left out, repeated rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size, kept = 0, 0
        for batch in batches:
            for of, t in zip(batch.column(0), batch.column(1), strict=True):
                found = grams(t.as_py())
                waiting.setdefault(of.as_py(), []).append(found)
                size += len(found[0])
                if size > max(PARTIAL, 2 * kept):
                    waiting = {k: [summed(*(np.concatenate(x) for x in zip(*v, strict=True)))] for k, v in waiting.items() if sum(len(x[0]) for x in v)}
                    size = kept = sum(len(v[0][0]) for v in waiting.values())
                    if kept > PARTIAL:
                        yield row(waiting)
                        waiting, size, kept = {}, 0, 0
        yield row(waiting)

    def row(waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
        merged = {k: summed(*(np.concatenate(x) for x in zip(*v, strict=True))) for k, v in waiting.items() if sum(len(x[0]) for x in v)}
        of = [k for k, v in merged.items() for _ in range(len(v[0]))]
        columns = [np.concatenate([np.zeros(0, np.int64), *(v[i] for v in merged.values())]) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(of, pa.string()), *map(pa.array, columns)], names=["lang", "gram", "n"])

    rows = documents.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)


class Profiles:
    """Profiles as one table of ranks, for all their n-grams and languages."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        """`rows` are (lang, gram, rank)."""
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        of = {k: i for i, k in enumerate(self.langs)}
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int32)
        if rows:
            self.ranks[np.searchsorted(self.grams, [r[1] for r in rows]), [of[r[0]] for r in rows]] = [r[2] for r in rows]

    def nearest(self, best: np.ndarray) -> tuple[str, float]:
        """The language of least distance (of equal ones the first by name) and a score.

        The score is one less the distance as a share of the largest there is.
        """
        if not len(best) or not self.langs:
            return UND, 0.0
        at = np.minimum(np.searchsorted(self.grams, best), len(self.grams) - 1)
        known = self.grams[at] == best
        ranks = self.ranks[at[known]]
        out = np.where(ranks < 0, self.size, np.abs(ranks - np.flatnonzero(known)[:, None]))
        distance = out.sum(axis=0) + self.size * (len(best) - int(known.sum()))
        k = int(distance.argmin())
        return self.langs[k], float(1 - distance[k] / (self.size * len(best)))


def predict(documents: DataFrame, learned: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, lang_pred, score) of each row, by profiles as `profiles` gives them.

    Texts that are null or have no letter are `und` with score 0, and so are all where
    nothing was learned. Repeated rows and null ids stay; an empty table gives an empty
    table. At most 8,192 languages times `size` n-grams are broadcast; more languages
    are an error.
    """
    rows = learned.select("lang", "gram", "rank").limit(LANGUAGES * size + 1).toArrow().to_pydict()
    if len(set(rows["lang"])) > LANGUAGES:
        raise ValueError(f"profiles are held for {LANGUAGES} languages at most")
    shared = documents.sparkSession.sparkContext.broadcast(Profiles(list(zip(rows["lang"], rows["gram"], rows["rank"], strict=True)), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, known = Grams(), shared.value
        for batch in batches:
            found = [known.nearest(ranked(*grams(t.as_py()), size)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op13_langid(documents: DataFrame) -> DataFrame:
    """Every document's language, learned from those that are not held out."""
    learned = profiles(documents.where(~held_out()))
    return predict(documents, learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
