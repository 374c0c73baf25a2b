"""Quality: random-indexing word vectors, pooled, and a two-layer network in numpy.

Every word bucket has a sparse random index vector; its context vector is the sum of
the index vectors around it over all documents. A document is the mean of both, with
what the means say about repetition, and a small network, its probabilities calibrated
by a temperature, scores it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType

from hitweave.llm.labelled import held_out, training_rows

#: Labelled rows of either class that training takes at most.
SAMPLE_EACH = 3000
BUCKETS, SIZE, ONES, WINDOW = 1 << 13, 32, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, SEED = 32, 60, 64, 0.02, 9
LEAST = 0.3
MAX_WORDS, STRETCH = 200_000, 200_000
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def index_vectors() -> np.ndarray:
    """[BUCKETS, SIZE]: ONES random places of each row hold 1 or -1, the same in every run."""
    rng = np.random.default_rng(SEED)
    table = np.zeros((BUCKETS, SIZE), np.float32)
    places = rng.permuted(np.tile(np.arange(SIZE), (BUCKETS, 1)), axis=1)[:, :ONES]
    np.put_along_axis(table, places, rng.choice(np.float32([-1, 1]), (BUCKETS, ONES)), axis=1)
    return table


class Tokens:
    """Word buckets of texts: runs of letters and digits, and runs of other signs.

    Words are lower-cased unless they are all capitals, which says something of its own.
    """

    def __init__(self):
        class Known(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= MAX_WORDS:
                    self.clear()
                key = word if len(word) > 1 and word.isupper() else word.lower()
                bucket = self[word] = zlib.crc32(key.encode("utf-8", "surrogatepass")) % BUCKETS
                return bucket

        self.known = Known()

    def __call__(self, text: str | None) -> np.ndarray:
        words = _TOKEN.findall(text or "")
        return np.fromiter(map(self.known.__getitem__, words), np.uint16, len(words))


def _add_contexts(sums: np.ndarray, index: np.ndarray, ids: np.ndarray) -> None:
    """Adds what surrounds each token to its bucket's row."""
    for at in range(0, len(ids), STRETCH):
        left, right = max(0, at - WINDOW), min(len(ids), at + STRETCH + WINDOW)
        around = index[ids[left:right]]
        total = np.zeros_like(around)
        for w in range(1, WINDOW + 1):
            total[w:] += around[:-w]
            total[:-w] += around[w:]
        own = ids[at : at + STRETCH]
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])
        sums[own[order][starts]] += np.add.reduceat(total[at - left : at - left + len(own)][order], starts, axis=0)


def context_vectors(documents: DataFrame, text: str = "text") -> np.ndarray:
    """[BUCKETS, SIZE]: context vectors over all documents, of unit length; unseen buckets are zero.

    Each task adds up its own rows; the cluster adds those up. Only the table, of fixed
    size, comes to the driver.
    """
    index = np.vstack([index_vectors(), np.zeros((1, SIZE), np.float32)])
    gap = np.full(WINDOW, BUCKETS, np.uint16)  # of the zero vector: no text is context of another
    names = [f"c{i}" for i in range(SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums = Tokens(), np.zeros((BUCKETS + 1, SIZE))
        for batch in batches:
            waiting, n = [], 0
            for t in batch.column(0):
                ids = tokens(t.as_py())
                if len(ids):
                    waiting += [ids, gap]
                    n += len(ids)
                if n >= STRETCH:
                    _add_contexts(sums, index, np.concatenate(waiting))
                    waiting, n = [], 0
            if waiting:
                _add_contexts(sums, index, np.concatenate(waiting))
        used = np.flatnonzero(sums[:BUCKETS].any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(sums[used, i]) for i in range(SIZE))], names=["bucket", *names])

    partial = documents.select(F.col(f"`{text}`")).mapInArrow(run, "bucket int, " + ", ".join(f"{c} double" for c in names))
    table = np.zeros((BUCKETS, SIZE))
    for row in partial.groupBy("bucket").agg(*(F.sum(c) for c in names)).toLocalIterator():
        table[row[0]] = row[1:]
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


FEATURES = 2 * SIZE + 4


def features(ids: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Pooled vectors of a text: means of index and context vectors, repetition, size."""
    out = np.zeros(FEATURES)
    if len(ids):
        for at in range(0, len(ids), STRETCH):
            out[: 2 * SIZE] += both[ids[at : at + STRETCH]].sum(axis=0, dtype=np.float64)
        out[: 2 * SIZE] /= len(ids)
        out[2 * SIZE] = out[:SIZE] @ out[:SIZE] / ONES  # about the chance that two words are the same
        out[2 * SIZE + 1] = np.mean(ids[1:] == ids[:-1]) if len(ids) > 1 else 0.0
        out[2 * SIZE + 2] = out[SIZE : 2 * SIZE] @ out[SIZE : 2 * SIZE]
    out[2 * SIZE + 3] = np.log1p(len(ids)) / 10
    return out


def pooled(documents: DataFrame, both: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """The `keep` columns and x array<double>, the pooled features of each text."""
    return _mapped(documents, both, keep, text, "x", ArrayType(DoubleType()), lambda x: pa.array(list(x), pa.list_(pa.float64())))


def _mapped(documents: DataFrame, both: np.ndarray, keep: list[str], text: str, out: str, kind: DataType, finish) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(both)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            x = np.array([features(tokens(t.as_py()), shared.value) for t in batch.column(batch.num_columns - 1)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], finish(x)], names=[*keep, out])

    kept = [F.col(f"`{c}`") for c in keep]
    source = documents.select(*kept, F.col(f"`{text}`")).toDF(*(f"c{i}" for i in range(len(keep) + 1)))  # mapInArrow takes no names with dots
    return source.mapInArrow(run, documents.select(*kept).schema.add(out, kind))


def train(x: np.ndarray, y: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Two-layer network by Adam; then its odds are set to the labels' `share` of ones and a temperature is fitted on a fifth kept back."""
    rng = np.random.default_rng(seed)
    kept = np.arange(len(x)) % 5 == 0 if len(x) >= 50 else np.zeros(len(x), bool)
    mean, spread = x[~kept].mean(axis=0), x[~kept].std(axis=0) + 1e-3
    z, t = (x[~kept] - mean) / spread, y[~kept]
    p = {"w1": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(order), BATCH):
            a, b = z[order[at : at + BATCH]], t[order[at : at + BATCH]]
            h = np.maximum(a @ p["w1"] + p["b1"], 0)
            d = (1 / (1 + np.exp(-(h @ p["w2"] + p["b2"]))) - b) / len(b)
            dh = d[:, None] * p["w2"] * (h > 0)
            grads = {"w1": a.T @ dh + 1e-4 * p["w1"], "b1": dh.sum(axis=0), "w2": h.T @ d + 1e-4 * p["w2"], "b2": np.array([d.sum()])}
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= RATE * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = {**p, "mean": mean, "spread": spread, "temperature": np.array(1.0), "offset": np.array(0.0)}
    rate = t.mean() if len(t) else 0.5
    if 0 < rate < 1 and 0 < share < 1:
        model["offset"] = np.array(np.log(share / (1 - share)) - np.log(rate / (1 - rate)))
    if kept.any():
        raw, own = logits(model, x[kept]), y[kept]
        weight = np.where(own == 1, share / max(rate, 1e-9), (1 - share) / max(1 - rate, 1e-9))
        grid = np.geomspace(1, 8, 60)
        loss = [np.average(np.logaddexp(0, np.where(own == 1, -1, 1) * (raw + model["offset"]) / g), weights=weight) for g in grid]
        model["temperature"] = np.array(grid[int(np.argmin(loss))])
    return model


def logits(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    h = np.maximum((x - model["mean"]) / model["spread"] @ model["w1"] + model["b1"], 0)
    return h @ model["w2"] + model["b2"][0]


def probabilities(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(logits(model, x) + model["offset"]) / model["temperature"]))


def fit(documents: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Word vectors from all documents; a network from up to `each` labelled rows of either class.

    Held-out labels are not read. Of an id's several texts the one with the least
    features counts. Unless there are rows of both classes, the scores are constant: the
    share of good labels, or almost 1 if there are no labels.
    """
    both = np.hstack([index_vectors(), context_vectors(documents)])
    chosen = training_rows(labels, "quality", each)
    rows = pooled(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), both, ["doc_id", "label"])
    rows = rows.groupBy("doc_id").agg(F.min("x").alias("x"), F.max("label").alias("label")).collect()
    rows.sort(key=lambda r: (zlib.crc32(f"{r['doc_id']}!".encode()), str(r["doc_id"])))
    share = labels.where(~held_out()).agg(F.avg("quality")).first()[0]
    y = np.array([float(r["label"]) for r in rows])
    if not 0 < y.sum() < len(y):
        return both, constant_model(1.0 if share is None else share)
    return both, train(np.array([r["x"] for r in rows]), y, share)


def constant_model(share: float) -> dict[str, np.ndarray]:
    """A model that scores every text alike."""
    model = train(np.zeros((1, FEATURES)), np.ones(1), 0.5, 0)
    model["w2"][:], model["offset"], model["temperature"] = 0, np.array(0.0), np.array(1.0)
    model["b2"] = np.array([np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -6, 6)])
    return model


def score(documents: DataFrame, both: np.ndarray, model: dict[str, np.ndarray], out: str = "score", text: str = "text") -> DataFrame:
    """Adds `out`, the probability that a whole text is good; a null text counts as empty.

    Other columns pass through, `out` is replaced if it is there, repeated rows stay
    repeated, an empty table stays empty.
    """
    keep = [c for c in documents.columns if c != out]
    return _mapped(documents, both, keep, text, out, DoubleType(), lambda x: pa.array(probabilities(model, x)))


def op5_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document its score and prediction."""
    both, model = fit(documents, labels)
    scored = score(documents.select("doc_id", "text"), both, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
