"""Toxicity: a convolutional text classifier trained in numpy.

Words are embedded by hashing (the word and its beginnings), filters of several widths
run over the whole text, and the maximum of each filter goes into a logistic layer.
Training takes all labelled rows that may be learnt from, dealt into groups of bounded
size: in each round a task goes on from the common model over the rows of a group, and
what the groups changed is averaged. Scoring is one narrow stage.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.llm.labelled import held_out, learnable
from hitweave.session import cut

#: Labelled rows of a group on average, and signs of such a row; longer texts are as many rows as they have windows of that length.
GROUP, SAMPLE_SIGNS = 2000, 1 << 15
#: Rounds, passes over a group in each, and what a change of 1 counts as: whole numbers, whose sum does not depend on their order.
ROUNDS, PASSES, UNIT = 2, 3, 1 << 20
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 15, 12, 6, (1, 2, 3)
BEGINNINGS = (4, 5)
EPOCHS, BATCH, RATE, SEED = 12, 100, 0.08, 5
MAX_WORDS, STRETCH = 80_000, 200_000
GRID = np.linspace(0.05, 0.95, 19)
#: Words of texts that are scored together.
TOGETHER = 1 << 14
_WORD = re.compile(r"\w+")
_TABLES, PAD = 1 + len(BEGINNINGS), max(WIDTHS) - 1


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits; an underscore parts words."""
    return _WORD.findall((text or "").lower().replace("_", " "))


def buckets_of(word: str) -> list[int]:
    """The rows of the embedding table that make up a word's vector."""
    keys = [word, *(f"{n}:{word[:n]}" for n in BEGINNINGS)]
    return [_bucket(k) + i * BUCKETS for i, k in enumerate(keys)]


def _bucket(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % BUCKETS


class _Beginnings(dict):
    """The bucket of each beginning of `n` signs."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, beginning: str) -> int:
        bucket = self[beginning] = _bucket(f"{self.n}:{beginning}")
        return bucket


class Words(dict):
    """Numbers of words, from 1 on as they come; `rows` has what `buckets_of` gives for each. Word 0 is padding, whose vector stays zero."""

    def __init__(self):
        super().__init__()
        self.rows = np.full((1, _TABLES), _TABLES * BUCKETS, np.int32)
        self._new: list[str] = []
        self._beginnings = [_Beginnings(n) for n in BEGINNINGS]

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self) + 1
        self._new.append(word)
        return number

    def ids(self, words: list[str]) -> np.ndarray:
        """Their numbers; rows of new words follow with `settled`."""
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def settled(self) -> np.ndarray:
        """The rows of the words that are new since the last call, which `rows` now has too, in place where there is room."""
        new, self._new = self._new, []
        start = len(self) + 1 - len(new)
        if len(self) >= len(self.rows):
            self.rows = np.vstack([self.rows[:start], np.empty((start + 2 * len(new), _TABLES), np.int32)])
        own = self.rows[start : len(self) + 1]
        own[:, 0] = np.fromiter(map(_bucket, new), np.int64, len(new))
        for i, known in enumerate(self._beginnings, 1):
            own[:, i] = np.fromiter((known[w[: known.n]] for w in new), np.int64, len(new)) + i * BUCKETS
        return own

    def clear(self) -> None:
        super().clear()
        self._new.clear()
        for known in self._beginnings:
            known.clear()


def _segment_max(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum and its first place for each segment of rows; segments are not empty."""
    starts = np.cumsum(lengths) - lengths
    top = np.maximum.reduceat(values, starts, axis=0)
    hit = values == np.repeat(top, lengths, axis=0)
    row, column = np.nonzero(hit)
    segment = np.searchsorted(starts, row, side="right") - 1
    place = np.full(top.shape, len(values), dtype=np.int64)
    np.minimum.at(place, (segment, column), row)
    return top, place


def train(texts: list[str | None], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, warm: bool = True) -> dict[str, np.ndarray]:
    """Filters, hashed embeddings and output weights, by Adagrad on the logistic loss.

    With `warm`, one component of the embeddings starts as the log-odds of the words in
    the training texts; the README gives held-out figures with and without it.
    """
    present, known = np.zeros((2, _TABLES * BUCKETS + 1)), Words()
    for text, label in zip(texts, labels, strict=True):
        present[int(label), _present(text, known)] += 1  # a row that comes twice counts once
    rng = np.random.default_rng(seed)
    return descended(started(rng, present, [int((labels == k).sum()) for k in (0, 1)], warm), texts, labels, epochs, rng)


def _present(text: str | None, known: Words) -> np.ndarray:
    """The rows of the embedding table that a text has, some of them more than once; `known` keeps those of words."""
    if len(known) > MAX_WORDS:
        known.clear()
    ids = known.ids(words_of(text))
    known.settled()
    return known.rows[ids].ravel()


def started(rng: np.random.Generator, present: np.ndarray, many: list[int], warm: bool = True) -> dict[str, np.ndarray]:
    """The model before training; `present` counts, for each class, the texts with a row of the table, `many` all texts."""
    table = rng.normal(0, 0.1, (_TABLES * BUCKETS + 1, SIZE)).astype(np.float32)
    table[-1] = 0
    model = {"table": table, "bias": np.zeros((len(WIDTHS), FILTERS), np.float32), "out": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "base": np.array([-1.0], np.float32)}
    # a warm start: the first component of a row is how much likelier toxic training texts are to have it
    odds = np.log((present[1] + 0.5) / max(1, many[1])) - np.log((present[0] + 0.5) / max(1, many[0]))
    model |= {f"filter{w}": rng.normal(0, 0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
    if warm:
        table[:-1, 0] = (np.clip(odds, -2, 6) * (present.sum(axis=0) >= 5) / 4)[:-1]
        model["filter1"][0, 0, 0] = 1.0
        model["out"][0] = 1.0
    return model


def descended(model: dict[str, np.ndarray], texts: list[str | None], labels: np.ndarray, epochs: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """The model after so many passes over the texts; it is changed in place."""
    vocabulary = Words()
    docs = [vocabulary.ids(words_of(t)) for t in texts]
    vocabulary.settled()
    rows = vocabulary.rows
    power = {k: np.full(v.shape, 1e-2, np.float32) for k, v in model.items()}

    def step(name: str, grad: np.ndarray, at=slice(None)) -> None:
        power[name][at] += grad * grad
        model[name][at] -= RATE * grad / np.sqrt(power[name][at])

    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for begin in range(0, len(order), BATCH):
            part = order[begin : begin + BATCH]
            padded = [np.r_[docs[i], np.zeros(PAD, np.int64)] if len(docs[i]) else np.zeros(PAD + 1, np.int64) for i in part]
            lengths, ids = np.array([len(x) for x in padded]), np.concatenate(padded)
            x = sum(model["table"][rows[ids, i]] for i in range(_TABLES))
            tops, places = [], []
            for k, w in enumerate(WIDTHS):
                y = sum(np.vstack([x[j:], np.zeros((j, SIZE), np.float32)]) @ model[f"filter{w}"][j] for j in range(w)) + model["bias"][k]
                top, place = _segment_max(y, lengths)
                tops.append(top)
                places.append(place)
            features = np.maximum(np.hstack(tops), 0)
            p = 1 / (1 + np.exp(-(features @ model["out"] + model["base"][0])))
            d = (p - labels[part]).astype(np.float32) / len(part)
            d_features = d[:, None] * model["out"][None, :] * (features > 0)
            step("out", features.T @ d)
            step("base", np.array([d.sum()]))
            d_rows, d_values = [], []
            for k, w in enumerate(WIDTHS):
                g = d_features[:, k * FILTERS : (k + 1) * FILTERS]
                kernel = model[f"filter{w}"]
                grad = np.zeros_like(kernel)
                for j in range(w):
                    at = np.minimum(places[k] + j, len(x) - 1)
                    grad[j] = np.einsum("bfs,bf->sf", x[at], g)
                    d_rows.append(ids[at].ravel())
                    d_values.append((g[:, :, None] * kernel[j].T[None]).reshape(-1, SIZE))
                step("bias", g.sum(axis=0), k)
                step(f"filter{w}", grad)
            at = rows[np.concatenate(d_rows)].ravel()
            touched, inverse = np.unique(at, return_inverse=True)
            grad = np.zeros((len(touched), SIZE), np.float32)
            np.add.at(grad, inverse, np.repeat(np.concatenate(d_values), _TABLES, axis=0))
            grad[touched == _TABLES * BUCKETS] = 0
            step("table", grad, touched)
    return model


class Scorer:
    """Scores whole texts. Each word's response to each filter row is worked out once; short texts are scored together."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.model, self.known = model, Words()
        self.rows = np.zeros((sum(WIDTHS) * FILTERS, 1024), np.float32)  # word 0 is padding

    def _ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > MAX_WORDS:
            known.clear()
        start = len(known) + 1
        ids = known.ids(words)
        end = len(known) + 1
        if end > start:
            if end > self.rows.shape[1]:
                self.rows = np.hstack([self.rows[:, :start], np.zeros((len(self.rows), max(end, min(2 * end, MAX_WORDS)) - start), np.float32)])
            vectors = self.model["table"][known.settled()].sum(axis=1)
            self.rows[:, start:end] = np.hstack([vectors @ self.model[f"filter{w}"][j] for w in WIDTHS for j in range(w)]).T
        return ids

    def features(self, text: str | None) -> np.ndarray:
        words, best = words_of(text), np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        for at in range(0, max(len(words), 1), STRETCH):  # a long text in stretches that overlap
            more = at + STRETCH + PAD < len(words)
            best = np.maximum(best, self._best([words[at : at + STRETCH + PAD]], not more)[0])
        return np.maximum(best, 0)

    def _best(self, texts: list[list[str]], whole: bool = True) -> np.ndarray:
        """The largest response of each filter in each text, which is followed by padding if it is whole."""
        many = np.array([len(t) for t in texts])
        lengths = np.where(many > 0, many + (PAD if whole else 0), PAD + 1)
        starts = np.cumsum(lengths) - lengths
        ids = np.zeros(lengths.sum() + PAD, np.int64)  # a place to end at, for the last one
        ids[np.arange(many.sum()) + np.repeat(starts - np.cumsum(many) + many, many)] = self._ids([w for t in texts for w in t])
        best, row = np.empty((len(texts), len(WIDTHS) * FILTERS), np.float32), 0
        for k, w in enumerate(WIDTHS):
            ends = np.column_stack([starts, starts + lengths - w + 1]).ravel()
            for f in range(FILTERS):
                total = sum(self.rows[row + j * FILTERS + f][ids[j : len(ids) - w + 1 + j]] for j in range(w))
                best[:, k * FILTERS + f] = np.maximum.reduceat(total, ends)[::2] + self.model["bias"][k, f]
            row += w * FILTERS
        return best

    def _gathered(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        waiting, many = [], 0
        for text in texts:
            words = words_of(text)
            if waiting and many + len(words) > TOGETHER:
                yield np.maximum(self._best(waiting), 0)
                waiting, many = [], 0
            if len(words) > STRETCH:
                yield self.features(text)[None]
                continue
            waiting.append(words)
            many += len(words)
        if waiting:
            yield np.maximum(self._best(waiting), 0)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        found = list(self._gathered(texts))
        features = (np.vstack(found) if found else np.zeros((0, len(WIDTHS) * FILTERS))).astype(np.float64)
        return 1 / (1 + np.exp(-(features @ self.model["out"] + self.model["base"][0])))


def thresholds_by_language(scores: np.ndarray, labels: np.ndarray, languages: list[str | None], share: float | None = None, counts: np.ndarray | None = None) -> dict[str | None, float]:
    """For each language the threshold with the best F1; 0.5 where either class is missing.

    With `share`, rows count as if that share of all had label 1, as it has where the scores are used.
    With `counts`, a row stands for so many.
    """
    rate = labels.mean() if len(labels) else 0.0
    weights = np.where(labels == 1, share / rate, (1 - share) / (1 - rate)) if share and 0 < rate < 1 else np.ones(len(labels))
    weights = weights if counts is None else weights * counts
    out: dict[str | None, float] = {}
    for lang in set(languages):
        mine = np.array([x == lang for x in languages])
        s, y, w = scores[mine], labels[mine], weights[mine]
        grid = GRID
        if 0 < y.sum() < len(y):
            f1 = [2 * w[(s >= t) & (y == 1)].sum() / (w[s >= t].sum() + w[y == 1].sum()) for t in grid]
            best = np.flatnonzero(np.isclose(f1, max(f1)))
            out[lang] = float(grid[best[len(best) // 2]])
        else:
            out[lang] = 0.5
    return out


def constant_model(share: float) -> dict[str, np.ndarray]:
    """A model that scores every text alike."""
    model = train([], np.zeros(0), 0)
    model["out"][:] = 0
    model["base"][:] = np.log(share / (1 - share)) if 0 < share < 1 else (6.0 if share >= 1 else -6.0)
    return model


def labelled_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, at, text, lang, label) of all rows that may be learnt from, `at` the window of a long text."""
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    rows = documents.select("doc_id", "text", lang.alias("lang")).join(learnable(labels, "toxic"), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row"), F.max("label").alias("label"))
    last = F.greatest(F.ceil(F.coalesce(F.length("row.text"), F.lit(0)) / SAMPLE_SIGNS).cast("int") - 1, F.lit(0))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("doc_id", "at", F.substring("row.text", F.col("at") * SAMPLE_SIGNS + 1, F.lit(SAMPLE_SIGNS)).alias("text"), "row.lang", "label")


def _counted(rows: DataFrame) -> np.ndarray:
    """For each class how many of the rows (text, label) have each row of the embedding table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, known = np.zeros((2, _TABLES * BUCKETS + 1), np.int64), Words()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                present[label, _present(text.as_py(), known)] += 1
        at = np.flatnonzero(present.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(present[0, at]), pa.array(present[1, at])], names=["at", "n0", "n1"])

    sums = rows.select("text", "label").mapInArrow(count, "at long, n0 long, n1 long").groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    out = np.zeros((2, _TABLES * BUCKETS + 1))
    out[:, sums["at"].to_numpy()] = sums["n0"].to_numpy(), sums["n1"].to_numpy()
    return out


def _flat(model: dict[str, np.ndarray]) -> np.ndarray:
    """All weights as rows of SIZE, those of the table first."""
    rest = np.concatenate([model[k].ravel() for k in sorted(model) if k != "table"])
    return np.vstack([model["table"], np.pad(rest, (0, -len(rest) % SIZE)).reshape(-1, SIZE)])


def _unflat(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, rest, at = {"table": flat[: len(like["table"])].astype(np.float32)}, flat[len(like["table"]) :].ravel(), 0
    for k in sorted(like):
        if k != "table":
            out[k] = rest[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
            at += like[k].size
    return out


def _round(rows: DataFrame, model: dict[str, np.ndarray], number: int) -> dict[str, np.ndarray]:
    """The model after PASSES over each group: a weight changes by the average over the groups that changed it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("doc_id", "ascending"), ("at", "ascending")])
        before = _flat(shared.value)
        own = {k: v.copy() for k, v in shared.value.items()}
        rng = np.random.default_rng([SEED, number, table["part"][0].as_py()])
        after = _flat(descended(own, table["text"].to_pylist(), table["label"].to_numpy().astype(np.float64), PASSES, rng))
        gap = np.rint(np.clip((after - before).astype(np.float64) * UNIT, -(2**31) + 1, 2**31 - 1)).astype(np.int32)
        at = np.flatnonzero(gap.any(axis=1))
        return pa.table({"at": pa.array(at), "gap": pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * SIZE, pa.int32()), pa.array(gap[at].ravel()))})

    gaps = rows.groupBy("part").applyInArrow(group, "at long, gap array<int>")
    sums = gaps.groupBy("at").agg(F.count("*").alias("n"), *(F.expr(f"sum(get(gap, {i})) AS g{i}") for i in range(SIZE))).toArrow()
    shared.destroy()
    flat = _flat(model).astype(np.float64)
    flat[sums["at"].to_numpy()] += np.column_stack([sums[f"g{i}"].to_numpy() for i in range(SIZE)]) / sums["n"].to_numpy()[:, None] / UNIT
    return _unflat(flat, model)


def fit(documents: DataFrame, labels: DataFrame, warm: bool = True) -> tuple[dict[str, np.ndarray], dict[str | None, float]]:
    """Model and thresholds by language, from all labelled rows that may be learnt from.

    Held-out rows are not read. Of an id's several texts the least one counts. A text of
    more than SAMPLE_SIGNS is cut into windows, each a row with the text's label. Nine
    tenths of the ids, by a hash, train, in groups of some GROUP rows; those of the rest
    calibrate the thresholds. What comes to the driver is the model, of fixed size, and
    counts by language. Without a `lang` column all texts are of one language, null.
    Unless there are training rows of both classes, the scores are constant: the share of
    toxic labels, or almost 0 if there are no labels.
    """
    rows = cut(labelled_rows(documents, labels).withColumn("kept", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(10)) == 0))
    many = {r["label"]: r["n"] for r in rows.where("NOT kept").groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = many.get(1, 0), many.get(0, 0)
    share = learnable(labels, "toxic").agg(F.avg("label")).first()[0]
    if not ones or not zeros:
        return constant_model(share or 0.0), {}
    groups = -(-(ones + zeros) // GROUP)
    draw = F.xxhash64("doc_id", "at", F.lit(3))
    rows = rows.withColumns({"draw": draw, "part": F.pmod(draw, F.lit(groups)).cast("int")})
    training = rows.where("NOT kept").select("part", "draw", "doc_id", "at", "text", "label")
    model = started(np.random.default_rng(SEED), _counted(training) if warm else np.zeros((2, _TABLES * BUCKETS + 1)), [zeros, ones], warm)
    for number in range(ROUNDS):
        model = _round(training, model, number)
    # windows are not spread over the classes as labels are; set the odds right
    if 0 < share < 1:
        model["base"] += np.float32(np.log(share / (1 - share)) - np.log(ones / zeros))
    step = F.expr(f"size(filter(array({', '.join(f'{g!r}D' for g in GRID.tolist())}), g -> g <= score))")
    cells = score(rows.where("kept").select("lang", "label", "text"), model).groupBy("lang", "label", step.alias("step")).agg(F.count("*").alias("n")).collect()
    at = np.r_[0.0, GRID][[r["step"] for r in cells]] if cells else np.zeros(0)
    y, n = (np.array([r[c] for r in cells], dtype=np.float64) for c in ("label", "n"))
    return model, thresholds_by_language(at, y, [r["lang"] for r in cells], counts=n)


def score(documents: DataFrame, model: dict[str, np.ndarray], out: str = "score") -> DataFrame:
    """Adds `out`, a toxicity score from 0 to 1 of the whole text; a null text counts as empty.

    The model, of fixed size, is broadcast. Other columns pass through, `out` is
    replaced if it is there, repeated rows stay repeated, an empty table stays empty.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = [c for c in documents.columns if c != out]
    keep = [F.col(f"`{c}`") for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer.scores(t.as_py() for t in batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*names, out])

    source = documents.select(*keep, F.col("text")).toDF(*(f"c{i}" for i in range(len(keep) + 1)))  # mapInArrow takes no names with dots
    return source.mapInArrow(run, documents.select(*keep).schema.add(out, "double"))


def op4_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document its score and prediction; `flagged` uses its language's own threshold."""
    model, thresholds = fit(documents, labels)
    if "lang" not in documents.columns:
        documents = documents.withColumn("lang", F.lit(None).cast("string"))
    scored = score(documents.select("doc_id", "lang", "text"), model)
    limit = F.lit(0.5)
    for lang, value in sorted(thresholds.items(), key=str):
        limit = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(value)).otherwise(limit)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= limit).cast("int").alias("flagged"))
