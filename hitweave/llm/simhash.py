"""SimHash near-duplicates: fingerprints, block keys, bit-sliced comparison, components.

Equal fingerprints are collapsed first, so a group of exact copies costs one row. Two
fingerprints within the radius agree on at least two of six bit blocks, so each is
keyed by the fifteen pairs of blocks and compared inside equal keys only. Inside a key
the bits are stored as vertical planes and distances are counted for 64 lanes at a
time. A key with very many fingerprints is dealt out as pairs of blocks of bounded
size, so no task holds it whole and no pair is left out. What leaves a task is a
spanning set of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.operators.components import connected_components
from hitweave.session import cut

RADIUS = 4
WORDS = 4
SEED = 42
#: Bit blocks (first bit, width): with 4 differing bits at least 2 of the 6 are equal.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Fingerprints of one key that one task compares with each other at most, by halves.
HOT = 4096
_QUERIES = 256


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the shingles of `words` words, as an unsigned number.

    Bit i is set if it is set in more than half of the shingles' hashes, repeats
    counted. Fewer words make one shingle; none give 0. ASCII case and the kind of
    ASCII white space do not matter.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = (np.cumsum([len(p) + 1 for p in parts]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: len(parts) - words])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :], strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def planes_of(values: np.ndarray) -> np.ndarray:
    """Vertical bit planes [64, ceil(n / 64)] of n 64-bit values; missing lanes are 0."""
    n = len(values)
    padded = np.zeros(-(-max(n, 1) // 64) * 64, dtype="<u8")
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


class LaneCounters:
    """Carry-save counters of 64 lanes a word; what passes the last one stays marked as over."""

    def __init__(self, shape, radius: int):
        self.radius, self.bits = radius, [np.zeros(shape, dtype=np.uint64) for _ in range(radius.bit_length())]
        self.spilt = np.zeros(shape, dtype=np.uint64)

    def add(self, plane: np.ndarray) -> None:
        carry = plane
        for k, bit in enumerate(self.bits):
            self.bits[k], carry = bit ^ carry, bit & carry
        self.spilt = self.spilt | carry

    def over(self) -> np.ndarray:
        """Lanes whose count is above the radius."""
        more, equal = self.spilt.copy(), ~np.zeros_like(self.spilt)
        for k in reversed(range(len(self.bits))):
            if self.radius >> k & 1:
                equal &= self.bits[k]
            else:
                more |= equal & self.bits[k]
                equal &= ~self.bits[k]
        return more

    def keep(self, words: np.ndarray) -> None:
        self.bits, self.spilt = [b[words] for b in self.bits], self.spilt[words]


ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def near_pairs(differences: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which XORs of pairs have at most `radius` bits set, bit-sliced, 64 pairs a word."""
    planes = planes_of(differences)
    words = np.arange(planes.shape[1])
    counters = LaneCounters(len(words), radius)
    for bit in range(64):
        counters.add(planes[bit, words])
        if bit % 8 == 7:
            live = counters.over() != ALL
            if not live.all():
                words = words[live]
                counters.keep(live)
                if not len(words):
                    break
    near = np.zeros(planes.shape[1], dtype="<u8")
    near[words] = ~counters.over()
    return np.unpackbits(near.view(np.uint8), bitorder="little")[: len(differences)].astype(bool)


def near_lanes(queries: np.ndarray, planes: np.ndarray, n: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(query, lane) indices within the radius, each query against all lanes of `planes`."""
    q, w = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(planes.shape[1]), indexing="ij"))
    counters = LaneCounters(len(q), radius)
    for bit in range(64):
        flip = (-((queries >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)).astype(np.uint64)
        counters.add(planes[bit][w] ^ flip[q])
        if bit % 8 == 7 and bit > 8:
            live = counters.over() != ALL
            if not live.all():
                q, w = q[live], w[live]
                counters.keep(live)
                if not len(q):
                    break
    hits = np.unpackbits((~counters.over()).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, lane = np.nonzero(hits)
    lane = w[word] * 64 + lane
    real = lane < n
    return q[word][real], lane[real]


def _root(parent: list[int] | np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _settled(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def links_of_large_group(values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Root of each distinct value of a large group, under links within the radius."""
    n, parent, planes = len(values), np.arange(len(values)), planes_of(values)
    for at in range(0, n, _QUERIES):
        q, lane = near_lanes(values[at : at + _QUERIES], planes, n, radius)
        q = q + at
        while len(q):
            parent = _settled(parent)
            open_ = parent[q] != parent[lane]
            q, lane = q[open_], lane[open_]
            if len(q):
                _, first = np.unique(q, return_index=True)  # one link a query, then look again
                for a, b in zip(q[first].tolist(), lane[first].tolist(), strict=True):
                    a, b = _root(parent, a), _root(parent, b)
                    parent[max(a, b)] = min(a, b)
    return _settled(parent)


def _group_links(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between the values of equal keys; rows are sorted by key."""
    firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[firsts, len(keys)])
    parent = np.arange(len(keys))
    for start, size in zip(firsts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        parent[start : start + size] = start + links_of_large_group(values[start : start + size], radius)
    small = np.repeat(sizes <= 64, sizes)
    for step in range(1, int(sizes[sizes <= 64].max(initial=1))):
        left = np.flatnonzero(small[:-step] & small[step:] & (keys[:-step] == keys[step:]))
        for at in range(0, len(left), 1 << 16):
            a = left[at : at + (1 << 16)]
            for i in a[near_pairs(values[a] ^ values[a + step], radius)].tolist():
                x, y = _root(parent, i), _root(parent, i + step)
                parent[max(x, y)] = min(x, y)
    parent = _settled(parent)
    linked = np.flatnonzero(parent != np.arange(len(keys)))
    return values[linked], values[parent[linked]]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, fp) that come sorted by key; a group may span batches."""
    rest_k, rest_v = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(keys, values):
        a, b = _group_links(keys, values, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys = np.r_[rest_k, batch.column(0).to_numpy(zero_copy_only=False)]
        values = np.r_[rest_v, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield out(keys[:last], values[:last])
        rest_k, rest_v = keys[last:], values[last:]
    if len(rest_k):
        yield out(rest_k, rest_v)


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, fp): the SimHash of each row's text as a signed long. Null texts count as empty.

    text_hash is Spark's 64-bit hash of the text; with the id it tells rows apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    own = F.col(f"`{text}`")
    return documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(own).alias("text_hash"), own.alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def near_links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that join all that are within the radius."""
    if radius > 4:
        raise ValueError("six blocks find all pairs up to radius 4")
    part = lambda k: F.shiftrightunsigned("fp", BLOCKS[k][0]).bitwiseAND(F.lit((1 << BLOCKS[k][1]) - 1))
    keys = [F.shiftleft(F.lit(t).cast("long"), 32).bitwiseOR(F.shiftleft(part(i), 11)).bitwiseOR(part(j)) for t, (i, j) in enumerate(combinations(range(6), 2))]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = cut(keyed.groupBy("key").count().where(F.col("count") > hot).select("key", F.ceil(F.col("count") / (hot // 2)).cast("int").alias("blocks")))
    keyed = keyed.join(large, "key", "left")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.xxhash64("key", F.least(b, block), F.greatest(b, block)))
    dealt = keyed.select("fp", F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pairs)).alias("key"))
    dealt = dealt.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(lambda batches: _links(batches, radius), "a long, b long")


def _classes(documents: DataFrame, doc_id: str, text: str, radius: int, words: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, least, component): each fingerprint's smallest doc_id and its class, named by a fingerprint."""
    sig = cut(fingerprints(documents, doc_id, text, words))
    distinct = cut(sig.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = cut(connected_components(near_links(distinct, radius, hot), "a", "b"))
    member = distinct.join(labels.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    return sig, cut(member)


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the class of near-duplicates that it is in.

    Two rows are linked if their fingerprints differ in at most `radius` bits;
    component_id is the smallest doc_id that can be reached, the own one included.
    Null and empty texts have fingerprint 0 and are linked like others. Rows with a
    null doc_id keep it and never name a component, unless nothing else is in it
    (null). Repeated rows stay repeated; a doc_id with several texts has a row, with a
    class of its own, for each. Other columns are not read, so their names cannot
    clash. An empty table gives an empty table.
    """
    sig, member = _classes(documents, doc_id, text, radius, words, hot)
    least = cut(member.groupBy("component").agg(F.min("least").alias("component_id")))
    named = cut(member.join(least, "component").select("fp", "component_id"))
    return sig.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = WORDS, hot: int = HOT) -> DataFrame:
    """One row of each near-duplicate class: that with the smallest doc_id.

    Rows, not ids, are decided on. A null id comes after all others; of several texts
    with the id that is kept, that of the smallest fingerprint stays, and of rows with
    the same id and text the first by a hash of the whole row. Null and empty texts
    are one class. Columns pass through unchanged; names with the prefix `__hw_` are
    reserved. An empty table stays empty. Only ids and hashes are joined, and whole
    rows move once.
    """
    sig, member = _classes(documents, doc_id, text, radius, words, hot)
    row = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("d"), "fp", F.col("text_hash").alias("t"))
    first = sig.groupBy("fp").agg(F.min(row).alias("row"))  # combined before the shuffle, so large groups of copies are one row
    winners = cut(first.join(member, "fp").groupBy("component").agg(F.min("row").alias("row")).select(F.col("row.n").alias("__hw_n"), F.col("row.d").alias("__hw_d"), F.col("row.t").alias("__hw_t")))
    names = documents.columns
    key = F.col(f"`{doc_id}`").cast("long")
    source = documents.select("*", key.isNull().alias("__hw_n"), F.coalesce(key, F.lit(0)).alias("__hw_d"), F.xxhash64(F.col(f"`{text}`")).alias("__hw_t"))
    keys = ["__hw_n", "__hw_d", "__hw_t"]
    plain = [F.col(f"`{f.name}`") for f in documents.schema.fields if "map<" not in f.dataType.simpleString()]
    # repeats of a row are cut to one before the shuffle, and the join has the same keys
    one = source.withColumn("__hw_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*plain)))).where("__hw_k = 1")
    return one.join(winners, keys, "left_semi").select(*(F.col(f"`{c}`") for c in names))


def op3_simhash(documents: DataFrame) -> DataFrame:
    """Per document its fingerprint in hexadecimal and its component."""
    return near_duplicates(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
