"""Secrets: patterns propose tokens, two character Markov models tell random ones from ordinary ones.

Only DataFrame functions; the scan is one narrow stage, no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.llm.spans import digest, judged, with_matches

_KEY = r"(?i:password|passwd|secret|token|api_?key)"
_SET = r"[\"']?+\x20*+[:=]\x20*+[\"']?"
_VALUE = r"[A-Za-z0-9+/_.=-]+"
#: Linear-time forms; for access and hex, runs too short to count are left out, which
#: loses nothing as a part of a run is shorter still.
PATTERNS = {
    "assign": f"{_KEY}{_SET}{_VALUE}",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"[0-9a-f]{16,}+",
    "random": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])",
}
KINDS = tuple(PATTERNS)
BASE_KINDS = KINDS[:3]
MIN_VALUE = 12
#: A token is kept if its log-likelihood ratio for each character reaches this, in nats;
#: chosen on made-up service keys and the names of common Python modules (see the README).
LEAST = 0.5
#: And if it has a digit and so many different characters.
VARIETY = 8
#: What the models tell apart: letters and digits by themselves, the other characters together.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
STATES = len(ALPHABET) + 1
#: Words that ordinary identifiers and prose are made of, for the labelled samples.
ORDINARY = (
    "get set read write open close list map key value name node edge file path user data item index count size time date start end first last next prev "
    "begin load save store table column row query filter join group order sort merge split parse format print error result status message event handler "
    "request response server client config option default input output buffer stream string number integer float double array vector matrix field record "
    "schema version update delete insert create remove find search match replace token secret password account session thread process worker task queue "
    "stack heap memory cache page block segment offset length width height color image font text label title button window panel frame view model "
    "controller service factory builder manager provider context state action reducer the and that with from this have which would there their about "
    "mente cion para desde como esta todo siempre donde entre heit keit schaft lich ung verein nicht auch werden eau tion ment elle dans pour avec mais"
).split()


#: Documents that give words to the samples, and words that are taken.
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 500, 4000


def words_of(documents: DataFrame, text: str = "text", n: int = SAMPLE_DOCUMENTS) -> list[str]:
    """Different words of three to fourteen letters, by themselves in the texts of n documents, in lower case.

    A bounded sample for training, the same in every run: the texts and then the words
    with the smallest hashes, SAMPLE_WORDS at most.
    """
    own = F.col(f"`{text}`")
    texts = documents.where(own.isNotNull()).select(F.xxhash64(own).alias("h")).distinct().orderBy("h").limit(n)
    chosen = documents.select(own.alias("text"), F.xxhash64(own).alias("h")).join(F.broadcast(texts), "h", "left_semi")
    words = chosen.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,14}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("w"))
    return [r["word"] for r in words.select(F.lower("w").alias("word")).distinct().orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS).collect()]


def labelled_samples(spark: SparkSession, n: int = 4000, seed: int = 17, words: list[str] | None = None) -> DataFrame:
    """(text, random): n made-up random strings and n ordinary identifiers, the same in every run.

    Random strings are base64 or hexadecimal digests; identifiers join two to five
    words in snake, kebab, camel or plain form, some with a number behind. The words
    are those of ORDINARY and, for every second identifier, `words` if there are any.
    """
    lists = [F.split(F.lit(" ".join(x)), " ") for x in (ORDINARY, words or ORDINARY)]
    ids = spark.range(0, n, 1, 4).withColumn("words", F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, lists[0]).otherwise(lists[1]))
    part = lambda salt: F.unhex(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col("id").cast("string")), 256))
    coded = F.regexp_replace(F.base64(part("a")), "=", "")
    strings = ids.select(F.when(F.col("id") % 4 == 0, F.lower(F.hex(part("a")))).otherwise(F.substring(coded, 1, 40)).alias("text"), F.lit(True).alias("random"))
    draw = lambda j: F.get("words", F.pmod(F.xxhash64(F.col("id"), F.lit(seed), j), F.size("words")).cast("int"))
    style = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(5))
    named = ids.select("id", style.alias("style"), F.transform(F.sequence(F.lit(0), (2 + F.pmod("id", F.lit(4))).cast("int")), draw).alias("chosen"))
    chosen, style = F.col("chosen"), F.col("style")
    name = (
        F.when(style == 0, F.array_join(chosen, "_"))
        .when(style == 1, F.array_join(chosen, "-"))
        .when(style == 2, F.array_join(F.transform(chosen, F.initcap), ""))
        .when(style == 3, F.upper(F.array_join(chosen, "_")))
        .otherwise(F.concat(F.array_join(chosen, ""), F.pmod("id", F.lit(100)).cast("string")))
    )
    return strings.unionByName(named.select(name.alias("text"), F.lit(False).alias("random")))


def _codes(text: Column) -> Column:
    """Model states 1 to STATES of a text's characters."""
    return F.transform(F.split(text, ""), lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c)).otherwise(STATES))


def train_markov(samples: DataFrame) -> list[float]:
    """log P(next | char, random) - log P(next | char, ordinary), row by row, from (text, random) samples.

    Counts of character pairs are summed on the cluster; at most 2 * STATES**2 rows,
    whatever the number of samples, come back. Add-one smoothing; null texts are skipped.
    """
    codes = samples.where("text IS NOT NULL").select("random", _codes(F.col("text")).alias("c"))
    pairs = codes.select("random", F.explode(F.transform(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))), lambda d, i: (F.get("c", i) - 1) * STATES + d - 1)).alias("pair"))
    counts = {True: [1.0] * STATES**2, False: [1.0] * STATES**2}
    for row in pairs.groupBy("random", "pair").count().collect():
        counts[row["random"]][row["pair"]] += row["count"]
    table = []
    for a in range(STATES):
        rows = {k: v[a * STATES : (a + 1) * STATES] for k, v in counts.items()}
        table += [math.log(x / sum(rows[True])) - math.log(y / sum(rows[False])) for x, y in zip(rows[True], rows[False], strict=True)]
    return table


def likelihood_ratio(text: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a text's character pairs; positive means random."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    codes = _codes(text)
    start = F.struct(F.lit(0).alias("prev"), F.lit(0.0).alias("sum"))
    total = F.aggregate(
        codes,
        start,
        lambda s, c: F.struct(c.alias("prev"), (s["sum"] + F.when(s["prev"] > 0, F.get(table, (s["prev"] - 1) * STATES + c - 1)).otherwise(0.0)).alias("sum")),
        lambda s: s["sum"],
    )
    return total / F.greatest(F.length(text) - 1, F.lit(1))


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets", model: list[float] | None = None) -> DataFrame:
    """Adds `out`: array<struct<kind, start, end, score, base>> of secrets in `text`.

    Sorted by start, then kind as in KINDS; code points, end exclusive. Base spans
    (assignments of 12 or more characters, AKIA keys, long hexadecimal runs) are always
    kept; `random` ones are tokens of 20 or more characters that touch no base span,
    hold a digit and VARIETY different characters, and whose score, the mean log-likelihood ratio of the two Markov
    models, is LEAST or more.

    A null text counts as empty and gives an empty array, as does a text without
    matches. Other columns pass through unchanged, repeated rows stay repeated; a
    column already named `out` is replaced and names with the prefix `__hw_` are
    reserved. An empty table gives an empty table. Without `model`, the models are
    trained anew on samples with words of these texts.
    """
    if model is None:
        model = train_markov(labelled_samples(df.sparkSession, words=words_of(df, text)))
    df = df.withColumn("__hw_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = with_matches(df, "__hw_text", PATTERNS)

    def base(kind: str):
        if kind == "assign":
            return lambda m: F.length(F.regexp_replace(m["match"], f"^{_KEY}{_SET}(?={_VALUE}$)", "")) >= MIN_VALUE
        return lambda m: F.lit(kind in BASE_KINDS)

    def score(kind: str):
        return lambda m: F.when(m["match"].rlike("[0-9]") & (F.size(F.array_distinct(F.split(m["match"], ""))) >= VARIETY), likelihood_ratio(m["match"], model)).otherwise(-1.0) if kind == "random" else F.lit(0.0)

    spans = {k: judged(k, F.col(f"__hw_found_{k}"), base(k), score(k), LEAST) for k in KINDS}
    df = df.withColumns({"__hw_base": F.concat(*(spans[k] for k in BASE_KINDS)), "__hw_more": spans["random"]})
    free = F.filter("__hw_more", lambda s: ~F.exists("__hw_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(F.concat("__hw_base", free), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s.alias("span")))
    return df.withColumn(out, F.transform(F.array_sort(keyed), lambda s: s["span"])).drop("__hw_text", "__hw_base", "__hw_more", *(f"__hw_found_{k}" for k in KINDS))


def redact(df: DataFrame, text: str = "text", model: list[float] | None = None) -> DataFrame:
    """Replaces every secret in `text` by `[SECRET:kind]` marks.

    Overlapping spans become one mark, that of the first. A null text stays null, a
    text without secrets stays as it is, repeated rows stay repeated. Other columns
    pass through unchanged; names with the prefix `__hw_` are reserved. An empty table
    stays empty.
    """
    found = find_secrets(df, text, "__hw_spans", model)
    own = F.col(f"`{text}`")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        inside = x["start"] < s["at"]
        kept = F.substring(own, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(inside, s["out"]).otherwise(F.concat(s["out"], F.array(kept, F.concat(F.lit("[SECRET:"), x["kind"], F.lit("]"))))).alias("out"))

    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(own, (s["at"] + 1).cast("int"), F.length(own)))
    return found.withColumn(text, F.when(F.size("__hw_spans") > 0, F.aggregate("__hw_spans", start, step, rest)).otherwise(own)).drop("__hw_spans")


def op7_secrets(documents: DataFrame) -> DataFrame:
    """Per document the counts and digests of find_secrets' spans."""
    found = find_secrets(documents.select("doc_id", "text")).drop("text").withColumn("base", F.filter("secrets", lambda s: s["base"]))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("secrets")).alias("spans"), F.size("secrets").cast("long").alias("n_spans"))
