"""Places of regular-expression matches, with DataFrame functions alone.

Spark's functions return what matched, not where. The text between matches is what
`split` returns for the same pattern, so a running sum over the lengths of both gives
every place, in code points. Patterns must never match the empty string.

Columns named with the prefix `__hw_` are reserved for these helpers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = 128


def running_sum(values: Column) -> Column:
    """Inclusive running sums of an array of numbers.

    Sums of chunks first, then inside each chunk: appending to one growing array for
    all values would copy it for every value.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")), lambda c: F.slice(values, c * _CHUNK + 1, F.lit(_CHUNK)))
    zero = F.lit(0).cast("bigint")
    state = F.struct(zero.alias("sum"), F.array().cast("array<bigint>").alias("out"))
    sums = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda s, x: s + x))
    bases = F.aggregate(sums, state, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["out"], s["sum"]).alias("out")), lambda s: s["out"])

    def inside(chunk: Column, base: Column) -> Column:
        start = F.struct(base.alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(chunk, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["out"], s["sum"] + x).alias("out")), lambda s: s["out"])

    return F.when(F.size(values) > 0, F.flatten(F.zip_with(chunks, bases, inside))).otherwise(F.array().cast("array<bigint>"))


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], context: int = 0) -> DataFrame:
    """Adds `__hw_found_<kind>`: array<struct<start, end, match, before, after>> for each pattern.

    Matches are leftmost and do not overlap. `before` and `after` hold up to `context`
    characters on either side that belong to no match of the same kind. The text
    must not be null.
    """
    kinds = list(patterns)
    df = df.withColumns({f"__hw_m_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in patterns.items()})
    none = F.array().cast("array<string>")
    df = df.withColumns({f"__hw_p_{k}": F.when(F.size(f"__hw_m_{k}") > 0, F.split(text, patterns[k], -1)).otherwise(none) for k in kinds})
    df = df.withColumns({f"__hw_g_{k}": _gaps(F.col(f"__hw_p_{k}"), F.col(f"__hw_m_{k}")) for k in kinds})
    df = df.withColumns({f"__hw_s_{k}": running_sum(F.col(f"__hw_g_{k}")) for k in kinds})
    df = df.withColumns({f"__hw_found_{k}": _found(k, context) for k in kinds})
    return df.drop(*(f"__hw_{x}_{k}" for x in "mpgs" for k in kinds))


def _gaps(pieces: Column, matches: Column) -> Column:
    """What lies between the starts of neighbouring matches."""
    before = F.transform(F.slice(pieces, F.lit(1), F.size(matches)), lambda p: F.length(p).cast("bigint"))
    own = F.concat(F.array(F.lit(0)), F.transform(matches, F.length))
    return F.zip_with(before, F.slice(own, F.lit(1), F.size(matches)), lambda n, m: n + m)


def _found(kind: str, context: int) -> Column:
    # Arrays are zipped, never looked up inside a lambda: the optimiser may move the
    # expression behind a column into the lambda and evaluate it for every element.
    matches, starts, pieces = (F.col(f"__hw_{x}_{kind}") for x in "msp")
    placed = F.zip_with(matches, starts, lambda m, s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))
    if not context:
        return placed
    n = F.size(matches)
    near = F.zip_with(F.slice(pieces, F.lit(1), n), F.slice(pieces, F.lit(2), n), lambda b, a: F.struct(F.substring(b, -context, context).alias("before"), F.substring(a, 1, context).alias("after")))
    return F.zip_with(placed, near, lambda m, c: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), c["before"].alias("before"), c["after"].alias("after")))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def judged(kind: str, found: Column, base, score, least: float) -> Column:
    """struct<kind, start, end, score, base> of the matches that are base ones or score `least`.

    `base` and `score` map a match to a Boolean and a number.
    """
    spans = F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), score(m).alias("score"), base(m).alias("base")))
    return F.filter(spans, lambda s: s["base"] | (s["score"] >= least))
