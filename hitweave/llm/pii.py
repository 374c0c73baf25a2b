"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Only DataFrame functions; one narrow stage, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.llm.spans import digest, judged, with_matches

#: Written so that no text takes more than linear time: a scan starts only where a run
#: starts (or where the last match ended), and runs are possessive. They match what the
#: plain forms match; for cards, chains too short for any card are left out.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){2,7}+(?:\x20?+[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = tuple(PATTERNS)
#: The kinds whose valid matches are always kept.
BASE_KINDS = KINDS[:4]
_IP = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
#: Score before context, and the words nearby that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.35}
SHORT_CARD_PRIOR = 0.4
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|addr|address|host|server|login)\b",
    "card": r"(?i)\b(?:card|visa|master ?card|amex|credit|debit|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:phone|call|tel|mobile|fax|telefon|cell)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b",
    "ssn": r"(?i)\b(?:ssn|social security|social)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|serial|build|order|invoice|example|section)\b"
BONUS, MALUS, LEAST = 0.25, 0.3, 0.5
CONTEXT = 48


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn check digit."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))

    def weight(x: Column, i: Column) -> Column:
        doubled = x * 2
        return F.when(i % 2 == 0, x).when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.transform(values, weight), F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the ISO 13616 remainder is 1. Letters count as 10 to 35."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(s: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(value < 10, s * 10 + value).otherwise(s * 100 + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _is_base(kind: str):
    def base(m: Column) -> Column:
        n = F.length(digits_of(m["match"]))
        if kind == "email":
            return F.lit(True)
        if kind == "ip":
            return m["match"].rlike(_IP)
        if kind == "card":
            return F.when(n.between(16, 19), luhn(digits_of(m["match"]))).otherwise(False)
        if kind == "phone":
            return n.between(8, 15)
        return F.lit(False)

    return base


def _score(kind: str):
    def score(m: Column) -> Column:
        near = F.concat_ws(" ", m["before"], m["after"])
        context = F.when(near.rlike(FOR[kind]), BONUS).otherwise(0.0) - F.when(near.rlike(AGAINST), MALUS).otherwise(0.0)
        digits = digits_of(m["match"])
        n = F.length(digits)
        if kind == "card":
            prior = F.when(n > 19, 0.0).when(n >= 16, F.when(luhn(digits), PRIOR[kind]).otherwise(0.0)).otherwise(F.when(luhn(digits), SHORT_CARD_PRIOR).otherwise(0.0))
        elif kind == "iban":
            prior = F.when(mod97(m["match"]), PRIOR[kind]).otherwise(0.0)
        elif kind == "ssn":
            prior = F.when(m["match"].rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), PRIOR[kind]).otherwise(0.0)
        else:
            prior = F.when(_is_base(kind)(m), PRIOR[kind]).otherwise(0.0)
        return F.when(prior > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), prior + context))).otherwise(F.lit(0.0))

    return score


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds `out`: array<struct<kind, start, end, score, base>> of personal data in `text`.

    Kinds in the order of KINDS, each by start; code points, end exclusive. Base
    spans (a valid email, ip, card of 16 to 19 digits, phone) are always kept. Others
    (a card of 13 to 15 digits, an IBAN, a US social security number) are kept if
    checksum and context bring them to LEAST.

    A null text counts as empty and gives an empty array, as does a text without
    matches. Other columns pass through unchanged, repeated rows stay repeated; a
    column already named `out` is replaced and names with the prefix `__hw_` are
    reserved. An empty table gives an empty table.
    """
    df = df.withColumn("__hw_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = with_matches(df, "__hw_text", PATTERNS, CONTEXT)
    spans = [judged(k, F.col(f"__hw_found_{k}"), _is_base(k), _score(k), LEAST) for k in KINDS]
    return df.withColumn(out, F.concat(*spans)).drop("__hw_text", *(f"__hw_found_{k}" for k in KINDS))


def op1_pii(documents: DataFrame) -> DataFrame:
    """Per document the counts and digests of find_pii's spans."""
    found = find_pii(documents.select("doc_id", "text"), out="pii").drop("text")
    base = F.filter("pii", lambda s: s["base"])
    found = found.withColumn("base", base)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"), F.round(F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)), 3).alias("top_score"))
