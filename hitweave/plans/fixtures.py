"""Hits and edges made from the driver's tables, in Spark and, by the same formulas, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.operators import edges as E
from hitweave.operators.neighbours import radius_join
from hitweave.session import table

R_MAX = 1.12
HOURS = 6


def hits_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event; a hit for each embedding."""
    base = table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("event_id"), F.col("vec_id").alias("hit_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    base = base.withColumns({c: F.get("v", F.lit(i)) * 1000 for i, c in enumerate("xyz")})
    base = base.withColumns({"r": F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), "phi": F.atan2("y", "x")})
    return base.withColumns({"rr": F.col("r") * F.col("r") + F.col("z") * F.col("z"), "eta": F.asinh(F.col("z") / F.col("r"))})


HITS_E = """hits_e AS (
    SELECT *, r * r + z * z AS "rr", asinh(z / r) AS eta FROM (
        SELECT *, sqrt(x * x + y * y) AS r, atan2(y, x) AS phi FROM (
            SELECT 0::BIGINT AS event_id, vec_id AS hit_id, list_transform(embedding, lambda x: x::DOUBLE) AS v,
                1000 * embedding[1]::DOUBLE AS x, 1000 * embedding[2]::DOUBLE AS y, 1000 * embedding[3]::DOUBLE AS z
            FROM embeddings)))"""


def near_e(spark: SparkSession, sf_dir: str, k: int | None = None, r_max: float = R_MAX) -> DataFrame:
    hits = hits_e(spark, sf_dir).select("event_id", "hit_id", "v")
    return radius_join(hits, hits_e(spark, sf_dir).select("event_id", "hit_id", "v"), r_max, k)


NEAR_E = f"""pairs_e AS (
    SELECT a.event_id, a.hit_id AS src, b.hit_id AS dst,
        list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS d2
    FROM hits_e a JOIN hits_e b ON a.event_id = b.event_id),
near_e AS (SELECT * FROM pairs_e WHERE d2 <= {R_MAX} * {R_MAX} AND src <> dst)"""


def edges_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges from the inside out, with a score that falls with the distance."""
    near = near_e(spark, sf_dir).where("src < dst")  # the other direction has the same distance to the bit
    turned = E.oriented(near, hits_e(spark, sf_dir))
    return turned.groupBy("event_id", "src", "dst").agg(F.max(F.round(1 / (1 + F.exp(-40 * (1.10 - F.sqrt("d2")))), 6)).alias("score"))


EDGES_E = """edges_e AS (
    SELECT event_id, src, dst, max(round(1 / (1 + exp(-40 * (1.10 - sqrt(d2)))), 6)) AS score FROM (
        SELECT n.event_id, d2, CASE WHEN s.rr > d.rr OR (s.rr = d.rr AND n.src > n.dst) THEN n.dst ELSE n.src END AS src,
            CASE WHEN s.rr > d.rr OR (s.rr = d.rr AND n.src > n.dst) THEN n.src ELSE n.dst END AS dst
        FROM near_e n JOIN hits_e s ON s.hit_id = n.src JOIN hits_e d ON d.hit_id = n.dst)
    GROUP BY event_id, src, dst)"""


def hits_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event for each user; R is the time of the hit in seconds, which orders it."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("event_id"), F.col("event_id").alias("hit_id"), "ts", "value", seconds.alias("rr"))


def edges_u(spark: SparkSession, sf_dir: str, hours: int = HOURS) -> DataFrame:
    """Edges between hits of an event that are up to `hours` apart, forward in time.

    Joined by slots of that length and the next one, so that a user with very many
    hits is dealt out over slots.
    """
    hits = hits_u(spark, sf_dir).withColumn("slot", F.floor(F.col("rr") / (hours * 3600)))
    a = hits.select("event_id", F.col("hit_id").alias("src"), F.col("ts").alias("t0"), F.col("value").alias("v0"), F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"))
    b = hits.select("event_id", F.col("hit_id").alias("dst"), F.col("ts").alias("t1"), F.col("value").alias("v1"), "slot")
    later = (F.col("t0") < F.col("t1")) | ((F.col("t0") == F.col("t1")) & (F.col("src") < F.col("dst")))
    close = F.col("t1") <= F.col("t0") + F.expr(f"INTERVAL {hours} HOURS")
    return a.join(b, ["event_id", "slot"]).where(later & close).select("event_id", "src", "dst", F.round(F.exp(-F.abs(F.col("v0") - F.col("v1")) / 50.0), 6).alias("score"))


EDGES_U = f"""edges_u AS (
    SELECT a.user_id AS event_id, a.event_id AS src, b.event_id AS dst, round(exp(-abs(a.value - b.value) / 50.0), 6) AS score
    FROM events a JOIN events b ON a.user_id = b.user_id AND (a.ts < b.ts OR (a.ts = b.ts AND a.event_id < b.event_id)) AND b.ts <= a.ts + INTERVAL {HOURS} HOUR),
live_u AS (SELECT * FROM edges_u WHERE score > 0.01)"""


def live_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score_cut(edges_u(spark, sf_dir), 0.01, strict=True)


def bip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers to parts, one event; parts are numbered from a million on."""
    return table(spark, sf_dir, "lineitem").select(F.lit(0).cast("long").alias("event_id"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("w"))


BIP = "bip AS (SELECT 0::BIGINT AS event_id, l_suppkey AS src, l_partkey + 1000000 AS dst, l_quantity AS q, l_discount AS w FROM lineitem)"


def matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predicted and true edges: pairs of supplier and part of returned and of finished lines."""
    lines = table(spark, sf_dir, "lineitem")
    pair = [F.lit(0).cast("long").alias("event_id"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")]
    pred = lines.where("l_returnflag = 'R'").select(*pair).distinct()
    truth = lines.where("l_linestatus = 'F'").groupBy(*pair).agg(F.max("l_orderkey").alias("truth_id"), F.max("l_quantity").alias("quantity"))
    return pred, truth.withColumn("signal", F.col("quantity") > 25)


MATCHES = """pred AS (SELECT DISTINCT 0::BIGINT AS event_id, l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R'),
truth AS (SELECT 0::BIGINT AS event_id, l_suppkey AS src, l_partkey AS dst, max(l_orderkey) AS truth_id, max(l_quantity) > 25 AS signal FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2, 3)"""
