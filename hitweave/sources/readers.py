"""Where hits, weights and module maps come from, and where stages can be written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.schema import HIT_COLUMNS, hits_schema


def read_hits(spark: SparkSession, path: str, columns=HIT_COLUMNS) -> DataFrame:
    """Hits from Parquet; only the keys and the given columns are read, and have to be there."""
    df = spark.read.parquet(path)
    if missing := [c for c in ("event_id", "hit_id", *columns) if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    optional = ["region"] if "region" in df.columns else []
    return df.select("event_id", "hit_id", *columns, *optional)


def random_hits(spark: SparkSession, n: int = 10, columns=HIT_COLUMNS, seed: int = 12345) -> DataFrame:
    """One event of n hits with pseudo-random features, the same in every run."""
    values = [(F.pmod(F.xxhash64("hit_id", F.lit(i), F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0).cast("float").alias(c) for i, c in enumerate(columns)]
    df = spark.range(n).select(F.lit(0).cast("long").alias("event_id"), F.col("id").alias("hit_id")).select("event_id", "hit_id", *values)
    return df.select(*(F.col(f.name) for f in hits_schema(columns)))


def read_weights(spark: SparkSession, path: str, skip: tuple[str, ...] = ("src_network", "tgt_network")) -> dict:
    """Layer lists from a JSON text file: name to list of layers. Names that contain one of `skip` are left out."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return {k: v for k, v in json.loads(text).items() if not any(s in k for s in skip)}


def read_module_map(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """(mid_1, mid_2, mid_3, occurence) of a triplet table with other column names."""
    df = spark.read.parquet(path).withColumnsRenamed(names or {})
    return df.select("mid_1", "mid_2", "mid_3", "occurence")


def split(df: DataFrame, name: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Rows of the events that fall into one of several splits, by a hash of the event."""
    draw = F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    low = 0.0
    for k, share in shares.items():
        if k == name:
            return df.where((draw >= low) & (draw < low + share))
        low += share
    raise ValueError(f"no split {name}")


def snapshot(df: DataFrame, path: str, stage: str, mode: str = "overwrite") -> DataFrame:
    """Writes an intermediate result and reads it back."""
    df.write.mode(mode).parquet(f"{path}/{stage}")
    return df.sparkSession.read.parquet(f"{path}/{stage}")


def captured(inputs: DataFrame, path: str, number: int, keep_all: bool = True) -> None:
    """Writes the input of request `number` to a folder of its own, which a repeated request replaces; or, unless `keep_all`, to one that every request replaces."""
    inputs.write.mode("overwrite").parquet(f"{path}/request={number}" if keep_all else f"{path}/request")


def write_training_graphs(edges: DataFrame, path: str, datatype: str = "datatype") -> None:
    """Writes edges with a column that names their split (train, validation, test), a folder for each, and in it events together."""
    edges.repartition(datatype, "event_id").sortWithinPartitions(datatype, "event_id", "dst", "src").write.mode("overwrite").partitionBy(datatype).parquet(path)


def write_labels(streams: DataFrame, path: str, mode: str = "error") -> None:
    streams.write.mode(mode).parquet(path)


def graphviz(edges: DataFrame, path: str) -> None:
    """Edges as lines of Graphviz text, one file for each partition, within a digraph when put together."""
    label = F.format_string('  "%d_%d" -> "%d_%d" [label="%.3f"];', "event_id", "src", "event_id", "dst", "score")
    edges.select(label.alias("value")).write.mode("overwrite").text(path)
