"""Two-pass external shuffle into shards.

First pass: seeded hashes scatter the records over shards and, inside each shard, over
buckets that fit in memory. Second pass: each bucket is put in a fixed order, shuffled
by Fisher-Yates with a seed of its own, and written. Which shard a record is in is
decided by its key and the number of shards alone: each shard draws a hash for the
key and the highest draw wins, so one more shard only takes records, into itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hitweave.llm.ties import dealt
from hitweave.session import shared_folder

SHARDS = 40
SEED = 7
#: Bytes of text in a bucket, about; a task holds one, with a few copies of it.
BUCKET_BYTES = 32 << 20
#: Most tasks of the second pass; beyond, each has more buckets, one after the other.
TASKS = 20_000
OVERHEAD = 16


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose draw for the key is highest."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(key, s, F.lit(seed)).alias("draw"), s.alias("shard")))
    return F.array_max(draws)["shard"]


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation: numpy's generator swaps each place with a random one of those left."""
    return np.random.default_rng(seed).permutation(n)


def external_shuffle(records: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Adds shard, bucket and slot to whole records, moved and shuffled.

    slot counts from 0 without gaps in each shard: buckets follow each other, and a
    bucket's records are in shuffled order. Rows of a shard sorted by slot are the
    shuffled stream. The result is the same in every run; rows that are equal in all
    columns may change places.

    Whole records move once. What goes before is a count of each bucket's rows, which
    meets the bucket by its key, so nothing is broadcast or sent to the driver.

    A null key is a key like others, a null text has no bytes, repeated rows stay
    repeated. Columns named shard, bucket or slot are replaced, names with the prefix
    `__hw_` are reserved, and columns of maps are not taken. An empty table gives an
    empty table. One key's rows share a shard, as they must, but are dealt over its
    buckets, by all their columns and, if they are equal, by number.
    """
    records = records.select(*(F.col(f"`{c}`") for c in records.columns if c not in ("shard", "bucket", "slot")))
    columns = [F.col(f"`{c}`") for c in records.columns]
    own = F.col(f"`{key}`")
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + OVERHEAD
    total = records.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    tasks = min(TASKS, shards * buckets)
    placed = dealt(records, size, seed, bucket_bytes).withColumn("shard", shard_of(own, shards, seed)).withColumn("bucket", F.pmod("__hw_tie", F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("shard", "bucket").count().select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))

    names = [*records.columns, "shard", "bucket"]

    def mix(table: pa.Table, first: pa.Table) -> pa.Table:
        table = table.rename_columns([*names, "__hw_key", "__hw_tie"]).sort_by([("__hw_key", "ascending"), ("__hw_tie", "ascending")])
        where = (table["shard"][0].as_py(), table["bucket"][0].as_py())
        table = table.take(pa.array(fisher_yates(table.num_rows, [seed, *where]))).drop_columns(["__hw_key", "__hw_tie"])
        return table.append_column("slot", pa.array(np.arange(table.num_rows) + first["first"][0].as_py(), pa.int64()))

    keyed = placed.select(*columns, "shard", "bucket", F.xxhash64(own, F.lit(seed)).alias("__hw_key"), "__hw_tie")
    keyed = keyed.toDF(*(f"c{i}" for i in range(len(names) + 2)))  # Arrow functions take no names with dots
    shard, bucket = (f"c{len(names) - i}" for i in (2, 1))
    keyed = keyed.repartition(tasks, shard, bucket)
    schema = placed.select(*columns, "shard", "bucket").schema.add("slot", "long")
    groups = keyed.groupBy(shard, bucket).cogroup(firsts.repartition(tasks, "s", "b").groupBy("s", "b"))
    return groups.applyInArrow(mix, schema)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Writes a folder for each shard; each task adds one file to it, with the buckets that it has shuffled, in slot order.

    Nothing moves again, and there are as many folders as shards, whatever the number
    of buckets. Slots of a bucket follow each other, so a reader that takes a shard's
    buckets by number, or its rows by slot, gets the shuffled stream; `contents` says
    where each bucket begins.
    """
    shuffled.sortWithinPartitions("shard", "bucket", "slot").write.partitionBy("shard").parquet(path)


def contents(shards: DataFrame) -> DataFrame:
    """(shard, bucket, file, first, rows): where the slots of each bucket are, from the columns of numbers of `read_shards` alone."""
    return shards.groupBy("shard", "bucket", F.input_file_name().alias("file")).agg(F.min("slot").alias("first"), F.count("*").alias("rows"))


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The records of all shards, with shard, bucket and slot; `schema` is that of the shuffled records."""
    return spark.read.schema(schema).parquet(path)


def op8_sharding(documents: DataFrame) -> DataFrame:
    """Every document's shard and slot, by the law of keys, and its shard with one more.

    The shards are written to the shared folder; the rows are those of the files.
    Null texts are empty, repeated rows and null ids stay, an empty table gives an
    empty table.
    """
    spark = documents.sparkSession
    path = shared_folder(spark, "shards")
    shuffled = external_shuffle(documents.select("doc_id", "text"))
    write_shards(shuffled, path)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return read_shards(spark, path, shuffled.schema).select(
        "doc_id",
        (F.length(data) + OVERHEAD).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"),
    )
