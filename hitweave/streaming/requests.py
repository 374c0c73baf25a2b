"""Requests as a stream: files of hits come in, label streams go out.

Where events are complete in their file, no state is needed; each micro-batch is one
batch run, and the same code serves both. Where an event's rows may come in several
files, state gathers them by event until as many are there as the request has announced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from hitweave.schema import HIT_COLUMNS, hits_schema
from hitweave.session import stored

#: Milliseconds that an event waits for more rows, and that an answered one is remembered.
PATIENCE = 600_000
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def hits_stream(spark: SparkSession, path: str, columns=HIT_COLUMNS, files_at_once: int = 100, announced: bool = False) -> DataFrame:
    """Hits from files as they come; `announced` adds n_hits, how many hits the event has."""
    schema = hits_schema(columns)
    if announced:
        schema = StructType([*schema.fields, StructField("n_hits", LongType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def whole_events(hits: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """The hits of each event once all that n_hits announces are there, with `whole` true.

    Hits are told apart by hit_id, so rows that come again count once. An event that has
    got no row for `patience` milliseconds is given up: one row with its event_id alone
    and `whole` false. What comes for an event after its answer is dropped for as long.
    State holds the rows of open events, of each no more than it has hits.
    """
    names = [c for c in hits.columns if c != "n_hits"]
    kinds = hits.select(*names).schema
    out = StructType([*kinds.fields]).add("whole", "boolean")

    def gathered(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, blob = state.get if state.exists else (False, b"")
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield pd.DataFrame([{c: key[0] if c == "event_id" else None for c in names} | {"whole": False}])
            return
        frames = [pa.ipc.open_stream(blob).read_pandas()] if blob else []
        rows = pd.concat([*frames, *parts], ignore_index=True)
        if not done:
            rows = rows.drop_duplicates("hit_id", ignore_index=True)
            done = len(rows) >= rows["n_hits"].max()
            if done:
                yield rows[names].assign(whole=True)
        sink = pa.BufferOutputStream()
        if not done:
            table = pa.Table.from_pandas(rows, preserve_index=False)
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
        state.update((done, b"" if done else sink.getvalue().to_pybytes()))
        state.setTimeoutDuration(patience)

    groups = hits.groupBy("event_id")
    return groups.applyInPandasWithState(gathered, out, "done boolean, rows binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def serve(hits: DataFrame, pipeline: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs `pipeline` on every micro-batch and writes its labels; a batch that is run again replaces its own output.

    Of a stream from `whole_events`, events that were given up are answered with [-1].
    With `available_now` the query ends when no file is left; waiting events are given up
    by a later batch with data, as state with time-outs would ask for empty ones for ever.
    """

    def batch(df: DataFrame, number: int) -> None:
        if "whole" in df.columns:
            df = stored(df)  # the state is gone through once
            given_up = df.where("NOT whole").select("event_id", F.array(F.lit(-1).cast("long")).alias("labels"))
            answers = pipeline(df.where("whole").drop("whole")).select("event_id", "labels").unionByName(given_up)
        else:
            answers = pipeline(df)
        answers.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = hits.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    if not available_now:
        return writer.start()
    conf = hits.sparkSession.conf
    before = conf.get(EMPTY_BATCHES)
    conf.set(EMPTY_BATCHES, "false")  # the query keeps the setting that it starts with
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(EMPTY_BATCHES, before)
