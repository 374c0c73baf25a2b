"""Small helpers around the session: shared storage for cutting lineage, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data set in `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that reliable checkpoints go to.

    A cluster names it in `spark.checkpoint.dir`; it has to be shared by driver and
    executors. Only where neither that setting nor an earlier call names one and all
    runs in one process (a local master: tests, one-machine runs), a temporary folder
    is taken; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="hitweave-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table that is written and read again."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in shared storage and forget how it was made.

    Reliable on purpose: lost executors cost a read, never a result. The result keeps
    its partitioning, and also the size that Spark estimated for it. Estimates of joins
    are products, so loops whose state is joined with itself use `stored`.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of the tables that `stored` has written and nothing has discarded, by application.
_written: dict[str, dict[str, None]] = {}


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as a table in shared storage and read it again, with the size that it really has.

    Loops discard the tables of the rounds before. The last ones are still read by what
    the loop returns; they stay until `discard_all`, or until the shared folder is cleared.
    """
    path = shared_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, {})[path] = None
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` returned, once nothing reads them or what was derived from them without being stored."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            _delete(df.sparkSession, path)
            _written.get(df.sparkSession.sparkContext.applicationId, {}).pop(path, None)


def discard_all(spark: SparkSession) -> int:
    """Delete all tables that this application has stored, once their results have been written or collected; how many there were."""
    paths = _written.pop(spark.sparkContext.applicationId, {})
    for path in paths:
        _delete(spark, path)
    return len(paths)
