"""Shared folder and lineage helpers.

Everything that must outlive an executor goes to the folder the cluster names
in ``spark.checkpoint.dir``.  Where that is not set, as in tests, it goes below
the warehouse, which all executors share, too.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; see ``drop_scratch``."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes it
    when the frame is no longer used.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)


def scratch_mark() -> int:
    """A mark that ``drop_scratch`` can go back to."""
    return len(_written)


def drop_scratch(spark: SparkSession, since: int = 0, keep: Collection[str] = ()) -> int:
    """Deletes the scratch tables that this process wrote since a mark, but for those to ``keep``.

    Frames that read them are of no use afterwards.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf, gone = spark.sparkContext._jsc.hadoopConfiguration(), 0
    kept = [path for path in _written[since:] if path in keep]
    for name in _written[since:]:
        if name not in keep:
            path = hadoop.Path(name)
            gone += path.getFileSystem(conf).delete(path, True)
    _written[since:] = kept
    return gone


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """``df`` written to a scratch table and read again; all other scratch since the mark is deleted."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    drop_scratch(df.sparkSession, since, keep=[path])
    return df.sparkSession.read.parquet(path)
