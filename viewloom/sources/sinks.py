"""Tables a job leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.operators.points import STORED_COLUMNS
from viewloom.sources import keyed


def write_splits(samples: DataFrame, path: str) -> None:
    """One Parquet set per split."""
    samples.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def write_embeds(embeds: DataFrame, path: str, model: str | None = None, group_rows: int | None = None) -> None:
    """float32 embeddings, partitioned by model; writing a model replaces only that model.

    ``fallback`` stays with the rows, so zeros that stand for a failed encoder can be counted later.
    With ``model`` all rows are of that model and need no sort.  Readers unpack whole row groups of
    up to some thousand rows, and zeros take no room in a file: for wide embeddings set ``group_rows``.
    """
    columns = {
        "tokens": F.col("tokens").cast("array<array<float>>"),
        "pooled": F.col("pooled").cast("array<float>") if "pooled" in embeds.columns else F.lit(None).cast("array<float>"),
        "attention_mask": F.col("attention_mask").cast("array<float>")
        if "attention_mask" in embeds.columns
        else F.lit(None).cast("array<float>"),
        "fallback": F.col("fallback") if "fallback" in embeds.columns else F.lit(False),
    }
    out = embeds if model is None else embeds.withColumn("model", F.lit(model))
    writer = out.select("model", "uid", *[c.alias(n) for n, c in columns.items()]).write.mode("overwrite")
    if group_rows is not None:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


METRICS = "run STRING, step BIGINT, name STRING, value DOUBLE"


def write_metrics(metrics: DataFrame, path: str) -> None:
    """(run, step, name, value) as they are logged; what is logged again replaces the value of its run, step and name.

    A job that runs again, or only in part, leaves the rows of its other steps alone. See ``keyed`` for the files.
    """
    keyed.merge(metrics.select("run", "step", "name", "value"), path, ["run", "step", "name"])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metric table; a run stays text even if all names are numbers."""
    return keyed.read(spark, path, METRICS).select(F.col("run").cast("string").alias("run"), "step", "name", "value")


def write_gaussians(stored: DataFrame, path: str) -> None:
    """Export table: float32 attributes and byte colours, in the stored column order."""
    columns = [
        F.col(c).cast("int" if c in ("red", "green", "blue") else "float").alias(c) for c in STORED_COLUMNS
    ]
    keys = [c for c in ("uid", "gid") if c in stored.columns]
    stored.select(*keys, *columns).write.mode("overwrite").parquet(path)
