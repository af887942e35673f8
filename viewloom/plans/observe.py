"""What every run reported and left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.operators import artifacts, logs


def run_overview(lines: DataFrame, listing: DataFrame, start: Column) -> DataFrame:
    """One row per run: last reported values, latest checkpoint, outputs to show, bytes on disk."""
    status = logs.run_status(logs.scan_lines(lines))
    latest = artifacts.latest_checkpoint(artifacts.list_checkpoints(listing))
    shown = artifacts.pick_outputs(listing, start)
    size = artifacts.dir_size(listing)
    return (
        status.join(latest, "run", "full")
        .join(shown, "run", "full")
        .join(size, "run", "full")
        .withColumn("reported", F.col("step").isNotNull())
    )
