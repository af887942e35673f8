"""Live run logs.

Streams carry ``run, line_no, line``.  What must be known across batches (the
last step, the last lines, the latest values of a run) is state of the engine's
own operators, keyed by run and restored from the checkpoint after a failure.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from viewloom.operators import logs as L
from viewloom.sources import keyed

LINES = "run STRING, line_no BIGINT, line STRING"


def read_lines(spark: SparkSession, path: str, files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A folder of line tables as a stream; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(LINES).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_metrics(lines: DataFrame) -> DataFrame:
    """Parsed training and validation rows as they arrive (append mode)."""
    return L.parse_lines(lines)


def stream_status(lines: DataFrame) -> DataFrame:
    """Latest values of each run (update or complete mode)."""
    return L.run_status(L.scan_lines(lines))


def stream_asof(lines: DataFrame) -> DataFrame:
    """Validation rows with the last training step of their run, across batches (append mode).

    The engine keeps one step for each run.  Lines of a run must arrive in order
    from batch to batch; inside a batch they may be in any order.  Only lines that
    report something are shuffled; those of one run and batch are sorted in a task,
    so the size of a micro-batch bounds it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values("line_no", kind="stable")
        before = state.get[0] if state.exists else None
        filled = rows["step"].astype("Int64").ffill()
        last = filled.iloc[-1]
        if not pd.isna(last):
            state.update((int(last),))
        rows["step"] = filled.fillna(0 if before is None else before).astype("int64")
        yield rows.loc[rows["psnr"].notna(), ["run", "line_no", "step", "psnr", "lpips", "ssim"]]

    parsed = L.parse_lines(lines).select("run", "line_no", "step", "psnr", "lpips", "ssim")
    return parsed.groupBy("run").applyInPandasWithState(
        step, "run STRING, line_no BIGINT, step BIGINT, psnr DOUBLE, lpips DOUBLE, ssim DOUBLE", "step BIGINT", "append", "NoTimeout"
    )


def stream_tail(lines: DataFrame, n: int = L.KEPT) -> DataFrame:
    """The last n lines of each run that a batch added to (update mode); the engine keeps n lines of each run."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers, texts = state.get if state.exists else ([], [])
        kept = pd.DataFrame({"line_no": pd.Series(numbers, dtype="int64"), "line": pd.Series(texts, dtype=object)})
        for frame in frames:
            kept = pd.concat([kept, frame[["line_no", "line"]]]).sort_values("line_no", kind="stable").tail(n)
        state.update((kept["line_no"].tolist(), kept["line"].tolist()))
        yield kept.assign(run=key[0])[["run", "line_no", "line"]]

    return lines.select("run", "line_no", "line").groupBy("run").applyInPandasWithState(
        step, LINES, "line_no ARRAY<BIGINT>, line ARRAY<STRING>", "update", "NoTimeout"
    )


def publish(latest: DataFrame, out: str, checkpoint: str, key: str = "run") -> DataStreamWriter:
    """Keeps the newest rows of each run of an update stream in a keyed table (``sources.keyed``).

    A batch replaces the rows of the runs it changed and no others; readers see it whole or not at all, and a repeated
    batch changes nothing. The number of files follows the rows, not the runs or the batches.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        keyed.merge(batch, out, [key], source=checkpoint, batch=batch_id)

    return latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(step)


def published(spark: SparkSession, out: str, schema: StructType | str) -> DataFrame:
    """What ``publish`` keeps; ``schema`` is for a table without a batch."""
    return keyed.read(spark, out, schema)


def run_to_end(writer: DataStreamWriter) -> int:
    """Processes everything available; returns the id of the last batch (-1 for none)."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    # a query without new input reports no batch with rows
    done = [p["batchId"] for p in query.recentProgress if p["numInputRows"] > 0]
    return max(done, default=-1)
