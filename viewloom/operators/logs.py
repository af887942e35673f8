"""Run logs in batch: ``lines(run, line_no, line)`` with line_no increasing inside a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewloom.functions import logs as L
from viewloom.operators.rows import explode_rows, keep_rows

# Lines shown, read from a file, and kept per run.
SHOWN, FROM_FILE, KEPT = 100, 120, 600

# Lines of one run that a single task walks through in the as-of join.
CHUNK = 1 << 20


def _train_columns(lines: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    split = lines.withColumn("_t", L.train_fields(F.col("line")))
    step, loss, lr = (F.get("_t", F.lit(i)) for i in (1, 2, 3))
    return split.select(
        *keep,
        step.try_cast("bigint").alias("step"),
        L.number_or_null(loss, "double").alias("loss"),
        L.number_or_null(lr, "double").alias("lr"),
    )


def _val_columns() -> list[Column]:
    return [L.val_score(F.col("line"), name).alias(name) for name in ("psnr", "lpips", "ssim")]


def parse_train(lines: DataFrame) -> DataFrame:
    """(run, line_no, step, loss, lr) of lines that report a finite loss."""
    parsed = _train_columns(lines.where(L.is_train_candidate(F.col("line"))), ("run", "line_no"))
    return keep_rows(parsed, F.col("step").isNotNull() & F.col("loss").isNotNull())


def parse_val(lines: DataFrame) -> DataFrame:
    """(run, line_no, psnr, lpips, ssim); ssim may be NULL, the others may not."""
    parsed = lines.where(L.is_val_candidate(F.col("line"))).select("run", "line_no", *_val_columns())
    return keep_rows(parsed, F.col("psnr").isNotNull() & F.col("lpips").isNotNull())


def scan_lines(lines: DataFrame) -> DataFrame:
    """Candidate lines with all columns: (step, loss, lr) and (psnr, lpips, ssim), NULL if not reported.

    Rows are chosen by plain substring tests; a few may hold nothing but NULLs.
    """
    line = F.col("line")
    candidates = lines.where(L.is_train_candidate(line) | L.is_val_candidate(line))
    parsed = _train_columns(
        candidates.select("run", "line_no", "line", *[c.alias(f"_{i}") for i, c in enumerate(_val_columns())]),
        ("run", "line_no", "_0", "_1", "_2"),
    )
    trained = F.col("loss").isNotNull()
    scored = F.col("_0").isNotNull() & F.col("_1").isNotNull()
    return parsed.select(
        "run",
        "line_no",
        *[F.when(trained, F.col(c)).alias(c) for c in ("step", "loss", "lr")],
        *[F.when(scored, F.col(f"_{i}")).alias(c) for i, c in enumerate(("psnr", "lpips", "ssim"))],
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """``scan_lines`` without the rows that report nothing."""
    return keep_rows(scan_lines(lines), F.col("step").isNotNull() | F.col("psnr").isNotNull())


def asof_step(parsed: DataFrame, carried: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Validation rows with the latest training step at or before them in their run.

    ``parsed`` comes from ``scan_lines`` or ``parse_lines`` (it is read twice:
    store it first where parsing dominates); ``carried(run, step)`` is the last
    step of earlier input; without any step the answer is 0.  A run is cut into
    chunks of line numbers: the last step of each chunk is a partial
    aggregation, the chunk summaries are carried forward, and the lines are
    walked chunk by chunk, so one very long run is shared by many tasks.
    """
    cut = parsed.withColumn("_chunk", F.floor(F.col("line_no") / chunk))
    last = cut.groupBy("run", "_chunk").agg(
        F.max_by("step", F.when(F.col("step").isNotNull(), F.col("line_no"))).alias("_last")
    )
    before = W.partitionBy("run").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    entering = last.select("run", "_chunk", F.last("_last", ignorenulls=True).over(before).alias("_in"))
    if carried is not None:
        entering = entering.join(carried.select("run", F.col("step").alias("_carried")), "run", "left").select(
            "run", "_chunk", F.coalesce("_in", "_carried").alias("_in")
        )
    inside = W.partitionBy("run", "_chunk").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    walked = cut.join(entering, ["run", "_chunk"]).withColumn(
        "step", F.coalesce(F.last("step", ignorenulls=True).over(inside), F.col("_in"), F.lit(0))
    )
    return walked.where(F.col("psnr").isNotNull()).select("run", "line_no", "step", "psnr", "lpips", "ssim")


def last_steps(parsed: DataFrame) -> DataFrame:
    """(run, step, line_no) of the last training line of each run."""
    return (
        parsed.where(F.col("step").isNotNull())
        .groupBy("run")
        .agg(F.max_by("step", "line_no").alias("step"), F.max("line_no").alias("line_no"))
    )


def tail_lines(lines: DataFrame, n: int = SHOWN) -> DataFrame:
    """The last n lines of each run.

    The rank filter is applied before the shuffle too, so at most n lines of a
    run leave a task.
    """
    ranked = lines.withColumn("_r", F.row_number().over(W.partitionBy("run").orderBy(F.col("line_no").desc())))
    return ranked.where(F.col("_r") <= n).drop("_r")


def run_status(parsed: DataFrame) -> DataFrame:
    """Latest step, loss, lr and latest psnr, lpips, ssim of each run; one partial aggregation."""
    at = {c: F.when(F.col(c).isNotNull(), F.col("line_no")) for c in ("step", "psnr", "ssim")}
    return parsed.groupBy("run").agg(
        F.max_by("step", at["step"]).alias("step"),
        F.max_by("loss", at["step"]).alias("loss"),
        F.max_by("lr", at["step"]).alias("lr"),
        F.max_by("psnr", at["psnr"]).alias("psnr"),
        F.max_by("lpips", at["psnr"]).alias("lpips"),
        F.max_by("ssim", at["ssim"]).alias("ssim"),
    )


def metric_rows(parsed: DataFrame, prefix_train: str = "training", prefix_val: str = "validation") -> DataFrame:
    """Parsed lines (with validation steps resolved) as (run, step, name, value)."""

    def rows(df: DataFrame, prefix: str, names: tuple[str, ...]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(f"{prefix}/{n}").alias("name"), F.col(n).alias("value")) for n in names])
        reported = F.filter(cells, lambda c: c["value"].isNotNull())
        return explode_rows(df, reported, "m", ["run", "step"]).select("run", "step", "m.name", "m.value")

    train = rows(parsed, prefix_train, ("loss", "lr"))
    return train.unionByName(rows(asof_step(parsed), prefix_val, ("psnr", "lpips", "ssim")))
