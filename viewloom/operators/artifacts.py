"""Checkpoints, rendered outputs, model files and run lineage from file listings.

Listings are ``(run, path, name, mtime, length)``.  "Newest" is always the
largest (mtime, name), taken by a partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.functions.text import output_iter, padded
from viewloom.operators.rows import explode_rows
from viewloom.operators.skew import skew_join
from viewloom.session import cut_lineage

# Model file suffixes, best first, and the one that cannot be read.
MODEL_SUFFIXES = (".blend", ".fbx", ".3ds", ".obj")
UNREADABLE_SUFFIX = ".max"
# Byte units.
UNITS = ("B", "KB", "MB", "GB", "TB")
STRIP_SUFFIX = "_gs.png"
VIDEO_SUFFIXES = (".gif", ".mp4")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    """Name without its last suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def list_checkpoints(artifacts: DataFrame) -> DataFrame:
    """(run, ckpt) of every iteration folder below a run's ``checkpoints``."""
    folder = F.regexp_extract("path", r"/checkpoints/(\d+)(?:/|$)", 1)
    return (
        artifacts.select("run", folder.alias("_f")).where(F.col("_f") != "").distinct()
        .select("run", F.col("_f").alias("folder"), F.col("_f").try_cast("bigint").alias("ckpt"))
    )


def list_experiments(artifacts: DataFrame) -> DataFrame:
    """Runs whose ``checkpoints`` folder is not empty."""
    return artifacts.where(F.contains("path", F.lit("/checkpoints/"))).select("run").distinct()


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("run").agg(F.max("ckpt").alias("ckpt"))


def inference_outputs(artifacts: DataFrame) -> DataFrame:
    """Files that lie directly in a run's ``inference`` folder; copies elsewhere are no outputs of it."""
    place = F.concat(F.lit("/"), F.col("run").cast("string"), F.lit("/inference/"), F.col("name"))
    return artifacts.where(F.endswith(F.col("path"), place))


def inference_iters(artifacts: DataFrame) -> DataFrame:
    """(run, iter) of the rendered strips."""
    found = inference_outputs(artifacts).select("run", output_iter(F.col("path")).alias("iter"))
    return found.where(F.col("iter").isNotNull()).distinct()


def latest_strip(artifacts: DataFrame, iteration: int | Column) -> DataFrame:
    """Per run the last strip, by name, of an iteration."""
    it = F.lit(iteration) if isinstance(iteration, int) else iteration
    wanted = F.concat(F.lit("_"), padded(it, 6), F.lit(STRIP_SUFFIX))
    return inference_outputs(artifacts).where(F.endswith(F.col("name"), wanted)).groupBy("run").agg(F.max("name").alias("name"))


def without_strip(runs: DataFrame, artifacts: DataFrame, iteration: int | Column) -> DataFrame:
    """Runs that lack a strip for the iteration."""
    return runs.select("run").join(latest_strip(artifacts, iteration), "run", "left_anti")


def _is_video(name: Column) -> Column:
    return F.endswith(name, F.lit(VIDEO_SUFFIXES[0])) | F.endswith(name, F.lit(VIDEO_SUFFIXES[1]))


def recent_outputs(artifacts: DataFrame, start: Column) -> DataFrame:
    """Images and videos written since a second before ``start``, oldest first."""
    name = F.col("name")
    kind = F.endswith(name, F.lit(".png")) | _is_video(name)
    return inference_outputs(artifacts).where(kind & _recent(start)).orderBy("mtime", "name")


def _recent(start: Column) -> Column:
    return F.col("mtime") >= start - F.expr("INTERVAL 1 SECOND")


def pick_outputs(artifacts: DataFrame, start: Column) -> DataFrame:
    """(run, image, video) to show after an inference that began at ``start``.

    The newest recent strip and the recent video of the same stem; failing that
    the newest recent video; failing that the newest of all.
    """
    name = F.col("name")
    is_image = F.endswith(name, F.lit(STRIP_SUFFIX))
    own_stem = F.when(is_image, F.expr(f"left(name, length(name) - {len(STRIP_SUFFIX)})")).otherwise(stem(name))
    listed = inference_outputs(artifacts).where(is_image | _is_video(name))
    listed = listed.withColumns({"_stem": own_stem, "_at": F.struct("mtime", "name"), "_new": _recent(start)})

    def newest(condition: Column) -> Column:
        return F.max(F.when(condition, F.col("_at")))

    per_stem = listed.groupBy("run", "_stem").agg(
        newest(is_image & F.col("_new")).alias("new_image"),
        newest(is_image).alias("any_image"),
        newest(_is_video(name) & F.col("_new")).alias("new_video"),
        newest(_is_video(name)).alias("any_video"),
    )
    # the newest recent strip brings the recent video of its stem along
    own = F.when(F.col("new_image").isNotNull(), F.struct("new_image", "new_video"))
    per_run = per_stem.groupBy("run").agg(
        F.max(own).alias("own"), *[F.max(c).alias(c) for c in ("any_image", "new_video", "any_video")]
    )
    return per_run.select(
        "run",
        F.coalesce("own.new_image.name", "any_image.name").alias("image"),
        F.coalesce("own.new_video.name", "new_video.name", "any_video.name").alias("video"),
    )


def dir_size(artifacts: DataFrame, unit: str = "B", by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Bytes below each prefix in steps of 1024."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    total = F.sum("length")
    if unit != "B":
        total = total / F.lit(1024.0 ** UNITS.index(unit))
    return artifacts.groupBy(*by).agg(total.alias("size"))


def _priority(name: Column) -> Column:
    chosen = None
    for i, suffix in enumerate(MODEL_SUFFIXES):
        hit = F.endswith(name, F.lit(suffix))
        chosen = F.when(hit, F.lit(i)) if chosen is None else chosen.when(hit, F.lit(i))
    return chosen.when(F.endswith(name, F.lit(UNREADABLE_SUFFIX)), F.lit(len(MODEL_SUFFIXES)))


def choose_model_file(files: DataFrame) -> DataFrame:
    """(object, name, source, usable): one model file per object.

    ``files(folder, name)``, folder NULL for flat files.  In a folder the best
    suffix wins, then the first name; a folder that only holds the unreadable
    format is reported as not usable.  Flat files follow, one per stem, unless
    a usable folder has that name.
    """
    ranked = files.withColumn("_p", _priority(F.col("name"))).where(F.col("_p").isNotNull())
    best = F.min(F.struct("_p", "name")).alias("b")
    usable = (F.col("b._p") < len(MODEL_SUFFIXES)).alias("usable")
    folders = (
        ranked.where(F.col("folder").isNotNull())
        .groupBy(F.col("folder").alias("object"))
        .agg(best)
        .select("object", F.col("b.name").alias("name"), F.lit("folder").alias("source"), usable)
    )
    flat = (
        ranked.where(F.col("folder").isNull())
        .groupBy(stem(F.col("name")).alias("object"))
        .agg(best)
        .select("object", F.col("b.name").alias("name"), F.lit("flat").alias("source"), usable)
    )
    taken = folders.where("usable").select("object")
    return folders.unionByName(flat.join(taken, "object", "left_anti"))


def resolve_base(run_params: DataFrame) -> DataFrame:
    """(run, ckpt, root_run, root_ckpt, status) following adapters to their base.

    ``run_params(run, ckpt, is_adapter, base_run, base_ckpt)`` has one row per
    checkpoint.  Every round doubles the pointers with one join and is
    checkpointed: round r settles all chains of up to 2^r steps.  A chain longer
    than that has members of every shorter length, so a round that settles
    nothing proves that the rest runs in circles.  A chain that ends in an
    unknown checkpoint is ``missing``; circles and missing ends give NULL roots.
    Many adapters may share one base: the first join spreads hot bases and
    settles all direct adapters, so only chains of adapters go into the rounds.
    """
    known = run_params.select(
        F.col("run").alias("base_run"), F.col("ckpt").alias("base_ckpt"), F.col("is_adapter").alias("_base_adapter")
    )
    base = {
        "base_run": F.when(F.col("is_adapter"), F.col("base_run")).otherwise(F.col("run")),
        "base_ckpt": F.when(F.col("is_adapter"), F.col("base_ckpt")).otherwise(F.col("ckpt")),
    }
    direct = run_params.select("run", "ckpt", "is_adapter", *[c.alias(n) for n, c in base.items()])
    exists = F.col("_base_adapter").isNotNull()
    status = (
        F.when(~exists, F.lit("missing"))
        .when(~F.col("is_adapter"), F.lit("root"))
        .when(~F.col("_base_adapter"), F.lit("resolved"))
        .otherwise(F.lit("open"))
    )
    state = cut_lineage(
        skew_join(direct, known, ["base_run", "base_ckpt"], ["run", "ckpt"], "left").select(
            "run",
            "ckpt",
            F.when(exists, F.col("base_run")).alias("root_run"),
            F.when(exists, F.col("base_ckpt")).alias("root_ckpt"),
            status.alias("status"),
        )
    )
    is_open = F.col("status") == "open"
    left = state.where(is_open).count()
    while left:
        target = state.select(
            F.col("run").alias("root_run"),
            F.col("ckpt").alias("root_ckpt"),
            F.struct(F.col("root_run").alias("run"), F.col("root_ckpt").alias("ckpt"), "status").alias("_next"),
        )
        moved = state.where(is_open).join(target, ["root_run", "root_ckpt"], "left").select(
            "run",
            "ckpt",
            F.col("_next.run").alias("root_run"),
            F.col("_next.ckpt").alias("root_ckpt"),
            F.when(F.col("_next.status") == "root", F.lit("resolved")).otherwise(F.col("_next.status")).alias("status"),
        )
        state = cut_lineage(state.where(~is_open).unionByName(moved))
        before, left = left, state.where(is_open).count()
        if left == before:
            break
    return state.select(
        "run",
        "ckpt",
        F.when(~is_open, F.col("root_run")).alias("root_run"),
        F.when(~is_open, F.col("root_ckpt")).alias("root_ckpt"),
        F.when(is_open, F.lit("cycle")).otherwise(F.col("status")).alias("status"),
    )


def expected_steps(calendar: DataFrame) -> DataFrame:
    """(run, step, save, evaluate): the steps at which a run should save or evaluate.

    ``calendar(run, total_steps, steps_per_epoch, save_freq, save_freq_epoch,
    eval_freq, eval_freq_epoch, early_eval, early_eval_freq)``; the early columns
    may be NULL.  Only the listed steps are generated, never all of them.
    """
    total = F.col("total_steps")

    def every(freq: Column, upto: Column = total) -> Column:
        usable = freq.isNotNull() & (freq > 0) & (freq <= upto)
        step = F.when(usable, freq).otherwise(F.lit(1))
        return F.when(usable, F.sequence(step, F.when(usable, upto).otherwise(F.lit(1)), step)).otherwise(
            F.array().cast("array<bigint>")
        )

    last = F.array(total)
    saves = F.array_union(
        F.array_union(every(F.col("save_freq")), every(F.col("save_freq_epoch") * F.col("steps_per_epoch"))), last
    )
    early_end = F.when(F.col("early_eval").isNotNull(), F.least(F.col("early_eval") - 1, total))
    early = every(F.col("early_eval_freq"), early_end)
    evals = F.array_union(
        F.array_union(every(F.col("eval_freq")), every(F.col("eval_freq_epoch") * F.col("steps_per_epoch"))),
        F.array_union(F.coalesce(early, F.array().cast("array<bigint>")), F.array_union(F.array(F.lit(1).cast("bigint")), last)),
    )
    both = calendar.select("run", saves.alias("_s"), evals.alias("_e"))
    return explode_rows(both, F.array_union("_s", "_e"), "step", ["run", "_s", "_e"]).select(
        "run",
        "step",
        F.array_contains("_s", F.col("step")).alias("save"),
        F.array_contains("_e", F.col("step")).alias("evaluate"),
    )


def audit_checkpoints(calendar: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(run, step, problem): saves that are missing and folders nobody expected."""
    due = expected_steps(calendar).where("save").select("run", "step", F.lit(True).alias("_due"))
    there = checkpoints.select("run", F.col("ckpt").alias("step"), F.lit(True).alias("_there"))
    both = due.join(there, ["run", "step"], "full")
    return both.where(F.col("_due").isNull() | F.col("_there").isNull()).select(
        "run", "step", F.when(F.col("_there").isNull(), F.lit("missing")).otherwise(F.lit("unexpected")).alias("problem")
    )
