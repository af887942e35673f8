"""Image, retrieval and run metrics.

Per-plane sums are computed where the planes are; only (sum, count) pairs are
shuffled, so a run or view that owns most of the images costs no more.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.functions import pixels as P
from viewloom.operators.skew import skew_join

PLANE = ["uid", "view_id", "channel"]

# Truth views that show 0, 90, 180 and 270 degrees.
EVAL_VIEWS = (0, 10, 20, 30)
# Defaults of the structural similarity.
SSIM_WINDOW = 7
SSIM_K1, SSIM_K2, SSIM_RANGE = 0.01, 0.03, 255.0
COSINE_GUARD = 1e-8
#: Rows of the largest block of a side that a task holds, and blocks of a side that smaller ones may be cut into.
LARGEST_BLOCK, FEW_BLOCKS = 8192, 4


def pair_eval(pred: DataFrame, truth: DataFrame, view_ids: Sequence[int] = EVAL_VIEWS) -> DataFrame:
    """Predicted slot k against truth view ``view_ids[k]``."""
    mapping = F.array(*[F.lit(i) for i in view_ids])
    wanted = pred.where(F.col("slot").between(0, len(view_ids) - 1)).withColumn(
        "view_id", F.get(mapping, F.col("slot"))
    )
    keys = ["uid", "view_id"] + (["channel"] if "channel" in pred.columns and "channel" in truth.columns else [])
    return wanted.withColumnRenamed("data", "a").join(
        truth.where(F.col("view_id").isin(list(view_ids))).withColumnRenamed("data", "b").select(*keys, "b"), keys
    )


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of either side without a partner; must be empty before scoring."""
    keys = list(keys)
    both = left.select(*keys, F.lit(True).alias("_l")).join(right.select(*keys, F.lit(True).alias("_r")), keys, "full")
    return both.where(F.col("_l").isNull() | F.col("_r").isNull()).select(
        *keys, F.when(F.col("_l").isNull(), F.lit("right")).otherwise(F.lit("left")).alias("only_in")
    )


def plane_mse(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean squared error of plane pairs (a, b), pooled over ``by``.

    The pixels are exploded into generated code and summed before the shuffle:
    what is exchanged is one sum and one count per group and task.
    """
    zipped = F.arrays_zip(P.like(F.col("a"), F.col("b")).alias("a"), F.col("b"))
    pixels = pairs.select(*by, F.explode_outer(zipped).alias("_p")).where(F.col("_p").isNotNull())
    error = F.col("_p.a").cast("double") - F.col("_p.b").cast("double")
    return pixels.groupBy(*by).agg(F.avg(error * error).alias("mse"))


def psnr(pairs: DataFrame, by: Sequence[str] = ("uid", "view_id")) -> DataFrame:
    """Per-image score: one mean over all channels and pixels of the image."""
    return plane_mse(pairs, by).withColumn("psnr", P.psnr_of(F.col("mse")))


def psnr_pooled(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """One mean over all images of a group, then the logarithm; not the mean of ``psnr``."""
    return plane_mse(pairs, by).withColumn("psnr", P.psnr_of(F.col("mse")))


def _plane_scorer():
    """The Arrow function behind ``ssim``.

    It is built inside a function so that it travels by value: executors need
    numpy and pyarrow, not this package.
    """
    window, area = SSIM_WINDOW, SSIM_WINDOW * SSIM_WINDOW
    c1, c2 = (SSIM_K1 * SSIM_RANGE) ** 2, (SSIM_K2 * SSIM_RANGE) ** 2

    def box_means(stack):
        """Means over every window of a (N, h, w) integer stack, from exact sums."""
        sums = np.zeros((stack.shape[0], stack.shape[1] + 1, stack.shape[2] + 1), dtype=np.int64)
        sums[:, 1:, 1:] = stack.cumsum(axis=1).cumsum(axis=2)
        return (
            sums[:, window:, window:] - sums[:, :-window, window:] - sums[:, window:, :-window] + sums[:, :-window, :-window]
        ) / area

    def scores_of(a, b):
        a, b = a.astype(np.int64), b.astype(np.int64)
        ux, uy = box_means(a), box_means(b)
        sample = area / (area - 1)
        vx = sample * (box_means(a * a) - ux * ux)
        vy = sample * (box_means(b * b) - uy * uy)
        vxy = sample * (box_means(a * b) - ux * uy)
        score = ((2 * ux * uy + c1) * (2 * vxy + c2)) / ((ux * ux + uy * uy + c1) * (vx + vy + c2))
        return score.mean(axis=(1, 2))

    def as_bytes(planes, index, height, width):
        flat = planes.take(index).flatten().to_numpy(zero_copy_only=False)
        # pixels are truncated, not rounded, to bytes in the stored precision
        return (flat * flat.dtype.type(255)).astype(np.uint8).reshape(-1, height, width)

    def score(a: pa.Array, b: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        heights, widths = h.to_numpy(zero_copy_only=False), w.to_numpy(zero_copy_only=False)
        out = np.full(len(a), np.nan)
        for height, width in sorted(set(zip(heights.tolist(), widths.tolist()))):
            if min(height, width) < window:
                continue
            rows = np.flatnonzero((heights == height) & (widths == width))
            # a few planes at a time bounds the integer work space
            step = max(1, (1 << 22) // (height * width))
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                index = pa.array(part)
                out[part] = scores_of(as_bytes(a, index, height, width), as_bytes(b, index, height, width))
        return pa.array(out, mask=np.isnan(out))

    return F.arrow_udf(score, "double")


def ssim(pairs: DataFrame, by: Sequence[str] = ("uid", "view_id")) -> DataFrame:
    """Structural similarity: mean over window positions, then over channels.

    Window sums need every pixel's neighbours, so the planes are scored in
    place as Arrow batches; a shuffle of exploded pixels would move each pixel
    twice.  Planes narrower than the window score NULL.
    """
    scored = pairs.select(*by, _plane_scorer()("a", "b", "h", "w").alias("_s"))
    return scored.groupBy(*by).agg(F.avg("_s").alias("ssim"))


def image_scores(pairs: DataFrame, by: Sequence[str] = ("uid", "view_id")) -> DataFrame:
    """PSNR and SSIM of each image from one pass over its planes."""

    def squared(x: Column, y: Column) -> Column:
        error = x.cast("double") - y.cast("double")
        return error * error

    errors = F.zip_with(P.like(F.col("a"), F.col("b")), "b", squared)
    scored = pairs.select(
        *by,
        _plane_scorer()("a", "b", "h", "w").alias("_s"),
        F.aggregate(errors, F.lit(0.0), lambda t, e: t + e).alias("_e"),
        F.size("a").alias("_n"),
    )
    sums = scored.groupBy(*by).agg((F.sum("_e") / F.sum("_n")).alias("_mse"), F.avg("_s").alias("ssim"))
    return sums.select(*by, P.psnr_of(F.col("_mse")).alias("psnr"), "ssim")


def score_summary(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means and spreads: sample deviation for psnr and lpips, population for ssim."""
    columns = []
    for name, spread in (("psnr", F.stddev_samp), ("lpips", F.stddev_samp), ("ssim", F.stddev_pop)):
        if name in scores.columns:
            columns += [F.avg(name).alias(f"{name}_mean"), spread(name).alias(f"{name}_std")]
    return scores.groupBy(*by).agg(*columns)


def _cosine(a: Column, b: Column) -> Column:
    return F.try_divide(P.dot(a, b), F.sqrt(P.dot(a, a)) * F.sqrt(P.dot(b, b)))


def clip_scores(images: DataFrame, texts: DataFrame, group: str = "grp", idx: str = "idx") -> DataFrame:
    """Cosine of each image with its own text."""
    pairs = images.select(group, idx, F.col("vec").alias("_a")).join(
        texts.select(group, idx, F.col("vec").alias("_b")), [group, idx]
    )
    return pairs.select(group, idx, _cosine(F.col("_a"), F.col("_b")).alias("score"))


def clip_sim(images: DataFrame, texts: DataFrame, group: str = "grp", idx: str = "idx") -> DataFrame:
    return clip_scores(images, texts, group, idx).groupBy(group).agg(F.avg("score").alias("clip_sim"))


def _block_matcher():
    """The pandas function behind ``best_texts``; built inside so that it travels by value."""
    slice_rows = 512

    def unit(vectors):
        stack = np.stack(vectors.to_numpy()).astype(np.float64)
        return stack / np.linalg.norm(stack, axis=1, keepdims=True)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """For each image of a block its best text of a block, the lowest index on a tie."""
        if left.empty or right.empty:
            empty = np.empty(0, np.int64)
            return pd.DataFrame({"grp": empty, "idx": empty, "best": np.empty(0), "best_idx": empty})
        right = right.sort_values("idx")
        images, texts = unit(left["vec"]), unit(right["vec"])
        top, at = np.empty(len(images)), np.empty(len(images), np.int64)
        # a slice of images at a time bounds the score matrix
        for start in range(0, len(images), slice_rows):
            scores = images[start : start + slice_rows] @ texts.T
            at[start : start + slice_rows] = scores.argmax(axis=1)
            top[start : start + slice_rows] = scores.max(axis=1)
        return pd.DataFrame(
            {
                "grp": left["grp"].to_numpy(),
                "idx": left["idx"].to_numpy(),
                "best": top,
                "best_idx": right["idx"].to_numpy()[at],
            }
        )

    return best


def blocks_of(rows: Column, block: int) -> Column:
    """Into how many blocks so many rows go.

    Each block meets all of the other side's, so a row is copied once for each of those.  Small blocks are cut for
    a few only; from there on blocks grow with the rows, up to what a task holds.
    """
    by_size = F.ceil(rows / F.lit(max(block, LARGEST_BLOCK)))
    return F.least(F.ceil(rows / F.lit(block)), F.greatest(F.lit(FEW_BLOCKS), by_size)).cast("int")


def best_texts(images: DataFrame, texts: DataFrame, block: int = 8192) -> DataFrame:
    """(grp, idx, best, best_idx): the best-scoring text of the group for every image.

    ``images`` and ``texts`` are (grp BIGINT, idx BIGINT, vec).  A group is cut
    into blocks of about ``block`` rows a side, or larger ones (``blocks_of``);
    each pair of blocks is one matrix product that returns one row per image,
    so neither the pairs nor a whole group are ever held anywhere.
    """

    def cut(side: DataFrame, own: str, other: str, sizes: DataFrame) -> DataFrame:
        placed = skew_join(side.select("grp", "idx", "vec"), sizes, ["grp"], ["idx"])
        return placed.select(
            "grp",
            "idx",
            "vec",
            F.pmod(F.xxhash64("idx"), F.col(f"n_{own}")).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), (F.col(f"n_{other}") - 1).cast("int"))).alias(other),
        )

    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("grp").agg(blocks_of(F.count(F.lit(1)), block).alias(name))

    sizes = blocks(images, "n_ib").join(blocks(texts, "n_tb"), "grp")
    keys = ["grp", "ib", "tb"]
    left = cut(images, "ib", "tb", sizes)
    right = cut(texts, "tb", "ib", sizes)
    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(_block_matcher(), "grp BIGINT, idx BIGINT, best DOUBLE, best_idx BIGINT")
    )
    top = F.max(F.struct("best", (-F.col("best_idx")).alias("low"))).alias("t")
    return found.groupBy("grp", "idx").agg(top).select(
        "grp", "idx", F.col("t.best").alias("best"), (-F.col("t.low")).alias("best_idx")
    )


def r_precision(images: DataFrame, texts: DataFrame, block: int = 8192) -> DataFrame:
    """Share of images whose best text is their own."""
    own = (F.col("best_idx") == F.col("idx")).cast("double")
    return best_texts(images, texts, block).groupBy("grp").agg(F.avg(own).alias("r_precision"))


def view_summary(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and population deviation over views of each score; blanks are skipped."""
    columns = []
    for name in names:
        columns += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
    return scores.agg(*columns)


def normal_cosine(pairs: DataFrame, by: Sequence[str] = ("uid", "view_id")) -> DataFrame:
    """Mean over pixels of the cosine between two normal images, along the channels.

    ``pairs`` has ax, ay, az and bx, by, bz arrays, one row per view.
    """
    zipped = [P.like(F.col(c), F.col("bz")).alias(c) for c in ("ax", "ay", "az", "bx", "by")] + [F.col("bz")]
    pixels = pairs.select(*by, F.explode_outer(F.arrays_zip(*zipped)).alias("_p")).where(F.col("_p").isNotNull())
    a, b = ([F.col(f"_p.{side}{c}").cast("double") for c in "xyz"] for side in "ab")
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    lengths = [F.greatest(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]), F.lit(COSINE_GUARD)) for v in (a, b)]
    return pixels.groupBy(*by).agg(F.avg(dot / (lengths[0] * lengths[1])).alias("normal_cosim"))


def elev_mae(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute elevation error in degrees."""
    return pairs.groupBy(*by).agg(F.avg(F.abs(F.col("pred") - F.col("truth"))).alias("err_degree"))


def val_rollup(batch_scores: DataFrame, max_steps: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(name, value): mean over the first batches of each metric and guidance scale.

    Scale 1.0 is reported under its own prefix.
    """
    kept = batch_scores if max_steps is None else batch_scores.where(F.col("batch_id") < max_steps)
    means = kept.groupBy(*by, "metric", "cfg").agg(F.avg("value").alias("value"))
    label = F.concat(F.col("metric"), F.lit("_cfg"), F.format_string("%.1f", F.col("cfg").cast("double")))
    prefix = F.when(F.contains(label, F.lit("cfg1.0")), F.lit("validation_cfg1.0/")).otherwise(F.lit("validation/"))
    return means.select(*by, F.concat(prefix, label).alias("name"), "value")


def rank_mean(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over ranks of a value each rank repeats once per sample of its batch."""
    return scores.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("value") * F.col("batch_size")), F.sum("batch_size")).alias("value")
    )
