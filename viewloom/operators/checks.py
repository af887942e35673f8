"""Data checks: each returns the offending rows, so an empty table means it passed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.operators import captions, metrics
from viewloom.operators.views import MIN_VIEWS, NUM_VIEWS, view_report


def too_few_views(sets: DataFrame, n: int = NUM_VIEWS, min_views: int = MIN_VIEWS) -> DataFrame:
    return view_report(sets, n, min_views).where(~F.col("enough"))


def captions_missing(oids: DataFrame, table: DataFrame) -> DataFrame:
    return captions.missing_captions(oids, table)


def broken_assets(views: DataFrame, files: Sequence[str]) -> DataFrame:
    """Views with at least one missing file, and which."""
    gone = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in files]), lambda f: f.isNotNull())
    return views.select("uid", "view_id", gone.alias("missing")).where(F.size("missing") > 0)


def check_view_counts(v: int, v_in: int, ring_sizes: Sequence[int] = (12,)) -> None:
    """A sample holds at least its input views, and even picks divide their rings."""
    if v < v_in:
        raise ValueError("a sample needs at least as many views as input views")
    if any(size % v_in for size in ring_sizes):
        raise ValueError("the number of input views must divide the ring size")


def depth_without_background(depth: DataFrame) -> DataFrame:
    """Samples whose masked depth has no zero anywhere; input from ``normalize_depth``."""
    return depth.groupBy("uid").agg(F.bool_or("has_zero").alias("has_zero")).where(~F.col("has_zero")).select("uid")


def elevation_out_of_range(binned: DataFrame) -> DataFrame:
    return binned.where(~F.col("elev_valid"))


def unequal_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return metrics.unmatched(left, right, keys)
