"""Render folders to sample shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.operators import views
from viewloom.sources import files, sinks


def sample_list(
    renders: DataFrame, prefix: str, n: int = views.NUM_VIEWS, min_views: int = views.MIN_VIEWS
) -> DataFrame:
    """(uid, name, split, caption) of the objects with enough views; only file names are read."""
    report = views.view_report(views.view_sets(files.render_flags(renders), n), n, min_views)
    names = report.where("enough").select(F.col("uid").alias("name"))
    return views.number_uids(views.holdout_last(names), prefix)


def rejected(renders: DataFrame, n: int = views.NUM_VIEWS, min_views: int = views.MIN_VIEWS) -> DataFrame:
    """Objects left out, with their valid and missing views."""
    report = views.view_report(views.view_sets(files.render_flags(renders), n), n, min_views)
    return report.where(~F.col("enough"))


def pack_samples(
    renders: DataFrame, prefix: str, n: int = views.NUM_VIEWS, min_views: int = views.MIN_VIEWS
) -> DataFrame:
    """Wide samples (uid, caption, split, name, a column pair per view).

    Which object goes where is decided on names; the contents move once, when
    the views of an object come together in its row.
    """
    wide = views.renders_wide(renders.withColumnRenamed("uid", "name"), n, keep=("name",))
    return sample_list(renders, prefix, n, min_views).join(wide, "name").select(
        "uid", "caption", "split", "name", *[f"`{c}`" for c in wide.columns if c != "name"]
    )


def build(
    spark: SparkSession,
    render_dir: str,
    out_dir: str,
    prefix: str,
    n: int = views.NUM_VIEWS,
    min_views: int = views.MIN_VIEWS,
    rejected_dir: str | None = None,
) -> None:
    """Writes one shard set per split; the job fails if an object has too few views.

    The failing objects, all of them, are written to ``rejected_dir`` if one is named.
    """
    renders = files.read_renders(spark, render_dir)
    failing = rejected(renders, n, min_views)
    if rejected_dir is not None:
        failing.write.mode("overwrite").parquet(rejected_dir)
        failing = spark.read.parquet(rejected_dir)
    count, first = failing.agg(F.count(F.lit(1)), F.min("uid")).first()
    if count:
        where = f"listed in {rejected_dir}" if rejected_dir else "see plans.build.rejected"
        raise ValueError(f"{count} objects have fewer than {min_views} valid views, the first is {first}; {where}")
    sinks.write_splits(pack_samples(renders, prefix, n, min_views), out_dir)
