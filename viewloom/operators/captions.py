"""Caption resolution: id lists, id maps and caption tables as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.functions.text import clean_caption, norm_uid, oid_of
from viewloom.operators.skew import skew_join


def caption_pairs(samples: DataFrame, uid_col: str = "uid", caption_col: str = "caption") -> DataFrame:
    """(uid, caption) ready for encoding: uid normalised, empty captions replaced."""
    return samples.select(
        norm_uid(F.col(uid_col).cast("string")).alias("uid"),
        clean_caption(F.col(caption_col).cast("string")).alias("caption"),
    )


def resolve_subset(subset: DataFrame, gidmap: DataFrame) -> DataFrame:
    """(gid) list through the (gid, path) map to (gid, oid)."""
    return subset.select("gid").join(gidmap, "gid").select("gid", oid_of(F.col("path")).alias("oid"))


def unresolved_gids(subset: DataFrame, gidmap: DataFrame) -> DataFrame:
    """Listed gids the map does not know; must be empty."""
    return subset.select("gid").join(gidmap.select("gid"), "gid", "left_anti")


def attach_captions(oids: DataFrame, captions: DataFrame) -> DataFrame:
    """Each row with the caption of its oid; one oid may own any share of the rows."""
    spread = [c for c in oids.columns if c != "oid"] or ["oid"]
    return skew_join(oids, captions.select("oid", "caption"), ["oid"], spread)


def missing_captions(oids: DataFrame, captions: DataFrame) -> DataFrame:
    """Distinct oids without a caption; must be empty."""
    return oids.select("oid").distinct().join(captions.select("oid"), "oid", "left_anti")


def uid_collisions(samples: DataFrame, uid_col: str = "uid") -> DataFrame:
    """Raw ids that the cut at the first dot merges into one uid."""
    return (
        samples.select(norm_uid(F.col(uid_col)).alias("uid"), F.col(uid_col).alias("raw"))
        .groupBy("uid")
        .agg(F.min("raw").alias("first_raw"), F.max("raw").alias("last_raw"), F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("first_raw") != F.col("last_raw"))
    )
