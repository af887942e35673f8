"""Exact best matches without looking at all pairs.

Texts lie in cells around anchors, which are some of the texts themselves. On the sphere the angle between an image and
any text of a cell is at least its angle to the anchor less the cell's radius. So an image looks into the cell of its
own nearest anchor first, and then only into those cells that by this bound may hold a better text. What it finds is
what comparing it with all texts would find.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewloom.operators.metrics import _block_matcher, blocks_of
from viewloom.operators.skew import skew_join
from viewloom.session import scratch_path

ANCHORS, BLOCK = 64, 8192
#: Angles are known to so many radians.
SLACK = 1e-6


def pick_anchors(texts: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(grp, a, anchor): the texts of a group with the smallest hashes; a rank limit that Spark applies before the shuffle."""
    drawn = W.partitionBy("grp").orderBy(F.xxhash64("grp", "idx"), "idx")
    ranked = texts.select("grp", F.col("vec").alias("anchor"), F.row_number().over(drawn).alias("a"))
    # columns of their own: anchors meet the texts they come from
    return ranked.where(F.col("a") <= anchors).select(*(F.col(c).alias(c) for c in ("grp", "anchor", "a")))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _sizes(rows: DataFrame, keys: list[str], block: int, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(blocks_of(F.count(F.lit(1)), block).alias(name))


def _places() -> object:
    """The pandas function behind ``place``; built inside so that it travels by value."""

    def unit(vectors):
        stack = np.stack(vectors.to_numpy()).astype(np.float64)
        length = np.linalg.norm(stack, axis=1, keepdims=True)
        return stack / np.where(length == 0, 1, length)

    def place(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or anchors.empty:
            numbers, lists = np.empty(0, np.int64), pd.Series([], dtype=object)
            return pd.DataFrame({"grp": numbers, "idx": numbers, "vec": lists, "a": numbers.astype(np.int32), "angles": lists})
        anchors = anchors.sort_values("a")
        angles = np.arccos(np.clip(unit(rows["vec"]) @ unit(anchors["anchor"]).T, -1, 1))
        nearest = anchors["a"].to_numpy()[angles.argmin(axis=1)]
        return pd.DataFrame({"grp": rows["grp"], "idx": rows["idx"], "vec": rows["vec"], "a": nearest, "angles": list(angles)})

    return place


def place(rows: DataFrame, anchors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(grp, idx, vec, a, angles): each row's nearest anchor, and its angles to all anchors of its group in their order."""
    sizes = _sizes(rows, ["grp"], block, "n")
    dealt = skew_join(rows.select("grp", "idx", "vec"), sizes, ["grp"], ["idx"])
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("idx"), "n").cast("int")).drop("n")
    copies = anchors.join(sizes, "grp").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    kind = dict(rows.dtypes)["vec"]
    fields = f"grp BIGINT, idx BIGINT, vec {kind}, a INT, angles ARRAY<DOUBLE>"
    return dealt.groupBy("grp", "b").cogroup(copies.groupBy("grp", "b")).applyInPandas(_places(), fields)


def _matched(images: DataFrame, cells: DataFrame, block: int) -> DataFrame:
    """(grp, idx, best, best_idx): each image's best text of each cell (``a``) it is listed for, block by block."""
    keys = ["grp", "a"]
    sizes = _sizes(images, keys, block, "n_i").join(_sizes(cells, keys, block, "n_t"), keys)

    def cut(side: DataFrame, own: str, other: str) -> DataFrame:
        placed = skew_join(side.select(*keys, "idx", "vec"), sizes, keys, ["idx"])
        part = F.pmod(F.xxhash64("idx"), F.col(f"n_{own}")).cast("int").alias(own)
        return placed.select(*keys, "idx", "vec", part, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(other))

    left, right = cut(images, "i", "t"), cut(cells, "t", "i")
    groups = left.groupBy(*keys, "i", "t").cogroup(right.groupBy(*keys, "i", "t"))
    return groups.applyInPandas(_block_matcher(), "grp BIGINT, idx BIGINT, best DOUBLE, best_idx BIGINT")


def _top(found: DataFrame) -> DataFrame:
    top = F.max(F.struct("best", (-F.col("best_idx")).alias("low"))).alias("t")
    best = found.groupBy("grp", "idx").agg(top)
    return best.select("grp", "idx", F.col("t.best").alias("best"), (-F.col("t.low")).alias("best_idx"))


def nearest_texts(images: DataFrame, texts: DataFrame, anchors: int = ANCHORS, block: int = BLOCK) -> DataFrame:
    """(grp, idx, best, best_idx, opened, cells): ``metrics.best_texts``, with the cells opened for the image, of how many.

    ``images`` and ``texts`` are (grp BIGINT, idx BIGINT, vec). Both are placed once and stored with their angles in the
    scratch folder. A group without texts gives no row. Vectors of length zero match nothing in particular.
    """
    chosen = pick_anchors(texts, anchors)
    cells = _stored(place(texts, chosen, block), "cells")
    radius = F.max(F.get("angles", F.col("a") - 1)).alias("radius")
    told = cells.groupBy("grp", "a").agg(radius).groupBy("grp").agg(F.collect_list(F.struct("a", "radius")).alias("all"))
    asked = _stored(place(images, chosen, block), "asked")
    seed = _stored(_top(_matched(asked, cells, block)), "seed")
    known = asked.join(seed, ["grp", "idx"])
    known = skew_join(known, told, ["grp"], ["idx"])
    bound = lambda c: F.cos(F.greatest(F.lit(0.0), F.get("angles", c["a"] - 1) - c["radius"] - SLACK))
    open_cells = F.filter("all", lambda c: (c["a"] != F.col("a")) & (bound(c) >= F.col("best") - 1e-9))
    known = known.select("grp", "idx", "vec", "best", "best_idx", open_cells.alias("more"), F.size("all").alias("cells"))
    further = known.select("grp", "idx", "vec", F.explode("more").alias("c")).select("grp", "idx", "vec", "c.a")
    found = _top(seed.unionByName(_matched(further, cells, block)))
    counts = known.select("grp", "idx", (F.size("more") + 1).alias("opened"), "cells")
    return found.join(counts, ["grp", "idx"])
