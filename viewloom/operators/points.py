"""Gaussian point tables: one row per point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.functions import camera as C
from viewloom.functions import gaussians as G
from viewloom.functions import matrix as M
from viewloom.operators.skew import skew_join

XYZ = ("x", "y", "z")
# Fixed value: longest side of a normalised object.
PADDING = 0.8
# Column order of the export table.
STORED_COLUMNS = (
    "x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity",
    "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3",
    "red", "green", "blue",
)


def normalize_points(points: DataFrame, padding: float = PADDING, spread_by: Sequence[str] = ("gid",)) -> DataFrame:
    """Each object's bounding box centred at the origin, its longest side ``padding``.

    The box is a partial aggregation; it returns to the points through a join
    that spreads an object with very many points.  A single point (no extent)
    gives NULL coordinates.
    """
    box = points.groupBy("uid").agg(
        *[F.min(a).alias(f"_lo_{a}") for a in XYZ], *[F.max(a).alias(f"_hi_{a}") for a in XYZ]
    )
    side = F.greatest(*[F.col(f"_hi_{a}") - F.col(f"_lo_{a}") for a in XYZ])
    frame = box.select(
        "uid",
        *[((F.col(f"_lo_{a}") + F.col(f"_hi_{a}")) / 2).alias(f"_c_{a}") for a in XYZ],
        F.try_divide(F.lit(float(padding)), side).alias("_s"),
    )
    joined = skew_join(points, frame, ["uid"], spread_by)
    return joined.withColumns({a: (F.col(a) - F.col(f"_c_{a}")) * F.col("_s") for a in XYZ}).drop(
        "_s", *[f"_c_{a}" for a in XYZ]
    )


def prune(gaussians: DataFrame, threshold: float, mode: str = "drop") -> DataFrame:
    """Strictly above ``threshold`` stays; others are dropped (export) or zeroed (render)."""
    keep = F.col("opacity") > threshold
    if mode == "drop":
        return gaussians.where(keep)
    if mode == "zero":
        return gaussians.withColumn("opacity", F.when(keep, F.col("opacity")).otherwise(F.lit(0.0)))
    raise ValueError("mode is 'drop' or 'zero'")


def to_ply_cols(gaussians: DataFrame, compatible: bool = True) -> DataFrame:
    """Model values to the stored columns; byte colours come from the unchanged colour."""
    out = {n: G.byte_colour(F.col(f"f_dc_{i}")) for i, n in enumerate(("red", "green", "blue"))}
    if compatible:
        out |= {f"f_dc_{i}": G.stored_colour(F.col(f"f_dc_{i}")) for i in range(3)}
        out |= {f"scale_{i}": G.stored_scale(F.col(f"scale_{i}")) for i in range(3)}
        out["opacity"] = G.logit(F.col("opacity"))
    return gaussians.withColumns(out)


def from_ply_cols(stored: DataFrame, compatible: bool = True) -> DataFrame:
    """Stored columns back to model values."""
    if not compatible:
        return stored
    out = {f"f_dc_{i}": G.shown_colour(F.col(f"f_dc_{i}")) for i in range(3)}
    out |= {f"scale_{i}": F.exp(f"scale_{i}") for i in range(3)}
    out["opacity"] = G.sigmoid(F.col("opacity"))
    return stored.withColumns(out)


def valid_range(gaussians: DataFrame) -> DataFrame:
    """Colour and opacity from the model's [-1, 1] to [0, 1]."""
    names = ("f_dc_0", "f_dc_1", "f_dc_2", "opacity")
    return gaussians.withColumns({c: F.col(c) * 0.5 + 0.5 for c in names})


def activate_scales(gaussians: DataFrame, smin: float, smax: float) -> DataFrame:
    return gaussians.withColumns({f"scale_{i}": G.activate_scale(F.col(f"scale_{i}"), smin, smax) for i in range(3)})


def project_points(
    points: DataFrame,
    cameras: DataFrame,
    intrinsics: tuple[float, ...] = C.FXFYCXCY,
    near: float = C.ZNEAR,
    far: float = C.ZFAR,
    spread_by: Sequence[str] = ("gid",),
) -> DataFrame:
    """Points of an object in each of its views: clip coordinates and x/w, y/w, z/w.

    An object has few cameras and may have very many points, so the points are
    spread and the cameras follow.
    """
    fx, fy, cx, cy = (float(v) for v in intrinsics)
    m = M.entries(F.col("c2w"))
    views = cameras.select("uid", "view_id", "c2w", M.pack(M.inverse(M.rotation(m))).alias("_inverse"))
    joined = skew_join(points, views, ["uid"], spread_by)
    offset = [F.col(a) - t for a, t in zip(XYZ, M.translation(m))]
    cam = M.times_vector(M.entries(F.col("_inverse"), 9), offset)
    seen = joined.withColumns(dict(zip(("_x", "_y", "_z"), cam)))
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    clip = seen.withColumns(
        {
            "clip_x": x * F.lit(2 * fx) + z * F.lit(2 * cx - 1),
            "clip_y": y * F.lit(2 * fy) + z * F.lit(2 * cy - 1),
            "clip_z": z * F.lit(far / (far - near)) - F.lit(far * near / (far - near)),
            "clip_w": z,
        }
    ).drop("_x", "_y", "_z", "c2w", "_inverse")
    return clip.withColumns({f"ndc_{a}": F.try_divide(F.col(f"clip_{a}"), F.col("clip_w")) for a in XYZ})
