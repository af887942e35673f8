"""Camera tables: (uid, slot, c2w) normalised against the first view of each object.

Windows here run inside one object, whose number of views is fixed by the
data model (40 by default), so no window can outgrow a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewloom.functions import camera as C
from viewloom.functions import matrix as M

# Fixed value: the distance the first camera is scaled to.
NORM_RADIUS = 1.4


def parse_cameras(views: DataFrame, json_col: str = "camera_json") -> DataFrame:
    """Adds ``c2w`` and, for unusable files, ``camera_problem``."""
    parsed = views.withColumn("_parts", C.camera_parts(F.col(json_col)))
    posed = parsed.withColumn("c2w", C.pose_of(F.col("_parts"))).drop("_parts")
    return posed.withColumn("camera_problem", C.camera_problem(F.col(json_col), F.col("c2w")))


def undo_orbit(cameras: DataFrame) -> DataFrame:
    return cameras.withColumns(dict(zip(("ele", "azi", "dis"), C.orbit_of(C.position(F.col("c2w"))))))


def _first(column: Column | str, order: str) -> Column:
    return F.first_value(column).over(W.partitionBy("uid").orderBy(order))


def relative_azimuth(cameras: DataFrame, order: str = "slot") -> DataFrame:
    """``azi`` relative to the first view, in [0, 360)."""
    turned = F.pmod(F.col("azi") - _first("azi", order), F.lit(360.0))
    # a tiny negative difference must not round up to 360
    return cameras.withColumn("azi", F.when(turned >= 360.0, F.lit(0.0)).otherwise(turned))


def normalize_radius(cameras: DataFrame, radius: float = NORM_RADIUS, order: str = "slot") -> DataFrame:
    """Scales translations and ``dis`` so that the first view sits at ``radius``."""
    scaled = cameras.withColumn("scale", F.try_divide(F.lit(float(radius)), C.distance(_first("c2w", order))))
    m = M.entries(F.col("c2w"))
    moved = [x * F.col("scale") if i in (3, 7, 11) else x for i, x in enumerate(m)]
    out = scaled.withColumn("c2w", M.pack(moved))
    if "dis" in cameras.columns:
        out = out.withColumn("dis", F.col("dis") * F.col("scale"))
    return out


def normalize_poses(cameras: DataFrame, reference: int = 0, radius: float = 0.0, order: str = "slot") -> DataFrame:
    """Moves all poses so that view ``reference`` becomes canonical (at ``radius`` on +z)."""
    w = W.partitionBy("uid")
    with_ref = cameras.withColumn("_ref", F.max(F.when(F.col(order) == reference, F.col("c2w"))).over(w))
    m, ref = M.entries(F.col("c2w")), M.entries(F.col("_ref"))
    ref_pos = M.translation(ref)
    scale = F.try_divide(F.lit(float(radius)), M.norm(ref_pos)) if abs(radius) > 0 else F.lit(1.0)
    with_ref = with_ref.withColumn("_inverse", M.pack(M.inverse(M.rotation(ref))))
    inverse = M.entries(F.col("_inverse"), 9)
    offset = [(p - r) * scale for p, r in zip(M.translation(m), ref_pos)]
    pos = M.times_vector(inverse, offset)
    pos = [pos[0], pos[1], pos[2] + F.lit(float(radius))]
    return with_ref.withColumn("c2w", M.pack(M.rigid(M.times(inverse, M.rotation(m)), pos))).drop("_ref", "_inverse")


def training_cameras(
    cameras: DataFrame,
    radius: float | None = NORM_RADIUS,
    order: str = "slot",
    keep: Sequence[str] = ("uid", "slot"),
    first: str | None = None,
) -> DataFrame:
    """Stored poses to the cameras a training batch uses.

    Axis change, orbit angles, azimuth relative to the first view, pole guard,
    look-at pose in OpenCV axes, distance scaled by the first view.  ``first``
    names a column with the stored pose of the object's first view; without it
    a window over the object finds the first by ``order``, one shuffle by uid.
    """
    ele, azi, dis = C.orbit_of(C.position_opengl(F.col("c2w")))
    angles = cameras.withColumns({"_ele": C.guard_pole(ele), "_azi": azi, "_dis": dis})
    if first is None:
        start = _first(F.struct(F.col("_azi").alias("azi"), F.col("_dis").alias("dis")), order)
    else:
        _, first_azi, first_dis = C.orbit_of(C.position_opengl(F.col(first)))
        start = F.struct(first_azi.alias("azi"), first_dis.alias("dis"))
    started = angles.withColumn("_first", start)
    turned = F.pmod(F.col("_azi") - F.col("_first.azi"), F.lit(360.0))
    scale = F.lit(1.0) if radius is None else F.try_divide(F.lit(float(radius)), F.col("_first.dis"))
    scaled = started.withColumns(
        {"_turned": F.when(turned >= 360.0, F.lit(0.0)).otherwise(turned), "_scale": scale}
    ).withColumn("_far", F.col("_dis") * F.col("_scale"))
    ele, azi, dis = F.col("_ele"), F.col("_turned"), F.col("_far")
    return scaled.select(
        *keep,
        ele.alias("ele"),
        azi.alias("azi"),
        dis.alias("dis"),
        F.col("_scale").alias("scale"),
        M.pack(C.flip_entries(C.orbit_entries(ele, azi, dis))).alias("c2w"),
        C.cam_pose(ele, azi, dis).alias("cam_pose"),
        C.to_opengl(F.col("c2w")).alias("original_c2w"),
    )


def grid_cameras(objects: DataFrame, elevs: Sequence[float], azims: Sequence[float], d: float) -> DataFrame:
    """The render grid of each object: rings of elevation, then azimuth, numbered in that order.

    Both lists are parameters, so the grid is an array literal and no join is needed.
    """
    cells = [
        F.struct(
            F.lit(i * len(azims) + j).alias("view_id"), F.lit(float(e)).alias("elev"), F.lit(float(a)).alias("azim")
        )
        for i, e in enumerate(elevs)
        for j, a in enumerate(azims)
    ]
    grid = objects.withColumn("_g", F.explode(F.array(*cells))).select(*objects.columns, "_g.*")
    e, a = F.radians("elev"), F.radians("azim")
    return grid.withColumns(
        {
            "x": F.lit(float(d)) * F.cos(e) * F.cos(a),
            "y": F.lit(float(d)) * F.cos(e) * F.sin(a),
            "z": F.lit(float(d)) * F.sin(e),
        }
    )


# The rings the renderer writes.
GRID_ELEVATIONS = (-5, 5, 15, 25, 35)
GRID_AZIMUTHS = (0, 45, 90, 135, 180, 225, 270, 315)
GRID_DISTANCE = 2.2


def elev_bins(df: DataFrame, col: str = "ele", lo: float = -40.0, hi: float = 10.0, n: int = 25) -> DataFrame:
    """Adds elevation class, offset inside the class, and whether the class exists."""
    width = (hi - lo) / n
    cls = F.floor((F.col(col) - F.lit(lo)) / F.lit(width))
    return (
        df.withColumn("elev_class", cls)
        .withColumn("elev_offset", F.col(col) - (F.lit(lo) + F.col("elev_class") * F.lit(width)))
        .withColumn("elev_valid", (F.col("elev_class") >= 0) & (F.col("elev_class") < n))
    )
