"""Training views with their pixel targets.

Planes are large, and are stored once for many epochs, so they are stored where their join needs them: in buckets of
(uid, view_id). The views of an epoch, which are small rows of ids and poses, move to the planes; the planes stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.functions import camera as C
from viewloom.functions import matrix as M
from viewloom.functions import pixels as P

KEY = ["uid", "view_id"]


def pack_planes(normals: DataFrame, depth: DataFrame, alpha: DataFrame) -> DataFrame:
    """(uid, view_id, h, w, nx, ny, nz, depth, alpha): one row for each view with all its planes.

    ``normals`` and ``depth`` hold decoded channels, (uid, view_id, channel, data) and (uid, view_id, h, w, data);
    ``alpha`` has (uid, view_id, data).
    """
    channels = [F.max(F.when(F.col("channel") == i, F.col("data"))).alias(n) for i, n in enumerate(("nx", "ny", "nz"))]
    both = depth.select(*KEY, "h", "w", F.col("data").alias("depth")).join(alpha.select(*KEY, F.col("data").alias("alpha")), KEY)
    return normals.groupBy(*KEY).agg(*channels).dropna().join(both, KEY)


def store_planes(planes: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Writes packed planes as the table ``name`` below ``path``, in ``buckets`` files or few more; returns it.

    Choose the buckets so that the planes of one fit a task; they cannot be split later.
    """
    dealt = planes.repartition(buckets, *KEY)
    writer = dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *KEY).sortBy(*KEY)
    writer.saveAsTable(name)
    return planes.sparkSession.table(name)


def turns(views: DataFrame, first: str = "slot") -> DataFrame:
    """(uid, turn): the rotation from the stored axes of an object into those of its first view."""
    new = M.rotation(M.entries(C.flip_yz(F.col("c2w"))))
    old = M.rotation(M.entries(F.col("original_c2w")))
    return views.where(F.col(first) == 0).select("uid", M.pack(M.times(new, M.inverse(old))).alias("turn"))


def _points(pose: str, scale: str | None, intrinsics: Sequence[float]) -> Column:
    """World points of all pixels, in [0, 1] and white outside the object: an array of (x, y, z)."""
    fx, fy, cx, cy = (F.lit(float(v)) for v in intrinsics)
    m = M.entries(F.col(pose))
    factor = F.col(scale) if scale else F.lit(1.0)

    def point(z: Column, i: Column) -> Column:
        x, y = i % F.col("w"), F.floor(i / F.col("w"))
        d = z["d"].cast("double") * factor
        u, v = x / (F.col("w") - 1).cast("double"), y / (F.col("h") - 1).cast("double")
        cam = [d * (u - cx) / fx, d * (v - cy) / fy, d]
        world = [r + t for r, t in zip(M.times_vector(M.rotation(m), cam), M.translation(m))]
        a = z["a"].cast("double")
        return F.struct(*(((p * 0.5 + 0.5) * a + (F.lit(1.0) - a)).alias(n) for p, n in zip(world, "xyz")))

    return F.transform(F.arrays_zip(P.like(F.col("depth"), F.col("alpha")).alias("d"), F.col("alpha").alias("a")), point)


def _normals() -> Column:
    """Normals in the axes of the first view, in [0, 1] and white outside the object: an array of (x, y, z)."""
    zipped = F.arrays_zip(*(P.like(F.col(c), F.col("alpha")).alias(c) for c in ("nx", "ny", "nz")), F.col("alpha").alias("a"))

    def normal(z: Column) -> Column:
        rows = []
        for r, n in enumerate("xyz"):
            v = F.get("turn", F.lit(3 * r)) * z["nx"] + F.get("turn", F.lit(3 * r + 1)) * z["ny"]
            v = v + F.get("turn", F.lit(3 * r + 2)) * z["nz"]
            rows.append(((v * 0.5 + 0.5) * z["a"] + (F.lit(1.0) - z["a"])).alias(n))
        return F.struct(*rows)

    return F.transform(zipped, normal)


def training_targets(
    views: DataFrame,
    planes: DataFrame,
    pose: str = "c2w",
    scale: str | None = "scale",
    intrinsics: Sequence[float] = C.FXFYCXCY,
    keep: Sequence[str] = ("uid", "view_id", "slot"),
) -> DataFrame:
    """``keep`` columns of the views with points, normals and depth of all pixels, row by row of the image.

    ``views`` are training rows (``plans.load.training_rows``: poses before and after, slot 0 first), ``planes`` a
    table of ``store_planes``. Points come from ``pose``, with depth times ``scale``; depth is over its maximum, near
    dark and background white, and NULL in a view without any. A view without planes gives no row.

    One join, to which only the views move; a test holds the plan to that.
    """
    turned = views.join(turns(views), "uid")
    joined = planes.join(turned, KEY)
    masked = F.zip_with(P.like(F.col("depth"), F.col("alpha")), "alpha", lambda d, a: d.cast("double") * a.cast("double"))
    top = joined.withColumn("_d", masked).withColumn("_max", F.array_max("_d"))
    depth = F.when(F.col("_max") != 0, F.transform("_d", lambda d: F.lit(1.0) - d / F.col("_max")))
    return top.select(*keep, "h", "w", _points(pose, scale, intrinsics).alias("points"), _normals().alias("normals"), depth.alias("depth"))
