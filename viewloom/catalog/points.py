"""Gaussian points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.catalog import standins as S
from viewloom.catalog.base import query, r6, s6
from viewloom.functions import camera as C
from viewloom.operators import points

_ATTRS = [c for c in points.STORED_COLUMNS if c not in ("red", "green", "blue")]


@query(
    f"""WITH {S.POINTS_SQL},
b AS (SELECT uid, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM points GROUP BY uid)
SELECT uid, gid, {s6("(x - (lx + hx) / 2) * 0.8 / greatest(hx - lx, hy - ly, hz - lz)")} AS x,
  {s6("(y - (ly + hy) / 2) * 0.8 / greatest(hx - lx, hy - ly, hz - lz)")} AS y,
  {s6("(z - (lz + hz) / 2) * 0.8 / greatest(hx - lx, hy - ly, hz - lz)")} AS z FROM points JOIN b USING (uid)"""
)
def normalize_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = points.normalize_points(S.points(spark, sf_dir))
    return moved.select("uid", "gid", *[r6(c).alias(c) for c in "xyz"])


@query(f"WITH {S.GAUSSIANS_SQL} SELECT uid, gid, {s6('opacity')} AS opacity FROM gaussians WHERE opacity > 0.5")
def prune_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.prune(S.gaussians(spark, sf_dir), 0.5).select("uid", "gid", r6("opacity").alias("opacity"))


@query(f"WITH {S.GAUSSIANS_SQL} SELECT uid, gid, CASE WHEN opacity > 0.5 THEN {s6('opacity')} ELSE 0.0 END AS opacity FROM gaussians")
def prune_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.prune(S.gaussians(spark, sf_dir), 0.5, "zero").select("uid", "gid", r6("opacity").alias("opacity"))


_STORED = {
    "opacity": "ln(opacity / (1 - opacity))",
    **{f"scale_{i}": f"ln(scale_{i} + 1e-8)" for i in range(3)},
    **{f"f_dc_{i}": f"(f_dc_{i} - 0.5) / 0.28209479177387814" for i in range(3)},
}


@query(
    f"""WITH {S.GAUSSIANS_SQL}
SELECT uid, gid, {", ".join(f"{s6(_STORED.get(c, c))} AS {c}" for c in _ATTRS)},
  {", ".join(f"trunc(least(greatest(f_dc_{i} * 255.0, 0.0), 255.0))::INTEGER AS {n}" for i, n in enumerate(("red", "green", "blue")))}
FROM gaussians"""
)
def to_ply_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = points.to_ply_cols(S.gaussians(spark, sf_dir))
    return stored.select("uid", "gid", *[r6(c).alias(c) for c in _ATTRS], "red", "green", "blue")


@query(f"WITH {S.GAUSSIANS_SQL} SELECT uid, gid, {', '.join(f'{s6(c)} AS {c}' for c in _ATTRS)} FROM gaussians")
def from_ply_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored and back: every attribute returns (scales up to the guard of the logarithm)."""
    back = points.from_ply_cols(points.to_ply_cols(S.gaussians(spark, sf_dir)))
    exact = back.withColumns({f"scale_{i}": F.col(f"scale_{i}") - 1e-8 for i in range(3)})
    return exact.select("uid", "gid", *[r6(c).alias(c) for c in _ATTRS])


@query(f"WITH {S.GAUSSIANS_SQL} SELECT uid, gid, {', '.join(f'{s6(f'0.0005 * scale_{i} + 0.02 * (1 - scale_{i})')} AS scale_{i}' for i in range(3))} FROM gaussians")
def activate_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = points.activate_scales(S.gaussians(spark, sf_dir), 0.0005, 0.02)
    return active.select("uid", "gid", *[r6(f"scale_{i}").alias(f"scale_{i}") for i in range(3)])


@query(f"WITH {S.GAUSSIANS_SQL} SELECT uid, gid, {', '.join(f'{s6(f'{c} * 0.5 + 0.5')} AS {c}' for c in ('f_dc_0', 'f_dc_1', 'f_dc_2', 'opacity'))} FROM gaussians")
def valid_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = points.valid_range(S.gaussians(spark, sf_dir))
    return shown.select("uid", "gid", *[r6(c).alias(c) for c in ("f_dc_0", "f_dc_1", "f_dc_2", "opacity")])


_FX = "2 * (1422.222 / 1024)"


@query(
    f"""WITH {S.POINTS_SQL},
c AS (SELECT vec_id AS uid, v.v AS view_id, radians((vec_id % 50 - 25)::DOUBLE) AS e, radians((v.v * 90 + vec_id % 90)::DOUBLE) AS a, 2.0 AS r
      FROM embeddings, (SELECT unnest(range(2)) AS v) v),
m AS (SELECT uid, view_id, cos(a) AS rx, 0.0 AS ry, -sin(a) AS rz, -sin(e)*sin(a) AS ux, -cos(e) AS uy, -sin(e)*cos(a) AS uz,
  -cos(e)*sin(a) AS fx, sin(e) AS fy, -cos(e)*cos(a) AS fz, r*cos(e)*sin(a) AS tx, -r*sin(e) AS ty, r*cos(e)*cos(a) AS tz FROM c),
p AS (SELECT uid, gid, view_id, rx*(x-tx) + ry*(y-ty) + rz*(z-tz) AS cx, ux*(x-tx) + uy*(y-ty) + uz*(z-tz) AS cy,
             fx*(x-tx) + fy*(y-ty) + fz*(z-tz) AS cz FROM points JOIN m USING (uid))
SELECT uid, gid, view_id::INTEGER AS view_id, {s6(f"cx * {_FX}")} AS clip_x, {s6(f"cy * {_FX}")} AS clip_y, {s6("cz * 100.0 / 99.99 - 1.0 / 99.99")} AS clip_z,
  {s6("cz")} AS clip_w, {s6(f"cx * {_FX} / cz")} AS ndc_x, {s6(f"cy * {_FX} / cz")} AS ndc_y, {s6("(cz * 100.0 / 99.99 - 1.0 / 99.99) / cz")} AS ndc_z
FROM p"""
)
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point in two orbit views of its object."""
    ids = S.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("uid"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("view_id")
    )
    ele = (F.col("uid") % 50 - 25).cast("double")
    azi = (F.col("view_id") * 90 + F.col("uid") % 90).cast("double")
    cams = ids.select("uid", "view_id", C.flip_yz(C.orbit_camera(ele, azi, F.lit(2.0))).alias("c2w"))
    seen = points.project_points(S.points(spark, sf_dir), cams)
    names = [f"clip_{a}" for a in "xyzw"] + [f"ndc_{a}" for a in "xyz"]
    return seen.select("uid", "gid", "view_id", *[r6(c).alias(c) for c in names])
