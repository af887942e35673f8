"""Camera parsing, axis changes, orbit poses, normalisation, rays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.catalog import standins as S
from viewloom.catalog.base import query, r6, s6, table
from viewloom.functions import camera as C
from viewloom.operators import cameras, pixels

_CELLS = [f"m{r}{c}" for r in range(3) for c in range(4)]


def _cells(pose: Column) -> list[Column]:
    """The 12 numbers of a pose as rounded columns."""
    return [r6(F.get(pose, F.lit(4 * r + c))).alias(f"m{r}{c}") for r in range(3) for c in range(4)]


def _sql_cells(*expressions: str) -> str:
    return ", ".join(f"{s6(e)} AS {n}" for e, n in zip(expressions, _CELLS))


_OPENGL = ["rx", "ux", "fx", "px", "ry", "uy", "fy", "py", "rz", "uz", "fz", "pz"]


@query(f"WITH {S.POSES_SQL} SELECT uid, view_id, {_sql_cells(*_OPENGL)} FROM poses")
def orbit_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.poses(spark, sf_dir).select("uid", "view_id", *_cells(F.col("c2w")))


@query(
    f"""WITH {S.CAMERAS_SQL},
p AS (SELECT *, dis*cos(radians(ele))*sin(radians(azi)) + 1.0 AS px, -dis*sin(radians(ele)) - 2.0 AS py,
             dis*cos(radians(ele))*cos(radians(azi)) + 0.5 AS pz FROM cameras),
f AS (SELECT *, sqrt((1.0-px)**2 + (-2.0-py)**2 + (0.5-pz)**2) AS n FROM p),
g AS (SELECT *, (1.0-px)/n AS fx, (-2.0-py)/n AS fy, (0.5-pz)/n AS fz FROM f),
r AS (SELECT *, -fz/sqrt(fz*fz+fx*fx) AS rx, 0.0 AS ry, fx/sqrt(fz*fz+fx*fx) AS rz FROM g),
u AS (SELECT *, ry*fz - rz*fy AS ux, rz*fx - rx*fz AS uy, rx*fy - ry*fx AS uz FROM r)
SELECT uid, view_id, {_sql_cells(*_OPENGL)} FROM u"""
)
def orbit_camera_opencv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other convention, around a target off the origin."""
    pose = C.orbit_camera(F.col("ele"), F.col("azi"), F.col("dis"), target=(1.0, -2.0, 0.5), opengl=False)
    return S.angles(spark, sf_dir).select("uid", "view_id", *_cells(pose))


@query(
    f"""WITH {S.POSES_SQL}
SELECT uid, view_id, {_sql_cells("rx", "-ux", "-fx", "px", "ry", "-uy", "-fy", "py", "rz", "-uz", "-fz", "pz")} FROM poses"""
)
def flip_yz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.poses(spark, sf_dir).select("uid", "view_id", *_cells(C.flip_yz(F.col("c2w"))))


@query(
    f"""WITH {S.POSES_SQL}
SELECT uid, view_id, {_sql_cells("rx", "-ux", "-fx", "px", "rz", "-uz", "-fz", "pz", "-ry", "uy", "fy", "-py")} FROM poses"""
)
def to_opengl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.poses(spark, sf_dir).select("uid", "view_id", *_cells(C.to_opengl(F.col("c2w"))))


# Columns of the matrix are the axes x, y, z and the origin.
_PARSED = {
    "m00": "ele", "m10": "azi", "m20": "0.0", "m01": "0.0", "m11": "1.0", "m21": "dis",
    "m02": "0.0", "m12": "0.0", "m22": "1.0", "m03": "-dis", "m13": "1.0", "m23": "2.0",
}


@query(
    f"""WITH {S.CAMERAS_SQL}
SELECT uid, view_id, CASE WHEN view_id = 6 THEN 'x, y, z and origin must be arrays of three numbers' END AS camera_problem,
       {", ".join(f"CASE WHEN view_id <> 6 THEN {s6(v)} END AS {c}" for c, v in _PARSED.items())}
FROM cameras"""
)
def parse_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera files as JSON; those of the last view hold scalars and are rejected."""
    ele, azi, dis = (F.col(c).cast("string") for c in ("ele", "azi", "dis"))
    good = F.concat(
        F.lit('{"x": ['), ele, F.lit(", "), azi, F.lit(', 0], "y": [0, 1, '), dis,
        F.lit('], "z": [0, 0, 1], "origin": [-'), dis, F.lit(", 1, 2]}"),
    )
    bad = F.concat(F.lit('{"x": '), ele, F.lit(', "y": 1, "z": 2, "origin": [0, 0, 0]}'))
    files = S.angles(spark, sf_dir).withColumn("camera_json", F.when(F.col("view_id") == 6, bad).otherwise(good))
    parsed = cameras.parse_cameras(files)

    cells = [r6(F.get("c2w", F.lit(4 * int(c[1]) + int(c[2])))).alias(c) for c in _PARSED]
    return parsed.select("uid", "view_id", "camera_problem", *cells)


@query(
    f"""WITH {S.CAMERAS_SQL}
SELECT uid, view_id, {s6("ele")} AS ele, {s6("CASE WHEN azi > 180 THEN azi - 360 ELSE azi END")} AS azi, {s6("dis")} AS dis
FROM cameras"""
)
def undo_orbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pose back to angles: the round trip returns the angles it was made from."""
    turned = cameras.undo_orbit(S.poses(spark, sf_dir))
    # half a turn may come back with either sign
    azi = F.when(F.col("azi") <= -180.0 + 1e-9, F.col("azi") + 360.0).otherwise(F.col("azi"))
    return turned.select("uid", "view_id", r6("ele").alias("ele"), r6(azi).alias("azi"), r6("dis").alias("dis"))


@query(
    f"""WITH {S.CAMERAS_SQL}
SELECT uid, view_id, {s6("(CASE WHEN ele >= 0 THEN 1 ELSE -1 END) * (abs(ele) - 1e-8) * 1e4")} AS guarded,
       {s6("radians(ele)")} AS ele, {s6("radians(azi)")} AS azi, {s6("dis")} AS dis
FROM cameras"""
)
def cam_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    posed = S.angles(spark, sf_dir).select(
        "uid",
        "view_id",
        r6(C.guard_pole(F.col("ele")) * 1e4).alias("guarded"),
        C.cam_pose(F.col("ele"), F.col("azi"), F.col("dis")).alias("p"),
    )
    return posed.select("uid", "view_id", "guarded", *[r6(F.col(f"p.{c}")).alias(c) for c in ("ele", "azi", "dis")])


def _slots(df: DataFrame) -> DataFrame:
    return df.withColumn("slot", F.col("view_id"))


@query(
    f"""WITH {S.CAMERAS_SQL},
f AS (SELECT uid, view_id, azi - first_value(azi) OVER (PARTITION BY uid ORDER BY view_id) AS d FROM cameras)
SELECT uid, view_id, {s6("d - 360 * floor(d / 360)")} AS azi FROM f"""
)
def relative_azimuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = cameras.relative_azimuth(_slots(S.angles(spark, sf_dir)))
    return turned.select("uid", "view_id", r6("azi").alias("azi"))


@query(
    f"""WITH {S.POSES_SQL},
s AS (SELECT *, 1.4 / first_value(dis) OVER (PARTITION BY uid ORDER BY view_id) AS k FROM poses)
SELECT uid, view_id, {s6("k")} AS scale, {s6("px * k")} AS m03, {s6("py * k")} AS m13, {s6("pz * k")} AS m23, {s6("dis * k")} AS dis
FROM s"""
)
def normalize_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = cameras.normalize_radius(_slots(S.poses(spark, sf_dir)))
    cells = [r6(F.get("c2w", F.lit(4 * r + 3))).alias(f"m{r}3") for r in range(3)]
    return scaled.select("uid", "view_id", r6("scale").alias("scale"), *cells, r6("dis").alias("dis"))


def _sql_normalized() -> str:
    axes = ("r", "u", "f")
    cells = []
    for i, ref in enumerate(axes):
        for col in axes:
            cells.append(f"q.{ref}x*p.{col}x + q.{ref}y*p.{col}y + q.{ref}z*p.{col}z")
        offset = f"(q.{ref}x*(p.px-q.px) + q.{ref}y*(p.py-q.py) + q.{ref}z*(p.pz-q.pz)) * 1.4 / q.dis"
        cells.append(offset + (" + 1.4" if i == 2 else ""))
    return _sql_cells(*cells)


@query(
    f"""WITH {S.POSES_SQL},
q AS (SELECT * FROM poses WHERE view_id = 0)
SELECT p.uid, p.view_id, {_sql_normalized()} FROM poses p JOIN q ON p.uid = q.uid"""
)
def normalize_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of the objects that have view 0, in the frame of that view."""
    moved = cameras.normalize_poses(_slots(S.poses(spark, sf_dir)), 0, 1.4)
    return moved.where(F.get("c2w", F.lit(0)).isNotNull()).select("uid", "view_id", *_cells(F.col("c2w")))


_TRAIN_SQL = f"""{S.POSES_SQL},
g AS (
  SELECT uid, view_id, px AS gx, pz AS gy, -py AS gz FROM poses),
a AS (
  SELECT *, sqrt(gx*gx + gy*gy + gz*gz) AS d, degrees(atan2(gx, gz)) AS az FROM g),
e AS (SELECT *, -degrees(asin(gy / d)) AS el FROM a),
w AS (
  SELECT *, (CASE WHEN el >= 0 THEN 1 ELSE -1 END) * (abs(el) - 1e-8) AS ele,
         az - first_value(az) OVER (PARTITION BY uid ORDER BY view_id) AS da,
         1.4 / first_value(d) OVER (PARTITION BY uid ORDER BY view_id) AS k FROM e),
t AS (SELECT uid, view_id, k, d * k AS dis, radians(ele) AS er, radians(da) AS ar FROM w)"""


@query(
    f"""WITH {_TRAIN_SQL}
SELECT uid, view_id, {s6("k")} AS scale, {s6("dis")} AS dis, {s6("er")} AS ele,
  {_sql_cells("cos(ar)", "-sin(er)*sin(ar)", "-cos(er)*sin(ar)", "dis*cos(er)*sin(ar)",
              "0.0", "-cos(er)", "sin(er)", "-dis*sin(er)",
              "-sin(ar)", "-sin(er)*cos(ar)", "-cos(er)*cos(ar)", "dis*cos(er)*cos(ar)")}
FROM t"""
)
def training_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored poses to training cameras in one pass."""
    made = cameras.training_cameras(_slots(S.poses(spark, sf_dir)), keep=("uid", "view_id", "slot"))
    return made.select(
        "uid", "view_id", r6("scale").alias("scale"), r6("dis").alias("dis"), r6("cam_pose.ele").alias("ele"), *_cells(F.col("c2w"))
    )


@query(
    f"""WITH g AS (SELECT p_partkey AS uid, e.i * 8 + a.j AS view_id, [-5, 5, 15, 25, 35][e.i + 1] AS elev, a.j * 45 AS azim
  FROM part, (SELECT unnest(range(5)) AS i) e, (SELECT unnest(range(8)) AS j) a)
SELECT uid, view_id::INTEGER AS view_id, elev::DOUBLE AS elev, azim::DOUBLE AS azim, {s6("2.2*cos(radians(elev))*cos(radians(azim))")} AS x,
       {s6("2.2*cos(radians(elev))*sin(radians(azim))")} AS y, {s6("2.2*sin(radians(elev))")} AS z FROM g"""
)
def render_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 camera positions every part has to be rendered from."""
    objects = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"))
    grid = cameras.grid_cameras(objects, cameras.GRID_ELEVATIONS, cameras.GRID_AZIMUTHS, cameras.GRID_DISTANCE)
    return grid.select("uid", "view_id", "elev", "azim", *[r6(c).alias(c) for c in "xyz"])


def _rays_sql(bug: bool) -> str:
    u = "x / 3.0 + 0.5 - 0.5" if bug else "(x + 0.5) / 4.0 - 0.5"
    v = "y / 2.0 + 0.5 - 0.5" if bug else "(y + 0.5) / 3.0 - 0.5"
    return f"""WITH {S.PLANES_SQL}, {S.PLANE_CAMERAS_SQL},
grid AS (SELECT c.*, y.y::INTEGER AS y, x.x::INTEGER AS x FROM cam c, (SELECT unnest(range(3)) AS y) y, (SELECT unnest(range(4)) AS x) x),
uv AS (SELECT *, ({u}) / (1422.222 / 1024) AS u, ({v}) / (1422.222 / 1024) AS v FROM grid),
d AS (SELECT *, m00*u + m01*v + m02 AS ax, m10*u + m11*v + m12 AS ay, m20*u + m21*v + m22 AS az FROM uv),
n AS (SELECT *, ax / sqrt(ax*ax + ay*ay + az*az) AS dx, ay / sqrt(ax*ax + ay*ay + az*az) AS dy, az / sqrt(ax*ax + ay*ay + az*az) AS dz FROM d)
SELECT uid, view_id, y, x, {s6("m03")} AS ox, {s6("m13")} AS oy, {s6("m23")} AS oz, {s6("dx")} AS dx, {s6("dy")} AS dy, {s6("dz")} AS dz,
  {s6("m13*dz - m23*dy")} AS mx, {s6("m23*dx - m03*dz")} AS my, {s6("m03*dy - m13*dx")} AS mz FROM n"""


def _rays(spark: SparkSession, sf_dir: str, bug: bool) -> DataFrame:
    made = pixels.rays(S.plane_cameras(spark, sf_dir), 3, 4, bug=bug)
    return made.select("uid", "view_id", "y", "x", *[r6(c).alias(c) for c in ("ox", "oy", "oz", "dx", "dy", "dz", "mx", "my", "mz")])


@query(_rays_sql(True))
def rays_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rays(spark, sf_dir, True)


@query(_rays_sql(False))
def rays_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rays(spark, sf_dir, False)
