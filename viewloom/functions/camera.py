"""Camera expressions: pose parsing, axis conventions, orbit angles.

A pose is ``c2w ARRAY<DOUBLE>``, 16 values, row-major, camera to world.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from viewloom.functions import matrix as M

# Normalised intrinsics (fx, fy, cx, cy) and the guard at the poles.
FXFYCXCY = (1422.222 / 1024, 1422.222 / 1024, 0.5, 0.5)
POLE_GUARD = 1e-8
# Clip planes of the projection.
ZNEAR, ZFAR = 0.01, 100.0

CAMERA_SCHEMA = "x ARRAY<DOUBLE>, y ARRAY<DOUBLE>, z ARRAY<DOUBLE>, origin ARRAY<DOUBLE>"


def camera_parts(camera_json: Column) -> Column:
    """Camera JSON (text or bytes) as a struct of its four columns."""
    return F.from_json(camera_json.cast("string"), CAMERA_SCHEMA)


def pose_of(parts: Column) -> Column:
    """Pose of a parsed camera; NULL unless x, y, z and origin all have three numbers."""
    columns = [parts[name] for name in ("x", "y", "z", "origin")]
    valid = F.lit(True)
    for column in columns:
        valid = valid & (F.size(column) == 3) & ~F.array_contains(F.transform(column, lambda v: v.isNull()), True)
    rows = [F.get(column, F.lit(r)) for r in range(3) for column in columns]
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.when(valid, F.array(*rows, zero, zero, zero, one))


def camera_problem(camera_json: Column, c2w: Column) -> Column:
    """Why a camera file is unusable, given its parsed pose; NULL for a good one."""
    return F.when(camera_json.isNull(), F.lit("no camera file")).when(
        c2w.isNull(), F.lit("x, y, z and origin must be arrays of three numbers")
    )


def to_opengl(c2w: Column) -> Column:
    """Z-up world with OpenCV axes to OpenGL world and camera."""
    m = M.entries(c2w)
    return M.pack(
        [m[0], -m[1], -m[2], m[3]]
        + [m[8], -m[9], -m[10], m[11]]
        + [-m[4], m[5], m[6], -m[7]]
        + m[12:16]
    )


def flip_entries(m: list[Column]) -> list[Column]:
    out = list(m)
    for r in range(3):
        out[4 * r + 1] = -m[4 * r + 1]
        out[4 * r + 2] = -m[4 * r + 2]
    return out


def flip_yz(c2w: Column) -> Column:
    """OpenGL to OpenCV camera axes (and back)."""
    return M.pack(flip_entries(M.entries(c2w)))


def position(c2w: Column) -> list[Column]:
    return [F.get(c2w, F.lit(i)) for i in (3, 7, 11)]


def position_opengl(c2w: Column) -> list[Column]:
    """Position of ``to_opengl`` without the rest of the pose."""
    x, y, z = position(c2w)
    return [x, z, -y]


def orbit_of(pos: list[Column]) -> tuple[Column, Column, Column]:
    """Elevation, azimuth and distance of a position around the origin.

    Degrees: elevation +90 looks from -y (NULL at distance zero); azimuth in
    (-180, 180], +z is 0 and +x is 90.
    """
    x, y, z = pos
    distance = M.norm(pos)
    ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(y, distance)))
    elevation = F.when(distance > 0, -F.degrees(F.asin(ratio)))
    return elevation, F.degrees(F.atan2(x, z)), distance


def distance(c2w: Column) -> Column:
    return M.norm(position(c2w))


def guard_pole(ele: Column) -> Column:
    shrunk = F.abs(ele) - F.lit(POLE_GUARD)
    return F.when(ele >= 0, shrunk).otherwise(-shrunk)


def cam_pose(ele: Column, azi: Column, dis: Column) -> Column:
    return F.struct(F.radians(ele).alias("ele"), F.radians(azi).alias("azi"), dis.alias("dis"))


def orbit_entries(
    ele: Column,
    azi: Column,
    radius: Column,
    target: tuple[float, float, float] = (0.0, 0.0, 0.0),
    opengl: bool = True,
    degrees: bool = True,
) -> list[Column]:
    """Pose that looks at ``target`` from an orbit position.

    The look-at frame of a point on a sphere has a closed form: with
    f = (cos e sin a, -sin e, cos e cos a), right is (cos a, 0, -sin a) and
    up is (sin e sin a, cos e, sin e cos a), for elevations inside (-90, 90).
    """
    e, a = (F.radians(ele), F.radians(azi)) if degrees else (ele, azi)
    se, ce, sa, ca = F.sin(e), F.cos(e), F.sin(a), F.cos(a)
    forward = [ce * sa, -se, ce * ca]
    right = [ca, F.lit(0.0), -sa]
    up = [se * sa, ce, se * ca]
    pos = [radius * f + F.lit(float(t)) for f, t in zip(forward, target)]
    third = forward if opengl else [-f for f in forward]
    rot = [axis[r] for r in range(3) for axis in (right, up, third)]
    return M.rigid(rot, pos)


def orbit_camera(ele: Column, azi: Column, radius: Column, **kwargs) -> Column:
    return M.pack(orbit_entries(ele, azi, radius, **kwargs))
