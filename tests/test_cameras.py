import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.functions import camera as C
from viewloom.operators import cameras


ANGLES = [(0.0, 0.0, 1.0), (30.0, 45.0, 2.0), (-60.0, 200.0, 1.5), (89.0, -90.0, 0.5), (5.0, 359.0, 3.0)]


def orbit_poses(spark, angles, **options):
    df = spark.createDataFrame(angles, "ele DOUBLE, azi DOUBLE, dis DOUBLE")
    made = df.select("*", C.orbit_camera(F.col("ele"), F.col("azi"), F.col("dis"), **options).alias("m"))
    return [(r.ele, r.azi, r.dis, np.array(r.m).reshape(4, 4)) for r in made.collect()]


@pytest.mark.parametrize("opengl", [True, False])
def test_orbit_cameras_face_their_target(spark, opengl):
    target = np.array([0.5, 1.0, -2.0])
    for ele, _, dis, m in orbit_poses(spark, ANGLES, target=tuple(target), opengl=opengl):
        axes, position = m[:3, :3], m[:3, 3]
        np.testing.assert_allclose(axes.T @ axes, np.eye(3), atol=1e-12)
        assert abs(np.linalg.det(axes)) == pytest.approx(1)
        assert m[3].tolist() == [0, 0, 0, 1]
        away = position - target
        assert np.linalg.norm(away) == pytest.approx(dis)
        # the third axis lies on the line to the target, away from it or towards it
        np.testing.assert_allclose(axes[:, 2] * dis * (1 if opengl else -1), away, atol=1e-12)
        assert axes[1, 0] == pytest.approx(0, abs=1e-12)  # the first axis is level
        assert away[1] == pytest.approx(-dis * math.sin(math.radians(ele)))


def test_orbit_turns_with_the_azimuth(spark):
    """Equal steps of the azimuth are equal turns about the vertical; at 0 the camera is on +z, at 90 on +x."""
    found = [m for *_, m in sorted(orbit_poses(spark, [(0.0, 90.0 * k, 2.0) for k in range(4)]), key=lambda r: r[1])]
    quarter = found[1] @ np.linalg.inv(found[0])
    for a, b in zip(found, [*found[1:], found[0]]):
        np.testing.assert_allclose(quarter @ a, b, atol=1e-12)
    np.testing.assert_allclose(found[0][:3, 3], [0, 0, 2], atol=1e-12)
    np.testing.assert_allclose(found[1][:3, 3], [2, 0, 0], atol=1e-12)


def test_orbit_and_back(spark):
    df = spark.createDataFrame(ANGLES, "ele DOUBLE, azi DOUBLE, dis DOUBLE")
    posed = df.select("ele", "azi", "dis", C.orbit_camera(F.col("ele"), F.col("azi"), F.col("dis")).alias("c2w"))
    renamed = posed.toDF("e", "a", "d", "c2w")
    for r in cameras.undo_orbit(renamed).collect():
        assert r.ele == pytest.approx(r.e, abs=1e-9)
        assert (r.azi - r.a) % 360 == pytest.approx(0, abs=1e-9) or (r.azi - r.a) % 360 == pytest.approx(360, abs=1e-9)
        assert r.dis == pytest.approx(r.d, abs=1e-12)


def test_orbit_in_radians(spark):
    e, a = F.lit(0.3), F.lit(1.2)
    got = spark.range(1).select(C.orbit_camera(e, a, F.lit(2.0), degrees=False).alias("m")).first().m
    ((*_, same),) = orbit_poses(spark, [(math.degrees(0.3), math.degrees(1.2), 2.0)])
    np.testing.assert_allclose(np.array(got).reshape(4, 4), same, atol=1e-12)


def random_pose(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    pose = np.eye(4)
    pose[:3, :3] = q * np.sign(np.linalg.det(q))
    pose[:3, 3] = rng.normal(size=3) * 2
    return pose


def poses(spark, n=6, seed=0):
    rng = np.random.default_rng(seed)
    made = [random_pose(rng) for _ in range(n)]
    data = [("u", i, [float(x) for x in m.reshape(-1)]) for i, m in enumerate(made)]
    return made, spark.createDataFrame(data, "uid STRING, slot INT, c2w ARRAY<DOUBLE>")


def opengl_of(c2w):
    c2w = c2w.copy()
    c2w[1] *= -1
    c2w[[1, 2]] = c2w[[2, 1]]
    c2w[:3, 1:3] *= -1
    return c2w


def test_axis_change(spark):
    made, df = poses(spark)
    got = {r.slot: np.array(r.m).reshape(4, 4) for r in df.withColumn("m", C.to_opengl(F.col("c2w"))).collect()}
    for i, m in enumerate(made):
        np.testing.assert_allclose(got[i], opengl_of(m), atol=1e-12)
        # the position becomes (px, pz, -py)
        np.testing.assert_allclose(got[i][:3, 3], [m[0, 3], m[2, 3], -m[1, 3]], atol=1e-12)


def test_flip_twice_is_identity(spark):
    made, df = poses(spark)
    back = df.withColumn("m", C.flip_yz(C.flip_yz(F.col("c2w"))))
    assert all(r.m == pytest.approx(r.c2w) for r in back.collect())


def test_training_cameras_stand_relative_to_the_first(spark):
    """Positions keep their heights and distances, turned so that the first is at azimuth 0 and radius 1.4;
    every camera looks at the origin with a level first axis, in OpenCV axes."""
    made, df = poses(spark)
    got = {r.slot: r for r in cameras.training_cameras(df).collect()}
    stored = [opengl_of(m) for m in made]
    start = stored[0][:3, 3]
    scale, angle = 1.4 / np.linalg.norm(start), math.atan2(start[0], start[2])
    turn = np.array([[math.cos(angle), 0, -math.sin(angle)], [0, 1, 0], [math.sin(angle), 0, math.cos(angle)]])
    for slot, gl in enumerate(stored):
        row, m = got[slot], np.array(got[slot].c2w).reshape(4, 4)
        position = m[:3, 3]
        np.testing.assert_allclose(position, turn @ gl[:3, 3] * scale, atol=1e-6)
        np.testing.assert_allclose(m[:3, :3].T @ m[:3, :3], np.eye(3), atol=1e-9)
        np.testing.assert_allclose(m[:3, 2], -position / np.linalg.norm(position), atol=1e-9)
        assert m[1, 0] == pytest.approx(0, abs=1e-9)
        np.testing.assert_allclose(np.array(row.original_c2w).reshape(4, 4), gl, atol=1e-12)
        pose = row.cam_pose
        assert pose.dis == pytest.approx(np.linalg.norm(position))
        assert -math.sin(pose.ele) * pose.dis == pytest.approx(position[1], abs=1e-6)
        assert math.cos(pose.azi) * math.cos(pose.ele) * pose.dis == pytest.approx(position[2], abs=1e-6)
        assert math.sin(pose.azi) * math.cos(pose.ele) * pose.dis == pytest.approx(position[0], abs=1e-6)
    assert got[0].azi == 0.0
    unscaled = {r.slot: r for r in cameras.training_cameras(df, radius=None).collect()}
    assert unscaled[2].dis == pytest.approx(np.linalg.norm(made[2][:3, 3]))


@pytest.mark.parametrize("radius", [0.0, 1.4])
def test_normalized_poses(spark, radius):
    made, df = poses(spark)
    scale = radius / np.linalg.norm(made[2][:3, 3]) if radius else 1.0
    scaled = [m.copy() for m in made]
    for m in scaled:
        m[:3, 3] *= scale
    canonical = np.eye(4)
    canonical[2, 3] = radius
    turn = canonical @ np.linalg.inv(scaled[2])
    got = cameras.normalize_poses(df, reference=2, radius=radius)
    for r in got.collect():
        np.testing.assert_allclose(np.array(r.c2w).reshape(4, 4), turn @ scaled[r.slot], atol=1e-9)


def test_normalize_radius(spark):
    made, df = poses(spark)
    for r in cameras.normalize_radius(df).collect():
        m = np.array(r.c2w).reshape(4, 4)
        factor = 1.4 / np.linalg.norm(made[0][:3, 3])
        np.testing.assert_allclose(m[:3, 3], made[r.slot][:3, 3] * factor)
        np.testing.assert_allclose(m[:3, :3], made[r.slot][:3, :3])


def test_relative_azimuth_range(spark):
    df = spark.createDataFrame([("u", 0, 10.0), ("u", 1, 5.0), ("u", 2, 10.0 - 1e-14)], "uid STRING, slot INT, azi DOUBLE")
    got = {r.slot: r.azi for r in cameras.relative_azimuth(df).collect()}
    assert got[0] == 0.0 and got[1] == 355.0 and 0 <= got[2] < 360


def test_camera_files(spark):
    good = json.dumps({"x": [1, 0, 0], "y": [0, 1, 0], "z": [0, 0, 1], "origin": [4, 5, 6]})
    scalar = json.dumps({"x": 1, "y": 2, "z": 3, "origin": [0, 0, 0]})
    short = json.dumps({"x": [1, 0], "y": [0, 1, 0], "z": [0, 0, 1], "origin": [4, 5, 6]})
    holes = json.dumps({"x": [1, None, 0], "y": [0, 1, 0], "z": [0, 0, 1], "origin": [4, 5, 6]})
    data = [(i, None if t is None else t.encode()) for i, t in enumerate([good, scalar, short, holes, "junk", None])]
    got = cameras.parse_cameras(spark.createDataFrame(data, "id INT, camera_json BINARY")).orderBy("id").collect()
    assert got[0].c2w == [1, 0, 0, 4, 0, 1, 0, 5, 0, 0, 1, 6, 0, 0, 0, 1] and got[0].camera_problem is None
    assert all(r.c2w is None and r.camera_problem for r in got[1:])
    assert got[5].camera_problem == "no camera file"


def test_columns_of_the_matrix(spark):
    text = json.dumps({"x": [1, 2, 3], "y": [4, 5, 6], "z": [7, 8, 9], "origin": [10, 11, 12]})
    df = spark.createDataFrame([(text,)], "camera_json STRING")
    m = np.array(cameras.parse_cameras(df).first().c2w).reshape(4, 4)
    np.testing.assert_array_equal(m[:3, 0], [1, 2, 3])
    np.testing.assert_array_equal(m[:3, 3], [10, 11, 12])


def test_guard_and_bins(spark):
    df = spark.createDataFrame([(90.0,), (-90.0,), (0.0,), (-40.0,), (9.99,), (10.0,)], "ele DOUBLE")
    guarded = [r[0] for r in df.select(C.guard_pole(F.col("ele"))).collect()]
    assert guarded[0] < 90 and guarded[1] > -90 and guarded[2] == -1e-8
    binned = [(r.elev_class, r.elev_valid) for r in cameras.elev_bins(df).collect()]
    assert binned[3:] == [(0, True), (24, True), (25, False)]
    assert binned[0][1] is False


def test_render_grid(spark):
    grid = cameras.grid_cameras(
        spark.createDataFrame([("o",)], "uid STRING"), cameras.GRID_ELEVATIONS, cameras.GRID_AZIMUTHS, 2.2
    )
    rows = {r.view_id: r for r in grid.collect()}
    assert len(rows) == 40
    assert (rows[10].elev, rows[10].azim) == (5.0, 90.0)
    assert [rows[i].azim for i in (0, 10, 20, 30)] == [0, 90, 180, 270]
    assert rows[0].x == pytest.approx(2.2 * math.cos(math.radians(-5)))


def test_a_skewed_reference_is_inverted(spark):
    """The stored matrix is inverted as it is, not taken for a rotation."""
    skewed = np.array([[2.0, 0.3, 0.0, 1.0], [0.0, 1.5, 0.1, -2.0], [0.2, 0.0, 0.5, 0.5], [0, 0, 0, 1]])
    other = np.eye(4)
    other[:3, 3] = [1, 2, 3]
    rows_ = [("u", 0, skewed.flatten().tolist()), ("u", 1, other.flatten().tolist())]
    df = spark.createDataFrame(rows_, "uid STRING, slot INT, c2w ARRAY<DOUBLE>")
    got = {r.slot: np.array(r.c2w).reshape(4, 4) for r in cameras.normalize_poses(df).collect()}
    np.testing.assert_allclose(got[0], np.eye(4), atol=1e-12)
    np.testing.assert_allclose(got[1], np.linalg.inv(skewed) @ other, atol=1e-12)
