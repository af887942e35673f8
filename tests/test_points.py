import math

import numpy as np
import pytest

from viewloom.functions import camera as C
from viewloom.operators import points

from test_cameras import random_pose

COLUMNS = [c for c in points.STORED_COLUMNS if c not in ("red", "green", "blue")]


def gaussians(spark, changes):
    base = dict.fromkeys(COLUMNS, 0.5)
    data = [("u", i, *[float(v) for v in (base | c).values()]) for i, c in enumerate(changes)]
    return spark.createDataFrame(data, "uid STRING, gid BIGINT, " + ", ".join(f"{c} DOUBLE" for c in COLUMNS))


def test_box_normalisation(spark):
    rng = np.random.default_rng(0)
    cloud = rng.normal(size=(200, 3)) * [1, 5, 2] + [10, 0, -3]
    data = [("a", i, *map(float, p)) for i, p in enumerate(cloud)] + [("dot", 0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(data, "uid STRING, gid BIGINT, x DOUBLE, y DOUBLE, z DOUBLE")
    got = {(r.uid, r.gid): (r.x, r.y, r.z) for r in points.normalize_points(df).collect()}
    lo, hi = cloud.min(axis=0), cloud.max(axis=0)
    expected = (cloud - (lo + hi) / 2) * 0.8 / (hi - lo).max()
    np.testing.assert_allclose([got["a", i] for i in range(200)], expected, atol=1e-12)
    assert got["dot", 0] == (None, None, None)


def test_pruning_is_strict(spark, rows):
    df = gaussians(spark, [{"opacity": o} for o in (0.0, 0.3, 0.30001)])
    assert rows(points.prune(df, 0.3), "gid") == [(2,)]
    assert [r[0] for r in rows(points.prune(df, 0.3, "zero"), "opacity")] == [0.0, 0.0, 0.30001]
    with pytest.raises(ValueError):
        points.prune(df, 0.3, "other")


def test_stored_columns(spark):
    df = gaussians(spark, [{"opacity": 0.0}, {"opacity": 1.0}, {"f_dc_0": -0.2, "f_dc_1": 1.7, "f_dc_2": 0.999, "scale_0": 0.0}])
    got = points.to_ply_cols(df).orderBy("gid").collect()
    assert got[0].opacity == -math.inf and got[1].opacity == math.inf
    assert (got[2].red, got[2].green, got[2].blue) == (0, 255, 254)
    assert got[2].scale_0 == pytest.approx(math.log(1e-8))
    assert got[2].f_dc_1 == pytest.approx(1.2 / 0.28209479177387814)
    raw = points.to_ply_cols(df, compatible=False).orderBy("gid").collect()
    assert raw[2].f_dc_1 == 1.7 and raw[2].green == 255


def test_stored_and_back(spark):
    rng = np.random.default_rng(1)
    df = gaussians(spark, [dict(zip(COLUMNS, rng.uniform(0.05, 0.95, size=14))) for _ in range(20)])
    back = points.from_ply_cols(points.to_ply_cols(df)).orderBy("gid").collect()
    for before, after in zip(df.orderBy("gid").collect(), back):
        for c in COLUMNS:
            assert after[c] == pytest.approx(before[c], abs=2e-8)


def test_larger_raw_scale_is_smaller(spark):
    got = [r.scale_0 for r in points.activate_scales(gaussians(spark, [{"scale_0": 0.0}, {"scale_0": 1.0}]), 0.0005, 0.02).collect()]
    assert got == pytest.approx([0.02, 0.0005])


def test_projection(spark):
    rng = np.random.default_rng(4)
    cloud = rng.normal(size=(30, 3))
    poses = [random_pose(rng) for _ in range(2)]
    fx, fy, cx, cy = 1.4, 1.2, 0.45, 0.6
    df = spark.createDataFrame([("u", i, *map(float, p)) for i, p in enumerate(cloud)], "uid STRING, gid BIGINT, x DOUBLE, y DOUBLE, z DOUBLE")
    cams = spark.createDataFrame([("u", v, [float(x) for x in m.reshape(-1)]) for v, m in enumerate(poses)], "uid STRING, view_id INT, c2w ARRAY<DOUBLE>")
    near, far = C.ZNEAR, C.ZFAR
    proj = np.zeros((4, 4))
    proj[0, 0], proj[1, 1] = 2 * fx, 2 * fy
    proj[0, 2], proj[1, 2] = 2 * cx - 1, 2 * cy - 1
    proj[2, 2], proj[2, 3], proj[3, 2] = far / (far - near), -far * near / (far - near), 1
    got = points.project_points(df, cams, (fx, fy, cx, cy)).collect()
    assert len(got) == 60
    for r in got:
        clip = proj @ np.linalg.inv(poses[r.view_id]) @ np.array([*cloud[r.gid], 1.0])
        np.testing.assert_allclose([r.clip_x, r.clip_y, r.clip_z, r.clip_w], clip, atol=1e-9)
        np.testing.assert_allclose([r.ndc_x, r.ndc_y, r.ndc_z], clip[:3] / clip[3], rtol=1e-6, atol=1e-9)
