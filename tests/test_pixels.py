import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.functions import camera as C
from viewloom.functions import pixels as P
from viewloom.operators import checks, pixels

from test_cameras import random_pose

PLANES = "uid STRING, view_id INT, channel INT, h INT, w INT, data ARRAY<DOUBLE>"


def planes(spark, stacks):
    """{(uid, view): (C, h, w) array} as a plane table."""
    data = []
    for (uid, view), stack in stacks.items():
        for c, plane in enumerate(stack):
            data.append((uid, view, c, *plane.shape, [float(x) for x in plane.reshape(-1)]))
    return spark.createDataFrame(data, PLANES)


def test_composite_over_colour(spark):
    df = spark.createDataFrame([([0.2, 0.4, 1.0], [0.0, 0.5, 1.0])], "data ARRAY<DOUBLE>, alpha ARRAY<DOUBLE>")
    white = pixels.composite_planes(df).first().data
    assert white == pytest.approx([1.0, 0.7, 1.0])
    assert pixels.composite_planes(df, background=0.0).first().data == pytest.approx([0.0, 0.2, 1.0])


def test_decoding(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("u", 0, c, 1, 3, [0.0, 0.75, nan]) for c in range(4)], PLANES
    )
    got = {r.channel: r.data for r in pixels.decode_nd(df).collect()}
    assert got[0] == [1.0, -0.5, 1.0]
    assert got[1] == [-1.0, 0.5, -1.0] and got[2] == got[1]
    assert got[3] == [0.0, 3.75, 0.0]
    bytes_ = spark.createDataFrame([([0, 51, 255],)], "v ARRAY<INT>").select(P.decode_bytes(F.col("v"))).first()[0]
    assert bytes_ == pytest.approx([0.0, 0.2, 1.0])
    words = spark.createDataFrame([([0, 65535],)], "v ARRAY<INT>").select(P.decode_bytes(F.col("v"), 16)).first()[0]
    assert words == [0.0, 1.0]


def test_missing_planes_become_white(spark):
    df = spark.createDataFrame([("u", 0, 0, 2, 3, None), ("u", 1, 0, 1, 2, [0.5, 0.5])], PLANES)
    got = {r.view_id: r.data for r in pixels.fill_missing_plane(df).collect()}
    assert got == {0: [1.0] * 6, 1: [0.5, 0.5]}


@pytest.mark.parametrize("c,h,w,p", [(3, 4, 8, 2), (1, 6, 6, 3), (2, 4, 4, 4)])
def test_tiles_and_back(spark, c, h, w, p):
    stack = np.arange(c * h * w, dtype=float).reshape(c, h, w)
    df = planes(spark, {("u", 0): stack})
    tiled = pixels.patchify(df, p)
    expected = stack.reshape(c, h // p, p, w // p, p).transpose(1, 3, 2, 4, 0).reshape((h // p) * (w // p), p * p * c)
    np.testing.assert_array_equal(np.array(tiled.first().patches), expected)
    back = {r.channel: r.data for r in pixels.unpatchify(tiled, p).collect()}
    for i in range(c):
        np.testing.assert_array_equal(back[i], stack[i].reshape(-1))


def test_tiles_must_fit(spark):
    assert pixels.patchify(planes(spark, {("u", 0): np.zeros((1, 4, 5))}), 2).first().patches is None


def cameras(spark, poses):
    return spark.createDataFrame(
        [(u, v, [float(x) for x in m.reshape(-1)]) for (u, v), m in poses.items()], "uid STRING, view_id INT, c2w ARRAY<DOUBLE>"
    )


@pytest.mark.parametrize("bug", [True, False])
def test_rays(spark, bug):
    h, w = 3, 5
    pose = random_pose(np.random.default_rng(1))
    fx, fy, cx, cy = 1.3, 1.1, 0.5, 0.4
    got = pixels.rays(cameras(spark, {("u", 0): pose}), h, w, bug, (fx, fy, cx, cy)).collect()
    assert len(got) == h * w
    for r in got:
        if bug:
            u, v = (r.x / (w - 1) + 0.5 - cx) / fx, (r.y / (h - 1) + 0.5 - cy) / fy
        else:
            u, v = ((r.x + 0.5) / w - cx) / fx, ((r.y + 0.5) / h - cy) / fy
        d = pose[:3, :3] @ np.array([u, v, 1.0])
        d = d / np.linalg.norm(d)
        o = pose[:3, 3]
        np.testing.assert_allclose([r.dx, r.dy, r.dz], d, atol=1e-12)
        np.testing.assert_allclose([r.ox, r.oy, r.oz], o, atol=1e-12)
        np.testing.assert_allclose([r.mx, r.my, r.mz], np.cross(o, d), atol=1e-12)


def test_unprojection(spark):
    rng = np.random.default_rng(2)
    h, w = 3, 4
    pose = random_pose(rng)
    depth = rng.uniform(0.5, 2, size=(h, w))
    mask = rng.uniform(size=(h, w))
    k = np.array([[C.FXFYCXCY[0], 0, 0.5], [0, C.FXFYCXCY[1], 0.5], [0, 0, 1]])
    table = spark.createDataFrame(
        [("u", 0, h, w, [float(x) for x in depth.reshape(-1)], [float(x) for x in mask.reshape(-1)])],
        "uid STRING, view_id INT, h INT, w INT, data ARRAY<DOUBLE>, m ARRAY<DOUBLE>",
    )
    cams = cameras(spark, {("u", 0): pose})
    plain = {(r.y, r.x): [r.px, r.py, r.pz] for r in pixels.unproject(table, cams).collect()}
    masked = {(r.y, r.x): [r.px, r.py, r.pz] for r in pixels.unproject(table, cams, mask="m").collect()}
    assert len(plain) == h * w
    for y in range(h):
        for x in range(w):
            uv = np.array([x / (w - 1), y / (h - 1), 1.0]) * depth[y, x]
            p = pose[:3, :3] @ (np.linalg.inv(k) @ uv) + pose[:3, 3]
            np.testing.assert_allclose(plain[y, x], p, atol=1e-12)
            np.testing.assert_allclose(masked[y, x], (p * 0.5 + 0.5) * mask[y, x] + 1 - mask[y, x], atol=1e-12)


def test_normals_into_the_first_frame(spark):
    rng = np.random.default_rng(3)
    first_old, first_new, other = (random_pose(rng) for _ in range(3))
    n = rng.normal(size=(3, 6))
    mask = rng.uniform(size=6)
    normals = spark.createDataFrame(
        [("u", 4, *[[float(x) for x in n[i]] for i in range(3)], [float(x) for x in mask])],
        "uid STRING, view_id INT, nx ARRAY<DOUBLE>, ny ARRAY<DOUBLE>, nz ARRAY<DOUBLE>, mask ARRAY<DOUBLE>",
    )
    flat = lambda m: [float(x) for x in m.reshape(-1)]
    cams = spark.createDataFrame(
        [("u", 0, flat(first_old), flat(first_new)), ("u", 1, flat(other), flat(other))],
        "uid STRING, slot INT, original_c2w ARRAY<DOUBLE>, c2w_opengl ARRAY<DOUBLE>",
    )
    r = pixels.normalize_normals(normals, cams).first()
    turned = first_new[:3, :3] @ np.linalg.inv(first_old[:3, :3]) @ n
    np.testing.assert_allclose([r.nx, r.ny, r.nz], (turned * 0.5 + 0.5) * mask + (1 - mask), atol=1e-9)


def test_depth_normalisation(spark, rows):
    df = spark.createDataFrame(
        [("a", 0, [2.0, 4.0, 9.0], [1.0, 1.0, 0.0]), ("b", 0, [1.0, 2.0, 3.0], [0.0, 0.0, 0.0]), ("c", 0, [1.0, 2.0, 2.0], [1.0, 1.0, 1.0])],
        "uid STRING, view_id INT, data ARRAY<DOUBLE>, mask ARRAY<DOUBLE>",
    )
    normal = pixels.normalize_depth(df)
    got = {r.uid: r for r in normal.collect()}
    assert got["a"].data == [0.5, 0.0, 1.0] and got["a"].has_zero
    assert got["b"].data is None and got["b"].empty
    assert not got["c"].has_zero
    assert rows(checks.depth_without_background(normal)) == [("c",)]


def box_of(spark, plane, size=256, border=0.2):
    h, w = plane.shape
    df = spark.createDataFrame([("u", 0, h, w, [float(x) for x in plane.reshape(-1)])], "uid STRING, view_id INT, h INT, w INT, data ARRAY<DOUBLE>")
    return pixels.foreground_box(df, size, border).first()


def test_foreground_box(spark):
    plane = np.zeros((20, 30))
    plane[4:10, 7:25] = 0.3
    r = box_of(spark, plane)
    assert (r.y_min, r.y_max, r.x_min, r.x_max) == (4, 9, 7, 24)
    scale = int(256 * 0.8) / 17
    assert (r.h2, r.w2) == (int(5 * scale), int(17 * scale))
    assert (r.y2_min, r.x2_min) == ((256 - r.h2) // 2, (256 - r.w2) // 2)
    assert (r.y2_max - r.y2_min, r.x2_max - r.x2_min) == (r.h2, r.w2)


def test_box_of_nothing_and_of_one_pixel(spark):
    nothing = box_of(spark, np.zeros((4, 4)))
    assert nothing.y_min is None and nothing.h2 is None
    dot = np.zeros((4, 4))
    dot[2, 1] = 1
    one = box_of(spark, dot)
    assert (one.y_min, one.x_min) == (2, 1) and one.h2 is None


def test_strips_are_cut_into_slots(spark, rows):
    kind = "uid STRING, channel INT, h INT, w INT, data ARRAY<FLOAT>"
    strips = spark.createDataFrame([("a", 0, 2, 6, [float(i) for i in range(12)])], kind)
    assert rows(pixels.split_strip(strips, 3)) == [
        ("a", 0, 0, 2, 2, [0.0, 1.0, 6.0, 7.0]), ("a", 1, 0, 2, 2, [2.0, 3.0, 8.0, 9.0]), ("a", 2, 0, 2, 2, [4.0, 5.0, 10.0, 11.0])
    ]
    with pytest.raises(Exception, match="equal views"):
        pixels.split_strip(strips, 4).collect()


def test_depth_without_scaling(spark):
    kind = "uid STRING, view_id INT, data ARRAY<DOUBLE>, mask ARRAY<DOUBLE>"
    depth = spark.createDataFrame([("a", 0, [2.0, 4.0], [1.0, 0.5]), ("a", 1, [0.0, 0.0], [1.0, 1.0])], kind)
    got = {r.view_id: r for r in pixels.normalize_depth(depth, scaled=False).collect()}
    assert got[0].data == [-1.0, -1.0] and got[1].data == [1.0, 1.0] and got[1].empty


def test_planes_of_unequal_size_are_refused(spark):
    kind = "uid STRING, view_id INT, data ARRAY<DOUBLE>, mask ARRAY<DOUBLE>"
    depth = spark.createDataFrame([("a", 0, [2.0, 4.0, 1.0], [1.0, 0.5])], kind)
    with pytest.raises(Exception, match="unequal size: 3 and 2"):
        pixels.normalize_depth(depth).collect()
    with pytest.raises(Exception, match="unequal size"):
        pixels.composite_planes(depth, alpha="mask").collect()
