import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.functions import camera as C
from viewloom.operators import cameras, pixels
from viewloom.plans import targets

H, W = 3, 4
KEY = ["uid", "view_id"]


@pytest.fixture(scope="module")
def views(spark):
    """Five objects of three views each, at different places."""
    ids = spark.range(15).select(F.floor(F.col("id") / 3).alias("uid"), (F.col("id") % 3).cast("int").alias("view_id"))
    ele, azi = (F.col("uid") * 9 + F.col("view_id") * 4).cast("double"), (F.col("uid") * 50 + F.col("view_id") * 70).cast("double")
    poses = ids.select(*KEY, F.col("view_id").alias("slot"), C.flip_yz(C.orbit_camera(ele, azi, F.lit(1.5))).alias("c2w"))
    return cameras.training_cameras(poses, keep=("uid", "view_id", "slot"))


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(2)
    rows = [(u, v, c, H, W, rng.uniform(0, 1, H * W).tolist()) for u in range(5) for v in range(3) for c in range(5)]
    planes = spark.createDataFrame(rows, "uid long, view_id int, channel int, h int, w int, data array<double>")
    depth = planes.where("channel = 3").drop("channel")
    alpha = planes.where("channel = 4").select(*KEY, F.transform("data", lambda a: F.when(a < 0.3, 0.0).otherwise(a)).alias("data"))
    # one view has no foreground
    alpha = alpha.withColumn("data", F.when((F.col("uid") == 4) & (F.col("view_id") == 1), F.transform("data", lambda a: F.lit(0.0))).otherwise(F.col("data")))
    return planes.where("channel < 3"), depth, alpha


@pytest.fixture(scope="module")
def store(spark, parts, tmp_path_factory):
    packed = targets.pack_planes(*parts)
    yield targets.store_planes(packed, "target_planes", str(tmp_path_factory.mktemp("planes") / "t"), 4)
    spark.sql("DROP TABLE target_planes")


def test_targets_equal_the_operators(views, parts, store):
    normals, depth, alpha = parts
    got = {(r.uid, r.view_id): r for r in targets.training_targets(views, store).collect()}
    assert len(got) == 15
    masked = depth.join(alpha.withColumnRenamed("data", "mask"), KEY)
    for r in pixels.unproject(masked, views, mask="mask", scale="scale").collect():
        p = got[r.uid, r.view_id].points[r.y * W + r.x]
        np.testing.assert_allclose([p.x, p.y, p.z], [r.px, r.py, r.pz], atol=1e-12)
    channels = [F.max(F.when(F.col("channel") == i, F.col("data"))).alias(n) for i, n in enumerate(("nx", "ny", "nz"))]
    wide = normals.groupBy(*KEY).agg(*channels).join(alpha.withColumnRenamed("data", "mask"), KEY)
    opengl = views.select("uid", "slot", "original_c2w", C.flip_yz(F.col("c2w")).alias("c2w_opengl"))
    for r in pixels.normalize_normals(wide, opengl).collect():
        own = got[r.uid, r.view_id].normals
        np.testing.assert_allclose([[n.x, n.y, n.z] for n in own], np.array([r.nx, r.ny, r.nz]).T, atol=1e-12)
    for r in pixels.normalize_depth(masked).collect():
        own = got[r.uid, r.view_id].depth
        assert r.empty == (own is None) and (r.empty or np.allclose(own, r.data, atol=1e-12))
    assert got[4, 1].depth is None and got[4, 1].points[0].x == 1.0


def test_planes_are_not_shuffled(spark, views, store):
    """From the scan of the planes to the targets there is no exchange, even if nothing may be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = targets.training_targets(views, store)
        lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    (scan,) = [k for k, line in enumerate(lines) if "target_planes" in line and "Scan" in line]
    depth = lines[scan].index("Scan")
    above = []
    for line in reversed(lines[:scan]):
        # an ancestor stands further left than all nodes seen so far
        at = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if at < depth:
            above.append(line)
            depth = at
    assert above and any("Join" in line for line in above)
    assert not any("Exchange" in line for line in above)
    assert any("Exchange" in line for line in lines)


def test_a_view_without_planes_gives_no_row(views, store):
    more = views.unionByName(views.where("uid = 0").withColumn("uid", F.lit(99).cast("long")))
    assert targets.training_targets(more, store).where("uid = 99").count() == 0
