"""Image planes: composite, decode, tiles, depth, normals, boxes, image scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.catalog import standins as S
from viewloom.catalog.base import digest, digest_sql, query, r6, s6, table
from viewloom.functions import camera as C
from viewloom.functions import pixels as P
from viewloom.operators import cameras, checks, metrics, pixels
from viewloom.operators.rows import explode_rows
from viewloom.plans import targets
from viewloom.session import scratch_path

KEY = ["uid", "view_id"]

# Truth side of the stand-in, one row per pixel, and the opacity of its channel 0.
_PX = f"{S.PLANES_SQL}, alpha AS (SELECT uid, view_id, i, y, x, {S.ALPHA_SQL} AS a FROM px WHERE side = 1 AND channel = 0)"


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.planes(spark, sf_dir).where("side = 1").drop("side")


def _with_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    alpha = S.alpha_planes(spark, sf_dir).select(*KEY, F.col("data").alias("alpha"))
    return _truth(spark, sf_dir).join(alpha, KEY)


def _exploded(planes: DataFrame, *keep: str, value: str = "data") -> DataFrame:
    return explode_rows(planes, value, "v", keep, "i").withColumn("v", r6(F.col("v").cast("double")))


@query(
    f"""WITH {_PX}
SELECT uid, view_id, channel, i, {s6("v::DOUBLE * a + (1.0 - a) * 0.5")} AS v
FROM (SELECT *, max(CASE WHEN channel = 0 THEN {S.ALPHA_SQL} END) OVER (PARTITION BY uid, view_id, i) AS a FROM px WHERE side = 1) WHERE a IS NOT NULL"""
)
def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(pixels.composite_planes(_with_alpha(spark, sf_dir), background=0.5), *KEY, "channel")


@query(
    f"""WITH {_PX}
SELECT uid, view_id, channel, i, {s6("(CASE WHEN channel = 0 THEN -1 ELSE 1 END) * (v::DOUBLE * 2.0 - 1.0)")} AS v FROM px WHERE side = 1"""
)
def decode_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(pixels.decode_nd(_truth(spark, sf_dir)), *KEY, "channel")


@query(f"WITH {_PX} SELECT uid, view_id, channel, i, {s6('v::DOUBLE * 5.0')} AS v FROM px WHERE side = 1")
def decode_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel read as the depth channel."""
    depth = pixels.decode_nd(_truth(spark, sf_dir).withColumns({"_c": F.col("channel"), "channel": F.lit(3)}))
    return _exploded(depth.withColumn("channel", F.col("_c")), *KEY, "channel")


@query(
    f"""WITH {_PX}
SELECT uid, view_id, channel, sum(CASE WHEN view_id = 2 THEN 1.0 ELSE v::DOUBLE END) > 63.999999 AS white,
       {s6("sum(CASE WHEN view_id = 2 THEN 1.0 ELSE v::DOUBLE END)")} AS total, count(*)::INTEGER AS n
FROM px WHERE side = 1 GROUP BY uid, view_id, channel"""
)
def fill_missing_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planes of view 2 are taken away and come back white."""
    gaps = _truth(spark, sf_dir).withColumn("data", F.when(F.col("view_id") != 2, F.col("data")))
    filled = pixels.fill_missing_plane(gaps)
    total = F.aggregate("data", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return filled.select(
        *KEY, "channel", (total > 63.999999).alias("white"), r6(total).alias("total"), F.size("data").alias("n")
    )


_PATCH_SQL = f"""WITH {_PX}, c AS (SELECT uid, view_id, count(DISTINCT channel) AS cs FROM px WHERE side = 1 GROUP BY uid, view_id)
SELECT uid, view_id, ((y // 4) * 2 + x // 4)::INTEGER AS patch, (((y % 4) * 4 + x % 4) * cs + channel)::INTEGER AS j, {s6("v::DOUBLE")} AS v
FROM px JOIN c USING (uid, view_id) WHERE side = 1"""


@query(_PATCH_SQL)
def patchify(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = explode_rows(pixels.patchify(_truth(spark, sf_dir), 4), "patches", "values", KEY, "patch")
    return explode_rows(tiles, "values", "v", [*KEY, "patch"], "j").withColumn("v", r6(F.col("v").cast("double")))


@query(f"WITH {_PX} SELECT uid, view_id, channel, i, {s6('v::DOUBLE')} AS v FROM px WHERE side = 1")
def unpatchify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles and back: the planes return unchanged."""
    back = pixels.unpatchify(pixels.patchify(_truth(spark, sf_dir), 4), 4)
    return _exploded(back, *KEY, "channel")


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel 0 as depth with its own opacity as the mask."""
    return _with_alpha(spark, sf_dir).where("channel = 0").select(*KEY, "h", "w", "data", F.col("alpha").alias("mask"))


_DEPTH_SQL = f"""{_PX},
d AS (SELECT p.uid, p.view_id, p.i, p.y, p.x, p.v::DOUBLE AS v, a.a, p.v::DOUBLE * a.a AS m FROM px p
      JOIN alpha a USING (uid, view_id, i) WHERE p.side = 1 AND p.channel = 0),
t AS (SELECT *, max(m) OVER (PARTITION BY uid, view_id) AS top, min(m) OVER (PARTITION BY uid, view_id) AS low FROM d)"""


@query(f"WITH {_DEPTH_SQL} SELECT uid, view_id, i, low = 0 AS has_zero, {s6('1.0 - m / top')} AS v FROM t WHERE top <> 0")
def normalize_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = pixels.normalize_depth(_depth(spark, sf_dir)).where("NOT empty")
    return _exploded(normal, *KEY, "has_zero").select(*KEY, "i", "has_zero", "v")


@query(f"WITH {_DEPTH_SQL} SELECT uid, view_id, i, {s6('1.0 - m')} AS v FROM t")
def unscaled_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked depth in its true scale, inverted."""
    return _exploded(pixels.normalize_depth(_depth(spark, sf_dir), scaled=False), *KEY)


@query(
    f"""SELECT vec_id AS uid, k::INTEGER AS slot, 0 AS channel, 4 AS h, 4 AS w,
  {digest_sql("data")} AS data FROM (SELECT vec_id, k, flatten([embedding[16 * y + 4 * k + 1 : 16 * y + 4 * k + 4] FOR y IN range(4)]) AS data
  FROM embeddings, range(4) AS r(k))"""
)
def split_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as strips of four views of 4 x 4 pixels."""
    strips = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("uid"), F.lit(0).alias("channel"), F.lit(4).alias("h"), F.lit(16).alias("w"), F.col("embedding").alias("data")
    )
    return pixels.split_strip(strips, 4).withColumn("data", digest(F.col("data")))


@query(
    f"""WITH {_PX}
SELECT uid FROM px WHERE side = 1 AND channel = 0 GROUP BY uid
HAVING min(v::DOUBLE * least(greatest((v::DOUBLE * 2.0 - 1.0) * 5.0 + 1.5, 0.0), 1.0)) <> 0"""
)
def depth_without_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that fill every pixel of every view, under a wider mask."""
    wide = F.transform("data", lambda p: F.least(F.greatest((p.cast("double") * 2.0 - 1.0) * 5.0 + 1.5, F.lit(0.0)), F.lit(1.0)))
    depth = _truth(spark, sf_dir).where("channel = 0").withColumn("mask", wide)
    return checks.depth_without_background(pixels.normalize_depth(depth))


@query(
    f"""WITH {_PX}, {S.PLANE_CAMERAS_SQL},
j AS (SELECT p.uid, p.view_id, p.y, p.x, p.v::DOUBLE * 2.0 AS d, a.a, c.* EXCLUDE (uid, view_id)
      FROM px p JOIN cam c ON p.uid = c.uid AND p.view_id = c.view_id
      JOIN alpha a ON p.uid = a.uid AND p.view_id = a.view_id AND p.i = a.i WHERE p.side = 1 AND p.channel = 0),
k AS (SELECT *, d * (x / 7.0 - 0.5) / (1422.222 / 1024) AS u, d * (y / 7.0 - 0.5) / (1422.222 / 1024) AS v FROM j),
w AS (SELECT *, m00*u + m01*v + m02*d + m03 AS wx, m10*u + m11*v + m12*d + m13 AS wy, m20*u + m21*v + m22*d + m23 AS wz FROM k)
SELECT uid, view_id, y, x, {s6("(wx*0.5 + 0.5)*a + (1.0 - a)")} AS px, {s6("(wy*0.5 + 0.5)*a + (1.0 - a)")} AS py,
       {s6("(wz*0.5 + 0.5)*a + (1.0 - a)")} AS pz FROM w"""
)
def unproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth planes to masked coordinate images."""
    depth = _depth(spark, sf_dir).withColumn("data", F.transform("data", lambda v: v.cast("double") * 2.0))
    points = pixels.unproject(depth, S.plane_cameras(spark, sf_dir), mask="mask")
    return points.select(*KEY, "y", "x", *[r6(c).alias(c) for c in ("px", "py", "pz")])


# Only full views carry three channels; the rotation is new * old^T of view 0.
_NORMALS_SQL = f"""{_PX}, {S.PLANE_CAMERAS_SQL},
n AS (SELECT uid, view_id, i, max(CASE WHEN channel = 0 THEN -(v::DOUBLE*2-1) END) AS nx, max(CASE WHEN channel = 1 THEN v::DOUBLE*2-1 END) AS ny,
             max(CASE WHEN channel = 2 THEN v::DOUBLE*2-1 END) AS nz FROM px WHERE side = 1 GROUP BY uid, view_id, i),
o AS (SELECT uid, m00, m01, m02, m20 AS m10, m21 AS m11, m22 AS m12, -m10 AS m20, -m11 AS m21, -m12 AS m22 FROM cam WHERE view_id = 0),
g AS (SELECT uid, m00, -m01 AS m01, -m02 AS m02, m10, -m11 AS m11, -m12 AS m12, m20, -m21 AS m21, -m22 AS m22 FROM o),
a0 AS (SELECT uid, -degrees(asin(greatest(-1.0, least(1.0, py / sqrt(px*px + py*py + pz*pz))))) AS ele
       FROM (SELECT uid, m03 AS px, m23 AS py, -m13 AS pz FROM cam WHERE view_id = 0)),
e0 AS (SELECT uid, radians((CASE WHEN ele >= 0 THEN 1 ELSE -1 END) * (abs(ele) - 1e-8)) AS e FROM a0),
w AS (SELECT uid, [1.0, 0.0, 0.0] AS w0, [0.0, cos(e), -sin(e)] AS w1, [0.0, sin(e), cos(e)] AS w2 FROM e0)"""


def _turned_sql(row: str) -> str:
    """Row of (new rotation) * (old rotation transposed) applied to the normal."""
    old = [f"(g.m0{c}*n.nx + g.m1{c}*n.ny + g.m2{c}*n.nz)" for c in range(3)]
    value = " + ".join(f"w.{row}[{c + 1}]*{old[c]}" for c in range(3))
    return s6(f"(({value})*0.5 + 0.5)*a.a + (1.0 - a.a)")


@query(
    f"""WITH {_NORMALS_SQL}
SELECT n.uid, n.view_id, n.i, {_turned_sql("w0")} AS nx, {_turned_sql("w1")} AS ny, {_turned_sql("w2")} AS nz
FROM n JOIN g ON n.uid = g.uid JOIN w ON n.uid = w.uid JOIN alpha a ON n.uid = a.uid AND n.view_id = a.view_id AND n.i = a.i
WHERE n.nx IS NOT NULL AND n.ny IS NOT NULL AND n.nz IS NOT NULL"""
)
def normalize_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels as normals, turned into the frame of each object's first view."""
    decoded = pixels.decode_nd(_truth(spark, sf_dir))
    channels = [F.max(F.when(F.col("channel") == i, F.col("data"))).alias(n) for i, n in enumerate(("nx", "ny", "nz"))]
    alpha = S.alpha_planes(spark, sf_dir).select(*KEY, F.col("data").alias("mask"))
    normals = decoded.groupBy(*KEY).agg(*channels).dropna().join(alpha, KEY)
    made = cameras.training_cameras(
        S.plane_cameras(spark, sf_dir).withColumn("slot", F.col("view_id")), keep=("uid", "view_id", "slot")
    )
    opengl = made.select("uid", "slot", "original_c2w", C.flip_yz(F.col("c2w")).alias("c2w_opengl"))
    turned = pixels.normalize_normals(normals, opengl)
    zipped = explode_rows(turned, F.arrays_zip("nx", "ny", "nz"), "p", KEY, "i")
    return zipped.select(*KEY, "i", *[r6(F.col(f"p.{c}")).alias(c) for c in ("nx", "ny", "nz")])


def _stored_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planes of full views in a bucketed table."""
    depth = _truth(spark, sf_dir).where("channel = 0").withColumn("data", F.transform("data", lambda v: v.cast("double") * 2.0))
    packed = targets.pack_planes(pixels.decode_nd(_truth(spark, sf_dir)), depth, S.alpha_planes(spark, sf_dir))
    path = scratch_path(spark, "planes")
    return targets.store_planes(packed, path.rsplit("/", 1)[-1].replace("-", "_"), path, 8)


@query(
    f"""WITH {_NORMALS_SQL},
d AS (SELECT p.uid, p.view_id, p.i, p.y, p.x, p.v::DOUBLE AS v, a.a, p.v::DOUBLE * a.a AS m FROM px p
      JOIN alpha a USING (uid, view_id, i) WHERE p.side = 1 AND p.channel = 0),
t AS (SELECT *, max(m) OVER (PARTITION BY uid, view_id) AS top FROM d),
k AS (SELECT t.*, c.* EXCLUDE (uid, view_id), v * 2.0 AS far, v * 2.0 * (x / 7.0 - 0.5) / (1422.222 / 1024) AS cu,
        v * 2.0 * (y / 7.0 - 0.5) / (1422.222 / 1024) AS cv FROM t JOIN cam c ON t.uid = c.uid AND t.view_id = c.view_id),
p AS (SELECT uid, view_id, i, a, m, top, m00*cu + m01*cv + m02*far + m03 AS wx, m10*cu + m11*cv + m12*far + m13 AS wy,
        m20*cu + m21*cv + m22*far + m23 AS wz FROM k)
SELECT n.uid, n.view_id, n.view_id AS slot, n.i, {s6("(wx*0.5 + 0.5)*p.a + (1.0 - p.a)")} AS px, {s6("(wy*0.5 + 0.5)*p.a + (1.0 - p.a)")} AS py,
  {s6("(wz*0.5 + 0.5)*p.a + (1.0 - p.a)")} AS pz, {_turned_sql("w0")} AS nx, {_turned_sql("w1")} AS ny, {_turned_sql("w2")} AS nz,
  CASE WHEN top <> 0 THEN {s6("1.0 - m / top")} END AS depth
FROM n JOIN p ON n.uid = p.uid AND n.view_id = p.view_id AND n.i = p.i JOIN g ON n.uid = g.uid JOIN w ON n.uid = w.uid
JOIN alpha a ON n.uid = a.uid AND n.view_id = a.view_id AND n.i = a.i
WHERE n.nx IS NOT NULL AND n.ny IS NOT NULL AND n.nz IS NOT NULL"""
)
def training_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the coordinate, normal and depth images of their stored planes."""
    poses = S.plane_cameras(spark, sf_dir)
    made = cameras.training_cameras(poses.withColumn("slot", F.col("view_id")), keep=("uid", "view_id", "slot"))
    views = made.join(poses.withColumnRenamed("c2w", "stored"), KEY)
    found = targets.training_targets(views, _stored_planes(spark, sf_dir), pose="stored", scale=None)
    zipped = F.arrays_zip("points", "normals", F.coalesce("depth", F.transform("points", lambda p: F.lit(None).cast("double"))).alias("depth"))
    px = explode_rows(found, zipped, "z", [*KEY, "slot"], "i")
    points, normals = ([r6(F.col(f"z.{name}.{a}")).alias(f"{name[0]}{a}") for a in "xyz"] for name in ("points", "normals"))
    return px.select(*KEY, "slot", "i", *points, *normals, r6(F.col("z.depth")).alias("depth"))


@query(
    f"""WITH {_PX},
b AS (SELECT uid, view_id, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max FROM alpha WHERE a > 0.9 GROUP BY uid, view_id),
s AS (SELECT *, y_max - y_min AS h, x_max - x_min AS w, 204.0::DOUBLE / nullif(greatest(y_max - y_min, x_max - x_min), 0) AS k FROM b),
t AS (SELECT *, floor(h * k)::INTEGER AS h2, floor(w * k)::INTEGER AS w2 FROM s)
SELECT uid, view_id, y_min, y_max, x_min, x_max, h2, w2, floor((256 - h2) / 2.0)::INTEGER AS y2_min, floor((256 - w2) / 2.0)::INTEGER AS x2_min,
       floor((256 - h2) / 2.0)::INTEGER + h2 AS y2_max, floor((256 - w2) / 2.0)::INTEGER + w2 AS x2_max FROM t"""
)
def foreground_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the opaque pixels and their place in a 256 x 256 frame."""
    opaque = S.alpha_planes(spark, sf_dir).withColumn("data", F.transform("data", lambda a: a - 0.9))
    return pixels.foreground_box(opaque, 256, 0.2).where("y_min IS NOT NULL")


_MSE = "(a::DOUBLE - b::DOUBLE) * (a::DOUBLE - b::DOUBLE)"


@query(f"WITH {S.PLANES_SQL} SELECT uid, view_id, {s6(f'avg({_MSE})')} AS mse, {s6(f'-10 * log10(avg({_MSE}))')} AS psnr FROM pp GROUP BY uid, view_id")
def psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.psnr(S.plane_pairs(spark, sf_dir))
    return scores.select(*KEY, r6("mse").alias("mse"), r6("psnr").alias("psnr"))


@query(f"WITH {S.PLANES_SQL} SELECT view_id, {s6(f'-10 * log10(avg({_MSE}))')} AS psnr FROM pp GROUP BY view_id")
def psnr_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.psnr_pooled(S.plane_pairs(spark, sf_dir), ["view_id"])
    return scores.select("view_id", r6("psnr").alias("psnr"))


@query(f"WITH {S.PLANES_SQL} SELECT channel, {s6(f'avg({_MSE})')} AS mse FROM pp GROUP BY channel")
def plane_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.plane_mse(S.plane_pairs(spark, sf_dir), ["channel"]).withColumn("mse", r6("mse"))


# 8 x 8 planes leave 2 x 2 window positions: top-left corners (0..1, 0..1).
_SSIM_SQL = f"""{S.PLANES_SQL},
q AS (SELECT uid, view_id, channel, y, x, floor(a * 255::FLOAT)::DOUBLE AS a, floor(b * 255::FLOAT)::DOUBLE AS b FROM pp),
win AS (
  SELECT uid, view_id, channel, t.t, l.l, avg(a) AS ux, avg(b) AS uy, avg(a*a) AS xx, avg(b*b) AS yy, avg(a*b) AS xy
  FROM q, (SELECT unnest(range(2)) AS t) t, (SELECT unnest(range(2)) AS l) l
  WHERE y BETWEEN t.t AND t.t + 6 AND x BETWEEN l.l AND l.l + 6 GROUP BY ALL),
v AS (SELECT *, 49.0/48 * (xx - ux*ux) AS vx, 49.0/48 * (yy - uy*uy) AS vy, 49.0/48 * (xy - ux*uy) AS vxy FROM win),
ss AS (
  SELECT uid, view_id, channel, avg((2*ux*uy + 6.5025) * (2*vxy + 58.5225) / ((ux*ux + uy*uy + 6.5025) * (vx + vy + 58.5225))) AS s
  FROM v GROUP BY uid, view_id, channel),
ssim AS (SELECT uid, view_id, avg(s) AS ssim FROM ss GROUP BY uid, view_id)"""


@query(f"WITH {_SSIM_SQL} SELECT uid, view_id, {s6('ssim')} AS ssim FROM ssim")
def ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ssim(S.plane_pairs(spark, sf_dir)).withColumn("ssim", r6("ssim"))


@query(
    f"""WITH {_SSIM_SQL}, ps AS (SELECT uid, view_id, -10 * log10(avg({_MSE})) AS psnr FROM pp GROUP BY uid, view_id)
SELECT view_id, {s6("avg(psnr)")} AS psnr_mean, {s6("stddev_samp(psnr)")} AS psnr_std, {s6("avg(ssim)")} AS ssim_mean, {s6("stddev_pop(ssim)")} AS ssim_std
FROM ps JOIN ssim USING (uid, view_id) GROUP BY view_id"""
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.plane_pairs(spark, sf_dir)
    scores = metrics.psnr(pairs).join(metrics.ssim(pairs), KEY)
    summary = metrics.score_summary(scores, ["view_id"])
    return summary.select("view_id", *[r6(c).alias(c) for c in summary.columns if c != "view_id"])


@query(
    f"""WITH {S.PLANES_SQL},
m AS (SELECT a.uid, a.view_id AS slot, b.view_id, a.channel, avg((a.v::DOUBLE - b.v::DOUBLE) * (a.v::DOUBLE - b.v::DOUBLE)) AS mse
      FROM px a JOIN px b ON a.uid = b.uid AND a.channel = b.channel AND a.i = b.i AND b.view_id = [0, 2, 3][a.view_id + 1]
      WHERE a.side = 0 AND b.side = 1 AND a.view_id < 3 GROUP BY ALL)
SELECT uid, slot, view_id, channel, {s6("mse")} AS mse FROM m"""
)
def pair_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted slots 0, 1, 2 against truth views 0, 2, 3."""
    both = S.planes(spark, sf_dir)
    pred = both.where("side = 0").withColumnRenamed("view_id", "slot").drop("side")
    pairs = metrics.pair_eval(pred, both.where("side = 1").drop("side"), (0, 2, 3))
    return metrics.plane_mse(pairs, ["uid", "slot", "view_id", "channel"]).withColumn("mse", r6("mse"))


@query(
    f"""WITH {S.PLANES_SQL},
n AS (SELECT uid, view_id, i, max(CASE WHEN channel = 0 THEN a::DOUBLE*2-1 END) AS ax, max(CASE WHEN channel = 1 THEN a::DOUBLE*2-1 END) AS ay,
  max(CASE WHEN channel = 2 THEN a::DOUBLE*2-1 END) AS az, max(CASE WHEN channel = 0 THEN b::DOUBLE*2-1 END) AS bx,
  max(CASE WHEN channel = 1 THEN b::DOUBLE*2-1 END) AS by_, max(CASE WHEN channel = 2 THEN b::DOUBLE*2-1 END) AS bz FROM pp GROUP BY uid, view_id, i)
SELECT uid, view_id, {s6("avg((ax*bx + ay*by_ + az*bz) / (greatest(sqrt(ax*ax + ay*ay + az*az), 1e-8) * greatest(sqrt(bx*bx + by_*by_ + bz*bz), 1e-8)))")} AS normal_cosim
FROM n WHERE az IS NOT NULL AND ay IS NOT NULL GROUP BY uid, view_id"""
)
def normal_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = S.plane_pairs(spark, sf_dir)
    signed = [
        F.max(F.when(F.col("channel") == i, P.decode_normal(F.col(side)))).alias(f"{side}{axis}")
        for side in "ab"
        for i, axis in enumerate("xyz")
    ]
    normals = pairs.groupBy(*KEY).agg(*signed).dropna()
    return metrics.normal_cosine(normals).withColumn("normal_cosim", r6("normal_cosim"))
