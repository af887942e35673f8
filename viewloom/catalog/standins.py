"""The driver's tables seen as view files, cameras, planes, points and logs.

Each stand-in has an SQL twin (``*_SQL``, a common table expression).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.catalog.base import table
from viewloom.functions import camera as C
from viewloom.operators.rows import explode_rows

RING = 7

FILES_SQL = """files AS (
  SELECT l_orderkey AS uid, l_linenumber - 1 AS view_id, l_returnflag <> 'R' AS has_png, l_linestatus = 'F' AS has_json
  FROM lineitem),
valid AS (
  SELECT uid, view_id FROM files GROUP BY uid, view_id HAVING bool_or(has_png) AND bool_or(has_json)),
objects AS (SELECT DISTINCT uid FROM files),
grid AS (SELECT uid, g.view_id::INTEGER AS view_id FROM objects, (SELECT unnest(range(7)) AS view_id) g)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order = object, line = view; the flags say which of its two files exist."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("uid"),
        (F.col("l_linenumber") - 1).alias("view_id"),
        (F.col("l_returnflag") != "R").alias("has_png"),
        (F.col("l_linestatus") == "F").alias("has_json"),
    )


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, one row per file."""
    flagged = files(spark, sf_dir)
    kinds = F.array(F.when(F.col("has_png"), F.lit("png")), F.when(F.col("has_json"), F.lit("json")))
    return explode_rows(flagged, F.array_compact(kinds), "kind", ["uid", "view_id"])


CAMERAS_SQL = """angles AS (
  SELECT l_orderkey AS uid, l_linenumber - 1 AS view_id, l_partkey, l_suppkey, l_discount,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_discount) AS rn
  FROM lineitem),
cameras AS (
  SELECT uid, view_id, (l_suppkey % 60 - 30)::DOUBLE AS ele, (l_partkey % 360)::DOUBLE AS azi, 1.4 + l_discount AS dis
  FROM angles WHERE rn = 1)"""


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, view_id, ele, azi, dis), one per view: the smallest line of a repeated key."""
    lines = table(spark, sf_dir, "lineitem")
    one = lines.groupBy(F.col("l_orderkey").alias("uid"), (F.col("l_linenumber") - 1).alias("view_id")).agg(
        F.min(F.struct("l_partkey", "l_suppkey", "l_discount")).alias("r")
    )
    return one.select(
        "uid",
        "view_id",
        (F.col("r.l_suppkey") % 60 - 30).cast("double").alias("ele"),
        (F.col("r.l_partkey") % 360).cast("double").alias("azi"),
        (F.col("r.l_discount") + 1.4).alias("dis"),
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras with an OpenGL look-at pose."""
    return angles(spark, sf_dir).withColumn("c2w", C.orbit_camera(F.col("ele"), F.col("azi"), F.col("dis")))


# Pose of the twin, by the look-at rule: forward is the unit position, right is
# the unit of up x forward, up is forward x right.
POSES_SQL = (
    CAMERAS_SQL
    + """,
pos AS (
  SELECT *, dis * cos(radians(ele)) * sin(radians(azi)) AS px, -dis * sin(radians(ele)) AS py,
         dis * cos(radians(ele)) * cos(radians(azi)) AS pz FROM cameras),
fwd AS (
  SELECT *, px / sqrt(px*px + py*py + pz*pz) AS fx, py / sqrt(px*px + py*py + pz*pz) AS fy,
         pz / sqrt(px*px + py*py + pz*pz) AS fz FROM pos),
rgt AS (SELECT *, fz / sqrt(fz*fz + fx*fx) AS rx, 0.0 AS ry, -fx / sqrt(fz*fz + fx*fx) AS rz FROM fwd),
poses AS (SELECT *, fy*rz - fz*ry AS ux, fz*rx - fx*rz AS uy, fx*ry - fy*rx AS uz FROM rgt)"""
)


PLANES_SQL = """vecs AS (
  SELECT vec_id, vec_id // 24 AS uid, ((vec_id // 6) % 4)::INTEGER AS view_id, ((vec_id // 2) % 3)::INTEGER AS channel,
         vec_id % 2 AS side, embedding FROM embeddings),
px AS (
  SELECT uid, view_id, channel, side, i::INTEGER AS i, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x,
         ((embedding[i + 1] + 1) / 2)::FLOAT AS v
  FROM vecs, (SELECT unnest(range(64)) AS i)),
pp AS (
  SELECT a.uid, a.view_id, a.channel, a.i, a.y, a.x, a.v AS a, b.v AS b
  FROM px a JOIN px b USING (uid, view_id, channel, i) WHERE a.side = 0 AND b.side = 1)"""


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 planes: 24 vectors are one object of 4 views x 3 channels x 2 sides."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(v / 24).alias("uid"),
        (F.floor(v / 6) % 4).cast("int").alias("view_id"),
        (F.floor(v / 2) % 3).cast("int").alias("channel"),
        (v % 2).alias("side"),
        F.lit(8).alias("h"),
        F.lit(8).alias("w"),
        F.transform("embedding", lambda e: ((e + F.lit(1).cast("float")) / 2).cast("float")).alias("data"),
    )


def plane_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even vectors are predictions (a), odd ones the truth (b)."""
    both = planes(spark, sf_dir)
    keys = ["uid", "view_id", "channel"]
    left = both.where("side = 0").select(*keys, "h", "w", F.col("data").alias("a"))
    right = both.where("side = 1").select(*keys, F.col("data").alias("b"))
    return left.join(right, keys)


def alpha_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uid, view_id, h, w, data): opacity 5v cut to [0, 1]; channel 0 of the truth side."""
    return planes(spark, sf_dir).where("side = 1 AND channel = 0").select(
        "uid", "view_id", "h", "w", F.transform("data", lambda p: _alpha(p.cast("double"))).alias("data")
    )


def _alpha(p):
    return F.least(F.greatest((p * 2.0 - 1.0) * 5.0, F.lit(0.0)), F.lit(1.0))


ALPHA_SQL = "least(greatest((v::DOUBLE * 2.0 - 1.0) * 5.0, 0.0), 1.0)"


PLANE_CAMERAS_SQL = """pcam AS (
  SELECT uid, view_id, (uid % 60 - 30 + view_id)::DOUBLE AS ele, (uid * 37 % 360 + view_id * 90)::DOUBLE AS azi,
         1.4 + (uid % 10) / 10.0::DOUBLE AS dis
  FROM (SELECT DISTINCT uid, view_id FROM vecs)),
pm AS (
  SELECT *, sin(radians(ele)) AS se, cos(radians(ele)) AS ce, sin(radians(azi)) AS sa, cos(radians(azi)) AS ca
  FROM pcam),
cam AS (
  SELECT uid, view_id, ca AS m00, -se*sa AS m01, -ce*sa AS m02, dis*ce*sa AS m03,
         0.0 AS m10, -ce AS m11, se AS m12, -dis*se AS m13,
         -sa AS m20, -se*ca AS m21, -ce*ca AS m22, dis*ce*ca AS m23 FROM pm)"""


def plane_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OpenCV camera per plane view, from its ids."""
    ids = planes(spark, sf_dir).select("uid", "view_id").distinct()
    ele = (F.col("uid") % 60 - 30 + F.col("view_id")).cast("double")
    azi = (F.col("uid") * 37 % 360 + F.col("view_id") * 90).cast("double")
    dis = F.lit(1.4) + (F.col("uid") % 10) / 10.0
    return ids.select("uid", "view_id", C.flip_yz(C.orbit_camera(ele, azi, dis)).alias("c2w"))


POINTS_SQL = """points AS (
  SELECT vec_id AS uid, g AS gid, embedding[3*g + 1]::DOUBLE AS x, embedding[3*g + 2]::DOUBLE AS y, embedding[3*g + 3]::DOUBLE AS z
  FROM embeddings, (SELECT unnest(range(21)) AS g))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 points per vector: consecutive triples."""
    exploded = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("uid"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("gid")
    )
    return exploded.select(
        "uid",
        F.col("gid").cast("bigint").alias("gid"),
        *[F.get("embedding", F.col("gid") * 3 + i).cast("double").alias(a) for i, a in enumerate("xyz")],
    )


# 14 attributes per Gaussian, four Gaussians per vector.
GAUSSIANS_SQL = """raw AS (
  SELECT vec_id AS uid, g AS gid, [e::DOUBLE FOR e IN embedding[14*g + 1 : 14*g + 14]] AS e
  FROM embeddings, (SELECT unnest(range(4)) AS g)),
gaussians AS (
  SELECT uid, gid, e[1] AS x, e[2] AS y, e[3] AS z,
         e[4] + 0.5 AS f_dc_0, e[5] + 0.5 AS f_dc_1, e[6] * 4 + 0.5 AS f_dc_2,
         (e[7] + 1) / 2 AS opacity, abs(e[8]) AS scale_0, abs(e[9]) AS scale_1, abs(e[10]) AS scale_2,
         e[11] AS rot_0, e[12] AS rot_1, e[13] AS rot_2, e[14] AS rot_3 FROM raw)"""


def gaussians(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("uid"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("gid")
    )

    def e(i: int):
        return F.get("embedding", F.col("gid") * 14 + (i - 1)).cast("double")

    columns = {
        "x": e(1), "y": e(2), "z": e(3),
        "f_dc_0": e(4) + 0.5, "f_dc_1": e(5) + 0.5, "f_dc_2": e(6) * 4 + 0.5,
        "opacity": (e(7) + 1) / 2,
        "scale_0": F.abs(e(8)), "scale_1": F.abs(e(9)), "scale_2": F.abs(e(10)),
        "rot_0": e(11), "rot_1": e(12), "rot_2": e(13), "rot_3": e(14),
    }
    return exploded.select("uid", F.col("gid").cast("bigint").alias("gid"), *[c.alias(n) for n, c in columns.items()])


LINES_SQL = """lines AS (
  SELECT user_id::VARCHAR AS run, event_id AS line_no,
    CASE event_type
      WHEN 'purchase' THEN 'Validation: 100%|##| 4/4 [00:01<00:00, lpips=0.' || lpad((event_id % 1000)::VARCHAR, 3, '0')
           || ', psnr=' || value::VARCHAR
           || CASE WHEN event_id % 3 = 0 THEN '' ELSE ', ssim=0.' || lpad((event_id % 997)::VARCHAR, 3, '0') END || ']'
      WHEN 'error' THEN 'Training: 10%|#| ' || event_id::VARCHAR || '/900000 [00:01<00:02, ema=0.99, loss=nan, lr=1e-05]'
      ELSE 'Training: 10%|#| ' || event_id::VARCHAR || '/900000 [00:01<00:02, ema=0.99, loss=' || value::VARCHAR
           || ', lr=' || (event_id % 9 + 1)::VARCHAR || 'e-05]'
    END AS line FROM events)"""

TRAIN_RE = r"\|\s*(\d+)/\d+\s*\[.*?loss=([\d.e+\-]+|nan).*?lr=([\d.e+\-]+)"

PARSED_SQL = (
    LINES_SQL
    + f""",
groups AS (
  SELECT *, regexp_extract(line, '{TRAIN_RE}', 1) AS s, regexp_extract(line, '{TRAIN_RE}', 2) AS l,
         regexp_extract(line, '{TRAIN_RE}', 3) AS r, regexp_extract(line, 'psnr=([\\d.e+\\-]+)', 1) AS p,
         regexp_extract(line, 'lpips=([\\d.e+\\-]+)', 1) AS q, regexp_extract(line, 'ssim=([\\d.e+\\-]+)', 1) AS m
  FROM lines),
train AS (
  SELECT run, line_no, s::BIGINT AS step, l::DOUBLE AS loss, r::DOUBLE AS lr FROM groups WHERE s <> '' AND l <> 'nan'),
val AS (
  SELECT run, line_no, p::DOUBLE AS psnr, q::DOUBLE AS lpips, nullif(m, '')::DOUBLE AS ssim
  FROM groups WHERE p <> '' AND q <> '')"""
)


def log_columns() -> dict:
    """Event columns to one log line."""
    value, event = F.col("value").cast("string"), F.col("event_id")
    ssim = F.when(event % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit(", ssim=0."), F.lpad((event % 997).cast("string"), 3, "0"))
    )
    val = F.concat(
        F.lit("Validation: 100%|##| 4/4 [00:01<00:00, lpips=0."),
        F.lpad((event % 1000).cast("string"), 3, "0"),
        F.lit(", psnr="),
        value,
        ssim,
        F.lit("]"),
    )
    start = F.concat(F.lit("Training: 10%|#| "), event.cast("string"), F.lit("/900000 [00:01<00:02, ema=0.99, loss="))
    train = F.concat(start, value, F.lit(", lr="), (event % 9 + 1).cast("string"), F.lit("e-05]"))
    broken = F.concat(start, F.lit("nan, lr=1e-05]"))
    line = F.when(F.col("event_type") == "purchase", val).when(F.col("event_type") == "error", broken).otherwise(train)
    return {"run": F.col("user_id").cast("string"), "line_no": event, "line": line}


def as_lines(events: DataFrame) -> DataFrame:
    """(run, line_no, line); the generator keeps filters on the text from composing it again."""
    columns = log_columns()
    return events.select(
        columns["run"].alias("run"), columns["line_no"].alias("line_no"), F.explode(F.array(columns["line"])).alias("line")
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: user = run, event id = line number."""
    return as_lines(table(spark, sf_dir, "events"))


# Orders as the files of runs: customer = run, order = file.
ARTIFACTS_SQL = """artifacts AS (
  SELECT o_custkey AS run, o_orderdate AS mtime, (o_totalprice * 100)::BIGINT AS length,
    CASE o_orderstatus
      WHEN 'F' THEN printf('img%d_%06d_gs.png', o_orderkey % 5, o_orderkey % 50)
      WHEN 'O' THEN printf('img%d_%06d.%s', o_orderkey % 5, o_orderkey % 50, CASE WHEN o_orderkey % 2 = 0 THEN 'gif' ELSE 'mp4' END)
      ELSE printf('%06d', (o_orderkey % 50) * 100) END AS name,
    o_orderstatus AS status, o_orderkey % 7 = 0 AND o_orderstatus <> 'P' AS stray FROM orders),
named AS (
  SELECT run, mtime, length, name,
    '/out/' || run::VARCHAR || CASE WHEN status = 'P' THEN '/checkpoints/' || name || '/unet/config.json'
      WHEN stray THEN '/wandb/media/inference/' || name ELSE '/inference/' || name END AS path FROM artifacts)"""


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, path, name, mtime, length): strips, videos and checkpoint folders of each customer, a seventh of the outputs elsewhere."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    image, iteration = (key % 5), (key % 50)
    name = (
        F.when(status == "F", F.format_string("img%d_%06d_gs.png", image, iteration))
        .when(
            status == "O",
            F.format_string("img%d_%06d.%s", image, iteration, F.when(key % 2 == 0, F.lit("gif")).otherwise(F.lit("mp4"))),
        )
        .otherwise(F.format_string("%06d", iteration * 100))
    )
    named = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"),
        F.col("o_orderdate").alias("mtime"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("length"),
        name.alias("name"),
        status.alias("_s"),
        (key % 7 == 0).alias("_stray"),
    )
    tail = F.when(F.col("_s") == "P", F.concat(F.lit("/checkpoints/"), "name", F.lit("/unet/config.json")))
    tail = tail.when(F.col("_stray"), F.concat(F.lit("/wandb/media/inference/"), "name")).otherwise(
        F.concat(F.lit("/inference/"), "name")
    )
    return named.select(
        "run", F.concat(F.lit("/out/"), F.col("run").cast("string"), tail).alias("path"), "name", "mtime", "length"
    )
