"""View pairing, reports, reshaping, picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.catalog import standins as S
from viewloom.catalog.base import query, table
from viewloom.operators import checks, sampling, views

RING = S.RING
MIN_VIEWS = 2
# Rings of the stand-in: views 0..3 and 4..5, every start equally likely.
RINGS = ((0, 4, 4 / 6), (4, 2, 2 / 6))

_MISSING = "SELECT uid, view_id FROM grid EXCEPT SELECT uid, view_id FROM valid"


@query(
    f"""WITH {S.FILES_SQL},
v AS (SELECT uid, count(*) AS n, string_agg(view_id::VARCHAR, ',' ORDER BY view_id) AS l FROM valid GROUP BY uid),
m AS (SELECT uid, string_agg(view_id::VARCHAR, ',' ORDER BY view_id) AS l FROM ({_MISSING}) GROUP BY uid)
SELECT o.uid, coalesce(v.n, 0)::INTEGER AS n_valid, coalesce(v.l, '') AS valid_views, coalesce(m.l, '') AS missing_views,
       coalesce(v.n, 0) >= 2 AS enough
FROM objects o LEFT JOIN v USING (uid) LEFT JOIN m USING (uid)"""
)
def view_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = views.view_report(views.view_sets(S.files(spark, sf_dir), RING), RING, MIN_VIEWS)
    return report.withColumns(
        {
            "n_valid": F.col("n_valid").cast("int"),
            "valid_views": F.array_join("valid_views", ","),
            "missing_views": F.array_join("missing_views", ","),
        }
    )


@query(f"WITH {S.FILES_SQL} {_MISSING}")
def missing_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.missing_views(views.view_sets(S.files(spark, sf_dir), RING), RING)


@query(
    f"""WITH {S.FILES_SQL}
SELECT uid, view_id, bool_or(has_png) AS has_png, bool_or(has_json) AS has_json,
       bool_or(has_png) AND bool_or(has_json) AS valid
FROM files WHERE has_png OR has_json GROUP BY uid, view_id"""
)
def pair_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pair_views(S.file_rows(spark, sf_dir))


@query(
    f"""WITH {S.FILES_SQL}, c AS (SELECT uid, count(*) AS n FROM valid GROUP BY uid)
SELECT o.uid, coalesce(c.n, 0)::INTEGER AS n_valid FROM objects o LEFT JOIN c USING (uid) WHERE coalesce(c.n, 0) < 2"""
)
def too_few_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    failing = checks.too_few_views(views.view_sets(S.files(spark, sf_dir), RING), RING, MIN_VIEWS)
    return failing.select("uid", F.col("n_valid").cast("int").alias("n_valid"))


# Image and camera stand for their files: part and supplier of the smallest line.
_BLOBS_SQL = f"""{S.FILES_SQL},
blobs AS (
  SELECT l_orderkey AS uid, l_linenumber - 1 AS view_id,
         min(CASE WHEN l_returnflag <> 'R' THEN 'png' || l_partkey::VARCHAR END) AS png,
         min(CASE WHEN l_linestatus = 'F' THEN 'cam' || l_suppkey::VARCHAR END) AS camera_json
  FROM lineitem GROUP BY 1, 2)"""


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    png = F.when(F.col("l_returnflag") != "R", F.concat(F.lit("png"), F.col("l_partkey").cast("string")))
    cam = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("cam"), F.col("l_suppkey").cast("string")))
    return lines.groupBy(F.col("l_orderkey").alias("uid"), (F.col("l_linenumber") - 1).alias("view_id")).agg(
        F.min(png).alias("png"), F.min(cam).alias("camera_json")
    )


def _wide_columns() -> str:
    cells = []
    for i in range(RING):
        for column, suffix in (("png", "png"), ("camera_json", "json")):
            cells.append(
                f'max(CASE WHEN view_id = {i} AND png IS NOT NULL AND camera_json IS NOT NULL THEN {column} END)'
                f' AS "{i:05d}.{suffix}"'
            )
    return ", ".join(cells)


@query(f"WITH {_BLOBS_SQL} SELECT uid, {_wide_columns()} FROM blobs GROUP BY uid")
def views_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.views_wide(_blobs(spark, sf_dir), RING)


@query(
    f"""WITH {_BLOBS_SQL}
SELECT uid, view_id, png, camera_json FROM blobs WHERE png IS NOT NULL AND camera_json IS NOT NULL"""
)
def views_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide and back to long: the round trip keeps exactly the whole pairs."""
    return views.views_long(views.views_wide(_blobs(spark, sf_dir), RING))


# Three more files of a view, each missing for some views.
_MORE = {"albedo": "(uid + view_id) % 11", "mr": "(uid + view_id) % 13", "nd": "(uid * 3 + view_id) % 17"}
_GONE = {"png": "png IS NULL", "camera_json": "camera_json IS NULL", **{c: f"{v} = 0" for c, v in _MORE.items()}}


@query(
    f"""WITH {_BLOBS_SQL}
SELECT uid, view_id, concat_ws(',', {", ".join(f"CASE WHEN {v} THEN '{c}' END" for c, v in _GONE.items())}) AS missing
FROM blobs WHERE {" OR ".join(_GONE.values())}"""
)
def broken_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = _blobs(spark, sf_dir).withColumns({c: F.expr(f"CASE WHEN {v} <> 0 THEN encode('x', 'UTF-8') END") for c, v in _MORE.items()})
    return checks.broken_assets(blobs, tuple(_GONE)).withColumn("missing", F.array_join("missing", ","))


@query(f"WITH {S.FILES_SQL} SELECT uid, view_id FROM valid WHERE view_id NOT IN (2, 5)")
def except_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = views.present_views(views.view_sets(S.files(spark, sf_dir), RING), RING)
    return views.except_views(present, (2, 5))


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part),
s AS (SELECT name, CASE WHEN name = max(name) OVER () THEN 'val' ELSE 'train' END AS split FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY name) - 1 AS i FROM s)
SELECT name, split, printf('chibi_%s_%03d', split, i) AS uid, 'a 3D character named ' || replace(name, '_', ' ') AS caption
FROM r"""
)
def holdout_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object names split, numbered and captioned."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return views.number_uids(views.holdout_last(names), "chibi")


@query(
    """WITH s AS (SELECT CASE WHEN c_name = max(c_name) OVER () THEN 'val' ELSE 'train' END AS split FROM customer)
SELECT split, count(*) AS n FROM s GROUP BY split"""
)
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    return views.split_counts(views.holdout_last(names))


@query(
    f"""WITH {S.FILES_SQL},
f AS (SELECT uid FROM (SELECT DISTINCT uid FROM valid) ORDER BY uid LIMIT 4),
r AS (SELECT uid, view_id, (row_number() OVER (PARTITION BY uid ORDER BY view_id) - 1)::INTEGER AS slot FROM valid)
SELECT uid, view_id, slot FROM r WHERE uid IN (SELECT uid FROM f) AND slot < 3"""
)
def preview_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = views.present_views(views.view_sets(S.files(spark, sf_dir), RING), RING)
    return views.preview(present, 4, 3).select("uid", "view_id", "slot")


_UNIT = "('0x' || substr(md5({0}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"


@query(
    f"""WITH {S.FILES_SQL},
d AS (SELECT uid, {_UNIT.format("concat_ws(':', '3', uid, 'ring')")} AS u,
             {_UNIT.format("concat_ws(':', '3', uid, 'start')")} AS s FROM objects),
st AS (SELECT uid, u < 4.0 / 6.0 AS wide, CASE WHEN u < 4.0 / 6.0 THEN floor(s * 4) ELSE floor(s * 2) END::INTEGER AS a FROM d)
SELECT uid, k.k::INTEGER AS slot, (CASE WHEN wide THEN (a + 2 * k.k) % 4 ELSE (a + k.k) % 2 + 4 END)::INTEGER AS view_id
FROM st, (SELECT unnest(range(2)) AS k) k"""
)
def pick_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = S.files(spark, sf_dir).select("uid").distinct()
    return sampling.pick_rows(sampling.pick_even(objects, 2, 3, RINGS))


@query(
    f"""WITH {S.FILES_SQL},
r AS (SELECT uid, view_id, row_number() OVER (PARTITION BY uid ORDER BY md5(concat_ws(':', '5', uid, 'view', view_id))) - 1 AS slot
      FROM grid WHERE view_id <> 5)
SELECT uid, slot::INTEGER AS slot, view_id FROM r WHERE slot < 3"""
)
def pick_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = S.files(spark, sf_dir).select("uid").distinct()
    return sampling.pick_rows(sampling.pick_random(objects, 3, 5, RING, exclude=(5,)))


# Candidate starts of the two rings and the views each needs.
_EXISTING_SQL = f"""{S.FILES_SQL},
cand AS (SELECT * FROM (VALUES (0, 0, 2), (1, 1, 3), (2, 2, 0), (3, 3, 1), (4, 4, 5), (5, 5, 4)) AS t(c, v0, v1)),
ok AS (SELECT o.uid, c.c, c.v0, c.v1, row_number() OVER (PARTITION BY o.uid ORDER BY md5(concat_ws(':', '7', o.uid, c.v0))) AS rn
       FROM objects o, cand c
       WHERE EXISTS (SELECT 1 FROM valid v WHERE v.uid = o.uid AND v.view_id = c.v0)
         AND EXISTS (SELECT 1 FROM valid v WHERE v.uid = o.uid AND v.view_id = c.v1)),
picked AS (SELECT uid, v0, v1 FROM ok WHERE rn = 1)"""


@query(
    f"""WITH {_EXISTING_SQL}
SELECT o.uid, p.v0 AS first_view, p.v1 AS second_view, p.v0 IS NULL AS failed FROM objects o LEFT JOIN picked p USING (uid)"""
)
def pick_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = sampling.pick_existing(views.view_sets(S.files(spark, sf_dir), RING), 2, 7, RINGS)
    return picked.select(
        "uid",
        F.get("picks", F.lit(0)).alias("first_view"),
        F.get("picks", F.lit(1)).alias("second_view"),
        F.col("picks").isNull().alias("failed"),
    )


@query(
    f"""WITH {_EXISTING_SQL},
rest AS (SELECT v.uid, v.view_id,
           row_number() OVER (PARTITION BY v.uid ORDER BY md5(concat_ws(':', '9', v.uid, 'fill', v.view_id))) + 1 AS slot
         FROM valid v JOIN picked p USING (uid) WHERE v.view_id NOT IN (p.v0, p.v1) AND v.view_id NOT IN (3, 6)),
lst AS (SELECT uid, 0 AS slot, v0 AS view_id FROM picked UNION ALL SELECT uid, 1, v1 FROM picked
        UNION ALL SELECT uid, slot, view_id FROM rest WHERE slot < 4),
cnt AS (SELECT uid, count(*) AS n FROM lst GROUP BY uid)
SELECT c.uid, k.k::INTEGER AS slot, l.view_id::INTEGER AS view_id
FROM cnt c, (SELECT unnest(range(4)) AS k) k, lst l WHERE l.uid = c.uid AND l.slot = k.k % c.n"""
)
def fill_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = sampling.pick_existing(views.view_sets(S.files(spark, sf_dir), RING), 2, 7, RINGS)
    return sampling.fill_views(picked, 4, 9, RING, exclude=(3, 6))


@query(
    f"""WITH {S.FILES_SQL},
r AS (SELECT uid, k.k AS slot, row_number() OVER (PARTITION BY uid ORDER BY md5(concat_ws(':', '11', uid, 'cond', k.k))) AS cond
      FROM objects, (SELECT unnest(range(1, 4)) AS k) k)
SELECT uid, 0 AS cond, 0 AS slot FROM objects
UNION ALL SELECT uid, cond::INTEGER, slot::INTEGER FROM r WHERE cond < 3"""
)
def cond_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = S.files(spark, sf_dir).select("uid").distinct()
    return sampling.cond_views(objects, 4, 3, 11)


# ---- more views than fit one word ------------------------------------------
# Customers as objects of 72 views; an order is a view, and a third of them lack the camera.

LARGE_RING = 72

_LARGE_SQL = """objects AS (SELECT DISTINCT o_custkey AS uid FROM orders),
valid AS (SELECT DISTINCT o_custkey AS uid, (o_orderkey % 72)::INTEGER AS view_id FROM orders WHERE o_orderkey % 3 <> 0),
grid AS (SELECT uid, v::INTEGER AS view_id FROM objects, range(72) AS r(v))"""


def _large(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("uid"), (key % LARGE_RING).cast("int").alias("view_id"), F.lit(True).alias("has_png"), (key % 3 != 0).alias("has_json")
    )
    return views.view_sets(files, LARGE_RING)


@query(
    f"""WITH {_LARGE_SQL},
v AS (SELECT uid, count(*) AS n, string_agg(view_id::VARCHAR, ',' ORDER BY view_id) AS l FROM valid GROUP BY uid),
m AS (SELECT uid, string_agg(view_id::VARCHAR, ',' ORDER BY view_id) AS l FROM ({_MISSING}) GROUP BY uid)
SELECT o.uid, coalesce(v.n, 0)::INTEGER AS n_valid, coalesce(v.l, '') AS valid_views, coalesce(m.l, '') AS missing_views,
       coalesce(v.n, 0) >= 4 AS enough
FROM objects o LEFT JOIN v USING (uid) LEFT JOIN m USING (uid)"""
)
def large_ring_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = views.view_report(_large(spark, sf_dir), LARGE_RING, 4)
    return report.withColumns(
        {
            "n_valid": F.col("n_valid").cast("int"),
            "valid_views": F.array_join("valid_views", ","),
            "missing_views": F.array_join("missing_views", ","),
        }
    )


@query(f"WITH {_LARGE_SQL} {_MISSING}")
def large_ring_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.missing_views(_large(spark, sf_dir), LARGE_RING)


@query(
    f"""WITH {_LARGE_SQL}, c AS (SELECT uid, count(*) AS n FROM valid GROUP BY uid)
SELECT o.uid, coalesce(c.n, 0)::INTEGER AS n_valid FROM objects o LEFT JOIN c USING (uid) WHERE coalesce(c.n, 0) < 4"""
)
def large_ring_too_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    failing = checks.too_few_views(_large(spark, sf_dir), LARGE_RING, 4)
    return failing.select("uid", F.col("n_valid").cast("int").alias("n_valid"))


@query(
    f"""WITH {_LARGE_SQL},
ok AS (SELECT a.uid, a.view_id AS v0, b.view_id AS v1,
         row_number() OVER (PARTITION BY a.uid ORDER BY md5(concat_ws(':', '7', a.uid, a.view_id))) AS rn
       FROM valid a JOIN valid b ON a.uid = b.uid AND b.view_id = (a.view_id + 36) % 72),
picked AS (SELECT uid, v0, v1 FROM ok WHERE rn = 1),
rest AS (SELECT v.uid, v.view_id,
           row_number() OVER (PARTITION BY v.uid ORDER BY md5(concat_ws(':', '9', v.uid, 'fill', v.view_id))) + 1 AS slot
         FROM valid v JOIN picked p USING (uid) WHERE v.view_id NOT IN (p.v0, p.v1) AND v.view_id NOT IN (3, 66)),
lst AS (SELECT uid, 0 AS slot, v0 AS view_id FROM picked UNION ALL SELECT uid, 1, v1 FROM picked
        UNION ALL SELECT uid, slot, view_id FROM rest WHERE slot < 6),
cnt AS (SELECT uid, count(*) AS n FROM lst GROUP BY uid)
SELECT c.uid, k.k::INTEGER AS slot, l.view_id::INTEGER AS view_id
FROM cnt c, (SELECT unnest(range(6)) AS k) k, lst l WHERE l.uid = c.uid AND l.slot = k.k % c.n"""
)
def large_ring_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two opposite views that exist, then others."""
    picked = sampling.pick_existing(_large(spark, sf_dir), 2, 7, ((0, LARGE_RING, 1.0),))
    return sampling.fill_views(picked, 6, 9, LARGE_RING, exclude=(3, 66))
