"""Shards, sinks, file formats, artifact listings, lineage and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.catalog import standins as S
from viewloom.catalog.base import digest, digest_sql, query, r6, s6, table
from viewloom.operators import artifacts, hooks, points, views
from viewloom.session import scratch_path
from viewloom.sources import files, live, shards, sinks

START_SQL = "TIMESTAMP '1998-06-01 00:00:00'"


def _start():
    return F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")


# ---- shards and sinks ------------------------------------------------------


@query("SELECT o_custkey % 10 AS bucket, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders GROUP BY 1")
def read_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shard set out of a directory, with a key for every row."""
    keyed = shards.with_row_key(shards.read_shards(spark, sf_dir, "orders", exact=True))
    return keyed.groupBy((F.col("o_custkey") % 10).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(shards.KEY)).alias("n_keys")
    )


@query("SELECT url AS uid, html AS caption FROM pages")
def read_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.read_captions(spark, sf_dir, "url", "html", prefix="pages")


@query("SELECT c_name AS name, CASE WHEN c_name = max(c_name) OVER () THEN 'val' ELSE 'train' END AS split FROM customer")
def split_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    sinks.write_splits(views.holdout_last(names), path)
    return sinks.read_split(spark, path, "train").unionByName(sinks.read_split(spark, path, "val"))


@query(
    f"""SELECT 'sd15' AS model, vec_id::VARCHAR AS uid, {digest_sql("embedding")} AS tokens, 2 AS n_tokens, vec_id % 7 = 0 AS fallback FROM embeddings"""
)
def embed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "embeds")
    e = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("uid"), F.array(F.slice(e, 1, 32), F.slice(e, 33, 32)).alias("tokens"), (F.col("vec_id") % 7 == 0).alias("fallback")
    )
    sinks.write_embeds(rows, path, "sd15")
    stored = spark.read.parquet(path)
    return stored.select(
        "model", "uid", digest(F.flatten("tokens")).alias("tokens"), F.size("tokens").alias("n_tokens"), "fallback"
    )


# Logarithms may differ in the last bit, which float32 makes larger: thousandths of those.
_LOGS = {"opacity": "ln(opacity / (1 - opacity))", **{f"scale_{i}": f"ln(scale_{i} + 1e-8)" for i in range(3)}}
_LINEAR = {
    **{c: c for c in ("x", "y", "z", "rot_0", "rot_1", "rot_2", "rot_3")},
    **{f"f_dc_{i}": f"(f_dc_{i} - 0.5) / 0.28209479177387814" for i in range(3)},
}
_BYTES = {n: f"trunc(least(greatest(f_dc_{i} * 255.0, 0.0), 255.0))::INTEGER" for i, n in enumerate(("red", "green", "blue"))}


@query(
    f"""WITH {S.GAUSSIANS_SQL}
SELECT uid, gid, {", ".join(f"{s6(f'({v})::FLOAT::DOUBLE')} AS {c}" for c, v in _LINEAR.items())},
  {", ".join(f"floor(({v})::FLOAT::DOUBLE * 1e3 + 0.5) / 1e3 AS {c}" for c, v in _LOGS.items())},
  {", ".join(f"{v} AS {c}" for c, v in _BYTES.items())} FROM gaussians WHERE opacity > 0.5 AND opacity < 1"""
)
def gaussian_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "gaussians")
    inside = S.gaussians(spark, sf_dir).where("opacity < 1")
    sinks.write_gaussians(points.to_ply_cols(points.prune(inside, 0.5)), path)
    stored = spark.read.parquet(path)
    logs = [(F.floor(F.col(c).cast("double") * 1e3 + 0.5) / 1e3).alias(c) for c in _LOGS]
    return stored.select("uid", "gid", *[r6(F.col(c).cast("double")).alias(c) for c in _LINEAR], *logs, *_BYTES)


@query("SELECT c_custkey::VARCHAR AS oid, c_name || ', \"the ' || lower(c_mktsegment) || '\"' AS caption FROM customer")
def read_caption_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a headerless CSV in which every line comes twice; the second wins."""
    path = scratch_path(spark, "captions")
    customer = table(spark, sf_dir, "customer")
    final = F.concat("c_name", F.lit(', "the '), F.lower("c_mktsegment"), F.lit('"'))
    both = F.explode(F.array(F.lit("draft"), final))
    customer.select(F.col("c_custkey").cast("string"), both).write.option("escape", '"').csv(path)
    return files.read_caption_csv(spark, path)


@query("SELECT o_orderkey::VARCHAR AS gid, 'set/' || o_custkey::VARCHAR || '.glb' AS path FROM orders")
def read_json_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON objects of up to a hundred entries."""
    path = scratch_path(spark, "gid-map")
    orders = table(spark, sf_dir, "orders")
    target = F.concat(F.lit("set/"), F.col("o_custkey").cast("string"), F.lit(".glb"))
    entry = F.struct(F.col("o_orderkey").cast("string").alias("k"), target.alias("v"))
    # the order key is unique, so a group is no larger than its range
    grouped = orders.groupBy(F.floor(F.col("o_orderkey") / 100)).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    grouped.select(F.to_json("m").alias("value")).write.text(path, lineSep="\n")
    return files.read_json_map(spark, path, per_line=True)


@query("SELECT o_orderkey::VARCHAR AS gid, (row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) - 1)::INTEGER AS pos FROM orders")
def read_json_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as ordered JSON arrays of up to a hundred entries."""
    path = scratch_path(spark, "gid-list")
    orders = table(spark, sf_dir, "orders")
    sorted_keys = F.sort_array(F.collect_list("o_orderkey"))
    grouped = orders.groupBy(F.floor(F.col("o_orderkey") / 100)).agg(F.transform(sorted_keys, lambda k: k.cast("string")).alias("l"))
    grouped.select(F.to_json("l").alias("value")).write.text(path, lineSep="\n")
    return files.read_json_list(spark, path, per_line=True)


# ---- listings --------------------------------------------------------------


@query(f"WITH {S.ARTIFACTS_SQL} SELECT DISTINCT run, name AS folder, name::BIGINT AS ckpt FROM artifacts WHERE status = 'P'")
def list_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.list_checkpoints(S.artifacts(spark, sf_dir))


@query(f"WITH {S.ARTIFACTS_SQL} SELECT DISTINCT run FROM artifacts WHERE status = 'P'")
def list_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.list_experiments(S.artifacts(spark, sf_dir))


@query(f"WITH {S.ARTIFACTS_SQL} SELECT run, max(name::BIGINT) AS ckpt FROM artifacts WHERE status = 'P' GROUP BY run")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.latest_checkpoint(artifacts.list_checkpoints(S.artifacts(spark, sf_dir)))


@query(f"WITH {S.ARTIFACTS_SQL} SELECT DISTINCT run, regexp_extract(name, '_(\\d+)_gs\\.png$', 1)::INTEGER AS iter FROM artifacts WHERE status = 'F' AND NOT stray")
def inference_iters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.inference_iters(S.artifacts(spark, sf_dir))


@query(f"WITH {S.ARTIFACTS_SQL} SELECT run, max(name) AS name FROM artifacts WHERE NOT stray AND name LIKE '%\\_000012\\_gs.png' ESCAPE '\\' GROUP BY run")
def latest_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.latest_strip(S.artifacts(spark, sf_dir), 12)


@query(
    f"""WITH {S.ARTIFACTS_SQL}
SELECT c_custkey AS run FROM customer
WHERE c_custkey NOT IN (SELECT run FROM artifacts WHERE NOT stray AND name LIKE '%\\_000012\\_gs.png' ESCAPE '\\')"""
)
def without_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"))
    return artifacts.without_strip(runs, S.artifacts(spark, sf_dir), 12)


@query(
    f"""WITH {S.ARTIFACTS_SQL}
SELECT run, name, mtime FROM artifacts WHERE status IN ('F', 'O') AND NOT stray AND mtime >= {START_SQL} - INTERVAL 1 SECOND"""
)
def recent_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.recent_outputs(S.artifacts(spark, sf_dir), _start()).select("run", "name", "mtime")


@query(
    f"""WITH {S.ARTIFACTS_SQL},
f AS (SELECT run, name, mtime, status = 'F' AS image, mtime >= {START_SQL} - INTERVAL 1 SECOND AS new,
             CASE WHEN status = 'F' THEN left(name, length(name) - 7) ELSE split_part(name, '.', 1) END AS stem
      FROM artifacts WHERE status IN ('F', 'O') AND NOT stray),
r AS (SELECT *, row_number() OVER (PARTITION BY run, image, new ORDER BY mtime DESC, name DESC) AS newest,
             row_number() OVER (PARTITION BY run, image ORDER BY mtime DESC, name DESC) AS any_newest,
             row_number() OVER (PARTITION BY run, image, new, stem ORDER BY mtime DESC, name DESC) AS stem_newest FROM f),
ni AS (SELECT run, name, stem FROM r WHERE image AND new AND newest = 1),
ai AS (SELECT run, name FROM r WHERE image AND any_newest = 1),
nv AS (SELECT run, name FROM r WHERE NOT image AND new AND newest = 1),
av AS (SELECT run, name FROM r WHERE NOT image AND any_newest = 1),
ov AS (SELECT v.run, v.name FROM r v JOIN ni ON v.run = ni.run AND v.stem = ni.stem WHERE NOT v.image AND v.new AND v.stem_newest = 1)
SELECT o.run, coalesce(ni.name, ai.name) AS image, coalesce(ov.name, nv.name, av.name) AS video
FROM (SELECT DISTINCT run FROM f) o LEFT JOIN ni ON o.run = ni.run LEFT JOIN ai ON o.run = ai.run LEFT JOIN nv ON o.run = nv.run
LEFT JOIN av ON o.run = av.run LEFT JOIN ov ON o.run = ov.run"""
)
def pick_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.pick_outputs(S.artifacts(spark, sf_dir), _start())


@query(f"WITH {S.ARTIFACTS_SQL} SELECT run, {s6('sum(length) / 1048576.0')} AS size FROM artifacts GROUP BY run")
def dir_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.dir_size(S.artifacts(spark, sf_dir), "MB").withColumn("size", r6("size"))


_MODELS_SQL = """files AS (
  SELECT CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'obj' || (p_partkey % 400)::VARCHAR END AS folder,
         CASE WHEN p_partkey % 3 = 0 THEN 'obj' || (p_partkey % 600)::VARCHAR ELSE p_brand END
         || ['.blend', '.fbx', '.3ds', '.obj', '.max', '.max', '.max', '.txt'][p_size % 8 + 1] AS name FROM part),
p AS (SELECT *, list_position(['.blend', '.fbx', '.3ds', '.obj', '.max'], '.' || split_part(name, '.', -1)) AS pr FROM files),
f AS (SELECT folder AS object, name, 'folder' AS source, pr < 5 AS usable, row_number() OVER (PARTITION BY folder ORDER BY pr, name) AS rn
      FROM p WHERE pr IS NOT NULL AND folder IS NOT NULL),
g AS (SELECT split_part(name, '.', 1) AS object, name, 'flat' AS source, pr < 5 AS usable,
             row_number() OVER (PARTITION BY split_part(name, '.', 1) ORDER BY pr, name) AS rn FROM p WHERE pr IS NOT NULL AND folder IS NULL)"""


@query(
    f"""WITH {_MODELS_SQL}
SELECT object, name, source, usable FROM f WHERE rn = 1
UNION ALL SELECT object, name, source, usable FROM g WHERE rn = 1 AND object NOT IN (SELECT object FROM f WHERE rn = 1 AND usable)"""
)
def choose_model_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as model files, two thirds of them in folders."""
    key = F.col("p_partkey")
    suffixes = F.array(*[F.lit(s) for s in (".blend", ".fbx", ".3ds", ".obj", ".max", ".max", ".max", ".txt")])
    flat = key % 3 == 0
    stem = F.when(flat, F.concat(F.lit("obj"), (key % 600).cast("string"))).otherwise(F.col("p_brand"))
    listing = table(spark, sf_dir, "part").select(
        F.when(~flat, F.concat(F.lit("obj"), (key % 400).cast("string"))).alias("folder"),
        F.concat(stem, F.get(suffixes, F.col("p_size") % 8)).alias("name"),
    )
    return artifacts.choose_model_file(listing)


# Customer c is an adapter on customer c div 2 (checkpoint 1), unless c ends in 0;
# those ending in 7 point past the table, 8 and 13 point at each other.
_LINEAGE_SQL = """WITH RECURSIVE params AS (
  SELECT c_custkey AS run, c_custkey % 10 <> 0 AS is_adapter,
         CASE WHEN c_custkey = 8 THEN 13 WHEN c_custkey = 13 THEN 8 WHEN c_custkey % 10 = 7 THEN c_custkey + 1000000000
              ELSE c_custkey // 2 END AS base FROM customer),
walk AS (
  SELECT run AS origin, run, is_adapter, base, 0 AS hops FROM params
  UNION ALL SELECT w.origin, p.run, p.is_adapter, p.base, w.hops + 1 FROM walk w JOIN params p ON p.run = w.base
  WHERE w.is_adapter AND w.hops < 40),
fin AS (SELECT origin, max_by(run, hops) AS run, max_by(is_adapter, hops) AS open, max(hops) AS hops FROM walk GROUP BY origin)
SELECT origin AS run, 1 AS ckpt, CASE WHEN NOT open THEN run END AS root_run, CASE WHEN NOT open THEN 1 END AS root_ckpt,
  CASE WHEN hops = 40 THEN 'cycle' WHEN open THEN 'missing' WHEN hops = 0 THEN 'root' ELSE 'resolved' END AS status FROM fin"""


@query(_LINEAGE_SQL)
def resolve_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.col("c_custkey")
    base = (
        F.when(run == 8, F.lit(13)).when(run == 13, F.lit(8)).when(run % 10 == 7, run + 1000000000).otherwise(F.floor(run / 2))
    )
    params = table(spark, sf_dir, "customer").select(
        run.alias("run"), F.lit(1).alias("ckpt"), (run % 10 != 0).alias("is_adapter"), base.alias("base_run"), F.lit(1).alias("base_ckpt")
    )
    return artifacts.resolve_base(params)


# A customer's run: length and frequencies from its key.
_CALENDAR_SQL = """cal AS (SELECT c_custkey AS run, 4900 + c_custkey % 300 AS total, 490 AS epoch, 700 AS save, 3 AS save_epochs,
  1000 AS ev, 4 AS ev_epochs, CASE WHEN c_custkey % 2 = 0 THEN 300 END AS early, 50 AS early_freq FROM customer),
steps AS (SELECT cal.*, s.s AS step FROM cal, (SELECT unnest(range(1, 5200)) AS s) s WHERE s.s <= total),
due AS (SELECT run, step, step % save = 0 OR step % (save_epochs * epoch) = 0 OR step = total AS save,
  step = 1 OR coalesce(step % early_freq = 0 AND step < early, false) OR step % ev = 0 OR step % (ev_epochs * epoch) = 0 OR step = total AS evaluate
  FROM steps)"""


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.col("c_custkey")
    fixed = {"steps_per_epoch": 490, "save_freq": 700, "save_freq_epoch": 3, "eval_freq": 1000, "eval_freq_epoch": 4, "early_eval_freq": 50}
    return table(spark, sf_dir, "customer").select(
        run.alias("run"),
        (F.lit(4900) + run % 300).cast("bigint").alias("total_steps"),
        F.when(run % 2 == 0, F.lit(300)).cast("bigint").alias("early_eval"),
        *[F.lit(v).cast("bigint").alias(k) for k, v in fixed.items()],
    )


@query(f"WITH {_CALENDAR_SQL} SELECT run, step, save, evaluate FROM due WHERE save OR evaluate")
def expected_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.expected_steps(_calendar(spark, sf_dir))


@query(
    f"""WITH {_CALENDAR_SQL}, {S.ARTIFACTS_SQL}, there AS (SELECT DISTINCT run, name::BIGINT AS step FROM artifacts WHERE status = 'P')
SELECT coalesce(d.run, t.run) AS run, coalesce(d.step, t.step) AS step, CASE WHEN t.run IS NULL THEN 'missing' ELSE 'unexpected' END AS problem
FROM (SELECT run, step FROM due WHERE save) d FULL JOIN there t ON d.run = t.run AND d.step = t.step WHERE d.run IS NULL OR t.run IS NULL"""
)
def audit_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = artifacts.list_checkpoints(S.artifacts(spark, sf_dir))
    return artifacts.audit_checkpoints(_calendar(spark, sf_dir), found)


# ---- hooks -----------------------------------------------------------------
# User code is defined inside the queries, so it travels to the executors by value.


@query(
    f"""SELECT 'paa' AS model, p_partkey::VARCHAR AS uid, {digest_sql("tokens")} AS tokens, 120 AS mask_length, false AS fallback
FROM (SELECT p_partkey, [(('0x' || substr(md5(lower(p_name)), 2 * i + 1, 2))::INTEGER / 255.0::DOUBLE)::FLOAT FOR i IN range(16)] AS tokens FROM part)"""
)
def encode_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in text encoder: token t is byte t of the caption's md5, scaled."""

    def encoder_factory():
        import hashlib

        import numpy as np

        def encode(captions, length):
            digests = np.array([list(hashlib.md5(c.encode()).digest()) for c in captions], dtype=np.float64) / 255.0
            return digests[:, :, None], None, np.array([[float(length)]] * len(captions))

        return encode

    part = table(spark, sf_dir, "part")
    captions = part.select(F.col("p_partkey").cast("string").alias("uid"), F.initcap("p_name").alias("caption"))
    made = hooks.encode(captions, encoder_factory, "paa", batch=100)
    return made.select("model", "uid", digest(F.flatten("tokens")).alias("tokens"), F.col("attention_mask")[0].cast("int").alias("mask_length"), "fallback")


@query(
    """SELECT s_suppkey::VARCHAR AS uid, model, 77 AS n_tokens, width, pooled_size, true AS fallback
FROM supplier, (VALUES ('sd15', 768, -1), ('sdxl', 2048, 1280)) AS models(model, width, pooled_size)"""
)
def encode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An encoder that cannot be built leaves flagged zeros."""

    def encoder_factory():
        raise RuntimeError("no model")

    supplier = table(spark, sf_dir, "supplier")
    captions = supplier.select(F.col("s_suppkey").cast("string").alias("uid"), F.col("s_name").alias("caption"))
    both = (hooks.encode(captions, encoder_factory, m, on_error="zeros") for m in ("sd15", "sdxl"))
    made = next(both).union(next(both))
    pooled = F.coalesce(F.size("pooled"), F.lit(-1)).alias("pooled_size")
    return made.select("uid", "model", F.size("tokens").alias("n_tokens"), F.size(F.col("tokens")[0]).alias("width"), pooled, "fallback")


@query(f"SELECT conv_id, turn, {s6('len(string_split(text, chr(32))) / (1 + turn)::DOUBLE')} AS score FROM conversations")
def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def scorer_factory():
        def score(pairs):
            return [float(len(t.split(" "))) / (1 + c) for t, c in zip(pairs["text"], pairs["turn"])]

        return score

    pairs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return hooks.score_pairs(pairs, scorer_factory).select("conv_id", "turn", r6("score").alias("score"))


@query("SELECT doc_id, length(text) AS size FROM documents")
def transform_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measure(frame):
        return frame.assign(size=frame["text"].str.len())[["doc_id", "size"]]

    samples = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hooks.transform_samples(samples, measure, "doc_id BIGINT, size BIGINT")


#: Tasks for each core that write small files.
FILE_TASKS = 4


def _write_files(rows: DataFrame, root: str) -> None:
    """Writes ``rows`` (path below ``root``, text): one small file for each. Rows are short and files slow, so the rows
    are dealt over all cores first."""
    opened = live.opened

    def run(batches):
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                files, place = opened(f"{root}/{path}")
                files.create_dir(place.rsplit("/", 1)[0])
                with files.open_output_stream(place) as out:
                    out.write(text.encode())
        yield from ()

    tasks = FILE_TASKS * rows.sparkSession.sparkContext.defaultParallelism
    rows.select("path", "text").repartition(tasks).mapInArrow(run, "done BOOLEAN").count()


# Suppliers as objects: some views, cameras for the even ones, and a note for every seventh object.
_RENDERS_SQL = """files AS (
  SELECT 's' || s_suppkey AS uid, v::INTEGER AS view_id, 'png' AS kind, v + 1 AS length
  FROM supplier, (SELECT unnest(range(4)) AS v) WHERE v <= s_suppkey % 4
  UNION ALL SELECT 's' || s_suppkey, v::INTEGER, 'json', 2
  FROM supplier, (SELECT unnest(range(4)) AS v) WHERE v <= s_suppkey % 4 AND v % 2 = 0
  UNION ALL SELECT 's' || s_suppkey, NULL, NULL, 5 FROM supplier WHERE s_suppkey % 7 = 0)"""


def _renders(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "renders")
    key = F.col("s_suppkey")
    objects = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key).alias("uid"), key)
    views = objects.withColumn("v", F.explode(F.sequence(F.lit(0), (key % 4).cast("int"))))
    name = F.format_string("%s/%05d", "uid", "v")
    images = views.select(F.concat(name, F.lit(".png")).alias("path"), F.repeat(F.lit("x"), F.col("v") + 1).alias("text"))
    poses = views.where("v % 2 = 0").select(F.concat(name, F.lit(".json")).alias("path"), F.lit("{}").alias("text"))
    notes = objects.where(key % 7 == 0).select(F.concat("uid", F.lit("/notes.txt")).alias("path"), F.lit("notes").alias("text"))
    _write_files(images.union(poses).union(notes), root)
    return root


@query(f"WITH {_RENDERS_SQL} SELECT uid, view_id, kind, length::BIGINT AS length FROM files")
def list_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of rendered views, written and listed by name."""
    return files.read_renders(spark, _renders(spark, sf_dir)).select("uid", "view_id", "kind", "length")


@query(
    f"""WITH {_RENDERS_SQL}
SELECT uid AS run, CASE WHEN kind IS NULL THEN 'notes.txt' ELSE printf('%05d.', view_id) || kind END AS name, length::BIGINT AS length FROM files"""
)
def list_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as what runs left behind."""
    return files.read_artifacts(spark, _renders(spark, sf_dir)).select("run", "name", "length")


_IMAGE_KINDS = ("png", "jpg", "txt", "webp", "jpeg.part")


@query(
    f"""SELECT name, length FROM (
  SELECT 'img' || s_suppkey || '.' || {list(_IMAGE_KINDS)}[s_suppkey % {len(_IMAGE_KINDS)} + 1] AS name, (s_suppkey % 9 + 1)::BIGINT AS length FROM supplier)
WHERE regexp_matches(name, '[.](png|jpg|webp)$')"""
)
def list_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files of all kinds, of which the images are listed."""
    root, key = scratch_path(spark, "images"), F.col("s_suppkey")
    kind = F.get(F.array(*map(F.lit, _IMAGE_KINDS)), (key % len(_IMAGE_KINDS)).cast("int"))
    path = F.concat(F.lit("img"), key, F.lit("."), kind)
    rows = table(spark, sf_dir, "supplier").select(path.alias("path"), F.repeat(F.lit("x"), (key % 9 + 1).cast("int")).alias("text"))
    # a folder below, whose files are not listed
    _write_files(rows.union(rows.withColumn("path", F.concat(F.lit("below/"), "path"))), root)
    return files.list_images(spark, root).select(F.substring_index("path", "/", -1).alias("name"), "length")
