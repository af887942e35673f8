"""Caption resolution and text expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.catalog.base import digest, digest_sql, query, r6, s6, table
from viewloom.functions import text as T
from viewloom.operators import captions
from viewloom.plans import prompts
from viewloom.session import scratch_path
from viewloom.sources import files

# The stripped characters as SQL.
_WS = " || ".join(f"chr({ord(c)})" for c in T.WHITESPACE)


def _gid_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order = gid, customer = oid inside a path; every seventh order is not mapped."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 7 != 0)
    path = F.concat(F.lit("set/"), F.col("o_custkey").cast("string"), F.lit(".x.glb"))
    return orders.select(F.col("o_orderkey").cast("string").alias("gid"), path.alias("path"))


def _subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    return finished.select(F.col("o_orderkey").cast("string").alias("gid"))


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
    return known.select(F.col("c_custkey").cast("string").alias("oid"), F.col("c_name").alias("caption"))


_OIDS = """oids AS (SELECT o_orderkey::VARCHAR AS gid, o_custkey::VARCHAR AS oid FROM orders
  WHERE o_orderstatus = 'F' AND o_orderkey % 7 <> 0)"""


@query(f"WITH {_OIDS} SELECT * FROM oids")
def resolve_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.resolve_subset(_subset(spark, sf_dir), _gid_map(spark, sf_dir))


@query("SELECT o_orderkey::VARCHAR AS gid FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 = 0")
def unresolved_gids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.unresolved_gids(_subset(spark, sf_dir), _gid_map(spark, sf_dir))


@query(
    f"""WITH {_OIDS}
SELECT gid, oid, c_name AS caption FROM oids JOIN customer ON c_custkey::VARCHAR = oid WHERE c_acctbal >= 0"""
)
def attach_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    oids = captions.resolve_subset(_subset(spark, sf_dir), _gid_map(spark, sf_dir))
    return captions.attach_captions(oids, _captions(spark, sf_dir))


@query(f"WITH {_OIDS} SELECT DISTINCT oid FROM oids JOIN customer ON c_custkey::VARCHAR = oid WHERE c_acctbal < 0")
def missing_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    oids = captions.resolve_subset(_subset(spark, sf_dir), _gid_map(spark, sf_dir))
    return captions.missing_captions(oids, _captions(spark, sf_dir))


@query("SELECT page_id, split_part(split_part(url, '/', -1), '.', 1) AS uid, nullif(split_part(split_part(url, '/', 2), '.', 1), '') AS host FROM pages")
def path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid and second-part id of path-like strings."""
    pages = table(spark, sf_dir, "pages")
    second = T.oid_of(F.col("url"))
    return pages.select("page_id", T.norm_uid(F.col("url")).alias("uid"), F.when(second != "", second).alias("host"))


@query(
    """WITH n AS (SELECT split_part(split_part(url, '/', -1), '.', 1) AS uid, url FROM pages)
SELECT uid, min(url) AS first_raw, max(url) AS last_raw, count(*) AS n_rows FROM n GROUP BY uid HAVING min(url) <> max(url)"""
)
def uid_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captions.uid_collisions(table(spark, sf_dir, "pages"), "url")


@query(
    f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ' ' || chr(12288) || text || chr(10)
                          WHEN turn % 3 = 1 AND conv_id % 2 = 0 THEN chr(160) || chr(9) ELSE text END AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN trim(t, {_WS}) = '' THEN '3d object' ELSE trim(t, {_WS}) END AS caption,
       trim(lower(t), {_WS}) AS lowered FROM t"""
)
def clean_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded and blank texts as captions, plain and for lower-casing models."""
    turn = F.col("turn")
    padded = (
        F.when(turn % 3 == 0, F.concat(F.lit(" 　"), "text", F.lit("\n")))
        .when((turn % 3 == 1) & (F.col("conv_id") % 2 == 0), F.lit("\xa0\t"))
        .otherwise(F.col("text"))
    )
    talks = table(spark, sf_dir, "conversations").withColumn("t", padded)
    return talks.select(
        "conv_id", "turn", T.clean_caption(F.col("t")).alias("caption"), T.model_caption(F.col("t"), "pas").alias("lowered")
    )


@query(
    """SELECT p_partkey, 'a 3D character named ' || replace(replace(p_name, ' ', '_'), '_', ' ') AS caption,
  replace(p_name || '_' || p_type, '_', ' ') AS prompt,
  '[' || p_brand || ']_[' || substr(p_name || ' ' || p_type || ' ' || p_brand, 1, 20) || '...]_' || printf('%06d', p_partkey * 997) AS by_prompt,
  printf('%03d_%03d_%06d', p_partkey, p_size, p_partkey * 997) AS by_id FROM part"""
)
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    number = F.col("p_partkey") * 997
    return part.select(
        "p_partkey",
        T.name_caption(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("caption"),
        T.arg_prompt(F.concat_ws("_", "p_name", "p_type")).alias("prompt"),
        T.prompt_output_name(F.col("p_brand"), words, number).alias("by_prompt"),
        T.id_output_name(F.col("p_partkey"), F.col("p_size"), number).alias("by_id"),
    )


@query(
    f"""WITH s AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS p FROM s)
SELECT doc_id, line_no::INTEGER AS line_no, trim(p, {_WS}) AS prompt FROM l WHERE trim(p, {_WS}) <> ''"""
)
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompt files: one stripped, non-blank line per prompt."""
    return files.split_prompts(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(
    f"""WITH d AS (SELECT regexp_replace(doc_id::VARCHAR || '/' || source || '.' || lang, '^', 'root/') AS uid, text FROM documents)
SELECT split_part(split_part(uid, '/', -1), '.', 1) AS uid,
       CASE WHEN trim(text, {_WS}) = '' THEN '3d object' ELSE trim(text, {_WS}) END AS caption FROM d"""
)
def caption_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample shards with path-like ids to (uid, caption)."""
    path = F.concat(F.lit("root/"), F.col("doc_id").cast("string"), F.lit("/"), "source", F.lit("."), "lang")
    samples = table(spark, sf_dir, "documents").select(path.alias("uid"), F.col("text").alias("caption"))
    return captions.caption_pairs(samples)


_BYTES_SQL = "[(('0x' || substr(md5({0}), 2 * i + 1, 2))::INTEGER / 255.0::DOUBLE)::FLOAT FOR i IN range(16)]"


@query(
    f"""WITH pairs AS (SELECT s_suppkey::VARCHAR AS oid, lower(s_name) AS caption FROM supplier),
paa AS (SELECT 'paa' AS model, oid AS uid, 16 AS n_tokens, {_BYTES_SQL.format("caption")} AS tokens FROM pairs
        UNION ALL SELECT 'paa', 'null', 16, {_BYTES_SQL.format("''")}),
made AS (SELECT model, uid, n_tokens, {digest_sql("tokens")} AS tokens, {s6("list_min(tokens)::DOUBLE")} AS low, {s6("list_max(tokens)::DOUBLE")} AS high FROM paa)
SELECT *, false AS fallback FROM made
UNION ALL SELECT 'sd15', oid, 77, NULL, 0.0, 0.0, true FROM pairs UNION ALL SELECT 'sd15', 'null', 77, NULL, 0.0, 0.0, false"""
)
def embed_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From id list, map and captions to stored embeddings: one encoder works and encodes the empty prompt, one
    cannot be built, and its empty prompt is zeros."""

    def working():
        import hashlib

        import numpy as np

        def encode(texts, length):
            rows = np.array([list(hashlib.md5(t.encode()).digest()) for t in texts], dtype=np.float64) / 255.0
            return rows[:, :, None], None, np.full((len(texts), 1), float(length))

        return encode

    def broken():
        raise RuntimeError("no model")

    path = scratch_path(spark, "prompts")
    key = F.col("s_suppkey").cast("string")
    supplier = table(spark, sf_dir, "supplier")
    gidmap = supplier.select(F.concat(F.lit("g"), key).alias("gid"), F.concat(F.lit("set/"), key, F.lit(".x.glb")).alias("path"))
    pairs = prompts.resolve_captions(gidmap.select("gid"), gidmap, supplier.select(key.alias("oid"), F.col("s_name").alias("caption")))
    prompts.embed_captions(pairs, working, "paa", path)
    prompts.embed_captions(pairs, broken, "sd15", path, zero_null=True, on_error="zeros")
    stored = spark.read.parquet(path)
    numbers = F.flatten("tokens")
    return stored.select(
        "model",
        "uid",
        F.size("tokens").alias("n_tokens"),
        F.when(F.col("model") == "paa", digest(numbers)).alias("tokens"),
        r6(F.array_min(numbers).cast("double")).alias("low"),
        r6(F.array_max(numbers).cast("double")).alias("high"),
        "fallback",
    )
