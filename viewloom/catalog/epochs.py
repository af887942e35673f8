"""Shards, batches, epochs, chunks, manifests, dropout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.catalog import standins as S
from viewloom.catalog.base import query, r6, s6, table
from viewloom.operators import cameras, embeds, epochs, metrics


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"))


@query(
    """WITH r AS (SELECT o_orderkey AS uid, row_number() OVER (ORDER BY md5(concat_ws(':', '4', o_orderkey)), o_orderkey) - 1 AS pos FROM orders)
SELECT uid, pos, pos % 4 AS shard FROM r"""
)
def assign_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs.assign_shards(_objects(spark, sf_dir), 4, seed=3, epoch=1, key="uid")


@query(
    """WITH s AS (SELECT o_orderkey AS uid, o_custkey % 3 AS shard FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY uid) - 1 AS p FROM s),
b AS (SELECT *, p // 100 AS b FROM p)
SELECT uid, shard, b * 100 + row_number() OVER (PARTITION BY shard, b ORDER BY md5(concat_ws(':', '3', 2, uid)), uid) - 1 AS pos FROM b"""
)
def shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("uid"), (F.col("o_custkey") % 3).alias("shard")
    )
    return epochs.shuffle_rows(sharded, seed=3, epoch=2, block=100)


@query(
    """WITH r AS (SELECT o_orderkey AS uid, row_number() OVER (ORDER BY md5(concat_ws(':', '4', o_orderkey)), o_orderkey) - 1 AS pos,
              count(*) OVER () AS n FROM orders)
SELECT uid, pos, (pos // 64)::BIGINT AS batch FROM r WHERE (pos // 64 + 1) * 64 <= n"""
)
def assign_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = epochs.assign_shards(_objects(spark, sf_dir), 1, seed=4, epoch=0, key="uid").drop("shard")
    return epochs.assign_batches(placed, 64)


@query(
    """WITH e AS (SELECT o_orderkey AS uid, e.e AS epoch FROM orders, (SELECT unnest(range(3)) AS e) e),
r AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY md5(concat_ws(':', epoch + 42, uid)), uid) - 1 AS p FROM e),
s AS (SELECT *, p % 8 AS shard, p // 8 AS q, count(*) OVER (PARTITION BY epoch, p % 8) AS n FROM r)
SELECT epoch::INTEGER AS epoch, shard, q // 16 AS batch, q % 16 AS place, uid FROM s WHERE (q // 16 + 1) * 16 <= n"""
)
def epoch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs.epoch_plan(_objects(spark, sf_dir), 3, 8, 16, 42)


@query("SELECT c_name AS uid, ntile(7) OVER (ORDER BY c_name) - 1 AS worker FROM customer")
def split_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("uid"))
    return epochs.split_even(names, 7)


@query(
    """WITH r AS (SELECT c_name AS uid, row_number() OVER (ORDER BY c_name) - 1 AS p FROM customer)
SELECT uid, p // 128 AS batch, p % 128 AS place FROM r"""
)
def encode_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("uid"))
    return epochs.encode_batches(names, 128)


@query(
    """SELECT page_id, n_name AS prompt, g.g AS guidance_scale, k.k::INTEGER AS slot
FROM pages, nation, (SELECT unnest([1.0::DOUBLE, 7.5::DOUBLE]) AS g) g, (SELECT unnest(range(2)) AS k) k"""
)
def request_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as condition images, nation names as the prompt suite."""
    images = table(spark, sf_dir, "pages").select("page_id")
    prompts = table(spark, sf_dir, "nation").select(F.col("n_name").alias("prompt"))
    return epochs.request_manifest(images, prompts, scales=(7.5, 1.0), slots=2)


@query(
    """WITH d AS (SELECT o_orderkey AS uid,
  ('0x' || substr(md5(concat_ws(':', '1', 2, o_orderkey)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM orders)
SELECT uid, u < 0.2 AS drop_text, u >= 0.1 AND u < 0.1 * 3 AS drop_image FROM d"""
)
def condition_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeds.condition_dropout(_objects(spark, sf_dir), 0.1, seed=1, epoch=2)


@query(
    f"""WITH {S.CAMERAS_SQL}
SELECT uid, view_id, floor((ele + 40.0) / 2.0)::BIGINT AS elev_class, {s6("ele - (-40.0 + floor((ele + 40.0) / 2.0) * 2.0)")} AS elev_offset,
       floor((ele + 40.0) / 2.0) >= 0 AND floor((ele + 40.0) / 2.0) < 25 AS elev_valid
FROM cameras"""
)
def elev_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = cameras.elev_bins(S.angles(spark, sf_dir))
    return binned.select("uid", "view_id", "elev_class", r6("elev_offset").alias("elev_offset"), "elev_valid")


@query(
    f"""WITH {S.CAMERAS_SQL}
SELECT view_id, {s6("avg(abs(ele - (-40.0 + floor((ele + 40.0) / 2.0) * 2.0)))")} AS err_degree FROM cameras GROUP BY view_id"""
)
def elev_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower bound of the elevation class as the prediction."""
    binned = cameras.elev_bins(S.angles(spark, sf_dir))
    pairs = binned.select("view_id", (F.col("ele") - F.col("elev_offset")).alias("pred"), F.col("ele").alias("truth"))
    return metrics.elev_mae(pairs, ["view_id"]).withColumn("err_degree", r6("err_degree"))


_SCORES_SQL = """scores AS (
  SELECT user_id AS run, event_type AS metric, (event_id % 3 * 3 + 1)::DOUBLE AS cfg, event_id // 50 AS batch_id,
         value, event_id % 8 + 1 AS batch_size FROM events)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_type").alias("metric"),
        (event % 3 * 3 + 1).cast("double").alias("cfg"),
        F.floor(event / 50).alias("batch_id"),
        "value",
        (event % 8 + 1).alias("batch_size"),
    )


@query(
    f"""WITH {_SCORES_SQL}
SELECT CASE WHEN cfg = 1.0 THEN 'validation_cfg1.0/' ELSE 'validation/' END || metric || '_cfg' || printf('%.1f', cfg) AS name,
       {s6("avg(value)")} AS value
FROM scores GROUP BY metric, cfg"""
)
def val_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.val_rollup(_scores(spark, sf_dir)).withColumn("value", r6("value"))


@query(f"WITH {_SCORES_SQL} SELECT run, metric, {s6('sum(value * batch_size) / sum(batch_size)')} AS value FROM scores GROUP BY run, metric")
def rank_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rank_mean(_scores(spark, sf_dir), ["run", "metric"]).withColumn("value", r6("value"))
