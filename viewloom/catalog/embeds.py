"""Prompt embeddings, similarity and retrieval scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.catalog import standins as S
from viewloom.catalog.base import digest, digest_sql, query, r6, s6, table
from viewloom.operators import embeds, metrics, retrieval


def _store(spark: SparkSession, sf_dir: str, model: str = "sdxl") -> DataFrame:
    """Vectors as embeddings of a model: two tokens of 32 numbers, the vector as pooled, its first 8 numbers as
    attention mask, where the model has those; vector 0 is the empty prompt."""
    e = F.col("embedding")
    uid = F.when(F.col("vec_id") == 0, F.lit(embeds.NULL_UID)).otherwise(F.col("vec_id").cast("string"))
    parts = {"tokens": F.array(F.slice(e, 1, 32), F.slice(e, 33, 32)), "pooled": e, "attention_mask": F.slice(e, 1, 8)}
    return table(spark, sf_dir, "embeddings").select(
        F.lit(model).alias("model"), uid.alias("uid"), *[parts[c].alias(c) for c in embeds.model_columns(model)]
    )


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.concat(F.lit("obj/"), F.col("p_partkey").cast("string"), F.lit(".glb")).alias("uid"), F.col("p_name").alias("caption")
    )


@query(
    f"""SELECT 'obj/' || p_partkey::VARCHAR || '.glb' AS uid, p_name AS caption, 2 AS n_tokens, {digest_sql("embedding")} AS tokens,
  {digest_sql("embedding")} AS pooled FROM part JOIN embeddings ON vec_id = p_partkey WHERE vec_id <> 0"""
)
def attach_embeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = embeds.attach_embeds(_samples(spark, sf_dir), _store(spark, sf_dir), "sdxl")
    return joined.select(
        "uid", "caption", F.size("tokens").alias("n_tokens"), digest(F.flatten("tokens")).alias("tokens"), digest(F.col("pooled")).alias("pooled")
    )


@query(
    """SELECT 'obj/' || p_partkey::VARCHAR || '.glb' AS uid FROM part
WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings WHERE vec_id <> 0)"""
)
def missing_embeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeds.missing_embeds(_samples(spark, sf_dir), _store(spark, sf_dir), "sdxl")


_DROP_SQL = f"""u AS (SELECT p_partkey, 'obj/' || p_partkey::VARCHAR || '.glb' AS uid FROM part),
j AS (SELECT uid, ('0x' || substr(md5('5:0:' || uid), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < 0.4 AS drop_text, embedding AS e,
  (SELECT embedding FROM embeddings WHERE vec_id = 0) AS n FROM u JOIN embeddings ON vec_id = p_partkey WHERE vec_id <> 0),
own AS (SELECT uid, drop_text, CASE WHEN drop_text THEN n ELSE e END AS e FROM j),
sums AS (SELECT uid, drop_text, {digest_sql("e")} AS whole, {digest_sql("e[:8]")} AS mask FROM own)"""


@query(
    f"""WITH {_DROP_SQL}
SELECT 'sdxl' AS model, uid, drop_text, CASE WHEN drop_text THEN 0 ELSE whole END AS tokens, CASE WHEN drop_text THEN 0 ELSE whole END AS pooled,
  NULL::BIGINT AS attention_mask FROM sums
UNION ALL SELECT 'sd3m', uid, drop_text, whole, whole, NULL FROM sums
UNION ALL SELECT 'pas', uid, drop_text, whole, NULL, mask FROM sums"""
)
def apply_text_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped samples carry all of the empty-prompt embedding; one model replaces that by zeros."""

    def dropped(model: str) -> DataFrame:
        store = _store(spark, sf_dir, model)
        joined = embeds.attach_embeds(_samples(spark, sf_dir), store, model)
        drawn = embeds.condition_dropout(embeds.attach_null(joined, store, model), 0.2, seed=5, epoch=0)
        swapped = embeds.apply_text_drop(drawn, model)
        none = F.lit(None).cast("bigint")
        sums = {"tokens": digest(F.flatten("tokens"))}
        sums |= {c: digest(F.col(c)) if c in embeds.model_columns(model) else none for c in ("pooled", "attention_mask")}
        return swapped.select(F.lit(model).alias("model"), "uid", "drop_text", *[c.alias(n) for n, c in sums.items()])

    return dropped("sdxl").union(dropped("sd3m")).union(dropped("pas"))


_PAIRS_SQL = """norms AS (SELECT vec_id // 2 AS idx, vec_id % 2 AS side, (vec_id // 2) % 4 AS grp,
  list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings),
unit AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM norms),
img AS (SELECT * FROM unit WHERE side = 0), txt AS (SELECT * FROM unit WHERE side = 1)"""


def _side(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """Even vectors are images, odd ones texts; four evaluation groups."""
    pair = F.floor(F.col("vec_id") / 2)
    return (
        table(spark, sf_dir, "embeddings")
        .where(F.col("vec_id") % 2 == side)
        .select((pair % 4).alias("grp"), pair.alias("idx"), F.col("embedding").alias("vec"))
    )


@query(
    f"""WITH {_PAIRS_SQL}
SELECT grp, {s6("avg(list_inner_product(i.e, t.e) / (i.n * t.n))")} AS clip_sim FROM img i JOIN txt t USING (grp, idx) GROUP BY grp"""
)
def clip_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.clip_sim(_side(spark, sf_dir, 0), _side(spark, sf_dir, 1))
    return scores.withColumn("clip_sim", r6("clip_sim"))


_BEST_SQL = f"""{_PAIRS_SQL},
s AS (SELECT i.grp, i.idx, t.idx AS j, list_inner_product(i.e, t.e) / (i.n * t.n) AS score FROM img i JOIN txt t USING (grp)),
b AS (SELECT *, row_number() OVER (PARTITION BY grp, idx ORDER BY score DESC, j) AS rn FROM s)"""


@query(f"WITH {_BEST_SQL} SELECT grp, idx, j AS best_idx, {s6('score')} AS best FROM b WHERE rn = 1")
def best_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # small blocks, so that every group is cut
    found = metrics.best_texts(_side(spark, sf_dir, 0), _side(spark, sf_dir, 1), block=64)
    return found.withColumn("best", r6("best"))


@query(f"WITH {_BEST_SQL} SELECT grp, idx, j AS best_idx, {s6('score')} AS best FROM b WHERE rn = 1")
def nearest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by anchors: only cells that may hold a better text are opened."""
    found = retrieval.nearest_texts(_side(spark, sf_dir, 0), _side(spark, sf_dir, 1), anchors=16, block=64)
    return found.select("grp", "idx", "best_idx", r6("best").alias("best"))


@query(f"WITH {_BEST_SQL} SELECT grp, {s6('avg((j = idx)::INTEGER::DOUBLE)')} AS r_precision FROM b WHERE rn = 1 GROUP BY grp")
def r_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.r_precision(_side(spark, sf_dir, 0), _side(spark, sf_dir, 1))
    return scores.withColumn("r_precision", r6("r_precision"))


@query(
    f"""WITH {_BEST_SQL},
c AS (SELECT grp, avg(list_inner_product(i.e, t.e) / (i.n * t.n)) AS sim FROM img i JOIN txt t USING (grp, idx) GROUP BY grp),
r AS (SELECT grp, avg((j = idx)::INTEGER::DOUBLE) AS rp FROM b WHERE rn = 1 GROUP BY grp)
SELECT {s6("avg(sim)")} AS clip_sim_mean, {s6("stddev_pop(sim)")} AS clip_sim_std,
       {s6("avg(rp)")} AS r_precision_mean, {s6("stddev_pop(rp)")} AS r_precision_std FROM c JOIN r USING (grp)"""
)
def view_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of both retrieval scores over the groups, as over view slots."""
    images, texts = _side(spark, sf_dir, 0), _side(spark, sf_dir, 1)
    scores = metrics.clip_sim(images, texts).join(metrics.r_precision(images, texts), "grp")
    summary = metrics.view_summary(scores, ["clip_sim", "r_precision"])
    return summary.select(*[r6(c).alias(c) for c in summary.columns])


@query(
    """SELECT vec_id // 2 AS idx, 'left' AS only_in FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 7 <> 0 AND (vec_id + 1) % 5 = 0
UNION ALL SELECT vec_id // 2, 'right' FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 5 <> 0 AND (vec_id - 1) % 7 = 0"""
)
def unequal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and texts without a partner, after some of either are taken out."""
    v = F.col("vec_id")
    vectors = table(spark, sf_dir, "embeddings").withColumn("idx", F.floor(v / 2))
    images = vectors.where((v % 2 == 0) & (v % 7 != 0))
    texts = vectors.where((v % 2 == 1) & (v % 5 != 0))
    return metrics.unmatched(images, texts, ["idx"])
