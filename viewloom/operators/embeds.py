"""Prompt embeddings: per-model columns, attach by uid, the embedding of the empty prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.functions.draws import hex_draw, unit_draw
from viewloom.functions.text import norm_uid
from viewloom.operators.skew import skew_join

# Which models store a pooled vector or an attention mask, and
# whose empty-prompt embedding is replaced by zeros.
POOLED_MODELS = ("sdxl", "sd3m", "sd35m", "sd35l")
MASK_MODELS = ("paa", "pas")
ZERO_NULL_MODELS = ("sdxl",)
NULL_UID = "null"


def model_columns(model: str) -> list[str]:
    columns = ["tokens"]
    if model in POOLED_MODELS:
        columns.append("pooled")
    if model in MASK_MODELS:
        columns.append("attention_mask")
    return columns


def _of_model(embeds: DataFrame, model: str) -> DataFrame:
    return embeds.where(F.col("model") == model)


def attach_embeds(samples: DataFrame, embeds: DataFrame, model: str) -> DataFrame:
    """Samples with the embedding of their normalised uid; samples without one drop out."""
    store = _of_model(embeds, model).select(F.col("uid").alias("embed_uid"), *model_columns(model))
    keyed = samples.withColumn("embed_uid", norm_uid(F.col("uid").cast("string")))
    return skew_join(keyed, store, ["embed_uid"], ["uid"]).drop("embed_uid")


def missing_embeds(samples: DataFrame, embeds: DataFrame, model: str) -> DataFrame:
    """Samples whose embedding is absent; only keys are read from the store."""
    store = _of_model(embeds, model).select(F.col("uid").alias("embed_uid"))
    keyed = samples.select("uid", norm_uid(F.col("uid").cast("string")).alias("embed_uid"))
    return keyed.join(store, "embed_uid", "left_anti").select("uid")


def _zeros(vector: Column) -> Column:
    return F.transform(vector, lambda v: v * 0)


def null_embed(embeds: DataFrame, model: str) -> Column:
    """The empty-prompt row of a model as a scalar: NULL when it was never written."""
    columns = model_columns(model)
    row = (
        _of_model(embeds, model)
        .where(F.col("uid") == NULL_UID)
        .agg(F.min(F.struct(*columns)).alias("row"))
        .scalar()
    )
    return row


def attach_null(samples: DataFrame, embeds: DataFrame, model: str) -> DataFrame:
    """Adds ``null_*`` columns holding the empty-prompt embedding.

    It is one row, so it travels as a scalar subquery and no join is planned.
    """
    out = samples.withColumn("_null", null_embed(embeds, model))
    columns = model_columns(model)
    values = {c: F.col(f"_null.{c}") for c in columns}
    if model in ZERO_NULL_MODELS:
        both = values["tokens"].isNotNull() & values["pooled"].isNotNull()
        values["tokens"] = F.when(both, F.transform(values["tokens"], _zeros)).otherwise(values["tokens"])
        values["pooled"] = F.when(both, _zeros(values["pooled"])).otherwise(values["pooled"])
    for c in columns:
        out = out.withColumn(f"null_{c}", values[c])
    return out.drop("_null")


def dropout_band(u: Column, rate: float) -> Column:
    """Which conditions one uniform draw drops: [0, q) text, [q, 2q) both, [2q, 3q) image."""
    return F.struct((u < 2 * rate).alias("drop_text"), ((u >= rate) & (u < 3 * rate)).alias("drop_image"))


def condition_dropout(samples: DataFrame, rate: float, seed: int, epoch: int, key: str = "uid") -> DataFrame:
    """Adds drop_text and drop_image, drawn from (seed, epoch, key)."""
    u = unit_draw(hex_draw(seed, F.lit(epoch), F.col(key)))
    return samples.withColumn("_d", dropout_band(u, rate)).select(*samples.columns, "_d.drop_text", "_d.drop_image")


def apply_text_drop(samples: DataFrame, model: str) -> DataFrame:
    """Dropped samples take every part of the empty-prompt embedding that the model stores."""
    swapped = {c: F.when(F.col("drop_text"), F.col(f"null_{c}")).otherwise(F.col(c)) for c in model_columns(model)}
    return samples.withColumns(swapped)
