"""Captions to stored prompt embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.operators import captions, hooks
from viewloom.sources import sinks


#: Numbers of a row group of stored embeddings, which a reader unpacks at once, and tasks for each core.
GROUP_NUMBERS, TASKS = 1 << 22, 4


def resolve_captions(subset: DataFrame, gidmap: DataFrame, table: DataFrame) -> DataFrame:
    """(uid, caption) of every listed object; an object without path or caption ends the job."""
    oids = captions.resolve_subset(subset, gidmap)
    for what, failing in (
        ("listed ids are not in the map", captions.unresolved_gids(subset, gidmap).select(F.col("gid").alias("id"))),
        ("objects have no caption", captions.missing_captions(oids, table).select(F.col("oid").alias("id"))),
    ):
        count, first = failing.agg(F.count(F.lit(1)), F.min("id")).first()
        if count:
            raise ValueError(f"{count} {what}, the first is {first}")
    return captions.attach_captions(oids, table).select(F.col("oid").alias("uid"), "caption").distinct()


def embed_captions(
    pairs: DataFrame,
    encoder_factory: Callable[[], hooks.Encoder],
    model: str,
    path: str,
    zero_null: bool = False,
    **options,
) -> None:
    """Stores the embedding of each (uid, caption) and of the empty prompt, which is encoded or all zeros.

    Rows of a failed encoder keep their flag in the store.  Captions are short and embeddings long, so the
    captions are dealt over all cores first.
    """
    spark = pairs.sparkSession
    pairs = pairs.repartition(TASKS * spark.sparkContext.defaultParallelism)
    if zero_null:
        null = hooks.zero_null(spark, model)
        made = hooks.encode(pairs, encoder_factory, model, **options).unionByName(null)
    else:
        made = hooks.encode_with_null(pairs, encoder_factory, model, **options)
    numbers = hooks.CAPTION_LENGTH[model] * hooks.TOKEN_WIDTH[model]
    sinks.write_embeds(made, path, model, max(1, GROUP_NUMBERS // numbers))
