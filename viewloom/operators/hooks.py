"""Places where user code joins a job: encoders, sample transforms, pair scorers.

A hook is built once per partition and works on Arrow batches, so a model loads
once per task.  No model is shipped here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.functions.text import model_caption
from viewloom.operators.embeds import MASK_MODELS, NULL_UID

# Caption length of each model (CLIP + T5 where there are two
# encoders), and the widths of its token and pooled vectors.
CAPTION_LENGTH = {
    "sd15": 77, "sd21": 77, "sdxl": 77, "paa": 120, "pas": 300,
    "sd3m": 77 + 256, "sd35m": 77 + 256, "sd35l": 77 + 256,
}
TOKEN_WIDTH = {
    "sd15": 768, "sd21": 1024, "sdxl": 2048, "paa": 4096, "pas": 4096, "sd3m": 4096, "sd35m": 4096, "sd35l": 4096,
}
POOLED_WIDTH = {"sdxl": 1280, "sd3m": 2048, "sd35m": 2048, "sd35l": 2048}
ENCODE_BATCH = 128
# Size of the Arrow batches that leave the encoder.
PIECE_BYTES = 32 << 20

EMBED_SCHEMA = (
    "model STRING, uid STRING, tokens ARRAY<ARRAY<FLOAT>>, pooled ARRAY<FLOAT>, "
    "attention_mask ARRAY<FLOAT>, fallback BOOLEAN"
)

# An encoder takes captions and the caption length of the model and returns
# (tokens, pooled or None, attention mask or None), one entry per caption.
Encoder = Callable[[list[str], int], tuple]


def encode(
    captions: DataFrame,
    encoder_factory: Callable[[], Encoder],
    model: str,
    batch: int = ENCODE_BATCH,
    on_error: str = "raise",
) -> DataFrame:
    """(uid, caption) to the embedding table of ``model``.

    ``on_error="zeros"`` replaces a failing batch by zeros in the model's own shape
    and flags the rows, so they can be counted; otherwise the failure ends the job.
    Spark fills in the zeros, so they are neither made in Python nor sent from there.
    """
    if model not in CAPTION_LENGTH:
        raise ValueError(f"unknown model {model}")
    if on_error not in ("raise", "zeros"):
        raise ValueError("on_error is 'raise' or 'zeros'")
    length, width, piece_bytes = CAPTION_LENGTH[model], TOKEN_WIDTH[model], PIECE_BYTES
    prepared = captions.select("uid", model_caption(F.col("caption"), model).alias("caption"))

    def floats(values, count):
        """(count, D) numbers as a float list column."""
        if values is None:
            return pa.nulls(count, pa.list_(pa.float32()))
        rows = [np.asarray(v, dtype=np.float32).reshape(-1) for v in values]
        offsets = np.cumsum([0] + [len(r) for r in rows], dtype=np.int32)
        flat = np.concatenate(rows) if rows else np.empty(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    def nested(values, count):
        """(count, N, D) numbers as a list of token vectors, without a Python object per number."""
        if values is None:
            return pa.nulls(count, pa.list_(pa.list_(pa.float32())))
        sheets = [np.asarray(v, dtype=np.float32) for v in values]
        vectors = floats([row for sheet in sheets for row in sheet], count)
        offsets = np.cumsum([0] + [len(s) for s in sheets], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                count, failed = part.num_rows, False
                try:
                    if encoder is None:
                        encoder = encoder_factory()
                    tokens, pooled, mask = encoder(part.column("caption").to_pylist(), length)
                except Exception:
                    if on_error == "raise":
                        raise
                    failed, tokens, pooled, mask = True, None, None, None
                made = pa.RecordBatch.from_arrays(
                    [
                        pa.array([model] * count),
                        part.column("uid"),
                        nested(tokens, count),
                        floats(pooled, count),
                        floats(mask, count),
                        pa.array([failed] * count),
                    ],
                    names=["model", "uid", "tokens", "pooled", "attention_mask", "fallback"],
                )
                # hand large embeddings over in pieces
                piece = max(1, count * piece_bytes // max(1, made.nbytes))
                for at in range(0, count, piece):
                    yield made.slice(at, piece)

    made = prepared.mapInArrow(run, EMBED_SCHEMA)
    if on_error == "raise":
        return made
    # sizes of failed rows only: a column of zeros depends on the row and is no huge constant of the plan
    sizes = {"tokens": (width, length), "pooled": (POOLED_WIDTH.get(model),), "attention_mask": (length if model in MASK_MODELS else None,)}

    def filled(name: str) -> Column:
        *inner, outer = sizes[name]
        if outer is None:
            return F.col(name)
        return F.coalesce(name, F.array_repeat(_zeros(*inner), F.when(F.col("fallback"), F.lit(outer)))).alias(name)

    return made.select("model", "uid", *map(filled, sizes), "fallback")


def _zeros(*sizes: int) -> Column:
    out = F.lit(0.0).cast("float")
    for size in sizes:
        out = F.array_repeat(out, size)
    return out


def encode_with_null(
    captions: DataFrame, encoder_factory: Callable[[], Encoder], model: str, batch: int = ENCODE_BATCH, **kwargs
) -> DataFrame:
    """As ``encode``, plus the row of the empty prompt under uid ``null``."""
    spark = captions.sparkSession
    empty = spark.range(1).select(F.lit("null").alias("uid"), F.lit("").alias("caption"))
    return encode(captions.select("uid", "caption").unionByName(empty), encoder_factory, model, batch, **kwargs)


def zero_null(spark: SparkSession, model: str) -> DataFrame:
    """The row of the empty prompt as zeros in the model's own shape."""
    length = CAPTION_LENGTH[model]
    none = F.lit(None).cast("array<float>")
    return spark.range(1).select(
        F.lit(model).alias("model"),
        F.lit(NULL_UID).alias("uid"),
        _zeros(TOKEN_WIDTH[model], length).alias("tokens"),
        (_zeros(POOLED_WIDTH[model]) if model in POOLED_WIDTH else none).alias("pooled"),
        (_zeros(length) if model in MASK_MODELS else none).alias("attention_mask"),
        F.lit(False).alias("fallback"),
    )


def transform_samples(samples: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """User transform of samples, one pandas batch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return samples.mapInPandas(run, schema)


def score_pairs(
    pairs: DataFrame, scorer_factory: Callable[[], Callable[[pd.DataFrame], np.ndarray]], name: str = "score"
) -> DataFrame:
    """Adds the score a user model gives each pair."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for frame in frames:
            yield frame.assign(**{name: np.asarray(scorer(frame), dtype=np.float64)})

    return pairs.mapInPandas(run, f"{schema}, `{name}` DOUBLE")
