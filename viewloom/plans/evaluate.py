"""Predicted views against the truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from viewloom.operators import metrics


def image_scores(pred: DataFrame, truth: DataFrame, view_ids: Sequence[int] = metrics.EVAL_VIEWS, by: Sequence[str] = ("uid", "slot")) -> DataFrame:
    """PSNR and SSIM per predicted view; ``by`` may add a model or run column of ``pred``."""
    return metrics.image_scores(metrics.pair_eval(pred, truth, view_ids), by)


def compare_models(pred: DataFrame, truth: DataFrame, view_ids: Sequence[int] = metrics.EVAL_VIEWS, model: str = "model") -> DataFrame:
    """Mean and spread of the scores per model."""
    return metrics.score_summary(image_scores(pred, truth, view_ids, (model, "uid", "slot")), [model])


def text_scores(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Similarity and retrieval precision per group, then their spread over groups."""
    scores = metrics.clip_sim(images, texts).join(metrics.r_precision(images, texts), "grp")
    return metrics.view_summary(scores, ["clip_sim", "r_precision"])
