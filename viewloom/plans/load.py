"""Sample shards to training rows.

A wide sample holds all views of its object, so view choice, cameras and the
reference to the first view are decided inside the row: from the shard scan to
the training rows nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.functions import camera as C
from viewloom.operators import cameras, checks, embeds, sampling, views
from viewloom.operators.rows import explode_rows


def training_views(
    samples: DataFrame,
    v: int,
    v_in: int,
    seed: int,
    n: int = views.NUM_VIEWS,
    even: bool = True,
    rings: Sequence[tuple[int, int, float]] = sampling.RINGS,
    exclude: Sequence[int] = sampling.DUPLICATE_VIEWS,
    without_poles: bool = False,
    keep: Sequence[str] = ("uid",),
) -> DataFrame:
    """(uid, slot, view_id, png, camera_json, first_json): v views per sample.

    The first v_in are an even or a random pick among the existing views, the
    others fill up.  Samples without a pick are left out (see ``failed_samples``).
    """
    checks.check_view_counts(v, v_in, [size for _, size, _ in rings] if even else ())
    poles = sampling.POLE_VIEWS if without_poles else ()
    masked = samples.select(
        *keep, views.wide_cells(samples, n).alias("_cells"), views.wide_mask(samples, n).alias("mask")
    )
    if even:
        picked = sampling.pick_existing(masked, v_in, seed, rings)
    else:
        picked = sampling.pick_random(masked, v_in, seed, n, exclude=poles, existing="mask")
    slotted = sampling.with_slots(picked, v, seed, n, (*exclude, *poles))
    chosen = F.transform(
        "slots", lambda i: F.struct(i.alias("view_id"), F.get("_cells", i).alias("cell"))
    )
    first = F.get("_cells", F.get("slots", F.lit(0)))["camera_json"]
    ready = slotted.select(*keep, chosen.alias("_chosen"), first.alias("first_json"))
    rows = explode_rows(ready, "_chosen", "_v", [*keep, "first_json"], "slot")
    return rows.select(*keep, "slot", "_v.view_id", "_v.cell.png", "_v.cell.camera_json", "first_json")


def failed_samples(samples: DataFrame, v_in: int, seed: int, n: int = views.NUM_VIEWS, rings=sampling.RINGS) -> DataFrame:
    """uids for which no complete even pick exists."""
    masked = samples.select("uid", views.wide_mask(samples, n).alias("mask"))
    return sampling.failed_picks(sampling.pick_existing(masked, v_in, seed, rings))


def training_rows(rows: DataFrame, radius: float | None = cameras.NORM_RADIUS, keep: Sequence[str] = ("uid",)) -> DataFrame:
    """Training views with their cameras; unusable camera files give a NULL pose and a reason."""
    parsed = cameras.parse_cameras(rows)
    with_first = parsed.withColumn("_parts", C.camera_parts(F.col("first_json"))).withColumn(
        "first_c2w", C.pose_of(F.col("_parts"))
    )
    return cameras.training_cameras(
        with_first, radius, keep=(*keep, "slot", "view_id", "png", "camera_problem"), first="first_c2w"
    )


def with_prompts(samples: DataFrame, store: DataFrame, model: str, rate: float, seed: int, epoch: int) -> DataFrame:
    """Prompt embeddings, the embedding of the empty prompt, and condition dropout.

    Joined to one row per sample, not per view.
    """
    joined = embeds.attach_null(embeds.attach_embeds(samples, store, model), store, model)
    return embeds.apply_text_drop(embeds.condition_dropout(joined, rate, seed, epoch), model)
