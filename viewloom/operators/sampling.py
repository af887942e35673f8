"""View picks: which views of an object enter a sample.

Picks work on view sets (see ``views.view_sets``), one narrow row per object,
and every draw is a function of (seed, uid, candidate).  Where a loader would
redraw until the views exist, all candidates are listed and the first complete
one in hash order is taken: the same distribution, without retries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.functions.draws import hex_draw, unit_draw
from viewloom.operators.rows import explode_rows
from viewloom.operators.views import covers, has_view, mask_of

# Rings as (first view, size, chance), duplicated views, views at the poles.
RINGS = ((0, 24, 2 / 3), (27, 12, 1 / 3))
DUPLICATE_VIEWS = (24, 39)
POLE_VIEWS = (25, 26)


def _check_even(v: int, rings: Sequence[tuple[int, int, float]]) -> None:
    if any(size % v for _, size, _ in rings):
        raise ValueError("the number of views must divide the size of every ring")


def _ring_start(start: int, size: int, first: int, v: int) -> list[int]:
    return [(start + (size // v) * i) % size + first for i in range(v)]


def pick_even(objects: DataFrame, v: int, seed: int, rings: Sequence[tuple[int, int, float]] = RINGS) -> DataFrame:
    """``picks``: v evenly spaced views of one ring, whether they exist or not."""
    _check_even(v, rings)
    ring_draw = unit_draw(hex_draw(seed, F.col("uid"), F.lit("ring")))
    start_draw = unit_draw(hex_draw(seed, F.col("uid"), F.lit("start")))

    def ring_picks(first: int, size: int) -> Column:
        # the draw is an argument of sequence, so it is made once, not once per slot
        start, step = F.floor(start_draw * size).cast("int"), size // v
        steps = F.sequence(start, start + F.lit((v - 1) * step), F.lit(step))
        return F.transform(steps, lambda s: s % size + first)

    # cumulative chances from the last ring backwards: the last one takes the rest
    picks = ring_picks(*rings[-1][:2])
    for i in reversed(range(len(rings) - 1)):
        upto = sum(chance for _, _, chance in rings[: i + 1])
        picks = F.when(ring_draw < upto, ring_picks(*rings[i][:2])).otherwise(picks)
    return objects.withColumn("picks", picks)


def _by_draw(ids: Column, seed: int, tag: str) -> Column:
    """View ids in hash order."""
    keyed = F.transform(ids, lambda i: F.struct(hex_draw(seed, F.col("uid"), F.lit(tag), i).alias("h"), i.alias("i")))
    return F.transform(F.sort_array(keyed), lambda s: s["i"])


def pick_random(
    objects: DataFrame, v: int, seed: int, n: int = 40, exclude: Sequence[int] = (), existing: str | None = None
) -> DataFrame:
    """``picks``: v distinct views out of 0..n-1 without ``exclude``.

    With ``existing`` (the name of a mask column) only valid views are drawn;
    an object with fewer than v of them gets NULL.
    """
    ids = F.array(*[F.lit(i) for i in range(n) if i not in set(exclude)])
    if existing is not None:
        ids = F.filter(ids, lambda i: has_view(F.col(existing), i))
    return objects.withColumn("picks", F.when(F.size(ids) >= v, F.slice(_by_draw(ids, seed, "view"), 1, v)))


def pick_existing(
    sets: DataFrame, v: int, seed: int, rings: Sequence[tuple[int, int, float]] = RINGS
) -> DataFrame:
    """``picks``: v evenly spaced views that all exist; NULL when no start has them.

    Drawing a ring by its chance and then a start, and redrawing until the views
    exist, weighs each start by chance / size.  The rings must agree on that
    weight (they do by default: 1/36), so every complete start is equally likely.
    """
    _check_even(v, rings)
    weights = {round(chance / size, 12) for _, size, chance in rings}
    if len(weights) > 1:
        raise ValueError("rings must give every start the same chance")
    n = max(first + size for first, size, _ in rings)
    candidates = []
    for first, size, _ in rings:
        for start in range(size):
            ids = _ring_start(start, size, first, v)
            candidates.append(
                F.struct(
                    F.array(*[F.lit(w).cast("bigint") for w in mask_of(ids, n)]).alias("need"),
                    F.array(*[F.lit(i) for i in ids]).alias("ids"),
                )
            )
    complete = F.filter(F.array(*candidates), lambda c: covers(F.col("mask"), c["need"]))
    keyed = F.transform(
        complete, lambda c: F.struct(hex_draw(seed, F.col("uid"), F.element_at(c["ids"], 1)).alias("h"), c["ids"].alias("ids"))
    )
    return sets.withColumn("picks", F.array_min(keyed)["ids"])


def pick_rows(picked: DataFrame) -> DataFrame:
    """(uid, slot, view_id), one row per pick."""
    return explode_rows(picked, "picks", "view_id", ["uid"], "slot")


def failed_picks(picked: DataFrame) -> DataFrame:
    """Objects for which no pick exists."""
    return picked.where(F.col("picks").isNull()).select("uid")


def with_slots(
    picked: DataFrame, v: int, seed: int, n: int = 40, exclude: Sequence[int] = DUPLICATE_VIEWS
) -> DataFrame:
    """Adds ``slots``: exactly v view ids, NULL where there is no pick.

    First the picks, then the other valid views in hash order without
    ``exclude``; if they run out, the list starts over.
    """
    rest = F.filter(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: has_view(F.col("mask"), i) & ~F.array_contains(F.col("picks"), i) & ~i.isin(list(exclude)),
    )
    listed = picked.withColumn("_listed", F.slice(F.concat(F.col("picks"), _by_draw(rest, seed, "fill")), 1, v))
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(v - 1)), lambda s: F.get(F.col("_listed"), (s % F.size("_listed")).cast("int"))
    )
    return listed.withColumn("slots", F.when(F.col("_listed").isNotNull(), slots)).drop("_listed")


def fill_views(
    picked: DataFrame, v: int, seed: int, n: int = 40, exclude: Sequence[int] = DUPLICATE_VIEWS
) -> DataFrame:
    """(uid, slot, view_id) with exactly v slots per object that has picks."""
    return explode_rows(with_slots(picked, v, seed, n, exclude), "slots", "view_id", ["uid"], "slot")


def cond_views(objects: DataFrame, v: int, k: int, seed: int) -> DataFrame:
    """(uid, cond, slot): slot 0 always, then k-1 other slots in hash order."""
    if not 1 <= k <= v:
        raise ValueError("between 1 and v condition views")
    if k == 1:
        return objects.select("uid", F.lit(0).alias("cond"), F.lit(0).alias("slot"))
    others = F.slice(_by_draw(F.sequence(F.lit(1), F.lit(v - 1)), seed, "cond"), 1, k - 1)
    return explode_rows(objects, F.concat(F.array(F.lit(0)), others), "slot", ["uid"], "cond")
