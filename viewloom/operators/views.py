"""View tables: pairing, reshaping, completeness reports, splits.

A view belongs to an object ``uid`` and has an index ``view_id`` in
``0..n-1``.  The set of valid views of an object is kept as bits, 62 in each
BIGINT of an array: combining sets is a bitwise OR that Spark pre-aggregates
before the shuffle, so an object that owns a third of all files costs a few
longs per task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewloom.functions.text import name_caption
from viewloom.operators.positions import with_position
from viewloom.operators.rows import explode_rows

# Views of a full sample, and the fewest that can be trained on.
NUM_VIEWS = 40
MIN_VIEWS = 4
# Views in one word of a mask.
WORD = 62

_WIDE_COLUMN = re.compile(r"^(\d{5})\.(png|json)$")


def _check_n(n: int) -> None:
    if n <= 0:
        raise ValueError("number of views must be positive")


def words(n: int) -> int:
    """Words of a mask for n views."""
    return -(-n // WORD)


def bit(view_id: Column) -> Column:
    """The bit of a view in its word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (view_id % WORD).cast("int"))


def word(view_id: Column) -> Column:
    return F.floor(view_id / WORD).cast("int")


def has_view(mask: Column, view_id: Column | int) -> Column:
    view = F.lit(view_id) if isinstance(view_id, int) else view_id
    own = F.get(mask, F.lit(view_id // WORD) if isinstance(view_id, int) else word(view))
    return F.coalesce(own.bitwiseAND(bit(view)) != 0, F.lit(False))


def views_in(mask: Column, n: int) -> Column:
    """Sorted view ids of a mask."""
    ids = F.sequence(F.lit(0), F.lit(n - 1))
    return F.filter(ids, lambda i: has_view(mask, i))


def views_not_in(mask: Column, n: int) -> Column:
    """Sorted view ids a mask lacks."""
    ids = F.sequence(F.lit(0), F.lit(n - 1))
    return F.filter(ids, lambda i: ~has_view(mask, i))


def count_views(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, w: a + F.bit_count(w))


def covers(mask: Column, need: Column) -> Column:
    """Every view of ``need`` is in ``mask``; words that one of them lacks are empty."""
    zero = F.lit(0).cast("bigint")

    def inside(x: Column) -> Column:
        wanted = F.coalesce(x["w"], zero)
        return F.coalesce(x["m"], zero).bitwiseAND(wanted) == wanted

    return F.forall(F.arrays_zip(mask.alias("m"), need.alias("w")), inside)


def mask_of(ids, n: int) -> list[int]:
    out = [0] * words(n)
    for i in ids:
        out[i // WORD] |= 1 << (i % WORD)
    return out


def pair_views(files: DataFrame) -> DataFrame:
    """(uid, view_id, kind) files to one row per view with flags and ``valid``.

    A view counts only when its image and its camera both exist.
    """
    return (
        files.groupBy("uid", "view_id")
        .agg(
            F.bool_or(F.col("kind") == "png").alias("has_png"),
            F.bool_or(F.col("kind") == "json").alias("has_json"),
        )
        .withColumn("valid", F.col("has_png") & F.col("has_json"))
    )


def view_sets(files: DataFrame, n: int = NUM_VIEWS) -> DataFrame:
    """(uid, view_id, has_png, has_json) to (uid, mask of valid views).

    Pairing and collecting are one aggregation: the image bits and the camera
    bits of an object are gathered apart and intersected at the end.  Rows may
    repeat.  Objects without any valid view stay, with an empty mask.  If a mask
    has several words they are gathered apart, then put together.
    """
    _check_n(n)
    in_ring = F.col("view_id").between(0, n - 1)
    own = bit(F.col("view_id"))
    place = F.when(in_ring, word(F.col("view_id"))).otherwise(F.lit(0))
    keys = ["uid"] if words(n) == 1 else ["uid", place.alias("_word")]
    gathered = files.groupBy(*keys).agg(
        F.bit_or(F.when(in_ring & F.col("has_png"), own)).alias("png"),
        F.bit_or(F.when(in_ring & F.col("has_json"), own)).alias("json"),
    )
    both = F.coalesce(F.col("png").bitwiseAND(F.col("json")), F.lit(0).cast("bigint"))
    if words(n) == 1:
        return gathered.select("uid", F.array(both).alias("mask"))
    entries = F.map_from_entries(F.collect_list(F.struct("_word", both.alias("bits"))))
    ids = F.sequence(F.lit(0), F.lit(words(n) - 1))
    return (
        gathered.groupBy("uid")
        .agg(entries.alias("_m"))
        .select("uid", F.transform(ids, lambda w: F.coalesce(F.try_element_at("_m", w), F.lit(0).cast("bigint"))).alias("mask"))
    )


def view_report(sets: DataFrame, n: int = NUM_VIEWS, min_views: int = MIN_VIEWS) -> DataFrame:
    """Per object: how many views are valid, which, which are missing, and is it enough."""
    if min_views <= 0:
        raise ValueError("min_views must be a positive integer")
    count = count_views(F.col("mask"))
    return sets.select(
        "uid",
        count.alias("n_valid"),
        views_in(F.col("mask"), n).alias("valid_views"),
        views_not_in(F.col("mask"), n).alias("missing_views"),
        (count >= min_views).alias("enough"),
    )


def present_views(sets: DataFrame, n: int = NUM_VIEWS) -> DataFrame:
    """One row per valid view of an object."""
    return explode_rows(sets, views_in(F.col("mask"), n), "view_id", ["uid"])


def missing_views(sets: DataFrame, n: int = NUM_VIEWS) -> DataFrame:
    """One row per view an object lacks."""
    return explode_rows(sets, views_not_in(F.col("mask"), n), "view_id", ["uid"])


def except_views(views: DataFrame, ids) -> DataFrame:
    """Candidate views without an excluded set."""
    return views.where(~F.col("view_id").isin(list(ids)))


def wide_view_ids(df: DataFrame) -> list[int]:
    """View ids for which a wide table has both columns."""
    seen: dict[int, set[str]] = {}
    for name in df.columns:
        match = _WIDE_COLUMN.match(name)
        if match:
            seen.setdefault(int(match.group(1)), set()).add(match.group(2))
    return sorted(i for i, kinds in seen.items() if kinds == {"png", "json"})


def views_long(samples: DataFrame, keep: tuple[str, ...] = ("uid",), extra: tuple[str, ...] = ()) -> DataFrame:
    """Wide samples to one row per existing view; a narrow step, nothing is shuffled.

    ``extra`` names further files of a view (``albedo``, ``mr``, ``nd``): they
    join as columns, NULL where the table lacks them.  A view whose image or
    camera is NULL, or whose columns do not exist, gives no row.
    """

    def cell(name: str) -> Column:
        return F.col(f"`{name}`") if name in samples.columns else F.lit(None).cast("binary")

    structs = [
        F.struct(
            F.lit(i).alias("view_id"),
            cell(f"{i:05d}.png").alias("png"),
            cell(f"{i:05d}.json").alias("camera_json"),
            *[cell(f"{i:05d}_{e}.png").alias(e) for e in extra],
        )
        for i in wide_view_ids(samples)
    ]
    if not structs:
        raise ValueError("no view columns such as 00000.png and 00000.json")
    present = F.filter(F.array(*structs), lambda v: v["png"].isNotNull() & v["camera_json"].isNotNull())
    return explode_rows(samples, present, "v", list(keep)).select(*keep, "v.*")


def wide_cells(samples: DataFrame, n: int = NUM_VIEWS) -> Column:
    """One (png, camera_json) per view id of a wide sample, NULL unless both exist."""
    known = set(wide_view_ids(samples))
    kind = "struct<png:binary,camera_json:binary>"
    cells = []
    for i in range(n):
        if i not in known:
            cells.append(F.lit(None).cast(kind))
            continue
        png, camera = F.col(f"`{i:05d}.png`"), F.col(f"`{i:05d}.json`")
        pair = F.struct(png.alias("png"), camera.alias("camera_json")).cast(kind)
        cells.append(F.when(png.isNotNull() & camera.isNotNull(), pair))
    return F.array(*cells)


def wide_mask(samples: DataFrame, n: int = NUM_VIEWS) -> Column:
    """Valid views of a wide sample as bits; no shuffle, the row knows."""
    _check_n(n)
    totals = [F.lit(0).cast("bigint")] * words(n)
    for i in wide_view_ids(samples):
        if i < n:
            whole = F.col(f"`{i:05d}.png`").isNotNull() & F.col(f"`{i:05d}.json`").isNotNull()
            totals[i // WORD] = totals[i // WORD] + F.when(whole, F.lit(1 << (i % WORD))).otherwise(F.lit(0)).cast("bigint")
    return F.array(*totals)


def complete_assets(views: DataFrame, files: tuple[str, ...] = ("png", "camera_json", "albedo", "mr", "nd")) -> DataFrame:
    """Views with every file; one missing file drops the view."""
    return views.dropna(subset=list(files))


def views_wide(views: DataFrame, n: int = NUM_VIEWS, keep: tuple[str, ...] = ("uid",)) -> DataFrame:
    """Long views to a column pair per view; half a pair becomes two NULLs.

    (uid, view_id) must be unique, so an object contributes at most n views;
    a repeated view is an error.
    """
    whole = F.col("png").isNotNull() & F.col("camera_json").isNotNull() & F.col("view_id").between(0, n - 1)
    pair = F.struct(F.col("view_id").cast("int").alias("k"), F.struct("png", "camera_json").alias("v"))
    grouped = views.groupBy(*keep).agg(F.map_from_entries(F.collect_list(F.when(whole, pair))).alias("_views"))
    cells = []
    for i in range(n):
        cell = F.try_element_at("_views", F.lit(i))
        cells += [cell["png"].alias(f"{i:05d}.png"), cell["camera_json"].alias(f"{i:05d}.json")]
    return grouped.select(*keep, *cells)


def renders_wide(renders: DataFrame, n: int = NUM_VIEWS, keep: tuple[str, ...] = ("uid",)) -> DataFrame:
    """(uid, view_id, kind, content) files to a column pair per view.

    The same result as pairing first and widening then, with the contents
    shuffled once.
    """
    _check_n(n)
    place = F.col("view_id") * 2 + (F.col("kind") == "json").cast("int")
    file = F.struct(place.alias("k"), F.col("content").alias("v"))
    wanted = renders.where(F.col("view_id").between(0, n - 1))
    grouped = wanted.groupBy(*keep).agg(F.map_from_entries(F.collect_list(file)).alias("_files"))
    cells = []
    for i in range(n):
        png, camera = (F.try_element_at("_files", F.lit(2 * i + k)) for k in (0, 1))
        cells.append(F.when(camera.isNotNull(), png).alias(f"{i:05d}.png"))
        cells.append(F.when(png.isNotNull(), camera).alias(f"{i:05d}.json"))
    return grouped.select(*keep, *cells)


def holdout_last(objects: DataFrame, name: str = "name") -> DataFrame:
    """The last object by name is ``val``, the others ``train``; a single one is both."""
    ends = objects.agg(F.struct(F.min(name).alias("first"), F.max(name).alias("last"))).scalar()
    tagged = objects.withColumn("_s", ends)
    last = F.col(name) == F.col("_s.last")
    splits = (
        F.when(last & (F.col("_s.first") == F.col("_s.last")), F.array(F.lit("train"), F.lit("val")))
        .when(last, F.array(F.lit("val")))
        .otherwise(F.array(F.lit("train")))
    )
    return explode_rows(tagged, splits, "split", objects.columns)


def number_uids(objects: DataFrame, prefix: str, name: str = "name", width: int = 3) -> DataFrame:
    """``{prefix}_{split}_{000}`` by name order inside the split; the name stays as a column."""
    numbered = with_position(objects, [name], ["split"], name="_i")
    uid = F.concat(F.lit(f"{prefix}_"), F.col("split"), F.lit("_"), F.format_string(f"%0{width}d", F.col("_i")))
    return numbered.select(
        uid.alias("uid"), *[c for c in objects.columns if c != "uid"], name_caption(F.col(name)).alias("caption")
    )


def split_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def preview(views: DataFrame, samples: int = 4, per_sample: int = 8) -> DataFrame:
    """At most ``samples`` objects, the first by uid, with their first views each."""
    first = views.select("uid").distinct().orderBy("uid").limit(samples)
    ranked = views.join(F.broadcast(first), "uid", "left_semi").withColumn(
        "slot", F.row_number().over(W.partitionBy("uid").orderBy("view_id")) - 1
    )
    return ranked.where(F.col("slot") < per_sample)
