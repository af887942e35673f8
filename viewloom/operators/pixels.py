"""Image-plane tables.

``planes(uid, view_id, channel, h, w, data ARRAY<FLOAT>)`` holds one channel of
one view per row.  Pixelwise work keeps that shape; only rays and unprojected
points become one row per pixel, after the join that needs the compact row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.functions import camera as C
from viewloom.functions import matrix as M
from viewloom.functions import pixels as P
from viewloom.operators.rows import explode_rows

KEY = ["uid", "view_id"]


def composite_planes(planes: DataFrame, alpha: str = "alpha", background: float = 1.0) -> DataFrame:
    """Colour planes over a solid background; ``alpha`` is the plane of the same view."""
    return planes.withColumn("data", P.composite(F.col("data"), F.col(alpha), background))


def decode_nd(planes: DataFrame) -> DataFrame:
    """Stored normal (channels 0..2) and depth (channel 3) to their true scales."""
    depth = F.col("channel") == 3
    return planes.withColumn(
        "data",
        F.when(depth, P.decode_depth(F.col("data")))
        .when(F.col("channel") == 0, P.decode_normal(F.col("data"), flip=True))
        .otherwise(P.decode_normal(F.col("data"))),
    )


def fill_missing_plane(planes: DataFrame, column: str = "data", value: float = 1.0) -> DataFrame:
    """An absent plane becomes a constant one (white)."""
    return planes.withColumn(column, P.filled(F.col(column), F.col("h"), F.col("w"), value))


def stack_channels(planes: DataFrame, name: str = "stack") -> DataFrame:
    """All channels of a view in one row, in channel order."""
    return planes.groupBy(*KEY).agg(
        F.first("h").alias("h"),
        F.first("w").alias("w"),
        F.transform(F.sort_array(F.collect_list(F.struct("channel", "data"))), lambda s: s["data"]).alias(name),
    )


def patchify(planes: DataFrame, p: int) -> DataFrame:
    """(uid, view_id, h, w, channels, patches): p x p tiles, row by row, channel fastest."""
    stacked = stack_channels(planes).withColumn("channels", F.size("stack"))
    checked = F.when(
        (F.col("h") % p == 0) & (F.col("w") % p == 0),
        P.patchify(F.col("stack"), F.col("h"), F.col("w"), F.col("channels"), p),
    )
    return stacked.select(*KEY, "h", "w", "channels", checked.alias("patches"))


def unpatchify(patched: DataFrame, p: int) -> DataFrame:
    """Tiles back to one plane per channel."""
    stack = P.unpatchify(F.col("patches"), F.col("h"), F.col("w"), F.col("channels"), p)
    return explode_rows(patched, stack, "data", [*KEY, "h", "w"], "channel")


def _pixels(h: int, w: int) -> list[Column]:
    i = F.explode(F.sequence(F.lit(0), F.lit(h * w - 1)))
    return [i.alias("_i")]


def rays(
    cameras: DataFrame, h: int, w: int, bug: bool = True, intrinsics: tuple[float, ...] = C.FXFYCXCY
) -> DataFrame:
    """Plucker rays: origin, direction and moment of each pixel of each camera.

    ``bug=True`` keeps the published pixel grid x/(w-1) + 0.5 - cx; ``False``
    uses pixel centres.
    """
    fx, fy, cx, cy = (F.lit(float(v)) for v in intrinsics)
    grid = cameras.select(*KEY, "c2w", *_pixels(h, w)).withColumns(
        {"y": F.floor(F.col("_i") / w).cast("int"), "x": (F.col("_i") % w).cast("int")}
    )
    if bug:
        u = (F.col("x") / F.lit(float(w - 1)) + 0.5 - cx) / fx
        v = (F.col("y") / F.lit(float(h - 1)) + 0.5 - cy) / fy
    else:
        u = ((F.col("x") + 0.5) / F.lit(float(w)) - cx) / fx
        v = ((F.col("y") + 0.5) / F.lit(float(h)) - cy) / fy
    m = M.entries(F.col("c2w"))
    d = M.times_vector(M.rotation(m), [u, v, F.lit(1.0)])
    raw = grid.select(
        *KEY, "y", "x", *[c.alias(n) for c, n in zip(M.translation(m) + d, ("ox", "oy", "oz", "_dx", "_dy", "_dz"))]
    )
    length = M.norm([F.col("_dx"), F.col("_dy"), F.col("_dz")])
    unit = raw.withColumn("_l", length).select(
        *KEY, "y", "x", "ox", "oy", "oz", *[(F.col(f"_d{a}") / F.col("_l")).alias(f"d{a}") for a in "xyz"]
    )
    moment = M.cross([F.col("ox"), F.col("oy"), F.col("oz")], [F.col("dx"), F.col("dy"), F.col("dz")])
    return unit.withColumns(dict(zip(("mx", "my", "mz"), moment)))


def unproject(
    depth: DataFrame,
    cameras: DataFrame,
    intrinsics: tuple[float, ...] = C.FXFYCXCY,
    mask: str | None = None,
    scale: str | None = None,
) -> DataFrame:
    """Depth planes to world points, one row per pixel.

    ``scale`` names a column of ``cameras`` by which depth is multiplied first: that of the object, if its cameras
    were moved to a fixed radius.

    ``mask`` names an alpha plane: the points are then mapped to [0, 1] and
    blended to white outside the object, which is the stored coordinate image.
    """
    fx, fy, cx, cy = (F.lit(float(v)) for v in intrinsics)
    planes = depth.select(*KEY, "h", "w", "data", *([F.col(mask).alias("_m")] if mask else []))
    if scale is not None:
        planes = planes.join(cameras.select(*KEY, F.col(scale).alias("_s")), KEY)
        planes = planes.withColumn("data", F.transform("data", lambda d: d.cast("double") * F.col("_s"))).drop("_s")
    joined = planes.join(cameras.select(*KEY, "c2w"), KEY)
    if mask:
        pairs = F.arrays_zip(P.like(F.col("data"), F.col("_m")).alias("d"), F.col("_m").alias("m"))
        px = explode_rows(joined, pairs, "_z", [*KEY, "h", "w", "c2w"], "_i").select(
            *KEY, "h", "w", "c2w", "_i", F.col("_z.d").cast("double").alias("_d"), F.col("_z.m").cast("double").alias("_a")
        )
    else:
        px = explode_rows(joined, "data", "_v", [*KEY, "h", "w", "c2w"], "_i").withColumn(
            "_d", F.col("_v").cast("double")
        )
    px = px.withColumns({"y": F.floor(F.col("_i") / F.col("w")).cast("int"), "x": (F.col("_i") % F.col("w")).cast("int")})
    u = F.col("x") / (F.col("w") - 1).cast("double")
    v = F.col("y") / (F.col("h") - 1).cast("double")
    d = F.col("_d")
    m = M.entries(F.col("c2w"))
    cam = [d * (u - cx) / fx, d * (v - cy) / fy, d]
    world = [r + t for r, t in zip(M.times_vector(M.rotation(m), cam), M.translation(m))]
    if mask:
        a = F.col("_a")
        world = [(p * 0.5 + 0.5) * a + (F.lit(1.0) - a) for p in world]
    return px.select(*KEY, "y", "x", *[p.alias(f"p{n}") for p, n in zip(world, "xyz")])


def normalize_normals(normals: DataFrame, cameras: DataFrame, first: str = "slot") -> DataFrame:
    """Normals into the frame of each object's first view, coloured and masked to white.

    ``normals(uid, view_id, nx, ny, nz, mask)`` holds decoded normals in [-1, 1]
    (x already flipped); ``cameras(uid, slot, original_c2w, c2w_opengl)`` gives
    the stored pose and the rebuilt one, both in OpenGL axes.  The rotation is
    one 3x3 product per object.
    """
    start = cameras.where(F.col(first) == 0)
    new = M.rotation(M.entries(F.col("c2w_opengl")))
    old = M.rotation(M.entries(F.col("original_c2w")))
    turn = start.select("uid", M.pack(M.times(new, M.inverse(old))).alias("_r"))
    joined = normals.join(turn, "uid")
    zipped = F.arrays_zip(*[P.like(F.col(c), F.col("mask")).alias(c) for c in ("nx", "ny", "nz")], "mask")

    def channel(r: int) -> Column:
        def one(px: Column) -> Column:
            v = F.get("_r", F.lit(3 * r)) * px["nx"] + F.get("_r", F.lit(3 * r + 1)) * px["ny"]
            v = v + F.get("_r", F.lit(3 * r + 2)) * px["nz"]
            return (v * 0.5 + 0.5) * px["mask"] + (F.lit(1.0) - px["mask"])

        return F.transform(zipped, one)

    others = [c for c in normals.columns if c not in ("nx", "ny", "nz")]
    return joined.select(*others, *[channel(r).alias(n) for r, n in enumerate(("nx", "ny", "nz"))])


def split_strip(strips: DataFrame, views: int) -> DataFrame:
    """(uid, slot, channel, h, w, data): a strip of ``views`` images side by side cut into its slots.

    A strip whose width the number of views does not divide is an error.
    """
    width = F.floor(F.col("w") / views).cast("int")
    odd = F.raise_error(F.concat(F.lit("a strip cannot be cut into equal views: "), F.col("uid").cast("string")))
    checked = F.when((F.col("w") % views != 0) | (F.size("data") != F.col("h") * F.col("w")), odd).otherwise(F.col("data"))
    rows = explode_rows(strips.withColumn("data", checked), F.sequence(F.lit(0), F.lit(views - 1)), "slot", strips.columns)
    lines = F.sequence(F.lit(0), F.col("h") - 1)
    own = F.flatten(F.transform(lines, lambda y: F.slice("data", y * F.col("w") + F.col("slot") * width + 1, width)))
    others = [c for c in strips.columns if c not in ("uid", "w", "data")]
    cut = rows.withColumn("data", own).withColumn("w", width)
    return cut.select("uid", "slot", *others, "w", "data")


def normalize_depth(depth: DataFrame, mask: str = "mask", scaled: bool = True) -> DataFrame:
    """Masked depth over its maximum (as it is, unless ``scaled``), inverted: near is dark, background white.

    ``empty`` flags a view without any depth (its plane is NULL); ``has_zero``
    is the check that something in the view is background.
    """
    masked = depth.withColumn("_d", F.zip_with(P.like(F.col("data"), F.col(mask)), mask, lambda d, m: d.cast("double") * m.cast("double")))
    top = masked.withColumns({"_max": F.array_max("_d"), "_min": F.array_min("_d")})
    if scaled:
        out = F.when(F.col("_max") != 0, F.transform("_d", lambda d: F.lit(1.0) - d / F.col("_max")))
    else:
        out = F.transform("_d", lambda d: F.lit(1.0) - d)
    return top.withColumns(
        {"data": out, "empty": F.col("_max") == 0, "has_zero": F.col("_min") == 0}
    ).drop("_d", "_max", "_min")


def foreground_box(alpha: DataFrame, size: int, border: float) -> DataFrame:
    """Where a cut-out goes when it is centred in a size x size frame.

    Bounds of the pixels with alpha > 0; the extent is max - min without the
    + 1, scaled to ``int(size * (1 - border))`` along the longer side and placed
    by floor.  A view without foreground, or with a single row and column, has
    no box: NULL.
    """
    hit = F.filter(F.sequence(F.lit(0), F.size("data") - 1), lambda i: F.get("data", i) > 0)
    rows = F.transform("_hit", lambda i: F.floor(i / F.col("w")).cast("int"))
    cols = F.transform("_hit", lambda i: (i % F.col("w")).cast("int"))
    bounds = alpha.withColumn("_hit", hit).select(
        *KEY,
        F.array_min(rows).alias("y_min"),
        F.array_max(rows).alias("y_max"),
        F.array_min(cols).alias("x_min"),
        F.array_max(cols).alias("x_max"),
    )
    return place_box(bounds, size, border)


def place_box(bounds: DataFrame, size: int, border: float) -> DataFrame:
    """Target rectangle for y_min..y_max, x_min..x_max."""
    h, w = F.col("y_max") - F.col("y_min"), F.col("x_max") - F.col("x_min")
    scale = F.try_divide(F.lit(float(int(size * (1 - border)))), F.greatest(h, w).cast("double"))
    scaled = bounds.withColumns({"h2": F.floor(h * scale).cast("int"), "w2": F.floor(w * scale).cast("int")})
    top = F.floor((F.lit(size) - F.col("h2")) / 2).cast("int")
    left = F.floor((F.lit(size) - F.col("w2")) / 2).cast("int")
    return scaled.withColumns({"y2_min": top, "x2_min": left}).withColumns(
        {"y2_max": F.col("y2_min") + F.col("h2"), "x2_max": F.col("x2_min") + F.col("w2")}
    )
