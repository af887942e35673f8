"""Expressions on image planes: row-major ARRAY columns in [0, 1].

Pixelwise work is array in, array out: no row is exploded and nothing is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: stored depth is one fifth of the true depth.
DEPTH_SCALE = 5.0


def at(plane: Column, index: Column) -> Column:
    return F.get(plane, index.cast("int"))


def like(plane: Column, other: Column) -> Column:
    """``plane``, which must have as many pixels as ``other``; an error otherwise."""
    sizes = F.concat(F.lit("planes of unequal size: "), F.size(plane).cast("string"), F.lit(" and "), F.size(other).cast("string"))
    return F.when(F.size(plane) != F.size(other), F.raise_error(sizes)).otherwise(plane)


def composite(rgb: Column, alpha: Column, background: float | Column = 1.0) -> Column:
    bg = background if isinstance(background, Column) else F.lit(float(background))
    return F.zip_with(like(rgb, alpha), alpha, lambda c, a: c * a + (F.lit(1.0) - a) * bg)


def without_nan(plane: Column) -> Column:
    return F.transform(plane, lambda v: F.nanvl(v.cast("double"), F.lit(0.0)))


def decode_bytes(plane: Column, bits: int = 8) -> Column:
    """Stored integers to [0, 1]."""
    top = float(2**bits - 1)
    return F.transform(plane, lambda v: F.nanvl(v.cast("double"), F.lit(0.0)) / F.lit(top))


def decode_depth(plane: Column) -> Column:
    return F.transform(plane, lambda v: F.nanvl(v.cast("double"), F.lit(0.0)) * F.lit(DEPTH_SCALE))


def decode_normal(plane: Column, flip: bool = False) -> Column:
    """[0, 1] to [-1, 1]; ``flip`` negates (the x channel in the OpenGL world)."""
    sign = -1.0 if flip else 1.0
    return F.transform(plane, lambda v: (F.nanvl(v.cast("double"), F.lit(0.0)) * 2.0 - 1.0) * F.lit(sign))


def filled(plane: Column, h: Column, w: Column, value: float = 1.0) -> Column:
    return F.coalesce(plane, F.array_repeat(F.lit(float(value)), (h * w).cast("int")))


def patchify(stack: Column, h: Column, w: Column, channels: Column, p: int) -> Column:
    """(C, h*w) planes to h/p * w/p patches of p*p*C values, channel fastest."""
    across = F.floor(w / p).cast("int")
    patches = F.sequence(F.lit(0), F.floor(h / p).cast("int") * across - 1)
    inside = F.sequence(F.lit(0), (channels * (p * p) - 1).cast("int"))

    def patch(k: Column) -> Column:
        top = F.floor(k / across).cast("int") * p
        left = (k % across) * p

        def value(j: Column) -> Column:
            cell = F.floor(j / channels).cast("int")
            row = top + F.floor(cell / p).cast("int")
            return at(F.get(stack, (j % channels).cast("int")), row * w + left + cell % p)

        return F.transform(inside, value)

    return F.transform(patches, patch)


def unpatchify(patches: Column, h: Column, w: Column, channels: Column, p: int) -> Column:
    """Inverse of patchify: back to (C, h*w) planes."""
    across = F.floor(w / p).cast("int")
    pixels = F.sequence(F.lit(0), (h * w - 1).cast("int"))

    def plane(c: Column) -> Column:
        def value(i: Column) -> Column:
            y, x = F.floor(i / w).cast("int"), (i % w).cast("int")
            k = F.floor(y / p).cast("int") * across + F.floor(x / p).cast("int")
            return at(F.get(patches, k.cast("int")), ((y % p) * p + x % p) * channels + c)

        return F.transform(pixels, value)

    return F.transform(F.sequence(F.lit(0), (channels - 1).cast("int")), plane)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def psnr_of(mse: Column) -> Column:
    """-10 log10(mse); identical planes score +infinity."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(F.lit(-10.0) * F.log10(mse))
