"""Reproducible randomness: every draw is a pure function of (seed, key).

A lost task that is run again makes the same choice, and any SQL engine with
md5 can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_draw(seed: int | Column, *parts: Column | str) -> Column:
    """32 hex digits, uniform; also the sort key of a random order."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", first.cast("string"), *[c.cast("string") for c in columns]).cast("binary"))


def unit_draw(hex_digits: Column) -> Column:
    """52 bits of a hex draw as a double in [0, 1)."""
    return F.conv(F.substring(hex_digits, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
