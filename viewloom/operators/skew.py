"""Equi joins whose big side may hold a third of its rows under one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salts_for(share: float, tasks: int) -> int:
    """Into how many parts a key with a measured ``share`` of the rows must go so that none is larger than a task's."""
    if not 0 <= share <= 1 or tasks < 1:
        raise ValueError("a share is between 0 and 1, and there is at least one task")
    return max(1, -(-int(share * 1_000_000) * tasks // 1_000_000))


def skew_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str] = (),
    how: str = "inner",
    salts: int = 1,
) -> DataFrame:
    """Join ``big`` to ``small`` on ``keys``; each side is read once.

    Adaptive execution splits the partition of a hot key, or broadcasts a small
    side that turns out to be small.  Where it cannot (a later step needs the
    join's partitioning), ask for ``salts`` (see ``salts_for``): the rows of a
    key are then spread by ``spread_by``, which should tell them apart, and the
    small side is repeated once per salt.  ``how`` is inner, left, left_semi or
    left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("a skew join keeps the big side: inner, left, left_semi or left_anti")
    keys = list(keys)
    kinds = dict(big.dtypes)
    like_big = small.withColumns({k: F.col(k).cast(kinds[k]) for k in keys})
    if salts == 1:
        return big.join(like_big, keys, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    repeated = like_big.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
