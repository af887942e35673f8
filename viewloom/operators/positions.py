"""Row numbers over a whole table without a single-task window.

``row_number() OVER (ORDER BY key)`` sends every row to one task.  Here the key
range is cut into buckets first; rows are numbered inside their bucket and the
bucket's offset is added.  A bucket is a pure function of the row's key, so a
stage that runs again after an executor is lost assigns the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Sampled bucketing: 1023 boundaries out of a sample of about 8 keys per bucket.
BOUNDARIES = 1023
OVERSAMPLE = 8


def _sampled_bucket(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Adds ``_bucket``: how many of the sampled boundaries lie below the key.

    The keys with the smallest hashes are the sample: its size is fixed whatever
    the size of the table, and it is the same whenever it is computed.
    """
    key = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)
    # the keys with the smallest hashes: every task hands over so many at most
    chosen = df.select(key.alias("k")).orderBy(F.xxhash64(*order_by)).limit((BOUNDARIES + 1) * OVERSAMPLE)
    sample = chosen.agg(F.sort_array(F.collect_list("k")).alias("keys"))
    boundaries = sample.select(
        F.transform(
            F.sequence(F.lit(1), F.lit(BOUNDARIES)),
            # a small table has a short sample: spread the boundaries over it
            lambda i: F.get("keys", F.floor(i * F.size("keys") / (BOUNDARIES + 1)).cast("int")),
        )
    ).scalar()
    out = df.withColumns({"_boundaries": boundaries, "_bucket": F.lit(0)})
    # binary search as plain projections: they compile, a lambda does not
    for bit in reversed(range(BOUNDARIES.bit_length())):
        step = 1 << bit
        below = F.get("_boundaries", F.col("_bucket") + (step - 1)) < key
        out = out.withColumn("_bucket", F.col("_bucket") + F.when(below, F.lit(step)).otherwise(F.lit(0)))
    return out.drop("_boundaries")


def with_position(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    name: str = "pos",
    total: str | None = None,
    hex_key: str | None = None,
    hex_digits: int = 3,
) -> DataFrame:
    """Adds the 0-based position of each row in the order of ``order_by``.

    ``order_by`` must be unique within ``partition_by``.  ``total`` also adds the
    number of rows of the partition.  When the order starts with a column of
    uniform hex digits (an md5 draw), name it as ``hex_key``: its leading digits
    are the buckets and no sample is taken.
    """
    if hex_key is not None:
        bucketed = df.withColumn("_bucket", F.substring(F.col(hex_key), 1, hex_digits))
    else:
        bucketed = _sampled_bucket(df, order_by)
    keys = ["_bucket"]
    if partition_by:
        # a struct: equal even where a column is NULL
        bucketed = bucketed.withColumn("_part", F.struct(*partition_by))
        keys = ["_part", "_bucket"]
    counts = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # One row per bucket: the only window that is not split is this small one.
    within = W.partitionBy("_part") if partition_by else W.partitionBy(F.lit(0))
    before = within.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(within).alias("_total"),
    )
    if not partition_by:
        # as many rows as there are buckets: at most 16^hex_digits or BOUNDARIES + 1
        offsets = F.broadcast(offsets)
    # the join and the window ask for the same distribution: the rows move once
    joined = bucketed.join(offsets, keys)
    numbered = joined.withColumn(
        name,
        F.col("_offset") + F.row_number().over(W.partitionBy(*keys).orderBy(*order_by)) - 1,
    )
    if total is not None:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop("_part", "_bucket", "_offset", "_total")
