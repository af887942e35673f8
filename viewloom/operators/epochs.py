"""Epoch plans: order, shards, batches, chunks.

All of them are arithmetic on one global position per row, so each costs one
shuffle of the key columns; payload columns join afterwards by key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewloom.functions.draws import hex_draw
from viewloom.operators.positions import with_position


#: Pairs of a cell of the request manifest.
CELL = 1 << 20


def _check_shards(n: int) -> None:
    if n <= 0:
        raise ValueError("the number of shards must be positive")


def shard_of(df: DataFrame, shard_id: int, n: int) -> DataFrame:
    """The rows of one shard."""
    _check_shards(n)
    if not 0 <= shard_id < n:
        raise ValueError("the shard id must be in 0..n-1")
    return df.where(F.col("shard") == shard_id)


def assign_shards(files: DataFrame, n: int, seed: int, epoch: int, key: str = "file") -> DataFrame:
    """Rows (files, or samples) in the order of the epoch, dealt to n shards."""
    _check_shards(n)
    drawn = files.withColumn("_h", hex_draw(seed + epoch, F.col(key)))
    placed = with_position(drawn, ["_h", key], name="pos", hex_key="_h").drop("_h")
    return placed.withColumn("shard", F.pmod("pos", F.lit(n)))


def shuffle_rows(df: DataFrame, seed: int, epoch: int, block: int, key: str = "uid", by: Sequence[str] = ("shard",)) -> DataFrame:
    """New order inside each shard in which a row moves less than ``block`` places.

    Rows are numbered by key, cut into blocks, and each block (at most ``block``
    rows) is put in hash order.
    """
    if block <= 1:
        return with_position(df, [key], list(by), name="pos")
    placed = with_position(df, [key], list(by), name="_p").withColumn("_b", F.floor(F.col("_p") / block))
    inside = W.partitionBy(*by, "_b").orderBy(hex_draw(seed, F.lit(epoch), F.col(key)), key)
    return placed.withColumn("pos", F.col("_b") * block + F.row_number().over(inside) - 1).drop("_p", "_b")


def _batched(placed: DataFrame, size: int, pos: Column, total: Column, drop_last: bool) -> DataFrame:
    batch = F.floor(pos / size)
    out = placed.withColumn("batch", batch)
    return out.where((F.col("batch") + 1) * size <= total) if drop_last else out


def assign_batches(df: DataFrame, size: int, drop_last: bool = True, order: str = "pos", total: Column | None = None) -> DataFrame:
    """Consecutive batches of an already positioned table; an incomplete last one is dropped."""
    if total is None:
        total = df.agg(F.count(F.lit(1))).scalar()
    return _batched(df, size, F.col(order), total, drop_last)


def epoch_plan(df: DataFrame, epochs: int, shards: int, size: int, seed: int, key: str = "uid") -> DataFrame:
    """(epoch, shard, batch, place, key) for a finite number of epochs.

    Each epoch has its own order; each shard drops its incomplete last batch.
    """
    _check_shards(shards)
    each = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    drawn = each.withColumn("_h", hex_draw(F.col("epoch") + F.lit(seed), F.col(key)))
    placed = with_position(drawn, ["_h", key], ["epoch"], name="_p", total="_t", hex_key="_h")
    shard = F.pmod("_p", F.lit(shards))
    place = F.floor(F.col("_p") / shards)
    in_shard = F.floor((F.col("_t") - shard + F.lit(shards - 1)) / shards)
    out = placed.withColumns({"shard": shard, "_q": place, "_s": in_shard})
    out = _batched(out, size, F.col("_q"), F.col("_s"), True)
    return out.select("epoch", "shard", "batch", (F.col("_q") % size).alias("place"), key)


def split_even(df: DataFrame, n: int, key: str = "uid") -> DataFrame:
    """Contiguous chunks in key order whose sizes differ by at most one, larger first."""
    _check_shards(n)
    placed = with_position(df, [key], name="_p", total="_t")
    small = F.floor(F.col("_t") / n)
    larger = F.col("_t") % n
    edge = larger * (small + 1)
    # when there are fewer rows than chunks, every row lies before the edge
    worker = F.when(F.col("_p") < edge, F.floor(F.col("_p") / (small + 1))).otherwise(
        larger + F.floor((F.col("_p") - edge) / F.greatest(small, F.lit(1)))
    )
    return placed.withColumn("worker", worker).drop("_p", "_t")


def encode_batches(df: DataFrame, size: int = 128, key: str = "uid") -> DataFrame:
    """Fixed-size batches in key order; the last one may be short."""
    placed = with_position(df, [key], name="_p")
    return placed.withColumns({"batch": F.floor(F.col("_p") / size), "place": F.col("_p") % size}).drop("_p")


def grid(left: int, right: int, cell: int = CELL) -> tuple[int, int]:
    """Rows and columns of blocks for the product of two tables of those sizes.

    A cell has about ``cell`` pairs, and of all such grids this one repeats the
    fewest rows: a row of the left side is sent once for each column, one of the
    right side once for each row.
    """
    cells = max(1, -(-left * right // cell))
    columns = min(max(right, 1), max(1, round(math.sqrt(cells * right / max(left, 1)))))
    rows = min(max(left, 1), -(-cells // columns))
    return rows, min(max(right, 1), -(-cells // rows))


def request_manifest(
    images: DataFrame,
    prompts: DataFrame,
    scales: Sequence[float] = (),
    slots: int = 0,
    image_blocks: int | None = None,
    prompt_blocks: int | None = None,
) -> DataFrame:
    """Every image with every prompt, and optionally every guidance scale and view slot.

    The product is the result itself.  It is built as an equi join on a grid of
    blocks: each image lies in one block row, each prompt in one block column,
    and every grid cell is one join key.  The work splits evenly over the cells
    and neither side has to fit into memory.  Unless it is given, the grid
    follows from the counted sizes of both sides (see ``grid``).
    """
    if image_blocks is None or prompt_blocks is None:
        image_blocks, prompt_blocks = grid(images.count(), prompts.count())
    image_block = F.pmod(F.xxhash64(*images.columns), F.lit(image_blocks)).cast("int")
    prompt_block = F.pmod(F.xxhash64(*prompts.columns), F.lit(prompt_blocks)).cast("int")
    left = images.withColumns(
        {"_i": image_block, "_p": F.explode(F.sequence(F.lit(0), F.lit(prompt_blocks - 1)))}
    )
    right = prompts.withColumns(
        {"_p": prompt_block, "_i": F.explode(F.sequence(F.lit(0), F.lit(image_blocks - 1)))}
    )
    out = left.join(right, ["_i", "_p"]).drop("_i", "_p")
    if scales:
        out = out.withColumn("guidance_scale", F.explode(F.array(*[F.lit(float(s)) for s in sorted(scales)])))
    if slots:
        out = out.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return out
