"""Mixing sources to target weights by a temperature on their token shares.

A source's weight is its token share to the power of an exponent between 0 (all alike) and 1 (as they are). The
exponent is bisected until the weights are as even as asked for, or a small source would be repeated too often.
The weights are then realised as passes over each source: whole passes, and part of one that fits the token budget,
each a permutation in blocks.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewloom.llm.common import fresh, quoted
from viewloom.session import scratch_path

EVENNESS, MAX_REPEATS, SEED = 0.9, 2.0, 42
#: Points at which one pass over the sources evaluates the exponent, and passes.
POINTS, ROUNDS = 15, 8
#: Sources of which the plan is sent to every task; more are joined.
BROADCAST_SOURCES = 100_000


class Mixture(NamedTuple):
    """The exponent, the number of sources with tokens, and their most tokens and sum of weights before scaling."""

    exponent: float
    sources: int
    largest: float
    budget: float


def words_of(text_col: str) -> Column:
    """A cheap measure of tokens: the words between white space."""
    return F.regexp_count(F.coalesce(quoted(text_col).cast("string"), F.lit("")), F.lit(r"\S+")).cast("long")


def _evaluate(totals: DataFrame, largest: float, budget: float | None, exponents: list[float]):
    """(evenness, most repeats) of each exponent, in one aggregation over the sources."""
    share = F.col("tokens") / largest
    columns = []
    for k, a in enumerate(exponents):
        w = F.pow(share, F.lit(a))
        columns += [
            F.sum(w).alias(f"z{k}"), F.sum(w * F.log(share)).alias(f"l{k}"), F.max(F.pow(share, F.lit(a - 1))).alias(f"r{k}"),
        ]
    row = totals.agg(F.count(F.lit(1)).alias("n"), *columns).first()
    out = []
    for k, a in enumerate(exponents):
        z, weighted_log, repeats = row[f"z{k}"], row[f"l{k}"], row[f"r{k}"]
        entropy = math.log(z) - a * weighted_log / z
        scale = 1.0 if budget is None else budget / (z * largest)
        out.append((entropy / math.log(row["n"]) if row["n"] > 1 else 1.0, repeats * scale))
    return out


def choose_exponent(
    totals: DataFrame, budget: float | None, evenness: float | None, max_repeats: float | None
) -> Mixture:
    """Bisects the exponent, many points at a time, over sources (source, tokens > 0) of any number."""
    row = totals.agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("m")).first()
    if not row["n"]:
        return Mixture(1.0, 0, 0.0, 0.0)
    largest = float(row["m"])

    def least(meets) -> float:
        """The least exponent that meets a condition which holds from some exponent on; 1 if none does."""
        low, high = 0.0, 1.0
        if meets(_evaluate(totals, largest, budget, [0.0])[0]):
            return 0.0
        for _ in range(ROUNDS):
            points = [low + (high - low) * (k + 1) / (POINTS + 1) for k in range(POINTS)]
            found = _evaluate(totals, largest, budget, points)
            first = next((k for k, x in enumerate(found) if meets(x)), POINTS)
            low, high = (points[first - 1] if first else low), (points[first] if first < POINTS else high)
        return high

    # evenness falls and repeats fall as the exponent grows; sources more even than asked for keep their shares
    unbound = 1.0 if max_repeats is None else 0.0
    flat = unbound if evenness is None else least(lambda x: x[0] <= evenness)
    rare = 0.0 if max_repeats is None else least(lambda x: x[1] <= max_repeats)
    exponent = round(max(flat, rare), 9)
    z = totals.agg(F.sum(F.pow(F.col("tokens") / largest, F.lit(exponent)))).first()[0]
    return Mixture(exponent, row["n"], largest, largest * z if budget is None else float(budget))


def _draw(key: Column, number: Column | int, seed: int) -> Column:
    return F.xxhash64(key, number if isinstance(number, Column) else F.lit(number), F.lit(seed))


def _block(draw: Column, blocks: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(draw, 1), blocks)


def mix_sources(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
    budget: int | None = None,
    evenness: float | None = EVENNESS,
    max_repeats: float | None = MAX_REPEATS,
    seed: int = SEED,
    pass_col: str = "pass",
    block_col: str = "block",
    draw_col: str = "draw",
) -> DataFrame:
    """``docs`` with each source's rows as often as its target weight says, in permuted blocks.

    ``evenness`` is the target entropy of the weights over that of equal weights; sources that are more even already
    stay as they are. ``max_repeats`` limits how often the smallest source is repeated, and wins; alone it asks for
    weights as even as it allows. Without either the shares stay as they are. ``budget`` is the
    number of tokens to give out; by default the least with which every source is passed once, so that no document
    is left out. ``tokens`` measures a row (default: its words).

    Result: all columns of ``docs``, and the pass (from 0), the block and the draw that orders rows in a block: in
    the order of pass, block, draw each source is a permutation, another one in each pass. The part of a pass gives
    rows in this order while their tokens stay within the source's budget; rows that repeat id and text come
    together. Rows without tokens come with each whole pass and each part. A null source is a source of its own; null
    texts are empty; a null id is a value like any other. A source without tokens is passed once. A column of
    ``docs`` that is called like one of the three is replaced. No row gives no row.

    Tokens are measured once and stored as numbers. The number of blocks is the root of a source's rows, so neither
    a list of blocks nor a block grows with a hot source as its rows do. Every choice is a function of the row.
    """
    spark = docs.sparkSession
    path, totals_path = scratch_path(spark, "measured"), scratch_path(spark, "totals")
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(quoted(id_col), text)
    measure = F.greatest(F.lit(0), F.coalesce(tokens, F.lit(0))) if tokens is not None else words_of(text_col)
    docs.select(quoted(source_col).cast("string").alias("source"), key.alias("key"), measure.cast("long").alias("tokens")).write.parquet(path)
    measured = spark.read.parquet(path)
    measured.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).write.parquet(totals_path)
    totals = spark.read.parquet(totals_path)
    mixture = choose_exponent(totals.where("tokens > 0"), budget, evenness, max_repeats)

    # times a source is given out: exactly 1 for the largest if there is no budget
    times = F.pow(F.col("tokens") / F.lit(mixture.largest), F.lit(mixture.exponent - 1))
    if budget is not None and mixture.sources:
        z = totals.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / mixture.largest, F.lit(mixture.exponent)))).first()[0]
        times = times * F.lit(budget / (z * mixture.largest))
    plan = totals.select(
        "source", F.ceil(F.sqrt("rows")).alias("blocks"),
        F.when(F.col("tokens") > 0, F.floor(times)).otherwise(F.lit(1).cast("long")).alias("whole"),
        F.when(F.col("tokens") > 0, F.floor((times - F.floor(times)) * F.col("tokens"))).otherwise(F.lit(0).cast("long")).alias("rest"),
    )
    few = totals.count() <= BROADCAST_SOURCES

    def by_source(left: DataFrame, name: str, right: DataFrame) -> DataFrame:
        return left.join(F.broadcast(right) if few else right, F.col(name).eqNullSafe(F.col("of")), "left").drop("of")

    of_plan = plan.withColumnRenamed("source", "of")
    placed = by_source(measured, "source", of_plan).where("rest > 0")
    placed = placed.withColumn("draw", _draw(F.col("key"), F.col("whole"), seed)).withColumn("block", _block(F.col("draw"), F.col("blocks")))
    sums = placed.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("tokens"))
    line = Window.partitionBy("source").orderBy("block")
    upto = sums.withColumn("upto", F.sum("tokens").over(line)).where("upto > rest")
    # the first block that does not fit whole; of it the draws up to some value fit
    edges = upto.groupBy("source").agg(F.min_by(F.struct("block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room")), "block").alias("e"))
    edges = edges.select(F.col("source").alias("of"), F.col("e.block").alias("edge"), F.col("e.room").alias("room"))
    inside = by_source(placed, "source", edges).where("block = edge")
    peers = Window.partitionBy("source", "block").orderBy("draw")
    fits = inside.withColumn("upto", F.sum("tokens").over(peers)).where("upto <= room")
    last = fits.groupBy("source").agg(F.max("draw").alias("last"))
    edges_path = scratch_path(spark, "edges")
    full_edges = edges.alias("a").join(last.alias("b"), F.col("a.of").eqNullSafe(F.col("b.source")), "left")
    full_edges.select("of", "edge", "last").write.parquet(edges_path)
    edges = spark.read.parquet(edges_path)
    plan = by_source(plan, "source", edges)

    base = docs.select(*(quoted(c) for c in docs.columns if c not in (pass_col, block_col, draw_col)))
    new = (pass_col, block_col, draw_col)
    names = fresh(base, "of", "blocks", "whole", "rest", "edge", "last", "key", "part", also=new)
    of, blocks, whole, rest, edge, last_, own_key, part = names
    plan = plan.toDF(of, blocks, whole, rest, edge, last_)
    joined = base.join(F.broadcast(plan) if few else plan, quoted(source_col).cast("string").eqNullSafe(F.col(of)), "left")
    joined = joined.withColumn(own_key, key)
    joined = joined.withColumn(draw_col, _draw(F.col(own_key), F.col(whole), seed))
    in_block = _block(F.col(draw_col), F.col(blocks))
    takes = (F.col(rest) > 0) & (
        F.col(edge).isNull()
        | (in_block < F.col(edge))
        | ((in_block == F.col(edge)) & F.coalesce(F.col(draw_col) <= F.col(last_), F.lit(False)))
    )
    passes = F.col(whole) + F.when(takes, 1).otherwise(0)
    copies = joined.withColumn(part, passes).where(F.col(part) > 0)
    copies = copies.withColumn(pass_col, F.explode(F.sequence(F.lit(0), F.col(part).cast("int") - 1)))
    copies = copies.withColumn(draw_col, _draw(F.col(own_key), F.col(pass_col).cast("long"), seed))
    copies = copies.withColumn(block_col, _block(F.col(draw_col), F.col(blocks)))
    return copies.select(*map(quoted, base.columns), pass_col, block_col, draw_col)
