"""Approximate nearest neighbours by cross-polytope hashing.

Vectors become unit vectors, are turned by fast pseudo-rotations (signs, then a Hadamard transform, three times) and
belong to the signed axis nearest to them. A query looks into the axes nearest to it in several tables; all that is
found there is compared exactly.

Vectors move once for each group of queries that looks at any of their axes, not once for each table: rows are stored
in blocks of like axes, and a directory of the axes of each block tells which blocks a group of queries has to meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viewloom.llm.common import quoted, stored

TABLES, PROBES, SEED, TOP = 32, 4, 42, 20
#: Probes of a table that a query starts with; it looks further if the last of them still found something.
FIRST = 2
#: Rows of a block, and queries that meet it in one task.
BLOCK, QUERIES = 4096, 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; their length is a power of two."""
    n, width, half = len(x), x.shape[1], 1
    while half < width:
        x = x.reshape(n, -1, 2, half)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2)
        half *= 2
    return x.reshape(n, width) / math.sqrt(width)


def rotated(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    signs = np.random.default_rng([seed, table, x.shape[1]])
    for _ in range(3):
        x = hadamard(x * signs.choice([-1.0, 1.0], x.shape[1]))
    return x


def axes(x: np.ndarray, most: int) -> np.ndarray:
    """For each row the ``most`` nearest signed axes, nearest first; axis k is 2k, its opposite 2k + 1."""
    both = np.stack((x, -x), axis=2).reshape(len(x), -1)
    if most == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :most]


def unit(x: np.ndarray, longest: float | None) -> np.ndarray:
    """Unit vectors of which the angles order inner products, in a power of two of dimensions.

    Candidates get one more dimension that fills them up to the ``longest``; queries (None) are scaled, since the
    length of a query does not change its order.
    """
    width = 1 << x.shape[1].bit_length()
    out = np.zeros((len(x), width))
    length = np.sqrt((x * x).sum(axis=1))
    if longest is None:
        out[:, : x.shape[1]] = x / length[:, None]
    else:
        out[:, : x.shape[1]] = x / longest
        out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (length / longest) ** 2))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first dimension to the last: equal vectors have equal products."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _nearest(q: np.ndarray, base_ids: np.ndarray, base: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``top`` best of the base for one query, nearest first.

    A matrix product chooses generously, exact products decide. Rows that repeat id and score count once.
    """
    rough = base @ q
    chosen = np.arange(len(base))
    if len(base) > top:
        edge = np.partition(rough, len(base) - top)[len(base) - top]
        slack = 1e-9 * np.sqrt((q * q).sum()) * np.sqrt((base * base).sum(axis=1).max())
        chosen = np.flatnonzero(rough >= edge - slack)
    exact = products(np.broadcast_to(q, (len(chosen), len(q))), base[chosen])
    order = np.lexsort((base_ids[chosen], -exact))
    chosen, exact = chosen[order], exact[order]
    again = np.concatenate(([False], (np.diff(exact) == 0) & (np.diff(base_ids[chosen]) == 0)))[: len(chosen)]
    return chosen[~again][:top], exact[~again][:top]


def nearest_probe(looks: np.ndarray, axis: np.ndarray, axes_each: int) -> np.ndarray:
    """For each query and row the least place, in any table, of the row's axis in the query's list (their length if none).

    ``looks`` has queries x tables x axes, nearest first; ``axis`` rows x tables.
    """
    queries, tables, most = looks.shape
    kind = np.uint8 if most < 256 else np.uint16
    out = np.full((queries, len(axis)), most, kind)
    at, places = np.arange(queries)[:, None], np.arange(most, dtype=kind)[None, :]
    for t in range(tables):
        place = np.full((queries, axes_each), most, kind)
        place[at, looks[:, t]] = places
        np.minimum(out, place[:, axis[:, t]], out=out)
    return out


def vectors(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, width)


def valid(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector, width, square, band) of the rows that take part: the square of the length, and its band."""
    rows = embeddings.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # lengths of a band differ by a factor of less than the root of two; 1 is in the middle of its band
    band = F.coalesce(F.floor(F.log2(F.nullif(square, F.lit(0.0))) + 0.5), F.lit(-(1 << 20))).cast("int")
    return rows.withColumn("width", F.size("vector")).withColumn("square", square).withColumn("band", band)


class Plan:
    """How far queries look into each band: its longest vector, and the factor by which their probes are multiplied.

    The best of a query are mostly among the longest vectors, which may be few; so the fewer rows are as long as a
    band's, the more of its axes are looked into.
    """

    def __init__(self, bands: list[tuple[int, int, float, int]], top: int, probes: int):
        self.longest = {(width, band): longest for width, band, longest, _ in bands}
        self.factor: dict[tuple[int, int], float] = {}
        self.probes: dict[int, int] = {}
        self.first: dict[int, int] = {}
        for width in {b[0] for b in bands}:
            own = sorted((b for b in bands if b[0] == width), key=lambda b: -b[1])
            total, seen = sum(b[3] for b in own), 0
            for _, band, _, n in own:
                seen += n
                self.factor[width, band] = total / seen
            # the less rows there are, the farther away are so many of them
            self.probes[width] = int(probes * (1 + 10 * top / total))
            # who asks for all axes wants all rows
            self.first[width] = FIRST if probes < 2 << width.bit_length() else probes

    def reach(self, width: int, band: int, probes: int) -> int:
        return math.ceil(probes * self.factor[width, band])

    def most(self, width: int) -> int:
        wanted = max(math.ceil(self.probes[width] * f) for (w, _), f in self.factor.items() if w == width)
        return min(wanted, 2 << width.bit_length())


def hashed(rows: DataFrame, plan: Plan, every: int, tables: int, seed: int) -> DataFrame:
    """Adds the axis of each row in each table, and for the queries the axes to look into (else null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, bands = batch.column("width").to_numpy(), batch.column("band").to_numpy()
            for width, band in sorted(set(zip(widths.tolist(), bands.tolist()))):
                own = batch.filter(pa.array((widths == width) & (bands == band)))
                x = vectors(own.column("vector"), width)
                stored_as, asked = unit(x, plan.longest[width, band]), unit(x, None)
                asks = own.column("vec_id").to_numpy() % every == 0
                axis = np.stack([axes(rotated(stored_as, t, seed), 1)[:, 0] for t in range(tables)], axis=1)
                looks: list = [None] * len(x)
                if asks.any():
                    seen = [axes(rotated(asked[asks], t, seed), plan.most(width)).tolist() for t in range(tables)]
                    for k, per_table in zip(np.flatnonzero(asks), zip(*seen)):
                        looks[k] = per_table
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(axis.tolist(), kind), pa.array(looks, pa.list_(kind))],
                    names=["vec_id", "vector", "width", "band", "axis", "looks"],
                )

    fields = "axis array<int>, looks array<array<int>>"
    kind = rows.schema["vector"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, vector {kind}, width int, band int, {fields}")


def _dealt(df: DataFrame, keys: list[str], first, id_col: str, size: int, name: str) -> DataFrame:
    """``df`` with ``name``: parts of at most about twice ``size`` rows with like axes in the first table."""
    rows = df.withColumn("first", first)
    counts = rows.groupBy(*keys, "first").agg(F.count(F.lit(1)).alias("n"))
    # one row for each axis, band and width: bounded by the parameters
    own = W.partitionBy(*keys).orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    small = F.when(F.col("n") <= size, F.col("n")).otherwise(0)
    before = F.coalesce(F.sum(small).over(own), F.lit(0))
    part = F.when(F.col("n") <= size, F.floor(before / size)).otherwise(-1 - F.col("first")).cast("long")
    sizes = stored(counts.select(*keys, "first", part.alias("part"), F.ceil(F.col("n") / size).alias("cuts")), "parts")
    placed = rows.join(F.broadcast(sizes), [*keys, "first"])
    own_part = F.concat_ws(":", *keys, "part", F.pmod(F.xxhash64(id_col), "cuts"))
    return placed.withColumn(name, own_part).drop("first", "part", "cuts")


def _met(base: DataFrame, asks: DataFrame, plan: Plan, top: int, tables: int, stage: int) -> DataFrame:
    """(query_id, found, compared): the best of each block that a query meets, as (score, vec_id, via).

    ``base`` has vec_id, vector, width, band, axis, block; ``asks`` query_id, vector, width, looks, edge, portion.
    Stage 0 looks along the first probes (``via`` 0 for the leading half of them), stage 1 along the others, in bands
    whose vectors are long enough to pass a query's ``edge``; stage 2 looks at all rows.
    """

    def span(width: int, band: int) -> tuple[int, int, int]:
        near, some = plan.reach(width, band, 1), plan.reach(width, band, plan.first[width])
        return (0, near, some) if stage == 0 else (some, some, plan.reach(width, band, plan.probes[width]))

    if stage == 2:
        pairs = asks.select("portion", "width").distinct().join(base.select("block", "width").distinct(), "width")
    else:
        spans = [(w, b, span(w, b)[0], span(w, b)[2]) for w, b in plan.factor]
        spans = F.broadcast(base.sparkSession.createDataFrame(spans, "width int, band int, low int, high int"))
        at = base.select("block", "width", "band", F.posexplode("axis").alias("t", "axis")).distinct()
        look = asks.select("portion", "width", F.posexplode("looks").alias("t", "l"))
        look = look.select("portion", "width", "t", F.posexplode("l").alias("k", "axis"))
        look = look.groupBy("portion", "width", "t", "axis").agg(F.min("k").alias("least"), F.max("k").alias("last"))
        at = at.join(spans, ["width", "band"])
        pairs = look.join(at, ["width", "t", "axis"]).where("least < high AND last >= low").select("portion", "block").distinct()
    pairs = stored(pairs.select("portion", "block"), "meetings")
    kind = base.schema["vector"].dataType.simpleString()
    rows = base.join(pairs, "block").select("portion", "block", "width", "band", F.col("vec_id").alias("id"), "vector", "axis")
    asked = asks.select("portion", F.col("query_id").alias("id"), "vector", "looks", "edge").join(pairs, "portion")
    both = rows.withColumns({"looks": F.lit(None).cast("array<array<int>>"), "edge": F.lit(None).cast("double")}).unionByName(
        asked.withColumns({"width": F.lit(None).cast("int"), "band": F.lit(None).cast("int"), "axis": F.lit(None).cast("array<int>")}).select(
            "portion", "block", "width", "band", "id", F.col("vector").cast(kind).alias("vector"), "axis", "looks", "edge"
        )
    )

    def meet(group: pa.Table) -> pa.Table:
        here = group.column("band").is_valid().to_numpy()
        own, asking = group.filter(pa.array(here)), group.filter(pa.array(~here))
        ids, scores, near, via, ends, compared = [], [], [], [], [0], []
        if len(own) and len(asking):
            width, band = own.column("width")[0].as_py(), own.column("band")[0].as_py()
            base_ids, x = own.column("id").to_numpy(), vectors(own.column("vector").combine_chunks(), width)
            q = vectors(asking.column("vector").combine_chunks(), width)
            axis = vectors(own.column("axis").combine_chunks(), tables).astype(np.int64)
            low, middle, high = span(width, band)
            longest = plan.longest[width, band]
            edges = asking.column("edge").to_pylist()
            probe = None
            for k, own_id in enumerate(asking.column("id").to_pylist()):
                if stage < 2 and k % 256 == 0:
                    looks = asking.column("looks").slice(k, 256).combine_chunks()
                    looks = vectors(looks.flatten(), plan.most(width)).astype(np.int64).reshape(len(looks), tables, -1)
                    probe = nearest_probe(looks, axis, 2 << width.bit_length())
                if edges[k] is not None and np.sqrt((q[k] * q[k]).sum()) * longest * (1 + 1e-9) < edges[k]:
                    continue
                if stage == 2:
                    leading = seen = np.ones(len(x), bool)
                else:
                    own_probe = probe[k % 256]
                    leading, seen = own_probe < middle, own_probe < high
                    if stage == 1:
                        seen &= own_probe >= low
                place = np.flatnonzero(seen & (base_ids != own_id))
                if len(place):
                    best, exact = _nearest(q[k], base_ids[place], x[place], top)
                    ids.append(own_id)
                    compared.append(len(place))
                    scores.append(exact)
                    near.append(base_ids[place[best]])
                    via.append((~leading[place[best]]).astype(np.int32))
                    ends.append(ends[-1] + len(best))
        joined = [np.concatenate(c) if c else np.empty(0) for c in (scores, near, via)]
        pairs = pa.StructArray.from_arrays(
            [pa.array(joined[0], pa.float64()), pa.array(joined[1].astype(np.int64)), pa.array(joined[2].astype(np.int32))],
            names=["score", "vec_id", "via"],
        )
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        return pa.table([pa.array(ids, pa.int64()), found, pa.array(compared, pa.int64())], names=["query_id", "found", "compared"])

    fields = "query_id long, found array<struct<score: double, vec_id: long, via: int>>, compared long"
    return both.groupBy("portion", "block").applyInArrow(meet, fields)


def _best(found: DataFrame, top: int) -> DataFrame:
    """(query_id, found, compared): the ``top`` best over all blocks."""
    ranked = F.transform("found", lambda x: F.struct((-x["score"]).alias("down"), x["vec_id"], x["via"], x["score"]))
    merged = found.select("query_id", ranked.alias("found"), "compared").groupBy("query_id")
    merged = merged.agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("f"), F.sum("compared").alias("compared"))
    kept = F.transform("f", lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"), x["via"].alias("via")))
    return merged.select("query_id", F.slice(kept, 1, top).alias("found"), "compared")


def search(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    top: int = TOP,
    tables: int = TABLES,
    probes: int = PROBES,
    seed: int = SEED,
    compared_col: str | None = None,
) -> DataFrame:
    """For each row whose id is divisible by ``every``, the ``top`` other rows with the largest inner product found.

    Result: query_id, rank (from 1), vec_id, score (inner product of the original vectors in double precision),
    nearest first, ties to the smaller vec_id, and on request ``compared_col`` (with how many rows the query was compared).
    All candidates that share an axis with a probe are compared exactly, each once; a query that found fewer than
    ``top`` looks at every row then, so it gets all candidates if there are fewer than ``top``.

    Rows take no part if the id is null or the vector is null, zero, or holds null or non-finite components. Vectors
    of different lengths are not compared. Rows that repeat id and vector count once; rows of one id are never
    neighbours of each other, and a query id of several vectors stands for the least of them. Of one vector only the
    ``top`` + 1 smallest ids can be found, so no others are looked at. Other columns are not read, whatever they are
    called. No row gives no row.

    Every row is hashed once and stored with its axes; nothing is fitted but the number of rows and the longest vector
    of each band of similar lengths (see ``Plan``). A query looks along its first probes of all tables and bands. If
    the later ones of these still gave some of its best, it looks along the others, up to ``probes`` of a table.
    """
    valid_rows = valid(embeddings, id_col, vector_col).dropDuplicates(["vec_id", "vector"])
    copies = W.partitionBy("vector").orderBy("vec_id")
    rows = valid_rows.withColumn("copy", F.row_number().over(copies)).where((F.col("copy") <= top + 1) | (F.col("vec_id") % every == 0))
    lengths = rows.where(F.col("copy") <= top + 1).groupBy("width", "band")
    lengths = lengths.agg(F.sqrt(F.max("square")).alias("longest"), F.count(F.lit(1)).alias("n")).collect()
    if not lengths:
        best = rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("r"), "vec_id", F.col("square").alias("score"), F.col("vec_id").alias("compared"))
        return _ranked(best, compared_col)
    plan = Plan([tuple(r) for r in lengths], top, probes)
    kept = stored(rows.select("vec_id", "vector", "width", "band", "copy"), "vectors")
    places = kept.where(F.col("copy") <= top + 1).drop("copy")
    queries = kept.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"))
    queries = queries.agg(F.min(F.struct("vector", "width", "band")).alias("q")).select(F.col("query_id").alias("vec_id"), "q.*")
    base = stored(hashed(places, plan, 1 << 62, tables, seed).drop("looks"), "hashed")
    base = _dealt(base, ["width", "band"], F.get("axis", 0), "vec_id", BLOCK, "block")
    asks = hashed(queries, plan, 1, tables, seed).withColumnRenamed("vec_id", "query_id")
    asks = stored(asks.select("query_id", "vector", "width", "looks", F.lit(None).cast("double").alias("edge")), "queries")
    asks = _dealt(asks, ["width"], F.get(F.get("looks", 0), 0), "query_id", QUERIES, "portion")

    first = stored(_best(_met(base, asks, plan, top, tables, 0), top), "found")
    settled = (F.size("found") >= top) & F.forall("found", lambda x: x["via"] == 0)
    edge = F.when(F.size("found") >= top, F.get("found", top - 1)["score"]).alias("edge")
    more = asks.drop("edge").join(first.where(~settled).select("query_id", edge), "query_id")
    more = more.unionByName(asks.join(first, "query_id", "left_anti"))
    second = _met(base, more, plan, top, tables, 1)
    best = stored(_best(first.unionByName(second), top), "found")
    enough = best.where(F.size("found") >= top)
    missing = asks.join(enough, "query_id", "left_anti")
    best = enough.unionByName(_best(_met(base, missing, plan, top, tables, 2), top))
    best = best.select("query_id", F.posexplode("found").alias("r", "f"), "compared")
    return _ranked(best.select("query_id", (F.col("r") + 1).alias("r"), "f.vec_id", "f.score", "compared"), compared_col)


def _ranked(best: DataFrame, compared_col: str | None) -> DataFrame:
    more = [F.col("compared").alias(compared_col)] if compared_col else []
    return best.select("query_id", F.col("r").alias("rank"), "vec_id", "score", *more)
