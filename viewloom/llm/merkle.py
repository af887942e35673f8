"""A Merkle manifest of a table, by time-forward processing.

The leaves of a group are numbered and cut into blocks of ``FANOUT ** HEIGHT``. In each block the nodes are handled in
the order of their labels (level, place); a queue ordered by label brings each node the digests of its children. What
a block cannot consume, the digest of its top, is a message to a block of the next round, and Spark's sorted shuffle
of these messages is the queue's external part. When only roots are left, rounds run backwards: each block gets the
proof of its top, and a queue in reversed order brings each node the part of the proof that its parent knows already.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from viewloom.llm.common import ascii_lower, fresh, quoted, stored

FANOUT = 8
#: Levels that a task goes up in one round: a block has at most FANOUT ** HEIGHT nodes at its bottom.
HEIGHT = 4
BATCH = 1 << 14

CONTENT = ("doc_id", "source", "lang", "n_chars", "text")
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
_PROOF = "array<struct<before string, after string>>"
_NODE = "grp string, at long, of long, digest string"


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 over all values: a dash for null, else the UTF-8 length, a colon and the value."""

    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(told, values)), 256)


def levels_for(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def climb(digests: Sequence[str], levels: int) -> list[list[str]]:
    """The digests of a block, level by level from its bottom, each node hashed when its label comes up."""
    out = [list(digests), *([] for _ in range(levels))]
    queue = [((1, k // FANOUT), k, d) for k, d in enumerate(digests)] if levels else []
    heapq.heapify(queue)
    while queue:
        label, children = queue[0][0], []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        level, place = label
        own = digest(children)
        out[level].append(own)
        if level < levels:
            heapq.heappush(queue, ((level + 1, place // FANOUT), place, own))
    return out


def descend(nodes: list[list[str]], above: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The proof of each node at the bottom of a block: the siblings before and after it, up to the root.

    ``above`` is the proof of the block's top. The queue hands a parent's proof to its children, the top first.
    """
    top = len(nodes) - 1
    queue, out = [((-top, 0), above)], [None] * len(nodes[0])
    while queue:
        (level, place), proof = heapq.heappop(queue)
        level = -level
        if not level:
            out[place] = proof
            continue
        first = place * FANOUT
        own = nodes[level - 1][first : first + FANOUT]
        for k in range(len(own)):
            heapq.heappush(queue, ((1 - level, first + k), [("".join(own[:k]), "".join(own[k + 1 :])), *proof]))
    return out


def fold(leaf: str, proof: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in proof:
        leaf = digest((before, leaf, after))
    return leaf


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``at`` (place in the group, from 0) and ``of`` (rows of the group); null sorts first.

    Rows are range-partitioned and counted in their order, so that no group goes to one task.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    told = StructType([*rows.schema.fields, StructField("part", LongType()), StructField("seq", LongType())])
    place = rows.columns.index(group)

    def run(batches):
        last, seq = None, 0
        for batch in batches:
            values = batch.column(place).to_pylist()
            own = []
            for value in values:
                seq = seq + 1 if last is not None and last[0] == value else 0
                last = (value,)
                own.append(seq)
            part = batch.column(len(told) - 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(told) - 2], part, pa.array(own, pa.int64())], names=told.names)

    dealt = rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id().cast("long"))
    dealt = stored(dealt.sortWithinPartitions(*keys).mapInArrow(run, told), "numbered")
    counts = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    # one row for each partition and group that meet: partitions and groups at most
    own = W.partitionBy(group)
    before = own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("g"),
        F.col("part").alias("p"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(own).alias("of"),
    )
    joined = dealt.join(offsets, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g")))
    return joined.select(*rows.columns, (F.col("seq") + F.col("offset")).alias("at"), "of")


def _blocks(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[list[dict]]:
    """The rows of each block; they stand together in their order."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[k] for k in keys)
            if own != key:
                if held:
                    yield held
                held, key = [], own
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[dict], schema: StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind, made = to_arrow_schema(schema), []
    for row in rows:
        made.append(row)
        if len(made) >= BATCH:
            yield pa.RecordBatch.from_pylist(made, schema=kind)
            made = []
    if made:
        yield pa.RecordBatch.from_pylist(made, schema=kind)


def _dealt(nodes: DataFrame) -> DataFrame:
    """Nodes by block, in their order."""
    size = FANOUT**HEIGHT
    block = nodes.withColumn("block", F.floor(F.col("at") / size).cast("long"))
    return block.repartition("grp", "block").sortWithinPartitions("grp", "block", "kind", "at")


def _up(nodes: DataFrame) -> DataFrame:
    """(grp, at, of, digest): the tops of all blocks, numbered; a group of one node stays as it is."""
    schema = StructType.fromDDL(_NODE)

    def run(batches):
        def tops():
            for rows in _blocks(batches, ("grp", "block")):
                n = rows[0]["of"]
                levels = min(levels_for(n), HEIGHT)
                top = climb([r["digest"] for r in rows], levels)[-1][0]
                yield {"grp": rows[0]["grp"], "at": rows[0]["block"], "of": -(-n // FANOUT**HEIGHT), "digest": top}

        yield from _batches(tops(), schema)

    lean = nodes.select("grp", "at", "of", "digest", F.lit(1).alias("kind"))
    return _dealt(lean).mapInArrow(run, schema)


def _down(nodes: DataFrame, tops: DataFrame, keep: StructType) -> DataFrame:
    """``keep`` columns of all nodes, with ``proof`` and what else ``tops`` (grp, at, proof, subroot, root) say.

    A block's top comes to the task of its nodes as one more row, ahead of them.
    """
    proof = StructType.fromDDL(f"proof {_PROOF}, subroot string, root string")
    schema = StructType([*keep.fields, *proof.fields])
    names, size = keep.names, FANOUT**HEIGHT

    def run(batches):
        def proved():
            for top, *rows in _blocks(batches, ("grp", "block")):
                levels = min(levels_for(rows[0]["of"]), HEIGHT)
                above = [(p["before"], p["after"]) for p in top["proof"]]
                for row, own in zip(rows, descend(climb([r["digest"] for r in rows], levels), above)):
                    told = [{"before": b, "after": a} for b, a in own]
                    yield {k: row[k] for k in names} | {"proof": told, "subroot": top["subroot"], "root": top["root"]}

        yield from _batches(proved(), schema)

    own = nodes.select("*", F.lit(1).alias("kind"))
    first = tops.select("grp", (F.col("at") * size).alias("at"), "proof", "subroot", "root", F.lit(0).alias("kind"))
    return _dealt(own.unionByName(first, allowMissingColumns=True)).mapInArrow(run, schema)


def _forest(leaves: DataFrame) -> list[DataFrame]:
    """The rounds of nodes (grp, at, of, digest) from ``leaves`` up to the roots of all groups."""
    rounds = [leaves]
    most = leaves.agg(F.max("of")).first()[0] or 0
    while most > 1:
        rounds.append(stored(_up(rounds[-1]), "tops"))
        most = -(-most // FANOUT**HEIGHT)
    return rounds


def _lowered(rounds: list[DataFrame], tops: DataFrame, keep: StructType) -> DataFrame:
    """Proofs for the lowest of ``rounds``, from those of its roots."""
    for nodes in reversed(rounds[1:-1]):
        tops = stored(_down(nodes, tops, StructType.fromDDL(_NODE)), "proofs")
    return _down(rounds[0], tops, keep)


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    content: Sequence[str] = CONTENT,
    tampered: dict[str, Column] | None = None,
) -> DataFrame:
    """The Merkle proof of every row; one row for each input row.

    Result: doc_id, lang (the group), leaf (digest of ``content``), other (the leaf with the values ``tampered``
    instead, or null if none are given), proof (siblings before and after, level by level up to the root), subroot (of
    the group) and root. Leaves of a group ascend by id, null first, then by digest; every ``FANOUT`` consecutive nodes
    become one until one remains. The subroots ascend by group, null first, and give the root in the same way. Null
    values have a mark of their own, so that null and empty differ; rows that repeat are leaves of their own. No row
    gives no row. Columns that are not named are not read, whatever they are called.
    """
    tampered = tampered or {}
    fields = [quoted(c) for c in content]
    changed = [tampered.get(c, quoted(c)) for c in content]
    leaves = docs.select(
        quoted(id_col).alias("doc_id"),
        quoted(group_col).cast("string").alias("lang"),
        leaf_digest(fields).alias("leaf"),
        (leaf_digest(changed) if tampered else F.lit(None).cast("string")).alias("other"),
    )
    leaves = numbered(stored(leaves, "leaves"), "lang", ["doc_id", "leaf", "other"])
    # a null group is told from all others by its first letter
    named = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    leaves = stored(leaves.select("*", named.alias("grp"), F.col("leaf").alias("digest")), "places")
    rounds = _forest(leaves)
    roots = rounds[-1].select(F.col("grp").alias("own"), F.col("digest").alias("subroot"))
    roots = numbered(stored(roots.withColumn("all", F.lit("all")), "roots"), "all", ["own"])
    roots = stored(roots.select("own", F.lit("all").alias("grp"), "at", "of", F.col("subroot").alias("digest")), "roots")
    upper = _forest(roots)
    if len(upper) == 1:  # one group or none
        root = roots.select("own", F.col("digest").alias("subroot"), F.lit(None).cast(_PROOF).alias("proof"), F.col("digest").alias("root"))
    else:
        top = upper[-1].select("grp", "at", F.array().cast(_PROOF).alias("proof"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
        keep = StructType([StructField("own", StringType()), StructField("digest", StringType())])
        root = _lowered(upper, top, keep).select("own", F.col("digest").alias("subroot"), "proof", "root")
    tops = root.select(F.col("own").alias("grp"), F.lit(0).cast("long").alias("at"), F.coalesce("proof", F.array().cast(_PROOF)).alias("proof"), "subroot", "root")
    keep = StructType([leaves.schema[c] for c in ("doc_id", "lang", "leaf", "other")])
    if len(rounds) == 1:  # every group has one leaf
        return leaves.join(tops.drop("at"), "grp").select(*keep.names, "proof", "subroot", "root")
    return _lowered(rounds, stored(tops, "proofs"), keep)


def verified(found: DataFrame) -> DataFrame:
    """``found`` with proof_sha256 (digest of all siblings, from the leaf up), folded_root and verified.

    The fold starts from ``other`` where that is given, else from ``leaf``; ``verified`` says whether it gives the root.
    """
    proof, folded, same = fresh(found, "proof_sha256", "folded_root", "verified")
    own = F.coalesce("other", "leaf")
    siblings = F.array_join(F.transform("proof", lambda p: F.concat(p["before"], p["after"])), "")
    up = F.aggregate("proof", own, lambda a, p: F.sha2(F.concat(p["before"], a, p["after"]), 256))
    out = found.withColumns({proof: F.sha2(siblings, 256), folded: up})
    return out.withColumn(same, F.col(folded) == F.col("root"))


def tampered_text(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text in lower case (A-Z) where 3 divides the CRC-32 of the decimal id, else as it is; null stays."""
    text = quoted(text_col)
    hit = F.crc32(quoted(id_col).cast("string")) % 3 == 0
    return F.when(hit, ascii_lower(text)).otherwise(text)
