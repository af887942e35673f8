"""The prefix trie of conversations, as burst tries.

A container holds the suffixes of all conversations below one trie head. A container of more than ``LIMIT``
conversations bursts: its head and the turns that all its suffixes begin with become nodes, and its suffixes go to one
container for each next turn, whatever their number. The containers that remain are sorted and swept into nodes, each
by one task. Texts are left behind at the start: a turn is an id and a size from there on.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import quoted, stored
from viewloom.operators.skew import skew_join

#: Conversations of a container that does not burst.
LIMIT = 512
#: Parts that a large container is dealt over.
SALTS = 16
#: Nodes of an Arrow batch.
BATCH = 1 << 14

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, head string, parent string"
)


def turn_lists(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, ids, sizes): one row for each conversation, with the ids of its turns and the bytes of their texts.

    Turns are ordered by ``turn_col``, null first, and those of one number by their ids; an id is a digest of role and
    text, of which null is empty. Repeated rows are repeated turns. Rows without a conversation are left out. Other
    columns are not read. No row gives no row.
    """
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    told = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(quoted(turn_col).alias("turn"), told.alias("id"), F.octet_length(text).cast("long").alias("size"))
    own = turns.select(quoted(conv_col).cast("long").alias("conv_id"), turn.alias("t")).where("conv_id IS NOT NULL")
    lists = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def regraft(lists: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations c rebuilt: the first h turns of conversation c - c % family, then their own after their first h.

    h is the CRC-32 of the decimal c modulo ``heads``. A conversation without a stem, or with fewer turns than h, may
    have no turns afterwards; it stays.
    """
    stems = lists.where(F.col("conv_id") % family == 0)
    stems = stems.select(F.col("conv_id").alias("stem"), *(F.slice(c, 1, heads).alias(f"stem_{c}") for c in ("ids", "sizes")))
    both = lists.withColumn("stem", F.col("conv_id") - F.col("conv_id") % family).join(stems, "stem", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")

    def grafted(name: str):
        stem = F.coalesce(f"stem_{name}", F.slice(F.col(name), 1, 0))
        return F.concat(F.slice(stem, F.lit(1), h), F.slice(F.col(name), h + 1, F.size(name))).alias(name)

    return both.select("conv_id", grafted("ids"), grafted("sizes"))


def sweep(members: list[tuple[int, list[str], list[int]]], top: int) -> list[list]:
    """The nodes of a container whose head stands at depth ``top``, children first; the last one is its head.

    A node is [conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends].
    """
    members.sort(key=lambda m: (m[1][top:], m[0]))
    out: list[list] = []
    stack: list[dict] = []

    def opened(depth: int, size: int) -> dict:
        return {"depth": depth, "size": size, "n": 0, "least": None, "kids": [], "leaves": 0, "saved": 0, "ends": []}

    def close() -> None:
        own = stack.pop()
        own["leaves"] = own["leaves"] or 1
        own["saved"] += (own["n"] - 1) * own["size"]
        for k in own["kids"]:
            out[k][2] = own["least"]
        ends = hashlib.sha256(",".join(map(str, sorted(own["ends"]))).encode()).hexdigest()
        out.append([own["least"], own["depth"], None, own["n"], len(own["kids"]), own["leaves"], own["saved"], ends])
        if stack:
            up = stack[-1]
            up["kids"].append(len(out) - 1)
            up["n"] += own["n"]
            up["least"] = own["least"] if up["least"] is None else min(up["least"], own["least"])
            up["leaves"] += own["leaves"]
            up["saved"] += own["saved"]

    before: list[str] = []
    for conv, ids, sizes in members:
        common = top
        while common < min(len(ids), len(before)) and ids[common] == before[common]:
            common += 1
        while stack and stack[-1]["depth"] > common:
            close()
        for depth in range(top if not stack else common + 1, len(ids) + 1):
            stack.append(opened(depth, sizes[depth - 1] if depth else 0))
        end = stack[-1]
        end["ends"].append(conv)
        end["n"] += 1
        end["least"] = conv if end["least"] is None else min(end["least"], conv)
        before = ids
    while stack:
        close()
    return out


def _sweep_containers(containers: DataFrame) -> DataFrame:
    """All nodes of the containers; those of container heads carry ``head`` and ``parent``."""
    kinds = containers.sparkSession.createDataFrame([], _NODE).schema
    names = kinds.names

    def run(batches):
        made, held, key = [], [], None

        def flush():
            if held:
                found = sweep([h[:3] for h in held], held[0][3])
                made.extend((*node, None, None) for node in found[:-1])
                made.append((*found[-1], key, held[0][4]))
                held.clear()

        def told():
            arrays = [
                pa.array(column, pa.string() if name in ("ends_sha256", "head", "parent") else pa.int64())
                for name, column in zip(names, zip(*made))
            ]
            made.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "ids", "sizes", "top", "parent", "head")]
            for *row, head in zip(*columns):
                if head != key:
                    flush()
                    key = head
                held.append(row)
            if len(made) >= BATCH:
                yield told()
        flush()
        if made:
            yield told()

    dealt = containers.select("conv_id", "ids", "sizes", "top", "parent", "head").repartition("head")
    return dealt.sortWithinPartitions("head").mapInArrow(run, kinds)


def _ends(ended: DataFrame) -> DataFrame:
    """(head, ends_sha256): the digest of the ids that end at a node, read in their order and never held together."""

    def run(batches):
        key, own, first = None, None, True
        for batch in batches:
            found = []
            for head, conv in zip(batch.column("head").to_pylist(), batch.column("conv_id").to_pylist()):
                if head != key:
                    if own is not None:
                        found.append((key, own.hexdigest()))
                    key, own, first = head, hashlib.sha256(), True
                own.update(str(conv).encode() if first else f",{conv}".encode())
                first = False
            if found:
                yield pa.RecordBatch.from_pylist([{"head": h, "ends_sha256": e} for h, e in found])
        if own is not None:
            yield pa.RecordBatch.from_pylist([{"head": key, "ends_sha256": own.hexdigest()}])

    sorted_rows = ended.select("head", "conv_id").repartition("head").sortWithinPartitions("head", "conv_id")
    return sorted_rows.mapInArrow(run, "head string, ends_sha256 string")


def _burst(own: DataFrame, above: DataFrame | None) -> DataFrame:
    """One row for each container of ``own``, all of which burst.

    ``depth`` is where its suffixes part, ``chain`` has the text sizes of the turns that end at depths ``top`` to
    ``depth``; ``path`` has the heads of all containers above it and its own.
    """
    rest = F.slice(F.col("ids"), F.col("top") + 1, F.size("ids"))
    told = own.groupBy("head").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("least"),
        F.min(rest).alias("lo"),
        F.max(rest).alias("hi"),
        F.first("parent").alias("parent"),
        F.first("top").alias("top"),
    )
    alike = F.transform(F.arrays_zip("lo", "hi"), lambda z: z["lo"].eqNullSafe(z["hi"]))
    parted = F.array_position(alike, False).cast("int")
    told = told.withColumn("depth", F.col("top") + F.when(parted > 0, parted - 1).otherwise(F.size("lo"))).drop("lo", "hi")
    # the sizes of one member are those of all
    sizes = own.groupBy("head").agg(F.min_by(F.struct("sizes", "top"), "conv_id").alias("any")).withColumnRenamed("head", "h")
    told = told.join(sizes, F.col("head") == F.col("h")).drop("h")
    first = F.when(F.col("top") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.slice("any.sizes", F.greatest("top", F.lit(1)), F.lit(1)))
    chain = F.concat(first, F.slice(F.col("any.sizes"), F.col("top") + 1, F.col("depth") - F.col("top")))
    told = told.withColumn("chain", chain).drop("any")
    if above is None:
        return told.withColumn("path", F.array("head"))
    paths = above.select(F.col("head").alias("parent"), F.col("path").alias("up"))
    return told.join(paths, "parent").withColumn("path", F.concat("up", F.array("head"))).drop("up")


def prefix_trie(lists: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of all conversations (conv_id, ids, sizes).

    A node is a distinct sequence of first turns; all conversations that start with it are its members. Result:
    conv_id (its smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves
    (childless nodes below it, itself included), saved_tokens (over its subtree, members but one times the size of the
    node's last turn), ends_sha256 (of the members that end at it, ascending, comma-joined). Conversations without
    turns are members of the root alone. No conversation gives no node.

    The turn ids of one conversation are held by one task (32 bytes a turn), and so are those of a container of at most
    ``limit`` conversations. Rounds: one for each place at which a container of more than ``limit`` parts.
    """
    rows = lists.select(
        "conv_id", "ids", "sizes", F.lit(0).alias("top"), F.lit("").alias("head"), F.lit(None).cast("string").alias("parent")
    )
    small, bursts, ended = [], [], []
    while True:
        rows = stored(rows, "open")
        heavy = stored(rows.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("head"), "heavy")
        if heavy.isEmpty():
            small.append(rows)
            break
        small.append(skew_join(rows, heavy, ["head"], ["conv_id"], "left_anti", SALTS))
        own = skew_join(rows, heavy, ["head"], ["conv_id"], "left_semi", SALTS)
        bursts.append(stored(_burst(own, bursts[-1] if bursts else None), "bursts"))
        own = skew_join(own, bursts[-1].select("head", "depth"), ["head"], ["conv_id"], "inner", SALTS)
        ended.append(own.where(F.size("ids") == F.col("depth")).select("head", "conv_id"))
        below = F.md5(F.concat_ws(":", "head", "depth", F.get("ids", F.col("depth"))))
        rows = own.where(F.size("ids") > F.col("depth"))
        rows = rows.select("conv_id", "ids", "sizes", F.col("depth").alias("top"), below.alias("head"), F.col("head").alias("parent"))
        rows = rows.withColumn("top", F.col("top") + 1)
    swept = stored(_sweep_containers(reduce(DataFrame.unionByName, small)), "swept")
    inner = swept.where("head IS NULL").select(*COLUMNS)
    heads = swept.where("head IS NOT NULL")
    if not bursts:
        return inner.union(heads.select(*COLUMNS))

    burst = reduce(DataFrame.unionByName, bursts)
    kids = heads.select("parent").union(burst.where("parent IS NOT NULL").select("parent"))
    kids = kids.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "head")
    burst = burst.join(kids, "head", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    spent = (F.col("n") - 1) * F.aggregate("chain", F.lit(0).cast("long"), lambda a, v: a + v)
    given = burst.select("path", (F.col("n_children") == 0).cast("long").alias("leaves"), spent.alias("saved"))
    paths = burst.select(F.col("head").alias("parent"), "path")
    below = skew_join(heads.select("conv_id", "parent", "n_leaves", "saved_tokens"), paths, ["parent"], ["conv_id"], "inner", SALTS)
    given = given.union(below.select("path", "n_leaves", "saved_tokens"))
    totals = given.select(F.explode("path").alias("head"), "leaves", "saved").groupBy("head")
    totals = totals.agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    least = burst.select(F.col("head").alias("parent"), F.col("least").alias("parent_conv_id"))
    nodes = burst.join(totals, "head").join(_ends(reduce(DataFrame.union, ended)), "head", "left").join(least, "parent", "left")
    nodes = nodes.select("*", F.posexplode("chain").alias("at", "size"))
    inside, last = F.col("at") > 0, F.col("top") + F.col("at") == F.col("depth")
    passed = F.aggregate(F.slice(F.col("chain"), F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, v: a + v)
    nothing = F.sha2(F.lit(""), 256)
    nodes = nodes.select(
        F.col("least").alias("conv_id"),
        (F.col("top") + F.col("at")).cast("long").alias("depth"),
        F.when(inside, F.col("least")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved") - (F.col("n") - 1) * passed).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", nothing)).otherwise(nothing).alias("ends_sha256"),
    )
    heads = skew_join(heads.drop("parent_conv_id"), least, ["parent"], ["conv_id"], "left", SALTS)
    return inner.union(nodes).union(heads.select(*COLUMNS))
