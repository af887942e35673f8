"""Near-duplicates by a chosen-path similarity join of shingle sets.

Each set is embedded as ``TOKENS`` minwise tokens (the minimum of its shingles under as many hash functions). Trees
branch the sets recursively: a node picks 1 / similarity of the tokens, by chance but alike for all its sets, and a set
goes to one child for each of them, named by the value of its token. A pair of just the similarity looked for stays
together in one child on average at every level, a pair of less in fewer, so nodes shrink while such pairs live on.
The first ``START`` levels are taken at one go, as ``PATHS`` independent paths, of which nearly every such pair shares
some; from there on a node branches while it has more than ``LEAF`` sets. Smaller nodes are compared exhaustively (in
blocks) on sketches of the tokens, larger ones with one set each. What may be alike forms a family, whose pairs are all decided at
once on the whole sets; sets of one family need not be told apart in any other node or tree.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import add_columns, id_text, stored
from viewloom.llm.simhash import SEED, components, keep_first, row_key, shingle_hashes
from viewloom.operators.skew import skew_join
from viewloom.session import drop_scratch, scratch_mark, scratch_path, settled

SHINGLE, SIMILARITY = 5, 0.8
#: Minwise tokens of a set, paths that the trees start with, and tokens of each of these.
TOKENS, PATHS, START = 128, 24, 3
#: Sets of a node that is compared exhaustively, and levels after which larger nodes are, too.
LEAF, DEPTH = 4096, 8
#: Sets of a family that is decided at once; larger ones are joined by hubs and branch on.
FAMILY = 1 << 14
#: Sets of a block of a node, and of a family. Two blocks meet in a task.
NODE_BLOCK, FAMILY_BLOCK = 1024, 512
#: Standard deviations by which a sketch may fall short of its expectation.
SLACK = 4.2
#: Sets compared with one hub in one group, shingles hashed at once, rows of a matrix, parts of a hot class.
STAR, CHUNK, STRIPE, SALTS = 256, 1 << 12, 256, 16

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")
_SKETCH = ("s0", "s1", "s2", "s3")

_draws = np.random.default_rng(SEED)
_A = _draws.integers(0, 1 << 64, TOKENS, np.uint64) | np.uint64(1)
_B = _draws.integers(0, 1 << 64, TOKENS, np.uint64)
_PLACE = _draws.integers(0, 1 << 64, TOKENS, np.uint64)
_PATHS = np.stack([_draws.permutation(TOKENS)[:START] for _ in range(PATHS)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _long(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def minwise(own: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set that is not empty."""
    least = np.full(TOKENS, np.iinfo(np.uint64).max)
    for k in range(0, len(own), CHUNK):
        np.minimum(least, (_A[:, None] * own[None, k : k + CHUNK] + _B[:, None]).min(axis=1), out=least)
    return (_mixed(least) >> np.uint64(32)).astype(np.uint32)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Two bits of each token, in four numbers."""
    two = (tokens & 3).astype(np.uint64).reshape(4, TOKENS // 4)
    return (two << (2 * np.arange(TOKENS // 4, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def least_alike(similarity: float) -> int:
    """Tokens whose two bits agree, for nearly every pair of that similarity."""
    p = similarity + (1 - similarity) / 4
    return max(0, math.floor(TOKENS * p - SLACK * math.sqrt(TOKENS * p * (1 - p))))


def first_nodes(tokens: np.ndarray) -> np.ndarray:
    """The nodes at the ends of the first paths."""
    nodes = np.arange(PATHS, dtype=np.uint64)
    for level in range(START):
        at = _PATHS[:, level]
        nodes = _mixed(nodes ^ _mixed(tokens[at].astype(np.uint64) ^ _PLACE[at]))
    return nodes


def children(nodes: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child): the children of each row's node that the row's tokens lead to."""
    width = 1 / similarity
    chance = _mixed(nodes ^ np.uint64(1)).astype(np.float64) / 2.0**64
    wide = int(width) + (chance < width - int(width))
    rows, found = [], []
    for k in range(int(width) + 1):
        own = np.flatnonzero(wide > k)
        at = (_mixed(nodes[own] + np.uint64(2 + k)) % np.uint64(TOKENS)).astype(np.int64)
        rows.append(own)
        found.append(_mixed(nodes[own] ^ _mixed(tokens[own, at].astype(np.uint64) ^ _PLACE[at])))
    return np.concatenate(rows), np.concatenate(found)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets."""
    out = np.zeros((len(sets), len(sets)), np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, places = np.unique(np.concatenate(sets), return_inverse=True)
    several = np.bincount(places, minlength=len(values)) > 1
    places, owner = (np.cumsum(several) - 1)[places[several[places]]], owner[several[places]]
    order = np.argsort(places, kind="stable")
    places, owner = places[order], owner[order]
    for first in range(0, int(several.sum()), CHUNK):
        a, b = np.searchsorted(places, (first, first + CHUNK))
        hit = np.zeros((len(sets), CHUNK), np.float32)
        hit[owner[a:b], places[a:b] - first] = 1
        out += (hit @ hit.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def similar(common, a, b, similarity: float):
    """Whether a share of the union of two sets is common, in whole numbers."""
    return common * 1_000_000 >= round(similarity * 1_000_000) * (a + b - common)


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j) with ``near[i, j]`` and i < j that join all that such pairs join, and no more."""
    root, links = np.arange(len(near)), []
    for i in range(len(near)):
        others = i + 1 + np.flatnonzero(near[i, i + 1 :])
        apart = others[root[others] != root[i]]
        if len(apart):
            for k in np.unique(root[apart], return_index=True)[1]:
                links.append((i, int(apart[k])))
                root[root == root[apart[k]]] = root[i]
    return links


def marks(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, thash, set, n, tokens, nodes, s0 .. s3): one row for each input row; ``set`` is a hash of the shingles."""

    def make():
        def new(batch):
            keys, sizes, tokens, nodes, short = [], [], [], [], []
            for t in batch.column("text").cast(pa.binary()):
                own = shingle_set(t.as_py(), shingle)
                keys.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                if len(own):
                    least = minwise(own)
                    tokens.append(least.tobytes())
                    nodes.append(_long(first_nodes(least)))
                    short.append(_long(sketch(least)))
                else:
                    tokens.append(b"")
                    nodes.append(np.empty(0, np.int64))
                    short.append(np.zeros(4, np.int64))
            short = np.array(short, np.int64).reshape(-1, 4)
            first = [pa.array(_long(keys)), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary())]
            return [*first, pa.array(nodes, pa.list_(pa.int64())), *(pa.array(short[:, k]) for k in range(4))]

        return new

    texts = id_text(docs, id_col, text_col).withColumn("thash", F.xxhash64("text"))
    fields = "set long, n long, tokens binary, nodes array<long>, s0 long, s1 long, s2 long, s3 long"
    return add_columns(texts, fields, make, keep=["doc_id", "thash"])


def _branch(live: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, set): the children of all nodes, one row for each set in each."""

    def run(batches):
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            own = batch.column("set").to_numpy()
            rows, found = children(batch.column("node").to_numpy().view(np.uint64), tokens, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(own[rows])], names=["node", "set"])

    both = live.select("node", "set").join(sets.select("set", "tokens"), "set")
    return both.select("node", "set", "tokens").mapInArrow(run, "node long, set long")


def _alike(a: str, b: str) -> Column:
    """How many tokens of two sketches agree."""
    parts = []
    for s in _SKETCH:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        parts.append(F.bit_count(x))
    return F.lit(TOKENS) - reduce(Column.__add__, parts)


def _promising(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that may be similar enough, by their sizes and sketches."""
    brief = F.struct("n", *_SKETCH)
    other = pairs.join(sets.select(F.col("set").alias("b"), brief.alias("y")), "b")
    both = other.join(sets.select(F.col("set").alias("a"), brief.alias("x")), "a")
    close = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-6
    return both.where(close & (_alike("x", "y") >= least_alike(similarity))).select("a", "b")


def _texts(docs: DataFrame, wanted: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(set, text): a text of each of the wanted sets."""
    rows = sets.join(wanted, "set", "left_semi").select("set", "row")
    texts = id_text(docs, id_col, text_col).withColumn("row", row_key(F.col("doc_id"), F.xxhash64("text")))
    return texts.join(rows, "row").select("set", "text").dropDuplicates(["set"])


def _stars(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b): the pairs whose whole sets are similar enough. Each ``a`` meets its partners in groups of about STAR."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    met = pairs.join(sizes, "a")
    met = met.select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), F.col("b").alias("set"))
    hubs = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("a").alias("set"))
    rows = hubs.union(met).join(texts, "set").select("a", "part", "kind", "set", "text")

    def run(batches):
        hub, key = None, None
        for batch in batches:
            a, b = [], []
            columns = [batch.column(c).to_pylist() for c in ("a", "part", "kind", "set")]
            for place, (own, part, kind, other) in enumerate(zip(*columns)):
                here = shingle_set(batch.column("text")[place].as_py().encode(), shingle)
                if not kind:
                    hub, key = here, (own, part)
                elif key == (own, part):
                    common = len(np.intersect1d(hub, here, assume_unique=True))
                    if similar(common, len(hub), len(here), similarity):
                        a.append(own)
                        b.append(other)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    return dealt.mapInArrow(run, "a long, b long")


def _groups(batches, names: list[str]):
    """The rows of each group as lists of columns; the first column names the group, whose rows stand together."""
    held, key = [[] for _ in names], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if row[0] != key:
                if held[0]:
                    yield held
                held, key = [[] for _ in names], row[0]
            for column, value in zip(held, row):
                column.append(value)
    if held[0]:
        yield held


def _leaves(nodes: DataFrame, sets: DataFrame, similarity: float, parts: bool = False) -> DataFrame:
    """(a, b): links that join the sets of a node that may be similar, by all pairs of its sketches.

    With ``parts`` (part, set) instead: the sets that are joined in a node, so that all pairs that may be similar lie in
    some part. Links tell which sets belong together, but not which pairs of those may be similar.
    """
    cut, names = least_alike(similarity), ["part", "set"] if parts else ["a", "b"]
    fives = np.uint64(0x5555555555555555)

    def found(label: np.ndarray, n: np.ndarray, short: np.ndarray) -> list[tuple[int, int]]:
        near = label[:, None] != label[None, :]
        for first in range(0, len(n), STRIPE):
            here = slice(first, first + STRIPE)
            apart = np.zeros((len(n[here]), len(n)), np.int16)
            for k in range(short.shape[1]):
                x = short[here, None, k] ^ short[None, :, k]
                apart += np.bitwise_count((x | (x >> np.uint64(1))) & fives)
            sizes = np.minimum.outer(n[here], n) >= similarity * np.maximum.outer(n[here], n) - 1e-6
            near[here] &= (TOKENS - apart >= cut) & sizes
        return spanning(near)

    def run(batches):
        a, b = [], []
        for node, own, label, n, *short in _groups(batches, ["node", "set", "label", "n", *_SKETCH]):
            short = np.array(short, np.int64).view(np.uint64).T
            links = found(np.array(label), np.array(n), short)
            if parts:
                root = np.arange(len(own))
                for p, q in links:
                    root[root == root[q]] = root[p]
                for p in np.unique(np.array(links, np.int64)).tolist():
                    a.append(xxhash.xxh64_intdigest(f"{node[p]} {own[root[p]]}", SEED))
                    b.append(own[p])
            else:
                a += (min(own[p], own[q]) for p, q in links)
                b += (max(own[p], own[q]) for p, q in links)
            if len(a) > CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(_long(a) if parts else a, pa.int64()), pa.array(b, pa.int64())], names=names)
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(_long(a) if parts else a, pa.int64()), pa.array(b, pa.int64())], names=names)

    rows = nodes.join(sets.select("set", "n", *_SKETCH), "set").select("node", "set", "label", "n", *_SKETCH)
    dealt = rows.repartition("node").sortWithinPartitions("node", "set")
    return dealt.mapInArrow(run, ", ".join(f"{name} long" for name in names)).distinct()


def _confirmed(groups: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b): links that join all sets of a group whose whole sets are similar enough, and no others."""

    def run(batches):
        for _, own, held in _groups(batches, ["grp", "set", "text"]):
            sets = [shingle_set(t.encode(), shingle) for t in held]
            n = np.array([len(s) for s in sets])
            near = similar(overlaps(sets), n[:, None], n[None, :], similarity)
            links = [(own[p], own[q]) for p, q in spanning(near)]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    rows = groups.join(texts, "set").select("grp", "set", "text")
    return rows.repartition("grp").sortWithinPartitions("grp", "set").mapInArrow(run, "a long, b long")


def _block_pairs(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` with ``grp``: all of a ``key`` of at most twice ``size`` rows (``k``), or each pair of blocks of a larger one."""
    blocks = F.when(F.col("k") <= 2 * size, F.lit(1)).otherwise(F.ceil(F.col("k") / size)).cast("int")
    block = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set"), "blocks").cast("int"))
    other = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grp = F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))
    return other.withColumn("grp", grp).drop("block", "other", "blocks")


def _families(links: DataFrame) -> DataFrame:
    """(set, family, k): the sets that links join, and how many."""
    joined = components(links).withColumnRenamed("root", "family").withColumnRenamed("fp", "set")
    whole = stored(joined.union(joined.select("family", "family").distinct()).toDF("set", "family"), "joined")
    sizes = whole.groupBy("family").agg(F.count(F.lit(1)).alias("k"))
    return stored(whole.join(sizes, "family"), "families")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    leaf: int = LEAF,
    depth: int = DEPTH,
) -> DataFrame:
    """The near-duplicate class of every whole text; one row for each input row.

    Result: doc_id, thash (hash of the text), n_shingles (distinct), root (a hash common to the class) and component_id
    (the least doc_id reachable over pairs of Jaccard similarity ``similarity`` or more, itself included). Words are
    parted by ASCII white space and A-Z is lower-cased; a text of fewer than ``shingle`` words is one shingle. Texts
    without words are linked with nothing: their root is null. Null texts are empty. A null id is never least, unless a
    class has no other: then component_id is null. Repeated rows give repeated results; other columns are not read. No
    row gives no row.

    Texts with equal sets are one set from the start. A link between sets is missed with a probability of about
    (1 - s ** START / (1 + 0.16 d)) ** PATHS where its nodes branch d times more, and confirmed on whole sets where it is met.
    """
    spark, since = docs.sparkSession, scratch_mark()
    marked = stored(marks(docs, id_col, text_col, shingle), "marks")
    row = row_key(F.col("doc_id"), F.col("thash")).alias("row")
    sets = marked.where("n > 0").select("set", row, "n", *_SKETCH, "tokens", "nodes").dropDuplicates(["set"])
    sets = stored(sets, "sets")
    frontier = sets.select(F.explode("nodes").alias("node"), "set", F.col("set").alias("label"))
    labels = spark.createDataFrame([], "set long, label long")
    edges, level = spark.createDataFrame([], "a long, b long"), 0
    while True:
        rounds = scratch_mark()
        # sets of one label are told apart already
        rank = F.struct(F.xxhash64("set", F.lit(level)).alias("r"), "set", "label")
        nodes = frontier.groupBy("node").agg(
            F.count(F.lit(1)).alias("k"), F.min(rank).alias("hub"), F.min("label").alias("lo"), F.max("label").alias("hi")
        )
        met = stored(frontier.join(nodes.where("lo < hi").select("node", "k", "hub"), "node"), "met")
        level += 1
        large = met.where((F.col("k") > leaf) & F.lit(level < depth))
        small = met.where((F.col("k") <= leaf) | F.lit(level >= depth))
        small = _block_pairs(small, "node", min(NODE_BLOCK, leaf)).select(F.col("grp").alias("node"), "set", "label")
        pairs = large.where("set != hub.set AND label != hub.label").select(F.col("hub.set").alias("a"), F.col("set").alias("b"))
        links = _promising(pairs.distinct(), sets, similarity).withColumn("hub", F.lit(True))
        links = stored(links.union(_leaves(small, sets, similarity).withColumn("hub", F.lit(False))), "links")
        if not links.isEmpty():
            families = _families(links)
            texts = _texts(docs, families.select("set"), sets, id_col, text_col)
            fit = families.where(F.col("k") <= FAMILY)
            found = [_confirmed(_block_pairs(fit, "family", FAMILY_BLOCK), texts, similarity, shingle)]
            over = families.where(F.col("k") > FAMILY).select("set")
            if not over.isEmpty():
                hubs = links.where("hub").join(over.withColumnRenamed("set", "a"), "a", "left_semi").select("a", "b")
                found.append(_stars(hubs, texts, similarity, shingle))
                # links alone would leave out pairs whose sets they join over others
                parts = stored(_leaves(small.join(over, "set", "left_semi"), sets, similarity, parts=True), "parts")
                parts = parts.join(parts.groupBy("part").agg(F.count(F.lit(1)).alias("k")), "part")
                found.append(_confirmed(_block_pairs(parts, "part", FAMILY_BLOCK), texts, similarity, shingle))
            edges = stored(edges.union(reduce(DataFrame.union, found)), "edges")
            # families of two levels may have one root, but were not decided together
            named = fit.select("set", F.xxhash64("family", F.lit(level)).alias("label"))
            if len(found) > 1:
                classes = components(edges).withColumnRenamed("fp", "set").withColumnRenamed("root", "label")
                named = named.union(classes.join(over, "set", "left_semi").select("set", "label"))
            labels = stored(labels.join(named, "set", "left_anti").union(named), "labels")
        if large.isEmpty():
            break
        frontier = _branch(large, sets, similarity).join(labels, "set", "left")
        frontier = frontier.select("node", "set", F.coalesce("label", "set").alias("label"))
        # what the next level reads stays
        below = {"frontier": frontier, "edges": edges, "labels": labels}
        paths = [scratch_path(spark, name) for name in below]
        for df, path in zip(below.values(), paths):
            df.write.parquet(path)
        drop_scratch(spark, rounds, keep=paths)
        frontier, edges, labels = (spark.read.parquet(path) for path in paths)
    roots = stored(components(edges), "set_roots")
    least = marked.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots.withColumnRenamed("fp", "set"), "set", "left")
    rooted = rooted.select("set", "least", F.coalesce("root", "set").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("named"), F.count(F.lit(1)).alias("k")).where("k > 1")
    classes = skew_join(rooted, named, ["root"], ["set"], "left", SALTS)
    classes = classes.select("set", "root", F.coalesce("named", "least").alias("component_id"))
    own = marked.select("doc_id", "thash", F.when(F.col("n") > 0, F.col("set")).alias("set"), F.col("n").alias("n_shingles"))
    out = own.join(classes, "set", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return settled(out.select("doc_id", "thash", "n_shingles", "root", alone.alias("component_id")), "classes", since)


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE
) -> DataFrame:
    """The rows of ``docs`` with one for each class of ``near_duplicates``, chosen as by ``simhash.keep_one``.

    Of texts without words one stays for each id.
    """
    found = near_duplicates(docs, id_col, text_col, similarity, shingle)
    alone = F.xxhash64(F.lit("without words"), row_key(F.col("doc_id"), F.col("thash")))
    return keep_first(docs, found.withColumn("root", F.coalesce("root", alone)), id_col, text_col)


def digest(found: DataFrame) -> DataFrame:
    """``found`` with kept: whether a row's id is that of its class."""
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*COLUMNS)
