"""Near-duplicates by SimHash fingerprints and a self-join of binary tries.

Fingerprints that differ in at most ``errors`` of 64 bits share all bits of
some ``blocks - errors`` out of ``blocks`` bit blocks. Each such choice of
blocks is a table; fingerprints that agree on a table's blocks form a trie.
Pairs of its nodes are walked together, level by level; a pair ends as soon as
its paths differ in more bits than allowed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import add_columns, fresh, id_text, quoted
from viewloom.operators.skew import skew_join
from viewloom.session import cut_lineage, scratch_path

BITS, ERRORS, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints a trie should hold at most on average; more blocks make smaller tries.
TRIE = 4096
#: Rows of tries that a task walks at once, and node pairs it expands at once.
FOREST, FRONTIER = 1 << 16, 1 << 18
#: Rows of a block of a trie that is too large for one task.
HOT = 1 << 15
#: Tasks that the fingerprints of one class are spread over when they look up its name.
SALTS = 16


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of all word shingles in their order; a text with fewer words is one shingle, one without words none."""
    words = text.lower().split()  # of bytes: folds A-Z only, splits at ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    size = min(shingle, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], seed) for a, b in spans), np.uint64, len(words) - size + 1)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The majority of the bits of XXH64 over all word shingles; 0 without words."""
    hashes = shingle_hashes(text, shingle, seed)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """(doc_id, thash, fp): one row for each input row; thash tells texts of one id apart."""

    def make():
        def new(batch):
            texts = batch.column("text").cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            return [pa.array(found.view(np.int64))]

        return new

    texts = id_text(docs, id_col, text_col).withColumn("thash", F.xxhash64("text"))
    return add_columns(texts, "fp long", make, keep=["doc_id", "thash"])


def blocks_for(n: int, errors: int = ERRORS, trie: int = TRIE) -> int:
    """How many bit blocks keep a trie of ``n`` evenly spread fingerprints at ``trie`` or fewer."""
    blocks = errors + 1
    while blocks < 2 * errors and n / 2 ** (BITS * (blocks - errors) // blocks) > trie:
        blocks += 1
    return blocks


def masks_for(blocks: int, errors: int = ERRORS) -> list[int]:
    """For each table the bits that must agree."""
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(block[k] for k in own) for own in combinations(range(blocks), blocks - errors)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Forest:
    """Tries of distinct fingerprints: rows of one trie stand together, in the order of their bits."""

    def __init__(self, fps: np.ndarray, tries: np.ndarray, errors: int):
        order = np.lexsort((fps, tries))
        self.fps, self.errors = fps[order], errors
        self.label = np.arange(len(fps))
        self.starts = np.flatnonzero(np.concatenate(([True], np.diff(tries[order]) != 0)))
        self.ones: dict[int, np.ndarray] = {}

    def ones_before(self, bit: int) -> np.ndarray:
        if bit not in self.ones:
            set_bits = (self.fps >> np.uint64(bit)) & np.uint64(1)
            self.ones[bit] = np.concatenate(([0], np.cumsum(set_bits.astype(np.int64))))
        return self.ones[bit]

    def link(self) -> np.ndarray:
        """The least row that each row is linked to, over any number of links."""
        ends = np.concatenate((self.starts[1:], [len(self.fps)]))
        roots = np.stack([self.starts, ends, self.starts, ends, np.zeros_like(ends)])
        work = [(BITS - 1, roots)]
        while work:
            bit, pairs = work.pop()
            if pairs.shape[1] > FRONTIER:
                half = pairs.shape[1] // 2
                work += [(bit, pairs[:, half:]), (bit, pairs[:, :half])]
                continue
            pairs = self._leaves(pairs)
            if bit >= 0 and pairs.shape[1]:
                work.append((bit - 1, self._children(bit, pairs)))
        return self.label

    def _leaves(self, pairs: np.ndarray) -> np.ndarray:
        """Compares pairs of single fingerprints; returns the pairs that have something below them."""
        a, b, c, d, _ = pairs
        single, same = (b - a == 1) & (d - c == 1), a == c
        x, y = a[single & ~same], c[single & ~same]
        near = np.bitwise_count(self.fps[x] ^ self.fps[y]) <= self.errors
        self._unite(x[near], y[near])
        return pairs[:, ~single]

    def _children(self, bit: int, pairs: np.ndarray) -> np.ndarray:
        a, b, c, d, wrong = pairs
        ones = self.ones_before(bit)
        ab, cd = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        cross = a != c
        below = [
            np.stack([a, ab, c, cd, wrong]),
            np.stack([ab, b, cd, d, wrong]),
            np.stack([a, ab, cd, d, wrong + 1]),
            np.stack([ab, b, c, cd, wrong + 1])[:, cross],
        ]
        found = np.concatenate(below, axis=1)
        return found[:, (found[0] < found[1]) & (found[2] < found[3]) & (found[4] <= self.errors)]

    def _unite(self, x: np.ndarray, y: np.ndarray) -> None:
        label = self.label
        while len(x):
            p, q = label[x], label[y]
            apart = p != q
            x, y, p, q = x[apart], y[apart], p[apart], q[apart]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def _split(rows: DataFrame) -> DataFrame:
    """(fp, t, key) so that the rows of a trie stand together; a trie of more than ``HOT`` rows is cut into blocks.

    Each pair of its blocks is walked as a trie of its own, whose key is drawn from the pair, so that no task holds
    more than two blocks and each pair of fingerprints still meets.
    """
    hot = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    hot = hot.select("t", "key", F.ceil(F.col("n") / HOT).cast("int").alias("blocks"))
    cut = rows.join(hot, ["t", "key"], "left").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    others = F.coalesce(F.sequence(F.lit(0), F.col("blocks") - 1), F.array(F.lit(0)))
    cut = cut.withColumn("other", F.explode(others))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    key = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(pair)
    return cut.select("fp", "t", key.alias("key")).repartition("t", "key").sortWithinPartitions("t", "key")


def links(fps: DataFrame, errors: int = ERRORS) -> DataFrame:
    """(a, b): links that join all distinct fingerprints ``fp`` within ``errors`` bits, perhaps over others.

    Of the links inside one forest a spanning star is given, so their number does not grow with the square of a
    group. Expects a stored table.
    """
    masks = masks_for(blocks_for(fps.count(), errors), errors)
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))
    rows = _split(fps.select("fp", F.posexplode(keys).alias("t", "key")))

    def walk(fp: np.ndarray, t: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        trie = np.cumsum(np.concatenate(([0], (np.diff(t) != 0) | (np.diff(key) != 0))))
        forest = Forest(fp.view(np.uint64), trie, errors)
        label = forest.link()
        far = np.flatnonzero(label != np.arange(len(label)))
        a, b = forest.fps[label[far]].view(np.int64), forest.fps[far].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held = [np.empty(0, kind) for kind in (np.int64, np.int32, np.int64)]
        for batch in batches:
            held = [np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, ("fp", "t", "key"))]
            changes = np.flatnonzero((np.diff(held[1]) != 0) | (np.diff(held[2]) != 0))
            if len(held[0]) >= FOREST and len(changes):
                cut = changes[-1] + 1  # the last trie may go on in the next batch
                yield walk(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield walk(*held)

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the least fingerprint that each linked one reaches, by stars in turn until nothing changes.

    Each round is aggregations and joins on the edges; their table is checkpointed, never collected.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"))
    before = None
    while True:
        # every vertex tells its larger neighbours the least vertex around it
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # and each its smaller neighbours, itself included
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.where("u != v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        before = state


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = ERRORS, shingle: int = SHINGLE
) -> DataFrame:
    """The near-duplicate class of every whole text; one row for each input row.

    Result: doc_id, thash (hash of the text), fp (fingerprint as a signed long) and component_id, the least doc_id
    of all texts reachable over fingerprints that differ in at most ``errors`` bits. Null and empty texts and those
    without words have fingerprint 0 and are linked like any other. A null id stays null and is never least, unless
    a class has no other: then component_id is null. Repeated rows give repeated results. Other columns are not
    read, whatever they are called. No row gives no row.

    Fingerprints are computed once and stored; copies are one fingerprint from there on.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "fingerprints")
    fingerprints(docs, id_col, text_col, shingle).write.parquet(path)
    marked = spark.read.parquet(path)
    fps = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps, errors))
    rooted = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("named"), F.count(F.lit(1)).alias("n"))
    # only classes of several fingerprints are looked up, and a large one in many tasks
    classes = skew_join(rooted, named.where("n > 1"), ["root"], ["fp"], "left", SALTS)
    classes = classes.select("fp", "root", F.coalesce("named", "least").alias("component_id"))
    return marked.join(classes, "fp").select("doc_id", "thash", "fp", "root", "component_id")


def row_key(doc_id: Column, thash: Column) -> Column:
    """A text that tells rows apart by id and hash; a null id is empty."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.hex(thash))


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` with one for each ``root`` of ``found`` (doc_id, thash, root)."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "thash")
    kept = found.groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.thash")
    (key,) = fresh(docs, "row_key")
    kept = kept.select(row_key(F.col("doc_id"), F.col("thash")).alias(key))
    own = row_key(quoted(id_col), F.xxhash64(F.coalesce(quoted(text_col).cast("string"), F.lit(""))))
    return docs.withColumn(key, own).join(kept, key, "left_semi").dropDuplicates([key]).drop(key)


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = ERRORS, shingle: int = SHINGLE
) -> DataFrame:
    """The rows of ``docs`` with one for each class of near-duplicates: that of the least id, then of the least hash.

    Of rows that repeat id and text one stays, whatever its other columns hold. A row without an id stays only if its
    class has no row with one.
    """
    return keep_first(docs, near_duplicates(docs, id_col, text_col, errors, shingle), id_col, text_col)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
