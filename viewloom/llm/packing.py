"""Best-fit packing of tokenized documents by a grouping genetic algorithm.

Documents become pieces of at most one sequence; full pieces are sequences of their own. The others are dealt into
blocks by hash. Each block is packed on several islands: a child takes over whole well-filled sequences of one
parent, sequences of the other that hold the same pieces are dissolved, and what they leave over is fitted in again,
each piece into the fullest sequence that has room. After each epoch an island's best packing migrates to the next.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewloom.llm.common import add_columns, id_text, pieces_of, texts_of, worker_cache
from viewloom.session import scratch_path

CAPACITY, END = 2048, 0
#: Pieces of a block, islands of each block, epochs between migrations, and generations and packings of an island.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, PACKINGS = 2048, 3, 3, 3, 4
#: Sequences filled less than this share are dissolved and packed once more, those of all blocks together.
LOOSE = 0.75
#: Words of which the ids are kept by a Python worker in each of two generations, and their longest.
MEMO, MEMO_CHARS = 800_000, 48

#: In a text with one of these a word's ids may depend on the case of its letters before normalisation, or white
#: space is not the same for Python and the tokenizer.
UNUSUAL = re.compile(r"<\||[̀-‏ -\U0010ffff\x1c-\x1f]")
ODD_BLANK = re.compile(r"[\x1c-\x1f]")
STOPS = ".,;:!?"
#: Letters before the first combining mark are in normal form, each for itself.
FIRST_MARK = "\u0300"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else one beyond 255."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class Ids:
    """Ids of whole texts as the tokenizer gives them, put together from its ids for their words.

    The tokenizer normalises and splits the parts between white space separately, so a text's ids are those of its
    words in a row. Words of a usual text are looked up with A-Z folded, which the tokenizer does anyway.
    """

    def __init__(self, path: str, most: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        # words looked up lately, and those before them
        self.most = most
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def plain(self, word: str) -> bytes:
        """Ids of a word that normalisation does not change and that is one pre-token: the model's own."""
        found = self.memo.get(word) or self.old.get(word)
        if found is None:
            shown = word if word.isascii() else "".join(map(BYTE_LETTERS.__getitem__, word.encode()))
            ids = [t.id for t in self.model.tokenize(shown)]
            found = pack(f"<{len(ids)}I", *ids)
        if len(word) <= MEMO_CHARS:
            self.memo[word] = found
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for some in pieces_of(texts, 1 << 16):
            found = self.tokenizer.encode_batch(some, add_special_tokens=False)
            out += (np.array(e.ids, "<u4").tobytes() for e in found)
        return out

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        for some in pieces_of(texts, 1 << 20):
            yield from self._ids(some)

    def words(self, text: str) -> list[str]:
        if not UNUSUAL.search(text):
            return text.encode().lower().decode().split()
        return [text] if ODD_BLANK.search(text) else text.split()

    def _ids(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > self.most:
            self.memo, self.old = {}, self.memo
        memo, old, other = self.memo, self.old, []
        split = [self.words(t) for t in texts]
        unknown = set(chain.from_iterable(split)).difference(memo)
        for w in unknown:
            if w in old:
                memo[w] = old[w]
                continue
            # letters, or letters before stops, which are two pre-tokens
            core = w.rstrip(STOPS)
            if core.isalpha() and core.islower() and (core.isascii() or max(core) < FIRST_MARK):
                memo[w] = self.plain(core) + self.stops(w[len(core) :]) if len(core) < len(w) else self.plain(core)
            else:
                other.append(w)
        memo.update(zip(other, self.encode(other)))
        out = [b"".join(map(memo.__getitem__, own)) for own in split]
        for w in unknown:
            if len(w) > MEMO_CHARS:
                memo.pop(w, None)
        return out

    def stops(self, tail: str) -> bytes:
        if tail not in self.memo:
            self.memo[tail] = self.encode([tail])[0]
        return self.memo[tail]


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, CRC-32) of each piece of a document's ids."""
    whole = range(0, len(ids) // 4, capacity)
    parts = (ids[4 * s : 4 * (s + capacity)] for s in whole)
    return [(k, s, len(p) // 4, zlib.crc32(p)) for k, (s, p) in enumerate(zip(whole, parts))]


PIECE = "struct<piece: int, start: long, length: long, ids_crc32: long>"


def document_pieces(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", capacity=CAPACITY, memo=MEMO) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32): the pieces of every whole text, its end id included.

    ``uid`` numbers the pieces within the partitions of ``docs``.
    """
    end = np.array([END], "<u4").tobytes()
    key = ("ids", tokenizer_path, memo)

    def make():
        encoder = worker_cache(key, lambda: Ids(tokenizer_path, memo))

        def new(batch):
            found = [cut(ids + end, capacity) for texts in texts_of(batch, "text") for ids in encoder.ids(texts)]
            ends = np.cumsum([0, *map(len, found)])
            flat = np.array(list(chain.from_iterable(found)), np.int64).reshape(-1, 4)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            fields = [pa.array(v, pa.int64()).cast(k) for v, k in zip(flat.T, kinds)]
            names = ["piece", "start", "length", "ids_crc32"]
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=names))]

        return new

    found = add_columns(id_text(docs, id_col, text_col), f"p array<{PIECE}>", make, ["doc_id"], key)
    rows = found.select("doc_id", F.explode("p").alias("p"))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "p.*")


class Packing:
    """Bins of item numbers, their fills, and a worth to compare: few bins, and uneven fills."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins = bins
        self.fills = [sum(map(lengths.__getitem__, b)) for b in bins]
        self.lengths, self.capacity = lengths, capacity

    @property
    def worth(self) -> tuple[int, int]:
        return -len(self.bins), sum(f * f for f in self.fills)

    def best_fit(self, items: list[int]) -> "Packing":
        """Puts each item, long ones first, into the fullest bin with room, or a new one."""
        lengths, capacity, bins, fills = self.lengths, self.capacity, self.bins, self.fills
        # room and bin in one number, in order of room
        rooms = sorted(((capacity - f) << 32) + k for k, f in enumerate(fills) if f < capacity)
        for item in items:
            length = lengths[item]
            at = bisect_left(rooms, length << 32)
            if at < len(rooms):
                key = rooms.pop(at)
                k, room = key & 0xFFFFFFFF, (key >> 32) - length
                bins[k].append(item)
                fills[k] += length
            else:
                k, room = len(bins), capacity - length
                bins.append([item])
                fills.append(length)
            if room:
                insort(rooms, (room << 32) + k)
        return self

    def without(self, gone: list[int]) -> list[list[int]]:
        return [b for k, b in enumerate(self.bins) if k not in set(gone)]


def inject(one: Packing, other: Packing, rng: random.Random) -> Packing:
    """A child of ``one`` with whole well-filled bins of ``other``."""
    ranked = sorted(range(len(other.bins)), key=other.fills.__getitem__, reverse=True)
    best = ranked[: max(1, len(ranked) // 2)]
    chosen = [other.bins[k] for k in rng.sample(best, max(1, len(best) // 4))]
    taken = set(chain.from_iterable(chosen))
    whole, displaced = [], []
    for b in one.bins:
        if taken.isdisjoint(b):
            whole.append(b)
        else:
            displaced += [i for i in b if i not in taken]
    return refill(whole + chosen, displaced, one)


def mutate(one: Packing, rng: random.Random) -> Packing:
    """Dissolves the emptiest bins and a few others."""
    ranked = sorted(range(len(one.bins)), key=one.fills.__getitem__)
    gone = set(ranked[:2]) | set(rng.sample(ranked, min(len(ranked), 1 + len(ranked) // 50)))
    displaced = [i for k in sorted(gone) for i in one.bins[k]]
    return refill([b for k, b in enumerate(one.bins) if k not in gone], displaced, one)


def refill(bins: list[list[int]], displaced: list[int], like: Packing) -> Packing:
    displaced.sort(key=lambda i: (-like.lengths[i], i))
    return Packing([list(b) for b in bins], like.lengths, like.capacity).best_fit(displaced)


def decode(numbers, lengths: list[int], capacity: int) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(numbers, default=-1) + 1)]
    for item, k in enumerate(numbers):
        bins[k].append(item)
    return Packing(bins, lengths, capacity)


def encode(packing: Packing) -> list[int]:
    numbers = [0] * len(packing.lengths)
    for k, b in enumerate(packing.bins):
        for item in b:
            numbers[item] = k
    return numbers


def evolve(lengths: list[int], elites: list[list[int]], seed: str, capacity: int, generations: int, packings: int) -> Packing:
    """The best packing of an island after some generations, from elites or, without any, from scratch."""
    rng = random.Random(seed)
    population = [decode(e, lengths, capacity) for e in elites]
    while len(population) < packings:
        # by falling length; all but the first packing of an island without elites with some disorder
        disorder = 0.2 if population else 0.0
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * (1 + disorder * rng.random()))
        population.append(Packing([], lengths, capacity).best_fit(order))
    ranked = sorted(((p.worth, -k, p) for k, p in enumerate(population)), key=itemgetter(0, 1), reverse=True)
    least = -(-sum(lengths) // capacity)
    born = len(ranked)
    for _ in range(generations * packings):
        if len(ranked[0][2].bins) <= least:
            break
        one, other = rng.sample(ranked, 2) if len(ranked) > 1 else (ranked[0], ranked[0])
        child = mutate(inject(one[2], other[2], rng), rng)
        born += 1
        ranked[-1] = max(ranked[-1], (child.worth, -born, child), key=itemgetter(0, 1))
        ranked.sort(key=itemgetter(0, 1), reverse=True)
    return ranked[0][2]


STATE = "block long, island int, src int, uids array<long>, lengths array<int>, packing array<int>, fewest long, squares long"


def pack_items(items: DataFrame, n_items: int, capacity: int = CAPACITY, seed: int = 42, block: int = BLOCK,
               islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS,
               packings: int = PACKINGS) -> DataFrame:
    """(uid, block, bin, offset, fill) for ``n_items`` rows (uid, length) with lengths below the capacity.

    A block has about ``block`` items whatever the size of the table, so no task grows with it; all blocks and
    islands evolve side by side. Every draw depends on seed, block, island and epoch alone, and the items of a block
    are in the order of uid, so a task that runs again gives the same packing.
    """
    blocks = max(1, math.ceil(n_items / block))
    tasks = max(1, min(10_000, blocks * islands // 4))
    dealt = items.select((F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(blocks))).alias("block"), "uid", "length")
    rows = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("uid", F.col("length").cast("int").alias("length")))).alias("i"))
    none = F.lit(None).cast("array<array<int>>")
    state = rows.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.col("i.uid").alias("uids"), F.col("i.length").alias("lengths"), none.alias("elites"),
    )

    def epoch(number: int, last: bool):
        def run(frames):
            for frame in frames:
                out = []
                for r in frame.itertuples(index=False):
                    lengths = r.lengths.tolist()
                    elites = [] if r.elites is None else [e.tolist() for e in r.elites]
                    start = f"{seed} {r.block} {r.island} {number}"
                    best = evolve(lengths, elites, start, capacity, generations, packings)
                    n, squares = best.worth
                    numbers = encode(best)
                    out.append((r.block, r.island, 0, r.uids, r.lengths, numbers, n, squares))
                    if not last and islands > 1:
                        out.append((r.block, (r.island + 1) % islands, 1, None, None, numbers, n, squares))
                yield pd.DataFrame(out, columns=[f.split()[0] for f in STATE.split(", ")])

        return run

    for number in range(epochs):
        # few bytes, much work: the number of tasks follows the work
        ready = state.repartition(tasks, "block", "island")
        done = ready.mapInPandas(epoch(number, number == epochs - 1), STATE)
        if number < epochs - 1:
            met = done.repartition(tasks, "block", "island").groupBy("block", "island").agg(
                F.first("uids", ignorenulls=True).alias("uids"),
                F.first("lengths", ignorenulls=True).alias("lengths"),
                F.array_sort(F.collect_list(F.struct("src", "packing"))).alias("e"),
            )
            state = met.select("block", "island", "uids", "lengths", F.col("e.packing").alias("elites"))
    best = done.groupBy("block").agg(F.max(F.struct("fewest", "squares", -F.col("island"), "uids", "lengths", "packing")).alias("s"))
    placed = best.select(
        "block", F.inline(F.arrays_zip(F.col("s.uids").alias("uid"), F.col("s.lengths").alias("length"), F.col("s.packing").alias("bin")))
    )
    line = Window.partitionBy("block", "bin").orderBy("uid")
    return placed.select(
        "uid", "block", "bin",
        (F.sum("length").over(line) - F.col("length")).alias("offset"),
        F.sum("length").over(Window.partitionBy("block", "bin")).alias("fill"),
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    loose: float = LOOSE,
    memo: int = MEMO,
) -> DataFrame:
    """Every whole text as pieces of at most ``capacity`` tokens, packed into few sequences of that size.

    Result, one row for each piece: doc_id, piece (from 0), start (its document's ids before it), length, ids_crc32,
    sequence_id and offset (its place there, without gaps). A document is its ids and the end id 0; only longer ones
    are cut. Null and empty texts are one piece of one token; a null id stays null; repeated rows are packed each.
    Other columns are not read, whatever they are called. No row gives no row. A Python worker keeps the ids of up to
    ``memo`` words in each of two generations (about 130 bytes a word).

    Pieces (numbers, no ids) are stored once; everything after works on those. Sequences of a first packing that
    stay loose are dissolved and packed once more, those of all blocks together.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    document_pieces(docs, tokenizer_path, id_col, text_col, capacity, memo).write.parquet(path)
    pieces = spark.read.parquet(path)
    items = pieces.where(F.col("length") < capacity).select("uid", "length")

    first_path, second_path = scratch_path(spark, "packed"), scratch_path(spark, "packed")
    pack_items(items, items.count(), capacity, seed).write.parquet(first_path)
    first = spark.read.parquet(first_path)
    again = F.col("fill") < capacity * loose
    left = first.where(again).select("uid").join(items, "uid")
    pack_items(left, first.where(again).count(), capacity, seed + 1).write.parquet(second_path)
    packed = first.where(~again).withColumn("round", F.lit(0)).union(
        spark.read.parquet(second_path).withColumn("round", F.lit(1))
    )
    # even and odd numbers for the two rounds, negative ones for full pieces
    packed = packed.select(
        "uid", (F.shiftleft(F.col("block").cast("long"), 24) + F.col("bin") * 2 + F.col("round")).alias("sequence_id"), "offset"
    )
    full = pieces.where(F.col("length") == capacity).select(
        *pieces.columns, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < capacity).join(packed, "uid")
    return full.unionByName(rest).drop("uid")


COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
