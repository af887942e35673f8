import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from viewloom.llm import simhash


def brute_fingerprint(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, errors=4):
    """The least index reachable from each."""
    label = list(range(len(fps)))
    for _ in fps:
        before = list(label)
        for i, a in enumerate(fps):
            for j in range(i):
                if (a ^ fps[j]).bit_count() <= errors:
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label
    return label


def near_copies():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(12):
        base = rng.choices(words, k=400)
        rows.append((10 * k + 5, " ".join(base)))
        for j in range(4):
            copy = list(base)
            copy[rng.randrange(400)] = "changed"
            rows.append((10 * k + j, " ".join(copy)))
    return rows


def test_rows_equal_brute_force(spark, tricky, pairs, by_rows):
    rows = pairs + [(i + 1000, t) for i, t in near_copies()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.digest(simhash.near_duplicates(docs))
    fps = [brute_fingerprint(t) for _, t in rows]
    label = brute_classes(fps)
    least = {}
    for (i, _), k in zip(rows, label):
        least[k] = min((x for x in (i, least.get(k)) if x is not None), default=None)
    want = [(i, f"{f:016x}", least[k]) for (i, _), f, k in zip(rows, fps, label)]
    assert by_rows(got.collect()) == by_rows(want)
    assert len(set(label)) < len(set(fps))


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_forest_finds_all_classes(blocks):
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64) for _ in range(12)]
    fps = np.unique(np.concatenate([base, *(base ^ a ^ b for a, b in zip(flips, flips[3:]))]))
    edges = []
    for mask in simhash.masks_for(blocks):
        keys = np.unique(fps & np.uint64(mask), return_inverse=True)[1]
        forest = simhash.Forest(fps, keys, 4)
        edges += zip(forest.fps.tolist(), forest.fps[forest.link()].tolist())
    label = {int(f): int(f) for f in fps}
    for _ in range(10):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    want = brute_classes([int(f) for f in fps])
    assert [label[int(f)] for f in fps] == [int(fps[k]) for k in want]


def test_small_frontiers_give_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 2**12, 600, dtype=np.uint64))
    tries = np.zeros(len(fps), np.int64)
    want = simhash.Forest(fps, tries, 2).link()
    monkeypatch.setattr(simhash, "FRONTIER", 16)
    assert simhash.Forest(fps, tries, 2).link().tolist() == want.tolist()


def test_blocks_follow_the_size():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**8, 10**10, 10**14)] == [5, 5, 6, 7, 8]
    for blocks in range(5, 9):
        assert all(m.bit_count() >= 64 * (blocks - 4) // blocks - 4 for m in simhash.masks_for(blocks))


def test_a_chain_is_one_class(spark):
    """Neighbours differ in four bits, the ends in many."""
    steps = [sum(0xF << (4 * j) for j in range(k)) for k in range(15)]
    fps = spark.createDataFrame([(s,) for s in steps], "fp long")
    roots = simhash.components(simhash.links(fps)).collect()
    assert {r.root for r in roots} == {0} and len(roots) == 14


def test_one_of_each_class_stays(spark, tricky, by_rows):
    kept = simhash.keep_one(tricky)
    assert kept.columns == tricky.columns
    found = simhash.near_duplicates(tricky).collect()
    classes = {r.root: r.component_id for r in found}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(c) for c in classes.values())


def test_no_rows(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_one(nothing).count() == 0


def test_hot_tries_are_split(spark, monkeypatch):
    """Fingerprints that agree on most bits are one trie; cut into blocks it gives the same classes."""
    rng = random.Random(8)
    fps = {rng.getrandbits(64) & 0xFFFFF | 0x1234567890000000 for _ in range(3000)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")

    def classes():
        return sorted(tuple(r) for r in simhash.components(simhash.links(df)).collect())

    want = classes()
    assert len(want) > 1000
    monkeypatch.setattr(simhash, "HOT", 200)
    rows = df.select("fp", F.lit(0).alias("t"), F.lit(7).cast("long").alias("key"))
    sizes = simhash._split(rows).groupBy("t", "key").count().collect()
    assert len(sizes) >= 100 and max(r["count"] for r in sizes) < 3 * 200
    assert classes() == want
