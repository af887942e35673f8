import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from viewloom.llm import chosen


def changed(words, share, rng):
    """A copy with one run of words replaced, so that about ``share`` of the shingles of both are common."""
    k = round(len(words) * (1 - share) / (1 + share))
    at = rng.randrange(10, len(words) - k - 10)
    return words[:at] + [f"new{rng.random()}" for _ in range(k - 4)] + words[at + k - 4 :]


def jaccard(a, b, shingle=5):
    a, b = (set(chosen.shingle_set(t.encode(), shingle).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a and b else 0.0


def pairs(n=60):
    rng, out = random.Random(4), []
    for k in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        out.append((" ".join(words), " ".join(changed(words, 0.805 + 0.19 * k / n, rng))))
    return out


def classes(texts, bound=0.8, shingle=5):
    label = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if label[i] != label[j] and jaccard(a, texts[j], shingle) >= bound:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def found(docs, **more):
    return {r.doc_id: r.component_id for r in chosen.near_duplicates(docs, **more).collect()}


def families(n=4, members=12, length=150, seed=2):
    """Texts that are alike only over others of their family."""
    rng, texts = random.Random(seed), []
    for _ in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        for _ in range(members):
            texts.append(" ".join(words))
            words = changed(words, rng.choice([0.7, 0.88, 0.92]), rng)
    return texts


def test_stage_drops_copies_of_similarity_from_08(spark):
    both = pairs()
    assert min(jaccard(a, b) for a, b in both) >= 0.8
    rng = random.Random(9)
    far = [" ".join(changed(a.split(), 0.7, rng)) for a, _ in both[:10]]
    assert max(jaccard(a, b) for (a, _), b in zip(both, far)) < 0.8
    rows = [(k, a) for k, (a, _) in enumerate(both)] + [(100 + k, b) for k, (_, b) in enumerate(both)]
    docs = spark.createDataFrame(rows + [(200 + k, t) for k, t in enumerate(far)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(range(60)) | {200 + k for k in range(10)}


@pytest.mark.parametrize("leaf, depth", [(256, 8), (4, 4), (4, 1)])
def test_groups_as_by_all_pairs(spark, leaf, depth):
    """Exhaustive nodes, branched ones, and blocks of large ones."""
    texts = families()
    want = classes(texts)
    assert 4 < len(set(want)) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(docs, leaf=leaf, depth=depth) == dict(enumerate(want))


def test_large_group_without_links_needs_no_pairs_of_it(spark, monkeypatch):
    """Texts that share a passage, far from similar: the rows of all steps follow the texts, not their pairs."""
    rng = random.Random(6)
    passage = " ".join(f"common{k}" for k in range(40))
    texts = [passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(3000)]
    sizes, stored = {}, chosen.stored

    def counted(df, name):
        out = stored(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(chosen, "stored", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = chosen.near_duplicates(docs).where("doc_id != component_id").count()
    assert got == 0 and max(sizes.values()) <= chosen.PATHS * len(texts)
    assert sizes["links"] == 0


def test_large_families_lose_no_pair(spark, monkeypatch):
    """Pairs that no link between promising sets names, as those sets are joined over others that are not similar."""
    monkeypatch.setattr(chosen, "FAMILY", 1)
    # all sets meet in one node only
    monkeypatch.setattr(chosen, "first_nodes", lambda tokens: np.zeros(1, np.uint64))
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(25):
        words = changed(base, 0.78, rng)
        texts += [" ".join(words), " ".join(changed(words, 0.85, rng))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(docs) == dict(enumerate(classes(texts)))


def test_parts_of_a_node_hold_all_promising_pairs(spark):
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 1 << 32, (3, chosen.TOKENS), np.uint64).astype(np.uint32)
    tokens = np.concatenate([tokens[:1].repeat(3, axis=0), tokens[1:2].repeat(2, axis=0), tokens[2:]])
    rows = [(k, 10, *chosen._long(chosen.sketch(t)).tolist()) for k, t in enumerate(tokens)]
    sets = spark.createDataFrame(rows, "set long, n long, s0 long, s1 long, s2 long, s3 long")
    nodes = sets.select(F.lit(7).cast("long").alias("node"), "set", F.col("set").alias("label"))
    got = {}
    for r in chosen._leaves(nodes, sets, 0.8, parts=True).collect():
        got.setdefault(r.part, set()).add(r.set)
    assert sorted(map(sorted, got.values())) == [[0, 1, 2], [3, 4]]


def test_large_group_of_near_copies_is_joined_by_its_hubs(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(changed(words, 0.9, rng)) for _ in range(1500)] + [" ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert set(found(docs).values()) == {0}


def test_similarity_and_shingle_are_the_callers(spark):
    texts = families(2, 8, seed=5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bound, shingle in ((0.9, 3), (0.65, 5)):
        assert found(docs, similarity=bound, shingle=shingle) == dict(enumerate(classes(texts, bound, shingle)))


def test_intersections_as_by_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in (1, 5, 900, 2500, 2500, 40)] + [np.arange(9000, dtype=np.uint64)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert chosen.overlaps(sets).tolist() == want


def test_sketches_let_nearly_all_pairs_pass():
    rng, passed = np.random.default_rng(3), 0
    for n in (10, 100, 1000, 10000):
        for _ in range(50):
            x = rng.integers(0, 1 << 64, n, np.uint64)
            a, b = x[: n * 9 // 10], np.concatenate((x[: n * 4 // 5], x[n * 9 // 10 :]))
            s, t = (chosen.sketch(chosen.minwise(np.sort(y))) for y in (a, b))
            d = (s ^ t) | ((s ^ t) >> np.uint64(1))
            passed += 128 - np.bitwise_count(d & np.uint64(0x5555555555555555)).sum() >= chosen.least_alike(0.8)
    assert passed == 200


def test_odd_rows(tricky, nothing, pairs, by_rows):
    """Nulls, texts without words, repeated rows and ids, very long texts, clashing columns."""
    docs = tricky.withColumns({c: F.lit(1) for c in ("set", "n", "nodes", "row", "root", "s0")})
    want = {}
    texts = [t or "" for _, t in pairs]
    for k, label in enumerate(classes(texts, shingle=4)):
        want.setdefault(label, []).append(k)
    rows = []
    for members in want.values():
        ids = [pairs[k][0] for k in members if pairs[k][0] is not None]
        for k in members:
            n = len(chosen.shingle_set(texts[k].encode(), 4))
            own = (min(ids) if ids else None) if n else pairs[k][0]
            rows.append((pairs[k][0], n, own, pairs[k][0] == own))
    got = chosen.digest(chosen.near_duplicates(docs, shingle=4))
    assert by_rows(got.collect()) == by_rows(rows)
    kept = chosen.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.where("doc_id IN (20, 21, 22)").collect()} == {20, 21, 22}
    assert chosen.keep_one(nothing).count() == 0 and chosen.near_duplicates(nothing).count() == 0
