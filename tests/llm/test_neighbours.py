import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.llm import neighbours


def brute(rows, every=20, top=20):
    ok = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, x in {i: v for i, v in ok if i % every == 0}.items():
        best = {}
        for i, v in ok:
            if i != q and len(v) == len(x):
                score = 0.0
                for a, b in zip(x, v):
                    score += a * b
                best[i, score] = None
        ranked = sorted(best, key=lambda p: (-p[1], p[0]))[:top]
        out += [(q, k + 1, i, s) for k, (i, s) in enumerate(ranked)]
    return out


def frame(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.withColumn("axis", F.lit(1)).withColumn("width", F.lit("x"))


def test_small_tables_are_exact(spark, by_rows):
    rows = [(k, [float(k % 7) - 3, 1.0, float(k % 3)]) for k in range(15)]
    rows += [(20, [0.5, -2.0, 0.25]), (40, [0.0, 0.0, 0.0]), (60, None), (61, [None, 1.0, 1.0]), (62, [float("nan"), 1.0, 1.0])]
    rows += [(63, [float("inf"), 1.0, 0.0]), (None, [1.0, 1.0, 1.0]), (80, [1.0, 2.0]), (100, []), rows[3], rows[3], rows[0]]
    got = neighbours.search(frame(spark, rows))
    assert by_rows(got.collect()) == by_rows(brute(rows))


def test_ties_go_to_the_smaller_id(spark, by_rows):
    """A vector that most rows share, and its scores, which are equal to the last bit."""
    rng = np.random.default_rng(3)
    hot = rng.normal(size=16).tolist()
    rows = [(k, hot if k % 3 else rng.normal(size=16).tolist()) for k in range(400)]
    got = neighbours.search(frame(spark, rows), probes=64, tables=1)  # looks at every axis: exact
    assert by_rows(got.collect()) == by_rows(brute(rows))


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if scaled:
        x *= rng.uniform(0.5, 2, 2000)[:, None]
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))]
    got = {(r.query_id, r.vec_id) for r in neighbours.search(frame(spark, rows, "float")).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows)}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


def test_hot_axes_are_cut_into_blocks(spark, monkeypatch, by_rows):
    rows = [(k, [1.0 + 0.001 * (k % 11), 0.01 * (k % 5), 0.0, 0.0]) for k in range(300)]
    want = neighbours.search(frame(spark, rows), every=3).collect()
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "QUERIES", 10)
    assert by_rows(neighbours.search(frame(spark, rows), every=3).collect()) == by_rows(want)


def test_rotations_keep_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(5, 64))
    y = neighbours.rotated(x, 2)
    assert np.allclose(x @ x.T, y @ y.T)
    assert not np.allclose(y, neighbours.rotated(x, 3))


def test_no_rows(spark):
    assert neighbours.search(frame(spark, [])).count() == 0
