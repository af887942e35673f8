import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.operators import metrics

from test_pixels import planes

PAIRS = "uid STRING, view_id INT, channel INT, h INT, w INT, a ARRAY<FLOAT>, b ARRAY<FLOAT>"


def pairs(spark, items):
    """(uid, view, a stack, b stack) as plane pairs."""
    data = []
    for uid, view, a, b in items:
        for c in range(len(a)):
            data.append((uid, view, c, *a[c].shape, [float(x) for x in a[c].reshape(-1)], [float(x) for x in b[c].reshape(-1)]))
    return spark.createDataFrame(data, PAIRS)


def random_items(shapes, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i, shape in enumerate(shapes):
        a = rng.uniform(size=shape).astype(np.float32)
        b = np.clip(a + rng.normal(scale=0.1, size=shape), 0, 1).astype(np.float32)
        out.append((f"u{i}", i, a, b))
    return out


def test_psnr_per_image_and_pooled(spark):
    items = random_items([(3, 8, 8)] * 4)
    both = pairs(spark, items)
    each = {r.uid: r.psnr for r in metrics.psnr(both).collect()}
    mse = {u: float(((a.astype(float) - b.astype(float)) ** 2).mean()) for u, _, a, b in items}
    for u in mse:
        assert each[u] == pytest.approx(-10 * math.log10(mse[u]))
    pooled = metrics.psnr_pooled(both.withColumn("run", F.lit(1)), ["run"]).first().psnr
    assert pooled == pytest.approx(-10 * math.log10(np.mean(list(mse.values()))))
    assert pooled != pytest.approx(np.mean(list(each.values())))


def test_identical_images_score_infinity(spark):
    a = np.full((3, 2, 2), 0.5, dtype=np.float32)
    assert metrics.psnr(pairs(spark, [("u", 0, a, a)])).first().psnr == math.inf


def slow_ssim(a, b):
    """Window by window, straight from the definition."""
    a = (a.astype(np.float32) * np.float32(255)).astype(np.uint8).astype(float)
    b = (b.astype(np.float32) * np.float32(255)).astype(np.uint8).astype(float)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    h, w = a.shape
    scores = []
    for y in range(h - 6):
        for x in range(w - 6):
            p, q = a[y : y + 7, x : x + 7].ravel(), b[y : y + 7, x : x + 7].ravel()
            cov = np.cov(p, q, ddof=1)
            scores.append(
                ((2 * p.mean() * q.mean() + c1) * (2 * cov[0, 1] + c2))
                / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2))
            )
    return float(np.mean(scores))


def test_ssim_by_definition(spark):
    items = random_items([(3, 8, 8), (3, 8, 8), (1, 16, 11), (3, 24, 24)], seed=5)
    got = {r.uid: r.ssim for r in metrics.ssim(pairs(spark, items)).collect()}
    for u, _, a, b in items:
        assert got[u] == pytest.approx(np.mean([slow_ssim(x, y) for x, y in zip(a, b)]), abs=1e-9)


def test_ssim_edge_cases(spark):
    same = np.random.default_rng(0).uniform(size=(1, 9, 9)).astype(np.float32)
    small = np.zeros((1, 6, 9), dtype=np.float32)
    got = {r.uid: r.ssim for r in metrics.ssim(pairs(spark, [("same", 0, same, same), ("small", 0, small, small)])).collect()}
    assert got["same"] == pytest.approx(1.0) and got["small"] is None


def test_summary_spreads(spark):
    values = [1.0, 2.0, 4.0]
    df = spark.createDataFrame([(v, v, v) for v in values], "psnr DOUBLE, lpips DOUBLE, ssim DOUBLE")
    r = metrics.score_summary(df).first()
    assert r.psnr_std == pytest.approx(np.std(values, ddof=1)) == pytest.approx(r.lpips_std)
    assert r.ssim_std == pytest.approx(np.std(values))
    assert r.psnr_mean == pytest.approx(np.mean(values))


def vectors(spark, array, grp=0):
    return spark.createDataFrame(
        [(grp, i, [float(x) for x in v]) for i, v in enumerate(array)], "grp BIGINT, idx BIGINT, vec ARRAY<FLOAT>"
    )


@pytest.mark.parametrize("block", [5, 1000])
def test_retrieval_in_blocks(spark, block):
    rng = np.random.default_rng(7)
    img = rng.normal(size=(40, 6)).astype(np.float32)
    txt = (img + rng.normal(scale=1.0, size=img.shape)).astype(np.float32)
    a = img / np.linalg.norm(img, axis=1, keepdims=True)
    b = txt / np.linalg.norm(txt, axis=1, keepdims=True)
    scores = a.astype(float) @ b.astype(float).T
    images, texts = vectors(spark, img), vectors(spark, txt)
    found = {r.idx: r.best_idx for r in metrics.best_texts(images, texts, block).collect()}
    assert found == dict(enumerate(scores.argmax(axis=1).tolist()))
    share = metrics.r_precision(images, texts, block).first().r_precision
    assert share == pytest.approx((scores.argmax(axis=1) == np.arange(40)).mean())
    assert metrics.clip_sim(images, texts).first().clip_sim == pytest.approx(scores.diagonal().mean(), abs=1e-6)


def test_copies_of_a_row_do_not_grow_with_small_blocks(spark):
    counts = [1, 64, 65, 1000, 32_768, 32_769, 1_000_000]
    rows = spark.createDataFrame([(n,) for n in counts], "n BIGINT")
    got = rows.select("n", *(metrics.blocks_of(F.col("n"), b).alias(f"b{b}") for b in (64, 8192, 20_000))).collect()
    assert {r.n: (r.b64, r.b8192, r.b20000) for r in got} == {
        1: (1, 1, 1), 64: (1, 1, 1), 65: (2, 1, 1), 1000: (4, 1, 1), 32_768: (4, 4, 2), 32_769: (5, 5, 2), 1_000_000: (123, 123, 50),
    }


def test_few_copies_are_shuffled(spark):
    rng = np.random.default_rng(5)
    images, texts = (vectors(spark, rng.normal(size=(40, 4))) for _ in range(2))

    def matcher(match=metrics._block_matcher()):
        def best(left, right):
            return match(left, right).assign(best_idx=len(left) + len(right))

        return best

    kept, metrics._block_matcher = metrics._block_matcher, matcher
    try:
        found = metrics.best_texts(images, texts, block=2).collect()
    finally:
        metrics._block_matcher = kept
    # four blocks of each side, not twenty
    assert len(found) == 40 and min(r.best_idx for r in found) > 4


@pytest.mark.parametrize("block", [1, 100])
def test_ties_go_to_the_lowest_index(spark, block):
    images = vectors(spark, [[1, 0], [0, 1], [1, 0]])
    texts = vectors(spark, [[2, 0], [0, 3], [4, 0]])
    found = {r.idx: r.best_idx for r in metrics.best_texts(images, texts, block).collect()}
    assert found == {0: 0, 1: 1, 2: 0}


def test_groups_do_not_mix(spark):
    images = vectors(spark, [[1, 0]], 1).unionByName(vectors(spark, [[0, 1]], 2))
    texts = vectors(spark, [[0, 1], [1, 0]], 1).unionByName(vectors(spark, [[0, 1]], 2))
    assert {(r.grp, r.best_idx) for r in metrics.best_texts(images, texts).collect()} == {(1, 1), (2, 0)}


def test_view_summary_skips_blanks(spark):
    df = spark.createDataFrame([(0.2, 1.0), (0.4, None), (0.9, 0.0)], "clip_sim DOUBLE, r_precision DOUBLE")
    r = metrics.view_summary(df, ["clip_sim", "r_precision"]).first()
    assert r.clip_sim_std == pytest.approx(np.std([0.2, 0.4, 0.9])) and r.r_precision_mean == 0.5


def test_normal_cosine_is_along_channels(spark):
    a, b = np.random.default_rng(3).normal(size=(2, 3, 10))
    b[:, 4] = 0
    row = tuple(map(lambda v: [float(x) for x in v], [*a, *b]))
    df = spark.createDataFrame([("u", 0, *row)], "uid STRING, view_id INT, ax ARRAY<DOUBLE>, ay ARRAY<DOUBLE>, az ARRAY<DOUBLE>, bx ARRAY<DOUBLE>, by ARRAY<DOUBLE>, bz ARRAY<DOUBLE>")
    norms = np.maximum(np.linalg.norm(a, axis=0), 1e-8) * np.maximum(np.linalg.norm(b, axis=0), 1e-8)
    assert metrics.normal_cosine(df).first().normal_cosim == pytest.approx(((a * b).sum(axis=0) / norms).mean())


def test_rollup_names_and_cap(spark, rows):
    data = [("psnr", 1.0, 0, 10.0), ("psnr", 1.0, 1, 20.0), ("psnr", 1.0, 2, 90.0), ("ssim", 7.5, 0, 0.5), ("ssim", 11.0, 0, 0.25)]
    df = spark.createDataFrame(data, "metric STRING, cfg DOUBLE, batch_id INT, value DOUBLE")
    assert rows(metrics.val_rollup(df, 2), "name", "value") == [
        ("validation/ssim_cfg11.0", 0.25), ("validation/ssim_cfg7.5", 0.5), ("validation_cfg1.0/psnr_cfg1.0", 15.0)
    ]
    assert dict(rows(metrics.val_rollup(df), "name", "value"))["validation_cfg1.0/psnr_cfg1.0"] == 40.0


def test_rank_mean_weighs_by_batch(spark):
    df = spark.createDataFrame([("m", 1.0, 3), ("m", 5.0, 1)], "name STRING, value DOUBLE, batch_size INT")
    assert metrics.rank_mean(df, ["name"]).first().value == 2.0


def test_elevation_error(spark):
    df = spark.createDataFrame([(1.0, 3.0), (5.0, 1.0)], "pred DOUBLE, truth DOUBLE")
    assert metrics.elev_mae(df).first().err_degree == 3.0


def test_pairing_of_predictions(spark, rows):
    truth = planes(spark, {("u", v): np.full((1, 1, 1), v / 100) for v in (0, 1, 10, 20, 30)})
    pred = planes(spark, {("u", s): np.full((1, 1, 1), s / 10) for s in range(5)}).withColumnRenamed("view_id", "slot")
    paired = metrics.pair_eval(pred, truth)
    assert rows(paired, "slot", "view_id") == [(0, 0), (1, 10), (2, 20), (3, 30)]


def test_unmatched(spark, rows):
    left = spark.createDataFrame([(1,), (2,)], "k INT")
    right = spark.createDataFrame([(2,), (3,)], "k INT")
    assert rows(metrics.unmatched(left, right, ["k"])) == [(1, "left"), (3, "right")]


def test_planes_of_unequal_size_are_refused(spark):
    pairs = spark.createDataFrame([("u", 0, [0.1, 0.2, 0.3], [0.1, 0.2])], "uid STRING, view_id INT, a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    with pytest.raises(Exception, match="unequal size"):
        metrics.psnr(pairs).collect()


def test_both_image_scores_come_from_one_pass(spark):
    rng = np.random.default_rng(8)
    data = [("u", v, 8, 8, rng.random(64).tolist(), rng.random(64).tolist()) for v in (0, 0, 1)]
    pairs = spark.createDataFrame(data, "uid STRING, view_id INT, h INT, w INT, a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    both = {r.view_id: (r.psnr, r.ssim) for r in metrics.image_scores(pairs).collect()}
    apart = {r.view_id: r.psnr for r in metrics.psnr(pairs).collect()}, {r.view_id: r.ssim for r in metrics.ssim(pairs).collect()}
    for view, (psnr, ssim) in both.items():
        assert psnr == pytest.approx(apart[0][view]) and ssim == pytest.approx(apart[1][view])
