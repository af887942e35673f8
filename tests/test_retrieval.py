import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.operators import metrics, retrieval

from test_metrics import vectors


def same(found, images, texts):
    got = sorted((r.grp, r.idx, r.best_idx, round(r.best, 9)) for r in found.collect())
    want = sorted((r.grp, r.idx, r.best_idx, round(r.best, 9)) for r in metrics.best_texts(images, texts).collect())
    assert got == want


def clustered(rng, n, clusters, spread, dims=16):
    centres = rng.normal(size=(clusters, dims))
    return centres[rng.integers(0, clusters, n)] + rng.normal(scale=spread, size=(n, dims))


@pytest.mark.parametrize("block", [7, 1000])
@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_equal_to_comparing_with_all(spark, block, spread):
    rng = np.random.default_rng(3)
    images = vectors(spark, clustered(rng, 60, 6, spread)).unionByName(vectors(spark, clustered(rng, 9, 2, spread), 5))
    texts = vectors(spark, clustered(rng, 80, 6, spread)).unionByName(vectors(spark, clustered(rng, 3, 2, spread), 5))
    images, texts = images.cache(), texts.cache()
    same(retrieval.nearest_texts(images, texts, anchors=8, block=block), images, texts)


def test_ties_and_one_sided_groups(spark):
    images = vectors(spark, [[1, 0], [0, 1], [1, 0]]).unionByName(vectors(spark, [[1, 1]], 7))
    texts = vectors(spark, [[2, 0], [0, 3], [4, 0], [0, 5]]).unionByName(vectors(spark, [[1, 1]], 8))
    for anchors in (1, 2, 64):
        found = {(r.grp, r.idx): r.best_idx for r in retrieval.nearest_texts(images, texts, anchors).collect()}
        assert found == {(0, 0): 0, (0, 1): 1, (0, 2): 0}
    assert retrieval.nearest_texts(images, texts.where("false")).count() == 0


def test_few_cells_are_opened_on_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 32))
    both = [(centres[rng.integers(0, 20, n)] + rng.normal(scale=0.1, size=(n, 32))) for n in (400, 600)]
    images, texts = (vectors(spark, v).cache() for v in both)
    found = retrieval.nearest_texts(images, texts, anchors=60).cache()
    same(found, images, texts)
    share = found.agg(F.sum("opened") / F.sum("cells")).first()[0]
    assert share < 1 / 3
