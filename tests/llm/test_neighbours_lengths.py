import numpy as np
import pytest

from viewloom.llm import neighbours


@pytest.mark.parametrize("kind", ["outlier", "log-normal"])
def test_recall_when_lengths_differ(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "outlier":
        x[1] *= 5
    else:
        x *= rng.lognormal(size=6000)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in neighbours.search(df, every=40).collect()}
    want = set()
    for q in range(0, 6000, 40):
        score = x @ x[q]
        score[q] = -np.inf
        want |= {(q, int(i)) for i in np.argsort(-score)[:20]}
    print(kind, len(got & want) / len(want))
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
