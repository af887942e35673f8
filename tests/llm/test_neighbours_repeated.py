import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.llm import neighbours


@pytest.mark.parametrize("times", [2, 25])
def test_repeated_rows_cost_no_neighbour(spark, monkeypatch, by_rows, times):
    """All rows several times give what all rows once give, whether found by probes or by looking at every row."""
    monkeypatch.setattr(neighbours, "BLOCK", 100)  # larger bands are probed
    x = np.random.default_rng(6).normal(size=(400, 16))
    once = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    many = once.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times))))
    for probes in (1, 64):
        want = neighbours.search(once, probes=probes).collect()
        assert by_rows(neighbours.search(many, probes=probes).collect()) == by_rows(want)
    exact = [(q, i) for q in range(0, 400, 20) for i in sorted((k for k in range(400) if k != q), key=lambda k: -x[q] @ x[k])[:20]]
    assert {(r.query_id, r.vec_id) for r in neighbours.search(many, probes=64, tables=1).collect()} == set(exact)
