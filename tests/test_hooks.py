import pickle
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from viewloom.operators import hooks, metrics

# the encoders below travel to the workers, which do not know this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def captions(spark, n=10):
    return spark.range(n).select(F.col("id").cast("string").alias("uid"), F.concat(F.lit("A "), F.col("id").cast("string")).alias("caption"))


def length_encoder():
    def encode(texts, length):
        tokens = [np.full((2, 3), len(t), dtype=np.float64) for t in texts]
        return tokens, [[float(length)]] * len(texts), [[1.0, 0.0] if t.islower() else [0.0] for t in texts]

    return encode


def test_encoder(spark):
    got = hooks.encode(captions(spark, 12), length_encoder, "sd35m", batch=5).orderBy(F.col("uid").cast("int")).collect()
    assert len(got) == 12
    assert got[11].tokens == [[4.0] * 3] * 2 and got[11].pooled == [333.0] and got[11].attention_mask == [0.0]
    assert not any(r.fallback for r in got)


def test_lower_casing_models(spark):
    got = hooks.encode(captions(spark, 2), length_encoder, "pas").collect()
    assert all(r.attention_mask == [1.0, 0.0] and r.pooled == [300.0] for r in got)


def test_null_row(spark):
    got = {r.uid: r for r in hooks.encode_with_null(captions(spark, 2), length_encoder, "sd15").collect()}
    assert set(got) == {"0", "1", "null"} and got["null"].tokens[0] == [0.0] * 3


def wide_encoder():
    return lambda texts, length: (np.ones((len(texts), 64, 1024)) * 0.5, None, None)


def test_large_embeddings_leave_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(hooks, "PIECE_BYTES", 1 << 20)
    made = hooks.encode(captions(spark, 40).coalesce(1), wide_encoder, "sd15", batch=16)
    assert {(r.uid, len(r.tokens), len(r.tokens[0]), r.tokens[63][1023]) for r in made.collect()} == {
        (str(i), 64, 1024, 0.5) for i in range(40)
    }


def flaky_encoder():
    def encode(texts, length):
        if any("3" in t for t in texts):
            raise RuntimeError("boom")
        return [np.ones((1, 1))] * len(texts), None, None

    return encode


def test_fallback_is_flagged(spark):
    got = hooks.encode(captions(spark, 6).coalesce(1), flaky_encoder, "sd15", batch=2, on_error="zeros").collect()
    flagged = {r.uid for r in got if r.fallback}
    assert flagged == {"2", "3"}
    zero = next(r for r in got if r.uid == "3")
    assert (len(zero.tokens), len(zero.tokens[0])) == (77, 768) and zero.pooled is None


def test_failure_ends_the_job(spark):
    with pytest.raises(Exception, match="boom"):
        hooks.encode(captions(spark, 6), flaky_encoder, "sd15").collect()


def test_arguments(spark):
    with pytest.raises(ValueError):
        hooks.encode(captions(spark), length_encoder, "unknown")
    with pytest.raises(ValueError):
        hooks.encode(captions(spark), length_encoder, "sd15", on_error="ignore")


def test_transform_and_score(spark):
    made = hooks.transform_samples(captions(spark, 4), lambda f: f.assign(n=f["caption"].str.len())[["uid", "n"]], "uid STRING, n BIGINT")
    assert {r.n for r in made.collect()} == {3}
    scored = hooks.score_pairs(captions(spark, 4), lambda: lambda f: f["uid"].astype(float) * 2)
    assert sorted(r.score for r in scored.collect()) == [0.0, 2.0, 4.0, 6.0]
    assert scored.columns == ["uid", "caption", "score"]


@pytest.mark.parametrize("make", [metrics._plane_scorer, metrics._block_matcher])
def test_task_code_does_not_need_this_package(spark, make):
    """Executors without the package installed can still run the tasks."""
    fn = make()
    payload = cloudpickle.dumps(getattr(fn, "func", fn))
    code = "import pickle, sys; f = pickle.loads(sys.stdin.buffer.read()); print('viewloom' in sys.modules, callable(f))"
    done = subprocess.run([sys.executable, "-c", code], input=payload, capture_output=True, cwd="/", timeout=60)
    assert done.stdout.split() == [b"False", b"True"], done.stderr
    assert pickle.loads(payload)


def test_python_sends_no_zeros(spark):
    def broken():
        raise RuntimeError("no model")

    made = hooks.encode(captions(spark, 3), broken, "sdxl", on_error="zeros")
    assert "array_repeat" in made._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert made.schema == hooks.encode(captions(spark, 3), broken, "sdxl").schema
    for r in made.collect():
        assert r.tokens == [[0.0] * 2048] * 77 and r.pooled == [0.0] * 1280 and r.attention_mask is None and r.fallback
