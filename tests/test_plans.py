import json
import os
from datetime import datetime

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from viewloom.functions import camera as C
from viewloom.operators import cameras, sampling, views
from viewloom.plans import build, evaluate, load, observe, prompts
from viewloom.sources import files, sinks

from test_artifacts import listing
from test_cameras import random_pose
from test_logs import table, train, val
from test_pixels import planes


def camera_text(pose):
    return json.dumps({k: [float(x) for x in pose[:3, i]] for i, k in enumerate(("x", "y", "z", "origin"))})


@pytest.fixture
def render_dir(tmp_path):
    rng = np.random.default_rng(0)
    for name, count in (("ada", 12), ("bo_b", 5), ("cleo", 12)):
        os.makedirs(tmp_path / "renders" / name)
        for i in range(count):
            (tmp_path / "renders" / name / f"{i:05d}.png").write_bytes(f"{name}{i}".encode())
            (tmp_path / "renders" / name / f"{i:05d}.json").write_text(camera_text(random_pose(rng)))
    (tmp_path / "renders" / "bo_b" / "00009.png").write_bytes(b"no camera")
    return str(tmp_path / "renders")


def test_build_writes_splits(spark, render_dir, tmp_path, rows):
    out = str(tmp_path / "shards")
    build.build(spark, render_dir, out, "chibi", n=12)
    train_set = sinks.read_split(spark, out, "train")
    assert rows(train_set, "uid", "name", "caption") == [
        ("chibi_train_000", "ada", "a 3D character named ada"), ("chibi_train_001", "bo_b", "a 3D character named bo b")
    ]
    assert rows(sinks.read_split(spark, out, "val"), "uid", "name") == [("chibi_val_000", "cleo")]
    bob = train_set.where("name = 'bo_b'").first()
    assert bytes(bob["00004.png"]) == b"bo_b4" and bob["00009.png"] is None


def test_build_refuses_thin_objects(spark, render_dir, tmp_path):
    with pytest.raises(ValueError, match="bo_b"):
        build.build(spark, render_dir, str(tmp_path / "none"), "chibi", n=12, min_views=6)
    renders = files.read_renders(spark, render_dir)
    assert [r.uid for r in build.rejected(renders, 12, 6).collect()] == ["bo_b"]
    assert build.pack_samples(renders, "chibi", 12, 6).count() == 2


RINGS = ((0, 8, 8 / 12), (8, 4, 4 / 12))


def test_training_rows_equal_the_table_form(spark, render_dir, rows):
    samples = build.pack_samples(files.read_renders(spark, render_dir), "chibi", 12, 4)
    picked = load.training_views(samples, 6, 4, seed=1, n=12, rings=RINGS, exclude=())
    # the same choice through the long tables
    flags = files.render_flags(files.read_renders(spark, render_dir))
    names = samples.select("uid", "name")
    sets = views.view_sets(flags, 12).withColumnRenamed("uid", "name").join(names, "name").select("uid", "mask")
    long = sampling.fill_views(sampling.pick_existing(sets, 4, 1, RINGS), 6, 1, 12, exclude=())
    assert rows(picked, "uid", "slot", "view_id") == rows(long, "uid", "slot", "view_id")
    assert "chibi_train_001" in {r.uid for r in load.failed_samples(samples, 4, 1, 12, RINGS).collect()} or len(rows(long)) == 18
    # and the same cameras through the window form
    made = load.training_rows(picked)
    poses = cameras.parse_cameras(picked).select("uid", "slot", "c2w")
    left = {(r.uid, r.slot): r.c2w for r in made.collect()}
    right = {(r.uid, r.slot): r.c2w for r in cameras.training_cameras(poses).collect()}
    assert set(left) == set(right)
    for key in left:
        np.testing.assert_allclose(left[key], right[key], atol=1e-9)
    png = {(r.uid, r.slot): (bytes(r.png).decode(), r.view_id) for r in made.collect()}
    assert all(text.endswith(str(view)) for text, view in png.values())


def test_training_rows_do_not_shuffle(spark, tmp_path):
    wide = spark.createDataFrame(
        [("u", b"p0", camera_text(np.eye(4)).encode())], "uid STRING, `00000.png` BINARY, `00000.json` BINARY"
    )
    wide.write.parquet(str(tmp_path / "w"))
    samples = spark.read.parquet(str(tmp_path / "w"))
    made = load.training_rows(load.training_views(samples, 2, 1, 1, n=1, even=False, exclude=()))
    assert made.count() == 2
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_prompts_join_samples(spark):
    store = spark.createDataFrame(
        [("sd15", f"u{i}", [[float(i)]], None, None) for i in range(50)] + [("sd15", "null", [[-1.0]], None, None)],
        "model STRING, uid STRING, tokens ARRAY<ARRAY<FLOAT>>, pooled ARRAY<FLOAT>, attention_mask ARRAY<FLOAT>",
    )
    samples = spark.createDataFrame([(f"x/u{i}.glb",) for i in range(60)], "uid STRING")
    made = load.with_prompts(samples, store, "sd15", 0.2, 1, 0).collect()
    assert len(made) == 50
    assert {r.tokens == [[-1.0]] for r in made if r.drop_text} == {True}
    assert 5 < sum(r.drop_text for r in made) < 35


def test_failed_embeddings_are_stored_in_small_row_groups(spark, tmp_path):
    def broken():
        raise RuntimeError("no model")

    pairs = spark.range(24).select(F.col("id").cast("string").alias("uid"), F.lit("a").alias("caption"))
    for model in ("sd15", "pas"):
        prompts.embed_captions(pairs.coalesce(1), broken, model, str(tmp_path / "e"), zero_null=True, on_error="zeros")
    stored = [pq.ParquetFile(p).metadata for p in (tmp_path / "e" / "model=pas").glob("*.parquet")]
    groups = [m.row_group(k).num_rows for m in stored for k in range(m.num_row_groups)]
    # a reader unpacks 300 x 4096 numbers a row
    assert sum(groups) == 25 and max(groups) <= prompts.GROUP_NUMBERS // (300 * 4096)
    assert sum(m.num_rows > 0 for m in stored) > 4
    kinds = spark.read.parquet(str(tmp_path / "e")).groupBy("model", "fallback").agg(
        F.count("uid").alias("n"),
        F.max(F.size("tokens")).alias("length"),
        F.max(F.size(F.col("tokens")[0])).alias("width"),
        F.max(F.size("attention_mask")).alias("mask"),
        F.max(F.array_max(F.transform("tokens", F.array_max))).alias("top"),
    )
    assert {tuple(r) for r in kinds.collect()} == {
        ("sd15", True, 24, 77, 768, None, 0.0), ("sd15", False, 1, 77, 768, None, 0.0),
        ("pas", True, 24, 300, 4096, 300, 0.0), ("pas", False, 1, 300, 4096, 300, 0.0),
    }


def test_model_comparison(spark):
    rng = np.random.default_rng(1)
    truth = {("u", v): rng.uniform(size=(3, 9, 9)) for v in (0, 10, 20, 30)}
    noisy = {("u", s): np.clip(truth["u", v] + 0.1, 0, 1) for s, v in enumerate((0, 10, 20, 30))}
    worse = {k: np.clip(p + 0.2, 0, 1) for k, p in noisy.items()}
    pred = planes(spark, noisy).withColumn("model", F.lit("b")).unionByName(planes(spark, worse).withColumn("model", F.lit("a")))
    got = {r.model: r for r in evaluate.compare_models(pred.withColumnRenamed("view_id", "slot"), planes(spark, truth)).collect()}
    assert got["b"].psnr_mean > got["a"].psnr_mean and got["b"].ssim_mean > got["a"].ssim_mean
    assert got["b"].ssim_std >= 0


def test_overview(spark):
    shown = listing(spark, [("r", "x_000001_gs.png", 20, 0), ("quiet", "y.gif", 1, 0)])
    start = F.lit(datetime(2024, 1, 1, 0, 10)).cast("timestamp_ntz")
    got = {r.run: r for r in observe.run_overview(table(spark, [train(4), val()]), shown, start).collect()}
    assert (got["r"].step, got["r"].image, got["r"].psnr) == (4, "x_000001_gs.png", 20.5)
    assert got["quiet"].video == "y.gif" and not got["quiet"].reported


def test_captions_are_complete_before_anything_is_encoded(spark):
    subset = spark.createDataFrame([("1",), ("2",)], "gid STRING")
    gidmap = spark.createDataFrame([("1", "d/a.glb"), ("2", "d/b.glb")], "gid STRING, path STRING")
    table = spark.createDataFrame([("a", "x")], "oid STRING, caption STRING")
    with pytest.raises(ValueError, match="1 objects have no caption, the first is b"):
        prompts.resolve_captions(subset, gidmap, table)
    with pytest.raises(ValueError, match="1 listed ids are not in the map, the first is 2"):
        prompts.resolve_captions(subset, gidmap.where("gid = '1'"), table)
    whole = table.union(spark.createDataFrame([("b", None)], table.schema))
    assert sorted(map(tuple, prompts.resolve_captions(subset, gidmap, whole).collect()), key=str) == [("a", "x"), ("b", None)]
