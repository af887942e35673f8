from datetime import datetime

import pytest
from pyspark.sql import functions as F

from viewloom.operators import artifacts

LISTING = "run STRING, path STRING, name STRING, mtime TIMESTAMP_NTZ, length BIGINT"


def listing(spark, items):
    return spark.createDataFrame(
        [(run, f"/out/{run}/inference/{name}", name, datetime(2024, 1, 1, 0, minute, second), 10) for run, name, minute, second in items],
        LISTING,
    )


def start():
    return F.lit("2024-01-01 00:10:00").cast("timestamp_ntz")


def picked(spark, items):
    return {r.run: (r.image, r.video) for r in artifacts.pick_outputs(listing(spark, items), start()).collect()}


def test_own_video_beats_newer_ones(spark):
    assert picked(spark, [("r", "a_gs.png", 11, 0), ("r", "b_gs.png", 12, 0), ("r", "b.gif", 11, 0), ("r", "z.mp4", 13, 0)]) == {
        "r": ("b_gs.png", "b.gif")
    }


def test_fallbacks(spark):
    got = picked(
        spark,
        [
            ("no_own", "a_gs.png", 11, 0), ("no_own", "x.gif", 11, 0), ("no_own", "y.mp4", 12, 0),
            ("old", "a_gs.png", 1, 0), ("old", "b_gs.png", 2, 0), ("old", "b.gif", 1, 0), ("old", "c.mp4", 3, 0),
            ("old_image", "a_gs.png", 1, 0), ("old_image", "a.gif", 11, 0), ("old_image", "z.gif", 12, 0),
            ("image_only", "a_gs.png", 11, 0),
            ("video_only", "a.mp4", 11, 0),
            ("other", "a.png", 11, 0),
        ],
    )
    assert got == {
        "no_own": ("a_gs.png", "y.mp4"),
        "old": ("b_gs.png", "c.mp4"),
        # the stem only counts for a recent image
        "old_image": ("a_gs.png", "z.gif"),
        "image_only": ("a_gs.png", None),
        "video_only": (None, "a.mp4"),
    }


def test_a_second_of_grace_and_ties_by_name(spark):
    assert picked(spark, [("r", "b_gs.png", 9, 59), ("r", "a_gs.png", 9, 59), ("r", "c_gs.png", 9, 58)]) == {"r": ("b_gs.png", None)}


def test_recent_outputs_in_order(spark):
    items = [("r", "b.png", 12, 0), ("r", "a.gif", 12, 0), ("r", "c.mp4", 11, 0), ("r", "d.txt", 12, 0), ("r", "e.png", 9, 0)]
    assert [r.name for r in artifacts.recent_outputs(listing(spark, items), start()).collect()] == ["c.mp4", "a.gif", "b.png"]


def test_checkpoint_listings(spark, rows):
    paths = ["a/checkpoints/000100/unet/x", "a/checkpoints/000100/y", "a/checkpoints/002000", "a/log.txt", "b/checkpoints/junk/x", "c/inference/p_000007_gs.png"]
    df = spark.createDataFrame([(p[0], "/out/" + p, p.split("/")[-1]) for p in paths], "run STRING, path STRING, name STRING")
    found = artifacts.list_checkpoints(df)
    assert rows(found, "run", "folder", "ckpt") == [("a", "000100", 100), ("a", "002000", 2000)]
    assert rows(artifacts.list_experiments(df)) == [("a",), ("b",)]
    assert rows(artifacts.latest_checkpoint(found)) == [("a", 2000)]
    assert rows(artifacts.inference_iters(df)) == [("c", 7)]


def test_latest_strip(spark, rows):
    df = listing(spark, [("r", "a_000012_gs.png", 1, 0), ("r", "b_000012_gs.png", 0, 0), ("r", "c_000013_gs.png", 2, 0), ("s", "1000012_gs.png", 1, 0)])
    assert rows(artifacts.latest_strip(df, 12)) == [("r", "b_000012_gs.png")]
    runs = spark.createDataFrame([("r",), ("s",)], "run STRING")
    assert rows(artifacts.without_strip(runs, df, 12)) == [("s",)]


def test_sizes(spark):
    df = listing(spark, [("r", f"f{i}", 0, 0) for i in range(3)])
    assert artifacts.dir_size(df).first()["size"] == 30
    assert artifacts.dir_size(df, "KB").first()["size"] == 30 / 1024
    with pytest.raises(ValueError):
        artifacts.dir_size(df, "kb")


def test_model_files(spark, rows):
    files = [
        ("a", "z.blend"), ("a", "a.obj"), ("b", "m.fbx"), ("b", "c.fbx"), ("c", "only.max"), ("d", "notes.txt"),
        (None, "a.blend"), (None, "c.obj"), (None, "e.obj"), (None, "e.3ds"), (None, "f.max"), (None, "B.OBJ"),
    ]
    df = spark.createDataFrame(files, "folder STRING, name STRING")
    assert rows(artifacts.choose_model_file(df), "object", "name", "source", "usable") == [
        ("a", "z.blend", "folder", True),
        ("b", "c.fbx", "folder", True),
        # the folder holds nothing usable, so the flat file of that name counts
        ("c", "c.obj", "flat", True),
        ("c", "only.max", "folder", False),
        ("e", "e.3ds", "flat", True),
        ("f", "f.max", "flat", False),
    ]


PARAMS = "run STRING, ckpt INT, is_adapter BOOLEAN, base_run STRING, base_ckpt INT"


def roots(spark, data):
    df = spark.createDataFrame(data, PARAMS)
    return {(r.run, r.ckpt): (r.root_run, r.root_ckpt, r.status) for r in artifacts.resolve_base(df).collect()}


def test_lineage(spark):
    got = roots(
        spark,
        [
            ("base", 5, False, None, None), ("one", 1, True, "base", 5), ("two", 1, True, "one", 1),
            ("lost", 1, True, "base", 6), ("after_lost", 1, True, "lost", 1), ("none", 1, True, None, None),
            ("x", 1, True, "y", 1), ("y", 1, True, "x", 1), ("into", 1, True, "x", 1), ("self", 1, True, "self", 1),
        ],
    )
    assert got == {
        ("base", 5): ("base", 5, "root"),
        ("one", 1): ("base", 5, "resolved"),
        ("two", 1): ("base", 5, "resolved"),
        ("lost", 1): (None, None, "missing"),
        ("after_lost", 1): (None, None, "missing"),
        ("none", 1): (None, None, "missing"),
        ("x", 1): (None, None, "cycle"),
        ("y", 1): (None, None, "cycle"),
        ("into", 1): (None, None, "cycle"),
        ("self", 1): (None, None, "cycle"),
    }


def test_long_lineage_with_a_circle(spark):
    chain = [("r0", 1, False, None, None)] + [(f"r{i}", 1, True, f"r{i - 1}", 1) for i in range(1, 70)]
    got = roots(spark, chain + [("p", 1, True, "q", 1), ("q", 1, True, "p", 1)])
    assert all(got[f"r{i}", 1] == ("r0", 1, "resolved") for i in range(1, 70))
    assert got["p", 1][2] == got["q", 1][2] == "cycle"


def test_lineage_with_one_base_for_most(spark):
    n = 4000
    run = F.concat(F.lit("r"), F.col("id").cast("string"))
    base = F.when(F.col("id") % 3 > 0, F.lit("r0")).otherwise(F.concat(F.lit("r"), F.floor(F.col("id") / 2).cast("string")))
    params = spark.range(n).select(
        run.alias("run"), F.lit(1).alias("ckpt"), (F.col("id") > 0).alias("is_adapter"), base.alias("base_run"), F.lit(1).alias("base_ckpt")
    )
    got = artifacts.resolve_base(params).groupBy("root_run", "status").count().collect()
    assert {(r.root_run, r.status, r["count"]) for r in got} == {("r0", "root", 1), ("r0", "resolved", n - 1)}


def brute_steps(c):
    save, evaluate = set(), set()
    for s in range(1, c["total_steps"] + 1):
        if s % c["save_freq"] == 0 or s % (c["save_freq_epoch"] * c["steps_per_epoch"]) == 0 or s == c["total_steps"]:
            save.add(s)
        early = c["early_eval"] is not None and s % c["early_eval_freq"] == 0 and s < c["early_eval"]
        if s == 1 or early or s % c["eval_freq"] == 0 or s % (c["eval_freq_epoch"] * c["steps_per_epoch"]) == 0 or s == c["total_steps"]:
            evaluate.add(s)
    return save, evaluate


CALENDAR = "run STRING, total_steps BIGINT, steps_per_epoch BIGINT, save_freq BIGINT, save_freq_epoch BIGINT, eval_freq BIGINT, eval_freq_epoch BIGINT, early_eval BIGINT, early_eval_freq BIGINT"


def test_checkpoint_calendar(spark, rows):
    data = [("a", 1000, 70, 150, 3, 400, 5, 90, 20), ("b", 37, 50, 100, 1, 10, 1, None, None), ("c", 1, 1, 1, 1, 1, 1, 10, 3), ("d", 500, 60, 70, 2, 90, 3, 2000, 200)]
    df = spark.createDataFrame(data, CALENDAR)
    steps = artifacts.expected_steps(df).collect()
    for row in data:
        c = dict(zip([x.split()[0] for x in CALENDAR.split(", ")], row))
        if c["early_eval_freq"] is None:
            c["early_eval"], c["early_eval_freq"] = None, 1
        mine = [r for r in steps if r.run == row[0]]
        save, evaluate = brute_steps(c)
        assert {r.step for r in mine if r.save} == save and {r.step for r in mine if r.evaluate} == evaluate
        assert len(mine) == len(save | evaluate)
    there = spark.createDataFrame([("b", 37), ("c", 1), ("c", 9)], "run STRING, ckpt BIGINT")
    audit = rows(artifacts.audit_checkpoints(df.where("run IN ('b', 'c')"), there))
    assert audit == [("c", 9, "unexpected")]
