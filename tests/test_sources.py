import json
import os

import pytest
from pyspark.sql import functions as F

from viewloom import session
from viewloom.operators import views
from viewloom.sources import files, shards, sinks


def write_shard(spark, folder, name, rows, schema="uid STRING, caption STRING, `00000.png` BINARY"):
    """One Parquet file with exactly this name."""
    temp = str(folder / f"_{name}.tmp")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(temp)
    part = next(f for f in os.listdir(temp) if f.endswith(".parquet"))
    with open(os.path.join(temp, part), "rb") as source, open(folder / name, "wb") as target:
        target.write(source.read())


@pytest.fixture
def shard_dir(spark, tmp_path):
    folder = tmp_path / "shards"
    os.makedirs(folder / "sub")
    for name, uid in (("set-280k-0000.parquet", "a"), ("set-280k-0001.parquet", "b"), ("set-280k-83k-0000.parquet", "c"), ("other.parquet", "d"), ("set-280k.txt", "e")):
        write_shard(spark, tmp_path, name, [(uid, " cap ", b"x"), (uid + "2", "", b"y")])
        with open(tmp_path / name, "rb") as source, open(folder / name, "wb") as target:
            target.write(source.read())
    write_shard(spark, tmp_path, "deep.parquet", [("z", "", b"")])
    with open(tmp_path / "deep.parquet", "rb") as source, open(folder / "sub" / "set-280k-0009.parquet", "wb") as target:
        target.write(source.read())
    return str(folder)


def uids(df):
    return sorted(r.uid for r in df.collect())


def test_shards_by_prefix(spark, shard_dir):
    assert uids(shards.read_shards(spark, shard_dir)) == ["a", "a2", "b", "b2", "c", "c2", "d", "d2"]
    assert uids(shards.read_shards(spark, shard_dir, "set-280k")) == ["a", "a2", "b", "b2", "c", "c2"]
    assert uids(shards.read_shards(spark, shard_dir, "set-280k", exact=True)) == ["a", "a2", "b", "b2"]
    assert uids(shards.read_shards(spark, shard_dir, "set-280k-83k", exact=True)) == ["c", "c2"]
    # a file named exactly like the prefix counts, whatever its suffix
    assert uids(shards.read_shards(spark, shard_dir, "set-280k.txt")) == ["e", "e2"]
    # a file is itself, whatever its name and the prefix
    assert uids(shards.read_shards(spark, shard_dir + "/other.parquet")) == ["d", "d2"]
    assert uids(shards.read_shards(spark, shard_dir + "/other.parquet", "set", exact=True)) == ["d", "d2"]
    assert uids(shards.read_shards(spark, "file:" + shard_dir + "/set-280k.txt")) == ["e", "e2"]


def test_shards_that_are_directories(spark, tmp_path):
    both = spark.createDataFrame([("x", "1"), ("y", "2")], "uid STRING, caption STRING")
    for name in ("set-000.parquet", "set-001.parquet", "set-long-000.parquet", "other.parquet"):
        both.repartition(2).write.parquet(f"{tmp_path}/{name}")
    single = both.where("uid = 'x'").coalesce(1)
    single.write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "set-002.parquet")
    assert uids(shards.read_shards(spark, str(tmp_path))) == ["x"] * 5 + ["y"] * 4
    assert uids(shards.read_captions(spark, str(tmp_path), prefix="set")) == ["x"] * 4 + ["y"] * 3
    exact = shards.read_shards(spark, str(tmp_path), "set", exact=True)
    assert uids(exact) == ["x", "x", "x", "y", "y"]
    assert len({r[shards.KEY] for r in shards.with_row_key(exact).collect()}) == 5
    assert uids(shards.read_shards(spark, f"{tmp_path}/other.parquet")) == ["x", "y"]


def test_shards_in_partition_folders(spark, tmp_path):
    rows = spark.createDataFrame([("x", "1"), ("y", "2")], "uid STRING, model STRING")
    rows.write.partitionBy("model").parquet(f"{tmp_path}/store")
    assert uids(shards.read_shards(spark, f"{tmp_path}/store")) == ["x", "y"]


@pytest.mark.parametrize("path,prefix", [("", "nothing"), ("/missing", None)])
def test_no_shards_is_an_error(spark, shard_dir, path, prefix):
    with pytest.raises(FileNotFoundError):
        shards.read_shards(spark, shard_dir + path, prefix)


def test_captions_read_two_columns(spark, shard_dir):
    captions = shards.read_captions(spark, shard_dir, prefix="set-280k")
    assert captions.columns == ["uid", "caption"]
    plan = captions._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<uid:string,caption:string>" in plan


def test_row_keys(spark, shard_dir):
    keyed = shards.with_row_key(shards.read_shards(spark, shard_dir, "set-280k"))
    keys = sorted(r[shards.KEY] for r in keyed.collect())
    assert len(set(keys)) == shards.count_rows(keyed) == 6
    assert keys[0] == "set-280k-0000.parquet:0"


def test_stored_keys_win(spark, tmp_path):
    write_shard(spark, tmp_path, "k.parquet", [("a", "kept"), ("b", None)], "uid STRING, __key__ STRING")
    keyed = shards.with_row_key(shards.read_shards(spark, str(tmp_path), "k"))
    assert sorted(r[shards.KEY] for r in keyed.collect()) == ["k.parquet:1", "kept"]


def test_legacy_text(spark, rows):
    df = spark.createDataFrame([("é".encode(), b"x")], "uid BINARY, png BINARY")
    assert rows(shards.decode_legacy(df)) == [("é", b"x")]


def test_renders(spark, tmp_path, rows):
    (tmp_path / "readme.txt").write_text("no object")
    for obj, names in {"mei_lin": ["00000.png", "00000.json", "00001.png", "notes.txt", "123.png"], "zoé b+50%": ["00039.json", "00039.png"], "bare": ["x.txt"]}.items():
        os.makedirs(tmp_path / obj)
        for name in names:
            (tmp_path / obj / name).write_bytes(f"{obj}/{name}".encode())
    renders = files.read_renders(spark, str(tmp_path))
    assert rows(renders.where("view_id IS NOT NULL"), "uid", "view_id", "kind") == [
        ("mei_lin", 0, "json"), ("mei_lin", 0, "png"), ("mei_lin", 1, "png"), ("zoé b+50%", 39, "json"), ("zoé b+50%", 39, "png")
    ]
    wide = files.render_views(renders)
    assert {(r.uid, r.view_id): r.camera_json for r in wide.collect()}["mei_lin", 1] is None
    report = views.view_report(views.view_sets(files.render_flags(renders)), min_views=1)
    assert rows(report, "uid", "n_valid", "valid_views") == [("bare", 0, []), ("mei_lin", 1, [0]), ("zoé b+50%", 1, [39])]
    # names alone answer the question: contents are not loaded
    assert "content" not in files.render_flags(renders)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


@pytest.mark.parametrize("multi_line", [True, False])
def test_caption_csv(spark, tmp_path, rows, multi_line):
    lines = ['a,"a cup, blue"', "b,first", "c,", 'b,"the ""last"" one"'] + [f"n{i},v{i}" for i in range(50)]
    (tmp_path / "c.csv").write_text("\n".join(lines) + "\n")
    got = {r.oid: r.caption for r in files.read_caption_csv(spark, str(tmp_path / "c.csv"), multi_line).collect()}
    assert got["a"] == "a cup, blue" and got["b"] == 'the "last" one' and got["c"] is None and len(got) == 53


def test_caption_with_line_break(spark, tmp_path):
    (tmp_path / "c.csv").write_text('a,"two\nlines"\nb,x\n')
    got = {r.oid: r.caption for r in files.read_caption_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"a": "two\nlines", "b": "x"}


def test_json_files(spark, tmp_path, rows):
    (tmp_path / "map.json").write_text(json.dumps({"1": "d/a.glb", "2": "d/b.glb"}, indent=1))
    (tmp_path / "list.json").write_text(json.dumps(["2", "1", "2"]))
    assert rows(files.read_json_map(spark, str(tmp_path / "map.json"))) == [("1", "d/a.glb"), ("2", "d/b.glb")]
    assert rows(files.read_json_list(spark, str(tmp_path / "list.json"))) == [(0, "2"), (1, "1"), (2, "2")]
    (tmp_path / "lines.json").write_text('{"1": "a"}\n{"2": "b"}\n')
    assert rows(files.read_json_map(spark, str(tmp_path / "lines.json"), per_line=True)) == [("1", "a"), ("2", "b")]


def test_prompt_files(spark, tmp_path, rows):
    (tmp_path / "my suite.txt").write_bytes("  a cat \r\n\n　\n a dog\nlast".encode())
    got = rows(files.read_prompts(spark, str(tmp_path)), "suite", "line_no", "prompt")
    assert got == [("my suite", 0, "a cat"), ("my suite", 3, "a dog"), ("my suite", 4, "last")]


def test_images(spark, tmp_path):
    for name in ("b.png", "a.webp", "c.JPG", "d.jpeg", "e.jpg", "f.gif"):
        (tmp_path / name).write_bytes(b"x")
    names = [r.path.rsplit("/", 1)[1] for r in files.list_images(spark, str(tmp_path)).collect()]
    assert names == ["a.webp", "b.png", "d.jpeg", "e.jpg"]


def test_logs_keep_their_order_over_splits(spark, tmp_path):
    os.makedirs(tmp_path / "run1")
    os.makedirs(tmp_path / "run 2+%")
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "run1" / "log.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "run 2+%" / "log.txt").write_text("a\rb \t\r\nc")
    (tmp_path / "run 2+%" / "log_infer.txt").write_text("Inference")
    (tmp_path / "run 2+%" / "other.txt").write_text("no")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = files.read_logs(spark, str(tmp_path))
        got = read.where("run = 'run1'").orderBy("line_no").collect()
        assert read.rdd.getNumPartitions() >= 1
        splits = spark.read.text(str(tmp_path / "run1")).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert splits > 3
    assert [r.line for r in got] == [x.rstrip() for x in lines]
    assert len({r.line_no for r in got}) == 5000
    few = files.read_logs(spark, str(tmp_path), keep=lambda line: F.endswith(line, F.lit("xxxxx"))).where("run = 'run1'")
    assert [r.line for r in few.orderBy("line_no").collect()] == [x for x in lines if x.endswith("xxxxx")]
    second = read.where("run = 'run 2+%'").orderBy("line_no").collect()
    assert [r.line for r in second] == ["a\rb", "c"]


def test_artifact_listing(spark, tmp_path, rows):
    os.makedirs(tmp_path / "run1" / "checkpoints" / "000100")
    (tmp_path / "run1" / "checkpoints" / "000100" / "w.bin").write_bytes(b"12345")
    (tmp_path / "top.txt").write_bytes(b"x")
    listed = files.read_artifacts(spark, str(tmp_path))
    assert rows(listed, "run", "name", "length") == [("run1", "w.bin", 5)]
    assert listed.first().mtime is not None


def test_split_sink(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "val")], "uid STRING, split STRING")
    sinks.write_splits(df, str(tmp_path / "s"))
    assert rows(sinks.read_split(spark, str(tmp_path / "s"), "train"), "uid") == [("a",), ("b",)]


def test_embedding_sink_replaces_one_model(spark, tmp_path, rows):
    path = str(tmp_path / "e")
    one = lambda uid, v: spark.createDataFrame([(uid, [[v]])], "uid STRING, tokens ARRAY<ARRAY<DOUBLE>>")
    sinks.write_embeds(one("u", 1.0), path, "sd15")
    sinks.write_embeds(one("u", 2.0), path, "pas")
    sinks.write_embeds(one("w", 3.0), path, "sd15")
    stored = spark.read.parquet(path)
    assert rows(stored, "model", "uid", "tokens") == [("pas", "u", [[2.0]]), ("sd15", "w", [[3.0]])]
    assert stored.schema["tokens"].dataType.simpleString() == "array<array<float>>"


def test_metric_sink_replaces_the_runs_of_a_job(spark, tmp_path, rows):
    kind = "run STRING, step BIGINT, name STRING, value DOUBLE"
    for value, run in ((0.5, "r"), (0.25, "q"), (0.75, "r")):
        sinks.write_metrics(spark.createDataFrame([(run, 1, "training/loss", value)], kind), str(tmp_path / "m"))
    stored = sinks.read_metrics(spark, str(tmp_path / "m"))
    assert rows(stored, "run", "value") == [("q", 0.25), ("r", 0.75)]


def test_metrics_of_a_partial_rerun_leave_one_row_for_each_key(spark, tmp_path, rows):
    path = str(tmp_path / "m")

    def log(run, steps, value):
        data = [(run, k, name, value) for k in steps for name in ("training/loss", "training/lr")]
        sinks.write_metrics(spark.createDataFrame(data, sinks.METRICS), path)

    log("1", range(0, 10), 1.0)
    log("2", range(0, 3), 2.0)
    log("1", range(6, 14), 3.0)  # overlaps
    log("1", range(6, 14), 3.0)  # again
    log("1", [], 9.0)
    got = rows(sinks.read_metrics(spark, path), "run", "step", "value")
    want = [("1", k, 1.0 if k < 6 else 3.0) for k in range(14)] + [("2", k, 2.0) for k in range(3)]
    assert got == sorted(want * 2)
    assert sinks.read_metrics(spark, path).schema["run"].dataType.simpleString() == "string"


def test_gaussian_sink(spark, tmp_path):
    from test_points import gaussians

    from viewloom.operators import points

    sinks.write_gaussians(points.to_ply_cols(gaussians(spark, [{}])), str(tmp_path / "g"))
    stored = spark.read.parquet(str(tmp_path / "g"))
    assert stored.columns == ["uid", "gid", *points.STORED_COLUMNS]
    assert stored.schema["x"].dataType.simpleString() == "float" and stored.first().red == 127


def test_scratch_is_below_the_shared_folder_and_can_be_dropped(spark):
    path = session.scratch_path(spark, "t")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path)
    kept, session._written[:] = session._written[:-1], [path]
    assert session.drop_scratch(spark) == 1 and not os.path.exists(path)
    session._written[:] = kept
