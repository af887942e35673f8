import json
import random

import pytest

from viewloom.sources import keyed

KIND = "k STRING, n BIGINT, v DOUBLE"


def put(spark, path, data, **more):
    return keyed.merge(spark.createDataFrame(data, KIND), path, ["k", "n"], **more)


def test_latest_write_of_a_key_counts(spark, tmp_path, rows):
    path, rng, want = str(tmp_path / "t"), random.Random(1), {}
    for turn in range(12):
        data = {(rng.choice(["a", "b", None]), rng.randrange(8)): float(turn) for _ in range(rng.randrange(1, 9))}
        put(spark, path, [(*k, v) for k, v in data.items()])
        want |= data
        got = {(r.k, r.n): r.v for r in keyed.read(spark, path).collect()}
        assert got == want and keyed.read(spark, path).count() == len(want)


def test_files_follow_the_rows(spark, tmp_path):
    """Many keys and many writes: few segments, each of few files."""
    path = str(tmp_path / "t")
    for turn in range(20):
        put(spark, path, [(f"run{k}", turn, 0.0) for k in range(50)])
    newest = json.loads(sorted((tmp_path / "t" / "_manifests").glob("*.json"))[-1].read_text())
    assert len(newest["segments"]) <= 6 and sum(s["rows"] for s in newest["segments"]) == 1000
    assert len(list((tmp_path / "t").glob("segment-*/*.parquet"))) <= 20
    assert len(list((tmp_path / "t" / "_manifests").glob("*.json"))) == keyed.KEPT


def test_rows_of_one_write_all_stay(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    put(spark, path, [("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, 3.0)])
    assert rows(keyed.read(spark, path), "v") == [(1.0,), (2.0,), (3.0,)]
    put(spark, path, [("a", 1, 4.0)])
    assert rows(keyed.read(spark, path), "v") == [(3.0,), (4.0,)]


def test_a_repeated_batch_changes_nothing(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    assert put(spark, path, [("a", 1, 1.0)], source="s", batch=0) == 1
    assert put(spark, path, [("a", 1, 2.0)], source="s", batch=1) == 2
    assert put(spark, path, [("a", 1, 1.0)], source="s", batch=0) == 2
    assert put(spark, path, [("a", 2, 7.0)], source="other", batch=0) == 3
    assert rows(keyed.read(spark, path), "n", "v") == [(1, 2.0), (2, 7.0)]


def test_a_write_that_did_not_end_is_not_seen(spark, tmp_path, rows, monkeypatch):
    path = str(tmp_path / "t")
    put(spark, path, [("a", 1, 1.0)])
    monkeypatch.setattr(keyed._Folder, "create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        put(spark, path, [("a", 1, 2.0)])
    assert rows(keyed.read(spark, path), "v") == [(1.0,)]


def test_an_open_reader_keeps_its_segments(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [("a", k, 1.0) for k in range(5)])
    opened = keyed.read(spark, path)
    put(spark, path, [("a", k, 2.0) for k in range(5)])
    put(spark, path, [("b", k, 3.0) for k in range(5)])
    assert [r.v for r in opened.collect()] == [1.0] * 5


def test_two_writers_at_once(spark, tmp_path, rows, monkeypatch):
    """The slower one puts its rows behind those of the faster one."""
    path, true, first = str(tmp_path / "t"), keyed._Folder.create, []

    def create(folder, name, text):
        if not first:
            first.append(1)
            put(spark, path, [("a", 1, 5.0), ("b", 1, 5.0)])
        return true(folder, name, text)

    monkeypatch.setattr(keyed._Folder, "create", create)
    assert put(spark, path, [("a", 1, 6.0)]) == 2
    assert rows(keyed.read(spark, path), "k", "v") == [("a", 6.0), ("b", 5.0)]


def test_no_table_and_other_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        keyed.read(spark, path)
    assert keyed.read(spark, path, KIND).count() == 0
    put(spark, path, [])
    assert keyed.read(spark, path).count() == 0
    with pytest.raises(ValueError):
        keyed.merge(spark.createDataFrame([("a", 1, 1.0)], KIND), path, ["k"])
