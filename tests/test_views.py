import pytest
from pyspark.sql import functions as F

from viewloom.operators import checks, views


def files(spark, triples):
    return spark.createDataFrame(triples, "uid STRING, view_id INT, has_png BOOLEAN, has_json BOOLEAN")


def test_pairing_needs_both_files(spark, rows):
    listed = spark.createDataFrame(
        [("a", 0, "png"), ("a", 0, "json"), ("a", 1, "png"), ("b", 0, "json")], "uid STRING, view_id INT, kind STRING"
    )
    assert rows(views.pair_views(listed), "uid", "view_id", "valid") == [("a", 0, True), ("a", 1, False), ("b", 0, False)]


def test_report_counts_lists_and_limits(spark):
    everything = [("full", i, True, True) for i in range(40)]
    three = [("three", i, True, True) for i in (1, 5, 39)] + [("three", 7, True, False)]
    halves = [("split", 3, True, False), ("split", 3, False, True), ("split", 99, True, True)]
    sets = views.view_sets(files(spark, everything + three + halves))
    report = {r.uid: r for r in views.view_report(sets).collect()}
    assert report["full"].n_valid == 40 and report["full"].missing_views == [] and report["full"].enough
    assert report["three"].valid_views == [1, 5, 39] and not report["three"].enough
    assert len(report["three"].missing_views) == 37 and 7 in report["three"].missing_views
    # two rows of one view make a pair; views outside the ring do not count
    assert report["split"].valid_views == [3]
    assert {r.uid for r in checks.too_few_views(sets).collect()} == {"three", "split"}


def test_objects_without_any_view_stay(spark, rows):
    sets = views.view_sets(files(spark, [("none", 0, False, True), ("none", 1, None, None)]), 3)
    assert rows(sets) == [("none", [0])]
    assert rows(views.missing_views(sets, 3)) == [("none", 0), ("none", 1), ("none", 2)]
    assert views.present_views(sets, 3).count() == 0


def test_sets_of_many_views(spark):
    n = 200
    rows_ = [("a", i, True, i % 2 == 0) for i in range(0, n, 3)] + [("b", 199, True, True), ("b", 200, True, True), ("c", 5, True, False)]
    sets = views.view_sets(files(spark, rows_), n)
    found = {r.uid: r for r in views.view_report(sets, n, 2).collect()}
    assert found["a"].valid_views == list(range(0, n, 6)) and found["a"].n_valid == 34
    assert found["b"].valid_views == [199] and found["c"].valid_views == []
    assert all(sorted(r.valid_views + r.missing_views) == list(range(n)) for r in found.values())


@pytest.mark.parametrize("bad", [0, -1])
def test_number_of_views_is_checked(spark, bad):
    with pytest.raises(ValueError):
        views.view_sets(files(spark, [("a", 0, True, True)]), bad)


def test_min_views_must_be_positive(spark):
    with pytest.raises(ValueError):
        views.view_report(views.view_sets(files(spark, [("a", 0, True, True)])), 40, 0)


LONG = "uid STRING, view_id INT, png BINARY, camera_json BINARY"


def test_wide_and_back(spark, rows):
    long = spark.createDataFrame(
        [("a", 0, b"p0", b"c0"), ("a", 2, b"p2", b"c2"), ("a", 1, b"p1", None), ("b", 3, None, b"c3")], LONG
    )
    wide = views.views_wide(long, 4)
    assert wide.columns == ["uid"] + [f"{i:05d}.{e}" for i in range(4) for e in ("png", "json")]
    row = {r.uid: r for r in wide.collect()}
    assert row["a"]["00001.png"] is None and row["a"]["00002.json"] == b"c2"
    assert all(row["b"][c] is None for c in wide.columns[1:])
    assert rows(views.views_long(wide)) == [("a", 0, b"p0", b"c0"), ("a", 2, b"p2", b"c2")]


def test_files_straight_to_wide(spark, rows):
    listed = [("a", 0, "png", b"p0"), ("a", 0, "json", b"c0"), ("a", 1, "png", b"p1"), ("b", 2, "json", b"c2"), ("a", 9, "png", b"x")]
    renders = spark.createDataFrame(listed, "uid STRING, view_id INT, kind STRING, content BINARY")
    long = renders.where("view_id < 3").groupBy("uid", "view_id").pivot("kind", ["png", "json"]).agg(F.first("content"))
    direct, paired = views.renders_wide(renders, 3), views.views_wide(long.withColumnRenamed("json", "camera_json"), 3)
    assert direct.columns == paired.columns
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(direct) == key(paired)


def test_repeated_views_are_an_error(spark):
    long = spark.createDataFrame([("a", 0, b"p", b"c"), ("a", 0, b"q", b"d")], LONG)
    with pytest.raises(Exception, match="[Dd]uplicate"):
        views.views_wide(long, 2).collect()


def test_long_with_absent_columns_and_extra_files(spark, rows):
    wide = spark.createDataFrame(
        [("a", b"p", b"c", b"n", b"p1")],
        "uid STRING, `00000.png` BINARY, `00000.json` BINARY, `00000_nd.png` BINARY, `00001.png` BINARY",
    )
    long = views.views_long(wide, extra=("albedo", "nd"))
    # view 1 has no camera column at all
    assert rows(long) == [("a", 0, b"p", b"c", None, b"n")]
    assert views.complete_assets(long, ("png", "camera_json", "nd")).count() == 1
    assert views.complete_assets(long, ("png", "albedo")).count() == 0
    assert rows(checks.broken_assets(long, ("png", "albedo", "nd")))[0][2] == ["albedo"]
    with pytest.raises(ValueError):
        views.views_long(spark.createDataFrame([("a",)], "uid STRING"))


def test_holdout_and_numbers(spark, rows):
    names = spark.createDataFrame([("mei_lin",), ("ada",), ("zoé",)], "name STRING")
    numbered = views.number_uids(views.holdout_last(names), "chibi")
    assert rows(numbered, "uid", "name", "caption") == [
        ("chibi_train_000", "ada", "a 3D character named ada"),
        ("chibi_train_001", "mei_lin", "a 3D character named mei lin"),
        ("chibi_val_000", "zoé", "a 3D character named zoé"),
    ]
    assert rows(views.split_counts(numbered)) == [("train", 2), ("val", 1)]


def test_single_object_is_in_both_splits(spark, rows):
    one = views.holdout_last(spark.createDataFrame([("solo",)], "name STRING"))
    assert rows(views.number_uids(one, "chibi"), "uid") == [("chibi_train_000",), ("chibi_val_000",)]


def test_preview_is_capped(spark, rows):
    data = [(f"u{u}", v) for u in range(6) for v in range(10)]
    shown = views.preview(spark.createDataFrame(data, "uid STRING, view_id INT"))
    assert rows(shown, "uid", "view_id") == [(f"u{u}", v) for u in range(4) for v in range(8)]


def test_except(spark, rows):
    data = spark.createDataFrame([("a", v) for v in (1, 24, 39)], "uid STRING, view_id INT")
    assert rows(views.except_views(data, (24, 39))) == [("a", 1)]
