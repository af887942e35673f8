from collections import Counter

import pytest
from pyspark.sql import functions as F

from viewloom.functions.draws import unit_draw
from viewloom.operators import checks, embeds, sampling
from viewloom.operators.views import mask_of


def objects(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("uid"))


def with_masks(spark, masks):
    return spark.createDataFrame([(str(i), m) for i, m in enumerate(masks)], "uid STRING, mask ARRAY<BIGINT>")


def test_even_picks_are_evenly_spaced(spark):
    picked = sampling.pick_even(objects(spark, 3000), 4, seed=1).collect()
    wide = [r.picks for r in picked if r.picks[0] < 24]
    low = [r.picks for r in picked if r.picks[0] >= 27]
    assert len(wide) + len(low) == 3000
    assert 0.62 < len(wide) / 3000 < 0.71
    for p in wide:
        assert [(x - p[0]) % 24 for x in p] == [0, 6, 12, 18]
    for p in low:
        assert [(x - p[0]) % 12 for x in p] == [0, 3, 6, 9] and all(27 <= x <= 38 for x in p)
    assert set(p[0] for p in wide) == set(range(24)) and set(p[0] for p in low) == set(range(27, 39))


def test_even_picks_need_a_divisor(spark):
    with pytest.raises(ValueError):
        sampling.pick_even(objects(spark, 1), 5, seed=1)
    with pytest.raises(ValueError):
        checks.check_view_counts(3, 4)
    with pytest.raises(ValueError):
        checks.check_view_counts(8, 5)
    checks.check_view_counts(8, 4)


def test_random_picks_are_distinct_and_uniform(spark):
    picked = sampling.pick_random(objects(spark, 4000), 4, seed=2, exclude=sampling.POLE_VIEWS).collect()
    counts = Counter(v for r in picked for v in r.picks)
    assert all(len(set(r.picks)) == 4 for r in picked)
    assert set(counts) == set(range(40)) - {25, 26}
    mean = 4000 * 4 / 38
    assert all(abs(c - mean) < 6 * mean**0.5 for c in counts.values())
    again = sampling.pick_random(objects(spark, 4000), 4, seed=2, exclude=sampling.POLE_VIEWS).collect()
    assert picked == again
    assert picked != sampling.pick_random(objects(spark, 4000), 4, seed=3, exclude=sampling.POLE_VIEWS).collect()


def test_random_picks_among_existing(spark):
    df = with_masks(spark, [mask_of([1, 5, 9, 30], 40), mask_of([1, 2, 3], 40)])
    got = {r.uid: r.picks for r in sampling.pick_random(df, 4, 1, existing="mask").collect()}
    assert sorted(got["0"]) == [1, 5, 9, 30] and got["1"] is None


def test_existing_pick_is_complete_when_possible(spark):
    only = mask_of([2, 8, 14, 20], 40)
    low = mask_of([28, 31, 34, 37, 0, 1], 40)
    none = mask_of(range(5, 24, 5), 40)
    df = with_masks(spark, [only, low, none, mask_of(range(40), 40)])
    got = {r.uid: r.picks for r in sampling.pick_existing(df, 4, 1).collect()}
    assert sorted(got["0"]) == [2, 8, 14, 20]
    assert sorted(got["1"]) == [28, 31, 34, 37]
    assert got["2"] is None and got["3"] is not None
    assert [r.uid for r in sampling.failed_picks(sampling.pick_existing(df, 4, 1)).collect()] == ["2"]


def test_existing_pick_uses_every_start_alike(spark):
    df = with_masks(spark, [mask_of(range(40), 40)] * 7200)
    starts = Counter(r.picks[0] for r in sampling.pick_existing(df, 4, 1).collect())
    assert set(starts) == set(range(24)) | set(range(27, 39))
    assert all(abs(c - 200) < 6 * 200**0.5 for c in starts.values())


def test_rings_must_weigh_starts_alike(spark):
    with pytest.raises(ValueError):
        sampling.pick_existing(with_masks(spark, [[0]]), 4, 1, rings=((0, 24, 0.5), (27, 12, 0.5)))


def test_fill_takes_valid_views_without_duplicates(spark):
    masks = [mask_of(range(40), 40), mask_of([2, 8, 14, 20, 24, 39, 25], 40)]
    picked = sampling.pick_existing(with_masks(spark, masks), 4, 1)
    firsts = {r.uid: r.picks for r in picked.collect()}
    got = {}
    for r in sampling.fill_views(picked, 10, 1).orderBy("uid", "slot").collect():
        got.setdefault(r.uid, []).append(r.view_id)
    assert got["0"][:4] == firsts["0"] and len(set(got["0"])) == 10
    assert not set(got["0"][4:]) & {24, 39}
    # only one more view can be used: the list starts over
    assert got["1"][:4] == firsts["1"] and got["1"][4] == 25 and got["1"][5:] == (firsts["1"] + [25])[:5]
    few = sampling.fill_views(picked, 10, 1, exclude=sampling.DUPLICATE_VIEWS + sampling.POLE_VIEWS)
    assert {r.view_id for r in few.where("uid = '1'").collect()} == {2, 8, 14, 20}


def test_condition_views(spark):
    got = {}
    for r in sampling.cond_views(objects(spark, 500), 6, 3, 1).orderBy("uid", "cond").collect():
        got.setdefault(r.uid, []).append(r.slot)
    assert all(s[0] == 0 and len(set(s)) == 3 and max(s) < 6 for s in got.values())
    assert {s for v in got.values() for s in v} == set(range(6))
    assert sampling.cond_views(objects(spark, 2), 6, 1, 1).count() == 2
    with pytest.raises(ValueError):
        sampling.cond_views(objects(spark, 1), 2, 3, 1)


def test_dropout_bands(spark):
    df = spark.createDataFrame([(u,) for u in (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.9)], "u DOUBLE")
    got = [tuple(r.d) for r in df.select(embeds.dropout_band(F.col("u"), 0.1).alias("d")).collect()]
    assert got[:4] == [(True, False), (True, True), (True, True), (False, True)]
    assert got[4] == (False, True) and got[6] == (False, False)


def test_dropout_shares(spark):
    drawn = embeds.condition_dropout(objects(spark, 20000), 0.1, seed=1, epoch=0)
    share = drawn.agg(F.avg(F.col("drop_text").cast("int")), F.avg(F.col("drop_image").cast("int"))).first()
    assert abs(share[0] - 0.2) < 0.015 and abs(share[1] - 0.2) < 0.015


def test_unit_draw_of_extremes(spark):
    df = spark.createDataFrame([("0" * 32,), ("f" * 32,)], "h STRING")
    low, high = [r[0] for r in df.select(unit_draw(F.col("h"))).collect()]
    assert low == 0.0 and high < 1.0
