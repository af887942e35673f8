from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.operators import epochs


def keyed(spark, n):
    return spark.range(n).select(F.format_string("u%05d", F.col("id")).alias("uid"))


@pytest.mark.parametrize("rows_,n", [(10, 3), (2, 5), (12, 4), (1, 1), (1000, 7)])
def test_split_even_is_array_split(spark, rows_, n):
    got = {r.uid: r.worker for r in epochs.split_even(keyed(spark, rows_), n).collect()}
    expected = {}
    for worker, part in enumerate(np.array_split([f"u{i:05d}" for i in range(rows_)], n)):
        expected |= {str(u): worker for u in part}
    assert got == expected


def test_encode_batches_keep_the_rest(spark):
    sizes = Counter(r.batch for r in epochs.encode_batches(keyed(spark, 300)).collect())
    assert sizes == {0: 128, 1: 128, 2: 44}


def test_shards_deal_out_the_epoch_order(spark):
    files = spark.createDataFrame([(f"f{i}.parquet",) for i in range(11)], "file STRING")
    one = {r.file: (r.pos, r.shard) for r in epochs.assign_shards(files, 3, seed=0, epoch=0).collect()}
    two = {r.file: (r.pos, r.shard) for r in epochs.assign_shards(files, 3, seed=0, epoch=1).collect()}
    assert sorted(p for p, _ in one.values()) == list(range(11))
    assert all(s == p % 3 for p, s in one.values())
    assert one != two
    # only seed + epoch decides
    assert two == {r.file: (r.pos, r.shard) for r in epochs.assign_shards(files, 3, seed=1, epoch=0).collect()}


def test_single_file_leaves_other_shards_empty(spark):
    files = epochs.assign_shards(spark.createDataFrame([("a",)], "file STRING"), 4, 0, 0)
    assert [epochs.shard_of(files, s, 4).count() for s in range(4)] == [1, 0, 0, 0]


def test_shard_arguments(spark):
    files = epochs.assign_shards(spark.createDataFrame([("a",)], "file STRING"), 2, 0, 0)
    with pytest.raises(ValueError):
        epochs.assign_shards(files, 0, 0, 0)
    for bad in (-1, 2):
        with pytest.raises(ValueError):
            epochs.shard_of(files, bad, 2)


def test_buffered_shuffle_moves_rows_less_than_a_block(spark):
    df = keyed(spark, 500).withColumn("shard", F.lit(0))
    got = {r.uid: r.pos for r in epochs.shuffle_rows(df, 1, 0, 32).collect()}
    assert sorted(got.values()) == list(range(500))
    moved = [abs(p - int(u[1:])) for u, p in got.items()]
    assert 0 < max(moved) < 32
    same = {r.uid: r.pos for r in epochs.shuffle_rows(df, 1, 0, -1).collect()}
    assert all(p == int(u[1:]) for u, p in same.items())


def test_batches_drop_the_last(spark):
    placed = keyed(spark, 25).withColumn("pos", F.substring("uid", 2, 5).cast("int"))
    assert Counter(r.batch for r in epochs.assign_batches(placed, 8).collect()) == {0: 8, 1: 8, 2: 8}
    assert Counter(r.batch for r in epochs.assign_batches(placed, 8, drop_last=False).collect())[3] == 1


def test_epoch_plan(spark):
    plan = epochs.epoch_plan(keyed(spark, 103), 3, 4, 8, 7).collect()
    for epoch in range(3):
        mine = [r for r in plan if r.epoch == epoch]
        assert len({r.uid for r in mine}) == len(mine)
        batches = Counter((r.shard, r.batch) for r in mine)
        assert set(batches.values()) == {8}
        # shards hold 26, 26, 26 and 25 rows: three full batches each
        assert Counter(s for s, _ in batches) == {0: 3, 1: 3, 2: 3, 3: 3}
        assert all(sorted(r.place for r in mine if (r.shard, r.batch) == k) == list(range(8)) for k in batches)
    orders = [[r.uid for r in sorted(plan, key=lambda r: (r.shard, r.batch, r.place)) if r.epoch == e] for e in range(3)]
    assert orders[0] != orders[1] != orders[2]


def test_manifest_is_the_whole_product(spark):
    images = spark.createDataFrame([(f"i{i}",) for i in range(37)], "image STRING")
    prompts = spark.createDataFrame([(p, f"p{p}") for p in range(11)], "j INT, prompt STRING")
    made = epochs.request_manifest(images, prompts, scales=(3.0, 1.0), slots=4)
    rows = [tuple(r) for r in made.collect()]
    assert len(rows) == len(set(rows)) == 37 * 11 * 2 * 4
    assert "CartesianProduct" not in made._jdf.queryExecution().toString()
    assert "NestedLoop" not in made._jdf.queryExecution().toString()


def test_grid_follows_both_sizes():
    for left, right in ((1, 10**6), (10**6, 1), (10**6, 4), (1000, 1000), (3 * 10**5, 7 * 10**4), (0, 5), (5, 0)):
        rows, columns = epochs.grid(left, right)
        assert 1 <= rows <= max(left, 1) and 1 <= columns <= max(right, 1)
        # cells are balanced and no larger than asked for, but for rounding up to whole rows of each side
        assert -(-left // rows) * -(-right // columns) <= 4 * epochs.CELL
        assert rows * columns <= max(2, 4 * left * right // epochs.CELL + 2)
    assert epochs.grid(1, 10**8)[1] >= 90 and epochs.grid(10**8, 1)[0] >= 90
    # of two grids of as many cells the one that repeats fewer rows
    rows, columns = epochs.grid(10**6, 10**4)
    assert rows > columns
