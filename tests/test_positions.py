import random

import pytest
from pyspark.sql import functions as F

from viewloom.functions.draws import hex_draw, unit_draw
from viewloom.operators.positions import with_position
from viewloom.operators.skew import salts_for, skew_join


def test_position_of_strings_equals_sorting(spark, rows):
    names = [f"Customer#{i:09d}" for i in random.Random(1).sample(range(10**6), 5000)]
    df = spark.createDataFrame([(n,) for n in names], "name STRING")
    placed = with_position(df, ["name"], total="n")
    assert rows(placed, "name", "pos", "n") == [(n, i, 5000) for i, n in enumerate(sorted(names))]


def test_position_inside_partitions(spark, rows):
    data = [(i % 3, (i * 7919) % 10007) for i in range(3000)]
    df = spark.createDataFrame(data, "part INT, key INT")
    expected = []
    for p in range(3):
        expected += [(p, k, i) for i, k in enumerate(sorted(k for q, k in data if q == p))]
    assert rows(with_position(df, ["key"], ["part"]), "part", "key", "pos") == sorted(expected)


def test_position_by_hash_order(spark, rows):
    df = spark.range(2000).withColumn("h", hex_draw(1, "id"))
    placed = with_position(df, ["h", "id"], hex_key="h", hex_digits=2)
    ordered = sorted(tuple(r) for r in df.select("h", "id").collect())
    assert rows(placed, "h", "id", "pos") == [(h, i, n) for n, (h, i) in enumerate(ordered)]


def test_position_with_null_partition(spark, rows):
    df = spark.createDataFrame([(None, 2), (None, 1), (1, 5)], "part INT, key INT")
    placed = with_position(df, ["key"], ["part"])
    assert {(r.part, r.key, r.pos) for r in placed.collect()} == {(None, 1, 0), (None, 2, 1), (1, 5, 0)}


def test_position_of_tiny_tables(spark, rows):
    assert rows(with_position(spark.range(1), ["id"]), "id", "pos") == [(0, 0)]
    assert with_position(spark.range(0), ["id"]).count() == 0
    assert rows(with_position(spark.range(3), ["id"]), "id", "pos") == [(0, 0), (1, 1), (2, 2)]


def test_sampled_buckets_are_balanced(spark):
    from viewloom.operators.positions import _sampled_bucket

    # keys bunch up at one end
    df = spark.range(100_000).select((F.col("id") * F.col("id")).alias("k"))
    sizes = [r["count"] for r in _sampled_bucket(df, ["k"]).groupBy("_bucket").count().collect()]
    assert len(sizes) > 900
    assert max(sizes) < 4 * 100_000 / 1024


def test_unit_draw_is_uniform(spark):
    stats = (
        spark.range(20000)
        .select(unit_draw(hex_draw(5, "id")).alias("u"))
        .agg(F.min("u"), F.max("u"), F.avg("u"), F.stddev_pop("u"))
        .first()
    )
    assert 0 <= stats[0] < 0.001 and 0.999 < stats[1] < 1
    assert abs(stats[2] - 0.5) < 0.01 and abs(stats[3] - 12**-0.5) < 0.01


@pytest.mark.parametrize("salts", [1, 5])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, how, salts):
    big = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).alias("k"), "id")
    small = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    left = sorted(map(tuple, skew_join(big, small, ["k"], ["id"], how, salts).collect()), key=str)
    right = sorted(map(tuple, big.join(small, ["k"], how).collect()), key=str)
    assert left == right


def test_skew_join_spreads_the_hot_key(spark):
    big = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(100).select(F.col("id").alias("k"))
    # the join itself must repartition, not broadcast or merge partitions, for the test to mean anything
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = skew_join(big, small, ["k"], ["id"], salts=salts_for(1 / 3, 12)).where("k = 7").withColumn("p", F.spark_partition_id())
        spread = joined.groupBy("p").count().collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert sum(r["count"] for r in spread) == 3001
    assert max(r["count"] for r in spread) < 0.6 * 3001


def test_each_side_of_a_join_is_read_once(spark, tmp_path):
    """No sample of the big side is taken; positions by a uniform draw need only the counts of its buckets."""
    spark.range(1000).select((F.col("id") % 7).alias("k"), F.format_string("%04d", "id").alias("name")).write.parquet(str(tmp_path / "t"))
    big = spark.read.parquet(str(tmp_path / "t"))
    small = spark.range(7).select(F.col("id").alias("k"))

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")

    assert scans(skew_join(big, small, ["k"])) == 1
    small_buckets = with_position(big.withColumn("h", F.md5("name")), ["h"], hex_key="h")
    assert scans(small_buckets) == 2
