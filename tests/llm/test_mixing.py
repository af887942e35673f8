import math

import pytest
from pyspark.sql import functions as F

from viewloom.llm import mixing

SIZES = {"big": 200, "mid": 40, "small": 20, None: 10}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"{s}{k}", s, "w " * (1 + k % 7)) for s, n in SIZES.items() for k in range(n)]
    rows += [("e", "empty", ""), ("n", "empty", None), (None, "big", "w w"), ("big1", "big", "w " * 2)]
    return spark.createDataFrame(rows, "doc_id string, source string, text string").withColumn("draw", F.lit("x")).cache()


def shares(df):
    rows = df.groupBy("source").agg(F.sum(mixing.words_of("text")).alias("t")).collect()
    return {r.source: r.t for r in rows}


def evenness(tokens):
    tokens = [t for t in tokens if t]
    return -sum(t / sum(tokens) * math.log(t / sum(tokens)) for t in tokens) / math.log(len(tokens))


@pytest.mark.parametrize("target", [0.8, 0.95])
def test_target_evenness(docs, target):
    mixed = mixing.mix_sources(docs, evenness=target, max_repeats=None)
    before, after = shares(docs), shares(mixed)
    assert abs(evenness(after.values()) - target) < 0.01
    assert all(after[s] >= before[s] for s in before) and after["big"] == before["big"]
    assert mixed.select("doc_id", "source").distinct().count() == docs.select("doc_id", "source").distinct().count()


def test_repeats_are_limited(docs):
    before, after = shares(docs), shares(mixing.mix_sources(docs, evenness=0.99, max_repeats=1.5))
    assert max(after[s] / before[s] for s in before if before[s]) <= 1.5
    alone = shares(mixing.mix_sources(docs, evenness=None, max_repeats=1.5))
    assert alone == after


def test_budget(docs):
    total = sum(shares(docs).values())
    mixed = mixing.mix_sources(docs, budget=total // 2, max_repeats=None)
    after = shares(mixed)
    assert total // 2 - 4 * 8 <= sum(after.values()) <= total // 2
    assert abs(evenness(after.values()) - 0.9) < 0.05


def test_enough_is_left_alone(docs):
    assert shares(mixing.mix_sources(docs, evenness=0.01)) == shares(docs)


def test_each_pass_is_a_permutation(docs):
    mixed = mixing.mix_sources(docs, evenness=1.0, max_repeats=None)
    assert mixed.columns == ["doc_id", "source", "text", "pass", "block", "draw"]
    for row in mixed.groupBy("source", "pass").agg(F.count("*").alias("n"), F.countDistinct("draw").alias("d"), F.max("block").alias("b")).collect():
        assert row.n <= SIZES.get(row.source, 2) + 2 and row.b <= math.isqrt(row.n + 2) + 1
    first = [r.draw for r in mixed.where("source = 'small' AND pass = 0").orderBy("doc_id").collect()]
    second = [r.draw for r in mixed.where("source = 'small' AND pass = 1").orderBy("doc_id").collect()]
    assert len(first) == 20 and first != second
    again = mixing.mix_sources(docs, evenness=1.0, max_repeats=None)
    assert again.exceptAll(mixed).count() == mixed.exceptAll(again).count() == 0


def test_many_sources_are_joined(docs, monkeypatch):
    want = mixing.mix_sources(docs)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    got = mixing.mix_sources(docs)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_edge_cases(tricky, nothing):
    mixed = mixing.mix_sources(tricky)
    assert mixed.columns == [*(c for c in tricky.columns if c != "pass"), "pass", "block", "draw"]
    assert mixed.where("pass = 0").count() == tricky.count()
    assert mixing.mix_sources(nothing).count() == 0
