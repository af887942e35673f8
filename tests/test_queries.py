"""Every registered query against its SQL twin, and rules all plans must obey."""

import pytest

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


LLM = {n for n in QUERIES if n == "pipeline" or n.startswith("op")}


def test_every_query_has_a_twin():
    assert set(QUERIES) - LLM == set(ORACLES) - LLM


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LLM))
def test_query_equals_twin(spark, duck, name):
    verdict = compare.compare(spark, duck, SF, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok"), verdict


# These run jobs while they are built, so their plan is only the last step.
EAGER = {n for n in QUERIES if n.startswith("stream_") or n.endswith("_sink")} | {"resolve_base", "embed_captions", "read_logs", "read_caption_csv", "read_json_map", "read_json_list"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER - LLM))
def test_no_plan_multiplies_tables(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
