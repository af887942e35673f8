import pytest

import __spark_entry__ as entry
import compare
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_query_equals_twin(spark, name):
    verdict = compare.compare(spark, compare.connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        seen.append((name, docs.count()))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    counts = [n for _, n in seen]
    assert counts[0] >= counts[1] >= counts[2] <= counts[3] and counts[2] > 0
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_pipeline_on_odd_rows(tricky, nothing, spark):
    """Nulls, texts without words, repeated rows, clashing columns: what stays is known, and no row comes from nowhere."""
    for docs, some in ((tricky, True), (nothing, False)):
        docs = docs.withColumn("n_chars", docs["doc_id"])
        columns, before = docs.columns, None
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF).cache()
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert before is None or ids <= before
            assert (docs.count() > 0) == some
            if number < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns
            if number == 0 and some:
                # too few words, or none at all
                assert ids.isdisjoint({20, 21, 22, 25, 26, 27}) and 24 in ids
            if number == 2:
                # rows that repeat a text are one row now
                assert docs.count() == docs.select("text").distinct().count()
            before = ids
