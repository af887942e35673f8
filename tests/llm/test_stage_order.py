import corpus_pipeline
from viewloom.llm import mixing

SF = "/root/testdata/sf0.001"


def test_mixing_stage_keeps_the_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = mixing.mix_sources(docs, max_repeats=corpus_pipeline.MAX_REPEATS).collect()
    want = [r.doc_id for r in sorted(rows, key=lambda r: (r["pass"], r.block, r.draw))]
    assert [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()] == want
