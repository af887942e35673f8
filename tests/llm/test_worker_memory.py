import sys

import public_tokenizers
import pyarrow as pa
from pyspark import cloudpickle
from tokenizers import Tokenizer

import corpus_pipeline
from viewloom.llm import common, packing

# the functions below travel to the workers, which do not know this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PATH = public_tokenizers.path("word_bpe_49k.json")
KEY = ("test_worker_memory",)


def keeping():
    common.worker_cache(KEY, dict)
    return telling()


def telling():
    def new(batch):
        kept = vars(sys.modules.get("_kept_by_worker", sys)).get("kept", {})
        return [pa.array([len(kept)] * len(batch), pa.int64())]

    return new


def test_workers_free_what_another_operator_kept(spark):
    """A worker outlives the stage it was started for, and its memory is that of the next stages."""
    ids = spark.range(0, 64, numPartitions=16)
    kept = [r.n for r in common.add_columns(ids, "n long", keeping, cache=KEY).collect()]
    assert kept == [1] * 64
    assert [r.n for r in common.add_columns(ids, "n long", telling, cache=KEY).where("n = 1").limit(1).collect()] == [1]
    assert [r.n for r in common.add_columns(ids, "n long", telling).collect()] == [0] * 64


def test_the_memo_of_ids_is_bounded():
    tokenizer = Tokenizer.from_file(PATH)
    ids = packing.Ids(PATH, most=50)
    for k in range(0, 2000, 20):
        text = " ".join(f"Word{j} and the{j}." for j in range(k, k + 20))
        assert next(ids.ids([text])) == packing.np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert max(len(ids.memo), len(ids.old)) <= 50 + 100


def test_the_pipeline_packs_with_a_smaller_memo(spark, nothing, monkeypatch):
    seen = []
    plain = packing.pack_documents
    monkeypatch.setattr(packing, "pack_documents", lambda *a, **k: seen.append(k["memo"]) or plain(*a, **k))
    assert corpus_pipeline.pack(spark, nothing, "").count() == 0
    assert seen[0] <= packing.MEMO // 4
