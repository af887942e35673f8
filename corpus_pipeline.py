"""A training corpus from raw documents, in five stages.

Each stage is written as Parquet to the shared scratch folder and read again as the next one's documents, so that an
executor lost in one stage costs nothing of those before it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.llm import boilerplate, chosen, mixing, packing, quality, simhash
from viewloom.llm.common import fresh, quoted
from viewloom.session import scratch_mark, settled

MAX_REPEATS = 1.5
SHINGLE, SIMILARITY = 5, 0.8
#: Words of which a worker keeps the ids: fewer than where packing has an executor's memory for itself.
MEMO = 200_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules do not reject."""
    return quality.keep_good(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source."""
    return boilerplate.drop_boilerplate(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, by shingles of five words.

    Fingerprints of few different bits find most copies; what is left is joined from a Jaccard similarity of 0.8,
    which no fingerprint of 64 bits reaches.
    """
    since = scratch_mark()
    first = settled(simhash.keep_one(docs, shingle=SHINGLE), "fingerprinted", since)
    return settled(chosen.keep_one(first, similarity=SIMILARITY, shingle=SHINGLE), "single", since)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again until the mixture is even enough.

    The table is written in the order of pass, block and draw: its parts by number, and the rows of each part.
    """
    passes, block, draw = fresh(docs, "pass", "block", "draw")
    mixed = mixing.mix_sources(docs, max_repeats=MAX_REPEATS, pass_col=passes, block_col=block, draw_col=draw)
    return mixed.orderBy(passes, block, draw).select(*map(quoted, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences."""
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memo=MEMO)
    return packed.select(*packing.COLUMNS)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_boilerplate),
    ("near-duplicates", drop_near_copies),
    ("source mixing", mix_sources),
    ("packing", pack),
]

#: The quality estimate, XXH64 fingerprints and tokenizer ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of ``sf_dir``; the scratch of a stage goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    since = scratch_mark()
    for number, (_, stage) in enumerate(STAGES):
        docs = settled(stage(spark, docs, sf_dir), f"stage{number}", since)
    return docs
