"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from viewloom.catalog.base import table
from viewloom.llm import boilerplate, chosen, licenses, merkle, mixing, neighbours, packing, quality, secrets, simhash, surrogates, tokens, tries, twins
from viewloom.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query(licenses.oracle())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).select(*licenses.COLUMNS)


@query(secrets.oracle())
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


@query()
def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op7_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


@query()
def op9_quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents")).select(*quality.COLUMNS)


@query(boilerplate.ORACLE)
def op8_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = boilerplate.drop_boilerplate(table(spark, sf_dir, "documents"), dropped_col="n_dropped")
    return cleaned.select("doc_id", "text", "n_dropped")


@query()
def op10_pack_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select(*packing.COLUMNS)


@query()
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "pass", "block", "draw")


@query()
def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


@query()
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = surrogates.replace_pii(table(spark, sf_dir, "documents"), key="viewloom example key")
    return replaced.select("doc_id", "text", "n_entities")


@query(twins.OP11)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = merkle.manifest(docs, tampered={"text": merkle.tampered_text()})
    return merkle.verified(found).select(*merkle.COLUMNS)


@query(twins.OP12)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = tries.regraft(tries.turn_lists(table(spark, sf_dir, "conversations")))
    return tries.prefix_trie(lists).select(*tries.COLUMNS)


@query(twins.OP13)
def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    # this result takes shingles of four words
    return chosen.digest(chosen.near_duplicates(table(spark, sf_dir, "documents"), shingle=4))
