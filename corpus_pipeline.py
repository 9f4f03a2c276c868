"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again as the next one's input.

1. quality: the factorisation machine drops documents that it rejects;
2. exact: block naming keeps one document of each group of equal texts;
3. near: SimHash over five-word shingles, confirmed by the exact similarity of
   the shingle sets, keeps one document of each group of near copies;
4. mix: temperature mixing repeats documents of rarer sources up to the repetition limit, and drops none;
5. encode: SentencePiece ids of every text, with doc_id, source and digests.

A stage is a pure function of (spark, docs, sf_dir), so a lost stage can be run
again from its predecessor's table.

Defined cases, as in the operators: null text is the empty text; null doc_id and
null source are values of their own; rows that repeat a doc_id are told apart by
their texts; very long texts are processed whole; an empty table, or one without
labels, passes through every stage; other columns of documents, whatever their
names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import block_dedup, fm_quality, mixing, near_copies, piece_codec, registry
from tessera.llm.common import discard_all, documents, materialise, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fm_quality.keep_good(docs, registry.labels(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return block_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode_corpus(docs, registry.piece_model())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: The classifier and SimHash are beyond SQL; a brute-force version checks the stages instead (tests/llm).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each one's result written to the shared folder in between."""
    docs, own = documents(spark, sf_dir), written()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard_all(but=own | {docs._shared_path})  # the stage's tables and its predecessor's
    return STAGES[-1][1](spark, docs, sf_dir)
