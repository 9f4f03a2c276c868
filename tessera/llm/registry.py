"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import block_dedup, fm_quality, line_dedup, mixing, piece_codec, preference, sharding, simhash, toxicity, winnowing
from tessera.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def piece_model() -> str:
    """Default place of the SentencePiece model: the installed vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")


def queries() -> dict[str, Query]:
    return {
        "op1_preference_pairs": lambda spark, sf: preference.op1_preference_pairs(conversations(spark, sf)),
        "op2_piece_codec": lambda spark, sf: piece_codec.op2_piece_codec(documents(spark, sf), piece_model()),
        "op3_winnowing": lambda spark, sf: winnowing.op3_winnowing(documents(spark, sf)),
        "op4_lexicon_toxicity": lambda spark, sf: toxicity.op4_lexicon_toxicity(documents(spark, sf), labels(spark, sf)),
        "op5_pigeonhole_simhash": lambda spark, sf: simhash.op5_pigeonhole_simhash(documents(spark, sf)),
        "op6_block_naming": lambda spark, sf: block_dedup.op6_block_naming(documents(spark, sf)),
        "op7_factorisation_machine": lambda spark, sf: fm_quality.op7_factorisation_machine(documents(spark, sf), labels(spark, sf)),
        "op8_temperature_mixing": lambda spark, sf: mixing.op8_temperature_mixing(documents(spark, sf)),
        "op9_line_bitmaps": lambda spark, sf: line_dedup.op9_line_bitmaps(documents(spark, sf)),
        "op10_feistel_sharding": lambda spark, sf: sharding.op10_feistel_sharding(documents(spark, sf)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_pairs": preference.OP1_SQL, "op6_block_naming": block_dedup.OP6_SQL, "op9_line_bitmaps": line_dedup.OP9_SQL}
