"""Sharding by a Feistel permutation over global row numbers.

Every row gets a global number 0..N-1 (its rank by ``doc_id``); a keyed
Feistel network permutes those numbers; the permuted number p gives
``shard = p % n_shards`` and ``slot = p // n_shards``. The permutation is
computable for any single row number, so where a row goes can be found
without looking at any other row, and shard sizes differ by at most one row
(law ``rows``).

The Feistel network works on 2w bits, the smallest even width that holds N.
Values that fall outside 0..N-1 walk on along their cycle until they come back
in; the domain is less than 4N, so a walk takes under four steps on average.

Plan: one range partitioning of 32-byte rows (texts are never moved), written
once to the shared folder; the number of rows before each range partition is
the only thing gathered, one number a partition.

Defined cases: null doc_id sorts first; null text has size 8 and the checksum
of the empty string; a very long text is read whole for both; repeated rows each get a slot of their own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, whole_text

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mixer (multiply and xor-shift), the round function."""
    x = x ^ np.uint64(key)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """The golden-ratio sequence started at the seed."""
    return [(seed + (i + 1) * 0x9E3779B97F4A7C15) % 2**64 for i in range(rounds)]


def half_width(n: int) -> int:
    """Bits of each half: the smallest w with 4**w >= n."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Place of each row number in the shuffled order; a bijection of 0..n-1."""
    w = np.uint64(half_width(n))
    mask = np.uint64((1 << int(w)) - 1)
    keys = round_keys(seed)
    out = rows.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> w, out[walking] & mask
        for key in keys:
            left, right = right, left ^ (_mix(right, key) & mask)
        out[walking] = left << w | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Add ``row_number`` (0..N-1 in the given order) without a global sort in one task; also N.

    ``df`` should be narrow: it is range-partitioned, sorted and written once.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    written = materialise(
        df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftright("_at", 33)
    # one row a range partition: its size does not depend on the rows
    counts = written.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    before, total = [], 0
    for row in counts:
        before.append((row["_part"], total))
        total += row["count"]
    starts = spark.createDataFrame(before, "_part long, _start long")
    numbered = (
        written.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("row_number", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at", "_part", "_start")
    )
    return numbered, total


def shard(df: DataFrame, n_shards: int = 24, seed: int = 20240601, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot`` to the (narrow) rows of ``df``."""
    numbered, n = number_rows(df, list(order))

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(permute(rows.to_numpy(), n, seed), dtype="int64")

    placed = numbered.withColumn("_place", F.pandas_udf(place, "long")("row_number"))
    return placed.select(
        *[c for c in placed.columns if c != "_place"],
        (F.col("_place") % n_shards).cast("int").alias("shard"),
        F.expr(f"_place div {n_shards}").alias("slot"),
    )


def op10_feistel_sharding(docs: DataFrame) -> DataFrame:
    """The contract's rows: law ``rows`` over 24 shards; ``grown_shard`` belongs to law ``key`` only."""
    text = whole_text()
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shard(narrow, 24, order=("doc_id", "text_crc32", "size"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
