"""Categorical columns: a sorted dictionary of distinct values, and codes.

The dictionary is found by a distinct aggregate and numbered in order. No task
sorts all values: the values are cut into ranges at the few with the least
hashes - a fair draw of the distinct values, the same on every run - and a
value's code is the number of values in the ranges before plus its rank in its
own. All of this is one lazy plan; the cuts, a fixed number of values, are
a scalar subquery. The dictionary is joined as a relation: adaptive execution broadcasts
it where its measured size is small, and merges (splitting hot values) where it
is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dictionary(df: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """``value``, ``code`` (a long: 0, 1, ... in order of value); missing values have no code.

    ranges: how many tasks rank values (default: one for each shuffle partition).
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    drawn = values.orderBy(F.xxhash64("value"), "value").limit(ranges - 1)
    cuts = drawn.agg(F.array_sort(F.collect_list("value")))
    placed = values.withColumn("_cuts", cuts.scalar()).select("value", F.size(F.filter("_cuts", lambda c: c < F.col("value"))).alias("_range"))
    counts = placed.groupBy("_range").count()
    before = F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("value")) - 1
    ranked = placed.withColumn("_own", own).join(F.broadcast(starts), "_range")
    return ranked.select("value", (F.col("_start") + F.col("_own")).alias("code"))


def factor(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``{column}_code``."""
    codes = dictionary(df, column)
    return df.join(codes.withColumnRenamed("code", f"{column}_code"), df[column] == codes["value"], "left").drop("value")


def code_type(n: int) -> str:
    """Datashape of the codes of n categories."""
    return "uint8" if n <= 256 else "uint16" if n <= 65536 else "uint32"
