"""The same functions on streams.

Values are Columns, so every element-wise function, cell reduction and JSON
function applies to a streaming DataFrame as it stands. What needs all rows -
reductions over rows - becomes a windowed aggregate with a watermark here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, size: str, late: str, keys: list[str], aggregates: dict[str, Callable[[], Column]]) -> DataFrame:
    """Aggregates by tumbling window and keys; rows later than ``late`` are dropped by the watermark."""
    rows = df.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys)
    out = rows.agg(*[f().alias(n) for n, f in aggregates.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)
