"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

No step collects a node's neighbours: each needs the least neighbour only (a
partial aggregate) and one join, whose two sides are freshly exchanged so that
a node with very many edges can be split. The edges of each step are written to
the shared folder. Ends when a step changes nothing; the number of steps grows
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (columns a, b) that is not its own root; root: the least node."""
    first = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(first, "edges")
    stamp = _stamp(now)
    while stamp[0]:
        most = 2 * stamp[0]  # no table of a step has more rows
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large, "edges", most)
        least_below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least_below, "a")
            .filter("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least_below.select("a", F.col("m").alias("b")))
            .distinct()
        )
        small = materialise(small, "edges", most)
        was, stamp = stamp, _stamp(small)
        discard(now, large)
        now = small
        if stamp == was:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots._shared_path = now._shared_path
    return roots
