"""A bounded, class-balanced sample of labelled documents for fitting a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, columns: list[str]) -> DataFrame:
    """At most ``per_class`` rows of each class, as doc_id, ``label`` 0/1 and the given columns of ``docs``.

    Ids are chosen by a hash, so the sample is the same on every run; held-out
    rows and null labels are never read. If an id has several labels, the
    largest counts; if several rows of ``docs`` have an id, its label can mean
    any of them and is not used, so rows are bounded as ids are. Of each class
    ``2 * per_class`` ids are looked up, to choose from those of one row; both
    lists are broadcast.
    """
    usable = (
        labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )

    def first(rows: DataFrame, most: int) -> DataFrame:
        part = [rows.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in (0, 1)]
        return part[0].union(part[1])

    found = docs.select("doc_id").join(F.broadcast(first(usable, 2 * per_class)), "doc_id")
    single = found.groupBy("doc_id", "label").count().filter("count = 1").select("doc_id", "label")
    return docs.select("doc_id", *columns).join(F.broadcast(first(single, per_class)), "doc_id").select("doc_id", "label", *columns)
