"""Line deduplication with per-document keep bitmaps (DataFrame functions only).

Lines of all documents are reduced to 128-bit hashes of their keys, with the
document, the row and the position that they come from. The hashes are
range-partitioned and sorted within partitions by hash, then document (largest
first) and position, and streamed in that order by window functions: the first
document of a hash is the one whose lines stay, and the rank of the last is the
number of documents. No hash is looked up a second time.

Hot lines. A hash that more than 1 / (4 * partitions) of all lines have (there
are fewer than 4 * partitions of them, so they are broadcast) is dealt over
several parts of the range by document and position. Its documents are counted,
and its first one found, by partial aggregates beforehand, so its parts need not
meet.

Bitmaps. A row that loses lines gets a sparse bitmap, one 64-bit word for each
64 lines that lose any, with a set bit for each line that stays; words without
an entry, and rows without a bitmap, keep all. No text is moved until bitmaps
are applied, when each row meets its own.

Plan: texts are read twice (hash, apply) and moved once, to meet their bitmaps
in a sort-merge join (bitmaps grow with the documents, so they are never
broadcast). Lines are moved once by range, and once more, as (hash, count), to
find the hot ones.

Keys are compared by 128 bits of hash, rows are known by doc_id and 128 bits of
their text. Defined cases: null or empty text is one empty line; a very long
text or line is processed whole, and its bitmap grows with its lines; null
doc_id is one document below all others; rows that repeat a doc_id count as one
document, and each keeps its own lines; rows that repeat the text too lose the
same lines; an empty table gives an empty result; extra columns are not read,
and pass through :func:`apply_bitmaps`, where those called n_lines, n_dropped
or kept_text are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import discard, materialise, whole_text

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(2**63)
HASH, ROW = ["h1", "h2"], ["doc", "k1", "k2"]
#: A hash with fewer lines is never dealt over several parts.
FEW = 1000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(" \t\n\x0b\x0c\r"))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _row() -> list[Column]:
    """doc_id (null: below all others) and 128 bits of the text."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    return [doc.alias("doc"), F.xxhash64(whole_text()).alias("k1"), F.xxhash64(F.lit(7), whole_text()).alias("k2")]


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Hash, row and ``pos`` of each line whose key is long enough."""
    # a line shorter than the least key can be left out before its key is made
    lines = docs.select(*_row(), F.posexplode(_lines(whole_text())).alias("pos", "line"))
    keyed = lines.filter(F.octet_length("line") >= min_chars).select(*ROW, "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(5), "key").alias("h2"), *ROW, "pos")


def hot_lines(lines: DataFrame, parts: int) -> DataFrame:
    """The hashes to be dealt over ``parts`` places each, their number of documents and the first one; below four a partition."""
    most = max(FEW, lines.count() // (4 * parts))
    hot = lines.groupBy(*HASH).agg(F.count("*").alias("n")).filter(F.col("n") > most)
    hot = materialise(hot.select(*HASH, F.ceil(F.col("n") / most).cast("int").alias("places")), "hot")
    holders = lines.join(F.broadcast(hot), HASH).select(*HASH, "places", "doc").distinct()
    found = materialise(holders.groupBy(*HASH, "places").agg(F.count("*").alias("all_docs"), F.max("doc").alias("keeper")), "common")
    discard(hot)
    return found


def dropped_lines(lines: DataFrame, hot: DataFrame, parts: int, min_docs: int) -> DataFrame:
    """Row and ``pos`` of each line to drop, streamed in the order of hash, document (largest first) and position."""
    # of a hot hash all is known already: its lines, even those of one document, need not meet
    place = F.coalesce(F.pmod(F.xxhash64("doc", "pos"), F.col("places")), F.lit(0)).alias("place")
    dealt = lines.join(F.broadcast(hot), HASH, "left").select(*HASH, place, *ROW, "pos", "all_docs", "keeper")
    group = [*HASH, "place"]
    ranged = dealt.repartitionByRange(parts, *group).sortWithinPartitions(*group, F.col("doc").desc(), "pos")
    one = Window.partitionBy(*group)
    down = one.orderBy(F.col("doc").desc(), "pos")
    streamed = ranged.withColumns({"first": F.first("doc").over(down), "rank": F.dense_rank().over(one.orderBy(F.col("doc").desc()))})
    docs = F.coalesce("all_docs", F.max("rank").over(one))
    return streamed.withColumn("docs", docs).filter((F.col("docs") >= min_docs) & (F.col("doc") != F.coalesce("keeper", "first"))).select(*ROW, "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Row (``doc``, ``k1``, ``k2``) and ``kept``, an array of (word, bits) with a set bit for each line that stays; rows that lose none are left out."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = materialise(hashed_lines(docs, min_chars), "lines")
    hot = hot_lines(lines, parts)
    drop = dropped_lines(lines, hot, parts, min_docs)
    words = drop.groupBy(*ROW, F.expr("pos div 64").cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"))
    maps = materialise(words.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("kept")), "bitmaps")
    discard(lines, hot)
    return maps


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``."""
    new = ["n_lines", "n_dropped", "kept_text"]
    carried = [docs[c] for c in docs.columns if c.lower() not in new]
    rows = docs.select(*_row(), whole_text().alias("text"), F.struct(*carried).alias("whole"))
    bits = bitmaps.select(*ROW, F.map_from_entries("kept").alias("bits"))
    # bitmaps grow with the documents: the same plan at every size, never a broadcast
    joined = rows.join(bits.hint("merge"), ROW, "left")
    lines = _lines(F.col("text"))
    word = lambda i: F.coalesce(F.try_element_at(F.col("bits"), F.shiftright(i, 6)), F.lit(-1).cast("long"))
    kept = F.filter(lines, lambda _, i: F.getbit(word(i), i.bitwiseAND(F.lit(63))) == 1)
    cut = joined.withColumns({"n": F.size(lines).cast("long"), "left": F.when(F.col("bits").isNotNull(), kept)})
    return cut.select(
        "whole.*",
        F.col("n").alias("n_lines"),
        F.when(F.col("bits").isNull(), F.lit(0)).otherwise(F.col("n") - F.size("left")).cast("long").alias("n_dropped"),
        F.when(F.col("bits").isNull(), F.col("text")).otherwise(F.array_join("left", "\n")).alias("kept_text"),
    )


def op9_line_bitmaps(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    out = apply_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS doc, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT r, doc_id, doc, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM d),
k AS (SELECT r, doc_id, doc, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND doc <> keeper AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
