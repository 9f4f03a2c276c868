"""Exact deduplication by deterministic block naming (DataFrame functions only).

A normalised text is cut into blocks of a fixed number of characters. The
distinct blocks are sorted and numbered: a block's number is its name. Then
adjacent names are paired, the distinct pairs sorted and numbered, and so on,
until each text has one name. Two texts have the same (level, name) exactly if
they are equal: names never collide, whatever the hashes below do.

Plan. Texts are prepared once - normalised, cut, hashed, digested - and their
blocks written with a number for each row. Distinct blocks are found with
partial aggregation on the map side, so a block that a third of all rows share
is sent once per map task. Each partition of distinct blocks is sorted and
numbered in place (the number holds the partition, so no global sort is needed)
and only (hash, name) is written. The occurrences of blocks then look up their
names by a 128-bit hash of the block, which moves a few numbers a block instead
of its text; if two distinct blocks ever share a hash - that is looked up - the
lookup compares the blocks themselves. Texts cross the network once. Every
lookup is a join of two freshly exchanged tables, so adaptive execution can
split a hot name; groups are sums and least values, so no task holds one.
Levels: the logarithm of the blocks of the longest text; texts of one block,
the most by far, take part in the first only.

:func:`deduplicate` removes rows by a list of doc_id and 128 bits of the text as
it is, without preparing texts again.

Defined cases: null text is the empty text (one empty block); a very long text
is many blocks, and a line of a regular expression takes it whole; null doc_id
counts as larger than any other: it stays only if all copies have none; rows
that repeat both doc_id and text count as copies of which one is kept; an empty
table gives an empty result; only doc_id and text are read, other columns pass
through :func:`deduplicate` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CLASS, discard, discard_all, materialise, whole_text, written

BLOCK = 2048
ROW = ["_doc", "_k1", "_k2"]
_NO_ID = -(2**63)


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(text, f"{SPACE_CLASS}+", " ")


def _row_key(df: DataFrame, text: str) -> DataFrame:
    """Add the key of a row: its doc_id and 128 bits of its text."""
    return df.withColumns(
        {
            "_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)),
            "_k1": F.xxhash64(text),
            "_k2": F.xxhash64(F.lit(7), text),
        }
    )


def _numbered(distinct: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Sort each partition of distinct things and number them: partition and rank make a unique integer."""
    return materialise(
        distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()).select(*keep, "name"),
        "names",
    )


def prepared_blocks(docs: DataFrame, block: int, hash_bits: int) -> DataFrame:
    """A row for each block of each document: ``rid`` (a number of the row), ``n`` blocks, ``idx``, hashes, ``block``; the rest in block 0."""
    rows = _row_key(docs.select("doc_id", whole_text().alias("_raw")), "_raw").withColumn("_text", normalised(F.col("_raw")))
    # a text of one block needs no cutting; the empty text is one block
    blocks = F.when(F.char_length("_text") <= block, F.array("_text")).otherwise(F.regexp_extract_all("_text", F.lit("(?s).{1,%d}" % block), F.lit(0)))
    keyed = rows.select("doc_id", *ROW, F.unhex(F.sha2("_text", 256)).alias("sha"), blocks.alias("blocks"), F.monotonically_increasing_id().alias("rid"))
    cut = keyed.select("doc_id", *ROW, "sha", "rid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("idx", "block"))
    mask = F.lit((1 << hash_bits) - 1 if hash_bits < 63 else -1)
    once = {c: F.when(F.col("idx") == 0, F.col(c)) for c in ["doc_id", *ROW, "sha"]}
    hashes = {"h1": F.xxhash64("block").bitwiseAND(mask), "h2": F.xxhash64(F.lit(11), "block").bitwiseAND(mask)}
    return materialise(cut.withColumns(once | hashes), "texts")


def name_blocks(rows: DataFrame) -> DataFrame:
    """The blocks of :func:`prepared_blocks` with ``name`` instead of hashes and texts."""
    distinct = rows.select("h1", "h2", "block").distinct()
    at = ["h1", "h2"]
    names = _numbered(distinct, ["block"], at)
    if not names.groupBy(*at).count().filter("count > 1").isEmpty():
        discard(names)
        at = ["h1", "h2", "block"]
        names = _numbered(distinct, ["block"], at)
    named = materialise(rows.join(names, at).drop("h1", "h2", "block"), "blocks")
    discard(names)
    return named


def identities(docs: DataFrame, block: int = BLOCK, hash_bits: int = 64) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row key, ``rid``, ``sha``, and its identity ``level``, ``name``."""
    before = written()
    first = name_blocks(prepared_blocks(docs, block, hash_bits))
    longest = first.agg(F.max("n")).first()[0] or 0
    own = ["doc_id", *ROW, "rid", "sha"]
    found = first.filter("n = 1").select(*own, F.lit(0).alias("level"), "name")
    now, level, done = first.filter("n > 1").select("rid", "n", "idx", "name"), 0, None
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        name = lambda side: F.max(F.when(F.col("idx") % 2 == side, F.col("name")))
        halves = [F.expr("(n + 1) div 2").cast("int").alias("n"), F.expr("idx div 2").cast("int").alias("idx")]
        paired = now.groupBy("rid", *halves).agg(name(0).alias("l"), F.coalesce(name(1), F.lit(-1)).alias("r"))
        names = _numbered(paired.select("l", "r").distinct(), ["l", "r"], ["l", "r"])
        now = materialise(paired.join(names, ["l", "r"]).select("rid", "n", "idx", "name"), "pairs")
        discard(names)
        ends = now.filter("n = 1").select("rid", F.lit(level).alias("level"), "name")
        done = ends if done is None else done.union(ends)
        now = now.filter("n > 1")
    if done is not None:
        found = found.union(first.filter("n > 1 and idx = 0").select(*own).join(done, "rid").select(*found.columns))
    found = materialise(found, "identities")
    discard_all(but=before | {found._shared_path})
    return found


def mark(docs: DataFrame, block: int = BLOCK, hash_bits: int = 64) -> DataFrame:
    """doc_id, row key, ``sha``, ``keep_id``, ``group_size``, ``kept`` for each row of ``docs``."""
    named = identities(docs, block, hash_bits)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    groups = materialise(named.groupBy("level", "name").agg(F.min(order).alias("first"), F.count("*").alias("group_size")), "groups")
    joined = named.join(groups, ["level", "name"])
    return joined.select("doc_id", *ROW, "sha", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"))


def deduplicate(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    before = written()
    rows = materialise(mark(docs, block).groupBy(*ROW).agg(F.count("*").alias("times"), F.bool_or("kept").alias("kept")).filter("not kept or times > 1"), "rows")
    gone = materialise(rows.filter("not kept").select(*ROW), "gone")
    repeated = not rows.filter("kept").isEmpty()
    discard_all(but=before | {gone._shared_path})
    # whole rows are packed, so that no column of theirs can clash with a key
    packed = docs.select("doc_id", whole_text().alias("_raw"), F.struct(*[docs[c] for c in docs.columns]).alias("_whole"))
    # the list grows with the documents: the same plan at every size, never a broadcast
    stay = _row_key(packed, "_raw").select(*ROW, "_whole").join(gone.hint("merge"), ROW, "left_anti")
    if repeated:  # rows that repeat doc_id and text: one of them, found with partial aggregation
        stay = stay.groupBy(*ROW).agg(F.first("_whole").alias("_whole"))
    return stay.select("_whole.*")


def op6_block_naming(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    return mark(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
"""
