"""Document fingerprints by winnowing (DataFrame functions only).

A text becomes tokens (runs without white space, at most 32 characters; signs
of scripts written without spaces stand alone). The hash of each k tokens is a
cyclic polynomial of the token hashes, the rolling hash that needs rotations
and exclusive-or only; it is rolled up by doubling (1, 2, 4, ... tokens, then
the powers of two that make up k) so that a whole text is hashed in a few array
passes. Of each window of w
hashes the least is chosen, the rightmost of equals, again by doubling; the
chosen hashes with their token positions are the fingerprint. Any passage of
w + k - 1 = 12 tokens that two texts share gives them a common hash, and a
window's choice depends on its own hashes only.

Likeness of two fingerprints: twice the shared hashes over all hashes (Dice),
1 for two empty ones.

Plan for the next document. Documents are dealt into ranges of doc_id, in order
within each. A range ends at a doc_id that exists (the largest of the range,
found by an aggregate over ids alone), so the one row that the neighbouring
range needs is known while texts are read and is sent there too. Texts cross
the network once and no task sees more than a range; the number of ranges is
four for each shuffle partition and is all that the driver learns.

Defined cases: null text is the empty text, with an empty fingerprint; a very
long text is hashed whole, in arrays that grow with it; fewer
than k tokens are hashed as one sequence; fewer than w hashes are one window;
null doc_id sorts below all others; rows that repeat a doc_id follow each other
in the order of their text; the only document of a table is its own next one;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import whole_text

K, W = 5, 8
#: The blocks of Thai, kana, Han and Hangul signs.
ALONE = "\\u0E00-\\u0E7F\\u3040-\\u30FF\\u3400-\\u9FFF\\uAC00-\\uD7AF"
TOKEN = f"[{ALONE}]|[^\\x20\\x09-\\x0D{ALONE}]{{1,32}}"
_LOW = (1 << 32) - 1
_NO_ID = -(2**63)


def _rolled(x: Column, by: int, y: Column) -> Column:
    """x rotated left, with y let in."""
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)).bitwiseXOR(y)


def _zip(a: Column, b: Column, shift: int, length: Column, f) -> Column:
    return F.zip_with(F.slice(a, 1, length), F.slice(b, shift + 1, length), f)


def fingerprint(df: DataFrame, text: str, name: str, k: int = K, w: int = W) -> DataFrame:
    """Add ``{name}`` (chosen hashes, in order of position) and ``{name}_at`` (their token positions)."""
    c = lambda x: f"_{name}_{x}"
    n, m, made = F.size(c("h1")), F.size(c("g")), ["words", "h1", "g", "k1", "at"]
    none = F.array().cast("array<bigint>")

    def doubled(df: DataFrame, kind: str, most: int, rows: Column, f: Callable[[int], Callable]) -> tuple[DataFrame, int]:
        """Columns for runs of 2, 4, ... at most ``most``, each made of two halves; also the length of the longest."""
        size = 1
        while 2 * size <= most:
            half = F.col(c(f"{kind}{size}"))
            df = df.withColumn(c(f"{kind}{2 * size}"), F.when(rows >= most, _zip(half, half, size, rows - (2 * size - 1), f(size))))
            size *= 2
            made.append(f"{kind}{size}")
        return df, size

    df = df.withColumn(c("words"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    df = df.withColumn(c("h1"), F.transform(c("words"), lambda x: F.xxhash64(x)))
    roll = lambda by: lambda x, y: _rolled(x, by, y)
    df, size = doubled(df, "h", k, n, roll)
    grams, have = F.col(c(f"h{size}")), size
    while have < k:
        while have + size > k:
            size //= 2
        grams, have = _zip(grams, F.col(c(f"h{size}")), have, n - (have + size - 1), roll(size)), have + size
    short = F.when(n > 0, F.array(F.xxhash64(F.array_join(c("words"), " ")))).otherwise(none)
    df = df.withColumn(c("g"), F.when(n >= k, grams).otherwise(short))
    # 31 bits of the hash, then the position from the right: the least key is the rightmost of the least hashes
    df = df.withColumn(c("k1"), F.transform(c("g"), lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 33), 32).bitwiseOR(F.lit(_LOW) - i)))
    least = lambda x, y: F.least(x, y)
    df, size = doubled(df, "k", w, m, lambda _: least)
    longest = F.col(c(f"k{size}"))
    # two runs that may overlap cover a window
    windows = longest if size == w else _zip(longest, longest, w - size, m - (w - 1), least)
    chosen = F.when(m >= w, windows).when(m > 0, F.array(F.array_min(c("k1")))).otherwise(none)
    df = df.withColumn(c("at"), F.transform(F.array_distinct(chosen), lambda x: (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("int")))
    df = df.withColumn(name, F.transform(c("at"), lambda p: F.element_at(c("g"), p + 1)))
    return df.withColumn(f"{name}_at", F.col(c("at"))).drop(*[c(x) for x in made])


def likeness(a: str, b: str) -> Column:
    x, y = F.array_distinct(a), F.array_distinct(b)
    total = F.size(x) + F.size(y)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def as_text(hashes: str) -> Column:
    """48 bits of each hash in hexadecimal, in order of position."""
    return F.array_join(F.transform(hashes, lambda x: F.substring(F.lpad(F.hex(x), 16, "0"), 5, 12)), " ")


def _ranges(keys: DataFrame, wanted: int) -> list[int]:
    """Ends (existing keys) of about ``wanted`` ranges of near-equal size; at most as many numbers as ranges."""
    cuts = keys.agg(F.percentile_approx("_key", [(i + 1) / wanted for i in range(wanted)], max(10_000, 20 * wanted))).first()[0]
    if not cuts:
        return []
    ends = keys.groupBy(_range_of("_key", sorted(set(cuts))).alias("r")).agg(F.max("_key").alias("end")).collect()
    return sorted(r["end"] for r in ends)


def _range_of(key: str, ends: list[int]) -> Column:
    """How many ends lie below the key, looked up in two levels."""
    size = max(1, int(len(ends) ** 0.5))
    rows = [ends[i : i + size] for i in range(0, len(ends), size)]
    below = lambda xs: F.size(F.filter(xs, lambda e: e < F.col(key)))
    row = below(F.lit([r[-1] for r in rows]))
    within = F.coalesce(below(F.try_element_at(F.array(*[F.lit(r) for r in rows]), row + 1)), F.lit(0))
    return row * size + within


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the text of the next document by descending doc_id; ``_range``, ``_ghost`` and ``_key`` for the order."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_key")
    ends = _ranges(docs.select(key), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", whole_text().alias("text"), key)
    here = _range_of("_key", ends or [0]).alias("_range")
    ahead = F.array(F.struct(here, F.lit(False).alias("_ghost")))
    both = F.array(F.struct(here, F.lit(False).alias("_ghost")), F.struct(((here + 1) % max(1, len(ends))).alias("_range"), F.lit(True).alias("_ghost")))
    is_end = F.array_contains(F.lit(ends or [0]), F.col("_key"))
    dealt = rows.withColumn("_to", F.explode(F.when(is_end, both).otherwise(ahead)))
    dealt = dealt.select("doc_id", "text", "_key", "_to._range", "_to._ghost")
    return dealt.withColumn("next_text", F.lead("text").over(_order()))


def _order() -> Window:
    return Window.partitionBy("_range").orderBy("_ghost", F.col("_key").desc(), F.xxhash64("text"), "text")


def op3_winnowing(docs: DataFrame) -> DataFrame:
    """The contract's rows; the positions of both fingerprints follow."""
    rows = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.coalesce("next_text", F.lit("")), half))
    rows = rows.select("doc_id", "text", "_key", "_range", "_ghost", edited.alias("_edited"), n.cast("long").alias("n_chars"))
    rows = fingerprint(rows, "text", "own")
    rows = rows.withColumn("_next", F.lead("own").over(_order())).filter(~F.col("_ghost"))
    rows = fingerprint(rows, "_edited", "edited")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"),
        as_text("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"),
        likeness("own", "_next").alias("near_next"),
        F.col("own_at").alias("positions"),
        F.col("edited_at").alias("edited_positions"),
    )
