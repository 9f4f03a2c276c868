"""Mixing sources to target weights by temperature.

A source with token share q gets weight q^a / sum q^a. The exponent a (1: as
found, 0: all equal) is bisected to the smallest that keeps every source within
a repetition limit, or to a target entropy. The budget (tokens of the mixture)
is, unless given, the least that holds one whole pass over every source, so
that mixing repeats but never drops.

Realisation. A source with budget b and t tokens gets b div t whole passes. For
the rest, its documents are dealt into blocks by a hash, as many blocks as the
square root of the documents; the blocks, and the documents in each, are put in
the order of keyed hashes (a block permutation), and documents are taken in that
order while they fit into the rest. Where the order is cut is one (block,
document) position for each source, so a document's number of copies follows
from its own hashes and its source's row.

Plan: texts are read once to count tokens, and only (id, source, tokens) is
kept, in the shared folder. Sums are by source, by (source, block) and by
document of the block that is cut, all with partial aggregation; of n documents
of a source no running sum is over more than about the square root. The
exponent comes from sums over the table of sources, whose size the driver never
sees. The plan of copies is broadcast up to ``BROADCAST`` sources, and joined
beyond (adaptive execution splits a hot source).

Defined cases: null source is a source of its own; null text has no tokens; a
very long text counts whole; null doc_id is hashed like a number; rows that
repeat a doc_id in a source are taken or left together; documents without tokens
are taken in every pass; a source without tokens passes once; an empty table
gives an empty result; other columns, whatever their names, pass through
:func:`mix`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import discard, materialise, whole_text

BROADCAST, SEED = 100_000, 11
#: The mixture of the registered query and of the pipeline: no source more often than this, relative to the rarest.
REPEAT_LIMIT = 1.5
#: Halvings of an exponent's interval, and how many of them one pass over the sources decides.
STEPS, AHEAD = 60, 5
_NONE, _NO_ID = "\x00none", -(2**63)


def bisect_exponent(good: Callable[[float], bool], steps: int = STEPS) -> float:
    """The smallest exponent in [0, 1] that is good, if all above a good one are."""
    if good(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if good(middle) else (middle, high)
    return high


def _raised(exponent: float, top: float) -> Column:
    """Token share to a power, but for a factor; 0 without tokens."""
    return F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(top), F.lit(exponent))).otherwise(0.0)


def entropies(sources: DataFrame, top: float, exponents: list[float]) -> dict[float, float]:
    """Entropy of the weights under each exponent, all in one pass over the sources."""
    sums = []
    for k, a in enumerate(exponents):
        r = _raised(a, top)
        sums += [F.sum(r).alias(f"s{k}"), F.sum(F.when(r > 0, r * F.log(r)).otherwise(0.0)).alias(f"t{k}")]
    row = sources.agg(*sums).first()
    return {a: math.log(row[f"s{k}"]) - row[f"t{k}"] / row[f"s{k}"] for k, a in enumerate(exponents)}


def _ahead(low: float, high: float, steps: int) -> list[float]:
    """Every middle that so many halvings can ask for."""
    if not steps:
        return []
    middle = (low + high) / 2
    return [middle, *_ahead(low, middle, steps - 1), *_ahead(middle, high, steps - 1)]


def find_exponent(sources: DataFrame, repeat_limit: float | None, target_entropy: float | None) -> tuple[float, float]:
    """The exponent, and the tokens of the largest source; sources: ``tokens``."""
    if (repeat_limit is None) == (target_entropy is None):
        raise ValueError("give either a repetition limit or a target entropy")
    ends = sources.filter("tokens > 0").agg(F.max("tokens").alias("top"), F.min("tokens").alias("least")).first()
    if not ends["top"]:
        return 1.0, 1.0
    top = float(ends["top"])
    if repeat_limit is not None:
        # passes are q^(a - 1): the most and the least repeated sources are the smallest and the largest
        return bisect_exponent(lambda a: (top / ends["least"]) ** (1 - a) <= repeat_limit), top
    known = entropies(sources, top, [0.0])
    low, high = 0.0, 1.0

    def good(a: float) -> bool:
        nonlocal low, high
        if a not in known:
            known.update(entropies(sources, top, _ahead(low, high, AHEAD)))
        fits = known[a] <= target_entropy
        if a:
            low, high = (low, a) if fits else (a, high)
        return fits

    return bisect_exponent(good), top


def _block_of(n: str) -> Column:
    """Block of a document in a source of n documents, by a hash of its id."""
    return F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.ceil(F.sqrt(F.col(n)))).cast("int")


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(_NONE)).alias("_source")


def _block_key(passes: str) -> Column:
    return F.xxhash64("_block", F.lit(SEED), passes)


def _doc_key(passes: str) -> Column:
    return F.xxhash64("doc_id", F.lit(SEED + 1), passes)


def _doc() -> Column:
    """Place of a document in its block."""
    return F.struct(_doc_key("passes").alias("k"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id"))


def _with_source(rows: DataFrame, sources: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(sources) if few else sources, "_source", how)


class Plan:
    """One row a source: ``n, weight, passes, rest``, and the position up to which the next pass goes."""

    def __init__(self, sources: DataFrame, few: bool):
        self.sources, self.few = sources, few


def plan(counted: DataFrame, budget: int | None = None, repeat_limit: float | None = REPEAT_LIMIT, target_entropy: float | None = None) -> Plan:
    """What each source gets; counted: ``_source``, ``doc_id``, ``tokens``."""
    sources = materialise(counted.groupBy("_source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "sources")
    few = sources.count() <= BROADCAST
    exponent, top = find_exponent(sources, repeat_limit, target_entropy)
    whole = sources.agg(F.sum(_raised(exponent, top))).first()[0] or 1.0
    weight = _raised(exponent, top) / F.lit(whole)
    weighted = sources.withColumn("weight", weight)
    least = F.lit(0)
    if budget is None:
        # the least that holds a whole pass over every source; rounding must not take the pass away
        budget = weighted.filter("weight > 0").agg(F.max(F.ceil(F.col("tokens") / F.col("weight")))).first()[0] or 0
        least = F.col("tokens")
    own = F.greatest(F.floor(F.col("weight") * F.lit(float(budget)) + 1e-6), least).cast("long")
    some = F.col("tokens") > 0
    passes = F.when(some, F.floor(own / F.col("tokens"))).otherwise(1).cast("long")
    start = weighted.withColumn("passes", passes).withColumn("rest", F.when(some, own - F.col("passes") * F.col("tokens")).otherwise(0).cast("long"))
    start = materialise(start.select("_source", "n", "weight", "passes", "rest"), "passes")
    # the block in which each source's next pass ends
    located = _with_source(counted, start, few).withColumn("_block", _block_of("n"))
    blocks = located.groupBy("_source", "_block", "passes", "rest").agg(F.sum("tokens").alias("tokens"))
    order = Window.partitionBy("_source").orderBy(_block_key("passes"), "_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = blocks.withColumn("upto", F.sum("tokens").over(order)).filter("upto > rest")
    left = (F.col("rest") - (F.col("upto") - F.col("tokens"))).alias("left")
    cut = running.groupBy("_source").agg(F.min(F.struct("upto", _block_key("passes").alias("k"), "_block", left)).alias("cut"))
    ended = materialise(cut.select("_source", F.col("cut.k").alias("cut_key"), F.col("cut._block").alias("cut_block"), F.col("cut.left").alias("left")), "ends")
    # and the document in that block; rows that repeat a doc_id go together
    inside = _with_source(located, ended, few).filter("_block = cut_block")
    by_doc = inside.groupBy("_source", "left", _doc().alias("_key")).agg(F.sum("tokens").alias("tokens"))
    taken = by_doc.withColumn("upto", F.sum("tokens").over(Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = taken.filter("upto <= left").groupBy("_source").agg(F.max("_key").alias("last"))
    full = start.join(ended, "_source", "left").join(last, "_source", "left")
    done = materialise(full.select("_source", "n", "weight", "passes", "rest", "cut_key", "cut_block", "left", F.col("last.k").alias("last_key"), F.col("last._id").alias("last_id")), "plan")
    discard(sources, start, ended)
    return Plan(done, few)


def copies(rows: DataFrame, planned: Plan) -> DataFrame:
    """Add ``weight``, ``passes`` and ``copies`` to rows with ``_source`` and ``doc_id``."""
    joined = _with_source(rows, planned.sources, planned.few).withColumn("_block", _block_of("n"))
    at, cut = F.struct(_block_key("passes"), F.col("_block")), F.struct("cut_key", "cut_block")
    before = at < cut
    inside = (F.col("_block") == F.col("cut_block")) & F.col("last_key").isNotNull() & (_doc() <= F.struct("last_key", "last_id"))
    # a rest as large as all blocks cannot be: then it would be a pass; without tokens there is no cut and no rest
    more = F.when(F.col("cut_block").isNull() | (F.col("rest") == 0), F.lit(0)).when(before | inside, F.lit(1)).otherwise(F.lit(0))
    return joined.withColumn("copies", (F.col("passes") + more).cast("int"))


def _counted(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of each row, written once."""
    tokens = F.regexp_count(whole_text(), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    return materialise(docs.select("doc_id", "source", _source(), tokens.alias("tokens")), "tokens")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture has it."""
    counted = _counted(docs)
    # whole rows are packed, so that no column of theirs can clash with the plan's
    packed = docs.select("doc_id", _source(), F.struct(*[docs[c] for c in docs.columns]).alias("_whole"))
    rows = copies(packed, plan(counted, **how))
    discard(counted)
    return rows.select(F.explode(F.array_repeat("_whole", F.col("copies"))).alias("_whole")).select("_whole.*")


def op8_temperature_mixing(docs: DataFrame) -> DataFrame:
    """One row a document: its source, tokens, the source's weight, whole passes, copies in the mixture and place in the last pass."""
    counted = _counted(docs)
    rows = copies(counted, plan(counted))
    return rows.select(
        "doc_id", "source", "tokens", F.round("weight", 12).alias("weight"), "passes", "copies", F.col("_block").alias("block"),
        _block_key("passes").alias("block_key"), _doc_key("passes").alias("doc_key"),
    )
