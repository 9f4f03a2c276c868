"""Near copies of a corpus by SimHash, for a similarity of shingle sets that no small radius reaches.

Two texts are near copies if their sets of five-word shingles (64-bit hashes)
have a Jaccard similarity of 0.8 or more. Whatever is proposed below, this is
computed exactly before a text goes.

Why SimHash alone doesn't do: at 0.8, 15 % of the bits differ. Masks that miss
no such pair leave a quarter of all pairs to compare, however the bits are
dealt, so the work would grow with the square of the corpus. Three steps do:

1. Keys. Rows meet if they are in one component of op5's search (fingerprints
   of 64 bits that differ in at most ``RADIUS``, by the generalised pigeonhole),
   or if they agree in one of ``BANDS`` bands of ``WIDTH`` least hashes. A pair
   of similarity s agrees in a band with probability s**7, so that 0.8 is
   missed by all 20 with 0.9 %, 0.9 with less than one in a million, and
   strangers at 0.2 meet once in 4,000 pairs.
2. SimHash. Rows that meet are compared by 256-bit fingerprints; a link has at
   most ``TOTAL`` differing bits (0.8: expected 39, spread 6, so 0.1 % of such
   pairs are beyond). Components of the links are teams.
3. Shingles. Inside a team the sets themselves are compared; components of the
   pairs that are alike are the groups, and the least row of each stays.

Hot groups, in both 2 and 3 (:func:`group_links`): all rows of a group of more
than ``chunk`` rows are compared with one of them, by a join that can be split.
Rows linked to it are in one component already and needn't meet each other. The
rest is dealt into chunks, and any two chunks that hold such a row meet in a
cell. No task holds a group and nothing is capped; what comes out is at most a
link for each row of a cell. Links are the same for every size of a chunk.

Cost: keys and fingerprints are 200 bytes a row; of texts and sets only those
of teams move. A group whose rows are close but not alike, so that one of them
links few, costs the square of its rest.

Defined cases: null text is the empty text, whose set is empty, and empty sets
are alike; fewer than five words are one shingle; rows with one doc_id, or none,
are told apart by 128 bits of their text; null doc_id comes last; rows that
repeat both stay or go together (the exact stage leaves none); a very long text
is hashed in pieces, and its set takes eight bytes a shingle; an empty table
gives an empty result; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.block_dedup import _NO_ID, ROW, _row_key
from tessera.llm.common import cells, discard_all, materialise, small_batches, whole_text, written
from tessera.llm.components import components
from tessera.llm.simhash import join_labels

SHINGLE, RADIUS, TOTAL, WORDS = 5, 2, 56, 4
BANDS, WIDTH = 20, 7
#: Near copies have at least this Jaccard similarity (a fraction).
ALIKE = (4, 5)
#: Rows of a chunk: of fingerprints, and of shingle sets.
PRINTS, SETS = 2048, 256
#: Shingles and pairs handled at a time.
PIECE, TILE = 4096, 1 << 18

FPS = [f"fp{k}" for k in range(1, WORDS + 1)]
#: One odd factor and one mask for each least hash, from the golden ratio and the square root of two.
_TURN = ((np.arange(1, BANDS * WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
_FLIP = ((np.arange(1, BANDS * WIDTH + 1, dtype=np.uint64) * np.uint64(0x6A09E667F3BCC909)) >> np.uint64(32)).astype(np.uint32)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Other 64-bit hashes made of hashes: xor, shift and multiply."""
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """SimHash words of a set of shingle hashes: of the hashes themselves, then of others made of them."""
    counts = np.zeros((WORDS, simhash.BITS), np.int64)
    for at in range(0, len(hashes), PIECE):
        some = hashes[at : at + PIECE]
        for k in range(WORDS):
            counts[k] += simhash.bits_set(_mixed(some, k) if k else some)
    return [simhash.packed(2 * c > len(hashes)) for c in counts]


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band: what ``WIDTH`` least hashes under different orders have in common."""
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), PIECE):
        x = (hashes[at : at + PIECE] >> np.uint64(32)).astype(np.uint32)
        x = x ^ (x >> np.uint32(15))
        turned = (x[None, :] ^ _FLIP[:, None]) * _TURN[:, None]
        least = np.minimum(least, (turned ^ (turned >> np.uint32(16))).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, WIDTH).T:
        key = _mixed(key ^ column.astype(np.uint64), 1)
    return key.view(np.int64)


def sketches(keyed: DataFrame) -> DataFrame:
    """Row key, ``fp1`` ... and ``keys`` (the bands) of each row of ``keyed`` (row key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = np.zeros((len(batch), WORDS), np.uint64), np.zeros((len(batch), BANDS), np.int64)
            for k, text in enumerate(cells(batch.column(len(ROW)))):
                hashes = simhash.shingle_set(text, SHINGLE)
                fps[k], keys[k] = wide_fingerprint(hashes), bands(hashes)
            fps = fps.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(batch) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ROW)], *[pa.array(fps[:, k]) for k in range(WORDS)], lists], names=[*ROW, *FPS, "keys"])

    small_batches(keyed.sparkSession)
    return keyed.select(*ROW, "text").mapInArrow(run, ", ".join([*[f"{c} long" for c in [*ROW, *FPS]], "keys array<long>"]))


def cell_runs(compare: Callable[[list[pa.Array]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole cells, one at a time, from batches sorted by their first column."""

    def one(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compare([c.combine_chunks() for c in pa.Table.from_batches(parts).columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            if kept and kept[-1].column(0)[-1].as_py() != cell[0]:
                yield from one(kept)
                kept = []
            start = 0
            for end in np.nonzero(np.diff(cell))[0] + 1:
                yield from one([*kept, batch.slice(start, end - start)])
                kept, start = [], end
            kept.append(batch.slice(start))
        if kept:
            yield from one(kept)

    return run


#: Joins the labels of places that are linked: each of the first rows with each of the second (none: of the first).
Join = Callable[[list, list | None, np.ndarray], None]


def group_links(rows: DataFrame, payload: list[str], close: Callable[[list[Column], list[Column]], Column], join: Join, chunk: int) -> DataFrame:
    """Columns a, b: links whose components are those of all close pairs of a group.

    rows: ``grp``, ``id`` and the payload that is compared, by the expression
    ``close`` with a group's leader and by ``join`` within a cell. An id can be
    in several groups, once in each.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = materialise(rows.groupBy("grp").agg(F.count("*").alias("n"), F.min("id").alias("leader")).filter("n > 1"), "groups")
    hot = groups.filter(F.col("n") > chunk)
    first = [f"first_{c}" for c in payload]
    leaders = rows.join(hot.select("grp", F.col("leader").alias("id")), ["grp", "id"]).dropDuplicates(["grp"]).select("grp", *[F.col(c).alias(f) for c, f in zip(payload, first, strict=True)])
    like = close([F.col(c) for c in payload], [F.col(c) for c in first])
    led = materialise(rows.join(leaders, "grp").filter(like).select("grp", "id"), "led")
    start = led.join(hot, "grp").filter("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    counts = led.groupBy("grp").agg(F.count("*").alias("led"))
    left = groups.join(counts, "grp", "left").select("grp", "leader", F.coalesce("led", F.lit(0)).alias("led"), "n")
    plan = left.withColumn("rest", F.col("n") - F.col("led")).filter("rest > 0").withColumns({c: F.ceil(F.col(c) / chunk).cast("int") for c in ("rest", "led")})
    met = rows.join(plan, "grp").join(led.select("grp", "id", F.lit(True).alias("_led")), ["grp", "id"], "left")
    is_led, dealt = F.coalesce("_led", F.lit(False)), F.xxhash64("id")
    place = F.when(is_led, F.col("rest") + F.pmod(dealt, F.greatest("led", F.lit(1)))).otherwise(F.pmod(dealt, F.col("rest"))).cast("int")
    # a led row meets the rest only
    last = F.when(is_led, F.col("rest")).otherwise(F.col("rest") + F.col("led")) - 1
    met = met.select("grp", "id", F.when(is_led, F.col("leader")).otherwise(F.col("id")).alias("label"), *payload, place.alias("chunk"), F.explode(F.sequence(F.lit(0), last)).alias("met"))
    cell = F.xxhash64("grp", F.least("chunk", "met"), F.greatest("chunk", "met"))
    met = met.select(cell.alias("cell"), "chunk", (F.col("chunk") == F.col("met")).alias("diagonal"), "id", "label", *payload)

    def compare(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        side = columns[1].to_numpy(zero_copy_only=False)
        lower, diagonal = side == side.min(), columns[2][0].as_py()
        if lower.all() and not diagonal:
            return  # its rows meet in a cell of their own
        order = np.argsort(~lower, kind="stable")
        ids, named = (columns[k].to_numpy(zero_copy_only=False)[order] for k in (3, 4))
        compared = [c.take(pa.array(order)) for c in columns[5:]]
        m = int(lower.sum())
        # rows of one label are linked from the start
        _, at, place = np.unique(named, return_index=True, return_inverse=True)
        label = at[place]
        join([c[:m] for c in compared], None if diagonal else [c[m:] for c in compared], label)
        own = np.nonzero((label != np.arange(len(label))) & (ids != ids[label]))[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[label[own]])], names=["a", "b"])

    return start.union(met.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(cell_runs(compare), "a long, b long"))


def join_close(left: list[pa.Array], right: list[pa.Array] | None, label: np.ndarray) -> None:
    """Join rows whose words differ in at most ``TOTAL`` bits."""
    words = lambda side: [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in side]
    a = words(left)
    b, shift = (a, 0) if right is None else (words(right), len(a[0]))
    step = max(1, TILE // max(1, len(b[0])))
    for at in range(0, len(a[0]), step):
        off = sum(np.bitwise_count(x[at : at + step, None] ^ y[None, :]).astype(np.uint16) for x, y in zip(a, b, strict=True))
        i, j = np.nonzero(off <= TOTAL)
        join_labels(label, i + at, j + shift)


def join_alike(left: list[pa.Array], right: list[pa.Array] | None, label: np.ndarray) -> None:
    """Join rows whose sets have a similarity of ``ALIKE``: each set is looked up in the sorted shingles of the other side."""
    own, other = left[0], left[0] if right is None else right[0]
    shift = 0 if right is None else len(own)
    lengths = lambda c: c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    mine = np.split(own.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths(own))[:-1])
    sizes, flat = lengths(other), other.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(other)), sizes)[order]
    p, q = ALIKE
    for k, x in enumerate(mine):
        if (label[shift : shift + len(other)] == label[k]).all():
            continue
        low, high = np.searchsorted(flat, x), np.searchsorted(flat, x, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(other))
        hits = np.nonzero(q * both >= p * (len(x) + sizes - both))[0]
        join_labels(label, np.full(len(hits), k), hits + shift)


def _close(own: list[Column], first: list[Column]) -> Column:
    off = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(own, first, strict=True)]
    return sum(off[1:], off[0]) <= TOTAL


def _alike(own: list[Column], first: list[Column]) -> Column:
    both = F.size(F.array_intersect(own[0], first[0]))
    return F.lit(ALIKE[1]) * both >= F.lit(ALIKE[0]) * (F.size(own[0]) + F.size(first[0]) - both)


def _met(prints: DataFrame) -> DataFrame:
    """``grp``, ``id`` of rows that share a key; keys that the same rows share count once."""
    near = components(simhash.links(prints.select(F.col(FPS[0]).alias("fp")).distinct(), RADIUS)).select(F.col("node").alias(FPS[0]), "root")
    close = prints.join(near, FPS[0], "left").select(F.xxhash64(F.lit(0), F.coalesce("root", FPS[0])).alias("grp"), "id")
    keyed = prints.select(F.explode("keys").alias("grp"), "id").union(close)
    who = [F.count("*").alias("n"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("y")]
    shared = keyed.groupBy("grp").agg(*who).filter("n > 1").groupBy("n", "least", "x", "y").agg(F.min("grp").alias("grp"))
    return keyed.join(materialise(shared.select("grp"), "shared"), "grp", "left_semi")


def teams(prints: DataFrame) -> DataFrame:
    """``id``, ``team`` of the rows of ``prints`` that SimHash links to others."""
    met = materialise(_met(prints).join(prints.select("id", *FPS), "id").select("grp", "id", *FPS), "met")
    roots = materialise(components(group_links(met, FPS, _close, join_close, PRINTS)), "teams")
    return roots.select(F.col("node").alias("id"), F.col("root").alias("team")).union(roots.select("root", "root").distinct())


def _shingle_sets(rows: DataFrame) -> DataFrame:
    """id, team and ``shingles``, the set of the row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.slice(at, 64)
                sets = [simhash.shingle_set(t, SHINGLE).view(np.int64) for t in cells(some.column(2))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["id", "grp", "shingles"])

    small_batches(rows.sparkSession)
    return rows.select("id", "team", "text").mapInArrow(run, "id long, grp long, shingles array<long>")


def near_groups(keyed: DataFrame) -> DataFrame:
    """Row key and ``root`` of each row of ``keyed`` (row key, text) that has a near copy; rows of one group share the root."""
    prints = materialise(sketches(keyed).withColumn("id", F.monotonically_increasing_id()), "sketches")
    # rows that repeat are one member
    members = materialise(prints.select("id", *ROW).join(teams(prints), "id").dropDuplicates(ROW), "members")
    # members grow with the documents: the same plan at every size, never a broadcast
    sets = materialise(_shingle_sets(keyed.join(members.hint("merge"), ROW).dropDuplicates(ROW)), "sets")
    roots = components(group_links(sets, ["shingles"], _alike, join_alike, SETS)).withColumnRenamed("node", "id")
    own = members.select("id", *ROW)
    return own.join(roots, "id").select("root", *ROW).union(own.join(roots.select(F.col("root").alias("id")).distinct(), "id").select("id", *ROW))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not near copies of one with a lesser doc_id, with all their columns."""
    before = written()
    keyed = _row_key(docs.select("doc_id", whole_text().alias("text")), "text").select(*ROW, "text")
    rank = F.struct((F.col("_doc") == _NO_ID).alias("none"), *ROW)
    named = materialise(near_groups(keyed), "alike")
    first = named.groupBy("root").agg(F.min(rank).alias("first"))
    gone = materialise(named.join(first, "root").filter(rank > F.col("first")).select(*ROW), "gone")
    discard_all(but=before | {gone._shared_path})
    packed = docs.select("doc_id", whole_text().alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("_whole"))
    return _row_key(packed, "text").join(gone.hint("merge"), ROW, "left_anti").select("_whole.*")
