"""SimHash near-duplicates found by the generalised pigeonhole principle.

Fingerprints that differ in at most ``radius`` of 64 bits are linked; documents
of a connected component are near-duplicates of each other.

Search. The 64 bits are grouped into m parts, correlated bits together (bit
co-occurrence is counted over all fingerprints). Part i gets a threshold t_i of
-1 or more with sum radius - m + 1: whatever two linked fingerprints look like,
in some part they differ in at most t_i bits. Which thresholds (and which m) is
decided by dynamic programming over estimated candidate counts: the number of
pairs that agree in a part, counted over all fingerprints, scaled by how often
its bits differ. A threshold t_i is probed by the C(|part|, t_i) masks that
leave out t_i bits of the part: pairs within t_i agree under one of them. So
each fingerprint gets one key (mask, masked value) for each mask.

Verify. Fingerprints of a key are compared in blocks, inside the task, and only
a spanning set of the verified links leaves it: rows out are at most rows in,
never all pairs of a group.

Skew. Equal fingerprints are one node from the start. Keys that more than
``bucket`` nodes share (counted with partial aggregation) go to no task whole:
the pigeonhole principle is applied again, to the bits that their mask leaves
open - split into radius + 1 parts, one of which a linked pair must share - and
again until the keys are small or leave at most ``radius`` bits open. Members
of such a last key are all within the radius of each other, and a link to the
least of them, found by aggregation, says all. Nothing is capped.

Very long texts are hashed ``CHUNK`` shingles at a time. For pairs that are
alike in fewer shingles than such a radius can reach see
:mod:`tessera.llm.near_copies`.

Defined cases: null text is the empty text; its fingerprint is zero, linked
like any other; null doc_id takes part and is never the least id unless a
component has no other; repeated rows give repeated rows; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cells, discard, discard_all, materialise, small_batches, written
from tessera.llm.components import components

BITS = 64
ALL = (1 << BITS) - 1
#: Shingles hashed at a time, so that very long texts take bounded memory.
CHUNK = 65_536


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_shingles(text: str, shingle: int) -> Iterator[list[bytes]]:
    """Shingles of A-Z lower-cased words between ASCII white space, ``CHUNK`` at a time; a shorter text is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    for at in range(0, n, CHUNK):
        part = words[at : min(n, at + CHUNK) + shingle - 1]
        yield [b" ".join(s) for s in zip(*[part[k:] for k in range(shingle)], strict=False)] if len(words) >= shingle else [b" ".join(words)]


def shingle_set(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts = [np.unique(np.fromiter((digest(s, seed) for s in found), np.uint64, len(found))) for found in text_shingles(text, shingle)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def packed(bits: np.ndarray) -> int:
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def text_fingerprint(text: str, shingle: int, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's shingles, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    count, total = np.zeros(BITS, np.int64), 0
    for found in text_shingles(text, shingle):
        total += len(found)
        count += bits_set(np.fromiter((digest(s, seed) for s in found), np.uint64, len(found)))
    return packed(2 * count > total)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((text_fingerprint(t or "", shingle) for t in cells(batch.column(1))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes, and how many have both bit i and bit j: 64 x 64 numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        rows = 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.float64)
            rows += len(bits)
        flat = np.append(total.ravel(), rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(flat)], names=["at", "n"])

    got = nodes.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).coalesce(1).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for row in got:
        flat[row["at"]] = row["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of near-equal size, each grown from a seed by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        rest = sorted(free)
        part = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        while len(part) < size:
            part.append(max((b for b in rest if b not in part), key=lambda b: (corr[b, part].sum(), -b)))
        free -= set(part)
        out.append(sorted(part))
    return out


def allocate(pairs: list[float], differ: np.ndarray, parts: list[list[int]], n: int, radius: int, key_cost: float = 16.0) -> tuple[float, list[int]]:
    """Thresholds of the least estimated cost; pairs: how many agree in each part; differ: by bit, how often two differ."""

    def cost(k: int, t: int) -> float:
        if t < 0:
            return 0.0
        # sum over the masks of the pairs that agree under each: the elementary symmetric polynomial of 1 / (1 - differ)
        poly = np.zeros(t + 1)
        poly[0] = 1
        for b in parts[k]:
            poly[1:] += poly[:-1] / max(1 - differ[b], 1e-6)
        return pairs[k] * poly[t] + key_cost * n * comb(len(parts[k]), t)

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for k in range(len(parts)):
        now: dict[int, tuple[float, list[int]]] = {}
        for total, (c, ts) in best.items():
            for t in range(-1, min(radius, len(parts[k])) + 1):
                new = c + cost(k, t)
                if total + t not in now or new < now[total + t][0]:
                    now[total + t] = new, [*ts, t]
        best = now
    return best[radius - len(parts) + 1]


def plan_masks(nodes: DataFrame, radius: int) -> list[int]:
    """The masks to probe, from counts over all nodes."""
    n, both = bit_counts(nodes)
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    plans = {m: group_bits(n, both, m) for m in range(2, min(radius + 2, 9))} if radius else {1: [list(range(BITS))]}
    wanted = [(m, k, sum(1 << b for b in part)) for m, parts in plans.items() for k, part in enumerate(parts)]
    masks = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.lit(_signed(mask)).alias("mask")) for m, k, mask in wanted])
    keyed = nodes.select("fp", F.explode(masks).alias("x")).select("x.m", "x.k", F.col("fp").bitwiseAND(F.col("x.mask")).alias("value"))
    counted = keyed.groupBy("m", "k", "value").count().groupBy("m", "k").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).coalesce(1).collect()
    pairs = {(r["m"], r["k"]): r["pairs"] for r in counted}
    _, thresholds, parts = min(
        (*allocate([pairs.get((m, k), 0.0) for k in range(m)], differ, parts, n, radius), parts) for m, parts in plans.items()
    )
    return [sum(1 << b for b in part if b not in out) for part, t in zip(parts, thresholds, strict=True) if t >= 0 for out in combinations(part, t)]


@lru_cache(maxsize=100_000)
def finer(mask: int, radius: int) -> tuple[int, ...]:
    """Masks that cover more: the open bits, dealt into radius + 1 parts, one part at a time."""
    open_bits = [b for b in range(BITS) if not mask >> b & 1]
    return tuple(mask | sum(1 << b for b in open_bits[k :: radius + 1]) for k in range(radius + 1))


def _refine(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            for k, kind in enumerate(kinds):
                fps = batch.column(1).filter(pa.array(at == k))
                for new in finer(int(kind) & ALL, radius):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), _signed(new), np.int64)), fps], names=["mask", "fp"])

    return run


def link_runs(key: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """Place of the least row that each row reaches by verified links among rows of its key; keys are sorted."""
    n = len(key)
    a, b = [], []
    here, d = np.arange(n), 0
    while True:
        d += 1
        here = here[here + d < n]
        here = here[key[here] == key[here + d]]
        if not len(here):
            break
        hit = here[np.bitwise_count(fp[here] ^ fp[here + d]) <= radius]
        a.append(hit)
        b.append(hit + d)
    label = np.arange(n)
    if a:
        join_labels(label, np.concatenate(a), np.concatenate(b))
    return label


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked places (and what they were linked to before) the least label of them, in place; roots label themselves."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _link(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def linked(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        root = link_runs(key, fp.view(np.uint64), radius)
        own = np.nonzero(fp != fp[root])[0]
        ends = np.unique(np.stack([fp[own], fp[root[own]]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
            if not len(columns[0]):
                continue
            # the last key may go on in the next batch
            end = int(np.searchsorted(columns[0], columns[0][-1]))
            kept = [c[end:] for c in columns]
            if end:
                yield linked(*[c[:end] for c in columns])
        if kept is not None and len(kept[0]):
            yield linked(*kept)

    return run


def links(nodes: DataFrame, radius: int, bucket: int = 2048) -> DataFrame:
    """Columns a, b: links whose components are those of all pairs of nodes (``fp``) that differ in at most ``radius`` bits."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    masks = F.array(*[F.lit(_signed(m)) for m in plan_masks(nodes, radius)])
    rows = nodes.select(F.explode(masks).alias("mask"), "fp")
    open_bits = F.bit_count(F.bitwise_not("mask"))
    found: DataFrame | None = None
    while True:
        rows = rows.withColumn("key", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        crowded = materialise(rows.groupBy("key").count().filter(F.col("count") > bucket).select("key"), "crowded")
        none = crowded.isEmpty()
        small = rows if none else rows.join(crowded, "key", "left_anti")
        small = small.select("key", "fp").repartition(parts, "key").sortWithinPartitions("key")
        some = small.mapInArrow(_link(radius), "a long, b long")
        if none:
            return some if found is None else found.union(some)
        large = rows.join(crowded, "key", "left_semi")
        last = large.filter(open_bits <= radius)
        center = materialise(last.groupBy("key").agg(F.min("fp").alias("c")), "centers")
        stars = last.join(center, "key").filter("fp <> c").select(F.col("fp").alias("a"), F.col("c").alias("b"))
        got = materialise(some.union(stars).distinct(), "links")
        found = got if found is None else found.union(got)
        again = large.filter(open_bits > radius).select("mask", "fp")
        rows = materialise(again.mapInArrow(_refine(radius), "mask long, fp long").distinct(), "finer")
        discard(center)
        if rows.isEmpty():
            return found


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, ``fp`` and ``component_id``, the least doc_id that can be reached."""
    before = written()
    fps = materialise(fingerprints(docs, shingle), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = materialise(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(ids, "root").select("fp", "component_id"), "components")
    discard_all(but=before | {fps._shared_path, named._shared_path})
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op5_pigeonhole_simhash(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    near = near_duplicates(docs, shingle=3, radius=2)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
