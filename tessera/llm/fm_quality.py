"""Quality classifier: a factorisation machine.

Inputs of a score: hashed words of the text (term frequencies of unit length),
structure statistics of the text, and the document's recorded length. The
statistics and the length enter as one-hot bins whose borders are quantiles of
the training sample. The machine is

    z = bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

and the pairwise sum is computed in linear time, for each of the k factors, as
half of (sum v_i x_i)^2 - sum (v_i x_i)^2.

Plan: fitted on the driver from at most ``PER_CLASS`` labelled documents of
each class (features are made on the executors and only they are gathered);
scoring is a narrow scan and one Arrow map with a model of fixed size. Defined
cases: null text is the empty text; a very long text is read whole; null recorded
length has a bin of its own; if a class has no labels every score is the share
of the other; repeated rows give repeated rows, and labels of an id that several
rows have are not learned from; an empty table gives an empty result; extra
columns are not read, and pass through :func:`keep_good`, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cells, free_name, held_out, small_batches
from tessera.llm.training_sample import labelled

#: Documented bounds and sizes.
PER_CLASS, WORDS, FACTORS, BINS, EPOCHS, SEED = 3000, 1 << 15, 8, 10, 6, 7
N_STATS = 16


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Fixed-length description of a text's structure."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    n = max(1, len(points))
    share = lambda mask: float(np.count_nonzero(mask)) / n
    letters = ((points | 32) >= 97) & ((points | 32) <= 122)
    digits = (points >= 48) & (points <= 57)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    ascii_sign = (points < 128) & ~letters & ~digits & ~space
    lines = text.split("\n")
    n_words = max(1, len(words))
    signed = sum(c for w, c in counts.items() if not w[-1].isalnum())
    return [
        float(np.log1p(len(points))),
        share((points >= 65) & (points <= 90)),
        share(digits),
        share(ascii_sign),
        share((points == 44) | (points == 46)),
        share(points >= 128),
        share(space),
        share(points == 10),
        float(len(words)) / max(1, len(lines)),
        sum(len(w) * c for w, c in counts.items()) / n_words,
        len(counts) / n_words,
        max(counts.values(), default=0) / n_words,
        signed / n_words,
        len(set(lines)) / len(lines),
        sum(c for w, c in counts.items() if len(w) == 1) / n_words,
        sum(c for w, c in counts.items() if len(w) > 12) / n_words,
    ]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Hashed words, their values, and the statistics with the recorded length last."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    folded: dict[int, int] = {}
    for w, c in counts.items():
        at = zlib.crc32(w.lower().encode()) % WORDS
        folded[at] = folded.get(at, 0) + c
    value = np.fromiter(folded.values(), np.float32, len(folded))
    value /= max(1e-9, float(np.sqrt((value * value).sum())))
    stats = statistics(text, words, counts)
    return np.fromiter(folded, np.int32, len(folded)), value, [*stats, float("nan") if n_chars is None else float(np.log1p(max(0, n_chars)))]


class Machine:
    """Bin borders, linear weights and factors."""

    def __init__(self, borders: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.borders, self.bias, self.w, self.v = borders, bias, w, v

    def inputs(self, at: np.ndarray, value: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Word inputs, and one input for the bin of each statistic; a missing one has the last bin."""
        bins = [BINS if s != s else int(np.searchsorted(b, s, side="right")) for s, b in zip(stats, self.borders, strict=True)]
        own = WORDS + np.arange(len(bins)) * (BINS + 1) + np.array(bins)
        return np.concatenate([at, own]), np.concatenate([value, np.full(len(bins), 0.5, np.float32)])

    def raw(self, at: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        vx = self.v[at] * x[:, None]
        total = vx.sum(axis=0)
        return float(self.bias + self.w[at] @ x + 0.5 * ((total * total).sum() - (vx * vx).sum())), total, vx

    def score(self, text: str | None, n_chars: int | None) -> float:
        z = self.raw(*self.inputs(*features(text, n_chars)))[0]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray) -> Machine:
    """AdaGrad on the logistic loss, one document at a time in a seeded order."""
    stats = np.array([r[2] for r in rows])
    borders = np.array([np.nanquantile(s, np.arange(1, BINS) / BINS) if np.isfinite(s).any() else np.zeros(BINS - 1) for s in stats.T])
    size = WORDS + (N_STATS + 1) * (BINS + 1)
    rng = np.random.default_rng(SEED)
    share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6))
    machine = Machine(borders, float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32))
    if labels.min() == labels.max():
        machine.v[:] = 0
        return machine
    inputs = [machine.inputs(*r) for r in rows]
    gw, gv, gb = np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            at, x = inputs[k]
            z, total, vx = machine.raw(at, x)
            slope = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[k]
            dw = slope * x + 1e-6 * machine.w[at]
            dv = slope * x[:, None] * (total - vx) + 1e-5 * machine.v[at]
            gw[at] += dw * dw
            gv[at] += dv * dv
            gb += slope * slope
            machine.w[at] -= 0.2 * dw / np.sqrt(gw[at])
            machine.v[at] -= 0.05 * dv / np.sqrt(gv[at])
            machine.bias -= 0.1 * slope / np.sqrt(gb)
    return machine


def _length(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, none where a table records no lengths; batches of its texts are bounded."""
    small_batches(docs.sparkSession)
    return docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.lit(None).cast("long"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Machine:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t, n) for t, n in zip(cells(batch.column(1)), cells(batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32())), pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                names=["label", "at", "value", "stats"],
            )

    sample = labelled(_length(docs), labels, label, per_class, ["text", "n_chars"]).select("label", "text", F.col("n_chars").cast("long"))
    table = sample.mapInArrow(run, "label int, at array<int>, value array<float>, stats array<double>").toArrow()
    if not table.num_rows:
        return Machine(np.zeros((N_STATS + 1, BINS - 1)), 0.0, np.zeros(WORDS + (N_STATS + 1) * (BINS + 1), np.float32), np.zeros((WORDS + (N_STATS + 1) * (BINS + 1), FACTORS), np.float32))
    rows = []
    for part in table.to_batches():
        split = lambda name: np.split(part.column(name).flatten().to_numpy(zero_copy_only=False), np.cumsum(part.column(name).value_lengths().to_numpy())[:-1])  # noqa: B023, E731
        rows += list(zip(split("at"), split("value"), [s.tolist() for s in split("stats")], strict=True))
    marks = table.column("label").to_numpy().astype(float)
    order = np.lexsort((np.array([float(r[1].sum()) for r in rows]), np.array([len(r[0]) for r in rows]), marks))
    return train([rows[k] for k in order], marks[order])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and ``score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [machine.score(t, n) for t, n in zip(cells(batch.column(1)), cells(batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return _length(docs).selectExpr("cast(doc_id as bigint) doc_id", "text", "cast(n_chars as bigint) n_chars").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, with all their columns."""
    machine = fit(docs, labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [machine.score(t, n) >= threshold for t, n in zip(cells(batch.column(names.index("text"))), cells(batch.column(len(names))), strict=True)]
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[: len(names)], names=names)

    return _length(docs).select(*names, F.col("n_chars").cast("long").alias(free_name("_length", names))).mapInArrow(run, docs.schema)


def op7_factorisation_machine(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
