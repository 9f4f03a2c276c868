"""Toxicity by a weighted lexicon and Aho-Corasick.

Folding. Lower case; accents and homoglyphs become plain Latin letters;
invisible signs go; digits and signs beside a letter become the letter they
stand for; letters spelled with dots or dashes between them are joined; all
else that is no letter becomes a space.

Lexicon. Terms match at the start of a word (a stem), so endings don't hide
them; a term with a plus sign needs an ending. To a short list of insults come stems learned from labelled documents:
word beginnings that toxic ones hold far more often, by a likelihood-ratio
test; of nested ones that with the most evidence is kept. A term's weight is its log odds. Exception phrases
(``trash can``) take the terms inside them out.

Score. Matched weight, matched weight per word (so that length is normalised)
and the number of different matched words enter a logistic function fitted to the same
labelled documents.

Plan: the model is learned from at most ``per_class`` documents of each class,
written once. Stems are counted, and texts measured, on the executors; the
driver gets hashes and measures, a few numbers a document, and the terms that
pass the test. Scoring is a narrow scan and one Arrow map, in time linear in the
text. Defined cases: null and empty texts get the score of a text without terms;
a very long text is folded and scored whole; with no labels the list alone
decides; repeated rows give repeated rows, and labels of an id that several rows
have are not learned from; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cells, discard, held_out, materialise, small_batches
from tessera.llm.training_sample import labelled

# Letters of other scripts that look like Latin ones, and what digits and signs stand for.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ɑ": "a", "ı": "i", "ł": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "!": "i", "+": "t"}
INSULTS = [
    "clown", "cretin", "degenerate", "disgusting", "dumbass", "filth", "idiot", "imbecile", "loser", "lowlife", "maggot", "moron",
    "pathetic", "retard", "scum", "scumbag", "shithead", "stupid", "trash", "vermin", "worthless",
]
EXCEPTIONS = ["trash can", "trash bag", "trash bin", "trash collection", "clown fish", "pond scum", "soap scum", "loser bracket", "pathetic fallacy"]

#: Bound of the training sample for each class, and what a learned stem must show.
PER_CLASS = 3000
STEM = range(3, 12)
EVIDENCE, LEAST_ODDS = 30.0, 1.5


def _fold_table() -> dict[int, str]:
    table = {}
    for code in [*range(0x80), *range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x370, 0x530), *range(0x2000, 0x2070), 0xFEFF, 0xAD]:
        sign = chr(code)
        if sign in HOMOGLYPHS:
            table[code] = HOMOGLYPHS[sign]
        elif unicodedata.category(sign) == "Cf":
            table[code] = ""
        elif sign.isalpha():
            plain = "".join(c for c in unicodedata.normalize("NFKD", sign) if not unicodedata.combining(c)).lower()
            table[code] = "".join(HOMOGLYPHS.get(c, c) for c in plain)
        elif sign not in SIGNS and sign not in ".-_*":
            table[code] = " "
    return table | {code: "" for code in range(0x300, 0x370)} | {code: chr(code - 0xFEE0).lower() for code in [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]}


_TABLE = _fold_table()
_SPELLED = re.compile(r"(?<![a-z])[a-z](?:[.\-_*]+[a-z0-9@$!]){2,}(?![a-z])")
_MARKS = re.compile(r"[.\-_*]+")
_STANDS = re.compile(r"(?<=[a-z])[0134578@$€9+]|(?<=[a-z])!(?=[a-z0-9@$])|[0134578@$€9](?=[a-z])")
_OTHER = re.compile(r"[0-9@$€!+.\-_*]+")
_SIGN = re.compile(r"[0-9@$€!+]")


def fold(text: str) -> str:
    """The text as words of plain letters, each behind a space."""
    out = text.lower().translate(_TABLE)
    out = _SPELLED.sub(lambda m: _MARKS.sub("", m[0]), out)
    if _SIGN.search(out):
        for _ in range(2):
            out = _STANDS.sub(lambda m: SIGNS[m[0]], out)
    return " " + _OTHER.sub(" ", out) + " "


class Lexicon:
    """Terms with weights, exception phrases, and the fitted logistic function."""

    def __init__(self, terms: dict[str, float], exceptions: list[str], curve: tuple[float, ...]):
        self.terms, self.exceptions, self.curve = terms, exceptions, curve

    def __getstate__(self):
        return self.terms, self.exceptions, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def finder(self):
        if "_finder" not in self.__dict__:
            import ahocorasick

            self._finder = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                bare = term.rstrip("+")
                self._finder.add_word(f" {bare}", (len(bare), weight, term != bare))
            for phrase in self.exceptions:
                self._finder.add_word(f" {phrase} ", (len(phrase) + 1, None, False))
            self._finder.make_automaton()
        return self._finder

    def measures(self, text: str) -> tuple[float, float, float]:
        """Matched weight, matched weight for 1000 words, different matched words; all as log(1 + x)."""
        folded = fold(text)
        found, spared = [], []
        for end, (length, weight, goes_on) in self.finder.iter(folded):
            if weight is None:
                spared.append((end - length, end))
            elif not goes_on or folded[end + 1] != " ":
                found.append((end - length + 1, weight))
        if spared:
            # exceptions are whole words, so by their ends they are in order of their starts but for nested ones
            spared.sort()
            starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
            found = [f for f in found if not ((k := bisect_right(starts, f[0])) and f[0] <= reach[k - 1])]
        if not found:
            return 0.0, 0.0, 0.0
        # the longest of the terms that match at a place counts
        best = {at: (weight, folded[at : folded.index(" ", at)]) for at, weight in found}
        total = sum(w for w, _ in best.values())
        return math.log1p(total), math.log1p(1000 * total / (1 + len(folded.split()))), math.log1p(len({word for _, word in best.values()}))

    def score(self, text: str) -> float:
        z = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], self.measures(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def least_hashes(text: str) -> list[int]:
    """The four least hashes of three words in a row."""
    words = text.split()
    return sorted({zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))})[:4]


def distinct(rows: list[tuple[int, list[int]]]) -> set[int]:
    """Ids of the texts without near copies of earlier ones, told by shared least hashes."""
    seen: set[int] = set()
    out = set()
    for at, least in rows:
        if sum(h in seen for h in least) * 2 <= len(least) or not seen:
            out.add(at)
        seen.update(least)
    return out


def stems(text: str) -> set[str]:
    """Word beginnings; with a plus sign, if more of the word follows."""
    return {x for w in set(fold(text).split()) for k in STEM if len(w) >= k for x in (w[:k], w[:k] + "+" * (len(w) > k))}


def log_odds(a: float, b: float, n1: int, n0: int) -> float:
    return math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))


def _telling(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """``evidence`` (likelihood-ratio statistic) of the stems that toxic documents hold far more often; counts: stem, a, b."""
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / F.lit(n1 + 1.0)) - F.log((b + 0.5) / F.lit(n0 + 1.0))
    both = (a + b) / F.lit(float(n1 + n0))
    term = lambda x, n, q: F.when(x > 0, x * F.log(x / (n * q))).otherwise(0.0)
    part = lambda k, n: term(k, F.lit(float(n)), both) + term(n - k, F.lit(float(n)), 1 - both)
    tested = counts.filter((a >= 3) & (odds >= LEAST_ODDS)).withColumn("evidence", 2 * (part(a, n1) + part(b, n0)))
    return tested.filter(F.col("evidence") >= EVIDENCE)


def choose_terms(found: list[tuple[float, str, float]]) -> dict[str, float]:
    """Terms and weights from (evidence, stem, log odds): of stems that begin with each other, the one with the most evidence."""
    terms: dict[str, float] = {}
    longer: set[str] = set()
    for _, s, odds in sorted(found, key=lambda x: (-x[0], x[1])):
        bare = s.rstrip("+")
        parts = [bare[:k] for k in range(1, len(bare) + 1)]
        if bare not in longer and not any(x in terms or x + "+" in terms for x in parts):
            terms[s] = min(8.0, odds)
            longer.update(parts)
    for s in INSULTS:
        if s not in longer and not any(s[:k] in terms or s[:k] + "+" in terms for k in range(1, len(s) + 1)):
            terms[s] = 4.0
    return terms


def _each(sample: DataFrame, make, schema: str) -> DataFrame:
    """Rows that ``make`` yields for each (doc_id, label, text) of the sample, on the executors."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), cells(batch.column(2)), strict=True):
                rows = list(make(at, mark, text or ""))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    types = [plain[c.split()[1]] for c in schema.split(", ")]
    return sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(run, schema)


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """Terms of the sample; its near copies count once."""
    least = _each(sample, lambda at, mark, text: [(at, mark, least_hashes(text))], "doc_id long, label int, least array<long>").collect()
    kept = {mark: distinct(sorted((r["doc_id"], r["least"]) for r in least if r["label"] == mark)) for mark in (0, 1)}
    n1, n0 = len(kept[1]), len(kept[0])
    held = _each(sample, lambda at, mark, text: ((s, mark) for s in stems(text)) if at in kept[mark] else (), "stem string, label int")
    counts = held.groupBy("stem").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    found = _telling(counts, n1, n0).collect()
    return choose_terms([(r["evidence"], r["stem"], log_odds(r["a"], r["b"], n1, n0)) for r in found])


def fit_curve(rows: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(rows)), rows])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-1] * rows.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (labels - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Lexicon:
    small_batches(docs.sparkSession)
    sample = materialise(labelled(docs, labels, label, per_class, ["text"]), "sample")
    if sample.select("label").distinct().count() < 2:
        return Lexicon(dict.fromkeys(INSULTS, 4.0), EXCEPTIONS, (-3.0, 1.0, 0.5, 0.5))
    found = Lexicon(learn_terms(sample), EXCEPTIONS, (0.0, 0.0, 0.0, 0.0))
    measured = _each(sample, lambda at, mark, text: [(at, mark, *found.measures(text))], "doc_id long, label int, x double, y double, z double")
    rows = sorted(tuple(r) for r in measured.collect())
    discard(sample)
    curve = fit_curve(np.array([r[2:] for r in rows]), np.array([float(r[1]) for r in rows]))
    return Lexicon(found.terms, EXCEPTIONS, curve)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and ``score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [lexicon.score(t or "") for t in cells(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op4_lexicon_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
