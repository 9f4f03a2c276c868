"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a text, the byte-pair encoding of that prefix ends in one
unique token. The table stores this last token for each prefix:

* an Aho-Corasick automaton over the vocabulary lists the tokens that end at a
  position;
* a token t starting at s is the last token of the prefix exactly if it can
  stand behind the last token of prefix s: the pair, encoded on its own, must
  come out as those two tokens (pair compatibility);
* the ids are then read backwards from the last prefix.

This takes linear time whatever the text looks like, with no priority queue.

Pair compatibility is decided by undoing the last merges of the two tokens,
latest first, and asking at each stage whether a merge across the border would
have come earlier (better score, or equal score further left). That is exact
when the scores along a token's own derivation never improve; tokens for which
they do are flagged while the table is built and take the slow, literal test.

If no piece of the vocabulary holds a space mark behind another character, or an
ASCII sign or digit beside a letter (both are looked up), no merge crosses such
a border: the parts between borders are encoded on their own and the results
are kept in a bounded cache. Characters outside the vocabulary become byte
tokens.

Plan: a narrow scan and one Arrow map; no shuffle. The vocabulary (half a
megabyte, fixed) travels in the task closure. Defined cases: null text is
encoded as the empty text, which has no ids; repeated rows give repeated rows;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import cells, small_batches

SPACE = "▁"
NONE = -1
#: ASCII characters that are no letters.
SIGNS = "\\x00-@\\[-`{-\\x7f"
#: Entries of a generation of the word cache (two are kept) and of the pair cache of a worker.
WORDS_KEPT, PAIRS_KEPT = 150_000, 250_000


def parsed(ids: str) -> np.ndarray:
    """Ids from their decimal form, joined by commas."""
    return np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32)


class PieceCodec:
    """Encoder and decoder for one BPE model file with byte fallback and no normalisation."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        spm = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = spm.get_piece_size()
        self.text = [spm.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(size) if spm.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i in range(size) if spm.is_control(i)}
        self.unknown = {i for i in range(size) if spm.is_unknown(i)}
        self.special = self.control | self.unknown | self.byte_of.keys()
        self.piece_id = {t: i for i, t in enumerate(self.text) if i not in self.special}
        if len(self.byte_id) != 256 or any(spm.is_unused(i) for i in range(size)):
            raise ValueError("only BPE models with byte fallback and no unused pieces are supported")
        order = {s: r for r, s in enumerate(sorted({spm.get_score(i) for i in self.piece_id.values()}, reverse=True))}
        self.order = [order.get(spm.get_score(i), 0) for i in range(size)]
        self.length = [len(t) for t in self.text]
        self.digits = [str(i) for i in range(size)]
        characters = set().union(*self.piece_id)
        if not characters <= self.piece_id.keys():
            raise ValueError("a character of a piece is no piece of its own")
        by_word = not any(SPACE in t.lstrip(SPACE) for t in self.piece_id)
        mixed = {x for t in self.piece_id for x in re.findall(f"([^\\W\\d_])(?=[{SIGNS}])|(?<=[{SIGNS}])([^\\W\\d_])", t) for x in x if x}
        letter, plain = f"[^\\W\\d_{re.escape(''.join(sorted(mixed)))}]", f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        # letters before a sign or signs before a letter; else all up to the next space
        self.parts = re.compile(f"{SPACE}*{letter}++(?=[{SIGNS}{SPACE}]|\\Z)|{SPACE}*[{SIGNS}]++(?={letter}|{SPACE}|\\Z)|{plain}" if by_word else "(?s).+")
        # the last merge of each token's own derivation; rank -1: a single character
        self.rank, self.left, self.right = [NONE] * size, [NONE] * size, [NONE] * size
        self.whole, self.odd = bytearray(size), set()
        self.finder = ahocorasick.Automaton()
        for t, i in self.piece_id.items():
            symbols, merges = self._merge(list(t))
            if len(symbols) == 1:
                self.whole[i] = 1
                if merges:
                    ranks = [m[0] for m in merges]
                    self.rank[i], self.left[i], self.right[i] = merges[-1][0], self.piece_id[merges[-1][1]], self.piece_id[merges[-1][2]]
                    if ranks != sorted(ranks):
                        self.odd.add(i)
                self.finder.add_word(t, i)  # a piece that never stands for itself can't be a last token
        self.finder.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def _merge(self, symbols: list[str]) -> tuple[list[str], list[tuple[int, str, str]]]:
        """The definition of BPE, for short texts: merge the best pair, leftmost first, until none is left."""
        merges = []
        while len(symbols) > 1:
            found = [(self.order[i], k) for k in range(len(symbols) - 1) if (i := self.piece_id.get(symbols[k] + symbols[k + 1])) is not None]
            if not found:
                break
            rank, k = min(found)
            merges.append((rank, symbols[k], symbols[k + 1]))
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols, merges

    def compatible(self, a: int, b: int) -> bool:
        """Whether the texts of a and b, encoded together, come out as these two tokens."""
        known = self.pairs.get(at := a << 32 | b)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[at] = self.literal_compatible(a, b) if a in self.odd or b in self.odd else self._undo(a, b)
        return known

    def literal_compatible(self, a: int, b: int) -> bool:
        return self._merge(list(self.text[a] + self.text[b]))[0] == [self.text[a], self.text[b]]

    def _undo(self, a: int, b: int) -> bool:
        text, rank, order, ids = self.text, self.rank, self.order, self.piece_id
        before = 1 << 62  # when the present state ends: twice the rank, and one more if equal ranks come later there
        while True:
            across = ids.get(text[a] + text[b])
            if across is not None and 2 * order[across] < before:
                return False
            ra, rb = rank[a], rank[b]
            if rb >= ra:
                if rb == NONE:
                    return True
                before, b = 2 * rb + 1, self.left[b]
            else:
                before, a = 2 * ra, self.right[a]

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part of a text that no merge leaves; unknown characters give byte ids."""
        last = [NONE] * (len(part) + 1)  # by the place of a prefix's last character; the empty prefix is at -1
        length, known, done = self.length, self.pairs.get, NONE
        for end, token in self.finder.iter(part):
            if end != done:
                before = last[end - length[token]]
                if before == NONE:
                    last[end] = token
                    done = end
                else:
                    fits = known(before << 32 | token)
                    if fits is None:
                        fits = self.compatible(before, token)
                    if fits:
                        last[end] = token
                        done = end
        ids, at = [], len(part) - 1
        while at >= 0:
            token = last[at]
            if token == NONE:
                ids.extend(self.byte_id[x] for x in reversed(part[at].encode()))
                at -= 1
            else:
                ids.append(token)
                at -= length[token]
        ids.reverse()
        return ids

    def word(self, part: str) -> tuple[int, str, str]:
        """Count, joined ids and decoded text of a part; kept for later."""
        out = self.older.get(part)
        if out is None:
            ids = self.encode_part(part)
            digits = self.digits
            out = len(ids), ",".join([digits[i] for i in ids]), self._surface(ids)
        if len(part) <= 64:
            if len(self.words) >= WORDS_KEPT:
                self.older, self.words = self.words, {}
            self.words[part] = out
        return out

    def forget(self) -> None:
        """Drop the words kept; the pairs stay."""
        self.words, self.older = {}, {}

    def encoded(self, text: str) -> list[tuple[int, str, str]]:
        if not text:
            return []
        get, word = self.words.get, self.word
        return [get(p) or word(p) for p in self.parts.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str) -> np.ndarray:
        return parsed(",".join([w[1] for w in self.encoded(text)]))

    def _surface(self, ids: list[int]) -> str:
        if not self.special.intersection(ids):
            return "".join([self.text[i] for i in ids]).replace(SPACE, " ")
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run = bytearray()
            if i not in self.control:
                out.append(" ⁇ " if i in self.unknown else self.text[i].replace(SPACE, " "))
        if run:
            out.append(run.decode(errors="replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; the space put before the text while encoding goes."""
        return self._surface(ids).removeprefix(" ")


_LOADED: dict[str, PieceCodec] = {}


def loaded(model: bytes) -> PieceCodec:
    """The codec of this worker, built once."""
    at = hashlib.sha256(model).hexdigest()
    if at not in _LOADED:
        _LOADED[at] = PieceCodec(model)
    return _LOADED[at]


def read_model(path: str) -> bytes:
    """Read on the driver; executors get the bytes."""
    with open(path, "rb") as f:
        return f.read()


def _map(docs: DataFrame, model_path: str, cell: str, row: Callable, fields: list[pa.Field], types: str, *more: str) -> DataFrame:
    """doc_id and the columns ``more`` of ``docs``, then what ``row`` makes of each value of ``cell``."""
    model, carried = read_model(model_path), ["doc_id", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(model)
        try:
            for batch in batches:
                got = [row(codec, t or "") for t in cells(batch.column(len(carried)))]
                columns = [pa.array([g[k] for g in got], type=f.type) for k, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *columns], names=[*carried, *[f.name for f in fields]])
        finally:
            codec.forget()  # the worker lives on and may run other stages

    small_batches(docs.sparkSession)
    kept = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in more]
    return docs.selectExpr("cast(doc_id as bigint) doc_id", *more, cell).mapInArrow(run, ", ".join(["doc_id long", *kept, types]))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the ids of each text."""
    return _map(docs, model_path, "text", lambda codec, text: (codec.encode(text),), [pa.field("ids", pa.list_(pa.int32()))], "ids array<int>")


def decode(ids: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of each array of ids."""
    return _map(ids, model_path, "ids", lambda codec, x: (codec.decode(list(x)),), [pa.field("text", pa.string())], "text string")


def _digest(codec: PieceCodec, text: str) -> tuple[int, str, str, str]:
    """Count, digest of the ids, digest of the decoded text, and the ids joined by commas."""
    words = codec.encoded(text)
    ids = ",".join([w[1] for w in words])
    back = "".join([w[2] for w in words]).removeprefix(" ")
    return sum([w[0] for w in words]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids


_DIGESTS = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
_DIGEST_TYPES = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_corpus(docs: DataFrame, model_path: str) -> DataFrame:
    """What training reads: doc_id, source, the contract's digests and the ``ids`` of each text."""

    def row(codec: PieceCodec, text: str) -> tuple:
        *digests, ids = _digest(codec, text)
        return *digests, parsed(ids)

    return _map(docs, model_path, "text", row, [*_DIGESTS, pa.field("ids", pa.list_(pa.int32()))], f"{_DIGEST_TYPES}, ids array<int>", "source")


def op2_piece_codec(docs: DataFrame, model_path: str) -> DataFrame:
    """The contract's rows: count and digest of the ids, and digest of the text decoded from them."""
    return _map(docs, model_path, "text", _digest, _DIGESTS, _DIGEST_TYPES)
