"""String functions with UTF-8 byte positions, lifted over dimensions.

Positions and lengths count bytes. An empty needle is found nowhere: ``find``
and ``rfind`` give -1, ``count`` 0, ``contains`` false, ``replace`` a copy and
``split`` the whole string. Matches don't overlap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.lifting import elwise, fail, forward_na
from tessera.value import Value

STRING, LONG, BOOL = T.StringType(), T.LongType(), T.BooleanType()


def _lift(f, dtype: T.DataType):
    return elwise(forward_na(lambda *v: Value(f(*[x.col for x in v]), dtype)))


def _bytes(s: Column) -> Column:
    return F.octet_length(s)


def _find(h: Column, n: Column) -> Column:
    at = F.call_function("instr", h, n)
    return F.when((n == "") | (at == 0), F.lit(-1)).otherwise(_bytes(F.left(h, at - 1))).cast("long")


def _rfind(h: Column, n: Column) -> Column:
    at = F.call_function("instr", F.reverse(h), F.reverse(n))
    return F.when((n == "") | (at == 0), F.lit(-1)).otherwise(_bytes(h) - _bytes(F.right(h, at - 1)) - _bytes(n)).cast("long")


def _count(h: Column, n: Column) -> Column:
    left = _bytes(h) - _bytes(F.replace(h, n, F.lit("")))
    return F.when(n == "", F.lit(0)).otherwise(F.call_function("div", left, F.greatest(_bytes(n), F.lit(1)))).cast("long")


def _split(s: Column, sep: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), F.replace(sep, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(sep == "", F.array(s)).otherwise(F.split(s, quoted, -1))


string_concatenation = _lift(F.concat, STRING)
string_find = _lift(_find, LONG)
string_rfind = _lift(_rfind, LONG)
string_count = _lift(_count, LONG)
string_replace = _lift(lambda s, old, new: F.when(old == "", s).otherwise(F.replace(s, old, new)), STRING)
string_startswith = _lift(F.startswith, BOOL)
string_endswith = _lift(F.endswith, BOOL)
string_contains = _lift(lambda h, n: (n != "") & F.contains(h, n), BOOL)
string_split = _lift(_split, T.ArrayType(STRING, False))

# Encodings and the names Spark has for them, the code points that the narrow ones hold, and what stands for others.
ENCODINGS = {"ascii": "US-ASCII", "latin1": "ISO-8859-1", "utf8": "UTF-8", "ucs2": "UTF-16LE", "utf16": "UTF-16LE", "utf16be": "UTF-16BE", "utf32": "UTF-32"}
BEYOND = {"ascii": "[^\\x{0}-\\x{7F}]", "latin1": "[^\\x{0}-\\x{FF}]", "ucs2": "[^\\x{0}-\\x{FFFF}]"}
SUBSTITUTE = "?"


def _mode(error_mode: str) -> bool:
    """Whether what can't be converted is an error."""
    if error_mode not in ("checked", "nocheck"):
        raise ValueError(f"error mode {error_mode!r} is neither checked nor nocheck")
    return error_mode == "checked"


def encode(v: Value, encoding: str, error_mode: str = "checked") -> Value:
    """Bytes of a string; a character that the encoding lacks is an error, or a substitute where not checked."""
    checked, beyond = _mode(error_mode), BEYOND.get(encoding)

    def scalar(s: Value) -> Value:
        text = s.col
        if beyond and checked and encoding == "ucs2":
            text = F.when(text.rlike(beyond), fail("a character is beyond ucs2", STRING)).otherwise(text)
        elif beyond and not checked:
            text = F.regexp_replace(text, beyond, SUBSTITUTE)
        return Value(F.encode(text, ENCODINGS[encoding]), T.BinaryType())

    return elwise(scalar)(v)


def decode(v: Value, encoding: str, error_mode: str = "checked") -> Value:
    """String of bytes; bytes that are no text in the encoding are an error, or substitutes where not checked."""
    checked = _mode(error_mode)

    def scalar(s: Value) -> Value:
        if checked:
            text = F.decode(s.col, ENCODINGS[encoding])
            return Value(F.when(text.rlike(BEYOND["ucs2"]), fail("a surrogate is not in ucs2", STRING)).otherwise(text) if encoding == "ucs2" else text, STRING)
        if encoding in ("ascii", "latin1"):
            return Value(F.regexp_replace(F.decode(s.col, "ISO-8859-1"), BEYOND[encoding], SUBSTITUTE), STRING)
        if encoding == "utf8":
            return Value(F.replace(F.make_valid_utf8(s.col.cast("string")), F.lit("\ufffd"), F.lit(SUBSTITUTE)), STRING)
        return Value(_lenient(encoding)(s.col), STRING)

    return elwise(scalar)(v)


def _lenient(encoding: str):
    """Wide encodings with substitutes: Spark's decoder stops at the first error, so these are Arrow batches."""
    import pyarrow as pa

    name = {"ucs2": "utf-16-le", "utf16": "utf-16-le", "utf16be": "utf-16-be", "utf32": "utf-32-be"}[encoding]
    width = 0xFFFF if encoding == "ucs2" else 0x10FFFF

    def one(x: bytes) -> str:
        return "".join(c if ord(c) <= width and c != "\ufffd" else SUBSTITUTE for c in x.decode(name, errors="replace"))

    return F.arrow_udf(lambda cells: pa.array([None if x is None else one(x) for x in cells.to_pylist()], pa.string()), STRING)
