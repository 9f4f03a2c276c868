"""Datashape strings, their Spark types, numeric promotion and pattern matching.

A datashape describes an n-dimensional value: ``3 * var * ?int32`` is three
ragged rows of integers that may be missing, ``{x: int32, y: ?string}`` a
struct. Spark has no unsigned, 128-bit, half or complex numbers; they widen:

* unsigned types become the next wider signed type (uint64: DECIMAL(20,0));
* 128-bit integers become DECIMAL(38,0), whose range is smaller;
* float16 becomes FLOAT and float128 DOUBLE;
* complex numbers become STRUCT<re, im>.

Sizes of fixed dimensions, and of fixed strings and bytes, are kept in the
parsed shape and checked where values enter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

# The scalar names and the Spark types that hold them.
SCALARS: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "int128": T.DecimalType(38, 0),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "uint128": T.DecimalType(38, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "float128": T.DoubleType(),
    "int": T.IntegerType(), "real": T.DoubleType(), "intptr": T.LongType(), "uintptr": T.DecimalType(20, 0),
    "string": T.StringType(), "bytes": T.BinaryType(), "char": T.StringType(), "void": T.NullType(),
    "fixed_string": T.StringType(), "fixed_bytes": T.BinaryType(), "categorical": T.StringType(),
}
COMPLEX = {"complex32": T.FloatType(), "complex64": T.DoubleType(), "complex": T.DoubleType()}
#: Least and greatest value of each integer type name.
INTEGER_RANGE = {f"{u}int{b}": ((0 if u else -(2 ** (b - 1))), 2 ** (b if u else b - 1) - 1) for u in ("", "u") for b in (8, 16, 32, 64)}


@dataclass(frozen=True)
class Scalar:
    name: str
    length: int | None = None


@dataclass(frozen=True)
class Option:
    item: object


@dataclass(frozen=True)
class Dim:
    """size: None for a ragged dimension, a string for a type variable."""

    size: int | str | None
    item: object


@dataclass(frozen=True)
class Struct:
    fields: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Tuple:
    items: tuple[object, ...]


@dataclass(frozen=True)
class Pattern:
    """A symbolic type: Any, Scalar, or a type variable (a capital letter first)."""

    name: str


@dataclass
class _Reader:
    text: str
    tokens: list[tuple[str, int]] = field(default_factory=list)
    at: int = 0

    def __post_init__(self):
        place = 0
        pattern = re.compile(r"\s*(?:#[^\n]*\n\s*)*([A-Za-z_][A-Za-z_0-9]*|\d+|\.\.\.|\*\*|[{}()\[\],:*?'\"]|->)")
        while self.text[place:].strip():
            m = pattern.match(self.text, place)
            if not m:
                self.fail(place)
            self.tokens.append((m[1], m.start(1)))
            place = m.end()

    def fail(self, place: int | None = None):
        place = place if place is not None else (self.tokens[self.at][1] if self.at < len(self.tokens) else len(self.text))
        line = self.text.count("\n", 0, place) + 1
        raise ValueError(f"datashape: unexpected input at line {line}, column {place - self.text.rfind(chr(10), 0, place)}: {self.text!r}")

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k][0] if self.at + k < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        got = self.peek()
        if not got or wanted and got not in wanted:
            self.fail()
        self.at += 1
        return got

    def shape(self):
        if self.peek() == "?":
            self.take()
            return Option(self.shape())
        if self.peek(1) == "*":
            size = self.take()
            self.take("*")
            if size.isdigit():
                return Dim(int(size), self.shape())
            return Dim(None if size == "var" else size, self.shape())
        if self.peek() == "{":
            return Struct(tuple(self.many("{", "}", self.named)))
        if self.peek() == "(":
            return Tuple(tuple(self.many("(", ")", self.shape)))
        name = self.take()
        if name in ("Any", "Scalar") or name[0].isupper():
            return Pattern(name)
        if name == "pointer":
            self.take("[")
            item = self.shape()
            self.take("]")
            return item
        if name == "complex" and self.peek() == "[":
            self.take("[")
            part = self.take()
            self.take("]")
            return Scalar("complex32" if part == "float32" else "complex64")
        if name not in SCALARS and name not in COMPLEX:
            self.at -= 1
            self.fail()
        length = None
        if self.peek() == "[":
            self.take()
            length = int(self.take())
            while self.peek() != "]":
                self.take()
            self.take("]")
        return Scalar(name, length)

    def named(self):
        name = self.take()
        if name in "'\"":
            name = self.take()
            self.take("'", '"')
        self.take(":")
        return name, self.shape()

    def many(self, first: str, last: str, one):
        self.take(first)
        out = []
        while self.peek() != last:
            out.append(one())
            if self.peek() == ",":
                self.take()
            elif self.peek() != last:
                self.fail()
        self.take(last)
        return out


def parse(text: str):
    """The parsed shape; errors name the line and column."""
    reader = _Reader(text)
    out = reader.shape()
    if reader.peek():
        reader.fail()
    return out


def to_spark(shape) -> T.DataType:
    """The Spark type that holds values of a shape (text or parsed)."""
    shape = parse(shape) if isinstance(shape, str) else shape
    match shape:
        case Scalar(name, _) if name in COMPLEX:
            return T.StructType([T.StructField(x, COMPLEX[name], True) for x in ("re", "im")])
        case Scalar(name, _):
            return SCALARS[name]
        case Option(item):
            return to_spark(item)
        case Dim(_, item):
            return T.ArrayType(to_spark(item), isinstance(item, Option))
        case Struct(fields):
            return T.StructType([T.StructField(n, to_spark(x), True) for n, x in fields])
        case Tuple(items):
            return T.StructType([T.StructField(f"_{k}", to_spark(x), True) for k, x in enumerate(items)])
    raise ValueError(f"{shape} is a pattern, not a type")


def relaxed(dtype: T.DataType) -> T.DataType:
    """The type with everything nullable, as expressions that may fail give it."""
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(relaxed(dtype.elementType), True)
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, relaxed(f.dataType), True) for f in dtype])
    return dtype


_BACK = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64",
         "string": "string", "binary": "bytes", "void": "void", "decimal(20,0)": "uint64", "decimal(38,0)": "int128"}


def from_spark(dtype: T.DataType, nullable: bool = False) -> str:
    """The datashape of a Spark type."""
    mark = "?" if nullable else ""
    if isinstance(dtype, T.ArrayType):
        return f"{mark}var * {from_spark(dtype.elementType, dtype.containsNull)}"
    if isinstance(dtype, T.StructType):
        if [f.name for f in dtype] == ["re", "im"]:
            return mark + ("complex32" if isinstance(dtype["re"].dataType, T.FloatType) else "complex64")
        if dtype.names and all(n == f"_{k}" for k, n in enumerate(dtype.names)):
            return f"{mark}({', '.join(from_spark(f.dataType, f.nullable) for f in dtype)})"
        return f"{mark}{{{', '.join(f'{f.name}: {from_spark(f.dataType, f.nullable)}' for f in dtype)}}}"
    name = _BACK.get(dtype.simpleString())
    if name is None:
        raise ValueError(f"no datashape for {dtype.simpleString()}")
    return mark + name


def match(pattern, shape, bound: dict | None = None) -> dict | None:
    """The bindings of the pattern's type variables for which it is the shape; None if there are none."""
    pattern = parse(pattern) if isinstance(pattern, str) else pattern
    shape = parse(shape) if isinstance(shape, str) else shape
    bound = {} if bound is None else dict(bound)

    def bind(name: str, value) -> dict | None:
        if name in bound:
            return bound if bound[name] == value else None
        return bound | {name: value}

    match pattern, shape:
        case Pattern("Any"), _:
            return bound
        case Pattern("Scalar"), Dim():
            return None
        case Pattern("Scalar"), _:
            return bound
        case Pattern(name), _:
            return bind(name, shape)
        case Option(a), Option(b):
            return match(a, b, bound)
        case Dim("Fixed", a), Dim(int(), b):
            return match(a, b, bound)
        case Dim(str() as name, a), Dim(size, b) if name != "Fixed":
            bound = bind(name, size)
            return None if bound is None else match(a, b, bound)
        case Dim(m, a), Dim(n, b) if m == n:
            return match(a, b, bound)
        case Struct(f), Struct(g) if [n for n, _ in f] == [n for n, _ in g]:
            parts = zip(f, g, strict=True)
            for (_, a), (_, b) in parts:
                bound = match(a, b, bound)
                if bound is None:
                    return None
            return bound
        case Tuple(f), Tuple(g) if len(f) == len(g):
            for a, b in zip(f, g, strict=True):
                bound = match(a, b, bound)
                if bound is None:
                    return None
            return bound
    return bound if pattern == shape else None


_ORDER = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType) or isinstance(t, T.DecimalType) and t.scale == 0


def is_complex(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.names == ["re", "im"]


def promote(a: T.DataType, b: T.DataType | None = None) -> T.DataType:
    """Type of an arithmetic result: small integers and booleans count as int32; a real type beats any integer."""
    kinds = [x for x in (a, b) if x is not None]
    if any(is_complex(x) for x in kinds):
        parts = [x["re"].dataType if is_complex(x) else x for x in kinds]
        part = T.FloatType() if all(isinstance(p, (T.FloatType, T.ByteType, T.ShortType)) for p in parts) else T.DoubleType()
        return T.StructType([T.StructField(n, part, True) for n in ("re", "im")])
    if any(isinstance(x, T.DoubleType) for x in kinds):
        return T.DoubleType()
    if any(isinstance(x, T.FloatType) for x in kinds):
        return T.FloatType()
    if any(isinstance(x, T.DecimalType) for x in kinds):
        return T.DecimalType(38, 0)
    if all(isinstance(x, (T.BooleanType, T.IntegralType)) for x in kinds):
        return T.LongType() if any(isinstance(x, T.LongType) for x in kinds) else T.IntegerType()
    if all(isinstance(x, T.StringType) for x in kinds):
        return T.StringType()
    raise TypeError(f"no arithmetic for {', '.join(x.simpleString() for x in kinds)}")


def common(a: T.DataType, b: T.DataType) -> T.DataType:
    """Type in which two values are compared."""
    if a == b:
        return a
    numeric = (T.BooleanType, T.NumericType)
    if isinstance(a, numeric) and isinstance(b, numeric):
        return promote(a, b)
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    raise TypeError(f"{a.simpleString()} and {b.simpleString()} can't be compared")
