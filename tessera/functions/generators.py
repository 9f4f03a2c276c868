"""Constructors, ranges and random numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import complexes
from tessera.types import INTEGER_RANGE, to_spark
from tessera.value import Value, literal

DOUBLE = T.DoubleType()


def filled(shape: tuple[int, ...], x: Value) -> Value:
    """An array of a shape with one value everywhere."""
    for n in reversed(shape):
        x = Value(F.array_repeat(x.col, n), T.ArrayType(x.dtype, True))
    return x


def empty(shape: tuple[int, ...], dtype: str = "float64") -> Value:
    """Not yet assigned: missing values of the type."""
    return filled(shape, literal(None, dtype))


def zeros(shape: tuple[int, ...], dtype: str = "float64") -> Value:
    t = to_spark(dtype)
    return filled(shape, Value(F.lit(0).cast(t), t))


def ones(shape: tuple[int, ...], dtype: str = "float64") -> Value:
    t = to_spark(dtype)
    return filled(shape, Value(F.lit(1).cast(t), t))


def empty_like(v: Value) -> Value:
    """Missing values in the shape of another value."""
    go = lambda c, t: F.transform(c, lambda x: go(x, t.elementType)) if isinstance(t, T.ArrayType) else F.lit(None).cast(t)
    return Value(go(v.col, v.dtype), v.dtype)


def _kind(*xs) -> T.DataType:
    for x in xs:
        if x is not None:
            t = x.dtype if isinstance(x, Value) else literal(x).dtype
            return t if isinstance(t, (T.LongType, T.FloatType, T.DoubleType)) else T.IntegerType()
    raise ValueError("range needs a stop")


def range_(stop=None, *, start=None, step=None, dtype: str | None = None) -> Value:
    """start, start + step, ... before stop; one positional argument is the stop. Arguments may be columns.

    Integer counts are rounded up, real ones to the nearest; a step of 0 is an
    error and a range that goes the wrong way is empty.
    """
    kind = to_spark(dtype) if dtype else _kind(start, stop)
    a, b, s = [literal(0 if x is None and k == 0 else 1 if x is None and k == 2 else x).col.cast(kind) for k, x in enumerate((start, stop, step))]
    safe = F.when(s == 0, F.raise_error(F.lit("range: step is 0")).cast(kind)).otherwise(s)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        n = F.floor((b - a + safe * F.lit(0.5)) / safe)
    else:
        gap, width = (b - a).cast("long"), safe.cast("long")
        n = F.call_function("div", gap + width - F.signum(width).cast("long"), width)
    count = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    return Value(F.transform(count, lambda i: (a + i.cast(kind) * safe).cast(kind)), T.ArrayType(kind, False))


def linspace(start, stop, count: int = 50) -> Value:
    """count values from start to stop, both included."""
    a, b = literal(start), literal(stop)
    i = lambda f: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), f)
    d = max(count - 1, 1)
    mix = lambda x, y: lambda k: ((F.lit(count - 1) - k) * x + k * y) / F.lit(float(d))
    if isinstance(a.dtype, T.StructType) or isinstance(b.dtype, T.StructType):
        p, q = complexes.as_complex(a), complexes.as_complex(b)
        f = lambda k: complexes.make(mix(p.col["re"], q.col["re"])(k), mix(p.col["im"], q.col["im"])(k)).col
        return Value(i(f), T.ArrayType(complexes.COMPLEX, False))
    return Value(i(mix(a.col.cast("double"), b.col.cast("double"))), T.ArrayType(DOUBLE, False))


def uniform(a=None, b=None, dtype: str = "float64", seed: int | None = None) -> Value:
    """A random value for each row: integers in [a, b], reals in [a, b), complex numbers by part."""
    t = to_spark(dtype)
    draw = lambda k: F.rand() if seed is None else F.rand(seed + k)
    if isinstance(t, T.StructType):
        low, high = complex(a or 0), complex(1 + 1j if b is None else b)
        return complexes.make(low.real + draw(0) * (high.real - low.real), low.imag + draw(1) * (high.imag - low.imag), t)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        low, high = a or 0.0, 1.0 if b is None else b
        return Value((F.lit(float(low)) + draw(0) * F.lit(float(high - low))).cast(t), t)
    low, high = a or 0, limits(dtype)[1] if b is None else b
    return Value(F.least(F.floor(F.lit(float(low)) + draw(0) * F.lit(float(high) - float(low) + 1.0)), F.lit(high)).cast(t), t)


def uniform_array(n: int | Column, **how) -> Value:
    """A 1-d value of independent draws, by seeded hashing of the row's own random value and the index."""
    one = uniform(dtype="float64", seed=how.get("seed"))
    a, b = how.get("a") or 0.0, 1.0 if how.get("b") is None else how["b"]
    draws = F.transform(F.sequence(F.lit(1), F.lit(n) if isinstance(n, int) else n), lambda i: F.lit(float(a)) + F.pmod(F.xxhash64(one.col, i), F.lit(1 << 53)) / F.lit(float(1 << 53)) * F.lit(float(b) - float(a)))
    return Value(draws, T.ArrayType(DOUBLE, False))


def limits(dtype: str) -> tuple:
    """Least and greatest finite value of a type."""
    if dtype in INTEGER_RANGE:
        return INTEGER_RANGE[dtype]
    if dtype == "bool":
        return False, True
    if dtype == "float32":
        top = (2 - 2**-23) * 2.0**127
        return -top, top
    if dtype == "float64":
        top = math.ldexp(2 - 2**-52, 1023)
        return -top, top
    raise ValueError(f"{dtype} has no limits")


def limits_min(dtype: str) -> Value:
    return literal(limits(dtype)[0], dtype)


def limits_max(dtype: str) -> Value:
    return literal(limits(dtype)[1], dtype)


def range_rows(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """A range as rows, made by the executors."""
    return spark.range(start, stop, step)
