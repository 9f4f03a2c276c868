"""Complex numbers as STRUCT<re, im>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.types import is_complex
from tessera.value import Value

COMPLEX = T.StructType([T.StructField(n, T.DoubleType(), True) for n in ("re", "im")])


def make(re: Column, im: Column, dtype: T.DataType = COMPLEX) -> Value:
    return Value(F.struct(re.alias("re"), im.alias("im")).cast(dtype), dtype)


def as_complex(v: Value, dtype: T.DataType = COMPLEX) -> Value:
    if is_complex(v.dtype):
        return Value(v.col.cast(dtype), dtype)
    return Value(F.when(v.col.isNotNull(), make(v.col.cast("double"), F.lit(0.0), dtype).col), dtype)


def _parts(z: Value) -> tuple[Column, Column]:
    return z.col["re"], z.col["im"]


def add(a: Value, b: Value) -> Value:
    (p, q), (r, s) = _parts(a), _parts(b)
    return make(p + r, q + s, a.dtype)


def subtract(a: Value, b: Value) -> Value:
    (p, q), (r, s) = _parts(a), _parts(b)
    return make(p - r, q - s, a.dtype)


def multiply(a: Value, b: Value) -> Value:
    (p, q), (r, s) = _parts(a), _parts(b)
    return make(p * r - q * s, p * s + q * r, a.dtype)


def divide(a: Value, b: Value) -> Value:
    (p, q), (r, s) = _parts(a), _parts(b)
    norm = r * r + s * s
    return make((p * r + q * s) / norm, (q * r - p * s) / norm, a.dtype)


def negate(z: Value) -> Value:
    p, q = _parts(z)
    return make(-p, -q, z.dtype)


def real(z: Value) -> Value:
    return Value(z.col["re"], z.dtype["re"].dataType)


def imag(z: Value) -> Value:
    return Value(z.col["im"], z.dtype["im"].dataType)


def conj(z: Value) -> Value:
    p, q = _parts(z)
    return make(p, -q, z.dtype)


def absolute(z: Value) -> Value:
    return Value(F.hypot(z.col["re"], z.col["im"]), T.DoubleType())


def sqrt(z: Value) -> Value:
    """Principal root: real part not negative, imaginary part with the sign of z's."""
    p, q = _parts(z)
    size = F.hypot(p, q)
    im = F.sqrt(F.greatest((size - p) / 2, F.lit(0.0)))
    return make(F.sqrt(F.greatest((size + p) / 2, F.lit(0.0))), F.when(q < 0, -im).otherwise(im), z.dtype)
