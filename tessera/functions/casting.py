"""Conversion between types with error modes, and missing-value rules.

Modes, from loose to strict: ``nocheck`` (wraps or truncates silently),
``overflow`` (values out of range are errors), ``fractional`` (so is a
fractional part lost to an integer type) and ``inexact`` (so is any value that
does not come back the same). Assigning checks fractions by default; ``cast``
does not check.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.lifting import elwise, fail
from tessera.types import is_complex, is_integer, to_spark
from tessera.value import Value, literal

MODES = ("nocheck", "overflow", "fractional", "inexact")
REAL = (T.FloatType, T.DoubleType)


def na_text(s: Column) -> Column:
    """Whether a text stands for a missing value: empty, NA, null in any case, or None."""
    bare = F.trim(s)
    return (bare == "") | (bare == "NA") | (F.lower(bare) == "null") | (bare == "None")


def _wrapped(x: Column, dtype: T.DataType) -> Column:
    """The low bits of an integer, as a signed number of the type's width."""
    bits = {"tinyint": 8, "smallint": 16, "int": 32}.get(dtype.simpleString())
    if bits is None:
        return x.cast(dtype)
    low = F.pmod(x.cast("long"), F.lit(1 << bits))
    return F.when(low >= 1 << (bits - 1), low - (1 << bits)).otherwise(low).cast(dtype)


def _bool_text(s: Column) -> Column:
    low = F.lower(F.trim(s))
    yes, no = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")
    return F.when(low.isin(*yes), F.lit(True)).when(low.isin(*no), F.lit(False)).otherwise(fail("text is no boolean", T.BooleanType()))


def _scalar(v: Value, dtype: T.DataType, mode: str, option: bool) -> Value:
    x, source = v.col, v.dtype
    if source == dtype:
        return Value(F.when(~F.isnan(x), x), dtype) if option and isinstance(dtype, REAL) else v
    if is_complex(dtype) and not is_complex(source):
        part = dtype["re"].dataType
        return Value(F.when(x.isNotNull(), F.struct(x.cast(part).alias("re"), F.lit(0).cast(part).alias("im"))), dtype)
    if isinstance(source, T.StringType):
        text = F.trim(x)
        if isinstance(dtype, T.BooleanType):
            out = _bool_text(x)
        elif is_integer(dtype) and mode != "nocheck":
            out = text.cast("decimal(38,10)").cast(dtype) if mode == "overflow" else F.when(text.rlike(r"^[+-]?\d+(\.0*)?$"), text.cast("decimal(38,10)").cast(dtype)).otherwise(fail("text is no whole number", dtype))
        elif mode == "nocheck":
            out = text.try_cast(dtype)
        else:
            out = text.cast(dtype)
        return Value(F.when(~na_text(x), out) if option else out, dtype)
    if isinstance(source, REAL) and is_integer(dtype):
        kept = F.when(~F.isnan(x), x) if option else x
        if mode == "nocheck":
            whole = kept.cast("double").try_cast("long")
            return Value(_wrapped(F.coalesce(whole, F.when(kept.isNotNull(), F.lit(-(2**63)))), dtype), dtype)
        if mode == "overflow":
            return Value(kept.cast(dtype), dtype)
        whole = F.when(kept.isNull() | (kept == F.floor(kept)), kept).otherwise(fail("a fractional part would be lost", source))
        return Value(whole.cast(dtype), dtype)
    if isinstance(dtype, T.BooleanType) and mode != "nocheck" and isinstance(source, T.NumericType):
        return Value(F.when(x.isNull() | x.isin(0, 1), x != 0).otherwise(fail("number is no boolean", dtype)), dtype)
    if is_integer(source) and is_integer(dtype) and mode == "nocheck":
        return Value(_wrapped(x, dtype), dtype)
    if mode == "inexact" and isinstance(dtype, REAL) and isinstance(source, T.NumericType):
        out = x.cast(dtype)
        back = out.cast(source) if isinstance(source, REAL) else out.cast("decimal(38,0)").cast(source)
        same = (back == x) | (F.isnan(x) if isinstance(source, REAL) else F.lit(False))
        return Value(F.when(x.isNull() | same, out).otherwise(fail("value can't be held exactly", dtype)), dtype)
    return Value(x.cast(dtype), dtype)


def assign(v, dtype: T.DataType | str, error_mode: str = "fractional") -> Value:
    """Convert every element; a shape with ``?`` reads NA texts and NaN as missing."""
    if error_mode not in MODES:
        raise ValueError(f"error mode {error_mode!r} is none of {MODES}")
    option = isinstance(dtype, str) and "?" in dtype
    dtype = to_spark(dtype) if isinstance(dtype, str) else dtype
    while isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    return elwise(lambda s: _scalar(s, dtype, error_mode, option))(literal(v))


def cast(v, dtype: T.DataType | str) -> Value:
    """Unchecked conversion of the elements; dimensions stay."""
    return assign(v, dtype, "nocheck")


def nan_to_na(v) -> Value:
    """NaN becomes missing."""
    return elwise(lambda s: Value(F.when(~F.isnan(s.col), s.col), s.dtype))(literal(v))


def copy(v) -> Value:
    return literal(v)
