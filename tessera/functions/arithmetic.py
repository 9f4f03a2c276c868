"""Arithmetic, bitwise, logical, comparison and mathematical functions.

Each is a function of scalar Values, lifted over dimensions and strict about
missing values: a missing operand gives a missing result, for logical operators
too (Spark's own ``false AND NULL`` is false). Operands are cast to the
promoted type first (Spark adds small integers in their own width).

Overflow of integers is an error (ANSI), as is integer division by zero; real
division by zero gives infinities or NaN. Integers of different signedness are
compared by value.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import complexes
from tessera.functions.lifting import elwise, forward_na
from tessera.types import common, is_complex, is_integer, promote
from tessera.value import Value, literal

BOOL, DOUBLE = T.BooleanType(), T.DoubleType()


def _binary(real: Callable[[Column, Column, T.DataType], Column], cplx: Callable | None = None, integers_only: bool = False) -> Callable:
    def scalar(a: Value, b: Value) -> Value:
        kind = promote(a.dtype, b.dtype)
        if is_complex(kind):
            if cplx is None:
                raise TypeError("not defined for complex numbers")
            return cplx(complexes.as_complex(a, kind), complexes.as_complex(b, kind))
        if integers_only and not is_integer(kind):
            raise TypeError(f"only for integers, not {kind.simpleString()}")
        return Value(real(a.col.cast(kind), b.col.cast(kind), kind).cast(kind), kind)

    return elwise(forward_na(scalar))


def _divide(a: Column, b: Column, kind: T.DataType) -> Column:
    if is_integer(kind):
        return F.call_function("div", a, b)
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(math.nan)).otherwise(F.signum(a) * F.lit(math.inf))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


add = _binary(lambda a, b, t: a + b, complexes.add)
subtract = _binary(lambda a, b, t: a - b, complexes.subtract)
multiply = _binary(lambda a, b, t: a * b, complexes.multiply)
divide = _binary(_divide, complexes.divide)
mod = _binary(lambda a, b, t: a % b, integers_only=True)
bitwise_and = _binary(lambda a, b, t: a.bitwiseAND(b), integers_only=True)
bitwise_or = _binary(lambda a, b, t: a.bitwiseOR(b), integers_only=True)
bitwise_xor = _binary(lambda a, b, t: a.bitwiseXOR(b), integers_only=True)
left_shift = _binary(lambda a, b, t: F.call_function("shiftleft", a, b.cast("int")), integers_only=True)
right_shift = _binary(lambda a, b, t: F.call_function("shiftright", a, b.cast("int")), integers_only=True)


def _pow(a: Value, b: Value) -> Value:
    kind = T.FloatType() if isinstance(promote(a.dtype, b.dtype), T.FloatType) else DOUBLE
    return Value(F.pow(a.col.cast("double"), b.col.cast("double")).cast(kind), kind)


pow_ = elwise(forward_na(_pow))


def _unary(real: Callable[[Column], Column], cplx: Callable | None = None, integers_only: bool = False, keep: bool = False) -> Callable:
    def scalar(a: Value) -> Value:
        kind = a.dtype if keep else promote(a.dtype)
        if is_complex(kind):
            if cplx is None:
                raise TypeError("not defined for complex numbers")
            return cplx(a)
        if integers_only and not is_integer(kind):
            raise TypeError(f"only for integers, not {kind.simpleString()}")
        return Value(real(a.col.cast(kind)).cast(kind), kind)

    return elwise(scalar)


plus = _unary(lambda a: a, lambda z: z)
minus = _unary(lambda a: -a, complexes.negate)
bitwise_not = _unary(F.bitwise_not, integers_only=True)


def _truth(v: Value) -> Column:
    return v.col if isinstance(v.dtype, T.BooleanType) else v.col != 0


def _logical(f: Callable[[Column, Column], Column]) -> Callable:
    return elwise(forward_na(lambda a, b: Value(f(_truth(a), _truth(b)), BOOL)))


logical_and = _logical(lambda a, b: a & b)
logical_or = _logical(lambda a, b: a | b)
logical_xor = _logical(lambda a, b: a != b)
logical_not = elwise(lambda a: Value(~_truth(a), BOOL))


def _compare(f: Callable[[Column, Column], Column], structs: bool = False) -> Callable:
    def scalar(a: Value, b: Value) -> Value:
        if isinstance(a.dtype, T.StructType) or isinstance(b.dtype, T.StructType):
            if not structs:
                raise TypeError("structs have no order")
            if not is_complex(a.dtype) and not is_complex(b.dtype):
                return Value(f(a.col, b.col), BOOL)
            kind = promote(a.dtype, b.dtype)
            return Value(f(complexes.as_complex(a, kind).col, complexes.as_complex(b, kind).col), BOOL)
        kind = common(a.dtype, b.dtype)
        return Value(f(a.col.cast(kind), b.col.cast(kind)), BOOL)

    return elwise(forward_na(scalar))


less = _compare(lambda a, b: a < b)
less_equal = _compare(lambda a, b: a <= b)
greater = _compare(lambda a, b: a > b)
greater_equal = _compare(lambda a, b: a >= b)
equal = _compare(lambda a, b: a == b, structs=True)
not_equal = _compare(lambda a, b: a != b, structs=True)


def _total_order(a: Value, b: Value) -> Value:
    for v in (a, b):
        if not isinstance(v.dtype, (T.StringType, T.IntegerType, T.BooleanType)):
            raise TypeError("total_order: only for strings, int32 and bool")
    return Value((a.col < b.col).cast("int"), T.IntegerType())


#: 1 if the first argument sorts before the second, else 0.
total_order = elwise(_total_order)


def _math(f: Callable[[Column], Column]) -> Callable:
    return elwise(lambda a: Value(f(a.col.cast("double")), DOUBLE))


cos, sin, tan, exp = _math(F.cos), _math(F.sin), _math(F.tan), _math(F.exp)
sqrt = elwise(lambda a: complexes.sqrt(a) if is_complex(a.dtype) else Value(F.sqrt(a.col.cast("double")).cast(a.dtype if isinstance(a.dtype, T.FloatType) else DOUBLE), a.dtype if isinstance(a.dtype, T.FloatType) else DOUBLE))
cbrt = _unary(F.cbrt, keep=True)

# Mathematical constants.
CONSTANTS = {"pi": math.pi, "e": math.e, "log2e": 1 / math.log(2), "log10e": 1 / math.log(10), "ln2": math.log(2), "ln10": math.log(10),
             "pi_2": math.pi / 2, "pi_4": math.pi / 4, "1_pi": 1 / math.pi, "2_pi": 2 / math.pi, "2_sqrtpi": 2 / math.sqrt(math.pi),
             "sqrt2": math.sqrt(2), "1_sqrt2": math.sqrt(0.5)}


def constant(name: str) -> Value:
    return literal(CONSTANTS[name])


def _is_na(a: Value) -> Value:
    missing = a.col.isNull()
    if isinstance(a.dtype, (T.FloatType, T.DoubleType)):
        missing = missing | F.isnan(a.col)
    return Value(F.coalesce(missing, F.lit(True)), BOOL)


#: Whether each element is missing; for real numbers any NaN is.
is_na = elwise(_is_na)


def assign_na(dtype: T.DataType | str) -> Value:
    """A missing value of a type."""
    return literal(None, dtype)


def compound(f: Callable, name: str) -> Callable:
    """``x = f(x, y)`` on a column of a DataFrame."""

    def apply(df, column: str, other):
        from tessera.value import value

        target = value(df, column)
        return df.withColumn(column, f(target, literal(other)).col.cast(target.dtype))

    apply.__name__ = name
    return apply


compound_add, compound_div = compound(add, "compound_add"), compound(divide, "compound_div")
