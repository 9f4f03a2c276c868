"""Typed column values.

A :class:`Value` is a Column with its Spark type, so that functions resolve at
plan-building time, as overloads: nothing is dispatched per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Value:
    """A lazily computed n-dimensional value: one cell of each row.

    ``plain``: the column is a name or a bound variable, so that naming it
    several times costs nothing.
    """

    __slots__ = ("col", "dtype", "plain")

    def __init__(self, col: Column, dtype: T.DataType, plain: bool = False):
        self.col, self.dtype, self.plain = col, dtype, plain

    @property
    def depth(self) -> int:
        """Number of dimensions."""
        d, t = 0, self.dtype
        while isinstance(t, T.ArrayType):
            d, t = d + 1, t.elementType
        return d

    @property
    def scalar(self) -> T.DataType:
        """Type of the elements."""
        t = self.dtype
        while isinstance(t, T.ArrayType):
            t = t.elementType
        return t

    def alias(self, name: str) -> Column:
        return self.col.alias(name)

    def __repr__(self) -> str:
        return f"Value<{self.dtype.simpleString()}>"

    # operators and calls by name go through the registry, imported late as it imports this module
    def _call(self, name: str, *others) -> Value:
        from tessera import registry

        return registry.get(name)(self, *others)

    def f(self, name: str, *args, **kw) -> Value:
        """Call a registered function with this value first."""
        from tessera import registry

        return registry.get(name)(self, *args, **kw)

    def p(self, name: str) -> Value:
        """A property: a field of a struct."""
        return self._call("field_access", name)

    def __getitem__(self, at) -> Value:
        from tessera.operators.arrays import index

        return index(self, *(at if isinstance(at, tuple) else (at,)))


for _dunder, _name in {
    "add": "add", "sub": "subtract", "mul": "multiply", "truediv": "divide", "mod": "mod", "pow": "pow",
    "and": "bitwise_and", "or": "bitwise_or", "xor": "bitwise_xor", "lshift": "left_shift", "rshift": "right_shift",
    "lt": "less", "le": "less_equal", "gt": "greater", "ge": "greater_equal", "eq": "equal", "ne": "not_equal",
}.items():
    setattr(Value, f"__{_dunder}__", lambda self, other, _n=_name: self._call(_n, other))
for _dunder, _name in {"neg": "minus", "pos": "plus", "invert": "bitwise_not"}.items():
    setattr(Value, f"__{_dunder}__", lambda self, _n=_name: self._call(_n))
Value.__hash__ = None


def value(df: DataFrame, name: str) -> Value:
    """A column of ``df`` (dots reach into structs) as a value."""
    t: T.DataType = df.schema
    for part in name.split("."):
        t = t[part].dataType
    return Value(F.col(name), t, plain=True)


def _type_of(x) -> T.DataType:
    if x is None:
        return T.NullType()
    if isinstance(x, bool):
        return T.BooleanType()
    if isinstance(x, int):
        return T.IntegerType() if -(2**31) <= x < 2**31 else T.LongType()
    if isinstance(x, float):
        return T.DoubleType()
    if isinstance(x, complex):
        return T.StructType([T.StructField(n, T.DoubleType(), True) for n in ("re", "im")])
    if isinstance(x, (bytes, bytearray)):
        return T.BinaryType()
    if isinstance(x, (list, tuple)):
        kinds = [_type_of(y) for y in x if y is not None]
        kind = next((k for k in kinds if isinstance(k, (T.DoubleType, T.ArrayType))), kinds[0] if kinds else T.NullType())
        if any(isinstance(k, T.LongType) for k in kinds) and isinstance(kind, T.IntegerType):
            kind = T.LongType()
        return T.ArrayType(kind, any(y is None for y in x))
    return T.StringType()


def literal(x, dtype: T.DataType | str | None = None) -> Value:
    """A constant: nested lists make nested arrays. A Value passes through."""
    from tessera.types import to_spark

    if isinstance(x, Value):
        return x
    dtype = to_spark(dtype) if isinstance(dtype, str) else dtype or _type_of(x)

    def build(y, t):
        if y is None:
            return F.lit(None).cast(t)
        if isinstance(t, T.ArrayType):
            return F.array(*[build(z, t.elementType) for z in y]).cast(t)
        if isinstance(y, complex):
            return F.struct(F.lit(y.real).alias("re"), F.lit(y.imag).alias("im")).cast(t)
        return F.lit(y).cast(t)

    return Value(build(x, dtype), dtype)
