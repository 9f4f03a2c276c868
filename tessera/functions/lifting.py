"""Lifting scalar functions over dimensions: element-wise with broadcasting, outer, and missing values.

Broadcasting aligns trailing dimensions: a value with fewer dimensions is used
whole for each item of the others, and a dimension of size 1 is stretched;
other differing sizes are an error. Arrays of one size take the ``zip_with``
path; only the stretched case indexes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.value import Value, literal

Scalar = Callable[..., Value]


def nested(dtype: T.DataType, depth: int) -> T.DataType:
    for _ in range(depth):
        dtype = T.ArrayType(dtype, True)
    return dtype


def fail(message: str, dtype: T.DataType) -> Column:
    return F.raise_error(F.lit(message)).cast(dtype)


def bound(values: list[Value], f: Callable[..., Value]) -> Value:
    """f of values that it names several times, each computed once.

    Plain columns are passed as they are. Anything longer is bound to a lambda
    variable, so that chains of functions grow by their length and not by
    copies of copies.
    """
    if all(v.plain for v in values):
        return f(*values)
    dtype = f(*[Value(F.lit(None).cast(v.dtype), v.dtype) for v in values]).dtype
    packed = F.array(F.struct(*[v.col.alias(f"_{k}") for k, v in enumerate(values)]))
    return Value(F.get(F.transform(packed, lambda s: f(*[Value(s[f"_{k}"], v.dtype, plain=True) for k, v in enumerate(values)]).col), F.lit(0)), dtype)


def once(col: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that it names several times, computed once."""
    return F.get(F.transform(F.array(col), f), F.lit(0))


def elwise(f: Scalar) -> Callable[..., Value]:
    """f on scalar Values becomes a function of values of any dimensions."""

    def lifted(*args) -> Value:
        values = [literal(a) for a in args]
        depth = max(v.depth for v in values)
        if not depth:
            return f(*values)
        # resolve the scalar function once for the type of the result
        out = f(*[Value(F.lit(None).cast(v.scalar), v.scalar) for v in values]).dtype
        item, whole = nested(out, depth - 1), nested(out, depth)
        deep = [k for k, v in enumerate(values) if v.depth == depth]

        def inner(*items: Column) -> Column:
            now = list(values)
            for k, x in zip(deep, items, strict=True):
                now[k] = Value(x, values[k].dtype.elementType, plain=True)
            return lifted(*now).col.cast(item)

        if len(deep) == 1:
            return Value(F.transform(values[deep[0]].col, lambda x: inner(x)), whole)

        def together(*several: Value) -> Value:
            arrays = [v.col for v in several]
            sizes = [F.size(a) for a in arrays]
            n = sizes[0]
            for s in sizes[1:]:
                n = F.when(n == 1, s).otherwise(n)
            fits = None
            for s in sizes:
                ok = (s == n) | (s == 1)
                fits = ok if fits is None else fits & ok
            at = lambda a, s, i: F.get(a, F.when(s == 1, F.lit(0)).otherwise(i))
            count = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
            stretched = F.transform(count, lambda i: inner(*[at(a, s, i) for a, s in zip(arrays, sizes, strict=True)]))
            some = arrays[0].isNotNull()
            for a in arrays[1:]:
                some = some & a.isNotNull()
            error = fail("shapes can't be broadcast together", whole)
            if len(deep) == 2:
                same = F.zip_with(arrays[0], arrays[1], lambda x, y: inner(x, y))
                col = F.when(sizes[0] == sizes[1], same).when(fits, stretched).otherwise(error)
            else:
                col = F.when(fits, stretched).otherwise(error)
            return Value(F.when(some, col), whole)

        return bound([values[k] for k in deep], together)

    return lifted


def forward_na(f: Scalar) -> Scalar:
    """Strict: the result is missing if any argument is."""

    def strict(*args) -> Value:
        values = [literal(a) for a in args]
        out = f(*values)
        missing = values[0].col.isNull()
        for v in values[1:]:
            missing = missing | v.col.isNull()
        return Value(F.when(~missing, out.col), out.dtype)

    return strict


def outer(f: Scalar) -> Callable[..., Value]:
    """f on all combinations: the dimensions of the arguments are put one after the other."""
    scalar = elwise(f)

    def combined(*args) -> Value:
        values = [literal(a) for a in args]

        def go(k: int, done: list[Value]) -> Value:
            if k == len(values):
                return scalar(*done)
            return over(values[k], k, done)

        def over(v: Value, k: int, done: list[Value]) -> Value:
            if not v.depth:
                return go(k + 1, [*done, v])
            item = v.dtype.elementType
            kind = over(Value(F.lit(None).cast(item), item), k, done).dtype
            return Value(F.transform(v.col, lambda x: over(Value(x, item), k, done).col), T.ArrayType(kind, True))

        return go(0, [])

    return combined


def state_elwise(f: Callable[[Value, Column], Value]) -> Callable[[Value], Value]:
    """f gets each element of a 1-d value and its index."""

    def indexed(a) -> Value:
        a = literal(a)
        item = a.dtype.elementType
        kind = f(Value(F.lit(None).cast(item), item), F.lit(0)).dtype
        return Value(F.transform(a.col, lambda x, i: f(Value(x, item), i).col), T.ArrayType(kind, True))

    return indexed


def map_column(f: Callable[[Column], Column], dtype: T.DataType) -> Scalar:
    return lambda v: Value(f(v.col), dtype)
