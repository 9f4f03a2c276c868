"""Reductions over dimensions, within a cell and over rows.

Within a cell, ``reduction(identity, f)`` folds along chosen axes in the JVM;
ragged dimensions fold over what each row has. Over rows, the same reductions
are aggregates of exploded elements: partial aggregation first, one shuffle on
the kept indices, no array is ever built from more than one row.

Empty sums are 0, empty ``all`` is true, empty ``max``/``min`` are the least
and greatest value of the type. NaN never wins a maximum or minimum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import arithmetic
from tessera.functions.generators import limits
from tessera.functions.lifting import elwise, nested
from tessera.types import from_spark, is_complex
from tessera.value import Value, literal

BOOL, DOUBLE = T.BooleanType(), T.DoubleType()
Fold = Callable[[Value, Value], Value]


def reduction(identity, f: Fold) -> Callable[..., Value]:
    """A reduction by a binary function from an identity; ``axes`` (default: all), ``keepdims``, any number of arrays."""
    if identity is None or f is None:
        raise ValueError("reduction: an identity and a function are needed")

    def reduced(*args, axes: tuple[int, ...] | None = None, keepdims: bool = False, combine: Callable[..., Value] | None = None) -> Value:
        v = literal(args[0]) if len(args) == 1 else (combine or (lambda *x: x[0]))(*[literal(a) for a in args])
        first = identity(v.scalar) if callable(identity) else literal(identity)
        acc = f(first, Value(F.lit(None).cast(v.scalar), v.scalar)).dtype if v.depth else first.dtype
        start = Value(first.col.cast(acc), acc)
        if not v.depth:
            return Value(f(start, v).col.cast(acc), acc)
        chosen = set(range(v.depth) if axes is None else [a + v.depth if a < 0 else a for a in axes])
        if not chosen <= set(range(v.depth)):
            raise ValueError("reduction: no such axis")
        return _fold(v, chosen, 0, start, f, keepdims)

    return reduced


def _fold(v: Value, chosen: set[int], d: int, start: Value, f: Fold, keepdims: bool) -> Value:
    """v stands at dimension d; chosen dimensions fold, others stay."""
    if not isinstance(v.dtype, T.ArrayType):
        return Value(f(start, v).col.cast(start.dtype), start.dtype)
    item = v.dtype.elementType
    if d not in chosen:
        kind = _fold(Value(F.lit(None).cast(item), item), chosen, d + 1, start, f, keepdims).dtype
        return Value(F.transform(v.col, lambda x: _fold(Value(x, item), chosen, d + 1, start, f, keepdims).col), T.ArrayType(kind, True))
    depth = v.depth
    if all(d + k in chosen for k in range(depth)):
        line, t = v.col, v.dtype
        for _ in range(depth - 1):
            line, t = F.flatten(line), t.elementType
        out = Value(F.aggregate(line, start.col, lambda acc, x: f(Value(acc, start.dtype), Value(x, v.scalar)).col.cast(start.dtype)), start.dtype)
        for _ in range(depth if keepdims else 0):
            out = Value(F.array(out.col), T.ArrayType(out.dtype, True))
        return out
    # reduce what lies below each item, then fold the items together element by element
    below = _fold(Value(F.lit(None).cast(item), item), chosen, d + 1, start, f, keepdims).dtype
    parts = F.transform(v.col, lambda x: _fold(Value(x, item), chosen, d + 1, start, f, keepdims).col)
    joined = elwise(lambda a, b: Value(f(a, b).col.cast(start.dtype), start.dtype))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    col = F.aggregate(rest, F.get(parts, F.lit(0)), lambda acc, x: joined(Value(acc, below), Value(x, below)).col.cast(below))
    return Value(F.array(col), T.ArrayType(below, True)) if keepdims else Value(col, below)


sum_ = reduction(lambda t: Value(F.lit(0).cast(t) if not is_complex(t) else literal(0j).col.cast(t), t), lambda a, x: Value(arithmetic.add(a, x).col.cast(a.dtype), a.dtype))


def _edge(top: bool) -> Callable[[T.DataType], Value]:
    def identity(t: T.DataType) -> Value:
        if is_complex(t):
            raise TypeError("complex numbers have no order")
        return literal(limits(from_spark(t))[top], t)

    return identity


max_ = reduction(_edge(False), lambda a, x: Value(F.when(x.col.isNull(), x.col).when(~_nan(x) & (x.col > a.col), x.col).otherwise(a.col), a.dtype))
min_ = reduction(_edge(True), lambda a, x: Value(F.when(x.col.isNull(), x.col).when(~_nan(x) & (x.col < a.col), x.col).otherwise(a.col), a.dtype))


def _nan(x: Value) -> Column:
    return F.isnan(x.col) if isinstance(x.dtype, (T.FloatType, T.DoubleType)) else F.lit(False)


all_ = reduction(True, lambda a, x: Value(a.col & x.col, BOOL))
any_ = reduction(False, lambda a, x: Value(a.col | x.col, BOOL))
product = reduction(lambda t: Value(F.lit(1).cast(t), t), lambda a, x: Value(arithmetic.multiply(a, x).col.cast(a.dtype), a.dtype))


def _count(v: Value, **how) -> Value:
    return sum_(elwise(lambda x: Value(F.lit(1), T.IntegerType()))(v), **how)


def mean(v, axes: tuple[int, ...] | None = None, keepdims: bool = False) -> Value:
    """Sum over the number of elements, in double precision."""
    v = elwise(lambda x: Value(x.col.cast("double"), DOUBLE))(literal(v))
    return arithmetic.divide(sum_(v, axes=axes, keepdims=keepdims), _count(v, axes=axes, keepdims=keepdims))


def _valid(v) -> Value:
    """Elements in double precision, and missing where they are NaN."""
    return elwise(lambda x: Value(F.when(~F.isnan(x.col.cast("double")), x.col.cast("double")), DOUBLE))(literal(v))


def _some(v: Value, **how) -> Value:
    """Number of elements that are there."""
    return sum_(elwise(lambda x: Value(F.when(x.col.isNull(), 0).otherwise(1), T.IntegerType()))(v), **how)


_sum_some = reduction(0.0, lambda a, x: Value(a.col + F.coalesce(x.col, F.lit(0.0)), DOUBLE))
_product_some = reduction(1.0, lambda a, x: Value(a.col * F.coalesce(x.col, F.lit(1.0)), DOUBLE))
_max_some = reduction(float("-inf"), lambda a, x: Value(F.greatest(a.col, x.col), DOUBLE))
_min_some = reduction(float("inf"), lambda a, x: Value(F.least(a.col, x.col), DOUBLE))

# In the nan forms NaN does not exist: [1, NaN, 3] has two elements. Missing elements count as NaN there.


def nansum(v, **how) -> Value:
    return _sum_some(_valid(v), **how)


def nanproduct(v, **how) -> Value:
    return _product_some(_valid(v), **how)


def _edge_of(f: Callable[..., Value]) -> Callable[..., Value]:
    def found(v, **how) -> Value:
        v = _valid(v)
        keep = lambda x, n: Value(F.when(n.col > 0, x.col), DOUBLE)
        return elwise(keep)(f(v, **how), _some(v, **how))

    return found


#: Missing, if there is no element.
nanmax, nanmin = _edge_of(_max_some), _edge_of(_min_some)


def nanmean(v, **how) -> Value:
    v = _valid(v)
    return elwise(lambda x, n: Value(F.when(n.col > 0, x.col / n.col), DOUBLE))(_sum_some(v, **how), _some(v, **how))


def nanvar(v, axes: tuple[int, ...] | None = None, keepdims: bool = False, ddof: int = 1) -> Value:
    """Sum of squared distances from the mean over n - ddof; missing, if that is not positive."""
    v = _valid(v)
    middle = nanmean(v, axes=axes, keepdims=True)
    square = elwise(lambda x, m: Value((x.col - m.col) * (x.col - m.col), DOUBLE))(v, middle)
    return elwise(lambda s, n: Value(F.when(n.col > ddof, s.col / (n.col - ddof)), DOUBLE))(_sum_some(square, axes=axes, keepdims=keepdims), _some(v, axes=axes, keepdims=keepdims))


def nanstd(v, **how) -> Value:
    return elwise(lambda x: Value(F.sqrt(x.col), DOUBLE))(nanvar(v, **how))


def _all_or_nan(f: Callable[..., Value]) -> Callable[..., Value]:
    """A nan form made strict: NaN or missing if any element is."""
    broken = lambda v, **how: any_(elwise(lambda x: Value(x.col.isNull(), BOOL))(v), **how)

    def strict(v, axes: tuple[int, ...] | None = None, keepdims: bool = False, **how) -> Value:
        gone = broken(_valid(v), axes=axes, keepdims=keepdims)
        return elwise(lambda x, b: Value(F.when(b.col, F.lit(float("nan"))).otherwise(x.col), DOUBLE))(f(v, axes=axes, keepdims=keepdims, **how), gone)

    return strict


var, std = _all_or_nan(nanvar), _all_or_nan(nanstd)


def all_equal(a, b) -> Value:
    """Whether every pair of elements is equal."""
    return all_(arithmetic.equal(a, b))


def left_compound(f: Fold, start) -> Callable[[Value], Value]:
    """Fold from the left with the accumulator first."""
    return lambda v: _compound(literal(v), literal(start), lambda acc, x: f(acc, x))


def right_compound(f: Fold, start) -> Callable[[Value], Value]:
    """Fold from the left with the accumulator last."""
    return lambda v: _compound(literal(v), literal(start), lambda acc, x: f(x, acc))


def _compound(v: Value, start: Value, f: Fold) -> Value:
    item = v.dtype.elementType
    kind = f(start, Value(F.lit(None).cast(item), item)).dtype
    return Value(F.aggregate(v.col, start.col.cast(kind), lambda acc, x: f(Value(acc, kind), Value(x, item)).col.cast(kind)), kind)


# over rows


def _known(c: Column, t: T.DataType) -> Column:
    return F.when(~_nan(Value(c, t)), c)


_AGGREGATES: dict[str, Callable[[Column, T.DataType], Column]] = {
    "sum": lambda c, t: F.coalesce(F.sum(c), F.lit(0)),
    "max": lambda c, t: F.coalesce(F.max(F.when(~_nan(Value(c, t)), c)), literal(limits(from_spark(t))[0], t).col),
    "min": lambda c, t: F.coalesce(F.min(F.when(~_nan(Value(c, t)), c)), literal(limits(from_spark(t))[1], t).col),
    "mean": lambda c, t: F.avg(c),
    "all": lambda c, t: F.coalesce(F.bool_and(c), F.lit(True)),
    "any": lambda c, t: F.coalesce(F.bool_or(c), F.lit(False)),
    "count": lambda c, t: F.count(c),
    "std": lambda c, t: F.stddev_samp(c),
    "var": lambda c, t: F.var_samp(c),
    "product": lambda c, t: F.coalesce(F.product(c), F.lit(1.0)),
    "nansum": lambda c, t: F.coalesce(F.sum(_known(c, t)), F.lit(0.0)),
    "nanproduct": lambda c, t: F.coalesce(F.product(_known(c, t)), F.lit(1.0)),
    "nanmax": lambda c, t: F.max(_known(c, t)),
    "nanmin": lambda c, t: F.min(_known(c, t)),
    "nanmean": lambda c, t: F.avg(_known(c, t)),
    "nanstd": lambda c, t: F.stddev_samp(_known(c, t)),
    "nanvar": lambda c, t: F.var_samp(_known(c, t)),
}


def reduce_rows(df: DataFrame, column: str, how: str, keys: list[str] | None = None, axes: tuple[int, ...] | None = None) -> DataFrame:
    """Reduce an array column over all rows of each key; dimensions not in ``axes`` stay, as index columns i0, i1, ..."""
    from tessera.operators.arrays import iterate

    keys = keys or []
    t, depth = df.schema[column].dataType, 0
    while isinstance(t, T.ArrayType):
        t, depth = t.elementType, depth + 1
    gone = set(range(depth)) if axes is None else set(axes)
    rows = iterate(df, column, keys, depth)
    if isinstance(t, T.FloatType) and how in ("sum", "mean", "std", "var"):
        rows = rows.withColumn("value", F.col("value").cast("double"))
    kept = [*keys, *[f"i{d}" for d in range(depth) if d not in gone]]
    return rows.groupBy(*kept).agg(_AGGREGATES[how](F.col("value"), t).alias("value"))


__all__ = ["nested", "reduction", "reduce_rows"]
