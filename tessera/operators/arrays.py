"""Structure of n-dimensional values: fields, indexing, taking, reshaping, sorting and searching.

All are array expressions evaluated in the JVM, one cell at a time: no shuffle,
and only the columns that are named are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.lifting import bound, fail
from tessera.value import Value, literal

LONG, INT = T.LongType(), T.IntegerType()


def field_access(v: Value, name: str) -> Value:
    """Field of a struct; of an array of structs, the array of that field."""
    if isinstance(v.dtype, T.ArrayType):
        item = v.dtype.elementType
        kind = field_access(Value(F.lit(None).cast(item), item), name).dtype
        return Value(F.transform(v.col, lambda x: field_access(Value(x, item), name).col), T.ArrayType(kind, True))
    if not isinstance(v.dtype, T.StructType) or name not in v.dtype.names:
        raise AttributeError(f"{v.dtype.simpleString()} has no property {name!r}")
    return Value(v.col.getField(name), v.dtype[name].dataType)


def _place(i: Column, n: Column) -> Column:
    """0-based place of an index that may count from the end; out of range is an error."""
    at = F.when(i < 0, i + n).otherwise(i)
    return F.when((at >= 0) & (at < n), at).otherwise(fail("index out of range", INT)).cast("int")


def _one(v: Value, i) -> Value:
    return bound([v], lambda x: _item(x, i))


def _item(v: Value, i) -> Value:
    i = literal(i).col
    item = v.dtype.elementType
    return Value(F.when(v.col.isNotNull() & i.isNotNull(), F.get(v.col, _place(i, F.size(v.col)))), item)


def _slice(v: Value, s: slice) -> Value:
    """Python slices with checks: a start past the end, or an end before the start of the array, is an error."""
    n = F.size(v.col)
    step = 1 if s.step is None else int(s.step)
    if step == 0:
        raise ValueError("slice: step is 0")
    bound = lambda x: literal(x).col.cast("int")
    error = fail("slice out of range", INT)
    if step > 0:
        start, stop = F.lit(0), n
        if s.start is not None:
            a = bound(s.start)
            start = F.when(a >= n, F.when(a == 0, a).otherwise(error)).when(a < -n, F.lit(0)).when(a < 0, a + n).otherwise(a)
        if s.stop is not None:
            b = bound(s.stop)
            stop = F.when(b < -n, error).when(b < 0, b + n).otherwise(F.least(b, n))
        part = F.slice(v.col, start + 1, F.greatest(stop - start, F.lit(0)))
        col = part if step == 1 else F.filter(part, lambda _, i: i % step == 0)
    else:
        inside = lambda x: F.when((x >= n) | (x < -n), error).when(x < 0, x + n).otherwise(x)
        start = n - 1 if s.start is None else inside(bound(s.start))
        stop = F.lit(-1) if s.stop is None else inside(bound(s.stop))
        part = F.reverse(F.slice(v.col, stop + 2, F.greatest(start - stop, F.lit(0))))
        col = part if step == -1 else F.filter(part, lambda _, i: i % -step == 0)
    return Value(F.when(v.col.isNotNull(), col), v.dtype)


def index(v: Value, *at) -> Value:
    """Indices drop a dimension, slices keep it; each applies to one dimension in turn."""
    if not at:
        return v
    if not isinstance(v.dtype, T.ArrayType):
        raise IndexError("too many indices")
    first, rest = at[0], at[1:]
    if not isinstance(first, slice):
        return index(_one(v, first), *rest)
    cut = v if first == slice(None) else bound([v], lambda x: _slice(x, first))
    if not rest:
        return cut
    item = v.dtype.elementType
    kind = index(Value(F.lit(None).cast(item), item), *rest).dtype
    return Value(F.transform(cut.col, lambda x: index(Value(x, item), *rest).col), T.ArrayType(kind, True))


def take(v: Value, at) -> Value:
    """Items where a mask is true, or at indices (in their order, repeated as often as they are)."""
    return bound([v, literal(at)], _take)


def _take(v: Value, at: Value) -> Value:
    kind = at.dtype.elementType
    if isinstance(kind, T.BooleanType):
        picked = F.filter(v.col, lambda _, i: F.coalesce(F.get(at.col, i), F.lit(False)))
        return Value(F.when(F.size(v.col) == F.size(at.col), picked).otherwise(fail("take: the mask has another size", v.dtype)), v.dtype)
    if not isinstance(kind, T.IntegralType):
        raise TypeError("take: indices must be integers or booleans")
    return Value(F.transform(at.col, lambda i: F.get(v.col, _place(i, F.size(v.col)))), v.dtype)


def where(pred: Callable[[Value], Value]) -> Callable[[Value], Value]:
    """Indices of the items for which the predicate is true."""

    def indices(v) -> Value:
        v = literal(v)
        item = v.dtype.elementType
        marked = F.transform(v.col, lambda x, i: F.when(pred(Value(x, item)).col, i.cast("long")))
        return Value(F.array_compact(marked), T.ArrayType(LONG, False))

    return indices


def where_rows(df: DataFrame, column: str, pred: Callable[[Value], Value], key: list[str]) -> DataFrame:
    """The same as rows: key, index, value."""
    item = df.schema[column].dataType.elementType
    rows = df.select(*key, F.posexplode(column).alias("index", "value"))
    return rows.filter(pred(Value(F.col("value"), item)).col)


def pack(**values) -> Value:
    """A struct of values."""
    fields = {n: literal(v) for n, v in values.items()}
    return Value(F.struct(*[v.col.alias(n) for n, v in fields.items()]), T.StructType([T.StructField(n, v.dtype) for n, v in fields.items()]))


def as_tuple(*values) -> Value:
    return pack(**{f"_{k}": v for k, v in enumerate(values)})


def concatenate(a: Value, b: Value) -> Value:
    """Two 1-d values of one type, one after the other."""
    if a.dtype.simpleString() != b.dtype.simpleString() or a.depth != 1:
        raise TypeError("concatenate: only for 1-d values of the same type")
    return Value(F.concat(a.col, b.col), a.dtype)


def flat(v: Value) -> Value:
    """All elements in C order."""
    while v.depth > 1:
        v = Value(F.flatten(v.col), v.dtype.elementType)
    return v


def _rows_of(line: Value, count: int, n: int) -> Value:
    rows = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice(line.col, i * n + 1, n))
    return Value(rows, T.ArrayType(line.dtype, False))


def reshape(v: Value, shape: tuple[int, ...]) -> Value:
    """The elements in C order, in another shape with as many."""
    return bound([flat(v)], lambda line: _shaped(line, shape))


def _shaped(line: Value, shape: tuple[int, ...]) -> Value:
    total = 1
    for n in shape:
        total *= n
    col = F.when(F.size(line.col) == total, line.col).otherwise(fail(f"reshape: not {total} elements", line.dtype))
    out = Value(col, line.dtype)
    for k in range(len(shape) - 1, 0, -1):
        n = shape[k]
        count = 1
        for m in shape[:k]:
            count *= m
        out = _rows_of(out, count, n)
    return out


def shape_of(v: Value) -> list[Column]:
    """Sizes along the first items: the shape, where dimensions are not ragged."""
    out, col, t = [], v.col, v.dtype
    while isinstance(t, T.ArrayType):
        out.append(F.size(col))
        col, t = F.get(col, F.lit(0)), t.elementType
    return out


def permute(v: Value, axes: tuple[int, ...]) -> Value:
    """Dimensions in another order: dimension k of the result is dimension axes[k]."""
    if sorted(axes) != list(range(len(axes))) or len(axes) > v.depth:
        raise ValueError("permute: axes must be a permutation of the first dimensions")
    return bound([v], lambda x: _permuted(x, axes))


def _permuted(v: Value, axes: tuple[int, ...]) -> Value:
    sizes = shape_of(v)
    inner = v.dtype
    for _ in axes:
        inner = inner.elementType

    def build(k: int, at: dict[int, Column]) -> Column:
        if k == len(axes):
            col = v.col
            for d in range(len(axes)):
                col = F.get(col, at[d])
            return col
        n = sizes[axes[k]]
        count = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(count, lambda i: build(k + 1, at | {axes[k]: i}))

    dtype = inner
    for _ in axes:
        dtype = T.ArrayType(dtype, True)
    return Value(F.when(v.col.isNotNull(), build(0, {})), dtype)


def transpose(v: Value) -> Value:
    """Dimensions in reverse order."""
    return permute(v, tuple(reversed(range(v.depth))))


def rotate(v: Value, to: int, source: int = 0) -> Value:
    """One dimension moved to another place."""
    axes = [d for d in range(v.depth) if d != source]
    axes.insert(to, source)
    return permute(v, tuple(axes))


def new_axis(v: Value, i: int, n: int = 1) -> Value:
    """n dimensions of size 1 put in at dimension i."""
    if i == 0:
        for _ in range(n):
            v = Value(F.array(v.col), T.ArrayType(v.dtype, True))
        return v
    item = v.dtype.elementType
    kind = new_axis(Value(F.lit(None).cast(item), item), i - 1, n).dtype
    return Value(F.transform(v.col, lambda x: new_axis(Value(x, item), i - 1, n).col), T.ArrayType(kind, True))


def sort(v: Value) -> Value:
    """Ascending, along the only dimension."""
    if v.depth != 1:
        raise TypeError("sort: only for 1-d values")
    return Value(F.array_sort(v.col), v.dtype)


def unique(v: Value) -> Value:
    """Without repeats of the item before: distinct items of a sorted value."""

    def kept(v: Value) -> Value:
        return Value(F.filter(v.col, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(v.col, F.greatest(i - 1, F.lit(0))))), v.dtype)

    return bound([v], kept)


def binary_search(v: Value, x) -> Value:
    """A place of x in an ascending value, or -1: halving in a fold over the bits of the size."""
    if isinstance(v.dtype.elementType, (T.StructType, T.ArrayType)):
        raise TypeError("binary_search: only for scalars with an order")
    return bound([v, literal(x)], _searched)


def _searched(v: Value, x: Value) -> Value:
    x = x.col.cast(v.dtype.elementType)
    n = F.size(v.col)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = (s["lo"] < s["hi"]) & (F.get(v.col, mid) < x)
        lo = F.when(below, mid + 1).otherwise(s["lo"])
        hi = F.when(~below & (s["lo"] < s["hi"]), mid).otherwise(s["hi"])
        return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    at = F.aggregate(steps, start, halve)["lo"]
    return Value(F.when((at < n) & (F.get(v.col, at) == x), at).otherwise(F.lit(-1)).cast("long"), LONG)


def equals_exact(a: Value, b: Value) -> Value:
    """Same type and same values, missing ones included."""
    same = a.dtype.simpleString() == b.dtype.simpleString()
    return Value(a.col.eqNullSafe(b.col) if same else F.lit(False), T.BooleanType())


def iterate(df: DataFrame, column: str, key: list[str], depth: int = 1) -> DataFrame:
    """Elements as rows: key, one index column for each dimension, value."""
    out = df.select(*key, F.col(column).alias("value"))
    for d in range(depth):
        keep = [*key, *[f"i{k}" for k in range(d)]]
        out = out.select(*keep, F.posexplode("value").alias(f"i{d}", "value"))
    return out


def identity(v) -> Value:
    """View, evaluation, copy to host and dereference: a column is a value already."""
    return literal(v)
