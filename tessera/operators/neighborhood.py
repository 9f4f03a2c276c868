"""Neighbourhoods: a reduction of the window around each element.

``out[i] = op(a[i + offset : i + offset + shape])``; where the window leaves
the array the boundary value is given. Within a cell it is an array expression
(1 to 3 dimensions); over rows it is a window frame, one shuffle on the
partition keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions.lifting import bound, nested
from tessera.operators.arrays import shape_of
from tessera.value import Value, literal


def neighborhood(op: Callable[[Value], Value], boundary=None) -> Callable[..., Value]:
    """op: a function of a window, as many-dimensional as the value."""

    def applied(v, shape: int | tuple[int, ...], offset: int | tuple[int, ...] = 0) -> Value:
        return bound([literal(v)], lambda x: windows(x, shape, offset))

    def windows(v: Value, shape: int | tuple[int, ...], offset: int | tuple[int, ...]) -> Value:
        shape = (shape,) if isinstance(shape, int) else tuple(shape)
        d = len(shape)
        offset = (offset,) * d if isinstance(offset, int) else tuple(offset)
        kind = op(Value(F.lit(None).cast(nested(v.scalar, d)), nested(v.scalar, d))).dtype
        edge = literal(boundary).col.cast(kind)
        sizes = shape_of(v)

        def window(col: Column, at: list[Column], k: int = 0) -> Column:
            part = F.slice(col, at[k] + offset[k] + 1, shape[k])
            return part if k == d - 1 else F.transform(part, lambda x: window(x, at, k + 1))

        def build(k: int, at: list[Column]) -> Column:
            if k == d:
                inside = F.lit(True)
                for i, o, w, n in zip(at, offset, shape, sizes, strict=True):
                    inside = inside & (i + o >= 0) & (i + o + w <= n)
                safe = [F.when(inside, i).otherwise(F.lit(-o)) for i, o in zip(at, offset, strict=True)]
                return F.when(inside, op(Value(window(v.col, safe), nested(v.scalar, d))).col).otherwise(edge)
            n = sizes[k]
            count = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(count, lambda i: build(k + 1, [*at, i]))

        return Value(F.when(v.col.isNotNull(), build(0, [])), nested(kind, d))

    return applied


def rolling_rows(df: DataFrame, op: Callable[[Column], Column], column: str, keys: list[str], order: list[str], size: int, offset: int, name: str) -> DataFrame:
    """The 1-d form over ordered rows: the aggregate of rows offset .. offset + size - 1, missing where fewer exist."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(offset, offset + size - 1)
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(w) == size, op(F.col(column)).over(w)))


def convolve(v: Value, kernel: list[float], mode: str = "valid") -> Value:
    """1-d convolution with a short kernel: sums of products over slices, ``valid`` or ``full``."""
    n = len(kernel)
    pad = F.array_repeat(F.lit(0.0), n - 1)
    col = v.col.cast("array<double>")
    if mode == "full":
        col = F.concat(pad, col, pad)
    weights = F.array(*[F.lit(float(k)) for k in reversed(kernel)])
    count = F.when(F.size(col) >= n, F.sequence(F.lit(0), F.size(col) - n)).otherwise(F.array().cast("array<int>"))
    one = lambda i: F.aggregate(F.zip_with(F.slice(col, i + 1, n), weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return Value(F.transform(count, one), T.ArrayType(T.DoubleType(), True))
